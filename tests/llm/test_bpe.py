"""Byte-level BPE against the tiktoken library, texts cut into chunks and whole."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from gridlore.llm import bpe
from gridlore.llm.queries import QUERIES


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts(n, length, seed):
    r = random.Random(seed)
    signs = [*"ab's t'rel 'vm d'l1 2!?-\n\t　 éüß漢字\U0001f600½٣\x1c\x85\x00", "'re", "'ll", " 's", "!'s", "  ", "\n\n ", "<|endoftext|>"]
    return ["".join(r.choice(signs) for _ in range(r.randrange(length))) for _ in range(n)]


def test_pieces_are_the_patterns(ranks, library):
    texts = [*_texts(5000, 60, 1), "", " ", "a" * 5000, "ab" * 3000, " " * 1000 + "x", "!" * 700 + "'s", "x" * 127 + " " + "y" * 129]
    got = bpe.Coder({"ranks": ranks}).encode_all(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode_ordinary(t) for t in texts]


def test_every_character_has_the_patterns_class(ranks, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b 1{chr(c)} {chr(c)}!\n" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    got = bpe.Coder({"ranks": ranks}).encode_all(texts)
    assert all(np.frombuffer(g, "<u4").tolist() == library.encode_ordinary(t) for g, t in zip(got, texts, strict=True))


def test_a_scan_is_right_from_the_second_change_of_class(ranks):
    coder, r = bpe.Coder({"ranks": ranks}), random.Random(2)
    for text in _texts(1500, 40, 3):
        if len(text) > 1:
            at = r.randrange(1, len(text))
            true, own, sure = coder.sure(text, True), coder.sure(text[at:], True) + at, coder.settled_from(text[at:]) + at
            assert true[true >= sure].tolist() == own[own >= sure].tolist(), (text, at)


@pytest.mark.parametrize("size,overlap", [(40, 8), (64, 20)])
def test_chunks_are_stitched(spark, ranks, library, size, overlap):
    texts = [None, "", *_texts(40, 400, 4), "a" * 300, "'" * 100 + "s" * 100, "x " * 150, "z" * 39 + "'re" * 60, " " * 200 + "end", "!" * 39 + "'s" + "k" * 90 + " it's"]
    rows = [(i % 9 if i % 7 else None, t, "own") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(5)
    parts = bpe.decode(bpe.encode(df, ["doc_id"], "text", ranks, size, overlap), ranks)
    held: dict = {}
    for p in parts.collect():
        held.setdefault(p["row"], []).append(p)
    assert len(held) == len(rows)
    got = []
    for ps in held.values():
        assert [p["part"] for p in ps] == list(range(ps[0]["parts"]))
        got.append((ps[0]["doc_id"], b"".join(p["decoded"] for p in ps).decode(), np.frombuffer(b"".join(p["ids"] for p in ps), "<u4").tolist()))
    want = [(k, t or "", library.encode_ordinary(t or "")) for k, t, _ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert max(len(ps) for ps in held.values()) > 3
    hashed = bpe.digests(parts, ["doc_id"]).collect()
    digest = lambda ids, t: (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert sorted((tuple(r) for r in hashed), key=repr) == sorted(((k, *digest(ids, t)) for k, t, ids in want), key=repr)


def test_query(spark, sf, library):
    got = {r["doc_id"]: r for r in QUERIES["op13_byte_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = library.encode_ordinary(d["text"] or ""), got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_empty_table_and_clashing_names(spark, ranks):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.decode(bpe.encode(none, ["doc_id"], "text", ranks), ranks), ["doc_id"]).collect() == []
    odd = spark.createDataFrame([(1, "a b", 2, "x"), (None, None, 3, "y")], "doc_id long, text string, ids int, piece string")
    assert sorted(r["parts"] for r in bpe.encode(odd, ["doc_id"], "text", ranks).collect()) == [1, 1]
    with pytest.raises(ValueError, match="longer than their overlap"):
        bpe.encode(none, ["doc_id"], "text", ranks, 10, 10)
