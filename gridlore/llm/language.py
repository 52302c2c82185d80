"""Language identification by cross-parsing entropy (operator 4)."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm._common import map_texts, slices

#: Symbols of one parsed block; a block's first phrase starts anew.
BLOCK = 1024
#: Letters with a symbol of their own at most, and symbols that all others share.
LETTERS, SHARED = 180, 8
#: Bytes of all languages' automata; with many languages each learns from less text.
MODEL_BYTES = 256 << 20


@dataclass
class Parser:
    """A language's suffix automaton as a table: next state times 2, plus 1 if a phrase ended before the symbol."""

    language: str
    table: np.ndarray
    bits: float  # of naming a place in the labelled text


@dataclass
class Model:
    letters: str
    parsers: list[Parser]


def symbols(text: str, letters: str) -> np.ndarray:
    """Numbers of the letters, lower-cased; each run of anything else is one 0."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = _symbol_table(letters)[np.minimum(points, 0xFFFF)]
    keep = out > 0
    keep[1:] |= out[:-1] > 0
    keep[:1] = True
    return out[keep]


_TABLES: dict[str, np.ndarray] = {}


def _symbol_table(letters: str) -> np.ndarray:
    if letters not in _TABLES:
        table = np.zeros(0x10000, np.uint8)
        for point in range(0xFFFF):
            c = chr(point)
            if c.isalpha():
                low = c.lower()[0]
                at = letters.find(low)
                table[point] = at + 1 if at >= 0 else 1 + len(letters) + ord(low) % SHARED
        table[0xFFFF] = 1 + len(letters)  # beyond the first plane
        _TABLES[letters] = table
    return _TABLES[letters]


def automaton(text: np.ndarray, width: int) -> np.ndarray:
    """The parsing table of the suffix automaton of `text`, whose symbols are below `width`; the last state begins a parse."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        now = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = now
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    dead = len(nexts)  # after a symbol that the text lacks, and before the first one
    root = np.array([nexts[0].get(c, dead) for c in range(width)], np.int32)
    table = np.tile(root * 2 + 1, (len(nexts) + 1, 1))
    for state, own in enumerate(nexts):
        for c, to in own.items():
            table[state, c] = to * 2
    return table.astype(np.int32)


def phrases(blocks: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Phrases of each block: columns of symbols, longest first, all parsed in step."""
    width = table.shape[1]
    flat = table.ravel()
    state = np.full(blocks.shape[1], len(table) - 1, np.int64)
    count = np.zeros(blocks.shape[1], np.int64)
    active = np.searchsorted(-lengths, -np.arange(1, blocks.shape[0] + 1), side="right")
    for at in range(blocks.shape[0]):
        n = int(active[at])
        if n == 0:
            break
        to = flat[state[:n] * width + blocks[at, :n]]
        count[:n] += to & 1
        state[:n] = to >> 1
    return count


def parse(texts: list[str | None], model: Model) -> np.ndarray:
    """Bits of each text in each language: phrases, times the bits of naming one; a symbol that the language lacks costs the longest text's bits more.

    Blocks of BLOCK symbols are parsed apart.
    """
    parts = [symbols(t, model.letters) if t else np.zeros(0, np.uint8) for t in texts]
    blocks = np.array([-(-len(p) // BLOCK) for p in parts])
    owner = np.repeat(np.arange(len(parts)), blocks)
    lengths = np.array([min(BLOCK, len(p) - at) for p in parts for at in range(0, len(p), BLOCK)], np.int64)
    grid = np.zeros((len(lengths), BLOCK), np.uint8)
    row = 0
    for p, n in zip(parts, blocks, strict=True):
        if n:
            grid[row : row + n].ravel()[: len(p)] = p
        row += n
    order = np.argsort(-lengths, kind="stable")
    columns = np.ascontiguousarray(grid[order].T)
    out = np.zeros((len(texts), len(model.parsers)))
    width = 1 + len(model.letters) + SHARED
    held = np.repeat(np.arange(len(parts)) * width, [len(p) for p in parts]) + np.concatenate(parts)
    held = np.bincount(held, minlength=len(parts) * width).reshape(len(parts), width)
    dearest = max(p.bits for p in model.parsers)
    for k, parser in enumerate(model.parsers):
        counts = phrases(columns, lengths[order], parser.table)
        lacks = parser.table[0] >> 1 == len(parser.table) - 1
        out[:, k] = np.bincount(owner[order], counts, minlength=len(texts)) * parser.bits + held[:, lacks].sum(axis=1) * dearest
    return out


def decide(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the fewest bits, the first of equal ones, and its share of 2 ** (-bits / 16)."""
    best = bits.argmin(axis=1)
    over = np.minimum((bits - bits.min(axis=1, keepdims=True)) / 16, 1000)
    return best, 1 / np.exp2(-over).sum(axis=1)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_chars: int = 24576, sample_docs: int = 64, model_bytes: int = MODEL_BYTES) -> Model:
    """Suffix automata of a bounded sample: of each language, texts in the order of their hash, up to `sample_chars` characters.

    At most `sample_docs` different texts a language come to the driver, and
    `sample_chars` characters of each. Every label that has a text with a letter is learned; if there are so
    many that the automata would have more than `model_bytes`, each learns from
    fewer characters. A language with less text than others learns from what it
    has; naming a place in a shorter text takes fewer bits. Letters get symbols
    by their greatest share in a language's text, so that each script has its
    own. Rows without a label or a letter are no sample; rows that repeat a text
    count once, whatever their ids; an empty table gives a model without languages.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null").where(F.col("text").rlike(r"\p{L}")).withColumn("at", F.xxhash64("text"))
    counts = {r["lang"]: (r["n"], r["least"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("at").alias("n"), F.min("at").alias("least")).collect()}
    if not counts:
        return Model("", [])
    bound = F.create_map(*[F.lit(x) for k, (n, least) in counts.items() for x in (k, max(least, min(2**63 - 1, int(2**64 * (2 * sample_docs / n)) - 2**63)))])
    few = rows.where(F.col("at") <= F.try_element_at(bound, F.col("lang"))).select("lang", "at", F.substring("text", 1, sample_chars).alias("text")).dropDuplicates(["lang", "at"])
    picked = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("at"))).where(F.col("k") <= sample_docs)
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in picked.collect():
        texts.setdefault(r["lang"], []).append((r["at"], r["text"]))
    joined = {k: "\n".join(t for _, t in sorted(v))[:sample_chars] for k, v in texts.items()}
    shares: dict[str, float] = {}
    for t in joined.values():
        seen = Counter(c for c in t.lower() if c.isalpha())
        for c, n in seen.items():
            shares[c] = max(shares.get(c, 0.0), n / seen.total())
    letters = "".join(sorted(c for c, _ in sorted(shares.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]))
    width = 1 + len(letters) + SHARED
    most = max(1, model_bytes // (8 * width * max(1, len(joined))))  # two states a character at most, 4 bytes a symbol
    parsers = []
    for k in sorted(joined):
        text = symbols(joined[k][:most], letters)
        parsers.append(Parser(k, automaton(text, width), float(np.log2(len(text) + 1))))
    return Model(letters, parsers)


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """`docs` with the language of each whole text and a score from 0 to 1 for it.

    A text is parsed into the longest pieces that the labelled text of a
    language holds; the language that needs the fewest bits for its pieces
    wins, the first in order of name among equals. The language is "und", with
    score 0, if the text is null or has no letter, or nothing was learned.
    Other columns pass through untouched; `lang_name` and `score_name` must be
    free names. Rows that repeat each come out; an empty table stays empty.
    """
    if not model.parsers:
        return docs.withColumns({lang_name: F.lit("und"), score_name: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast((model.letters, [(p.language, p.table, p.bits) for p in model.parsers]))
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        letters, parsers = shared.value
        model = Model(letters, [Parser(*p) for p in parsers])
        tags = [p.language for p in model.parsers]
        for batch in slices(batches, 2 << 20):
            texts = batch.column(at).to_pylist()
            letter = batch.column(len(names)).to_pylist()
            best, score = decide(parse([t if ok else None for t, ok in zip(texts, letter, strict=True)], model))
            lang = [tags[k] if ok else "und" for k, ok in zip(best, letter, strict=True)]
            score = np.where(np.array(letter, bool), score, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], lang_name, score_name])

    ready = docs.select(*docs.columns, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    ready = ready.toDF(*[f"c{i}" for i in range(len(names) + 1)])
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    out = map_texts(ready, run, f"{kinds}, {lang_name} string, {score_name} double")
    return out.toDF(*names, lang_name, score_name)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; a quarter of the ids is held out of the learning.

    Rows whose crc32 of the id as text leaves 2 when divided by 4 are held
    out; null ids aren't. Null texts and those
    without a letter are "und". Rows that repeat each come out; an empty table
    gives an empty one; columns but the three are not read.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held), lang_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return identify(rows, model).drop("text")
