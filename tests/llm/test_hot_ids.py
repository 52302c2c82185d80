"""Null and repeated ids in number, clashing names, and one long repetitive text."""

from __future__ import annotations

import math
import random

import pytest

import corpus_pipeline
from gridlore.llm import exact, language, quality

WORDS = {"en": ["the", "house", "with", "water", "and", "thought"], "de": ["der", "schöne", "Straße", "über", "nicht", "zwölf"], "fr": ["être", "garçon", "l'eau", "où", "forêt", "les"]}


def _texts(n, seed=1):
    r = random.Random(seed)
    return [(lang, " ".join(r.choice(words) for _ in range(30)) + ".") for lang, words in WORDS.items() for _ in range(n)]


@pytest.mark.parametrize("ids", ["null", "one"])
def test_labels_are_learned_whatever_the_ids(spark, ids):
    rows = [({"null": None, "one": 7}[ids], t, lang, "web", len(t)) for i, (lang, t) in enumerate(_texts(120))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [p.language for p in language.fit(df).parsers] == ["de", "en", "fr"]
    want = sorted((t, lang) for lang, t in _texts(120))
    told = language.identify(df, language.fit(df)).select("text", "lang_pred").collect()
    assert sum(tuple(r) in set(want) for r in told) >= 0.98 * len(want)
    assert corpus_pipeline.language_stage(spark, df, "").count() == len(rows)


def test_language_sample_is_bounded(spark):
    df = spark.createDataFrame([(1, t, lang) for lang, t in _texts(40)] + [(1, "Hola señor", "es")] * 300, "doc_id long, text string, lang string")
    few = language.fit(df, sample_docs=3)
    assert [p.language for p in few.parsers] == ["de", "en", "es", "fr"]


def test_one_word_ten_megabytes(spark):
    rows = [(i, f"good words number {i} here" if i % 2 else f"bad junk {i}") for i in range(200)]
    rows += [(900, "spam " * 2_000_000), (901, "good words number 3 here " * 60_000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = quality.resample(spark.createDataFrame(rows, "doc_id long, text string"), labels, seed=2).collect()
    assert len(got) == 202 and all(math.isfinite(r["sort_key"]) for r in got)
    keep = round(202 * 0.5)
    least = sorted((r["sort_key"] for r in got), reverse=True)[keep - 1]
    assert all(r["selected"] == (r["sort_key"] >= least) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[901]["selected"] and not by_id[900]["selected"]


@pytest.mark.parametrize("share", [0.0, 0.37])
def test_threshold_is_exact(spark, share):
    rows = [(i, "x " * (i % 17) + "word " * (i % 5)) for i in range(700)]
    labels = spark.createDataFrame([(i, i % 3 and 1, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    got = quality.resample(spark.createDataFrame(rows, "doc_id long, text string"), labels, share=share).collect()
    keep = round(700 * share)
    order = sorted((r["sort_key"] for r in got), reverse=True)
    assert [r["selected"] for r in got] == [keep > 0 and r["sort_key"] >= order[keep - 1] for r in got]


def test_exact_groups_of_one_id(spark):
    rows = [(None, f"text {i // 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact.exact_groups(df).collect()
    assert len(got) == 3000 and {r["group_size"] for r in got} == {2} and sum(r["kept"] for r in got) == 1500
    assert exact.exact_dedup(df).select("text").distinct().count() == 1500 == exact.exact_dedup(df).count()


def test_clashing_names_through_every_stage(spark, tmp_path):
    rows = [(i, t, lang, "web", len(t), "x", 1, "y", 2.0, "z", 3, 4) for i, (lang, t) in enumerate([*_texts(12), *_texts(12)[:18]])]
    extra = "gone_id string, gone_tk int, gone_sha string, tk double, ident string, uid int, sha int"
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    spark.createDataFrame([(1, "nothing that these texts hold at all, not even ten words of it")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs, sizes = df, []
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path}/{name}"
        stage(spark, docs, f"file://{tmp_path}").write.parquet(path)
        docs = spark.read.parquet(path)
        assert set(df.columns) <= set(docs.columns), name
        sizes.append(docs.count())
    assert sizes[0] == 54 and sizes[1] == 36 and sizes[2] <= 36 and sizes[3] == sizes[2]
