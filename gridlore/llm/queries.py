"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
import public_tokenizers
from gridlore.llm import bpe, chat, decontaminate, exact, language, mixing, quality, repair, simhash, units, urlfilter, warc, whitening

from gridlore.llm.repair_sql import REPAIR_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of operator 3, and what they say.
URL_RULES = [
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
]


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(_table(spark, sf_dir, "documents"), alpha=0.5, epochs=1.0, seed=42)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_filter(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "rule string, verdict string"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_table(spark, sf_dir, "documents"))


def op5_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"), width=3, radius=2)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_hit", "longest_item", "longest_at")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op10_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.dedup_units(_table(spark, sf_dir, "documents")).drop("lang", "source", "n_chars")


def op11_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 32)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(_table(spark, sf_dir, "conversations"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), ["doc_id"], "text", ranks), ranks), ["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_poisson_mix": op1_poisson_mix,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_language_id": op4_language_id,
    "op5_quality_resample": op5_quality_resample,
    "op6_warc_roundtrip": op6_warc_roundtrip,
    "op7_simhash_neardup": op7_simhash_neardup,
    "op8_decontaminate": op8_decontaminate,
    "op9_chat_format": op9_chat_format,
    "op10_unit_dedup": op10_unit_dedup,
    "op11_qdwh_whitening": op11_qdwh_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE: dict[str, str] = {
    "op12_conversation_repair": REPAIR_SQL,
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)""",
    "op8_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, row_number() OVER () AS s, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT item_id, s, j, least(len(w), 10) AS n, array_to_string(w[j:j + 9], ' ') AS win
               FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS r(j) WHERE len(w) > 0),
        dw AS (SELECT doc_id, i, s.n, array_to_string(w[i:i + s.n - 1], ' ') AS win
               FROM d, (SELECT DISTINCT n FROM bw) AS s, unnest(range(1, len(w) - s.n + 2)) AS r(i)),
        m AS (SELECT dw.doc_id, dw.i, dw.n, CAST(bw.item_id AS VARCHAR) AS item_id, bw.s, bw.j FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
        o AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, s, i - j ORDER BY i) AS g FROM m),
        q AS (SELECT doc_id, item_id, min(i) - 1 AS place, count(*) + any_value(n) - 1 AS longest FROM o GROUP BY doc_id, item_id, s, i - j, g),
        l AS (SELECT doc_id, item_id AS longest_item, place, longest FROM q QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY longest DESC, item_id, place) = 1),
        x AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS INTEGER) AS longest_hit,
               longest_item, CAST(place AS INTEGER) AS longest_at
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN l USING (doc_id)""",
    "op1_poisson_mix": r"""
        WITH m AS (SELECT source, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS mass FROM documents GROUP BY source),
        t AS (SELECT sum(mass) AS total, sum(CASE WHEN mass > 0 THEN pow(mass, 0.5) ELSE 0 END) AS weights FROM m),
        r AS (SELECT source, pow(mass, 0.5) / weights * total / mass AS rate FROM m, t WHERE mass > 0),
        p AS (SELECT source, greatest(1, CAST(ceil(rate / 16) AS INTEGER)) AS parts, rate / greatest(1, ceil(rate / 16)) AS rate FROM r),
        k AS (SELECT source, parts, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS term FROM p, range(0, 90) AS g(k)),
        c AS (SELECT source, parts, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k
              QUALIFY k <= ceil(max(rate) OVER (PARTITION BY source) + 12 * sqrt(max(rate) OVER (PARTITION BY source)) + 24)),
        l AS (SELECT source, parts, list(cdf) AS cdf FROM c GROUP BY source, parts),
        u AS (SELECT d.doc_id, l.cdf, CAST('0x' || substr(md5('42|' || d.doc_id || '|' || i), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
              FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source, unnest(range(1, l.parts + 1)) AS q(i)),
        n AS (SELECT doc_id, CAST(sum(len(list_filter(cdf, lambda x: x <= u))) AS INTEGER) AS copies FROM u GROUP BY doc_id)
        SELECT d.*, copies, CAST(copy_no AS INTEGER) AS copy_no,
               CAST('0x' || substr(md5('42#' || d.doc_id || '#' || copy_no), 1, 15) AS BIGINT) AS order_key
        FROM documents d JOIN n USING (doc_id), unnest(range(1, copies + 1)) AS q(copy_no)""",
    "op3_url_filter": r"""
        WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r(rh, rp, rule, verdict) AS (VALUES ('com', '/en/', 'com/en/', 'block'), ('example.com', '/en/7', 'example.com/en/7', 'allow'), ('net', '/de/', 'net/de/', 'allow'),
                          ('example.net', '/de/8', 'example.net/de/8', 'block'), ('org', '/es/', 'org/es/', 'block')),
        m AS (SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS k
              FROM u LEFT JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND prefix(path, rp))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1""",
    "op6_warc_roundtrip": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h,
                          min(page_id) OVER (PARTITION BY coalesce(html, '')) AS lead FROM pages)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead THEN lead END AS refers_to
        FROM p""",
    "op9_chat_format": r"""
        WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
        c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn, role, text) AS l FROM t GROUP BY conv_id),
        k AS (SELECT c.conv_id, len(c.l) AS n_turns FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.l[1] = c.l[1]
              AND ((len(d.l) > len(c.l) AND d.l[1:len(c.l)] = c.l) OR (d.l = c.l AND d.conv_id < c.conv_id)))),
        p AS (SELECT conv_id, n_turns, turn // 1024 AS block, string_agg('<|im_start|>' || CASE WHEN role = '' THEN 'unknown' ELSE role END || chr(10)
                  || replace(replace(text, '<|', '< |'), '|>', '| >') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS chat
              FROM t JOIN k USING (conv_id) GROUP BY conv_id, n_turns, block)
        SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY block) - 1 AS INTEGER) AS part, n_turns, chat FROM p""",
}
