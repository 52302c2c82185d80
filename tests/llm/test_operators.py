"""The corpus operators against brute force, and on awkward rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridlore.llm import chat, components, decontaminate, exact, language, mixing, neardup, quality, simhash, units, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    base = [words(rng, rng.randrange(1, 120)) for _ in range(60)]
    near = [re.sub(r"w1(\d)\b", r"w2\1", b, count=1) for b in base[:20]]
    rows = [(i, t) for i, t in enumerate([*base, *near, *base[:10], None, "", "  \t\n", "ONE", "one", "a" * 70_000 + " b" * 3000])]
    rows += [(None, base[0]), (3, base[3]), (3, base[3])]
    data = [(i, t, "en" if k % 2 else None, ["s1", "s1", None][k % 3], 1) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, DOCS).repartition(3).cache()


def local(df):
    return [tuple(r) for r in df.collect()]


def test_exact_groups(corpus):
    rows = local(corpus.select("doc_id", "text"))
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(plain(t), []).append(i)
    for primes in (exact.PRIMES, ((3, 2), (2, 1))):  # the second makes nearly all texts of a length collide
        got = local(exact.exact_groups(corpus, primes=primes, max_rows=2).select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))
        want = sorted((str(i), str(min((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(p.encode()).hexdigest()) for p, g in groups.items() for i in g)
        assert sorted((str(a), str(b), n, s) for a, b, n, _, s in got) == want
        assert sorted(s for *_, kept, s in got if kept) == sorted({s for *_, s in want})
    left = local(exact.exact_dedup(corpus).select("text"))
    assert sorted(plain(t) for (t,) in left) == sorted(groups)


def test_polynomials_compose():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 256, 3 * exact.CHUNK + 17, dtype=np.uint8).tobytes()
    for prime, base in exact.PRIMES:
        whole = 0
        for b in text[:2000]:
            whole = (whole * base + b + 1) % prime
        parts = [(exact.chunk_hash(text[a : a + 300], prime, base), len(text[a : a + 300])) for a in range(0, 2000, 300)]
        parts[-1] = (exact.chunk_hash(text[1800:2000], prime, base), 200)
        out = (0, 0)
        for p in parts:
            out = exact.combine(out, p, prime, base)
        assert out == (whole, 2000)


def brute_simhash(text, width=3):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + width]).encode(), 42) for i in range(max(1, len(ws) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def linked(fps, radius=2):
    root = {f: f for f in fps}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    fs = sorted(fps)
    for a in fs:
        for b in fs:
            if a < b and (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fs}


@pytest.mark.parametrize("limit", [1024, 1])
def test_simhash_groups(corpus, limit):
    rows = local(corpus.select("doc_id", "text"))
    fps = [(i, brute_simhash(t)) for i, t in rows]
    root = linked({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted((str(i), f"{f:016x}", str(least.get(root[f]))) for i, f in fps)
    got = local(simhash.simhash_groups(corpus, tree_limit=limit))
    assert sorted((str(a), b, str(c)) for a, b, c in got) == want


@pytest.mark.parametrize(("radius", "limit"), [(1, 1024), (2, 1024), (1, 2), (2, 2)])
def test_fingerprint_links(spark, radius, limit):
    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:15]:
        for _ in range(4):
            g = f
            for _ in range(rng.randrange(1, 4)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    edges = simhash.fingerprint_links(df, radius, limit)
    got = {r["node"] & (2**64 - 1): r["root"] for r in components.components(edges).collect()}
    root = linked(fps, radius)
    same = lambda m: {frozenset(x for x in fps if m(x) == v) for v in {m(x) for x in fps}}
    assert same(lambda f: got.get(f, ("alone", f))) == same(root.get)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201)], "a long, b long")
    got = dict(local(components.components(edges)))
    assert {got[i] for i in range(61)} == {0} and got[201] == 200 and 100 not in got


def test_language(spark):
    rng = random.Random(5)
    parts = {"xx": ["ba", "bo", "bi", "ka"], "yy": ["tru", "gle", "smo", "pla"]}
    rows = []
    for i in range(120):
        lang = ["xx", "yy"][i % 2]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), lang, "s", 1))
    rows += [(500, None, "xx", "s", 1), (501, "12 !! 3", "yy", "s", 1), (None, "babo", None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("c1", F.lit(7))
    got = {r["doc_id"]: r for r in language.languages(df).collect()}
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und" and got[500]["score"] == 0
    assert got[None]["lang_pred"] == "xx" and not got[None]["held_out"]
    assert all(got[i]["lang_pred"] == ["xx", "yy"][i % 2] and 0 <= got[i]["score"] <= 1 for i in range(120))
    assert local(language.languages(df.limit(0))) == []


def test_cross_parsing_is_greedy():
    text = np.array([1, 2, 1, 3, 1, 2, 2], np.uint8)
    table = language.automaton(text, 5)
    known = {tuple(text[i:j]) for i in range(7) for j in range(i + 1, 8)}
    rng = np.random.default_rng(2)
    for _ in range(50):
        query = rng.integers(1, 5, 30).astype(np.uint8)
        count, at = 0, 0
        while at < len(query):
            n = 1
            while at + n < len(query) and tuple(query[at : at + n + 1]) in known and tuple(query[at : at + n]) in known:
                n += 1
            count, at = count + 1, at + n
        assert int(language.phrases(query[:, None], np.array([30]), table)[0]) == count


def test_language_decisions(spark):
    """Of more labels than scripts, repeated rows and texts of many blocks: the winner is that of a plain greedy parse."""
    rng = random.Random(16)
    alphabets = {"l1": "abcde", "l2": "abcdf", "ru": "жзикл", "zh": "的一是不了", "rare": "mnopq"}
    make = lambda lang, n: " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    rows = [(i, make(lang, 40), lang) for i, lang in enumerate(k for k in alphabets for _ in range(2 if k == "rare" else 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, sample_chars=600)
    assert [p.language for p in model.parsers] == sorted(alphabets) and set(model.letters) == set("".join(alphabets.values()))
    joined = {}
    for r in df.select("lang", "text", F.xxhash64("doc_id").alias("at")).orderBy("at").collect():
        joined.setdefault(r["lang"], []).append(r["text"])
    joined = {k: bytes(language.symbols("\n".join(v)[:600], model.letters)) for k, v in joined.items()}
    queries = [(i, make(lang, rng.choice([1, 3, 30, 900])), lang) for i, lang in enumerate([*alphabets] * 8)]
    queries += [(3, queries[3][1], None), (None, "abc 的", None), (90, None, "l1"), (91, "7 !", None), (92, "", None)]

    def bits(text):
        out = {}
        for lang, known in joined.items():
            s, n = bytes(language.symbols(text, model.letters)), 0
            for block in (s[k : k + language.BLOCK] for k in range(0, len(s), language.BLOCK)):
                at = 0
                while at < len(block):
                    size = 1
                    while at + size < len(block) and block[at : at + size + 1] in known:
                        size += 1
                    n, at = n + 1, at + size
            out[lang] = n * np.log2(len(known) + 1) + sum(c not in known for c in s) * np.log2(max(map(len, joined.values())) + 1)
        return out

    got = language.identify(spark.createDataFrame(queries, "doc_id long, text string, lang string"), model).collect()
    assert len(got) == len(queries)
    for r in got:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        b = bits(r["text"])
        assert np.isclose(b[r["lang_pred"]], min(b.values())) and 0 <= r["score"] <= 1
    sure = [r for r in got if r["lang"] in ("ru", "zh", "rare") and r["text"]]
    assert all(r["lang_pred"] == r["lang"] for r in sure)
    few = language.fit(df, model_bytes=8 * 30 * 5 * 100)
    assert len(few.parsers) == 5 and max(len(p.table) for p in few.parsers) < 250
    assert language.identify(df.limit(0), model).count() == 0 and language.fit(df.limit(0)).parsers == []


def test_quality(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, 80) + (" JUNK!! SPAM!!" * 9 if i % 4 == 0 else "")) for i in range(400)] + [(900, None), (None, "")]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 300)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.resample(spark.createDataFrame(rows, "doc_id long, text string"), labels, seed=1).collect()}
    bad = [got[i]["selected"] for i in range(0, 400, 4)]
    good = [got[i]["selected"] for i in range(400) if i % 4]
    assert len(got) == 402 and sum(bad) / len(bad) < 0.2 < 0.9 < sum(good) / len(good)
    keys = sorted((r["sort_key"] for r in got.values()), reverse=True)
    share = 225 / 300
    assert {r["sort_key"] for r in got.values() if r["selected"]} == set(keys[: round(402 * share)])
    none = quality.resample(spark.createDataFrame(rows, "doc_id long, text string"), labels.limit(0))
    assert none.where("selected").count() == 402


def test_quality_is_a_likelihood_ratio(spark):
    """Weights and draws against a plain computation with dictionaries, on repeated rows, ties and awkward texts."""
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randrange(1, 90), 60)) for i in range(120)] + [(3, words(rng, 20, 60)), (7, None), (200, ""), (None, "w1 w2"), (None, None)]
    labelled = [(i, i % 3 and 1, int(i % 7 == 0)) for i in range(60)] + [(1, 0, 0), (2, None, 0), (None, 1, 0)]
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    worst = {}
    for i, q, t in labelled:
        if i is not None and q is not None:
            worst[i] = min(worst.get(i, True), q == 1 and not t)
    grams = lambda t: [w for w in (t or "").split()], lambda t: list(zip((t or "").split(), (t or "").split()[1:]))
    weight = [0.0] * len(rows)
    for gram, add in zip(grams, quality.SMOOTHING):
        raw, target = {}, {}
        for i, t in rows:
            for g in gram(t):
                raw[g] = raw.get(g, 0) + 1
                target[g] = target.get(g, 0) + bool(worst.get(i))
        scale = sum(target.values()) / sum(raw.values())
        weight = [w + sum(np.log((target[g] + add) / (raw[g] * scale + add)) for g in gram(t)) for w, (_, t) in zip(weight, rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit(1)).repartition(3)
    got = quality.resample(df, labels, seed=5, buckets=1 << 20).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), float(w)) for (i, _), w in zip(rows, weight))
    both = list(zip(sorted((str(r["doc_id"]), r["log_weight"]) for r in got), want))
    assert all(a == b and abs(x - y) < 0.1 for (a, x), (b, y) in both)  # a few pairs share a bucket
    assert sum(abs(x - y) < 1e-3 for (_, x), (_, y) in both) > 0.8 * len(rows)
    share = sum(worst.values()) / len(worst)
    keys = sorted((r["sort_key"] for r in got), reverse=True)
    least = keys[round(len(rows) * share) - 1]
    assert all(r["selected"] == (r["sort_key"] >= least) for r in got)
    noise = {}
    for r in got:
        noise.setdefault(r["doc_id"], set()).add(round(r["sort_key"] - r["log_weight"], 9))
    assert all(len(v) == 1 for v in noise.values())
    assert quality.resample(df.limit(0), labels).count() == 0


def test_quality_features_of_long_texts():
    rng = random.Random(10)
    text = words(rng, 300_000, 5000).encode()  # beyond a block of 1 MiB: pairs reach over the seam
    found = quality.features(text, 1 << 18)
    assert len(text) > 1 << 20 and len(found) == 2 * 300_000 - 1
    plain = text.split()
    pair = {}
    for p, b in zip(zip(plain, plain[1:]), [*found[found >= 1 << 18]]):
        assert pair.setdefault(p, b) == b


def test_decontaminate(spark):
    rng = random.Random(4)
    items = [(1, words(rng, 30)), (2, words(rng, 14)), (3, "w1 w2 w3 zz"), (4, None), (5, "!!"), (None, words(rng, 12)), (2, words(rng, 11)), (6, "la " * 40), (8, words(rng, 25))]
    items += [(7, items[0][1]), (9, " ".join(items[0][1].split()[5:20]) + " other words")]
    docs = [(i, words(rng, 60)) for i in range(30)]
    docs += [(40, words(rng, 9) + " " + items[0][1].upper() + ", " + words(rng, 5)), (41, items[1][1] + " x " + items[5][1]), (42, "W1-w2 W3 zz"), (43, None), (44, "")]
    docs += [(45, " ".join(items[0][1].split()[:10] + items[8][1].split()[3:13])), (46, "xxxxx " * 90_000 + items[8][1] + " yyyyy" * 90_000), (47, "la " * 70), (47, "la " * 70), (None, items[0][1]), (48, " ".join(items[0][1].split()[8:29]) + " . " + items[8][1])]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"spans": F.lit(1), "row_": F.lit(2)}).repartition(2)
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = tokens(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    want, most = [], {}
    for i, t in docs:
        w, hit, found, best = tokens(t), set(), set(), (0, None, None, None)
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if names := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= names
        for j, u in items:
            v, name = tokens(u), "" if j is None else str(j)
            before = [0] * (len(v) + 1)
            for x, word in enumerate(w):  # lengths of the common words that end here
                now = [0] + [before[y] + 1 if word == v[y] else 0 for y in range(len(v))]
                for y, n in enumerate(now):
                    if n >= min(10, len(v)) and v:
                        best = min(best, (-n, name, x + 1 - n, y - n))
                        most[name] = max(most.get(name, 0), n)
                before = now
        want.append((i, len(w), len(hit), len(found), decontaminate.sha256_of_items(list(found)), bool(hit), -best[0], *best[1:]))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_hit", "longest_item", "longest_at", "longest_item_at"]
    for size in (1 << 20, 100):  # one block of the benchmark, and many
        got = decontaminate.contamination(d, b, block_bytes=size).select(*columns)
        assert sorted(local(got), key=str) == sorted(want, key=str)
        longest = {r["item_id"]: r for r in decontaminate.longest_matches(d, b, block_bytes=size).collect()}
        assert {k: r["length"] for k, r in longest.items()} == most
        for k, r in longest.items():
            text = [tokens(t) for i, t in docs if i == r["doc_id"]]
            item = [tokens(t) for i, t in items if ("" if i is None else str(i)) == k]
            n = r["length"]
            assert any(x[r["doc_at"] : r["doc_at"] + n] == y[r["item_at"] : r["item_at"] + n] and len(y) >= r["item_at"] + n for x in text for y in item)
    by = {r[0]: r for r in want}
    assert by[45][2] == 20 and by[45][6] == 10  # two items side by side are no match of 20
    assert sorted((r["doc_id"] for r in decontaminate.decontaminate(d, b).collect()), key=str) == sorted((r[0] for r in want if not r[5]), key=str)
    assert decontaminate.contamination(d, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(d.limit(0), b).count() == 0 == decontaminate.longest_matches(d.limit(0), b).count()


def test_url_filter(spark):
    rules = spark.createDataFrame([("com/en/", "block"), ("example.com/en/7", "allow"), ("shop.net", "block"), ("a.org/x/*/z", "block")], "rule string, verdict string")
    urls = ["http://A.Example.com/en/71?x", "https://other.com/en/", "http://notexample.com/en/7", "http://example.com/EN/7", "ftp://shop.net", "http://my.shop.net/a#b", "http://workshop.net/", "http://a.org/x/y/z1", "http://a.org/x/z", None, "no scheme", "", "http://h?q://z/p"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[0]), (0, urls[0])], "page_id long, url string").withColumn("row", F.lit(1))
    got = local(urlfilter.url_filter(df, rules))
    by = {r[0]: r[1:] for r in got}
    assert len(got) == len(urls) + 2
    assert by[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and by[1][2:] == ("com/en/", "block") and by[2][2] == "com/en/" and by[3][2] is None
    assert by[4] == ("shop.net", "", "shop.net", "block") and by[5][2] == "shop.net" and by[6][2] is None and by[7][2] == "a.org/x/*/z" and by[8][2] is None
    assert by[9] == by[10] == by[11] == ("", "", None, "allow") and by[12][:2] == ("h", "")
    assert urlfilter.url_filter(df, rules.limit(0)).where("verdict = 'allow'").count() == len(urls) + 2


def test_warc(spark, tmp_path):
    long = "é" * 40_000
    rows = [(3, "http://a/1", "<p>x</p>"), (1, "http://b/\r\nX: y", "<p>x</p>"), (2, None, None), (5, "u", ""), (4, "u", long), (7, "w", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (7, "w", "WARC/1.1\r\nWARC-Type: response\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(local(warc.archive_pages(df, archive_bytes=300)), key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {3: 1, 5: 2}
    want = sorted(((i, len((h or "").encode()), sha(h), "revisit" if i in first else "response", first.get(i)) for i, _, h in rows), key=str)
    assert got == want
    assert warc.archive_pages(df.limit(0)).count() == 0


def warc_record(body):
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(body).digest()) + b"\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_warc_salvage():
    bodies = [f"body {i} ".encode() * (i + 1) for i in range(5)]
    parts = [warc_record(b) for b in bodies]
    broken = parts[0] + parts[1].replace(b"body 1", b"bodX 1", 1) + b"noise" + parts[2] + parts[3][:-30] + parts[4]
    found = list(warc.read_records(broken))
    assert [x.payload for x in found if x.kind == "record"] == [bodies[0], bodies[2], bodies[4]]
    gaps = [(x.start, x.stop) for x in found if x.kind == "gap"]
    assert gaps == [(len(parts[0]), len(parts[0]) + len(parts[1]) + 5), (len(parts[0]) + len(parts[1]) + 5 + len(parts[2]), len(broken) - len(parts[4]))]
    members = [gzip.compress(p) for p in parts]
    hurt = bytearray(members[1])
    hurt[20] ^= 0xFF
    data = members[0] + bytes(hurt) + members[2] + b"junk" + members[3] + members[4][:-12] + b"\0"
    found = list(warc.read_records(data))
    kept = [x.payload for x in found if x.kind == "record"]
    at = np.cumsum([0, *map(len, members)]).tolist()
    assert kept[:3] == [bodies[0], bodies[2], bodies[3]]
    assert [(x.start, x.stop) for x in found if x.kind == "gap"][:2] == [(at[1], at[2]), (at[3], at[3] + 4)]
    assert list(warc.read_records(b"")) == list(warc.read_records(b"\0\0")) == []
    mixed = members[0] + parts[1] + members[2] + b"\0\0\0"
    assert [x.payload for x in warc.read_records(mixed)] == bodies[:3]


def test_warc_salvage_of_one_great_member():
    rng = random.Random(20)
    bodies = [bytes(rng.randrange(97, 123) for _ in range(900)) for _ in range(200)]
    whole = gzip.compress(b"".join(map(warc_record, bodies)))
    following = gzip.compress(warc_record(b"after"))
    hurt = bytearray(whole)
    place = len(whole) * 9 // 10
    hurt[place : place + 6] = b"\xff\x00\xff\x00\xff\x01"
    found = list(warc.read_records(bytes(hurt) + following))
    kept = [x.payload for x in found if x.kind == "record"]
    assert kept[-1] == b"after" and kept[:175] == bodies[:175]
    gap = [x for x in found if x.kind == "gap"][-1]
    assert 0.8 * place < gap.start <= place + 6 and gap.stop == len(whole)
    wrong = bytearray(whole)
    wrong[-6] ^= 1  # only the check sum
    assert [x.payload for x in warc.read_records(bytes(wrong)) if x.kind == "record"] == bodies
    plain = warc_record(gzip.compress(b"x" * 50)) * 2  # zipped bodies in a plain archive
    assert len([x for x in warc.read_records(plain) if x.kind == "record"]) == 2


def test_warc_damaged_archives(spark, tmp_path):
    """Archives written by Spark and then damaged lose the records that are hit, and no others."""
    rng = random.Random(21)
    rows = [(i, f"http://x/{i}", words(rng, 60, 5000)) for i in range(400)]
    path = tmp_path / "warc"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{path}", archive_bytes=40_000)
    files = sorted(f for f in path.iterdir() if f.name.startswith("part-"))
    assert len(files) > 2 and all(gzip.decompress(f.read_bytes()).count(b"WARC/1.1") > 1 for f in files)
    lost = 0
    for f in files:
        data, heads = bytearray(f.read_bytes()), []
        for x in warc.read_records(bytes(data)):
            assert x.kind == "record"
            heads.append((x.start, x.stop))
        hit = rng.sample(range(len(heads)), 2)
        for k in hit:
            start, stop = heads[k]
            data[start + 40 : start + 46] = bytes(6)
        lost += len(hit)
        f.write_bytes(bytes(data))
        (path / f".{f.name}.crc").unlink()
        want = sorted(heads[k] for k in hit)
        gaps = [(x.start, x.stop) for x in warc.read_records(bytes(data)) if x.kind == "gap"]
        assert sum(b - a for a, b in gaps) == sum(b - a for a, b in want)
    records = warc.read_warc(spark, f"file://{path}")
    assert warc.resolve(records).count() == 400 - lost and records.where("kind = 'gap'").count() > 0


def test_mixing(spark):
    rows = [(i, "x" * (10 + i % 7), "en", "big" if i % 10 else "small", 1) for i in range(3000)] + [(None, None, None, None, None), (5000, "y", "en", None, 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("copies", F.lit(0))
    out = mixing.poisson_mix(df, {"big": 1.0, "small": 1.0}, epochs=3.0).cache()
    mass = dict(local(out.groupBy("source").agg(F.sum(F.length("text")))))
    total = sum(len(r[1] or "") for r in rows)
    assert set(mass) == {"big", "small"} and all(abs(v - 1.5 * total) < 0.12 * total for v in mass.values())
    assert out.columns == [*df.columns, "copies_", "copy_no", "order_key"]
    per = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copies_").alias("c"), F.max("copy_no").alias("k")).where("n <> c OR n <> k").count()
    assert per == 0
    one = mixing.poisson_mix(spark.createDataFrame([(1, "abc", "en", "s", 1), (2, "d" * 99_997, "en", "t", 1)], DOCS), {"s": 1.0, "t": 0.0})
    assert 30_000 < one.count() < 37_000  # a rate far beyond one draw's
    assert mixing.poisson_mix(df.limit(0)).count() == 0


def test_chats(spark):
    turn = lambda c, n, r, t: (c, n, r, t)
    a = [turn(1, 0, "user", "hi"), turn(1, 1, "assistant", "yo")]
    rows = [*a, *[(2, *x[1:]) for x in a], turn(2, 2, "user", "more"), turn(3, 0, "user", "hi"), turn(4, 0, "user", "other <|im_end|>"), turn(5, 0, "user", "other <|im_end|>"), turn(6, 5, None, None), turn(6, 5, None, None), turn(7, None, "user", "q"), turn(7, 3000, "user", "z"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit(1))
    got = {(r["conv_id"], r["part"]): (r["n_turns"], r["chat"]) for r in chat.format_chats(df).collect()}
    assert set(got) == {(2, 0), (4, 0), (6, 0), (7, 0), (7, 1), (None, 0)}
    assert got[2, 0] == (3, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n")
    assert "other < |im_end| >" in got[4, 0][1] and got[6, 0] == (1, "<|im_start|>unknown\n<|im_end|>\n")
    assert chat.format_chats(df.limit(0)).count() == 0


def naive_units(text):
    """Words with their places, line by line, cut where a word's hash is the least of four on both sides."""
    out = []
    for line in re.finditer(r"[^\n]+", text):
        found = list(re.finditer(r"\S+", line.group()))
        h = [int(units.span_hashes(np.array([ord(c) for c in w.group().lower()], np.uint32), np.array([0]), np.array([len(w.group())]))[0]) for w in found]
        cuts = [i for i in range(len(h)) if i == 0 or (all(h[i] < x for x in h[max(0, i - 4) : i]) and all(h[i] <= x for x in h[i + 1 : i + 5]))]
        for i, j in zip(cuts, [*cuts[1:], len(h)]):
            out.append((line.start() + found[i].start(), line.start() + found[j - 1].end(), tuple(w.group().lower() for w in found[i:j])))
    return out


def naive_dedup(rows, least):
    """{(id, text): text without repeated passages} by dictionaries."""
    seen, out = set(), {}
    for i, text in sorted({r for r in rows if r[1]}, key=lambda r: (r[0] is not None, r[0] or 0, units.text_key(r[1]))):
        spans, run = [], []
        for start, stop, unit in [*naive_units(text), (0, 0, None)]:
            if unit in seen:
                run.append((start, stop, len(unit)))
                continue
            if sum(n for *_, n in run) >= least:
                spans.append((run[0][0], run[-1][1]))
            run = []
            seen |= {unit} - {None}
        at = [0, *[b for _, b in spans]], [*[a for a, _ in spans], len(text)]
        out[i, text] = "".join(text[a:b] for a, b in zip(*at))
    return out


def test_units(spark):
    rng = random.Random(13)
    passages = [words(rng, rng.randrange(51, 90), 3000) for _ in range(12)]
    boiler = "All rights are reserved here."
    rows = []
    for i in range(150):
        lines = [words(rng, rng.randrange(1, 60), 3000) for _ in range(rng.randrange(1, 6))]
        if i % 3 == 0:  # a passage in the middle of a line, as a line, and as several lines
            p = passages[i // 3 % 12]
            lines.insert(rng.randrange(len(lines) + 1), [words(rng, 15, 3000) + " " + p + " " + words(rng, 9, 3000), p.upper(), p.replace(" ", "\n")][i % 9 // 3])
        if i % 4 == 0:
            lines.append(boiler)
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, " \n\n "), (None, rows[0][1]), (5, rows[5][1]), (300, rows[7][1] + "\n" + passages[0] + "\n" + passages[0]), (301, "a " * 40_000), (302, "b " + "a " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit(0)).repartition(3)
    want = naive_dedup(rows, 20)
    got = units.dedup_units(df, min_words=20).collect()
    assert len(got) == len(rows)
    before = {}
    for i, t in rows:
        before.setdefault(i, []).append(t)
    for r in got:
        source = next(t for t in before[r["doc_id"]] if (want[r["doc_id"], t] if t else t) == r["text"])
        assert r["n_removed"] == len(r["removed_"]) and (r["n_removed"] > 0) == (source != r["text"])
        assert not source or r["text"] == "".join(source[a:b] for a, b in zip([0, *[x["stop"] for x in r["removed_"]]], [*[x["start"] for x in r["removed_"]], len(source)]))
    by = {r["doc_id"]: r for r in got}
    clean = [i for i in range(1, 150) if i % 3 and i != 5 and i != 7]
    assert all(by[i]["n_removed"] == 0 for i in clean)
    planted = [i for i in range(39, 150, 3)]  # all but the first of each passage
    assert all(by[i]["n_removed"] > 0 for i in planted)
    assert all(not any(p.lower() in (by[i]["text"] or "").lower() for p in passages) for i in planted)
    assert by[200]["text"] is None and by[201]["text"] == "" and by[None]["n_removed"] == 0
    assert units.dedup_units(df.limit(0)).count() == 0


def test_units_of_long_lines(monkeypatch):
    rng = random.Random(14)
    text = words(rng, 5000, 900) + "\n" + words(rng, 3000, 900)
    whole = units.units(text)
    monkeypatch.setattr(units, "BLOCK", 4000)
    parts = units.units(text)
    assert int(whole[2].sum()) == int(parts[2].sum()) == 8000 and (parts[1] > parts[0]).all()
    same = set(zip(whole[3].tolist(), whole[4].tolist())) & set(zip(parts[3].tolist(), parts[4].tolist()))
    assert len(same) > 0.95 * len(whole[0])
    assert [len(x) for x in units.units("x" * 9000)] == [3] * 5  # a word without an end is cut at blocks


def test_near_duplicates(spark):
    rng = random.Random(11)
    base = [words(rng, rng.randrange(40, 300), 3000) for _ in range(60)]
    rows = list(enumerate(base))
    for k, b in enumerate(base[:40]):
        w = b.split()
        for _ in range(1 + k % 12):
            w[rng.randrange(len(w))] = "changed"
        rows.append((100 + k, " ".join(w)))
    rows += [(300, None), (301, ""), (302, base[50]), (302, base[50])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tk", F.lit(1)).repartition(3)

    def sh(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [sh(t) for _, t in rows]
    root = list(range(len(rows)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), set()).add(d)
    assert sorted(r["doc_id"] for r in neardup.near_dedup(df).collect()) == sorted(min(g) for g in groups.values())
    assert neardup.near_dedup(df.limit(0)).count() == 0


def test_near_duplicates_of_a_hot_band(spark):
    """Pairs of similarity 0.85 among texts that have 0.75 with all others, which share their bands."""
    rng = random.Random(12)
    common, rows = [f"c{i}" for i in range(300)], []
    for k in range(60):
        own = [f"p{k}x{i}" for i in range(22)]
        rows += [" ".join(common + own + [f"q{k}{m}x{i}" for i in range(28)]) for m in "ab"[: 1 + (k % 3 > 0)]]
    rng.shuffle(rows)

    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in rows)]
    like = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(like) == 40 == len({i for i, _ in like})
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["keep_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == like


@pytest.mark.parametrize(("n", "changed"), [(20, 14), (100, 12), (200, 10)])
def test_near_duplicates_of_a_family(spark, n, changed):
    """Families of copies of one text, whose pairs lie on both sides of the threshold, at 4 and at 64 partitions."""
    rng = random.Random(n)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for k in range(n):
        w = list(base)
        for at in rng.sample(range(300), rng.randrange(2, changed)):
            w[at] = f"x{k}y{at}" if rng.random() < 0.5 else f"z{at % 5}"
        texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(n))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    like = [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert 0.02 * n * n < 2 * len(like) < 0.95 * n * n
    for i, j in like:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (4, 64) if n == 200 else (4,):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = {(r["doc_id"], r["keep_id"]) for r in neardup.near_duplicates(df.repartition(parts)).collect()}
            assert got == {(i, find(i)) for i in range(n) if find(i) != i}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("chunk", [1 << 19, 40])
def test_components_of_hubs(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = random.Random(15)
    edges = [(0, i) for i in range(1, 2000)] + [(5000 + i, 7000) for i in range(1500)] + [(7000, 1999)] + [(8000 + i, 8001 + i) for i in range(300)] + [(9999, i) for i in range(9000, 9500)] + [(rng.randrange(10_000, 10_400), rng.randrange(10_000, 10_400)) for _ in range(250)]
    got = dict(local(components.components(spark.createDataFrame(edges, "a long, b long").repartition(5))))
    root = {}
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}


def test_functions_travel_by_value(tmp_path):
    """What runs in tasks must load where this repository is not installed."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    own = [exact.fingerprint, exact._unlike, simhash.fingerprint, simhash._grow(8, 2), neardup.shingles, language.parse, quality.features, decontaminate.search, units.units, warc.read_records]
    (tmp_path / "own").write_bytes(cloudpickle.dumps(own))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", "import pickle; f = pickle.load(open('own', 'rb')); print(f[0](b'abc'))"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.stdout.strip() == str(exact.fingerprint(b"abc")), done.stderr[-500:]


def test_units_are_shuffled_once(spark, monkeypatch):
    """Counting units and marking their later occurrences read one shuffle."""
    from gridlore.llm import units as U

    seen, plain = {}, U.settle
    monkeypatch.setattr(U, "settle", lambda df, tag: plain(seen.setdefault(tag, df), tag))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = " ".join(f"w{i}" for i in range(60))
        out = U.repeated_spans(spark.createDataFrame([(i, f"t{i}\n{words}") for i in range(4)], "doc_id long, text string"))
        assert out.count() == 3
        seen["spans"].collect()
        assert "ReusedExchange" in seen["spans"]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
