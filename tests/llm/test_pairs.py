"""SimHash, vectors, exact top-k and archives: brute force and edge cases."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from oracle import compare
from tripleloom.functions.session import shared_dir
from tripleloom.llm import queries, simhash, topk, vector_dedup, warc
from tripleloom.llm.common import components


def closure(n, pairs):
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(300, 360)] + [(400, 400 + i) for i in range(80)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = closure(500, pairs)
    assert all(got.get(i, i) == want[i] for i in range(500))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash --------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts(words):
    rnd = random.Random(6)
    out = [None, "", " \t\n", "one", "One two", "ÀB c d e", "a b c a b c a b c"]
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randint(50, 300))]
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, 12)):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            out.append(" ".join(copy).upper() if rnd.random() < 0.2 else " ".join(copy))
    return out


@pytest.mark.parametrize("bucket", [256, 3])
def test_simhash_equals_brute_force(spark, words, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    texts = near_texts(words)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.query(df).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = closure(len(texts), pairs)
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == sorted(set(want))


def test_masks_cover_every_pair_within_the_radius():
    rnd = random.Random(1)
    for level in range(simhash.LEVELS):
        tables = simhash.masks(level)
        for _ in range(3000):
            flips = sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3)))
            assert any(not (m & flips) for m in tables)


def test_simhash_links_of_random_prints(spark):
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = base + [b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(1, 5))) for b in base for _ in range(20)]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    pairs = [(i, j) for i in range(len(signed)) for j in range(i) if ((signed[i] ^ signed[j]) & (2**64 - 1)).bit_count() <= 3]
    low = closure(len(signed), pairs)
    got = {r["node"]: r["component"] for r in components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()}
    assert all(got.get(p, p) == signed[low[i]] for i, p in enumerate(signed))


def test_simhash_edges(spark):
    df = spark.createDataFrame([(None, "x y z", 1, "q"), (7, "x y z", 2, None), (7, "x y z", 2, None), (9, None, 3, "r")], "doc_id long, text string, fp int, component string")
    out = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in simhash.query(df).collect())
    assert out == [(False, 7, 7), (False, 7, 7), (False, 9, 9), (True, 0, 7)]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [7, 9]
    assert simhash.query(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_one_row_of_each_group_stays_whatever_its_ids(spark):
    one, two, three, four = ("a b c d e", "f g h i j", "k l m n o", "p q r s t")
    rows = [(5, one), (5, two), (3, one.upper()), (None, three), (None, three), (None, four), (None, two), (8, four), (9, None), (None, ""), (None, "x y z"), (5, "u v w"), (5, "u v w")]
    prints = [plain_fingerprint(t) for _, t in rows]
    groups = closure(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    want = [min((rows[i][0] is None, rows[i][0] or 0, (rows[i][1] or "").lower()) for i in range(len(rows)) if groups[i] == g) for g in set(groups)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "").lower()) for r in kept) == sorted(want) and len(want) == 7


# vectors --------------------------------------------------------------------------------------------

def test_pruned_products_lose_nothing():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(200, 24)) * np.linspace(3, 0.1, 24)
    x = vector_dedup.unit(np.vstack([x, x[:50] + rnd.normal(size=(50, 24)) * 0.02]))
    for t in (0.5, 0.9, 0.98):
        i, j = vector_dedup.linked(x, x, t)
        assert set(zip(*np.nonzero(x @ x.T >= t))) <= set(zip(i, j)) and ((x @ x.T)[i, j] >= t - 1e-8).all()


@pytest.mark.parametrize("tile", [1024, 7])
def test_vectors_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vector_dedup, "TILE", tile)
    rnd = np.random.default_rng(5)
    rows = []
    for c in range(12):
        base = rnd.normal(size=10)
        for k in range(12):
            v = base + rnd.normal(size=10) * rnd.choice([0.0, 0.05, 0.12, 0.4])
            rows.append((len(rows), [float(np.float32(x)) * (1e-30 if c == 3 else 1e30 if c == 4 else 1.0) for x in v], int(c % 3) if c != 7 else None))
    rows += [(1000, None, 1), (1001, [0.0] * 10, 1), (1002, [math.nan] * 10, 1), (1003, [None] + [1.0] * 9, 1), (1004, [math.inf] * 10, 1), (1005, [1.0], 1), (1006, [2.0], 1), (1007, [], 1), (None, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit("clash"))
    good = lambda r: r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    def cos(a, b):
        a, b = (np.array(v) / np.abs(v).max() for v in (a, b))
        return a @ b / math.sqrt((a @ a) * (b @ b))
    pairs = [(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows[:i]) if good(a) and good(b) and a[2] == b[2] and len(a[1]) == len(b[1]) and cos(a[1], b[1]) >= 0.98]
    low, n = closure(len(rows), pairs), [0] * len(rows)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(df).collect()}
    want = {r[0]: (n[i], rows[low[i]][0], r[0] is not None and low[i] == i) for i, r in enumerate(rows)}
    assert got == want and len(pairs) > 200
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


# top k ----------------------------------------------------------------------------------------------

def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "DEPTHS", (2, 8, 30, 100, 1 << 40))
    rnd = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.round(rnd.normal(size=6), 1 if i % 3 else 5)]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 500)] + [(600, None), (650, [1.0, None] + [0.0] * 4), (700, [math.inf] * 6), (750, [1.0]), (800, [2.0]), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, a in good:
        if q % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q and len(a) == len(b))
            want |= {(q, rank, c, -v) for rank, (v, c) in enumerate(s[:5], 1)}
    assert {tuple(r) for r in topk.query(df).collect()} == want
    assert topk.query(df.limit(0)).count() == 0


def test_topk_of_large_numbers(spark):
    rows = [(i, [1e5 * (i + 1), 3e4 - i]) for i in range(60)]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    ints = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    s = sorted((-sum(x * y for x, y in zip(ints[50], ints[c])), c) for c in ints if c != 50)
    assert got[50, 1] == (s[0][1], -s[0][0]) and got[50, 5] == (s[4][1], -s[4][0])


@pytest.mark.parametrize("equal", [0, 3000])
def test_topk_reads_large_blocks_to_their_end(equal):
    rnd = np.random.default_rng(4)
    x = rnd.integers(-300, 300, size=(topk.DEPTHS[-1] + 900, 4))
    x[:equal] = x[0]
    x[-1] = 0           # as a query, equal scores everywhere
    ids = rnd.permutation(len(x))
    block = pd.DataFrame({"vec_id": ids, "v": list(x)})
    asked = [0, len(x) - 2, len(x) - 1]
    got = topk.best_pairs(block, block.iloc[asked], 5)
    for at in asked:
        best = sorted((-int(x[at] @ x[c]), int(ids[c])) for c in range(len(x)) if c != at)[:5]
        mine = got[got["query_id"] == ids[at]]
        assert list(zip(-mine["score"], mine["vec_id"])) == best


# archives -------------------------------------------------------------------------------------------

def test_arc_round_trip():
    bodies = [b"", b"plain", b"\n\nfiledesc://x 1 2 3 4\n", "é\r\n\r\nWARC/1.1\r\n".encode(), b"HTTP/1.0 200 OK\r\nA: b\r\n\r\npayload"]
    for version in (1, 2):
        arc = warc.write_arc([{"url": f"http://a/{i} b", "ip": "1.2.3.4", "date": "20010203040506", "type": "text/html", "body": b} for i, b in enumerate(bodies)], version)
        back = list(warc.read_arc(arc))
        assert back[0]["url"].startswith("filedesc://") and [r["body"] for r in back[1:]] == bodies and back[1]["url"] == "http://a/0%20b"
        records = [warc.to_warc(r) for r in back]
        read = list(warc.read_warc(b"".join(r + b"\r\n\r\n" for r in records)))
        assert [r["block"] for r in read][1:] == bodies and read[0]["warc-type"] == "warcinfo" and len({r["warc-record-id"] for r in read}) == 6
        assert read[1]["warc-date"] == "2001-02-03T04:05:06Z" and read[5]["warc-payload-digest"] == "sha1:" + warc.digest(b"payload")
        assert read[5]["content-type"] == "application/http; msgtype=response" and read[1]["warc-ip-address"] == "1.2.3.4"


def test_old_urls_and_bad_archives():
    head = b"filedesc://x 0.0.0.0 19970101 text/plain 6\n1 0 xx\n\n"
    row = b"http://a/with blank 1.1.1.1 1997 text/html 3\nabc\n"
    got = list(warc.read_arc(head + row))
    assert got[1]["url"] == "http://a/with blank" and got[1]["body"] == b"abc" and warc.stamp(got[1]["date"]) == "1997-01-01T00:00:00Z"
    for bad in (b"no archive\n", head.replace(b"1 0 xx", b"9 0 xx"), head + b"http://a 1.1.1.1 1997 text/html 30\nabc\n", head + b"http://a text/html x\n"):
        with pytest.raises(warc.BadArchive):
            list(warc.read_arc(bad))


def test_pages_with_edges(spark):
    rows = [(1, "http://a", "x"), (5, None, "x"), (3, "u u", "x"), (7, "v", None), (8, "v", ""), (9, "w", "WARC/1.1\r\n\r\n"), (9, "w", "WARC/1.1\r\n\r\n"), (None, "n", "x"), (11, "é", "ü" * 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.query(df).collect()}
    def of(i, kind, to, text):
        return (i, kind, to, len(text.encode()), warc.digest(text.encode()))
    assert got == {of(1, "revisit", 5, "x"), of(5, "response", None, "x"), of(3, "revisit", 5, "x"), of(None, "revisit", 5, "x"), of(7, "revisit", 8, ""), of(8, "response", None, ""),
                   of(9, "response", None, "WARC/1.1\r\n\r\n"), of(11, "response", None, "üüü")}
    assert warc.query(df).count() == 9 and warc.query(df.limit(0)).count() == 0
    path = shared_dir(spark)
    warc.convert(df, path, version=2, least=2)
    assert warc.read_back(spark, path).where("record_type = 'revisit'").count() == 0


def test_payload_that_looks_like_a_response(spark):
    html = ["HTTP/1.1 200 OK\r\n\r\nbody", "HTTP/1.0 404", "\r\n\r\n", "HTTP/1.1 200 OK\r\n\r\nbody"]
    df = spark.createDataFrame([(i, f"dns:{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.query(df).collect()}
    assert got == {i: (len(h), warc.digest(h.encode()), "revisit" if i == 0 else "response", 3 if i == 0 else None) for i, h in enumerate(html)}


def test_revisits_name_records_of_the_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, None if i == 9 else f"http://h/{i} x", f"body {i % 3}") for i in range(30)] + [(9, "http://again", "body 0")], "page_id long, url string, html string").repartition(4)
    path = str(tmp_path / "w")
    warc.convert(pages, path)
    rows = warc.records_of(spark, path).collect()
    ids = {r["record_id"]: r["page_id"] for r in rows if r["record_type"] == "response"}
    assert len(ids) == 3 and all(ids[r["refers"]] == 27 + r["page_id"] % 3 for r in rows if r["record_type"] == "revisit") and len(rows) == 31
    for f in (tmp_path / "w").glob("part-*.gz"):
        import gzip
        kinds = [r["warc-type"] for r in warc.read_warc(gzip.decompress(f.read_bytes()))]
        assert kinds[0] == "warcinfo" and kinds.count("warcinfo") == 1
    copies = spark.createDataFrame([(i, "u", "same") for i in range(2000)], "page_id long, url string, html string")
    got = warc.query(copies)
    assert got.where("record_type = 'revisit' and refers_to = 1999").count() == 1999 and got.where("record_type = 'response'").count() == 1


def test_every_file_begins_with_its_description(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    pages = spark.range(40).selectExpr("id AS page_id", "'u' AS url", "concat('text ', id) AS html").coalesce(1)
    path = str(tmp_path / "w")
    warc.convert(pages, path)
    import gzip
    files = [[r["warc-type"] for r in warc.read_warc(gzip.decompress(f.read_bytes()))] for f in (tmp_path / "w").glob("part-*.gz")]
    assert len(files) > 5 and all(k[0] == "warcinfo" and k.count("warcinfo") == 1 for k in files) and sum(map(len, files)) == 40 + len(files)


def test_name_look_ups_are_resources():
    arc = warc.write_arc([{"url": "dns:a.org", "type": "text/dns", "body": b"a.org. 300 IN A 1.2.3.4"}])
    assert b"WARC-Type: resource" in warc.to_warc(list(warc.read_arc(arc))[1])


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, duck, name):
    state, n, _, note = compare(spark, duck, name, queries.QUERIES[name], queries.SQL[name], "/root/testdata/sf0.001")
    assert state == "ok" and n > 0, note
