"""Cross-tokenizer alignment against plain loops over tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tripleloom.llm import alignment
from tripleloom.llm.tokens import vocabulary_path

A, B = vocabulary_path(alignment.A_NAME), vocabulary_path(alignment.B_NAME)
ODD = [None, "", " ", "a", "  two  blanks ", "a▁b", "nul\x00nul", "\n\ttab\r\n", "ﬁ é naïve", "日本語😀 中文", "<s>x</s><unk>", "<|endoftext|>", "<0x41>", "x" * 3000,
       "\U0001F600" * 50, "1234567890 " * 40, "é", "the cat's they'll"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(texts, libraries):
    """Per text: A ids, B ids, groups and links, by walking over both token lists."""
    from tripleloom.llm.tokens import byte_letters
    a, b = libraries
    letters, out = byte_letters(), []
    for text in texts:
        if not text:
            out.append(([], [], [], []))
            continue
        line = (" " + text).encode()
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ba = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(ba) != line or b"".join(bb) != line:
            out.append(([], [], [], []))
            continue
        spans = []
        for pieces in (ba, bb):
            at, found = 0, []
            for p in pieces:
                found.append((at, at + len(p)))
                at += len(p)
            spans.append(found)
        links, j = [], 0
        for x, (s, e) in zip(ia, spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(ib) and spans[1][k][0] < e:
                links.append((x, ib[k]))
                k += 1
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for end in common:
            groups.append((start, end, [x for x, (s, e) in zip(ia, spans[0]) if start < e <= end] if len(ia) < 2000 else None,
                           [x for x, (s, e) in zip(ib, spans[1]) if start < e <= end] if len(ib) < 2000 else None))
            start = end
        out.append((ia, ib, groups, links))
    return out


def expected(texts, libraries):
    found = plain(texts, libraries)
    count = Counter(pair for _, _, _, links in found for pair in set(links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    rows = []
    for ia, ib, groups, links in found:
        digest = ";".join(",".join(map(str, g[2])) + "|" + ",".join(map(str, g[3])) for g in groups)
        rows.append((len(ia), len(ib), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
                     hashlib.sha256(digest.encode()).hexdigest() if ia else ""))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_equals_plain_loops_on_whole_documents(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [r for r in docs.collect() if len(r["text"] or "") < 4000]
    texts = [r["text"] for r in rows] + ODD + ["the cat's they'll"]
    given = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.query(given).collect()}
    want = expected(texts, libraries)
    assert got == dict(enumerate(want))


def test_small_pieces_and_blocks_give_the_same(spark, libraries, monkeypatch):
    texts = [t for t in ODD for _ in range(2)]
    given = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    whole = sorted(tuple(r) for r in alignment.query(given).collect())
    tools = alignment.tokenizers(A, B)
    sizes = alignment.lengths_of(tools)
    x = alignment.Aligned(texts, tools, *sizes)
    for piece in (1, 2, 3, 7, 64):
        parts = [*alignment.merge_path(x.a_ends, x.b_ends, piece)]
        assert all(len(p[0]) <= piece for p in parts)
        for k, name in enumerate(("left", "right", "tie")):
            assert np.array_equal(np.concatenate([p[k] for p in parts]), getattr(x, name))
    assert sum(r[4] for r in whole) == len(x.left) and sum(r[3] for r in whole) == int(x.tie.sum())


def test_diagonals_split_like_a_merge():
    rnd = random.Random(5)
    for _ in range(200):
        a, b = (np.cumsum([rnd.randint(1, 4) for _ in range(rnd.randint(0, 30))]).astype(np.int64) for _ in range(2))
        merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        for d in range(len(merged) + 1):
            assert alignment.splits(a, b, np.array([d]))[0] == sum(side == 0 for _, side in merged[:d])


def test_groups_keep_bytes_and_ids(spark, libraries):
    texts = ["naïve cafés in Zürich", "", None, "a▁b"]
    given = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, groups string")
    got = {r["id"]: r["groups"] for r in alignment.groups(given).collect()}
    for i, (_, _, groups, _) in enumerate(plain(texts, libraries)):
        assert [(g["start"], g["end"], g["a"], g["b"]) for g in got[i]] == groups


def test_edges(spark, libraries):
    rows = [(None, "same text", 1, "z"), (7, "same text", 2, None), (7, "same text", 2, None), (8, None, 3, "q"), (9, "", 4, "q")]
    given = spark.createDataFrame(rows, "doc_id long, text string, block long, pairs string")
    got = sorted((tuple(r) for r in alignment.query(given).collect()), key=str)
    want = expected([r[1] for r in rows], libraries)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, want)), key=str)
    assert alignment.query(given.limit(0)).count() == 0
    table = {(r["a_id"], r["b_id"]): r["count"] for r in alignment.pair_table(given).collect()}
    assert set(table.values()) == {3} and len(table) >= 2


def test_a_long_text_spans_many_pieces(spark):
    text = "the naïve cat " * 30_000
    given = spark.createDataFrame([(1, text), (2, "the naïve cat ")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in alignment.query(given).collect()}
    tools = alignment.tokenizers(A, B)
    a, b = tools.encode(text)
    assert (got[1]["n_a"], got[1]["n_b"]) == (len(a), len(b)) and got[1]["n_a"] + got[1]["n_b"] > 2 * alignment.PIECE
    ends = [set(np.cumsum([len(table[i]) for i in ids]).tolist()) for ids, table in ((a, tools.a_bytes), (b, tools.b_bytes))]
    assert got[1]["n_groups"] == len(ends[0] & ends[1]) and got[1]["n_links"] == len(ends[0] | ends[1])
