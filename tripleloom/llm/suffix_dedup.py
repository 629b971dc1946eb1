"""Removal of repeated substrings through merged suffix orders of document shards.

The alphabet of the suffix order is phrases, not bytes.  A document is cut where the hash of the next
GRAM bytes is the least within RADIUS bytes to either side, so cuts depend on nearby bytes alone and
copies are cut alike.  Only phrases that occur twice take part.

1. Every shard (a task) builds the rows of its own order: for each phrase, the phrases from it on as
   far as a window of LENGTH bytes can reach, equal rows counted once.
2. The shards' rows are merged by interleave refinement: all rows start as one interval, each round
   refines every interval by the next symbol, and a row alone in its interval is finished; the round in
   which it parted is its longest common prefix.  An interval is refined in memory once it is small;
   large ones go through another distributed round, so no phrase, however common, fills one task.
3. A common prefix of n phrases covers all windows inside it.  What remains are windows at the ends of
   matches, whose first or last bytes lie in phrases that differ, and windows without two cuts.  Where
   the core that their cuts follow from occurs twice, their contents are hashed to 128 bits and counted,
   also in the copies whose interior they match.

Bit arrays that mark repeated phrases, cores and windows are filters of bounded size: they save
work, and every decision that follows from a set bit is checked exactly afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from tripleloom.functions.session import staged
from tripleloom.llm.common import bits_of, marked, marked_rows

LENGTH = 400
RADIUS = 32          # a power of two
GRAM = 8
BLOCK = 20_000       # rows of an interval that is refined in memory
FLUSH = 200_000      # windows named before they are counted and passed on
MULT = np.uint64(0x9E3779B97F4A7C15)
ZERO = np.zeros(1, np.int64)
OUTSIDE = RADIUS * 2 + GRAM      # bytes of a window in which no cut follows from the window alone


def cuts(b: bytes) -> np.ndarray:
    """0, the cuts, and the length of ``b``."""
    n = len(b)
    m = n - GRAM + 1
    if m < 2 * RADIUS + 1:
        return np.array([0, n] if n else [0], np.int64)
    g = np.empty(m, np.uint64)
    for o in range(GRAM):
        g[o::GRAM] = np.frombuffer(b, "<u8", (n - o) // GRAM, o)[:len(range(o, m, GRAM))]
    h = ((g * MULT) >> np.uint64(32)).astype(np.uint32)
    low, s = h, 1
    while s < RADIUS:
        low = np.minimum(low[:-s], low[s:])
        s *= 2
    mid = h[RADIUS:m - RADIUS]
    left, right = low[:len(mid)], low[RADIUS + 1:RADIUS + 1 + len(mid)]
    at = np.flatnonzero(((mid < left) & (mid <= right)) | ((mid <= left) & (mid < right))) + RADIUS
    return np.concatenate([[0], at, [n]])


def symbols(b: bytes, c: np.ndarray) -> list[int]:
    return [xxh3_64_intdigest(b[x:y]) for x, y in zip(c[:-1].tolist(), c[1:].tolist())]


def inner(c: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with the same inner cuts: where each begins, and the numbers of the first and the last cut that
    its windows themselves determine.  Worked out from the cuts, of which there are far fewer than bytes."""
    starts = max(0, n - length + 1)
    enter, leave = c - RADIUS + 1, c - (length - RADIUS - GRAM)
    at = np.concatenate([ZERO, enter, leave])
    at.sort()
    at = at[at.searchsorted(0):at.searchsorted(starts)]
    first = np.maximum(enter.searchsorted(at, "right"), 1)
    last = np.minimum(leave.searchsorted(at, "right") - 1, len(c) - 2)
    new = np.ones(len(at), bool)        # equal numbers in ``at`` have equal cuts
    new[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    return at[new], first[new], last[new]


def spread(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [x, y), one range after another."""
    size = y - x
    return np.repeat(x - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(x) else np.zeros(0, np.int64)


def joined(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of the ranges [x, y), ascending in x, as disjoint ranges that do not touch."""
    if len(x) < 2:
        return x, y
    far = np.maximum.accumulate(y)
    gap = (x[1:] > far[:-1]).nonzero()[0]
    return np.concatenate([x[:1], x[gap + 1]]), np.concatenate([far[gap], far[-1:]])


# Phrases and their order ----------------------------------------------------------------------------

def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (null as the smallest long), h (hash of the text) and the text's bytes; rows equal in id and
    text share their key, which is harmless: each is counted, and what holds for one holds for both."""
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("h"),
                       F.coalesce(text, F.lit("")).cast("binary").alias("b"))


def parsed(rows: DataFrame, length: int) -> DataFrame:
    """(id, h, n, sha, bare, starts, syms) of every document; ``bare``: some window has no two cuts."""
    def parse(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            starts, syms, bare = [], [], []
            for b in batch["b"]:
                c = cuts(b)
                _, first, last = inner(c, len(b), length)
                starts.append(c.astype(np.int32))
                bare.append(bool((last <= first).any()))
                syms.append(np.array(symbols(b, c) if len(b) >= length else [], np.uint64).view(np.int64))
            yield pd.DataFrame({"id": batch["id"], "h": batch["h"], "n": batch["b"].map(len), "sha": batch["sha"],
                                "bare": bare, "starts": starts, "syms": syms})
    return rows.withColumn("sha", F.sha2("b", 256)).mapInPandas(
        parse, "id long, h long, n long, sha string, bare boolean, starts array<int>, syms array<long>")


def shard_rows(phrases: DataFrame, repeated, length: int) -> DataFrame:
    """(id, h, j, s1, s2, seq): of each phrase that may lie in a repeated window, the phrases from it on.

    ``seq`` comes with the first row of its kind in a shard; s1 and s2 name it everywhere."""
    def build(batches: Iterator[pd.DataFrame]):
        sent: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            for i, h, starts, syms in zip(batch["id"], batch["h"], batch["starts"], batch["syms"]):
                if not len(syms):
                    continue
                s = np.ascontiguousarray(syms, np.int64)
                flag = marked(repeated.value, s.view(np.uint64))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
                for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    before = -length if x == 0 else int(starts[x - 1])
                    after = int(starts[-1]) + length if y == len(s) else int(starts[y + 1])
                    if after - before < length - OUTSIDE + 2:      # no window's inner cuts all lie in this run
                        continue
                    ends = np.minimum(np.searchsorted(starts, starts[x + 1:y + 1] + length), y)
                    for j, k in zip(range(x, y), ends.tolist()):
                        seq = s[j:k]
                        name = xxh3_128_digest(seq.tobytes())
                        out.append((i, h, j, name, None if name in sent else seq))
                        sent.add(name)
                if len(sent) > FLUSH:
                    sent.clear()
            if not out:
                continue
            names = np.frombuffer(b"".join(r[3] for r in out), "<i8").reshape(-1, 2)
            yield pd.DataFrame({"id": [r[0] for r in out], "h": [r[1] for r in out], "j": [r[2] for r in out],
                                "s1": names[:, 0], "s2": names[:, 1], "seq": [r[4] for r in out]})
    return phrases.select("id", "h", "starts", "syms").mapInPandas(build, "id long, h long, j int, s1 long, s2 long, seq array<long>")


def refine(rows: list[np.ndarray]) -> np.ndarray:
    """For each symbol row the longest prefix it shares with another of ``rows`` (all different).

    The interleave starts as one interval; round t parts every interval by symbol t.  Rows alone in
    their interval have parted and leave, as do rows that have ended."""
    lens = np.array([len(r) for r in rows])
    lcp, alive, interval, t = np.zeros(len(rows), np.int64), np.arange(len(rows)), np.zeros(len(rows), np.int64), 0
    while len(alive):
        alive, interval = alive[lens[alive] > t], interval[lens[alive] > t]
        symbol = np.array([rows[i][t] for i in alive], np.int64)
        order = np.lexsort((symbol, interval))
        new = np.ones(len(order), bool)
        new[1:] = (symbol[order][1:] != symbol[order][:-1]) | (interval[order][1:] != interval[order][:-1])
        number = np.cumsum(new) - 1
        shared = np.bincount(number)[number] > 1 if len(number) else new
        alive, interval = alive[order[shared]], number[shared]
        t += 1
        lcp[alive] = t
    return lcp


def merged(rows: DataFrame) -> DataFrame:
    """(s1, s2, lcp): the longest common prefix of each different symbol row with any other occurrence."""
    def in_memory(batches: Iterator[pd.DataFrame]):
        rest: list[pd.DataFrame] = []

        def done(part: pd.DataFrame):
            lcp = refine(part["seq"].tolist())
            own = np.where(part["n"] > 1, part["seq"].map(len), 0)
            return pd.DataFrame({"s1": part["s1"], "s2": part["s2"], "lcp": np.maximum(np.maximum(lcp, own), part["least"])})
        for batch in batches:       # ordered by interval: cut after the last that is known to be whole
            rest.append(batch)
            if sum(map(len, rest)) > BLOCK:
                have = pd.concat(rest)
                tail = (have["p1"] == have["p1"].iloc[-1]) & (have["p2"] == have["p2"].iloc[-1])
                if not tail.all():
                    yield done(have[~tail])
                    rest = [have[tail]]
        if rest:
            yield done(pd.concat(rest))

    different = rows.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.first("seq", ignorenulls=True).alias("seq"))
    todo, out, depth = staged(different), None, 0
    while True:
        depth += 1
        prefix = F.slice("seq", 1, depth)
        todo = todo.withColumns({"p1": F.xxhash64(prefix), "p2": F.xxhash64(F.lit(depth), prefix)})
        sizes = todo.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("m"))
        large = sizes.where(F.col("m") > BLOCK).drop("m")
        none = large.isEmpty()
        small = todo if none else todo.join(large, ["p1", "p2"], "left_anti")
        least = F.least(F.size("seq"), F.lit(depth - 1)).alias("least")
        part = (small.select("s1", "s2", "n", "seq", "p1", "p2", least).repartition("p1", "p2").sortWithinPartitions("p1", "p2")
                .mapInPandas(in_memory, "s1 long, s2 long, lcp long"))
        out = part if out is None else out.unionByName(part)
        if none:
            return out
        todo = staged(todo.join(large, ["p1", "p2"], "left_semi").drop("p1", "p2"))


# Windows --------------------------------------------------------------------------------------------

class Windows:
    """Window starts of one document, cut at ``starts``, in runs [at[r], at[r + 1]) that determine the same inner cuts.

    ``x`` and ``y`` bound the ranges of starts that a common prefix covers.  A run may hold other repeated
    windows only if the phrases between its inner cuts occur again (``may``).  What the cuts were derived from,
    the core of its windows, must then occur again too; a run without an inner cut (``bare``) has no core."""

    def __init__(self, b: bytes, starts, marks, length: int):
        self.b, self.length, c = b, length, np.asarray(starts, np.int64)
        n = max(0, len(b) - length + 1)
        reach = np.zeros(len(c), np.int64)
        marks = np.asarray(marks, np.int64)
        j = marks >> 32
        reach[j] = c[j + (marks & 0xFFFFFFFF)]
        past = reach - length
        whole = (past >= c).nonzero()[0]
        self.x, self.y = joined(c[whole], past[whole] + 1)
        at, first, last = inner(c, len(b), length)
        self.at, self.first, self.last, self.c = np.concatenate([at, [n]]), first, last, c
        self.bare = last < first
        top = len(c) - 1
        self.may = (last <= first) | (reach[np.minimum(first, top)] >= c[np.maximum(np.minimum(last, top), 0)])
        if len(self.x):
            size = (self.y - self.x).cumsum()
            i = self.x.searchsorted(self.at, "right") - 1       # the range that begins at or before each run; -1: none
            covered = np.where(i < 0, 0, size[i] - np.maximum(self.y[i] - self.at, 0))
            self.open = self.may & (covered[1:] - covered[:-1] < self.at[1:] - self.at[:-1])
        else:
            self.open = self.may

    def known(self, where: np.ndarray) -> np.ndarray:
        """Which of these starts a common prefix covers."""
        i = self.x.searchsorted(where, "right") - 1
        return (i >= 0) & (where < self.y[i]) if len(self.x) else np.zeros(len(where), bool)

    def cores(self, runs: np.ndarray) -> np.ndarray:
        c, b = self.c, self.b
        return np.array([xxh3_64_intdigest(b[c[f] - RADIUS:c[t] + RADIUS + GRAM])
                         for f, t in zip(self.first[runs].tolist(), self.last[runs].tolist())], np.uint64)

    def chosen(self, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of bare runs, and those of runs whose core occurs twice."""
        runs = np.flatnonzero(self.may & ~self.bare)
        runs = runs[marked(twice, self.cores(runs))] if len(runs) else runs
        return self.without_core(), spread(self.at[runs], self.at[runs + 1])

    def without_core(self) -> np.ndarray:
        runs = np.flatnonzero(self.bare)
        return spread(self.at[runs], self.at[runs + 1])

    def names(self, where: np.ndarray) -> np.ndarray:
        b, n = self.b, self.length
        return np.frombuffer(b"".join([xxh3_128_digest(b[p:p + n]) for p in where.tolist()]), "<i8").reshape(-1, 2)

    def again(self, where: np.ndarray) -> np.ndarray:
        """Which of these windows occur twice among them."""
        if len(where) < 2:
            return np.zeros(len(where), bool)
        names = self.names(where)
        order = np.lexsort((names[:, 1], names[:, 0]))
        same = (names[order][1:] == names[order][:-1]).all(axis=1)
        out = np.zeros(len(where), bool)
        out[order[1:][same]] = out[order[:-1][same]] = True
        return out


def with_cuts(rows: DataFrame) -> DataFrame:
    """Rows with the cuts of their bytes as ``starts``."""
    @F.pandas_udf("array<int>")
    def of(content: pd.Series) -> pd.Series:
        return pd.Series([cuts(b).astype(np.int32) for b in content], dtype=object)
    return rows.withColumn("starts", of("b"))


def windows_of(batch: pd.DataFrame, length: int):
    """The documents of a batch, one at a time."""
    for i, h, b, starts, marks in zip(batch["id"], batch["h"], batch["b"], batch["starts"], batch["marks"]):
        yield i, h, Windows(b, starts, marks, length)


def tally(names: list[np.ndarray]) -> pd.DataFrame:
    both = np.concatenate(names)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    new = np.ones(len(both), bool)
    new[1:] = (both[1:] != both[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return pd.DataFrame({"w1": both[at, 0], "w2": both[at, 1], "c": np.diff(at, append=len(both))})


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, h, n, sha) of every row, and (id, h, spans, n_removed, n_spans, kept_sha) of
    every key with something to remove.

    Spans are the maximal runs of bytes covered by a string of ``length`` bytes that also starts
    anywhere else, in this document or another; a string never runs over a document's end.  Null is
    empty.  Texts shorter than ``length`` have no span.  A row that is repeated, id and text, is its
    own copy, so all of it goes if it is long enough."""
    if length < OUTSIDE + 3 * RADIUS:
        raise ValueError(f"length must be at least {OUTSIDE + 3 * RADIUS}")
    rows = keyed(docs, id_col, text_col)
    phrases = staged(parsed(rows, length))
    twice = staged(phrases.select(F.explode("syms").alias("sym")).groupBy("sym").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sym"))
    shards = staged(shard_rows(phrases, bits_of(twice, "sym"), length))
    lcp = merged(shards).where("lcp > 0")
    marks = shards.select("id", "h", "j", "s1", "s2").join(lcp, ["s1", "s2"]).select("id", "h", (F.shiftleft(F.col("j").cast("long"), 32) + F.col("lcp")).alias("mark"))
    marks = marks.unionByName(phrases.where("bare").select("id", "h", F.lit(0).cast("long").alias("mark")))
    per_doc = staged(marks.groupBy("id", "h").agg(F.collect_set("mark").alias("marks")))
    wanted = bits_of(per_doc.select(F.xxhash64("id", "h").alias("k")), "k")
    texts = rows.withColumn("k", F.xxhash64("id", "h")).where(marked_rows("k", wanted)).drop("k")
    held = staged(with_cuts(texts.join(per_doc, ["id", "h"]).select("id", "h", "b", "marks")), "zstd")       # later passes need them four times

    def cores(batches):
        found, asked, size = [], [], 0

        def done():
            core, at, n = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
            return pd.DataFrame({"core": core.view(np.int64), "n": n, "asked": np.bincount(at, np.concatenate(asked), len(core)).astype(np.int64)})
        for batch in batches:
            for _, _, w in windows_of(batch, length):
                runs = np.flatnonzero(w.may & ~w.bare)
                found.append(w.cores(runs))
                asked.append(w.open[runs])
                size += len(runs)
                if size > FLUSH:
                    yield done()
                    found, asked, size = [], [], 0
        if size:
            yield done()
    twice = bits_of(staged(held.mapInPandas(cores, "core long, n long, asked long").groupBy("core").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked"))
                           .where("n > 1 and asked > 0").select("core")), "core")

    def counted(batches):
        found, size = [], 0
        for batch in batches:
            for _, _, w in windows_of(batch, length):
                found += [w.names(p) for p in w.chosen(twice.value)]
                size += len(found[-1]) + len(found[-2])
                if size > FLUSH:
                    yield tally(found)
                    found, size = [], 0
        if size:
            yield tally(found)
    more = staged(held.mapInPandas(counted, "w1 long, w2 long, c long").groupBy("w1", "w2").agg(F.sum("c").alias("c")).where("c > 1").select("w1", "w2"))
    seen = bits_of(more, "w1")

    def opened(batches):
        names_of = ["id", "h", "at", "w1", "w2"]
        found, size = [], 0
        for batch in batches:
            for i, h, w in windows_of(batch, length):
                bare, cored = w.chosen(twice.value)
                p = np.concatenate([bare[~w.again(bare)], cored])        # finish() sees again() for itself
                p = p[~w.known(p)]
                if not len(p):
                    continue
                names = w.names(p)
                hit = marked(seen.value, np.ascontiguousarray(names[:, 0]).view(np.uint64))
                found.append(np.column_stack([np.full(hit.sum(), i), np.full(hit.sum(), h), p[hit], names[hit]]))
                size += len(found[-1])
                if size > FLUSH:
                    yield pd.DataFrame(np.concatenate(found), columns=names_of)
                    found, size = [], 0
        if size:
            yield pd.DataFrame(np.concatenate(found), columns=names_of)
    ends = (held.mapInPandas(opened, "id long, h long, at long, w1 long, w2 long").join(more, ["w1", "w2"], "left_semi")
            .groupBy("id", "h").agg(F.collect_set(F.col("at").cast("int")).alias("at")))

    def finish(batches):
        for batch in batches:
            out = []
            for i, h, b, starts, marks_, at in zip(batch["id"], batch["h"], batch["b"], batch["starts"], batch["marks"], batch["at"]):
                w = Windows(b, starts, marks_, length)
                bare = w.without_core()
                more_ = np.sort(np.concatenate([bare[w.again(bare)], np.asarray([] if at is None else at, np.int64)]))
                x, y = np.concatenate([w.x, more_]), np.concatenate([w.y, more_ + 1])
                order = np.argsort(x, kind="stable")
                x, y = joined(x[order], y[order] + length - 1)
                if not len(x):
                    continue
                kept = b"".join([b[p:q] for p, q in zip([0, *y.tolist()], [*x.tolist(), len(b)])])
                out.append((i, h, [{"start": p, "end": q} for p, q in zip(x.tolist(), y.tolist())], int((y - x).sum()),
                            len(x), hashlib.sha256(kept).hexdigest()))
            if out:
                yield pd.DataFrame(out, columns=["id", "h", "spans", "n_removed", "n_spans", "kept_sha"])
    removed = held.join(ends, ["id", "h"], "left").mapInPandas(
        finish, "id long, h long, spans array<struct<start: int, end: int>>, n_removed long, n_spans long, kept_sha string")
    removed = staged(removed.groupBy("id", "h").agg(*[F.max(c).alias(c) for c in ("spans", "n_removed", "n_spans", "kept_sha")]))
    return phrases.select("id", "h", "n", "sha"), removed


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the spans taken out of the text; all other columns and all rows as given.

    A span that begins or ends inside a character is narrowed to whole characters, so that the text
    stays text.  Rows with nothing to remove do not move."""
    _, removed = repeats(docs, id_col, text_col, length)
    spans = removed.select("id", "h", "spans")
    hit = bits_of(spans.select(F.xxhash64("id", "h").alias("k")), "k")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("h"))
    rows = rows.withColumn("k", F.xxhash64("id", "h")).withColumn("may", marked_rows("k", hit))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans_: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else cut_text(t, s) for t, s in zip(texts, spans_)], dtype=object)
    changed = rows.where("may").join(spans, ["id", "h"], "left").withColumn("row", F.col("row").withField(f"`{text_col}`", cut("text", "spans")))
    return rows.where("not may").select("row.*").unionByName(changed.select("row.*"))


def cut_text(text: str | None, spans) -> str | None:
    if text is None:
        return None
    b, out, at = text.encode("utf-8"), [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        x, y = s["start"], s["end"]
        while x < y and b[x] & 0xC0 == 0x80:
            x += 1
        while y > x and y < len(b) and b[y] & 0xC0 == 0x80:
            y -= 1
        out.append(b[at:x])
        at = y
    return b"".join([*out, b[at:]]).decode("utf-8")


def query(docs: DataFrame) -> DataFrame:
    """Of every document how many bytes and spans go, and the digest of the rest."""
    whole, removed = repeats(docs)
    return whole.join(removed.drop("spans"), ["id", "h"], "left").select(
        F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id"), F.col("n").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))
