"""Cross-tokenizer alignment through merge-path partitioning.

A text is cut by two tokenizers, A and B, and the byte offsets where tokens end are two ascending lists.
Merging the lists orders the ends: each distinct end closes one stretch of bytes that lies in exactly one
A token and one B token, so it is one link, and an end that both lists hold closes a group.

The merge of the lists of many texts (a text's offsets continue those of the text before) is divided along
diagonals: diagonal d crosses the merge path at the one split (i, d - i) that leaves the first d ends
behind it, which a binary search finds without merging anything.  Pieces between neighbouring diagonals
have the same number of ends, whatever the texts are like, and know nothing of one another: each
emits the links and the common ends it holds.  A group that began in an earlier piece is stitched
by numbering common ends over all pieces.

How many texts hold a pair linked is counted per block of texts first, so that a pair travels once per block.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.session import staged
from tripleloom.llm.tokens import PLAIN, byte_letters, vocabulary_path

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
PIECE = 1 << 15          # ends that one piece merges
BLOCK_BYTES = 2 << 20    # text of a block, unless a single text has more
LONGEST_RUN = 10_000     # longest run without a break that the faster library is given
SPREAD = 1 << 32         # a pair (a, b) is the number a * SPREAD + b
BLANK = "▁"              # stands for a blank in pieces


class Tokenizers:
    """Both vocabularies and, for each id, the bytes it stands for."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes: list = [None] * (1 + max(vocabulary.values(), default=0))
        for piece, number in vocabulary.items():
            self.a_bytes[number] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.b_bytes = [self.piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.fast = self.ranks()

    def piece_bytes(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace(BLANK, " ").encode()

    def ranks(self):
        """The same vocabulary under a faster library; None where its pattern is not the known one or numbers have gaps."""
        import json
        import public_tokenizers
        import tiktoken
        stated = json.loads(self.a.to_str())
        plain = stated["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": stated["pre_tokenizer"].get("trim_offsets"), "use_regex": True}
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {self.a_bytes[i]: i for s, i in self.a.get_vocab(with_added_tokens=True).items() if s not in special}
        if not plain or stated["normalizer"] or len(ranks) != 1 + max(ranks.values()):
            return None
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def a_ids(self, text: str) -> list[int]:
        """Texts of plain letters without very long runs go to the faster library: both cut them alike."""
        if self.fast and PLAIN.fullmatch(text) and not LONG_RUN.search(text):
            return self.fast.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both; none if the text is empty or the tokens of either do not spell it."""
        if not text:
            return [], []
        line = " " + text
        whole, b = line.encode(), self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return [], []
        a = self.a_ids(line)
        return (a, b) if b"".join(map(self.a_bytes.__getitem__, a)) == whole else ([], [])


def _long_run():
    import regex
    return regex.compile(rf"\p{{L}}{{{LONGEST_RUN}}}|\s{{{LONGEST_RUN}}}|[^\s\p{{L}}\p{{N}}]{{{LONGEST_RUN}}}|\p{{N}}{{{LONGEST_RUN}}}")


LONG_RUN = _long_run()


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def splits(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many ends of ``a`` lie before each diagonal of the merge path; on ties those of ``a`` come first."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        ahead = open_.copy()                                    # a[mid] is merged before b[d - mid - 1]: the split lies further on
        ahead[open_] = a[mid[open_]] <= b[diagonals[open_] - mid[open_] - 1]
        low, high = np.where(ahead, mid + 1, low), np.where(open_ & ~ahead, mid, high)
    return low


def merged_piece(a: np.ndarray, b: np.ndarray, i0: int, j0: int, i1: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One piece of the merge path, ends a[i0:i1] and b[j0:j1]: its links as places in ``a`` and in ``b``, in order, and
    which of them end on both sides.  An end of ``b`` equal to one of ``a`` adds no link; that one may be the last of the piece before."""
    mine, other = a[i0:i1], b[j0:j1]
    to = j0 + np.searchsorted(other, mine, "left")                               # the B token that the end of an A token lies in
    both = (to < len(b)) & (b[np.minimum(to, len(b) - 1)] == mine)
    at = i0 + np.searchsorted(mine, other, "left")
    before = np.searchsorted(a[max(0, i0 - 1):i1], other, "right") - 1 + max(0, i0 - 1)
    new = (before < 0) | (a[np.maximum(before, 0)] != other)
    left, right = np.concatenate([np.arange(i0, i1), at[new]]), np.concatenate([to, np.arange(j0, j1)[new]])
    tie = np.concatenate([both, np.zeros(int(new.sum()), bool)])
    order = np.argsort(left + right, kind="stable")                              # each link goes one step further in a or in b
    return left[order], right[order], tie[order]


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pieces of the merge of two lists of token ends that cover the same bytes, in order."""
    n = len(a) + len(b)
    at = np.append(np.arange(0, n, piece), n)
    i = splits(a, b, at)
    for k in range(len(at) - 1):
        yield merged_piece(a, b, int(i[k]), int(at[k] - i[k]), int(i[k + 1]), int(at[k + 1] - i[k + 1]))


class Aligned:
    """Texts of one block side by side: tokens, links and groups of all, and where each text's begin."""

    def __init__(self, texts: list, tools: Tokenizers, a_lengths: np.ndarray, b_lengths: np.ndarray):
        ids = [tuple(np.array(side, np.int32) for side in tools.encode(t)) for t in texts]
        self.a, self.b = (np.concatenate([pair[k] for pair in ids] or [np.zeros(0, np.int32)]).astype(np.int64) for k in (0, 1))
        self.a_from, self.b_from = (np.concatenate([[0], np.cumsum([len(pair[k]) for pair in ids])]).astype(np.int64) for k in (0, 1))
        self.a_ends, self.b_ends = np.cumsum(a_lengths[self.a]), np.cumsum(b_lengths[self.b])
        parts = [*merge_path(self.a_ends, self.b_ends)]
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        self.left, self.right, self.tie = (np.concatenate([p[k] for p in parts] or [none[k]]) for k in range(3))
        self.a_cut, self.b_cut = self.left[self.tie] + 1, self.right[self.tie] + 1       # tokens up to the end of each group
        self.link_from, self.group_from = np.searchsorted(self.left, self.a_from), np.searchsorted(self.a_cut, self.a_from, "right")

    def line(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens in the order in which groups are written, as id * 4 + separator (A's ids first), and where texts begin.

        Separators: 0 a comma, 1 a bar, 2 a semicolon, 3 nothing (at the end of a text)."""
        group_a = np.searchsorted(self.a_cut, np.arange(len(self.a)), "right")
        group_b = np.searchsorted(self.b_cut, np.arange(len(self.b)), "right")
        b_before = np.concatenate([[0], self.b_cut])
        out = np.empty(len(self.a) + len(self.b), np.int64)
        a_at, b_at = np.arange(len(self.a)) + b_before[group_a], np.arange(len(self.b)) + self.a_cut[group_b] if len(self.b) else np.zeros(0, np.int64)
        out[a_at], out[b_at] = self.a * 4, self.b * 4
        out[a_at[self.a_cut - 1]] += 1
        out[b_at[self.b_cut - 1]] += 2
        last = self.b_from[1:][np.diff(self.b_from) > 0] - 1
        out[b_at[last]] += 1
        return out, self.a_from + self.b_from


SEPARATORS = (",", "|", ";", "")


def blocks_of(texts: list) -> Iterator[slice]:
    start, held = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > start and held + n > BLOCK_BYTES:
            yield slice(start, k)
            start, held = k, 0
        held += n
    if texts:
        yield slice(start, len(texts))


def lengths_of(tools: Tokenizers) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([len(x or b"") for x in table], np.int64) for table in (tools.a_bytes, tools.b_bytes))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A_NAME, b: str = B_NAME) -> DataFrame:
    """(id, groups): the aligned groups of every text in order, each with its byte range in blank + text and the ids of both sides."""
    paths = vocabulary_path(a), vocabulary_path(b)

    def of(batches):
        tools = tokenizers(*paths)
        sizes = lengths_of(tools)
        for batch in batches:
            for part in blocks_of([*batch["text"]]):
                rows = batch.iloc[part]
                x, out = Aligned([*rows["text"]], tools, *sizes), []
                for k in range(len(rows)):
                    found, i, j = [], int(x.a_from[k]), int(x.b_from[k])
                    zero = int(x.a_ends[i - 1]) if i else 0
                    for g in range(int(x.group_from[k]), int(x.group_from[k + 1])):
                        i1, j1 = int(x.a_cut[g]), int(x.b_cut[g])
                        found.append({"start": (int(x.a_ends[i - 1]) if i else 0) - zero, "end": int(x.a_ends[i1 - 1]) - zero,
                                      "a": x.a[i:i1].tolist(), "b": x.b[j:j1].tolist()})
                        i, j = i1, j1
                    out.append(found)
                yield pd.DataFrame({"id": rows["id"], "groups": out})
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInPandas(of, f"id {kind}, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>")


def blocks(docs: DataFrame, id_col: str, text_col: str, a: str, b: str) -> DataFrame:
    """One row per text (its figures, and the block's pairs that it links: places in the block's list and how often), and one row
    per block, with null figures: its distinct pairs and in how many of its texts each is linked."""
    paths = vocabulary_path(a), vocabulary_path(b)
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def of(batches):
        tools, task, number = tokenizers(*paths), TaskContext.get().partitionId(), 0
        sizes = lengths_of(tools)
        written = [f"{i}{s}" for i in range(max(len(tools.a_bytes), len(tools.b_bytes))) for s in SEPARATORS]
        for batch in batches:
            for part in blocks_of([*batch["text"]]):
                rows = batch.iloc[part]
                x = Aligned([*rows["text"]], tools, *sizes)
                pairs, at = np.unique(x.a[x.left] * SPREAD + x.b[x.right], return_inverse=True)
                text = np.repeat(np.arange(len(rows)), np.diff(x.link_from))
                held, times = np.unique(text * max(1, len(pairs)) + at, return_counts=True)
                place = held % max(1, len(pairs))
                cut = np.searchsorted(held, np.arange(len(rows) + 1) * max(1, len(pairs)))
                line, begin = x.line()
                digest = ["" if lo == hi else hashlib.sha256("".join(map(written.__getitem__, line[lo:hi].tolist())).encode()).hexdigest()
                          for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist())]
                block = (task << 32) + number
                number += 1
                yield pd.DataFrame({"block": block, "id": rows["id"], "n_a": np.diff(x.a_from), "n_b": np.diff(x.b_from), "n_groups": np.diff(x.group_from),
                                    "n_links": np.diff(x.link_from), "digest": digest,
                                    "places": [place[lo:hi].astype(np.int32) for lo, hi in zip(cut[:-1], cut[1:])],
                                    "times": [times[lo:hi].astype(np.int32) for lo, hi in zip(cut[:-1], cut[1:])], "pairs": None, "texts": None})
                yield pd.DataFrame({"block": [block], "id": rows["id"].iloc[:1].to_numpy(), "n_a": None, "n_b": None, "n_groups": None, "n_links": None, "digest": None, "places": None,
                                    "times": None, "pairs": [pairs], "texts": [np.bincount(place, minlength=len(pairs))]})
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInPandas(of, f"block long, id {kind}, n_a long, n_b long, n_groups long, n_links long, digest string, places array<int>, times array<int>, "
                                 "pairs array<long>, texts array<long>")


def pair_counts(each: DataFrame) -> DataFrame:
    """(pair, count, best): in how many texts of all blocks a pair is linked, and whether no pair of its A id is in more.

    The highest counts are one row per id of A's vocabulary, which bounds what is broadcast."""
    counts = (each.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "texts")).alias("p")).groupBy(F.col("p.pairs").alias("pair"))
              .agg(F.sum("p.texts").alias("count")))
    counts = staged(counts.withColumn("a", F.floor(F.col("pair") / F.lit(SPREAD)).cast("int")))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def pair_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A_NAME, b: str = B_NAME) -> DataFrame:
    """(a_id, b_id, count, best): the alignment table of two vocabularies that a corpus gives."""
    found = pair_counts(staged(blocks(docs, id_col, text_col, a, b), "zstd"))
    return found.select(F.floor(F.col("pair") / F.lit(SPREAD)).cast("int").alias("a_id"), (F.col("pair") % F.lit(SPREAD)).cast("int").alias("b_id"), "count", "best")


def _looked_up(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Sums over the links of the texts of one block, whose pairs come with their counts."""
    size = int(found["place"].max()) + 1 if len(found) else 0
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    count[found["place"]], best[found["place"]] = found["count"], found["best"]
    out = texts[["id", "n_a", "n_b", "n_groups", "n_links", "digest"]].copy()
    sums = [((count[p] * t).sum(), (best[p] * t).sum()) for p, t in zip(texts["places"], texts["times"])]
    out["count_sum"], out["n_best"] = (np.array([s[k] for s in sums], np.int64) for k in (0, 1))
    return out


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A_NAME, b: str = B_NAME) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest): one row per row of ``docs``.

    ``count_sum`` adds, over a text's links, in how many texts the linked pair of ids occurs, and ``n_best`` counts the links whose
    pair is the most frequent of its A id (ties included); ``digest`` is the SHA-256 of the groups, written ``a1,a2|b1;a3|b2,b3``.
    Null and empty texts, and texts that the tokens of a side do not spell, have zeros and an empty digest.  Rows that repeat an
    id or a text, null ids included, count each; an empty table gives no rows; other columns are not read.
    """
    each = staged(blocks(docs, id_col, text_col, a, b), "zstd")
    asked = each.where("pairs is not null").select(F.col("block").alias("in_block"), F.posexplode("pairs").alias("place", "pair"))
    found = asked.join(pair_counts(each), "pair").select("in_block", "place", "count", F.col("best").cast("long").alias("best"))
    texts = each.where("pairs is null").drop("pairs", "texts")
    kind = texts.schema["id"].dataType.simpleString()
    return (texts.groupBy("block").cogroup(found.groupBy("in_block"))
            .applyInPandas(_looked_up, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, digest string, count_sum long, n_best long"))


def query(docs: DataFrame) -> DataFrame:
    """The figures of ``align`` for every document."""
    return align(docs).select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("digest").alias("groups_sha256"))
