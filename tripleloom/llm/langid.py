"""Language identification by unigram pieces, marginalised over all segmentations.

A fixed public vocabulary gives the pieces.  Each language has its own piece probabilities; the
probability of a word is the sum over all ways to cut it into pieces, by a forward recursion, and that
of a text the product over its words (pieces never cross a word).  The probabilities are fitted by
expectation-maximisation, whose expected counts use the same recursion forwards and backwards.

Words are runs of letters in lower case with the vocabulary's word-start sign before them.  A letter
without a piece of its own is covered by a stand-in piece that every language shares.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.session import staged
from tripleloom.llm.common import fold
from tripleloom.llm.tokens import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
FIT_DOCS = 1000      # documents of each language that the fit reads, chosen by a hash of their id
ROUNDS = 3
SMOOTH = 0.1
START = "▁"
LETTERS = regex.compile(r"\p{L}+")
LONGEST = 16         # letters of the longest piece that is used
MULT = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 16_384       # distinct words worked on at once


class Pieces:
    """The vocabulary as sorted hashes, so that all substrings of many words are looked up at once."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        names = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.names = sorted(p for p in names if p == p.lower() and len(p) <= LONGEST and LETTERS.fullmatch(p.removeprefix(START) or "a"))
        hashes = np.array([hash_of(p) for p in self.names], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.size = len(self.names) + 1          # the last is the stand-in for a single letter

    def spans(self, codes: np.ndarray) -> list[np.ndarray]:
        """For words of one length: at [l][:, i] the piece on the l letters from i, or -1."""
        n, length = codes.shape
        prefix = np.zeros((n, length + 1), np.uint64)
        for i in range(length):
            prefix[:, i + 1] = prefix[:, i] * MULT + codes[:, i]
        power, out = np.ones(1, np.uint64), [np.zeros((n, 0), np.int32)]
        for l in range(1, min(LONGEST, length) + 1):
            power = power * MULT
            h = prefix[:, l:] - prefix[:, :-l] * power
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out.append(np.where(self.hashes[at] == h, self.order[at], self.size - 1 if l == 1 else -1).astype(np.int32))
        return out


def hash_of(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(MULT) + ord(c)) % (1 << 64)
    return h


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def blocks(words: list[str]):
    """(positions, code points) of words of one length, in blocks of bounded size."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for length, at in sorted(by_length.items()):
        step = max(1, BLOCK * 8 // max(8, length))
        for lo in range(0, len(at), step):
            part = at[lo:lo + step]
            text = "".join(words[i] for i in part).encode("utf-32-le")
            yield np.array(part), np.frombuffer(text, "<u4").reshape(len(part), length).astype(np.uint64)


def forward(spans: list, length: int, prob: np.ndarray):
    """Log of the summed probability of all segmentations, (words, languages).

    ``prob`` is (pieces + 1, languages) with zeros at the end, which -1 picks.  Only a window of
    ``LONGEST`` letters is held, and it is rescaled as often, so words of any length are scored."""
    n, langs = len(spans[1]), prob.shape[1]
    window, total = [np.ones((n, langs))], np.zeros((n, langs))
    for j in range(1, length + 1):
        window.insert(0, sum(window[l - 1] * prob[spans[l][:, j - l]] for l in range(1, min(LONGEST, j) + 1)))
        del window[LONGEST:]
        if j % LONGEST == 0:
            top = np.maximum.reduce(window)
            window = [w / top for w in window]
            total += np.log(top)
    return np.log(window[0]) + total


def word_scores(words: list[str], path: str, prob: np.ndarray) -> np.ndarray:
    """(words, languages): log probability of each word."""
    p, out = pieces(path), np.zeros((len(words), prob.shape[1]))
    prob = np.vstack([prob, np.zeros((1, prob.shape[1]))])
    for at, codes in blocks([START + w for w in words]):
        out[at] = forward(p.spans(codes), codes.shape[1], prob)
    return out


def scaled_sums(spans: list, prob: np.ndarray, n: int, length: int, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Summed probabilities of all segmentations up to (or from) every place, as values and the logs of what they are to be multiplied by.

    The last ``LONGEST`` values are rescaled as often, so a run of letters of any length neither under- nor overflows."""
    sums, logs = np.zeros((length + 1, n)), np.zeros((length + 1, n))
    order = range(length, -1, -1) if backward else range(length + 1)
    sums[order[0]] = 1.0
    for k, j in enumerate(order):
        if k:
            steps = range(1, min(LONGEST, k) + 1)
            sums[j] = sum(sums[j + l] * prob[spans[l][:, j]] for l in steps) if backward else sum(sums[j - l] * prob[spans[l][:, j - l]] for l in steps)
            logs[j] = logs[order[k - 1]]
        if k % LONGEST == LONGEST - 1:
            window = slice(j, j + LONGEST) if backward else slice(j - LONGEST + 1, j + 1)
            # all values of a window are under the scale of its newest one when the next ones are summed from them
            level = np.exp(logs[window] - logs[j])
            top = (sums[window] * level).max(axis=0)
            top = np.where(top > 0, top, 1.0)
            sums[window] = sums[window] * level / top
            logs[window] = logs[j] + np.log(top)
    return sums, logs


def expected(words: list[str], weight: np.ndarray, path: str, prob: np.ndarray) -> np.ndarray:
    """Expected piece counts of weighted words of one language under ``prob`` (pieces); runs of letters of any length teach."""
    p, out = pieces(path), np.zeros(len(prob))
    prob = np.append(prob, 0.0)
    for at, codes in blocks([START + w for w in words]):
        n, length = codes.shape
        spans = p.spans(codes)
        alpha, alpha_log = scaled_sums(spans, prob, n, length, False)
        beta, beta_log = scaled_sums(spans, prob, n, length, True)
        whole = np.log(alpha[length], out=np.full(n, np.inf), where=alpha[length] > 0) + alpha_log[length]
        for l in range(1, len(spans)):
            if l > length:
                break
            piece = spans[l][:, :length - l + 1]
            scale = np.exp(np.minimum(alpha_log[:length - l + 1] + beta_log[l:] - whole, 700.0)).T
            share = weight[at][:, None] * alpha[:length - l + 1].T * prob[piece] * beta[l:].T * scale
            out += np.bincount((piece % len(prob)).ravel(), share.ravel(), len(prob))[:-1]
    return out


def fit(docs: DataFrame, lang: Column, learn: Column, vocabulary: str = VOCABULARY, per_language: int = FIT_DOCS, rounds: int = ROUNDS) -> dict:
    """Piece probabilities of every language: {"langs": [...], "prob": (pieces, languages)}.

    Reads at most ``per_language`` documents of each language (those whose id has the smallest hash); rows that share such an id
    are all read, and rows with a null id are never drawn.
    What comes to the driver is a table of vocabulary x languages.
    """
    path = vocabulary_path(vocabulary)
    ids = docs.where(learn & lang.isNotNull()).select("doc_id", lang.alias("lang"))
    share = ids.groupBy("lang").agg((F.lit(2.0 * per_language) / F.count(F.lit(1))).alias("share"))     # a row a language
    at = F.xxhash64("doc_id")
    by = Window.partitionBy("lang").orderBy(at, "doc_id")
    low = ids.join(F.broadcast(share), "lang").where(at < F.col("share") * float(1 << 64) - float(1 << 63))
    drawn = low.withColumn("r", F.row_number().over(by)).where(F.col("r") <= per_language).select("doc_id").distinct()
    texts = (docs.where(learn & lang.isNotNull()).select("doc_id", lang.alias("lang"), "text")
             .join(F.broadcast(drawn), "doc_id", "left_semi"))     # at most per_language rows a language

    def words(batches):
        for batch in batches:
            for tag, part in batch.groupby("lang"):
                found: dict[str, int] = {}
                for text in part["text"]:
                    for w in LETTERS.findall((text or "").lower()):
                        found[w] = found.get(w, 0) + 1
                if found:
                    yield pd.DataFrame({"lang": tag, "word": pd.Series(list(found), dtype=object), "n": list(found.values())})

    counts = staged(texts.mapInPandas(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    size = pieces(path).size
    prob = np.full((size, len(langs)), 1.0 / size)
    for _ in range(rounds if langs else 0):
        now = prob

        def gather(batches):
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                for tag, part in batch.groupby("lang"):
                    got = expected(part["word"].tolist(), part["n"].to_numpy(float), path, now[:, langs.index(tag)])
                    sums[tag] = sums.get(tag, 0) + got
            for tag, got in sums.items():
                at = np.flatnonzero(got)
                yield pd.DataFrame({"lang": tag, "piece": at, "n": got[at]})

        table_ = (counts.mapInPandas(gather, "lang string, piece long, n double").groupBy("lang", "piece")
                  .agg(F.sum("n").alias("n")).toPandas())
        got = np.zeros_like(prob)
        got[table_["piece"], [langs.index(x) for x in table_["lang"]]] = table_["n"]
        prob = (got + SMOOTH) / (got.sum(axis=0) + SMOOTH * size)
    return {"langs": langs, "prob": prob, "path": path}


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the posterior under equal priors; equal posteriors: first by name).

    Null text, text without a letter, and a model without languages give ``und`` and 0.  Columns of
    these two names are replaced.
    """
    langs, prob, path = model["langs"], model["prob"], model["path"]

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        known: dict[str, int] = {}
        found = []
        for text in texts:
            ws = LETTERS.findall(text.lower()) if text and langs else []
            found.append(np.array([known.setdefault(w, len(known)) for w in ws], np.int64))
        scores = word_scores(list(known), path, prob) if known else np.zeros((0, len(langs)))
        names, best = [], []
        for at in found:
            if not len(at):
                names.append("und")
                best.append(0.0)
                continue
            total = scores[at].sum(axis=0)
            post = np.exp(total - total.max())
            names.append(langs[int(total.argmax())])
            best.append(float(post.max() / post.sum()))
        return pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": best})
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, of(F.col(text_col)).alias("_p")).select(*kept, "_p.lang_pred", "_p.score")


def query(docs: DataFrame) -> DataFrame:
    """The language of every document, learned from those whose fold is not 2."""
    model = fit(docs.select("doc_id", "lang", "text"), F.col("lang"), fold("doc_id", 4) != 2)
    out = predict(docs.select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
