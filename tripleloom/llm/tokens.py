"""Token counts under a fixed byte-pair vocabulary with word ends, through a whole-token shortcut.

When a counter is made it tries every vocabulary string that ends a word: those which the library
turns into exactly their one token need no merging ever again.  In a text, pre-tokens that are such
strings count one each; only the others are merged, by the library, and each distinct one once.

Texts whose characters could be treated otherwise by the library's normaliser (anything outside the
listed plain ranges, or a special string) go to the library whole.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
MEMO = 300_000       # pre-tokens remembered per worker besides the whole tokens
# White space, printable ASCII and accented Latin letters: lower case and classes are the same everywhere.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-¬®-įı-ž]*")
# The pattern stated in the vocabulary file.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def vocabulary_path(name: str) -> str:
    """A bare file name is looked up among the installed public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by rule."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        vocabulary, letters = self.library.get_vocab(with_added_tokens=False), byte_letters()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ends = np.zeros(1 + max(vocabulary.values(), default=0), bool)
        self.whole: dict[str, int] = {}
        for piece, number in vocabulary.items():
            if piece.endswith("</w>"):
                self.ends[number] = True
                try:
                    text = bytes(letters[c] for c in piece[:-4]).decode()
                except (KeyError, UnicodeDecodeError):
                    continue
                if PRE_TOKENS.fullmatch(text) and PLAIN.fullmatch(text) and self.library.encode(text, add_special_tokens=False).ids == [number]:
                    self.whole[text] = 1
        self.memo = dict(self.whole)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not PLAIN.fullmatch(text) or not unicodedata.is_normalized("NFC", text) or any(s in text for s in self.special):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        parts, memo = PRE_TOKENS.findall(text.lower()), self.memo
        rest = [p for p in set(parts) if p not in memo]
        if rest:
            if len(memo) > MEMO + len(self.whole):
                memo = self.memo = dict(self.whole)
                rest = [p for p in set(parts) if p not in memo]
            memo.update(zip(rest, self.merged(rest)))
        return sum(map(memo.__getitem__, parts))

    def merged(self, parts: list[str]) -> list[int]:
        """Tokens of each pre-token; set apart by blanks they are merged independently."""
        ids = self.library.encode(" ".join(parts), add_special_tokens=False).ids
        last = np.flatnonzero(self.ends[np.asarray(ids, np.int64)])
        if len(last) != len(parts):
            return [len(self.library.encode(p, add_special_tokens=False).ids) for p in parts]
        return np.diff(last, prepend=-1).tolist()


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text as column ``name`` (replaced if it exists).

    Null and empty texts have 0 tokens.  No shuffle; rows, repeated ones too, stay as they are.
    """
    path = vocabulary_path(vocabulary)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        count = counter(path).count
        return pd.Series([count(t) for t in texts], dtype="int64")
    return docs.withColumn(name, of(F.col(text_col)))


def query(docs: DataFrame, limit: int = 2048) -> DataFrame:
    """Token counts of every document, and which are over the limit."""
    counted = token_counts(docs.select("doc_id", "text"), "text")
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
