"""Personal data by a skip-chain conditional random field over base patterns.

Patterns give base spans: e-mail and IP addresses, card and phone numbers.  The field then looks at every
word that holds a digit or an @ (others can only be ordinary).  Its variables are these words' kinds.  Chain
edges join neighbouring words; skip edges join words of a document, however far apart, that repeat
or resemble one another, each to its next occurrence.  Both carry potentials, and so do the word's shape and what
stands before it.  Words of base spans are observed; loopy message passing works out the marginals of the rest of each document,
and a run of words whose kind is all but certain becomes a further span, so the short or bare form of an
entity that is written out elsewhere is found too.

Weights are fitted by pseudo-likelihood on the base kinds of all documents.  Shapes and neighbouring kinds take
few values, so the whole corpus is a table of counted patterns, bounded by these values, and the fit
reads nothing else.  Shapes leave out what only the patterns ask for (a plus sign, valid check digits, parts up to 255).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]       # their order decides between spans that start together
NONE = 5                                       # "no neighbour", after the kinds and 0 for ordinary words
LABELS = 1 + len(KINDS)
CERTAIN = 0.95       # marginal from which a word counts as found
ROUNDS = 50          # of message passing at most; it ends when no message moves
STILL = 1e-6
DAMP = 0.3
RIDGE = 1.0          # pull of weights to 0, in words
NEWTON = 200
MIN_FORM = 5         # characters of a word's form from which repeats are joined

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
WORD = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
EDGES = "\"'`.,;:!?()[]{}<>|*#$%&=~_-/\\"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Looks from each @ to both sides: a name's characters hold no @, so each is read once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        else:
            end = at + 1
        at = text.find("@", end)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all base spans, by start and kind; code points, end exclusive."""
    if not text:
        return []
    out = [(s, 0, e) for s, e in emails(text)]
    if DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = "".join(DIGITS.findall(m.group()))
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(len, DIGITS.findall(m.group()))) <= 15]
    return sorted(out)


# the words of a batch of texts ----------------------------------------------------------------------

SIZES = [0, 1, 2, 3, 4, 5, 7, 8, 10, 12, 20]      # digit counts from which a shape's class begins
MARKS = ".-(:/,"                                  # marks whose presence is part of a shape
SHAPE_FEATURES = len(SIZES) + len(MARKS) + 1 + 2 + 5


def shape(word: str) -> tuple[int, ...]:
    """Numbers of the features that hold for a word."""
    digits, base = sum(c.isdigit() for c in word), len(SIZES)
    out = [int(np.searchsorted(SIZES, digits, "right")) - 1]
    out += [base + k for k, mark in enumerate(MARKS) if mark in word]
    base += len(MARKS)
    if "@" in word:
        out.append(base)
    base += 1
    out.append(base + any(c.isalpha() for c in word))
    base += 2
    out.append(base + min(4, word.count(".")))
    return tuple(out)


def forms(word: str) -> list[str]:
    """What makes a word resemble another: its letters and digits, and the last seven digits of a longer number."""
    digits = "".join(DIGITS.findall(word))
    bare = word.lower() if "@" in word else "".join(c for c in word.lower() if c.isalnum())
    out = [bare] if len(bare) >= MIN_FORM else []
    if len(digits) >= 7 and "@" not in word and not any(c.isalpha() for c in word):
        out.append("#" + digits[-7:])
    return out


class Words:
    """Candidate words of many texts, with base kinds and both sorts of edges."""

    def __init__(self, texts: list):
        self.base = [base_spans(t) for t in texts]
        self.text, self.start, self.end, self.kind, shapes, chain, last = [], [], [], [], [], [], {}
        skip: set[tuple[int, int]] = set()
        for k, t in enumerate(texts):
            if not t:
                continue
            spans, p, first = self.base[k], 0, len(self.start)
            found = [(m.start(), m.end()) for m in WORD.finditer(t)]
            last.clear()
            reach: list[tuple[int, int, int]] = []
            for n, (s, e) in enumerate(found):
                while p < len(spans) and spans[p][0] < e:
                    reach.append(spans[p])
                    p += 1
                reach = [r for r in reach if r[2] > s]
                left = n > 0 and found[n - 1][1] + 1 >= s
                raw = t[s:e]
                word = raw.strip(EDGES)
                cut = s + len(raw) - len(raw.lstrip(EDGES))
                i = first + n
                self.text.append(k)
                self.start.append(cut)
                self.end.append(cut + len(word))
                self.kind.append(min((1 + r[1] for r in reach), default=0))
                shapes.append(shape(raw))
                if left:
                    chain.append((i - 1, i))
                for form in forms(word):
                    if form in last:
                        skip.add((last[form], i))
                    last[form] = i
        self.kind = np.array(self.kind, np.int64)
        self.shapes = shapes
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.skip = np.array(sorted(skip), np.int64).reshape(-1, 2)

    def patterns(self) -> Counter:
        """How often each shape occurs with each kind of its own and of its neighbours (before, after, repeats).

        A word outside base spans that repeats one inside them is of unknown kind: it is not counted, nor as a neighbour.  A word with
        neighbours of both sorts counts three times, with all, without those beside it and without its repeats: patterns put
        spans where neighbours agree, so that words beside would explain all and leave repeats without weight."""
        n = len(self.kind)
        inside = self.kind[self.skip] > 0
        unknown = np.zeros(n, bool)
        for own, other in ((0, 1), (1, 0)):
            unknown[self.skip[inside[:, other], own]] = True
        unknown &= self.kind == 0
        known = np.where(unknown, NONE, self.kind)
        before, after = np.full(n, NONE), np.full(n, NONE)
        before[self.chain[:, 1]], after[self.chain[:, 0]] = known[self.chain[:, 0]], known[self.chain[:, 1]]
        repeats = np.full((n, 2), NONE)
        for own, other in ((0, 1), (1, 0)):
            repeats[self.skip[:, own], own] = known[self.skip[:, other]]
        out: Counter = Counter()
        for (shapes, b, a, one, two, kind), c in Counter(zip(self.shapes, before.tolist(), after.tolist(), repeats[:, 0].tolist(), repeats[:, 1].tolist(), known.tolist())).items():
            if kind != NONE:
                out[shapes, b, a, one, two, kind] += c
                if min(b, a) < NONE and min(one, two) < NONE:
                    out[shapes, NONE, NONE, one, two, kind] += c
                    out[shapes, b, a, NONE, NONE, kind] += c
        return out


# the fit --------------------------------------------------------------------------------------------

class Field:
    """Weights of shapes (feature x kind), of neighbours (left kind x right kind) and of repeats (symmetric)."""

    def __init__(self, shape_weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.shape, self.chain, self.skip = shape_weights, chain, skip

    def local(self, shapes: list) -> np.ndarray:
        known: dict = {}
        out = np.empty((len(shapes), LABELS))
        for i, s in enumerate(shapes):
            if s not in known:
                known[s] = self.shape[list(s)].sum(axis=0)
            out[i] = known[s]
        return out


def fit_field(patterns: list[tuple]) -> Field:
    """Largest pseudo-likelihood of counted patterns (shape, before, after, repeat, repeat, kind, count), with a quadratic penalty.

    Each word's kind is predicted from its shape and the kinds around it; steps follow the gradient scaled by its running
    size and are halved until the value no longer falls.  Weights of kinds that never occur stay 0.
    """
    size, m = SHAPE_FEATURES * LABELS, LABELS * LABELS
    weights = np.zeros(size + 2 * m)
    if not patterns:
        return Field(np.zeros((SHAPE_FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    x = np.zeros((len(patterns), SHAPE_FEATURES))
    for i, p in enumerate(patterns):
        x[i, list(p[0])] = 1
    before, after, one, two, kind = (np.array([p[k] for p in patterns], np.int64) for k in range(1, 6))
    count = np.array([p[6] for p in patterns], float)
    eye = np.vstack([np.eye(LABELS), np.zeros(LABELS)])             # the last row: no neighbour
    b, a, r, y = eye[before], eye[after], eye[one] + eye[two], eye[kind]

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        shapes, chain, skip = w[:size].reshape(-1, LABELS), w[size:size + m].reshape(LABELS, LABELS), w[size + m:].reshape(LABELS, LABELS)
        score = x @ shapes + b @ chain + a @ chain.T + r @ (skip + skip.T) / 2
        score = score - score.max(axis=1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=1, keepdims=True)
        loss = -(count * np.log(np.maximum((p * y).sum(axis=1), 1e-300))).sum() + RIDGE / 2 * (w * w).sum()
        off = (p - y) * count[:, None]
        pull = r.T @ off
        g = np.concatenate([(x.T @ off).ravel(), (b.T @ off + off.T @ a).ravel(), ((pull + pull.T) / 2).ravel()])
        return loss, g + RIDGE * w

    loss, g = value(weights)
    past: list[tuple[np.ndarray, np.ndarray]] = []                  # limited-memory quasi-Newton steps
    for _ in range(NEWTON):
        q, used = g.copy(), []
        for s, d in reversed(past):
            c = (s @ q) / (s @ d)
            q -= c * d
            used.append(c)
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.abs(g).max()))
        for (s, d), c in zip(past, reversed(used)):
            q += s * (c - (d @ q) / (s @ d))
        step, slope = 1.0, float(g @ q)
        if slope <= 0:
            q, slope, past = g.copy(), float(g @ g), []
        while True:
            new = weights - step * q
            new_loss, new_g = value(new)
            if new_loss <= loss - 1e-4 * step * slope or step < 1e-12:
                break
            step /= 2
        if step < 1e-12:
            break
        s, d = new - weights, new_g - g
        if s @ d > 1e-12 * np.sqrt((s @ s) * (d @ d)):
            past = [*past[-9:], (s, d)]
        done = abs(loss - new_loss) <= 1e-9 * max(1.0, abs(loss))
        weights, loss, g = new, new_loss, new_g
        if done:
            break
    skip = weights[size + m:].reshape(LABELS, LABELS)
    return Field(weights[:size].reshape(-1, LABELS), weights[size:size + m].reshape(LABELS, LABELS), (skip + skip.T) / 2)


PATTERN = "shape array<int>, before int, after int, one int, two int, kind int, n long"


def train(docs: DataFrame, text_col: str = "text") -> Field:
    """The field of all texts of ``docs``.  What is collected is bounded by the values of a pattern, not by the rows."""
    def of(batches):
        for batch in batches:
            found = Words([*batch["text"]]).patterns()
            yield pd.DataFrame([[list(k[0]), *k[1:], n] for k, n in found.items()], columns=["shape", "before", "after", "one", "two", "kind", "n"])
    parts = docs.select(F.col(text_col).alias("text")).where("text is not null").mapInPandas(of, PATTERN)
    keys = ["shape", "before", "after", "one", "two", "kind"]
    rows = parts.groupBy(*keys).agg(F.sum("n").alias("n")).orderBy(*keys).collect()
    return fit_field([(tuple(r["shape"]), r["before"], r["after"], r["one"], r["two"], r["kind"], r["n"]) for r in rows])


# message passing ------------------------------------------------------------------------------------

def marginals(words: Words, field: Field) -> np.ndarray:
    """Approximate marginals of every word's kind; words of base spans are fixed to theirs.

    All edges pass messages at once, damped, until none moves or ROUNDS are over.
    """
    n = len(words.kind)
    local = field.local(words.shapes)
    fixed = words.kind > 0
    local[fixed] = -1e6
    local[fixed, words.kind[fixed]] = 0
    edges = np.concatenate([words.chain, words.skip])
    if not len(edges):
        return softmax(local)
    weights = np.concatenate([np.broadcast_to(field.chain, (len(words.chain), LABELS, LABELS)), np.broadcast_to(field.skip, (len(words.skip), LABELS, LABELS))])
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    weights = np.concatenate([weights, weights.transpose(0, 2, 1)])          # from the source's kind to the target's
    back = np.concatenate([np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))])
    message = np.zeros((2 * len(edges), LABELS))
    belief = local
    for _ in range(ROUNDS):
        inner = belief[source] - message[back]
        new = logsumexp(inner[:, :, None] + weights)
        new -= logsumexp(new[:, :, None])
        moved = np.abs(new - message).max()
        message = DAMP * message + (1 - DAMP) * new if moved > STILL else new
        belief = local.copy()
        np.add.at(belief, target, message)
        if moved <= STILL:
            break
    return softmax(belief)


def logsumexp(x: np.ndarray) -> np.ndarray:
    """Over the second axis."""
    top = x.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]


def softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
    return p / p.sum(axis=1, keepdims=True)


def added_spans(words: Words, chance: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Spans the field adds to each text: runs of neighbouring free words of one certain kind that touch no base span."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in words.base]
    kind = chance.argmax(axis=1) if len(chance) else np.zeros(0, np.int64)
    kind = np.where((chance.max(axis=1, initial=0) >= CERTAIN) & (words.kind == 0), kind, 0)
    joined = {int(j) for i, j in words.chain if kind[i] and kind[i] == kind[j]}
    for i in np.flatnonzero(kind).tolist():
        if words.start[i] >= words.end[i]:
            continue
        mine = out[words.text[i]]
        if i in joined and mine and mine[-1][1] == kind[i] - 1:
            mine[-1] = (mine[-1][0], mine[-1][1], words.end[i])
        else:
            mine.append((words.start[i], int(kind[i]) - 1, words.end[i]))
    for k, spans in enumerate(out):
        if spans:
            held, p, free = words.base[k], 0, []
            ends = np.maximum.accumulate([s[2] for s in held]) if held else []
            for s in spans:                                        # by start; base spans that begin before its end must have ended before its start
                p = int(np.searchsorted([h[0] for h in held], s[2], "left")) if held else 0
                if not p or ends[p - 1] <= s[0]:
                    free.append(s)
            out[k] = free
    return out


def find(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): spans of every whole text as arrays of (kind, start, end), code points, end exclusive.

    ``field`` defaults to one trained on ``docs`` themselves.  Null and empty texts have no spans.  Rows that repeat an id, null ids
    included, are documents of their own; an empty table gives no rows; other columns are not read.
    """
    field = field or train(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(field)       # a fixed number of weights
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def rows(spans):
        return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

    def of(batches):
        for batch in batches:
            words = Words([*batch["text"]])
            more = added_spans(words, marginals(words, shared.value))
            yield pd.DataFrame({"id": batch["id"], "base": [rows(b) for b in words.base], "added": [rows(m) for m in more]})
    span = "array<struct<kind: string, start: long, end: long>>"
    return given.mapInPandas(of, f"id {given.schema['id'].dataType.simpleString()}, base {span}, added {span}")


def mask(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): the texts with every span, base or added, replaced by its kind in angle brackets; null stays null."""
    field = field or train(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def of(batches):
        for batch in batches:
            texts = [*batch["text"]]
            words = Words(texts)
            more, out = added_spans(words, marginals(words, shared.value)), []
            for t, b, m in zip(texts, words.base, more):
                parts, at = [], 0
                for s, k, e in sorted([*b, *m]):
                    if s >= at:
                        parts += [t[at:s], f"<{KINDS[k]}>"]
                    at = max(at, e)
                out.append(t if t is None else "".join([*parts, t[at:]]))
            yield pd.DataFrame({"id": batch["id"], "text": pd.Series(out, index=batch.index, dtype=object)})
    return given.mapInPandas(of, given.schema)


def query(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, base and added, of every document.

    The counts are those of the base spans, which the digest covers."""
    found = find(docs)
    order = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(F.col("id").alias("doc_id"), *[F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"))
