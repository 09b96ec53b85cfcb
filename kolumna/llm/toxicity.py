"""Toxicity: a subsequence string kernel with Nyström landmarks and a linear SVM, trained on labelled sentences.

Kernel: two tokens are compared by the letter triples that both contain in order, each step skipping at most two
characters (inserted letters, digits, punctuation); a triple that spans s characters counts DECAY**s, and the value is
normalised. So "id.iot" and "idxiot" stay close to "idiot". A sentence is compared with a landmark by its best token.

A word's beginning counts as a letter, so "idiotic" is nearer to "idiot" than "fabidiot" is.

Training, on at most MAX_LABELLED labelled rows: landmarks are the tokens most typical of toxic texts and the clean
tokens that resemble them most; sentences with a token near any landmark are projected on them (Nyström:
K^-1/2 k); the SVM learns the suspicious sentences of toxic texts against those of clean texts (``witnessed``). A first
isotonic regression turns a sentence's margin into log-odds, which are added up over a text; a second one, on rows kept
out, turns the sum into a probability.

Scoring reads whole texts; distinct tokens are compared once per task while they are remembered (a bounded memory).
Null and empty texts and texts without a near token get the score of such texts. Without labels of both kinds, or
without typical tokens, every score is the share of label 1, or 0. Rows are scored one by one, so ids may be null or
repeated; an id with several labels has their largest; a labelled id with several rows teaches by all of them. Other
columns, whatever their names, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.llm.common import clean_text, fold, stored
from kolumna.llm.models import calibrated, isotonic, linear_svm
from kolumna.llm.quality import labelled_rows

DECAY, STEP, LENGTH = 0.5, 3, 24
#: Tokens below this kernel value for every toxic landmark are far: the SVM never sees them, and a text with only such
#: tokens gets FAR_SCORE. A higher value is cheaper and loses insults with inserted characters.
NEAR = 0.45
#: Width and step of the windows of tokens over LENGTH; short ones, as a short landmark is not near in a wide window.
WINDOWS = ((LENGTH, 4), (LENGTH // 2, 4))
TOXIC_LANDMARKS, CLEAN_LANDMARKS, POWER, ROUNDS = 128, 96, 3, 4
#: Bounds of the fit alone: labelled rows; texts whose sentences the SVM sees, and the nearest sentences of each of them.
MAX_LABELLED, MAX_SENTENCES, WITNESSES = 20_000, 4_000, 8
#: Margins are counted in bins of 1 / PER_UNIT between -BINS and BINS; a sentence's log-odds stay within EVIDENCE.
PER_UNIT, BINS, EVIDENCE = 25, 4, (-0.3, 2.5)
REMEMBERED = 300_000
FAR_SCORE = -2.0
#: Stands before the first letter of a token, so that triples tell a word's beginning from its middle.
START = b"^"
_EDGE = b".,;:!?\"'()[]{}<>|*#%&$-_=+~/\\`^"
_CODE = np.zeros(256, np.int32)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:192] = 27 + np.arange(64) % 5  # letters beyond ASCII count by the last byte of their UTF-8 form
_CODE[START[0]] = 32
_BASE = 33
_SPACED = re.compile(rb"(?<![a-z])[a-z](?:[ .*_-]{1,3}[a-z]){3,}(?![a-z])")
_BETWEEN = re.compile(rb"[.!?\n|]+\s*(?=\s|$)|\n")
_AGAIN = re.compile(rb"(.)\1{2,}")


def bare(token: bytes) -> bytes:
    """A lower-case token without outer punctuation; letters written three times or more count twice."""
    return _AGAIN.sub(rb"\1\1", token.strip(_EDGE))


def windows(token: bytes) -> list[bytes]:
    """The token, or if it is over LENGTH, overlapping windows that cover all of it."""
    if len(token) <= LENGTH:
        return [token]
    return [token[i : i + w] for w, step in WINDOWS for i in range(0, len(token) - w + step, step)]


def triples(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (0: none) and weights of the gapped letter triples of each token, as rows."""
    width = min(LENGTH + 1, max(2 * STEP + 1, *map(len, tokens), 0))
    raw = np.frombuffer(b"".join(t[:width].ljust(width, b"\0") for t in tokens), np.uint8).reshape(len(tokens), width)
    c = _CODE[raw]
    codes, weights = [], []
    for a in range(1, STEP + 1):
        for b in range(1, STEP + 1):
            n = width - a - b
            x, y, z = c[:, :n], c[:, a : a + n], c[:, a + b :]
            codes.append((x * _BASE**2 + y * _BASE + z) * ((x > 0) & (y > 0) & (z > 0)))
            weights.append(np.full(n, DECAY ** (a + b + 1), np.float32))
    return np.hstack(codes), np.hstack(weights)


def _norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The length of each row's vector of triples; a triple that occurs again adds up."""
    row, at = np.nonzero(codes)
    triple, inverse = np.unique(row * _BASE**3 + codes[row, at], return_inverse=True)
    total = np.bincount(inverse, weights[at], len(triple))
    return np.maximum(np.sqrt(np.bincount(triple // _BASE**3, total**2, len(codes))), 1e-9)


def table_of(landmarks: list[bytes]) -> np.ndarray:
    """Normalised triple weights of each landmark: (triples, landmarks)."""
    out = np.zeros((_BASE**3, len(landmarks)), np.float32)
    codes, weights = triples(landmarks)
    for j, row in enumerate(codes):
        np.add.at(out[:, j], row[row > 0], weights[row > 0])
    return out / np.maximum(np.sqrt((out**2).sum(0)), 1e-9)


def _added(codes: np.ndarray, weights: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each row of triples, the weighted sum of their rows of the table."""
    out = np.zeros((len(codes), *table.shape[1:]), np.float32)
    for column, w in zip(codes.T, weights):
        out += w * table[column]
    return out


def kernel(tokens: list[bytes], table: np.ndarray) -> np.ndarray:
    """Normalised kernel of each token with each landmark, to the POWER (a product of kernels is one; near counts more)."""
    out = np.zeros((len(tokens), table.shape[1]))
    for lo in range(0, len(tokens), 256):
        codes, weights = triples(tokens[lo : lo + 256])
        out[lo : lo + 256] = _added(codes, weights, table) / _norms(codes, weights)[:, None]
    return out**POWER


def nearness(tokens: list[bytes], peaks: np.ndarray) -> np.ndarray:
    """An upper bound of a token's kernel with any landmark (peaks: the largest weights of each triple, by group)."""
    codes, weights = triples(tokens)
    length = np.maximum(np.sqrt((weights**2 * (codes > 0)).sum(1)), 1e-9)
    return (_added(codes, weights, peaks).max(1) / length).astype(np.float64)


def peaks_of(table: np.ndarray, landmarks: list[bytes], size: int = 8) -> np.ndarray:
    """The largest weight of each triple among landmarks that stand together in the alphabet, a column for each group."""
    order = sorted(range(len(landmarks)), key=landmarks.__getitem__)
    return np.stack([table[:, order[i : i + size]].max(1) for i in range(0, len(order), size)], 1)


class Matcher:
    """Finds the sentences of a text that hold a token near a toxic landmark, as kernel vectors.

    Landmarks that begin with START are compared with the beginnings of tokens too.
    """

    def __init__(self, landmarks: list[bytes], toxic: int):
        self.table = table_of(landmarks)
        self.peaks = peaks_of(self.table, landmarks[:toxic])
        self.peak = self.peaks.max(1, keepdims=True)
        self.toxic = toxic
        self.start = START if any(m.startswith(START) for m in landmarks) else b""
        self.seen: set[bytes] = set()
        self.near: dict[bytes, np.ndarray] = {}

    def learn(self, tokens: set[bytes]) -> None:
        """Remember the kernel vectors of those new tokens that are near."""
        new = tokens - self.seen
        self.seen |= new
        pieces = []
        for t in new:
            b = bare(t)
            if len(b) <= LENGTH:
                pieces.append((self.start + b, t))
            else:
                pieces += [((b"" if i else self.start) + p, t) for i, p in enumerate(windows(b))]
        pieces.sort(key=lambda x: len(x[0]))  # alike in width
        for lo in range(0, len(pieces), 4096):
            part = pieces[lo : lo + 4096]
            for bound in (self.peak, self.peaks):  # a cheap bound first
                part = [x for x, k in zip(part, nearness([p for p, _ in part], bound)) if k >= NEAR] if part else []
            if part:
                for (_, t), k in zip(part, kernel([p for p, _ in part], self.table)):
                    if k[: self.toxic].max() >= NEAR**POWER:
                        old = self.near.get(t)
                        self.near[t] = k if old is None else np.maximum(old, k)

    def of(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """sentences() of each text; the tokens of many texts are learnt together."""
        for lo in range(0, len(texts), 500):
            if len(self.seen) > REMEMBERED:
                self.seen.clear(), self.near.clear()
            part = [t.lower() for t in texts[lo : lo + 500]]
            own = [(set(t.split()), spelt(t)) for t in part]
            self.learn(set().union(*(a | b for a, b in own)))
            yield from (self._rows(t, a, b) for t, (a, b) in zip(part, own))

    def sentences(self, text: bytes) -> np.ndarray:
        """A row for each different sentence with a near token: the best kernel value of its tokens with each landmark."""
        return next(self.of([text]))

    def _rows(self, text: bytes, tokens: set[bytes], joined: set[bytes]) -> np.ndarray:
        near = {t for t in tokens | joined if t in self.near}
        alike = {frozenset((t,)) for t in joined & near}  # sentences with the same near tokens count once
        if near:
            alike |= {frozenset(near.intersection(sentence.split())) for sentence in _BETWEEN.split(text)}
        rows = [np.max([self.near[t] for t in own], 0) for own in sorted(alike, key=sorted) if own]
        return np.array(rows) if rows else np.empty((0, self.table.shape[1]))


def spelt(text: bytes) -> set[bytes]:
    """Words whose letters are written apart, joined."""
    return {re.sub(rb"[^a-z]", b"", s) for s in _SPACED.findall(text)}


class Model:
    """Landmarks, the weights of their kernel values, a sentence's log-odds by its margin, and the calibration of texts."""

    def __init__(self, landmarks=(), toxic=0, beta=None, bias=0.0, knots=(0.0,), values=(0.0,)):
        self.landmarks, self.toxic, self.beta, self.bias = list(landmarks), toxic, beta, bias
        self.odds = (np.array([0.0]), np.array([0.0]))
        self.knots, self.values = np.array(knots), np.array(values)

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """The SVM's margins of a text's sentences."""
        return rows @ self.beta + self.bias

    def raw(self, rows: np.ndarray) -> float:
        """A text's evidence: the log-odds of its sentences, each within bounds, added up."""
        return float(np.interp(self.margins(rows), *self.odds).sum()) if len(rows) else FAR_SCORE

    def score(self, raw: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(raw), self.values[0])
        return calibrated(raw, self.knots, self.values)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, ys = [], []
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = {START + b[:LENGTH] for b in map(bare, set(text.lower().split())) if b}  # landmarks: first windows
            words += own
            ys += [y] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(ys, pa.float64())], names=["token", "y"])


def _resembling(batches: Iterator[pa.RecordBatch], peaks: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column(0).to_pylist()
        near = np.concatenate([nearness(tokens[i : i + 4096], peaks) for i in range(0, len(tokens), 4096)] or [np.empty(0)])
        mask = pa.array(near >= NEAR, pa.bool_())
        yield pa.RecordBatch.from_arrays([*(c.filter(mask) for c in batch.columns), pa.array(near).filter(mask)], names=["token", "n", "near"])


def _vectors(batches: Iterator[pa.RecordBatch], landmarks: list[bytes], toxic: int) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(landmarks, toxic)
    for batch in batches:
        rows = []
        for k in matcher.of(batch.column(0).to_pylist()):
            k = k[np.argsort(-k[:, :toxic].max(1), kind="stable")[:WITNESSES]] if len(k) else k
            rows.append(k.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1), batch.column(2)], names=["rows", "y", "part"])


def fit(docs: DataFrame, labels: DataFrame, held_out, limit: int = MAX_LABELLED) -> Model:
    """The model for labels.toxic; held_out(id column) marks the rows that it must not learn from."""
    rows = labelled_rows(docs, labels, "toxic", held_out, limit)
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(4)).cast("int")
    rows = stored(rows.select(F.col("text").cast("binary").alias("text"), "y", part.alias("part")), "toxicity")
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return Model(values=(float(next(iter(n), 0.0)),))
    n1, n0 = n[1.0], n[0.0]
    seen = rows.select("text", "y").mapInArrow(_tokens, "token binary, y double").groupBy("token")
    seen = stored(seen.agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")), "tokens")
    odds = F.log((F.col("t") + 0.5) / (n1 + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (n0 + 1))
    typical = seen.where((F.col("t") >= max(3, 0.005 * n1)) & (odds > 2.5)).orderBy(F.desc(F.col("t") * odds), "token")
    toxic = [bytes(r["token"]) for r in typical.limit(TOXIC_LANDMARKS).collect()]
    if not toxic:
        return Model(values=(n1 / (n1 + n0),))
    peaks = peaks_of(table_of(toxic), toxic)
    like = seen.where((odds < 0.5) & (F.col("n") > 2)).select("token", "n")
    like = like.mapInArrow(lambda it: _resembling(it, peaks), "token binary, n long, near double")
    clean = like.orderBy(F.desc(F.col("near") * F.log1p("n")), "token").limit(CLEAN_LANDMARKS)
    landmarks = toxic + [bytes(r["token"]) for r in clean.collect()]
    gram = kernel(landmarks, table_of(landmarks))
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])  # k @ root: the Nyström features

    data = rows.mapInArrow(lambda it: _vectors(it, landmarks, len(toxic)), "rows binary, y double, part int")
    data = stored(data, "sentences")
    some = data.where("part <> 0 and octet_length(rows) > 0").orderBy(F.xxhash64("rows")).limit(MAX_SENTENCES).collect()
    texts = [(np.frombuffer(r["rows"], np.float32).reshape(-1, len(landmarks)).astype(float), r["y"]) for r in some]
    model = Model(landmarks, len(toxic), *witnessed(texts, root, len(toxic)))
    learn = rows.where("part <> 0").select("y", "text").mapInArrow(lambda it: _margins(it, model), "bin int, y double, n long")
    bins = learn.groupBy("bin", "y").agg(F.sum("n").alias("n")).toPandas()  # at most 2 * BINS rows
    model.odds = log_odds(bins["bin"].to_numpy() / PER_UNIT, bins["y"].to_numpy(), bins["n"].to_numpy(np.float64))
    rest = rows.where("part = 0").select("y", "text").mapInArrow(lambda it: _raw(it, model), "y double, raw double").toArrow()
    model.knots, model.values = isotonic(rest["raw"].to_numpy(), rest["y"].to_numpy())
    return model


def witnessed(texts: list[tuple[np.ndarray, float]], root: np.ndarray, toxic: int) -> tuple[np.ndarray, float]:
    """Weights of the kernel values and the bias: SVMs on sentences, of which those of toxic texts are chosen anew.

    Not every sentence of a toxic text is toxic: each round learns from its sentences that the round before puts on the
    toxic side (one at least), against the four most suspicious ones of each clean text.
    """
    beta, bias = np.r_[np.ones(toxic), np.zeros(len(root) - toxic)] / toxic, 0.0
    margin = lambda k: k[:, :toxic].max(1) - 0.75
    for _ in range(ROUNDS):
        x, y = [], []
        for k, is_toxic in texts:
            f = margin(k)
            best = np.argsort(-f, kind="stable")
            own = best[: max(1, int((f > 0).sum()))] if is_toxic else best[:4]
            x.append(k[own])
            y.append(np.full(len(own), 1.0 if is_toxic else -1.0))
        y = np.concatenate(y) if y else np.empty(0)
        if not len(y) or y.min() == y.max():
            break
        w, bias = linear_svm(np.concatenate(x) @ root, y, c=10.0, epochs=15)
        beta = root @ w
        margin = lambda k, beta=beta, bias=bias: k @ beta + bias
    return beta, bias


def log_odds(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By isotonic regression, the log-odds against the mean that a sentence of margin x is of a toxic text, as knots."""
    total = n.sum()
    if not total or not 0 < (n * y).sum() < total:
        return np.array([0.0]), np.array([0.0])
    knots, p = isotonic(x, y, n)
    p, mean = np.clip(p, 1e-3, 1 - 1e-3), (n * y).sum() / total
    return knots, np.clip(np.log(p / (1 - p)) - np.log(mean / (1 - mean)), *EVIDENCE)


def _margins(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """How many sentences have a margin within each bin, by the label of their texts."""
    matcher = _matcher(tuple(model.landmarks), model.toxic)
    for batch in batches:
        ys = batch.column(0).to_pylist()
        own = [(model.margins(k), y) for k, y in zip(matcher.of(batch.column(1).to_pylist()), ys) if len(k)]
        for label in set(ys):
            f = np.concatenate([np.empty(0), *(f for f, y in own if y == label)])
            bins, n = np.unique(np.rint(np.clip(f, -BINS, BINS) * PER_UNIT).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(np.full(len(bins), label)), pa.array(n.astype(np.int64))], names=["bin", "y", "n"])


@lru_cache(maxsize=1)
def _matcher(landmarks: tuple[bytes, ...], toxic: int) -> Matcher:
    """One for each worker process, so that tokens are remembered from task to task."""
    return Matcher(list(landmarks), toxic)


def _raw(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """The first column, and the evidence of the texts in the second."""
    matcher = _matcher(tuple(model.landmarks), model.toxic)
    for batch in batches:
        raw = [model.raw(k) for k in matcher.of(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.float64())], names=[batch.schema.names[0], "raw"])


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    matcher = _matcher(tuple(model.landmarks), model.toxic) if model.beta is not None else None
    for batch in batches:
        texts = batch.column(1).to_pylist()
        raw = np.array([model.raw(k) for k in matcher.of(texts)]) if matcher else np.zeros(len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(raw), pa.float64())], names=["doc_id", "score"])


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, rest: int = 1, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out (crc32(doc_id) mod folds = rest), score and predicted (1: at least ``least``) of every row."""
    model = fit(docs, labels, lambda c: fold(c, folds) == rest)
    rows = docs.select(F.col(id_col).alias("doc_id"), clean_text(F.col(text_col)).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(lambda it: _score(it, model), f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), folds) == rest).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )
