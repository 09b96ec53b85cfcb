"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

1. Statistics of the whole text (``statistics``): sizes, character classes, repetition of words and lines.
2. Standardised, they pass through cos(xW + b), random features whose inner products approximate a Gaussian kernel.
3. Each partition sums Z'Z and Z'y of its labelled rows; the sums are added and solved once (ridge).
4. Isotonic regression on labelled rows kept out of step 3 turns scores into probabilities.

The fit reads at most MAX_LABELLED labelled rows (those of smallest id hash), so what reaches the driver is bounded; the
scores cover every row. Null texts count as empty. Without labels of both kinds every score is the share of label 1, or
0.5. Labels that are null are left out; an id with several labels has their largest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.llm.common import clean_text, fold, stored, tidy
from kolumna.llm.models import calibrated, isotonic

FEATURES, GAMMA, RIDGE, SEED = 256, 0.03, 1.0, 17
#: Bound of the labelled rows that the model is fitted on.
MAX_LABELLED = 40_000
PARTS = 16
_SYMBOLS = np.frombuffer(b"#$%&*<>=@^_{}|~\\/+", np.uint8)
_NAMES = 22


def statistics(text: bytes) -> list[float]:
    """_NAMES numbers that describe a text."""
    size = max(len(text), 1)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = max(len(words), 1)
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if counts else 0
    upper, lower, digits = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum()
    letters = max(upper + lower, 1)
    p = hist[hist > 0] / size
    distinct_lines = len(set(lines))
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)),
        (size - hist[10] - hist[32]) / n, upper / letters, digits / size, hist[128:].sum() / size,
        hist[33] / n, hist[124] / n, hist[_SYMBOLS].sum() / size, hist[46] / n, hist[44] / n, hist[63] / n,
        hist[34] / size, (hist[40] + hist[41]) / size, hist[32] / size,
        len(counts) / n, top / n, sum(map(eq, words, words[1:])) / n,
        1 - distinct_lines / max(len(lines), 1), float(-(p * np.log2(p)).sum()), len(words) / max(len(lines), 1) ** 0.5 / 100,
    ]


def _matrix(column: pa.Array) -> np.ndarray:
    texts = column.to_pylist()
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), _NAMES)


class Features:
    """Standardise, then random Fourier features with an intercept."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(0, np.sqrt(2 * GAMMA), (len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.std, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ self.w + self.b), np.ones((len(x), 1))])


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "y", "part"]
        )


def _normal_equations(batches: Iterator[pa.RecordBatch], features: Features) -> Iterator[pa.RecordBatch]:
    a, b, n = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
    for batch in batches:
        x = np.array(batch.column(0).to_pylist(), np.float64).reshape(batch.num_rows, -1)
        if len(x):
            z, y = features(x), batch.column(1).to_numpy(zero_copy_only=False)
            a, b, n = a + z.T @ z, b + z.T @ y, n + len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], names=["a", "b"])


class Model:
    def __init__(self, features: Features | None, w: np.ndarray | None, knots: np.ndarray, values: np.ndarray):
        self.features, self.w, self.knots, self.values = features, w, knots, values

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None or not len(x):
            return np.full(len(x), self.values[0])
        return calibrated(self.features(x) @ self.w, self.knots, self.values)


def labelled_rows(
    docs: DataFrame, labels: DataFrame, label: str, held_out, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled ids that are not held out, those of smallest id hash."""
    own = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).where("id is not null and y in (0, 1)")
    own = own.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").cast("double").alias("y"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(limit)
    body = docs.select(F.col(id_col).alias("id"), clean_text(F.col(text_col)).alias("text"))
    return body.join(F.broadcast(own), "id")  # its size is bounded by limit


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, limit: int = MAX_LABELLED, text_col: str = "text") -> Model:
    """The model for labels.quality; rows with crc32(doc_id) mod folds = 0 are held out."""
    rows = labelled_rows(docs, labels, "quality", lambda c: fold(c, folds) == 0, limit, text_col=text_col)
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(PARTS)).cast("int")
    rows = rows.select(F.col("text").cast("binary"), "y", part.alias("part"))
    rows = stored(rows.mapInArrow(_with_features, "x array<double>, y double, part int"), "quality")
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"),
        *[f(F.col("x")[j]).alias(f"{k}{j}") for j in range(_NAMES) for k, f in (("m", F.avg), ("s", F.stddev_pop))],
    ).first()
    if not stats["n"] or stats["y"] in (0.0, 1.0):
        return Model(None, None, np.array([0.0]), np.array([0.5 if not stats["n"] else stats["y"]]))
    features = Features(*(np.array([stats[f"{k}{j}"] for j in range(_NAMES)]) for k in "ms"))
    # bounded: at most limit rows of _NAMES numbers, dealt to PARTS tasks that each send one pair of sums
    learn = rows.where(f"part % 4 <> 0").repartition(PARTS, "part")
    sums = learn.mapInArrow(lambda it: tidy(_normal_equations(it, features)), "a binary, b binary").collect()
    a = sum((np.frombuffer(r["a"]).reshape(FEATURES + 1, -1) for r in sums), np.zeros((FEATURES + 1, FEATURES + 1)))
    b = sum((np.frombuffer(r["b"]) for r in sums), np.zeros(FEATURES + 1))
    w = np.linalg.solve(a + RIDGE * np.eye(FEATURES + 1), b)
    rest = rows.where("part % 4 = 0").select("x", "y").toPandas()
    if not len(rest):
        return Model(features, w, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    raw = features(np.array(rest["x"].tolist())) @ w
    return Model(features, w, *isotonic(raw, rest["y"].to_numpy()))


def _score(batches: Iterator[pa.RecordBatch], model: Model, at: int) -> Iterator[pa.RecordBatch]:
    """The columns but the text at ``at``, then the score."""
    for batch in batches:
        score = model.score(_matrix(batch.column(at)))
        rest = [i for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in rest), pa.array(score, pa.float64())], names=[*(batch.schema.names[i] for i in rest), "score"]
        )


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), clean_text(F.col(text_col)).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: tidy(_score(it, model, 1)), f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1: score of at least ``least``) of every row."""
    return score(docs, fit(docs, labels, folds)).select(
        "doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )


def _good(batches: Iterator[pa.RecordBatch], model: Model, at: int, least: float) -> Iterator[pa.RecordBatch]:
    """The rows whose text, in column ``at``, scores at least ``least``."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            texts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in part.column(at).cast(pa.string()).to_pylist()]
            x = np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), _NAMES)
            yield part.filter(pa.array(model.score(x) >= least, pa.bool_()))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs without the rows that quality_scores() predicts as 0; columns and rows otherwise unchanged."""
    model = fit(docs, labels, folds, text_col=text_col)
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: tidy(_good(it, model, at, least)), docs.schema)
