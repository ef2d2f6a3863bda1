"""Severity of toxic text by cumulative-link ordinal regression over sparse text features.

P(grade > k | x) = sigmoid(w.x - cut[k]) with one weight vector w for all thresholds; the expected
severity is the sum of these probabilities. Features are a document's words and their prefixes, as
1 + log(count). The model is fitted on a bounded sample of labelled rows and applied to every text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import arrow_map, saved, sliced, texts_of

#: The largest number of labelled rows that a model is fitted on; the sample is the rows of least id hash.
SAMPLE_ROWS = 8000
#: The largest number of features, and the least likelihood ratio (G) that a feature must have.
FEATURES, LEAST_G = 4096, 24.0
#: Lengths of the word prefixes that are features besides whole words.
PREFIXES = (4, 5, 6)
#: Grades: 0 for clean, then toxic by how much toxic vocabulary a text has.
GRADES = 3
#: Share of the sample that chooses the decision threshold and isn't fitted on.
HELD_OUT = 0.25
#: Words that a worker remembers the features of.
CACHE_ENTRIES = 400_000
_EDGE = ".,!?;:\"'()[]{}*$%&#|-_<>/\\"


def word_features(token: str) -> list[str]:
    """The features of one lower-case token: the word without marks at its edges, and its prefixes."""
    word = token.strip(_EDGE)
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) > n)] if word else []


@dataclass(frozen=True)
class Model:
    """Weights by feature, increasing cuts, and the expected severity from which a text counts as toxic."""

    weights: dict[str, float]
    cuts: tuple[float, ...]
    threshold: float

    def expected(self, z: np.ndarray) -> np.ndarray:
        return sum((_sigmoid(z - c) for c in self.cuts), np.zeros(len(z)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class _Finder(dict):
    """Of a raw token: the known features that it has, or None; remembered."""

    def __init__(self, known: dict[str, float]):
        self.known = known

    def __missing__(self, token: str):
        found = tuple(f for f in word_features(token) if f in self.known) or None
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(token) <= 64:
            self[token] = found
        return found

    def counts(self, text: str) -> Counter:
        out: Counter = Counter()
        for found in filter(None, map(self.__getitem__, text.lower().split())):
            out.update(found)
        return out


def _sample(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    chosen = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most SAMPLE_ROWS rows of two numbers
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return saved(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "sample")


def _vocabulary(sample: DataFrame, toxic: int, clean: int) -> list[tuple[str, float]]:
    """Features that speak for toxic texts by a likelihood-ratio test, at most FEATURES, with their log-odds. Those that speak for clean ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            kinds = batch.column(1).to_pylist()
            for text, kind in zip(texts_of(batch), kinds, strict=True):
                found = sorted({f for token in set(text.lower().split()) for f in word_features(token)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([kind] * len(found), pa.int32())], ["feature", "toxic"])

    rows = sample.select("text", F.col("toxic").cast("int")).mapInArrow(run, "feature string, toxic int")
    counted = rows.groupBy("feature").agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("b"))
    share = toxic / (toxic + clean)
    n = F.col("a") + F.col("b")
    g = 2 * (F.col("a") * F.log(F.col("a") / (n * share)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (n * (1 - share)))).otherwise(0.0))
    picked = counted.filter("a > 0").filter(F.col("a") > n * share).withColumn("g", g).filter(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "feature").limit(FEATURES).collect()
    odds = [np.log((r.a + 0.5) / (toxic + 1)) - np.log((r.b + 0.5) / (clean + 1)) for r in picked]
    return [(r.feature, float(o)) for r, o in zip(picked, odds, strict=True)]


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from labels (doc_id, toxic) of documents (doc_id, text).

    Labels without a document, and null labels, don't count; of several labels of one id the largest
    does, and of several documents of one id the least text, so the sample has at most `rows` rows; it is written once. Toxic rows are grade 1 or, from the median of their summed log-odds up, grade 2. With fewer
    than two toxic or two clean rows the model calls every text clean.
    """
    sample = _sample(documents, labels, rows)
    number = {r.t: r.n for r in sample.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = number.get(True, 0), number.get(False, 0)
    blank = Model({}, (50.0, 50.0), 1.0)
    if min(toxic, clean) < 2:
        return blank
    found = _vocabulary(sample, toxic, clean)
    if not found:
        return blank
    names, odds = [f for f, _ in found], np.array([o for _, o in found])
    place = {f: i for i, f in enumerate(names)}

    def run(batch: pa.RecordBatch) -> dict:
        finder = _Finder(place)
        counts = [finder.counts(x) for x in texts_of(batch)]
        return {"doc_id": batch.column(0), "toxic": batch.column(2), "at": [[place[f] for f in c] for c in counts], "n": [list(c.values()) for c in counts]}

    data = arrow_map(sample.select("doc_id", "text", F.col("toxic").cast("int")), run, "doc_id bigint, toxic int, at array<int>, n array<int>").collect()
    data.sort(key=lambda r: (r.doc_id, r.at))
    row = np.repeat(np.arange(len(data)), [len(r.at) for r in data])
    col = np.array([i for r in data for i in r.at], np.int64)
    val = 1 + np.log(np.array([i for r in data for i in r.n], np.float64))
    y = np.array([r.toxic > 0 for r in data]).astype(int)
    hits = np.bincount(row, odds[col] * val, len(data))
    y[(y > 0) & (hits >= np.median(hits[y > 0]))] = GRADES - 1
    held = (np.arange(len(data)) * 0.6180339887) % 1 < HELD_OUT  # spread evenly over the ids
    weights, cuts = ordinal_fit(row, col, val, np.where(held, -1, y), len(names))
    z = np.bincount(row, weights[col] * val, len(data))
    model = Model(dict(zip(names, map(float, weights), strict=True)), tuple(map(float, cuts)), 1.0)
    severity = model.expected(z)
    return Model(model.weights, model.cuts, _best_threshold(severity[held], y[held] > 0))


def _best_threshold(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The grid point of best F1 on held-out rows; of equal ones the middle."""
    grid = np.arange(0.1, 1.01, 0.05)
    score = [2 * (toxic & (severity >= t)).sum() / max(1, toxic.sum() + (severity >= t).sum()) for t in grid]
    best = np.flatnonzero(np.isclose(score, max(score)))
    return float(grid[best[len(best) // 2]])


def ordinal_fit(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, features: int, grades: int = GRADES, penalty: float = 5e-5, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and increasing cuts by Adam on the likelihood of the grades; rows with y < 0 are left out.

    The likelihood of grade k is sigmoid(z - cut[k-1]) - sigmoid(z - cut[k]). Cuts are the first one and
    positive gaps (exponentials), so they stay in order.
    """
    n, used = len(y), y >= 0
    theta = np.zeros(features + grades - 1)
    theta[features] = 2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, gaps = theta[:features], np.exp(theta[features + 1 :])
        cuts = theta[features] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(row, w[col] * val, n)
        s = _sigmoid(z[:, None] - cuts[None, :])
        upper = np.hstack([np.ones((n, 1)), s])  # P(grade >= k)
        lower = np.hstack([s, np.zeros((n, 1))])
        k = np.where(used, y, 0)
        at = np.arange(n)
        p = np.maximum(upper[at, k] - lower[at, k], 1e-12)
        du, dl = upper[at, k] * (1 - upper[at, k]) / p, lower[at, k] * (1 - lower[at, k]) / p
        du, dl = np.where(used, du, 0), np.where(used, dl, 0)
        count = used.sum()
        g = np.zeros_like(theta)
        g[:features] = -np.bincount(col, (du - dl)[row] * val, features) / count + penalty * w
        g_cut = np.array([(du[k == j + 1].sum() - dl[k == j].sum()) / count for j in range(grades - 1)])
        g[features] = g_cut.sum()
        g[features + 1 :] = [g_cut[j + 1 :].sum() * gaps[j] for j in range(grades - 2)]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:features], theta[features] + np.concatenate([[0], np.cumsum(np.exp(theta[features + 1 :]))])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of `documents` and severity double, grade int, toxic boolean of its text.

    grade is the severity rounded, half up. A null or empty text has severity as a text without known
    words and is never toxic. Columns of `documents` with these names are replaced; rows stay as they are.
    """
    kept = documents.drop("severity", "grade", "toxic")
    schema = [*kept.schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", severity double, grade int, toxic boolean"
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(model.weights)
        for batch in sliced(batches):
            severity, toxic = _judged(finder, model, batch.column(at))
            extra = [pa.array(severity, pa.float64()), pa.array(np.floor(severity + 0.5).astype(np.int32), pa.int32()), pa.array(toxic, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "severity", "grade", "toxic"])

    return kept.mapInArrow(run, ddl)


def _judged(finder: _Finder, model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Severity of texts, and whether they are toxic."""
    counts = [finder.counts(x or "") for x in texts.to_pylist()]
    z = np.array([sum(model.weights[f] * (1 + np.log(n)) for f, n in sorted(c.items())) for c in counts], np.float64)
    severity = np.round(model.expected(z), 6)
    return severity, (severity >= model.threshold) & np.array([bool(c) for c in counts], bool)


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of `documents` whose text isn't toxic, with all their columns as they are, whatever their names. Null and empty texts stay."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(model.weights)
        for batch in sliced(batches):
            yield batch.filter(pa.array(~_judged(finder, model, batch.column(at))[1]))

    numbered = documents.toDF(*(f"c{k}" for k in range(len(documents.columns))))
    return numbered.mapInArrow(run, numbered.schema).toDF(*documents.columns)
