"""Toxicity severity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w.x - theta_k): one weight vector shared by all ordered thresholds.
x marks which words and word beginnings (4 to 6 letters, for inflected and compounded forms) a
text holds, of all those that tell toxic from clean rows by ``LEAST_Z`` standard errors. The expected severity is the sum
of P(grade > k) over the thresholds; a text is rejected if P(grade > 0) is at least 1/2.

The model is fitted on a bounded sample: at most ``SAMPLE`` labelled rows of each class, those
with the smallest hash of their id, weighted back to the class sizes of all labels. Copies
and near copies in the sample (same smallest shingle hash) count once, else a copied text's
chance words would pass for markers. Given only toxic 0 or 1, toxic rows are graded by how
many marking features they hold (``GRADE_STEPS``): severity then says how many markers a text
has, not what people think of it. Scoring reads every whole text.

Edge cases: null and blank texts hold no feature and score the base rate. Null labels are
left out; repeated labels of an id count once (the highest). Without toxic labels every
severity is 0 and nothing is rejected. Empty tables give empty results. Added columns
replace input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm.common import stage, words

SAMPLE = 3000
BEGINNINGS = (4, 5, 6)
#: Toxic rows with at least this many marking features have grade 1, 2.
GRADE_STEPS = (0, 6)
#: A marking feature stands in so many times more toxic than clean rows, and in this share of toxic rows.
MARK_LIFT, MARK_SHARE = 10.0, 0.005
#: Features need this many standard errors of log odds.
LEAST_Z = 3.0


def features(text: str | None) -> set[str]:
    """Distinct words of a text and their beginnings (marked by a star)."""
    held = set(b" ".join(words(text)).decode("utf-8", "replace").split(" ")) - {""}
    out = set(held)
    for k in BEGINNINGS:
        out.update([w[:k] + "*" for w in held if len(w) >= k])
    return out


def sketch(text: str | None) -> int:
    """Smallest hash of the three-word shingles: equal for most near copies."""
    parts = words(text)
    return min((xxhash.xxh64_intdigest(b" ".join(parts[k:k + 3])) >> 1 for k in range(max(1, len(parts) - 2))), default=0)


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]

    def probabilities(self, text: str | None) -> list[float]:
        """P(grade > k) for each threshold."""
        score = sum(self.weights[w] for w in self.weights.keys() & features(text))
        return [0.0 if t == float("inf") else 1 / (1 + float(np.exp(min(t - score, 700.0)))) for t in self.thresholds]


class Marks:
    """Sparse 0/1 matrix: the places (row, column) of its ones."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int]):
        self.rows, self.columns, self.shape = rows, columns, shape

    @property
    def T(self) -> Marks:
        return Marks(self.columns, self.rows, self.shape[::-1])

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=v[self.columns], minlength=self.shape[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_ordinal(x: np.ndarray | Marks, y: np.ndarray, sample_weight: np.ndarray, grades: int,
                l2: float = 2e-5, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the penalised likelihood.

    Thresholds stay ordered: the first is free, each further one adds exp of a parameter."""
    n, d = x.shape
    share = sample_weight / sample_weight.sum()
    above = np.array([max(share[y > k].sum(), 1e-6) for k in range(grades - 1)])
    theta0 = np.maximum.accumulate(-np.log(above / np.maximum(1 - above, 1e-6)) + 1e-3 * np.arange(grades - 1))
    p = np.concatenate([np.zeros(d), theta0[:1], np.log(np.maximum(np.diff(theta0), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        w, gaps = p[:d], np.exp(p[d + 1:])
        theta = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = _sigmoid((x @ w)[:, None] - theta)
        edge = np.hstack([np.ones((n, 1)), s, np.zeros((n, 1))])
        up, down = edge[rows, y], edge[rows, y + 1]
        prob = np.maximum(up - down, 1e-12)
        g_score = -share * (1 - up - down)
        slope = s * (1 - s)
        g_theta = np.zeros(grades - 1)
        for k in range(grades - 1):
            g_theta[k] = (share * slope[:, k] / prob * ((y == k + 1).astype(float) - (y == k))).sum()
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([x.T @ g_score + l2 * w, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1:]))])


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, seed: int):
    """(id, grade, features) of the sampled rows without copies, and the class sizes of all labels."""
    clean = labels.where(F.col("grade").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(
        F.max("grade").alias("grade"))
    sizes = {r[0]: r[1] for r in clean.groupBy("grade").count().collect()}  # one row per grade
    picked = None
    for grade in sorted(sizes):
        part = clean.where(F.col("grade") == grade).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return None, sizes
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(picked), "id")  # at most SAMPLE rows per grade

    @F.pandas_udf("struct<held:array<string>,sketch:bigint>")
    def held(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"held": [sorted(features(t)) for t in texts], "sketch": [sketch(t) for t in texts]})

    rows = marked.withColumn("f", held("text")).groupBy("grade", "f.sketch").agg(
        F.min_by(F.struct("id", "f.held"), F.struct("id", F.size("f.held"))).alias("r"))
    return rows.select("r.id", "grade", "r.held"), sizes


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", seed: int = 42) -> Model:
    """Fit on labelled rows. A label is 0 or a positive number; with no grade above 1, toxic
    rows are graded by ``GRADE_STEPS``."""
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("grade"))
    held, sizes = _sample(docs, labels, id_col, text_col, seed)
    if held is None or not any(g > 0 for g in sizes) or 0 not in sizes:
        return Model({}, [float("inf")])
    held = stage(held, "toxicity-sample")
    n = {r[0]: r[1] for r in held.groupBy(F.col("grade") > 0).count().collect()}
    n_toxic, n_clean = n.get(True, 0), n.get(False, 0)
    if not n_toxic or not n_clean:
        return Model({}, [float("inf")])
    each = held.select((F.col("grade") > 0).cast("int").alias("toxic"), F.explode("held").alias("word"))
    rate_t = (F.col("t") + 0.5) / (n_toxic + 1)
    rate_c = (F.col("c") + 0.5) / (n_clean + 1)
    odds = F.log(rate_t / (1 - rate_t)) - F.log(rate_c / (1 - rate_c))
    chosen = (each.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
              .withColumn("z", F.abs(odds) / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)))
              .where(F.col("z") >= LEAST_Z)
              .orderBy(F.desc("z"), "word").collect())  # words of the bounded sample
    place = {r["word"]: k for k, r in enumerate(chosen)}
    marks = {k for k, r in enumerate(chosen) if r["t"] >= MARK_SHARE * n_toxic
             and (r["t"] + 0.5) / (n_toxic + 1) >= MARK_LIFT * (r["c"] + 0.5) / (n_clean + 1)}

    @F.pandas_udf("array<int>")
    def places(words_held: pd.Series) -> pd.Series:
        return pd.Series([sorted(place[w] for w in held_by if w in place) for held_by in words_held])

    rows = held.select("id", "grade", places("held").alias("held")).orderBy("grade", "id").collect()
    y = np.array([r["grade"] for r in rows])
    weight = np.array([sizes[g] / max(1, int((y == g).sum())) for g in y])
    if y.max() <= 1:
        y = np.array([0 if g <= 0 else sum(len(marks.intersection(r["held"])) >= s for s in GRADE_STEPS)
                      for g, r in zip(y, rows)])
    values = sorted(set(y.tolist()))
    y = np.array([values.index(g) for g in y])
    x = Marks(np.repeat(np.arange(len(rows)), [len(r["held"]) for r in rows]),
              np.array([k for r in rows for k in r["held"]], dtype=np.int64), (len(rows), len(place)))
    w, theta = fit_ordinal(x, y, weight, len(values))
    return Model({word: float(w[k]) for word, k in place.items()}, theta.tolist())


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Input columns plus ``severity``, ``toxic_probability`` and ``rejected``."""

    @F.pandas_udf("struct<severity:double,toxic_probability:double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        p = [model.probabilities(t) for t in texts]
        return pd.DataFrame({"severity": [sum(x) for x in p], "toxic_probability": [x[0] for x in p]})

    name = "_toxicity"
    return (docs.withColumn(name, of(F.col(text_col)))
            .withColumn("severity", F.col(f"{name}.severity"))
            .withColumn("toxic_probability", F.col(f"{name}.toxic_probability"))
            .withColumn("rejected", F.col(f"{name}.toxic_probability") >= 0.5).drop(name))
