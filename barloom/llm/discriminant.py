"""Quality scores by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import documents, fresh, held_out, settle, with_columns

#: Weight of the pooled covariance in each class covariance, and of its diagonal in the pooled one.
POOLED = 0.2
DIAGONAL = 0.1
RIDGE = 1e-3
THRESHOLD = 0.7
FEATURES = 14
_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t\r\v\f",
    "line": b"\n",
    "stop": b".,;:?",
    "shout": b"!",
    "mark": b"#*$%&|<>{}[]\\^~_=+@",
}


def _masks() -> np.ndarray:
    out = np.zeros((256, len(_GROUPS)))
    for k, members in enumerate(_GROUPS.values()):
        out[list(members), k] = 1
    return out


_MASKS = _masks()


def features(text: str | None) -> list[float]:
    """Transformed statistics of one text: logarithms of sizes, square roots of shares. Defined for an empty text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    share = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _MASKS / n)
    words = text.split()
    m = max(1, len(words))
    same = sum(map(str.__eq__, words, words[1:]))
    lines = text.split("\n") if "\n" in text else [text]
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        np.log1p(len(raw) / m),
        np.sqrt(len(set(words)) / m),
        np.sqrt(same / m),
        np.sqrt(1 - len(set(lines)) / len(lines)),
        *share,
    ]


def featurise(docs: DataFrame, text: str, carry: list[str], name: str) -> DataFrame:
    made = [(name, "array<double>", pa.list_(pa.float64()))]
    return with_columns(docs, text, carry, made, lambda texts: [[features(t) for t in texts]])


class Discriminant:
    """Two Gaussians, each kept as mean, inverse Cholesky factor and log normaliser."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> None:
        """counts (2,), sums (2, p) and sums of outer products (2, p, p) by class."""
        self.share = float(counts[1] / counts.sum()) if counts.sum() else 0.5
        self.classes = []
        if counts.min() == 0:
            return
        means = sums / counts[:, None]
        own = [squares[k] / counts[k] - np.outer(means[k], means[k]) for k in (0, 1)]
        pooled = (counts[0] * own[0] + counts[1] * own[1]) / counts.sum()
        pooled = (1 - DIAGONAL) * pooled + DIAGONAL * np.diag(np.diag(pooled))
        for k in (0, 1):
            covariance = (1 - POOLED) * own[k] + POOLED * pooled + RIDGE * np.eye(len(pooled))
            factor = np.linalg.cholesky(covariance)
            constant = np.log(counts[k] / counts.sum()) - np.log(np.diag(factor)).sum()
            self.classes.append((means[k], np.linalg.inv(factor), constant))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 by row; the share of class 1 if a class was never seen."""
        if not self.classes:
            return np.full(len(x), self.share)
        low, high = (c - 0.5 * (((x - mean) @ factor.T) ** 2).sum(axis=1) for mean, factor, c in self.classes)
        return 1 / (1 + np.exp(np.clip(low - high, -500, 500)))


def fit(rows: DataFrame, name: str, label: str) -> Discriminant:
    """Class sums of features and of their products over all labelled rows, in one aggregation."""
    pairs = [(i, j) for i in range(FEATURES) for j in range(i + 1)]
    x = [F.col(name)[i] for i in range(FEATURES)]
    sums = [F.sum(v) for v in x] + [F.sum(x[i] * x[j]) for i, j in pairs]
    found = rows.filter(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*"), *sums).collect()
    counts, first, second = np.zeros(2), np.zeros((2, FEATURES)), np.zeros((2, FEATURES, FEATURES))
    for row in found:
        k = int(row[0])
        counts[k], first[k] = row[1], row[2 : 2 + FEATURES]
        for (i, j), v in zip(pairs, row[2 + FEATURES :], strict=True):
            second[k, i, j] = second[k, j, i] = v
    return Discriminant(counts, first, second)


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted) for each row; labels(id, quality) of ids that are not held out are learned from.

    A document labelled more than once counts as the rounded mean of its labels; null labels are ignored. Null texts are
    empty texts and are scored like any other. Without both labels the score is the share of label 1 (0.5 without any).
    An empty table gives an empty one. Only (id, 14 numbers) leave the text scan.
    """
    (x,) = fresh([doc_id, "quality"], "x")
    seen = settle(featurise(docs.select(doc_id, text), text, [doc_id], x))
    known = labels.groupBy(doc_id).agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    model = fit(seen.filter(~held_out(doc_id)).join(known, doc_id), x, "quality")
    spread = docs.sparkSession.sparkContext.broadcast(model)

    scored = with_columns(
        seen, x, [doc_id], [("score", "double", pa.float64())], lambda rows: [spread.value.score(np.array(rows).reshape(-1, FEATURES))]
    )
    return scored.select(
        doc_id, held_out(doc_id).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
