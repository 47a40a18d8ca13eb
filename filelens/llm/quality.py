"""Quality classification by a regularised quadratic discriminant.

A document becomes a vector of transformed statistics. Each class has a mean
and a covariance, shrunk towards the pooled covariance and its diagonal; scores
are the difference of the two Gaussian log densities, from Mahalanobis distances
by Cholesky factors computed once, put through the logistic function.

All labelled rows are used: tasks return sums of products, which Spark adds up.
Results: null and empty texts are scored as texts of no words. Labels other than
0 and 1 and null labels teach nothing; repeated label rows count as often as
they occur, and so do rows with equal doc_id. With fewer than two rows of a class
the score is the class of more rows, 0 where they are equal; with no rows, 0.5.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.llm.common import materialize
from filelens.llm.common_arrow import map_texts

FEATURES = ("word_length", "upper", "digits", "stops", "marks", "symbols", "bars", "breaks", "distinct_words", "spaces")


@dataclass(frozen=True)
class QualityConfig:
    to_pooled: float = 0.3  # weight of the pooled covariance in a class's
    to_diagonal: float = 0.05  # then the weight of the diagonal
    floor: float = 1e-3  # added to every variance
    temper: float = 1.0  # divides the log-density difference
    threshold: float = 0.7


def _group(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[np.frombuffer(chars, dtype=np.uint8)] = 1
    return out


_KINDS = np.stack(
    [
        _group(bytes(range(65, 91))),
        _group(bytes(range(48, 58))),
        _group(b".,;:"),
        _group(b"!?"),
        _group(b"#$%&*+<=>@\\^_`{}~"),
        _group(b"|"),
        _group(b"\n\r"),
        _group(b" \t\x0b\x0c"),
    ]
)


def statistics(raw: bytes | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of FEATURES."""
    data = raw or b""
    n = max(1, len(data))
    upper, digits, stops, marks, symbols, bars, breaks, spaces = np.arcsin(np.sqrt(_KINDS @ np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) / n)).tolist()
    words = data.split()
    k = len(words)
    length = float(np.log1p(len(data) / max(1, k)))
    return [length, upper, digits, stops, marks, symbols, bars, breaks, len(set(words)) / max(1, k), spaces]


@dataclass(frozen=True)
class QualityModel:
    prior: float  # score where there is no density
    means: tuple | None = None
    factors: tuple | None = None  # inverses of the Cholesky factors
    offsets: tuple | None = None  # log prior minus half the log determinant
    temper: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        side = [o - 0.5 * np.square((x - m) @ f.T).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1.0 / (1.0 + np.exp(-np.clip((side[1] - side[0]) / self.temper, -700, 700)))


def quality_features(docs: DataFrame) -> DataFrame:
    """doc_id, features: one row a document."""

    def make():
        return lambda texts: {"features": [statistics(t) for t in texts]}

    return map_texts(docs, "text", ["doc_id"], "features array<double>", make)


def fit_quality(features: DataFrame, labels: DataFrame, cfg: QualityConfig | None = None) -> QualityModel:
    """Fit on every row of ``labels`` (doc_id, quality) that has features."""
    cfg, d = cfg or QualityConfig(), len(FEATURES)
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality")
    rows = features.join(known, "doc_id").select("quality", "features")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x = np.asarray(b.column("features").flatten()).reshape(-1, d)
            y = np.asarray(b.column("quality"))
            for c in (0, 1):
                z = x[y == c]
                total[c] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel())], names=["at", "value"])

    total = np.zeros(2 * (1 + d + d * d))
    for r in rows.mapInArrow(sums, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        total[r["at"]] = r["value"]
    total = total.reshape(2, -1)
    n = total[:, 0]
    if n.sum() == 0:
        return QualityModel(0.5)
    if n.min() < 2:
        return QualityModel(float(n[1] > n[0]))
    means = total[:, 1 : 1 + d] / n[:, None]
    scatter = total[:, 1 + d :].reshape(2, d, d) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    factors, offsets = [], []
    for c in (0, 1):
        cov = (1 - cfg.to_pooled) * scatter[c] / n[c] + cfg.to_pooled * pooled
        cov = (1 - cfg.to_diagonal) * cov + cfg.to_diagonal * np.diag(np.diag(cov)) + cfg.floor * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log(n[c] / n.sum()) - np.log(np.diag(lower)).sum()))
    return QualityModel(float(n[1] / n.sum()), tuple(means), tuple(factors), tuple(offsets), cfg.temper)


def learn_quality(docs: DataFrame, labels: DataFrame, cfg: QualityConfig | None = None) -> tuple[QualityModel, DataFrame]:
    """The model, and the table of features it was fitted on."""
    features = materialize(quality_features(docs), "quality-features")
    return fit_quality(features, labels, cfg), features


def score_features(features: DataFrame, model: QualityModel, cfg: QualityConfig | None = None) -> DataFrame:
    """doc_id, score, predicted from a table of features."""
    cfg, d = cfg or QualityConfig(), len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(np.asarray(b.column("features").flatten()).reshape(-1, d))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    kind = features.schema["doc_id"].dataType.simpleString()
    scored = features.select("doc_id", "features").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= cfg.threshold).cast("int"))


def score_documents(docs: DataFrame, model: QualityModel, keep: list[str], prefix: str = "") -> DataFrame:
    """The columns ``keep`` with the score of each text, named with ``prefix``."""

    def make():
        def score(texts: list[bytes | None]) -> dict[str, list]:
            x = np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))
            return {f"{prefix}score": model.score(x).tolist()}

        return score

    return map_texts(docs, "text", keep, f"{prefix}score double", make)
