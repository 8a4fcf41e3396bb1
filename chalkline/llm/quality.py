"""Document quality from a linear-chain conditional random field that labels every line good or bad.

Labels are known per document only. Fitting starts with the document's label on each of its lines, then twice lets the fitted chain relabel the
lines of bad documents (a good line may stand in a bad document; at least the worst line of each stays bad) and fits again. A document's
quality is the mean of the lines' marginals weighted by line length, brought to a probability by a one-variable logistic fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import rows_of, stage, text_of
from chalkline.llm.crf import Chain, fit, logit

SAMPLE_ROWS = 2000
SAMPLE_LINES = 2000
THRESHOLD = 0.3
KINDS = 6

_KIND = np.zeros(256, np.uint8)  # 0: letters beyond ASCII and the rest
_KIND[ord("a"):ord("z") + 1] = 1
_KIND[ord("A"):ord("Z") + 1] = 2
_KIND[ord("0"):ord("9") + 1] = 3
for _c in b"!#$%&*+<=>@\\^_`{|}~[]/":
    _KIND[_c] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 5
OWN = 16
NEAR = [1, 2, 5, 6, 7]  # features that a line also takes from the lines before and after it
FEATURES = OWN + 2 * len(NEAR) + 2


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths in characters) of the lines of `text` that have words."""
    lines = [s for s in text.split("\n") if s and not s.isspace()]
    n = len(lines)
    if not n:
        return np.zeros((0, FEATURES)), np.zeros(0)
    body = "\n".join(lines).encode("utf-8", "surrogatepass")
    kinds = _KIND[np.frombuffer(body, np.uint8)]
    ends = np.fromiter((len(s.encode("utf-8", "surrogatepass")) + 1 for s in lines), np.int64, n).cumsum()
    starts = np.concatenate(([0], ends[:-1]))
    count = np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in range(KINDS)], axis=1).astype(float)
    size = np.maximum(count.sum(axis=1), 1)
    x = np.zeros((n, FEATURES))
    x[:, 0] = 1
    x[:, 1] = count[:, 2] / np.maximum(count[:, 1] + count[:, 2], 1)
    x[:, 2] = count[:, 4] / size
    x[:, 3] = count[:, 3] / size
    x[:, 4] = count[:, 5] / size
    seen: set[str] = set()
    for i, s in enumerate(lines):
        words = s.split()
        m = len(words)
        distinct = len(set(words))
        x[i, 5] = 1 - distinct / m if m > 7 else 0
        x[i, 6] = sum(map(eq, words, words[1:])) / m
        x[i, 7] = words.count("|") / m
        x[i, 8] = m < 4
        x[i, 9] = min(m, 60) / 60
        x[i, 10] = min(len(s) / m, 20) / 20
        x[i, 11] = s.rstrip()[-1] in ".!?:;\"'"
        x[i, 12] = s in seen
        x[i, 13] = min(s.count(",") + s.count("."), m) / m
        seen.add(s)
    x[:, 14] = x[:, 2] > 0.1
    x[:, 15] = x[:, 1] > 0.6
    own = x[:, NEAR]
    x[1:, OWN:OWN + len(NEAR)] = own[:-1]
    x[:-1, OWN + len(NEAR):OWN + 2 * len(NEAR)] = own[1:]
    x[0, -2] = x[-1, -1] = 1
    return x, np.fromiter(map(len, lines), float, n)


@dataclass
class QualityModel:
    chain: Chain
    slope: float
    base: float

    def goodness(self, x: np.ndarray, size: np.ndarray) -> float:
        p = self.chain.marginals(self.chain.unary(x).tolist())
        return float(np.dot(p, size) / size.sum()) if len(size) else 0.0

    def score(self, text: str) -> float:
        """Probability of label 1. A text without words has no good line: the score at goodness 0."""
        v = self.base + self.slope * logit(self.goodness(*line_features(text)), 1e-3)
        return 1 / (1 + exp(-v))


def _logistic(g: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, base) of a one-variable logistic fit, slope at least 0, by Newton steps with a ridge."""
    a = np.stack([g, np.ones_like(g)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.eye(2)
        step = np.linalg.solve(h, a.T @ (p - y) + beta)
        beta -= step
        if abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def fit_model(pages: list[tuple[np.ndarray, np.ndarray, int]]) -> QualityModel:
    """Fit on (features, lengths, label) of documents with at least one line. Without both labels the score is the label's share."""
    pages = [p for p in pages if len(p[1])]
    labels = np.array([p[2] for p in pages], dtype=int)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return QualityModel(Chain(np.zeros(FEATURES), np.zeros((2, 2))), 0.0, logit(float(share)))
    x = np.concatenate([p[0] for p in pages])
    lengths = np.array([len(p[1]) for p in pages])
    y = np.repeat(labels, lengths)
    ends = np.cumsum(lengths)
    for turn in range(3):
        chain = fit(x, y, lengths)
        if turn < 2:
            for k in np.flatnonzero(labels == 0):
                at = slice(ends[k] - lengths[k], ends[k])
                unary = chain.unary(x[at])
                y[at] = chain.viterbi(unary.tolist())
                y[at.start + int(unary.argmin())] = 0
    model = QualityModel(chain, 1.0, 0.0)
    g = np.array([logit(model.goodness(p[0], p[1]), 1e-3) for p in pages])
    return QualityModel(chain, *_logistic(g, labels))


def is_held_out(id_col: str = "doc_id"):
    """Rows whose crc32(id as text) is divisible by 5; a null id counts as the empty text, which is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample_rows: int = SAMPLE_ROWS, sample_lines: int = SAMPLE_LINES) -> QualityModel:
    """Fit on at most `sample_rows` labelled documents of each label that are not held out, the first by a hash of the id, and of those on
    documents of at most `sample_lines` lines; only line features reach the driver. Ids with null or contradicting labels are left out."""
    known = labels.where(~is_held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("most"))
    known = known.where("label = most and label in (0, 1)").select("id", F.col("label").cast("int").alias("label"), F.xxhash64("id").alias("h"))
    parts = [known.where(F.col("label") == v).orderBy("h", "id").limit(sample_rows) for v in (0, 1)]
    sample = stage(parts[0].unionByName(parts[1]).select("id", "label"), "sample")  # at most 2 * sample_rows rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, text in rows_of(batches, "label", "body"):
            if text.count("\n") < sample_lines:
                x, size = line_features(text)
                if len(size):
                    yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([x.astype("<f4").tobytes()]), pa.array([size.astype("<f4").tobytes()])],
                                                     names=["label", "x", "size"])

    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    rows = source.join(F.broadcast(sample), "id").select("label", "body").mapInArrow(run, "label int, x binary, size binary").collect()
    pages = [(np.frombuffer(r.x, "<f4").reshape(-1, FEATURES).astype(float), np.frombuffer(r.size, "<f4").astype(float), r.label) for r in rows]
    pages.sort(key=lambda p: (p[2], len(p[1]), p[0].tobytes()))
    return fit_model(pages)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row's whole text; null texts count as empty, repeated rows are kept, no rows give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t[0]) for t in rows_of([batch], "body")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, score double")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text scores at least `threshold`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t[0] or "") for t in rows_of([batch], text_col)]
            yield batch.filter(pa.array([s >= threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
