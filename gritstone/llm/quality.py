"""Quality classifier: a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, SPACE, drop, hash_words, save, slices, text_bytes

STATISTICS = (
    "word_length", "capitals", "digits", "symbols", "bars", "accents", "distinct_words", "repeated_next", "top_word", "distinct_lines", "line_words",
    "stops"
)

_KIND = {name: np.zeros(256, bool) for name in ("capitals", "digits", "symbols", "bars", "accents", "stops")}
_KIND["capitals"][65:91] = True
_KIND["digits"][48:58] = True
_KIND["symbols"][[ord(c) for c in "!#$%&*@^~+=<>{}[]\\/_"]] = True
_KIND["bars"][ord("|")] = True
_KIND["accents"][128:] = True
_KIND["stops"][[ord(c) for c in ".,;:?"]] = True


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of STATISTICS for each text, and its number of words: rates go through a shifted logarithm, sizes through log1p, so that each is nearer
    to a normal."""
    raw, bounds = text_bytes(texts)
    words, at = hash_words(texts)
    chars, n = np.diff(bounds).astype(float), np.diff(at).astype(float)
    out = np.zeros((len(texts), len(STATISTICS)))
    col = {name: k for k, name in enumerate(STATISTICS)}

    def log_rate(part, whole):
        return np.log((part + 0.002 * whole + 0.25) / (whole + 5))

    total = np.zeros(len(raw) + 1, np.int64)
    for name, table in _KIND.items():
        np.cumsum(table[raw], out=total[1:])
        out[:, col[name]] = log_rate(total[bounds[1:]] - total[bounds[:-1]], chars)
    np.cumsum(SPACE[LOWER[raw]], out=total[1:])
    blank = total[bounds[1:]] - total[bounds[:-1]]
    out[:, col["word_length"]] = np.log1p((chars - blank) / np.maximum(n, 1))
    ends = np.flatnonzero(raw == 10)
    line_at = np.searchsorted(ends, bounds)
    for d in range(len(texts)):
        w = words[at[d] : at[d + 1]]
        distinct = top = again = 0
        if len(w):
            s = np.sort(w)
            runs = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            distinct, top, again = len(runs) - 1, int(np.diff(runs).max()), int((w[1:] == w[:-1]).sum())
        cuts = [bounds[d], *(ends[line_at[d] : line_at[d + 1]] + 1), bounds[d + 1]]
        lines = {raw[a:b].tobytes().strip() for a, b in zip(cuts, cuts[1:], strict=False)} - {b""}
        out[d, col["distinct_words"]] = distinct
        out[d, col["top_word"]] = top
        out[d, col["repeated_next"]] = again
        out[d, col["distinct_lines"]] = len(lines)
        out[d, col["line_words"]] = len(cuts) - 1
    n1 = np.maximum(n, 1)
    lines = out[:, col["line_words"]].copy()
    out[:, col["line_words"]] = np.log1p(n / np.maximum(lines, 1))
    out[:, col["distinct_lines"]] = np.log((out[:, col["distinct_lines"]] + 1) / (lines + 1))
    out[:, col["distinct_words"]] = np.log((out[:, col["distinct_words"]] + 5) / (n1 + 5)) / np.log(n1 + 10)
    out[:, col["top_word"]] = log_rate(out[:, col["top_word"]], n)
    out[:, col["repeated_next"]] = log_rate(out[:, col["repeated_next"]], n)
    return out, n


@dataclass
class Discriminant:
    """Means, inverses of the Cholesky factors and logs of their determinants (made once, at fitting), and log weights of both classes; None of them
    where a class has too few labels.

    centre: the statistics of a few words say little, so they are drawn to it as if some words of that kind had been seen (see drawn()).
    """

    centre: np.ndarray | None = None
    mean: np.ndarray | None = None
    inverse: np.ndarray | None = None
    log_det: np.ndarray | None = None
    log_weight: np.ndarray | None = None

    @classmethod
    def fit(
        cls, centre: np.ndarray, count: np.ndarray, total: np.ndarray, outer: np.ndarray, shrink_to_pooled: float, shrink_to_diagonal: float
    ) -> Discriminant:
        """From each class's count, sums and sums of outer products: no row of data is needed again."""
        if count.min() < 2:
            return cls()
        mean = total / count[:, None]
        scatter = outer - count[:, None, None] * mean[:, :, None] * mean[:, None, :]
        pooled = scatter.sum(0) / count.sum()
        factor = []
        for k in range(2):
            cov = (1 - shrink_to_pooled) * scatter[k] / count[k] + shrink_to_pooled * pooled
            cov = (1 - shrink_to_diagonal) * cov + shrink_to_diagonal * np.diag(np.diag(cov))
            factor.append(np.linalg.cholesky(cov + 1e-6 * np.eye(len(cov))))
        inverse = np.stack([np.linalg.inv(f) for f in factor])
        return cls(centre, mean, inverse, np.array([np.log(np.diag(f)).sum() for f in factor]), np.log(count / count.sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; 0.5 where nothing could be learned."""
        if self.mean is None:
            return np.full(len(x), 0.5)
        logs = []
        for mean, inverse, log_det, weight in zip(self.mean, self.inverse, self.log_det, self.log_weight, strict=True):
            z = (x - mean) @ inverse.T
            logs.append(weight - 0.5 * (z * z).sum(1) - log_det)
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


#: Words of evidence as strong as the centre's pull.
PULL_WORDS = 30.0


def drawn(x: np.ndarray, words: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return centre + (x - centre) * (words / (words + PULL_WORDS))[:, None]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, words and statistics (an array of doubles) for every row of docs."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, words = statistics(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), lists], ["doc_id", "words", "statistics"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(make, "doc_id bigint, words double, statistics array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def _moments(rows: DataFrame, centre: np.ndarray | None) -> np.ndarray:
    """Count, sums and sums of outer products of both classes: each task sums its own rows, and only these sums reach the driver."""
    d = len(STATISTICS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = _matrix(batch.column("statistics")), batch.column("quality").to_numpy()
            if centre is not None:
                x = drawn(x, batch.column("words").to_numpy(), centre)
            for k in range(2):
                part = x[y == k]
                total[k] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
        keys = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total.ravel())], ["k", "v"])

    out = np.zeros(2 * (1 + d + d * d))
    for r in rows.mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out.reshape(2, -1)


def fit(stats: DataFrame, labels: DataFrame, shrink_to_pooled: float = 0.1, shrink_to_diagonal: float = 0.05) -> Discriminant:
    """labels: doc_id, quality 0 or 1; other values and null are left out. Every labelled row counts."""
    d = len(STATISTICS)
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = save(stats.join(known, "doc_id").select("words", "statistics", "quality"), "quality-labelled")
    first = _moments(rows, None)
    if first[:, 0].min() < 2:
        drop(rows)
        return Discriminant()
    centre = first[:, 1 : d + 1].sum(0) / first[:, 0].sum()
    total = _moments(rows, centre)
    drop(rows)
    return Discriminant.fit(centre, total[:, 0], total[:, 1 : d + 1], total[:, d + 1 :].reshape(2, d, d), shrink_to_pooled, shrink_to_diagonal)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 where score >= threshold), learned (whether there was a model) for every row of
    docs.

    Inputs of a score are the text's statistics alone. A null or empty text is scored as one without words, which is the
    centre's score. Repeated rows are scored one by one. A null doc_id is scored and never learned from. Without two labels of
    each class every score is 0.5. Columns of docs beyond doc_id and text are not looked at.
    """
    stats = save(with_statistics(docs), "quality")
    model = fit(stats, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("statistics"))
            p = model.score(x if model.mean is None else drawn(x, batch.column("words").to_numpy(), model.centre))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(np.full(len(p), model.mean is not None))],
                ["doc_id", "score", "predicted", "learned"]
            )

    return stats.mapInArrow(score, "doc_id bigint, score double, predicted int, learned boolean")


def without_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all columns, that score at least threshold; all of them where nothing could be learned. Texts are read twice and never
    shuffled."""
    stats = save(with_statistics(docs), "quality")
    model = fit(stats, labels)
    drop(stats)
    if model.mean is None:
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, words = statistics(batch.column("text"))
            yield batch.filter(pa.array(model.score(drawn(x, words, model.centre)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
