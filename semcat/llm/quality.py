"""Quality by random Fourier features of document statistics, ridge regression and isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcat.llm.common import lowered, slices, span_hashes, stored, tidied, tidied_group, word_spans

FEATURES = 256  # cosines that approximate the kernel
RIDGE = 1.0
BINS = 1000  # of the raw score, for the calibration

_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".!?", "comma": b",;:",
    "quote": b"'\"()-", "other": b"#$%&*+/<=>@[\\]^_`{|}~", "wide": range(128, 256),
}
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_spread", "line_words", "log_longest", "distinct",
    "top_word", "repeated_lines", "short_words", "capitals", *_KINDS,
)


def _table(codes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


_TABLES = [_table(codes) for codes in _KINDS.values()]
_NEWLINE = _table(b"\n")


def _per_doc(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, n)


def _repeats(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document, and how often its most frequent one stands."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(d)))
    top = np.zeros(n)
    np.maximum.at(top, d[first], run)
    return np.bincount(d[first], minlength=n), top


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per document; all zeros for an empty one."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    start, end, doc = word_spans(data, bounds)
    length = (end - start).astype(float)
    words = np.bincount(doc, minlength=n)
    some = np.maximum(words, 1)
    mean = _per_doc(doc, length, n) / some
    spread = np.sqrt(np.maximum(_per_doc(doc, length**2, n) / some - mean**2, 0))
    distinct, top = _repeats(doc, span_hashes(lowered(data), start, end), n)
    l_start, l_end, l_doc = word_spans(data, bounds, _NEWLINE)
    lines = np.bincount(l_doc, minlength=n)
    l_distinct, _ = _repeats(l_doc, span_hashes(data, l_start, l_end), n)
    longest = np.zeros(n)
    np.maximum.at(longest, l_doc, (l_end - l_start).astype(float))
    capital = _TABLES[0][data[start]] if len(start) else np.zeros(0)
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(lines), mean, spread, np.log1p(words / np.maximum(lines, 1)), np.log1p(longest),
        distinct / some, top / some, (lines - l_distinct) / np.maximum(lines, 1), _per_doc(doc, length <= 3, n) / some,
        _per_doc(doc, capital, n) / some,
    ]
    for table in _TABLES:
        sums = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum(table[data], out=sums[1:])
        columns.append((sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(size, 1))
    return np.stack([np.asarray(c, float) for c in columns], 1)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics as one array, from whole texts; a null text is an empty one."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in slices(batch):
                rows = statistics(data, bounds)
                flat = pa.array(rows.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidied(measure), f"doc_id {kind}, stats array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    turn: np.ndarray  # statistics x FEATURES
    phase: np.ndarray
    weight: np.ndarray  # FEATURES + 1, the last for the constant
    knots: np.ndarray  # raw scores
    heights: np.ndarray  # calibrated at the knots

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.spread, -6, 6)
        waves = np.sqrt(2 / len(self.phase)) * np.cos(scaled @ self.turn + self.phase)
        return np.concatenate([waves, np.ones((len(stats), 1))], 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weight

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.heights)


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def isotonic(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Means that never fall, nearest to total / weight (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for w, t in zip(weight, total):
        blocks.append([w, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    return np.concatenate([np.full(n, t / w) for w, t, n in blocks]) if blocks else np.zeros(0)


def fit_quality(labelled: DataFrame, seed: int = 5) -> QualityModel | None:
    """A model from doc_id, stats, label (0 or 1) over all labelled rows.

    Three quarters of the rows, by a hash of the id, give the normal equations,
    summed in each partition and then by row of the matrix; the rest calibrate.
    The driver receives one matrix of FEATURES + 1 rows and BINS counts.
    None if there are no rows.
    """
    table = stored(labelled.where("label is not null and stats is not null").withColumn("part", F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(4))), "labelled_stats")
    size = len(STATISTICS)
    moments = table.agg(F.count("*").alias("n"), *(f(F.col("stats")[i] if p == 1 else F.col("stats")[i] * F.col("stats")[i]).alias(f"m{p}_{i}") for p, f in ((1, F.avg), (2, F.avg)) for i in range(size))).first()
    if not moments["n"]:
        return None
    mean = np.array([moments[f"m1_{i}"] for i in range(size)])
    spread = np.sqrt(np.maximum(np.array([moments[f"m2_{i}"] for i in range(size)]) - mean**2, 1e-12))
    spread[spread < 1e-5] = 1.0
    rng = np.random.default_rng(seed)
    turn = rng.normal(0, 1 / np.sqrt(size), (size, FEATURES))
    model = QualityModel(mean, spread, turn, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = model.cosines(_stats(batch))
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            total += z.T @ np.concatenate([z, y[:, None]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(list(total))], ["row", "sums"])

    def summed(group: pa.Table) -> pa.Table:
        rows = np.stack(group.column("sums").to_pylist())
        return pa.table({"row": group.column("row").slice(0, 1), "sums": pa.array([rows.sum(0)])})

    fitted = table.where("part != 0") if table.where("part != 0").limit(1).count() else table
    shape = "row long, sums array<double>"
    rows = fitted.select("stats", "label").mapInArrow(tidied(equations), shape).groupBy("row").applyInArrow(tidied_group(summed), shape).collect()
    system = np.stack([r["sums"] for r in sorted(rows, key=lambda r: r["row"])])
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-6
    model.weight = np.linalg.solve(system[:, :-1] + penalty, system[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(model.raw(_stats(batch)), -1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.round((raw + 1) / 3 * BINS).astype(np.int64)), batch.column("label").cast(pa.float64())], ["bin", "label"])

    aside = table.where("part = 0") if table.where("part = 0").limit(1).count() else table
    bins = aside.select("stats", "label").mapInArrow(tidied(binned), "bin long, label double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("y")).orderBy("bin").collect()
    n, y = np.array([b["n"] for b in bins], float), np.array([b["y"] for b in bins], float)
    model.knots = np.array([b["bin"] for b in bins]) / BINS * 3 - 1
    heights = isotonic(n, y)
    # A slight slope keeps the order of the raw scores within a level.
    model.heights = np.clip(0.98 * heights + 0.02 * (model.knots + 1) / 3, 0, 1)
    return model


def score_quality(stats: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id and quality (0 to 1) of each row of statistics; without a model every score is 0.

    Empty and null texts have statistics of zeros and are scored like others.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = model.score(_stats(batch)) if model is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value)], ["doc_id", "quality"])

    return stats.mapInArrow(tidied(score), f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, quality double")
