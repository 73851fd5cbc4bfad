"""What the operators share: word spans and hashes over Arrow texts, tables in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semcat.session import bound_batches, work_dir  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
# Bytes of text that one numpy step looks at; longer documents pass whole.
SLICE_BYTES = 2 << 20


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


_SCRATCH: list[list[str]] = []


def remove_folders(spark: SparkSession, *folders: str) -> None:
    """Removes tables of an operator that are read no more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    free_shuffles(spark)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end, but for those stored with ``keep``."""
    folders: list[str] = []
    _SCRATCH.append(folders)
    try:
        yield
    finally:
        _SCRATCH.remove(folders)
        remove_folders(spark, *folders)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The frame as a Parquet table in the shared folder.

    Later steps read it again after a lost executor; nothing is computed twice.
    """
    folder = work_dir(df.sparkSession, name)
    df.write.parquet(folder)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table.stored_in = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Removes stored tables before their operator ends: nothing reads them any more."""
    for table in tables:
        remove_folders(table.sparkSession, table.stored_in)


SEND_ROWS = 2_000_000  # ids that are sent whole to all executors; beyond, the join is shuffled


def sent(ids: DataFrame, keep: bool = False) -> DataFrame:
    """A table of ids, written once and marked for sending if it has at most SEND_ROWS rows."""
    table = stored(ids, "ids", keep)
    return F.broadcast(table) if table.limit(SEND_ROWS + 1).count() <= SEND_ROWS else table


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    while name in df.columns:
        name += "_"
    return name


def remainder(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def hashed_sample(df: DataFrame, bound: int, salt: str, total: int | None = None) -> DataFrame:
    """At most ``bound`` rows, those with the smallest hash of doc_id.

    All but about twice the bound are left out before the sort, so that no task
    sends more than its share.
    """
    total = df.count() if total is None else total
    place = F.xxhash64(F.lit(salt), F.col("doc_id").cast("string"))
    kept = df.where(F.pmod(place, F.lit(1 << 40)) < int((2 * bound + 100) / max(total, 1) * (1 << 40)))
    return kept.orderBy(F.pmod(place, F.lit(1 << 40)), *(c for c in df.columns if c == "text")).limit(bound)


def worker_cache() -> dict:
    """What a Python worker keeps from task to task.

    Functions travel to workers by value, without a module that could keep it; a
    cached function would travel by name, and workers need no installed copy.
    """
    return vars(sys).setdefault("_kept_by_worker", {})


def shipped(spark: SparkSession, value) -> Callable:
    """Sends a value of any class once to every worker; the function gives it there.

    A plain broadcast names classes and leaves it to the workers to know them.
    """
    sent_bytes, name = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex

    def get():
        kept = worker_cache()
        if kept.get("shipped", (None,))[0] != name:
            kept["shipped"] = name, cloudpickle.loads(sent_bytes.value)
        return kept["shipped"][1]

    return get


def _release_memory() -> None:
    """Gives freed memory back to the system: a worker outlives its tasks, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(task: Callable) -> Callable:
    """A function for mapInArrow that leaves no freed memory with its worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            _release_memory()

    return run


def tidied_group(task: Callable) -> Callable:
    """The same for applyInArrow, of one group or of two."""

    def one(group: pa.Table) -> pa.Table:
        try:
            return task(group)
        finally:
            _release_memory()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return task(left, right)
        finally:
            _release_memory()

    return two if task.__code__.co_argcount == 2 else one


def as_texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of large strings without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the bounds of each, from 0."""
    _, ends, data = texts.buffers()
    bounds = np.frombuffer(ends, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of about ``limit`` bytes of text: rows, bytes, bounds."""
    data, bounds = bytes_of(as_texts(batch.column(column)))
    low = 0
    while low < batch.num_rows:
        high = int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1
        high = min(max(high, low + 1), batch.num_rows)
        yield batch.slice(low, high - low), data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
        low = high


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, bounds: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run without a byte of ``apart``, white space if not given."""
    ink = ~apart[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    inner = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[inner] = ink[inner]
    outer = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    last[outer] = ink[outer]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(bounds, start, "right") - 1


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(value: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    value = value ^ (value >> np.uint64(32))
    value = value * np.uint64(0xD6E8FEB86659FD93)
    value = value ^ (value >> np.uint64(29))
    value = value * np.uint64(0xA0761D6478BD642F)
    return value ^ (value >> np.uint64(32))


_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    kept = worker_cache()
    if ("powers", bits) not in kept:
        kept["powers", bits] = _new_powers(bits)
    return kept["powers", bits]


def _new_powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    ones = np.full(1 << bits, _ODD), np.full(1 << bits, inverse)
    for array in ones:
        array[0] = 1
    return tuple(np.cumprod(array) for array in ones)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each span; spans are in order and don't overlap."""
    out = np.empty(len(start), np.uint64)
    low = 0
    while low < len(start):
        high = max(int(np.searchsorted(end, start[low] + step, "right")), low + 1)
        base, top = start[low], end[high - 1]
        power, inverse = _powers(max(18, int(top - base).bit_length()))
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum(_LETTERS[data[base:top]] * power[: top - base], out=sums[1:])
        s, e = start[low:high] - base, end[low:high] - base
        out[low:high] = (sums[e] - sums[s]) * inverse[s]
        low = high
    return mixed(out ^ (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, with A-Z lower-cased, and its document."""
    start, end, doc = word_spans(data, bounds)
    return span_hashes(lowered(data), start, end), doc


class HashIndex:
    """Places of 64-bit keys in an array of distinct keys: an open-addressing table, looked up in bulk."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        self.mask = (1 << max(4, int(2 * len(keys)).bit_length())) - 1
        self.table = np.full(self.mask + 1, -1, np.int64)
        left, step = np.arange(len(keys)), 0
        slot = self._slot(self.keys)
        while len(left):
            at = (slot[left] + step) & self.mask
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            left, step = left[self.table[at] != left], step + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        keys = keys.astype(np.uint64, copy=False)
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        slot, left, step = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            place = self.table[(slot[left] + step) & self.mask]
            hit = (place >= 0) & (self.keys[place] == keys[left])
            out[left[hit]] = place[hit]
            left, step = left[(place >= 0) & ~hit], step + 1
        return out
