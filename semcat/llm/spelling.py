"""Spelling variants: words one edit apart, by edit-matrix rows shared along a sorted vocabulary.

Words that differ by one edit agree before and after a window that holds the edit.
They meet in a list of all words that agree there; a list that is too long is cut into
two, one for each half of its window.  In a sorted list the words that share a prefix
stand side by side, between two places where adjacent words share less: the rows of the
edit matrix up to the end of the prefix are made once for the whole range, three
cells wide, and a range whose row holds nothing up to one edit is skipped as a whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semcat.llm.common import stored, tidied, tidied_group

LEAST_LETTERS = 5
LEAST_COUNT = 3
TYPO_RATE = 97  # of so many words of a document one loses a letter
LIST_WORDS = 4096  # of a list; beyond, it is cut by its window
BUCKET_ROWS = 60_000  # of the lists of one group
HELD_COUNTS = 400_000  # words that a task counts before it sends them on
STATES = 1 << 20  # rows of edit matrices held at once
_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LETTERS)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FAR = 3


def with_typo(doc_id: str, run: str, rate: int = TYPO_RATE) -> str:
    """The run, or, where its hash says so, the run without one letter."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % rate:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: runs of Latin letters of at least LEAST_LETTERS code points, A-Z lower-cased, after their typos.

    Null and empty texts have none; a null doc_id counts as empty.
    """

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                # A typo only shortens a run, so shorter ones never count.
                runs = Counter(_RUN.findall(text.as_buffer().to_pybytes().translate(_LOWER).decode()))
                head = zlib.crc32(f"{doc_id.as_py()}:".encode())
                for run, n in runs.items():
                    h = zlib.crc32(run.encode(), head)
                    if h % TYPO_RATE == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_LETTERS:
                            continue
                    counts[run] += n
                if len(counts) > HELD_COUNTS:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    texts = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return texts.mapInArrow(tidied(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _listed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, size, a, b) with the key of their list: the shorter word's size, the window, and what stands around it."""
    around = F.concat(F.substring("word", F.lit(1), F.col("a")), F.lit("|"), F.substring("word", F.length("word") - F.col("size") + F.col("b") + 1, F.length("word")))
    return rows.withColumn("key", F.concat_ws("|", F.col("size"), F.col("a"), F.col("b"), around))


def _halves(low: Column, middle: Column, high: Column) -> Column:
    return F.explode(F.array(F.struct(low.alias("a"), middle.alias("b")), F.struct(middle.alias("a"), high.alias("b"))))


def word_lists(words: DataFrame, most: int = LIST_WORDS) -> DataFrame:
    """word, n, size, a, b, key: every word in the lists where it can meet a word one edit away.

    A list holds words of ``size`` code points and those with one more.  None has over
    ``most`` words, but where its window is one letter wide.
    """
    length = F.length("word")
    sizes = words.where(length >= 2).select("word", "n", F.explode(F.array(length, length - 1)).alias("size"))
    half = F.floor(F.col("size") / 2).cast("int")
    open_rows = _listed(sizes.select("word", "n", "size", _halves(F.lit(0), half, F.col("size")).alias("w")).select("word", "n", "size", "w.a", "w.b"))
    done = None
    while True:
        open_rows = stored(open_rows, "word_lists")
        long = stored(open_rows.where("b - a > 1").groupBy("key").count().where(F.col("count") > most).select("key"), "long_lists")
        if long.isEmpty():
            return open_rows if done is None else done.unionByName(open_rows)
        short = open_rows.join(long, "key", "left_anti")
        done = short if done is None else done.unionByName(short)
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        cut = open_rows.join(long, "key", "left_semi").select("word", "n", "size", _halves(F.col("a"), middle, F.col("b")).alias("w"))
        open_rows = _listed(cut.select("word", "n", "size", "w.a", "w.b"))


def near_pairs(words: np.ndarray, group: np.ndarray, size: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of words one edit apart in the same group; each pair once.

    ``words`` (bytes, one a code point) ascend within ``group``, have ``size`` or
    ``size + 1`` letters and agree, within a group, in all but the window from a to b.
    Pairs whose edit, as far right as it can stand, is in another window are left to that.
    """
    n = len(words)
    none = np.zeros(0, np.int64)
    letters = np.zeros((n, size + 4), np.uint8)  # from the second column: what stands before a word differs from all
    letters[:, 1 : size + 2] = words.astype(f"S{size + 1}").view(np.uint8).reshape(n, size + 1)
    length = size + (letters[:, size + 1] != 0)
    same = letters[1:, 1 : size + 2] == letters[:-1, 1 : size + 2]
    common = np.full(n + 1, -1, np.int64)
    common[1:n] = np.where(same.all(1), size + 1, same.argmin(1))
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    common[heads] = -1
    ends = np.append(heads[1:], n)
    inside = np.repeat(np.arange(len(heads)), ends - heads)
    queries = np.flatnonzero((length == size) & ((ends - heads)[inside] > 1))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # Where rows of a chunk grow in number, later chunks are smaller.
    at, width = 0, 1 << 14
    while at < len(queries):
        q = queries[at : at + width]
        low, high = heads[inside[q]], ends[inside[q]]
        # All words of a list share the first a letters: their row is known.
        rows = np.empty((3, len(q)), np.int8)
        rows[:] = np.array([[1 if a else _FAR], [0], [1]])
        most = len(q)
        for depth in range(a, size + 2):
            over = length[low] == depth
            if depth >= size:
                cell = rows[1] if depth == size else rows[0]
                hit = over & (cell == 1) & ((low > q) if depth == size else True)
                found.append((q[hit], low[hit]))
            low = low + over
            open_ = low < high
            q, low, high, rows = q[open_], low[open_], high[open_], rows[:, open_]
            if not len(q) or depth > size:
                break
            # Ranges of words that share one letter more: cut where adjacent words share less.
            starts = np.flatnonzero(common <= depth)
            first = np.searchsorted(starts, low)
            count = np.searchsorted(starts, high) - first
            parent = np.repeat(np.arange(len(q)), count)
            child = np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(parent))
            q, low, high, rows = q[parent], starts[child], starts[child + 1], rows[:, parent]
            letter = letters[low, depth + 1]
            before = np.minimum(rows[0] + (letter != letters[q, depth]), rows[1] + 1)
            here = np.minimum(np.minimum(rows[1] + (letter != letters[q, depth + 1]), rows[2] + 1), before + 1)
            after = np.minimum(rows[2] + (letter != letters[q, min(depth + 2, size + 3)]), here + 1)
            rows = np.stack([before, here if depth < size else np.full_like(here, _FAR), after if depth < size - 1 else np.full_like(after, _FAR)]).astype(np.int8)
            near = rows.min(0) <= 1
            q, low, high, rows = q[near], low[near], high[near], rows[:, near]
            most = max(most, len(parent))
        at += width
        width = max(64, min(width * 2, 1 << 14, width * STATES // most))
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (none, none)
    gap = same_letters(letters[i, 1 : size + 2], letters[j, 1 : size + 2])
    own = (length[j] == size) | ((gap >= a) & ((gap < b) | ((gap == size) & (b == size))))
    return i[own], j[own]


def same_letters(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Letters that rows of x and y share at the front."""
    same = x == y
    return np.where(same.all(1), x.shape[1], same.argmin(1)) if x.shape[0] else np.zeros(0, np.int64)


def _nearest(group: pa.Table) -> pa.Table:
    """word, n_near, form_n, form of the words of a bucket of lists: near words and the most frequent of them."""
    words = np.array([w.encode("latin-1") for w in group.column("word").to_pylist()], object)
    counts = group.column("n").to_numpy()
    size, a, b = (group.column(c).to_numpy() for c in ("size", "a", "b"))
    key = group.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
    out = []
    order = np.lexsort((b, a, size))
    kind = np.flatnonzero(np.append(True, (np.diff(size[order]) != 0) | (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)))
    for start, end in zip(kind, np.append(kind[1:], len(order))):
        rows = order[start:end]
        if len(rows) < 2:
            continue
        s = int(size[rows[0]])
        text = words[rows].astype(f"S{s + 1}")
        by = np.lexsort((text, key[rows]))
        rows, text = rows[by], text[by]
        i, j = near_pairs(text, key[rows], s, int(a[rows[0]]), int(b[rows[0]]))
        if not len(i):
            continue
        one, two = np.concatenate([i, j]), np.concatenate([j, i])
        n = counts[rows]
        by = np.lexsort((text[two], -n[two], one))
        one, two = one[by], two[by]
        first = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
        out.append((rows[one[first]], np.diff(np.append(first, len(one))), rows[two[first]]))
    one, near, best = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    names = group.column("word").combine_chunks()
    return pa.table({"word": names.take(pa.array(one)), "n_near": near.astype(np.int64), "form_n": counts[best], "form": names.take(pa.array(best))})


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root: where following ``forms`` (word, form) ends.  A form is more frequent than its word, so it does end.

    Every round doubles the steps that a row has taken.
    """
    steps = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.drop("moved")
        steps = moved.drop("moved")


def spelling_forms(words: DataFrame, most: int = LIST_WORDS) -> DataFrame:
    """word, n, form, root, n_near, form_n of a vocabulary (word, n) of distinct words in Latin-1 letters.

    Two words are near if one letter inserted, deleted or replaced makes one the other.
    A word's form is its most frequent near word (ties: smallest by code point), if that
    is at least twice as frequent; ``root`` follows forms to the last.  Words of any
    length are compared whole; an empty vocabulary gives an empty table.
    """
    words = stored(words.select("word", "n"), "vocabulary")
    lists = word_lists(words, most)
    buckets = max(8, -(-lists.count() // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    found = lists.select(bucket, "word", "n", "size", "a", "b", "key").groupBy("bucket")
    partial = found.applyInArrow(tidied_group(_nearest), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best")
    near = partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    twice = -F.col("best.n") >= 2 * F.col("n")
    rated = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(twice, F.col("best.form")).alias("form"), F.when(twice, -F.col("best.n")).alias("form_n")), "forms")
    roots = last_forms(rated.where("form is not null"))
    return rated.join(roots, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """:func:`spelling_forms` of the words with at least LEAST_COUNT occurrences in all documents."""
    return spelling_forms(word_counts(docs).where(F.col("n") >= LEAST_COUNT))
