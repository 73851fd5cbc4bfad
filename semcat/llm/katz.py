"""A Katz backoff bigram model over all training documents, kept in tables by bucket.

Texts become blocks of some thousand documents with a word list each.  A block
asks the unigram table for the counts of its words, then the bigram table for the
counts of its distinct pairs; tables are split by hash, answers come back by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcat.llm.common import mixed, remove_folders, slices, tidied, tidied_group, words_of
from semcat.session import work_dir

LARGEST = 5  # counts up to this are discounted
BLOCK_BYTES = 16 << 20  # text of one block
BUCKET_BYTES = 16 << 20  # text whose n-grams one bucket of a table holds
_END_WORD = np.uint64(0x5EED0FE17D0C5EED)
_BOS = np.int64(-1)


def _pack(array: np.ndarray) -> bytes:
    """Bytes of the array, plane by plane, compressed."""
    flat = np.ascontiguousarray(array)
    planes = flat.view(np.uint8).reshape(-1, flat.itemsize).T
    return len(flat).to_bytes(8, "little") + flat.dtype.str.encode().ljust(8) + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    n, kind = int.from_bytes(blob[:8], "little"), np.dtype(blob[8:16].decode().strip())
    planes = np.frombuffer(pa.decompress(blob[16:], n * kind.itemsize, "zstd", asbytes=True), np.uint8).reshape(kind.itemsize, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def discounts(kinds: np.ndarray) -> np.ndarray:
    """Katz's Good-Turing discounts of the counts 0 to LARGEST + 1, from the numbers of n-grams with each count.

    Where the numbers don't give one between 0 and 1, half a count is taken off.
    """
    out = np.ones(LARGEST + 2)
    spill = (LARGEST + 1) * kinds[LARGEST + 1] / kinds[1] if kinds[1] else 1.0
    for r in range(1, LARGEST + 1):
        good = kinds[r] > 0 and kinds[r + 1] > 0 and spill < 1
        value = ((r + 1) * kinds[r + 1] / kinds[r] / r - spill) / (1 - spill) if good else 0.0
        out[r] = value if 0 < value < 1 else 1 - 0.5 / r
    return out


class Unigrams:
    """Probability of a word from its count; the last mass is that of the unknown word."""

    def __init__(self, kinds: np.ndarray, total: int, distinct: int):
        self.total, self.distinct = int(total), int(distinct)
        self.discount = discounts(kinds)
        lost = sum(r * kinds[r] * (1 - self.discount[r]) for r in range(1, LARGEST + 1))
        # Without a small count nothing is lost; then half a count is kept for unknown words.
        self.scale = 1.0 if lost > 0 else total / (total + 0.5)
        self.unknown = lost / total if lost > 0 else 0.5 / (total + 0.5)

    def chance(self, count: np.ndarray) -> np.ndarray:
        seen = count * self.discount[np.minimum(count, LARGEST + 1)] / max(self.total, 1) * self.scale
        return np.where(count > 0, seen, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def backoff_weights(total: np.ndarray, kinds: np.ndarray, seen: np.ndarray, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale of the seen words and weight of the unseen ones, of contexts.

    ``kinds`` has the number of words with each count 1 to LARGEST, ``seen`` the
    sum of the unigram probabilities of seen words.  Seen and unseen words of a
    context together have probability 1.
    """
    counts = np.arange(1, LARGEST + 1)
    lost = (kinds * (counts * (1 - discount[1 : LARGEST + 1]))).sum(1)
    some = np.maximum(total, 1)
    scale = np.where(lost > 0, 1.0, some / (some + 0.5))
    left = np.where(lost > 0, lost / some, 0.5 / (some + 0.5))
    return scale, left / np.maximum(1 - seen, 1e-12)


class Block:
    """Words, documents and distinct pairs of a block, with the counts of its words."""

    def __init__(self, row: dict, answers: dict[int, tuple[np.ndarray, np.ndarray]], buckets: int, hot: float):
        self.ids, self.held = row["doc_ids"], _unpack(row["held"])
        self.length, token = _unpack(row["length"]), _unpack(row["token"])
        words = _unpack(row["words"])
        bucket = (words % np.uint64(buckets)).astype(np.int64)
        count, code = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for b, (rank, n) in answers.items():
            mine = bucket == b
            count[mine], code[mine] = n, rank.astype(np.int64) * buckets + b
        self.count = count[token]
        before = np.empty(len(token), np.int64)
        before[1:] = token[:-1]
        before[(np.cumsum(self.length) - self.length)[self.length > 0]] = _BOS
        before += 1
        before *= len(words) + 1
        before += token
        pair, self.of_token = np.unique(before, return_inverse=True)
        del before
        left, right = pair // (len(words) + 1) - 1, pair % (len(words) + 1)
        made = np.bincount(self.of_token[np.repeat(~self.held, self.length)], minlength=len(pair))
        context = np.where(left < 0, _BOS, code[left])
        # A very frequent context is split over all buckets by its pairs.
        self.hot = (left < 0) | (count[left] > hot)
        spread = np.where(self.hot, mixed((context * 0x1F123BB5 + code[right]).astype(np.uint64)), mixed(context.astype(np.uint64)))
        place = (spread % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((code[right], context, place))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.of_token = back[self.of_token]
        self.place, self.context, self.word = place[order], context[order], code[right][order]
        self.made, self.right_count, self.hot = made[order], count[right][order], self.hot[order]

    def bounds(self, buckets: int) -> np.ndarray:
        return np.searchsorted(self.place, np.arange(buckets + 1))


def _kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    folder = work_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def katz_scores(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, n_tokens, n_known, base_score, score of each row, and the number of training tokens.

    ``docs`` has doc_id, text and train (whether the row is learned from).  Tokens
    are words, lower-cased A-Z, and one end.  A pair that was seen has its
    discounted relative count; for others the word's own probability is taken
    times the context's backoff weight; all words unseen in training are one.
    Counts cover all training rows.  Null and empty texts have one token, the
    end; repeated rows count as often as they stand; without a training row every
    token is unknown.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.coalesce("train", F.lit(False)).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-int(size) // BUCKET_BYTES))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = 0
        for batch in batches:
            for part, data, bounds in slices(batch, limit=BLOCK_BYTES):
                word, doc = [], []
                for low in range(0, part.num_rows, 512):  # hashes in pieces that stay in the cache
                    high = min(low + 512, part.num_rows)
                    w, d = words_of(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
                    word.append(w)
                    doc.append(d + low)
                word, doc = np.concatenate(word), np.concatenate(doc)
                n = np.bincount(doc, minlength=part.num_rows)
                flat = np.full(len(word) + part.num_rows, _END_WORD, np.uint64)
                flat[np.arange(len(word)) + doc] = word
                words, token = np.unique(flat, return_inverse=True)
                held = ~part.column("train").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(TaskContext.get().partitionId() << 20) + serial]),
                        pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id").combine_chunks() if isinstance(part.column("doc_id"), pa.ChunkedArray) else part.column("doc_id")),
                        *(pa.array([_pack(x)], pa.binary()) for x in (held, (n + 1).astype(np.int32), token.astype(np.int32), words)),
                    ],
                    ["block", "doc_ids", "held", "length", "token", "words"],
                )
                serial += 1

    shape = f"block long, doc_ids array<{kind}>, held binary, length binary, token binary, words binary"
    table, block_folder = _kept(docs.mapInArrow(tidied(blocks), shape), "blocks")

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, token = _unpack(row["words"]), _unpack(row["token"])
                train = np.repeat(~_unpack(row["held"]), _unpack(row["length"]))
                count = np.bincount(token, train, len(words)).astype(np.int32)
                bucket = (words % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = [(b, order[cut[b] : cut[b + 1]]) for b in range(buckets) if cut[b] < cut[b + 1]]
                yield pa.RecordBatch.from_pydict(
                    {"bucket": [b for b, _ in rows], "block": [row["block"]] * len(rows), "key": [_pack(words[i]) for _, i in rows], "count": [_pack(count[i]) for _, i in rows]}
                )

    def count_words(group: pa.Table) -> pa.Table:
        """The bucket of the unigram table, its sums, and the answer to each block."""
        keys = [_unpack(b) for b in group.column("key").to_pylist()]
        counts = [_unpack(b) for b in group.column("count").to_pylist()]
        words, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), len(words)).astype(np.int64)
        kinds = np.bincount(np.minimum(total, LARGEST + 2), minlength=LARGEST + 3)
        bucket = group.column("bucket")[0].as_py()
        ends = np.cumsum([len(k) for k in keys])
        answers = [(_pack(at[e - len(k) : e].astype(np.int32)), _pack(total[at[e - len(k) : e]])) for k, e in zip(keys, ends)]
        first = [("table", -1, _pack(words), _pack(total)), ("sums", -1, _pack(np.append(kinds, [total.sum(), (total > 0).sum()])), b"")]
        rows = first + [("answer", block, *answer) for block, answer in zip(group.column("block").to_pylist(), answers)]
        return pa.table({"kind": [r[0] for r in rows], "block": pa.array([r[1] for r in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int64()), "one": pa.array([r[2] for r in rows], pa.binary()), "two": pa.array([r[3] for r in rows], pa.binary())})

    asked = table.select("block", "held", "length", "token", "words").mapInArrow(tidied(ask_words), "bucket long, block long, key binary, count binary")
    answer_shape = "kind string, block long, bucket long, one binary, two binary"
    unigrams, unigram_folder = _kept(asked.groupBy("bucket").applyInArrow(tidied_group(count_words), answer_shape), "unigrams")
    sums = np.sum([_unpack(r["one"]) for r in unigrams.where("kind = 'sums'").select("one").collect()] or [np.zeros(LARGEST + 5, np.int64)], axis=0)
    model = Unigrams(sums[: LARGEST + 2].astype(float), max(sums[-2], 1), sums[-1])
    # At most 4 contexts a bucket are that frequent.
    hot = max(sums[-2] / (4 * buckets), 1000)
    remove_folders(spark)

    def block_of(row: pa.Table, answers: pa.Table) -> Block:
        told = {r["bucket"]: (_unpack(r["one"]), _unpack(r["two"])) for r in answers.to_pylist() if r["kind"] == "answer"}
        return Block(row.to_pylist()[0], told, buckets, hot)

    def ask_pairs(row: pa.Table, answers: pa.Table) -> pa.Table:
        own = block_of(row, answers)
        cut = own.bounds(buckets)
        names = ("context", "word", "made", "right_count", "hot")
        parts = [(b, {n: _pack(getattr(own, n)[cut[b] : cut[b + 1]]) for n in names}) for b in range(buckets) if cut[b] < cut[b + 1]]
        columns = {n: pa.array([p[n] for _, p in parts], pa.binary()) for n in names}
        return pa.table({"bucket": pa.array([b for b, _ in parts], pa.int64()), "block": pa.array([row.column("block")[0].as_py()] * len(parts), pa.int64()), **columns})

    def count_pairs(group: pa.Table) -> pa.Table:
        """The bucket of the bigram table, its sums, its part of very frequent contexts, and the answers."""
        part = {n: [_unpack(b) for b in group.column(n).to_pylist()] for n in ("context", "word", "made", "right_count", "hot")}
        sizes = [len(x) for x in part["context"]]
        context, word, made, right, is_hot = (np.concatenate(part[n]) for n in ("context", "word", "made", "right_count", "hot"))
        order = np.lexsort((word, context))
        new = np.ones(len(order), bool)
        new[1:] = (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])
        first = np.flatnonzero(new)
        total = np.add.reduceat(made[order], first)
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        head = order[first]
        contexts, which = np.unique(context[head], return_inverse=True)
        seen = total > 0
        sums = np.zeros((len(contexts), LARGEST + 2))
        sums[:, 0] = np.bincount(which, total, len(contexts))
        for r in range(1, LARGEST + 1):
            sums[:, r] = np.bincount(which[total == r], minlength=len(contexts))
        sums[:, -1] = np.bincount(which[seen], model.chance(right[head])[seen], len(contexts))
        kinds = np.bincount(np.minimum(total, LARGEST + 2), minlength=LARGEST + 3)
        bucket = group.column("bucket")[0].as_py()
        rows = [("table", -1, _pack(np.stack([context[head], word[head]], 1)[seen].ravel()), _pack(total[seen])), ("sums", -1, _pack(kinds), b"")]
        split = np.unique(which[is_hot[head]])
        rows.append(("hot", -1, _pack(contexts[split]), _pack(sums[split].ravel())))
        ends = np.cumsum(sizes)
        for block, n, e, cold in zip(group.column("block").to_pylist(), sizes, ends, part["hot"]):
            mine, place = context[e - n : e], at[e - n : e]
            # One row for each context of the block that is whole here, in order.
            own = np.unique(mine[~cold])
            row = sums[np.searchsorted(contexts, own)]
            rows.append(("pairs", block, _pack(total[place].astype(np.int32)), _pack(row[:, :-1].astype(np.int32).ravel()) + b"|SPLIT|" + _pack(row[:, -1].astype(np.float64))))
        return pa.table({"kind": [r[0] for r in rows], "block": pa.array([r[1] for r in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int64()), "one": pa.array([r[2] for r in rows], pa.binary()), "two": pa.array([r[3] for r in rows], pa.binary())})

    told = unigrams.where("kind = 'answer'")
    pairs = table.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(tidied_group(ask_pairs), "bucket long, block long, context binary, word binary, made binary, right_count binary, hot binary")
    bigrams, bigram_folder = _kept(pairs.groupBy("bucket").applyInArrow(tidied_group(count_pairs), answer_shape), "bigrams")
    kinds = np.sum([_unpack(r["one"]) for r in bigrams.where("kind = 'sums'").select("one").collect()] or [np.zeros(LARGEST + 3, np.int64)], axis=0)
    discount = discounts(kinds[: LARGEST + 2].astype(float))

    def hot_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                contexts, sums = _unpack(row["one"]), _unpack(row["two"]).reshape(-1, LARGEST + 2)
                yield pa.RecordBatch.from_pydict({"context": pa.array(contexts), **{f"s{i}": pa.array(sums[:, i]) for i in range(LARGEST + 2)}})

    columns = [f"s{i}" for i in range(LARGEST + 2)]
    split = bigrams.where("kind = 'hot'").select("one", "two").mapInArrow(tidied(hot_parts), "context long, " + ", ".join(f"{c} double" for c in columns))
    frequent = {r["context"]: [r[c] for c in columns] for r in split.groupBy("context").agg(*(F.sum(c).alias(c) for c in columns)).collect()}
    hot_keys = np.array(sorted(frequent), np.int64)
    hot_sums = np.array([frequent[k] for k in hot_keys.tolist()]).reshape(-1, LARGEST + 2)
    shared = spark.sparkContext.broadcast((hot_keys, hot_sums))
    del pairs
    remove_folders(spark)

    def score(row: pa.Table, answers: pa.Table) -> pa.Table:
        own = block_of(row, answers)
        cut = own.bounds(buckets)
        hot_keys, hot_sums = shared.value
        chance = model.chance(own.right_count)
        # Bucket by bucket, so that the contexts' sums of one bucket are held at a time.
        for at in range(answers.num_rows):
            if answers.column("kind")[at].as_py() != "pairs":
                continue
            bucket = answers.column("bucket")[at].as_py()
            low, high = cut[bucket], cut[bucket + 1]
            made = _unpack(answers.column("one")[at].as_py())
            ints, _, floats = answers.column("two")[at].as_py().partition(b"|SPLIT|")
            context, is_hot = own.context[low:high], own.hot[low:high]
            sums = np.empty((high - low, LARGEST + 2))
            keys = np.unique(context[~is_hot])
            told = np.concatenate([_unpack(ints).reshape(-1, LARGEST + 1).astype(float), _unpack(floats)[:, None]], 1)
            sums[~is_hot] = told[np.searchsorted(keys, context[~is_hot])]
            if is_hot.any():
                sums[is_hot] = hot_sums[np.searchsorted(hot_keys, context[is_hot])]
            total = sums[:, 0]
            scale, weight = backoff_weights(total, sums[:, 1:-1], sums[:, -1], discount)
            seen = made * discount[np.minimum(made, LARGEST + 1)] / np.maximum(total, 1) * scale
            chance[low:high] = np.where(made > 0, seen, np.where(total > 0, weight, 1.0) * chance[low:high])
        doc = np.repeat(np.arange(len(own.length)), own.length)
        logs = np.log10(np.maximum(chance, 1e-300))[own.of_token]
        size = len(own.length)
        return pa.table(
            {
                "doc_id": row.column("doc_ids").combine_chunks().flatten(),
                "n_tokens": pa.array(own.length.astype(np.int64)),
                "n_known": pa.array(np.bincount(doc, own.count > 0, size).astype(np.int64)),
                "base_score": pa.array(np.bincount(doc, model.base(own.count), size)),
                "score": pa.array(np.bincount(doc, logs, size)),
            }
        )

    every = told.unionByName(bigrams.where("kind = 'pairs'"))
    out = table.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(tidied_group(score), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    scored, _ = _kept(out, "katz_scores")
    del out, every, told
    remove_folders(spark, block_folder)
    return scored, int(sums[-2])
