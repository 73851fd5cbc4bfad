"""Removal of repeated byte strings, by interval expansion on Burrows-Wheeler transforms.

Every string of the least length has an anchor: of the short grams in it the one
with the smallest hash.  Equal strings have equal anchors at equal places, so
texts are cut into segments, the strings that share one anchor, and only segments
with equal anchor grams can hold a common string.  Of segments that are equal as
wholes only the first is looked at further; those that differ go through the transform.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcat.llm.common import as_texts, bound_batches, bytes_of, free_shuffles, mixed, scratch, sent, slices, span_hashes, stored, tidied, tidied_group

LENGTH = 100  # bytes of the shortest repeat
GRAM = 32  # bytes of an anchor
STEP = 1 << 18  # starts that one numpy step looks at
BUCKET_BYTES = 16 << 20  # text whose anchors one group holds
TRANSFORM_BYTES = 1 << 19  # segments of one transform
# Anchors with more different segments, by a sample of the documents, are compared string
# by string through a shuffle of hashes.  Where the line lies changes no result.
HOT_SEGMENTS = 20_000
SAMPLE_RATE, SAMPLE_DOCS = 0.001, 2_000
_END = 0xFF  # between segments; no byte of UTF-8
_LAST = np.iinfo(np.int64).max


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of all texts: document, gram hash of the anchor, first and last start of a string."""
    width = length - GRAM + 1
    parts = []
    for base in range(0, max(len(data) - length + 1, 0), STEP):
        top = min(base + STEP, len(data) - length + 1)
        piece = data[base : top + length - 1]
        h = mixed(piece.astype(np.uint64) + np.uint64(1))
        size = 1
        while size < GRAM:
            h = h[:-size] * np.uint64(0x9FB21C651E98DF25) + h[size:]
            h ^= h >> np.uint64(31)
            size *= 2
        h = mixed(h)
        # Of equal grams the first counts: the place stands in the lower bits.
        low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.arange(base, top)
        doc = np.searchsorted(bounds, start, "right") - 1
        good = start + length <= bounds[doc + 1]
        place, start, doc = place[good], start[good], doc[good]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        parts.append((doc[first], h[place[first]], start[first], start[last], place[first] + base))
    if not parts:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    doc, gram, first, last, place = (np.concatenate(x) for x in zip(*parts))
    # A segment cut by a step is one again, as equal texts must be cut alike.
    new = np.ones(len(doc), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    keep = np.flatnonzero(new)
    return doc[keep], gram[keep], first[keep], last[np.append(keep[1:], len(doc)) - 1]


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document joined where they meet."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    far = end + doc * (1 << 40)
    reach = np.maximum.accumulate(far)
    new = np.ones(len(doc), bool)
    new[1:] = (start[1:] + doc[1:] * (1 << 40)) > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(end, first)


def _firsts(keys: list[np.ndarray], doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys and place; where a new key begins; what stands later than the first of its key."""
    order = np.lexsort((start, tie, doc, *reversed(keys)))
    new = np.ones(len(order), bool)
    same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys]) if len(order) > 1 else np.zeros(0, bool)
    new[1:] = ~same
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    d, t, s = doc[order], tie[order], start[order]
    # Rows that agree in id and text are one document.
    later = (d != d[head]) | (t != t[head]) | (s != s[head])
    return order, new, later


def repeats_by_transform(segments: list[bytes], rank: np.ndarray, length: int) -> np.ndarray:
    """For each start of each segment, in order, whether its string of ``length`` bytes also starts at a smaller rank.

    ``rank`` has one place for each such start, in order of the segments.
    All suffixes are sorted, each up to the end of its segment, so that the order says
    nothing of how long neighbours agree.  On their Burrows-Wheeler transform,
    intervals of strings are extended backward by one byte, breadth first: what
    ends at a border for the first time after n rounds has n bytes in common with
    its neighbour.  After ``length`` rounds the borders left have that much.
    """
    text = np.frombuffer(b"".join(s + bytes([_END]) for s in segments), np.uint8)
    n = len(text)
    padded = np.concatenate([text, np.full(8, _END, np.uint8)])
    stop = np.flatnonzero(text == _END)
    left = np.repeat(stop, np.diff(np.append(-1, stop))) - np.arange(n)  # bytes up to the end of the segment
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | np.where(k < left, padded[k : n + k], _END).astype(np.uint64)

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        new = np.zeros(n, np.int64)
        np.cumsum(key[order][1:] != key[order][:-1], out=new[1:])
        out = np.empty(n, np.int64)
        out[order] = new
        return out

    own, depth = ranked(key), 8
    while depth <= left.max() and own.max() < n - 1:
        ahead = np.append(own[depth:], np.zeros(min(depth, n), np.int64))[:n]
        own = ranked(own * (n + 1) + np.where(left > depth, ahead, n))  # the end is the largest byte
        depth *= 2
    # Suffixes that are equal to their end stand as their ends do.
    order = np.argsort(own, kind="stable")

    before = text[order - 1]  # of the first suffix the last byte, an end
    stable = np.argsort(before, kind="stable")
    step_to = np.empty(n, np.int64)
    step_to[stable] = np.arange(n)
    ends = before == _END
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    parent = np.empty(n, np.int64)
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(low):
            break
        size = high - low
        flat = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        parent[flat] = np.repeat(np.arange(len(low)), size)
        flat = flat[~ends[flat]]
        to = np.sort(step_to[flat])
        source = stable[to]
        if not len(to):
            break
        new = np.ones(len(to), bool)
        new[1:] = (to[1:] != to[:-1] + 1) | (parent[source[1:]] != parent[source[:-1]]) | (before[source[1:]] != before[source[:-1]])
        first = np.flatnonzero(new)
        low, high = to[first], to[np.append(first[1:], len(to)) - 1] + 1
        fresh = ~known[high]
        known[high[fresh]] = True
        low, high = low[fresh], high[fresh]

    sizes = np.array([len(s) for s in segments])
    count = sizes - length + 1
    begin = np.cumsum(sizes + 1) - sizes - 1
    starts = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(known[:-1])
    mine = group[starts]
    by = np.lexsort((rank, mine))
    out = np.zeros(len(starts), bool)
    out[by[1:]] = mine[by][1:] == mine[by][:-1]
    return out


def _spans_batch(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(tie.astype(np.int64)), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))], ["k", "t", "start", "end"])


# Of a segment: its document in the blob's list, start, strings less one, anchor, hash as a whole.
_BLOBS = {"doc": np.uint32, "start": np.int32, "more": np.uint16, "gram": np.uint32, "segment": np.uint64}


def _blob_row(bucket: int, hot: bool, keys: np.ndarray, ties: np.ndarray, doc: np.ndarray, **parts: np.ndarray) -> dict:
    """Segments of one bucket, by document; places as differences, which pack well."""
    ids, place = np.unique(doc, return_inverse=True)
    row = {"bucket": bucket, "hot": hot, "k": np.diff(keys[ids], prepend=np.int64(0)).tobytes(), "t": ties[ids].tobytes()}
    return row | {n: x.astype(_BLOBS[n]).tobytes() for n, x in {"doc": np.diff(place, prepend=0), **parts}.items()}


def _local(batch: pa.RecordBatch, length: int, buckets: int, hot: np.ndarray) -> Iterator[dict]:
    """Segments of a batch as blobs by bucket; spans that repeat within the batch."""
    keys, ties = batch.column("k").to_numpy(), batch.column("t").to_numpy()
    found, offset = [], 0
    for part, data, bounds in slices(batch):
        doc, gram, first, last = anchors(data, bounds, length)
        segment = span_hashes(data, first, last + length)
        base = bounds[doc]
        found.append((doc + offset, gram, segment, first - base, last - base))
        offset += part.num_rows
    doc, gram, segment, first, last = (np.concatenate(x) for x in zip(*found))
    order, new, later = _firsts([gram, segment], keys[doc], ties[doc], first)
    gone = order[later]
    d, s, e = _merged(doc[gone], first[gone], last[gone] + length)
    if len(d):
        row = {"bucket": int(keys[d[0]] % buckets), "hot": None, "k": keys[d].tobytes(), "t": ties[d].tobytes()}
        yield row | {"start": s.astype(np.int64).tobytes(), "gram": e.astype(np.int64).tobytes(), "doc": b"", "more": b"", "segment": b""}
    kept = np.sort(order[new])
    frequent = np.isin(gram[kept], hot)
    # Segments of frequent anchors are dealt out by themselves, others by their anchor.
    bucket = np.where(frequent, segment[kept], gram[kept]) % np.uint64(buckets)
    place = bucket.astype(np.int64) * 2 + frequent
    by = np.argsort(place, kind="stable")
    kept, place = kept[by], place[by]
    cuts = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(place)) if len(place) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:]):
        at = kept[a:b]
        yield _blob_row(int(place[a]) // 2, bool(place[a] % 2), keys, ties, doc[at], start=first[at], more=last[at] - first[at], gram=gram[at] >> np.uint64(32), segment=segment[at])


def frequent_anchors(docs: DataFrame, length: int, rate: float = SAMPLE_RATE, least: int = SAMPLE_DOCS) -> np.ndarray:
    """Hashes of the anchors with over about HOT_SEGMENTS different segments, counted in a share of the documents.

    They are at most one of HOT_SEGMENTS segments of the whole table.
    """
    rate = max(rate, least / max(docs.count(), 1))
    sample = docs.where(F.pmod(F.xxhash64(F.lit("anchors"), "k", "t"), F.lit(1 << 30)) < int(rate * (1 << 30))) if rate < 1 else docs

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds in slices(batch):
                _, gram, first, last = anchors(data, bounds, length)
                both = np.unique(np.stack([gram, span_hashes(data, first, last + length)]), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["gram", "segment"])

    found = sample.select("text").mapInArrow(tidied(grams), "gram long, segment long").distinct()
    often = found.groupBy("gram").count().where(F.col("count") > max(20, min(rate, 1) * HOT_SEGMENTS)).select("gram")
    return np.array([r["gram"] for r in often.collect()], np.int64).view(np.uint64)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """k, t, start, end: byte spans, not yet merged, that repeat something earlier.

    ``docs`` has k (the document's place in the order), t (tells documents of one place
    apart) and text.  See ``without_repeats`` for the rule.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-int(total) // BUCKET_BYTES))
    hot = spark.sparkContext.broadcast(frequent_anchors(docs, length))
    names = ("k", "t", *_BLOBS)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            rows = list(_local(batch, length, buckets, hot.value))
            columns = {"bucket": pa.array([r["bucket"] for r in rows], pa.int64()), "hot": pa.array([r["hot"] for r in rows], pa.bool_())}
            yield pa.RecordBatch.from_pydict(columns | {n: pa.array([r[n] for r in rows], pa.binary()) for n in names})

    blobs = docs.select("k", "t", "text").mapInArrow(tidied(local), "bucket long, hot boolean, " + ", ".join(f"{n} binary" for n in names))
    shape = "k long, t long, start long, end long"

    def segments_of(rows: list[dict]) -> list[np.ndarray]:
        out = []
        for r in rows:
            doc = np.cumsum(np.frombuffer(r["doc"], np.uint32).view(np.int32))
            k, t = np.cumsum(np.frombuffer(r["k"], np.int64))[doc], np.frombuffer(r["t"], np.int64)[doc]
            start, more = (np.frombuffer(r[n], _BLOBS[n]).astype(np.int64) for n in ("start", "more"))
            out.append((k, t, start, start + more + length, np.frombuffer(r["gram"], np.uint32), np.frombuffer(r["segment"], np.uint64)))
        return [np.concatenate(x) for x in zip(*out)]

    def compare(group: pa.Table) -> pa.Table:
        """Later copies of whole segments as spans; firsts of anchors with several segments as requests."""
        out = []
        bucket = group.column("bucket")[0].as_py()
        all_rows = group.to_pylist()
        for kind, frequent in ((1, False), (2, True)):
            rows = [r for r in all_rows if r["hot"] is frequent]
            if not rows:
                continue
            k, t, start, end, gram, segment = segments_of(rows)
            order, new, later = _firsts([gram, segment], k, t, start)
            gone, asked = order[later], order[new]
            if not frequent:
                _, inverse, count = np.unique(gram[asked], return_inverse=True, return_counts=True)
                asked = asked[count[inverse] > 1]
            both = np.concatenate([gone, asked])
            kinds = np.concatenate([np.zeros(len(gone), np.int32), np.full(len(asked), kind, np.int32)])
            # The bucket and half of an anchor's hash: anchors that agree in both are only compared for nothing.
            anchor = (np.int64(bucket) << np.int64(32)) | gram[both].astype(np.int64)
            out.append((k[both], t[both], start[both], end[both], anchor, kinds))
        for r in (r for r in all_rows if r["hot"] is None):
            spans = [np.frombuffer(r[n], np.int64) for n in ("k", "t", "start", "gram")]
            out.append((*spans, np.zeros(len(spans[0]), np.int64), np.zeros(len(spans[0]), np.int32)))
        return pa.table(dict(zip(("k", "t", "start", "end", "gram", "kind"), (np.concatenate(x) for x in zip(*out)))))

    compared = stored(blobs.groupBy("bucket").applyInArrow(tidied_group(compare), f"{shape}, gram long, kind int"), "compared")
    free_shuffles(spark)
    copies = compared.where("kind = 0").select("k", "t", "start", "end")

    wanted = compared.where("kind > 0").groupBy("k", "t").agg(F.collect_list(F.struct("start", "end", "gram", "kind")).alias("asked"))
    # Texts of which nothing is asked stay where they are.
    some = sent(compared.where("kind > 0").select("k").distinct())
    texts = docs.select("k", "t", "text").join(some, "k", "left_semi").join(wanted, ["k", "t"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = bytes_of(as_texts(batch.column("text")))
            lists = batch.column("asked")
            inner = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            start, end = inner.field("start").to_numpy(), inner.field("end").to_numpy()
            raw = data.tobytes()
            base = bounds[row]
            pieces = [raw[a:b] for a, b in zip((base + start).tolist(), (base + end).tolist())]
            for low in range(0, len(pieces), 50_000):
                cut = slice(low, low + 50_000)
                rows = pa.array(row[cut])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").take(rows), batch.column("t").take(rows), pa.array(start[cut]), inner.field("gram").slice(low, 50_000), inner.field("kind").slice(low, 50_000), pa.array(pieces[cut], pa.binary())],
                    ["k", "t", "start", "gram", "kind", "piece"],
                )

    pieces = stored(texts.mapInArrow(tidied(fetch), "k long, t long, start long, gram long, kind int, piece binary"), "segments")

    def transform(group: pa.Table) -> pa.Table:
        names = ("start", "t", "k", "gram")
        columns = [group.column(n).to_numpy() for n in names]
        order = np.lexsort(columns)
        # Rows that agree in id and text bring the same segment twice.
        new = np.append(True, np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns]))
        group = group.take(pa.array(order[new]))
        gram = group.column("gram").to_numpy()
        size = group.column("piece").combine_chunks().cast(pa.large_binary())
        size = np.diff(np.frombuffer(size.buffers()[1], np.int64, len(size) + 1, size.offset * 8)) + 1
        k, t, start = (group.column(n).to_numpy() for n in ("k", "t", "start"))
        heads = np.append(np.flatnonzero(np.append(True, gram[1:] != gram[:-1])), len(gram))
        sums = np.concatenate([[0], np.cumsum(size)])[heads]
        out, at = [], 0
        while at < len(heads) - 1:
            to = max(int(np.searchsorted(sums, sums[at] + TRANSFORM_BYTES, "right")) - 1, at + 1)
            a, b = heads[at], heads[to]
            count = size[a:b] - length
            owner = np.repeat(np.arange(a, b), count)
            place = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            rank = np.empty(len(owner), np.int64)
            rank[np.lexsort((place, t[owner], k[owner]))] = np.arange(len(owner))
            bad = repeats_by_transform(group.column("piece").slice(a, b - a).to_pylist(), rank, length)
            d, s, e = _merged(owner[bad], place[bad], place[bad] + length)
            out.append(_spans_batch(k[d], t[d], s, e))
            at = to
        return pa.Table.from_batches(out)

    bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets)).alias("bucket")
    cold = pieces.where("kind = 1").select("k", "t", "start", "gram", "piece", bucket)
    found = cold.groupBy("bucket").applyInArrow(tidied_group(transform), shape)

    # Very frequent anchors: each string by itself, by two hashes, reduced before the shuffle.
    strings = pieces.where("kind = 2").select("k", "t", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("piece") - length + 1), lambda i: F.substring("piece", i, F.lit(length)))).alias("i", "s"), "start")
    strings = strings.select("k", "t", (F.col("start") + F.col("i")).alias("start"), F.unhex(F.md5("s")).alias("key"))
    least = strings.groupBy("key").agg(F.min(F.struct("k", "t", "start")).alias("least"))
    frequent = strings.join(least, "key").where(F.struct("k", "t", "start") > F.col("least")).select("k", "t", "start", (F.col("start") + length).alias("end"))
    return copies.unionByName(found).unionByName(frequent)


def _cut(docs: DataFrame, length: int, extra: tuple[str, str, str, str]) -> DataFrame:
    """The documents with what is kept, bytes, bytes removed and spans, named by ``extra``."""
    spark, names = docs.sparkSession, docs.columns
    bound_batches(spark)
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("k"))
    with scratch(spark):
        # Only documents that share an id need more than it to be told apart.
        repeated = sent(rows.groupBy("k").count().where("count > 1").select("k", F.lit(True).alias("twice")), keep=True)
        keyed = rows.join(repeated, "k", "left").select("row", "k", F.when(F.col("twice"), F.xxhash64("row.text")).otherwise(0).cast("long").alias("t"))
        spans = repeated_spans(keyed.select("k", "t", "row.text"), length)
        spans = stored(spans.groupBy("k", "t").agg(F.collect_list(F.struct("start", "end")).alias("all")), "spans", keep=True)
    joined = keyed.join(spans, ["k", "t"], "left").select("row", "all")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{n}` {t}" for n, t in zip(extra, ("binary", "long", "long", "long")))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([*batch.column("row").flatten(), batch.column("all")], [*(f"c{i}" for i in range(len(names))), "all"])
            for part, data, bounds in slices(rows, f"c{names.index('text')}", limit=8 << 20):
                lists = part.column("all")
                inner = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy().astype(np.int64))
                d, s, e = _merged(row, inner.field("start").to_numpy(), inner.field("end").to_numpy())
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, bounds[d] + s, 1)
                np.add.at(edge, bounds[d] + e, -1)
                stays = np.cumsum(edge[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(stays)])[bounds]
                kept = data[stays].tobytes()
                pieces = [kept[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist())]
                size = np.diff(bounds)
                more = [pa.array(pieces, pa.binary()), pa.array(size), pa.array(size - np.diff(left)), pa.array(np.bincount(d, minlength=part.num_rows).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *more], [*names, *extra])

    return joined.mapInArrow(tidied(cut), schema)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All columns of the documents with kept (bytes), n_bytes, n_removed, n_spans.

    A byte goes if a string of ``length`` bytes that covers it also starts
    earlier: in a document with a smaller doc_id, or before in the same document.
    Strings are judged on the input, may overlap and never cross documents.
    Null texts are empty; doc_id is a whole number.  Rows that agree in doc_id and
    text are one document; other rows of one doc_id stand in an order of their
    texts' hashes; a null doc_id comes last.  Columns of these names are replaced.
    """
    extra = ("kept", "n_bytes", "n_removed", "n_spans")
    return _cut(docs.drop(*extra), length, extra)


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with what stays of their texts; what loses every byte goes.

    A cut through a character leaves no part of it; texts without a repeat, null
    ones included, stay as they are.
    """
    prefix = "cut_"
    while any(n.startswith(prefix) for n in docs.columns):
        prefix += "_"
    kept, size, removed, spans = extra = tuple(prefix + n for n in ("kept", "bytes", "removed", "spans"))
    cut = _cut(docs, length, extra)
    left = F.regexp_replace(F.make_valid_utf8(F.col(kept).cast("string")), "\ufffd", "")
    text = F.when(F.col(removed) > 0, left).otherwise(F.col("text"))
    return cut.where((F.col(removed) == 0) | (F.col(removed) < F.col(size))).withColumn("text", text).select(*docs.columns)
