"""Near copies among embeddings by randomised-rotation binary codes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcat.llm.common import stored, tidied, tidied_group
from semcat.llm.graph import components

THRESHOLD = 0.98
RECALL = 0.98  # that two vectors just at the threshold share a key
SURENESS = 4.0  # standard errors of an estimate that its bound allows for
BLOCK = 2048  # vectors of one key that are compared in one piece
GROUP_ROWS = 20_000  # rows of one group of keys, on average
SEED = 17


def plan_keys(largest: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits of a key and number of keys: longer keys for larger labels, as many as reach RECALL at the threshold."""
    bits = max(6, math.ceil(math.log2(max(largest, 2))) - 2)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(2, math.ceil(math.log(1 - RECALL) / math.log(1 - same)))


def rotations(size: int, turns: int) -> np.ndarray:
    """Random orthonormal matrices, side by side: size x (size * turns)."""
    rng = np.random.default_rng((SEED, size))
    return np.concatenate([np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(turns)], 1)


def turns_for(size: int, bits: int, tables: int) -> int:
    """Rotations that give enough bits for all keys."""
    return max(1, -(-bits * tables // size))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits of the turned unit vectors; of the first rotation the code's inner product with its vector, and the turned vector in steps.

    The steps (whole numbers up to 127, and the size of one) take a byte a component.
    """
    size = unit.shape[1]
    turned = unit @ turn
    first = turned[:, :size]
    factor = np.abs(first).sum(1) / math.sqrt(size)
    step = np.abs(first).max(1) / 127
    return turned >= 0, factor, np.rint(first / step[:, None]).astype(np.int8), step


def estimates(signs: np.ndarray, factor: np.ndarray, steps: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Estimated cosines of coded vectors (rows) and stepped vectors (columns).

    The inner product of a code and the other vector, divided by the stored factor,
    has the cosine as its mean over random rotations.
    """
    size = signs.shape[1]
    return (signs @ steps.T) * (step / math.sqrt(size)).astype(np.float32) / factor[:, None].astype(np.float32)


def may_reach(signs: np.ndarray, factor: np.ndarray, steps: np.ndarray, step: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose estimate does not fall SURENESS standard errors below that of a pair at the threshold.

    The part of the code across its own vector meets the part of the other vector across it:
    sqrt(1 - f^2) / f times sqrt(1 - cos^2), in size - 1 directions; steps add their rounding.
    All sides are multiplied by the factor, so that each side of a pair has a number of its own.
    """
    size = signs.shape[1]
    across = np.sqrt(np.maximum(1 - factor**2, 0)) * math.sqrt(max(1 - threshold**2, 0)) / math.sqrt(max(size - 1, 1))
    found = signs @ steps.T
    found *= (step / math.sqrt(size)).astype(np.float32)
    found += (SURENESS * step / math.sqrt(12)).astype(np.float32)
    return found >= (factor * threshold - SURENESS * across - 1e-5).astype(np.float32)[:, None]


def candidates(left: dict, right: dict | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the pairs of one block, or of two blocks, that either's estimate leaves open."""
    other = left if right is None else right
    maybe = np.ones((len(left["factor"]), len(other["factor"])), bool)
    for x, y, turn in ((left, other, False), (other, left, True)):
        close = may_reach(x["signs"], x["factor"], y["steps"], y["step"], threshold)
        maybe &= close.T if turn else close
    if right is None:
        maybe = np.triu(maybe, 1)
    return np.nonzero(maybe)


def exact_links(left: dict, right: dict | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The candidates that are linked, by their vectors; a pair counts in the first table in which its keys agree."""
    other = left if right is None else right
    a, b = candidates(left, right, threshold)
    kept_a, kept_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, len(a), 1 << 16):
        i, j = a[low : low + (1 << 16)], b[low : low + (1 << 16)]
        x, y = left["vector"][i], other["vector"][j]
        exact = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        agree = left["keys"][i] == other["keys"][j]
        good = (exact >= threshold) & (agree.argmax(1) == left["table"])
        kept_a.append(i[good])
        kept_b.append(j[good])
    return np.concatenate(kept_a), np.concatenate(kept_b)


def _keys(code: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The keys of each code: a number of ``bits`` bits for each table."""
    keys = np.zeros((len(code), tables), np.int64)
    for t in range(tables):
        for k in range(bits):
            keys[:, t] = keys[:, t] * 2 + code[:, t * bits + k]
    return keys


def _forest(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row of the pairs is connected with."""
    root = ids.copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            return root
        root = new


def similar_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row.

    Vectors of one label and one length are linked when their cosine in double
    precision is at least the threshold.  Equal vectors are one, with a weight.
    A vector's code, its factor and the vector in steps of a byte are stored under some keys,
    bits of the code.  Among vectors that share a key the estimates, with their confidence
    bounds, say which can have a partner; only for these are vectors fetched, and the
    cosines of the open pairs computed.  A pair counts once, in its first
    shared key.  Keys with more than BLOCK vectors are compared in pairs of
    blocks, none left out.

    Vectors that are null, zero, or hold null or non-finite values, and vectors
    without a label, link with nothing.  Rows that repeat a vec_id are vectors of
    their own in n_links.  An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()
    good = rows.where(F.coalesce(usable, F.lit(False))).select("vec_id", F.col("label").cast("string").alias("label"), "v")
    distinct = good.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    # Different vectors may share an id; the row number is theirs alone.
    single = stored(distinct.withColumn("row_no", F.monotonically_increasing_id()), "vectors")
    largest = single.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_keys(largest, threshold)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            lengths = lists.value_lengths().to_numpy()
            for size in np.unique(lengths):
                part = batch.filter(pa.array(lengths == size))
                n = part.num_rows
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, size)
                v = v / np.abs(v).max(1, keepdims=True)
                turn = rotations(int(size), turns_for(int(size), bits, tables))
                code, factor, steps, step = encode(v / np.linalg.norm(v, axis=1, keepdims=True), turn)
                keys = _keys(code, bits, tables)
                packed = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (np.packbits(code, axis=1), steps)]
                row = np.tile(np.arange(n), tables)
                take, table = pa.array(row), np.repeat(np.arange(tables), n)
                yield pa.RecordBatch.from_pydict(
                    {
                        "label": part.column("label").take(take), "size": pa.array(np.full(n * tables, size, np.int32)), "table": pa.array(table.astype(np.int32)),
                        "key": pa.array(keys[row, table]), "row_no": part.column("row_no").take(take), "id": part.column("id").take(take), "weight": part.column("weight").take(take),
                        "code": packed[0].take(take), "steps": packed[1].take(take), "step": pa.array(step[row]), "factor": pa.array(factor[row]),
                    }
                )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    coded = single.mapInArrow(tidied(keyed), f"label string, size int, table int, key long, row_no long, id {kind}, weight long, code binary, steps binary, step double, factor double")
    coded = stored(coded, "coded_vectors")
    crowd = coded.groupBy("label", "size", "table", "key").count().where(f"count > {BLOCK}")
    # At most one key in BLOCK rows, so these are few; they are still joined by size.
    crowd = stored(crowd.withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count"), "crowded_keys")
    placed = coded.join(crowd, ["label", "size", "table", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("row_no"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("one", F.least("block", "with")).withColumn("two", F.greatest("block", "with"))
    groups = max(8, -(-coded.count() // GROUP_ROWS))
    cell = ["label", "size", "table", "key", "one", "two"]
    place = F.pmod(F.xxhash64(*cell), F.lit(groups)).alias("place")
    placed = placed.select(*cell, "block", "row_no", "id", "weight", "code", "steps", "step", "factor", place)

    def sides(group: pa.Table) -> Iterator[tuple[np.ndarray, dict, np.ndarray | None, dict | None]]:
        """Rows and contents of every cell of a group: one block, or two."""
        frame = {n: group.column(n).to_numpy() for n in ("size", "table", "key", "one", "two", "block", "step", "factor")}
        _, label = np.unique(np.array(group.column("label").to_pylist(), object).astype(str), return_inverse=True)
        parts = np.stack([label, *(frame[n].astype(np.int64) for n in ("size", "table", "key", "one", "two"))])
        order = np.lexsort(parts[::-1])
        new = np.ones(len(order), bool)
        new[1:] = (parts[:, order[1:]] != parts[:, order[:-1]]).any(0)
        first = np.append(np.flatnonzero(new), len(order))
        blobs = {n: group.column(n).combine_chunks() for n in ("code", "steps", "v") if n in group.column_names}

        def side(at: np.ndarray, size: int, table: int) -> dict:
            rows = {n: b"".join(x.take(pa.array(at)).to_pylist()) for n, x in blobs.items() if n != "v"}
            code = np.unpackbits(np.frombuffer(rows["code"], np.uint8).reshape(len(at), -1), axis=1)
            out = {"signs": code[:, :size].astype(np.float32) * 2 - 1, "factor": frame["factor"][at], "step": frame["step"][at], "table": table}
            out |= {"steps": np.frombuffer(rows["steps"], np.int8).reshape(len(at), size).astype(np.float32), "keys": _keys(code, bits, tables)}
            if "v" in blobs:
                vector = blobs["v"].take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)
                # A vector's scale doesn't matter; this keeps squares in range.
                out["vector"] = vector / np.abs(vector).max(1, keepdims=True)
            return out

        for low, high in zip(first[:-1], first[1:]):
            at = order[low:high]
            size, table, one, two = (int(frame[n][at[0]]) for n in ("size", "table", "one", "two"))
            if len(at) > 1 and one == two:
                yield at, side(at, size, table), None, None
            elif one != two:
                x, y = at[frame["block"][at] == one], at[frame["block"][at] == two]
                if len(x) and len(y):
                    yield x, side(x, size, table), y, side(y, size, table)

    def open_rows(group: pa.Table) -> pa.Table:
        """Rows that have a partner in some open pair of their cell."""
        wanted = np.zeros(group.num_rows, bool)
        for x, left, y, right in sides(group):
            a, b = candidates(left, right, threshold)
            wanted[x[a]] = True
            wanted[(x if y is None else y)[b]] = True
        return group.filter(pa.array(wanted))

    layout = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    wanted = stored(placed.groupBy("place").applyInArrow(tidied_group(open_rows), layout), "open_rows")
    fetched = wanted.join(single.select("row_no", "v"), "row_no")

    def compare(group: pa.Table) -> pa.Table:
        ids_of, weights = group.column("id").to_numpy(), group.column("weight").to_numpy()
        out_id, out_links, out_root = [], [], []
        for x, left, y, right in sides(group):
            a, b = exact_links(left, right, threshold)
            if not len(a):
                continue
            ids, inverse = np.unique(np.concatenate([x[a], (x if y is None else y)[b]]), return_inverse=True)
            a, b = inverse[: len(a)], inverse[len(a) :]
            weight = weights[ids].astype(float)
            links = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
            out_id.append(ids_of[ids])
            out_links.append(links.astype(np.int64))
            out_root.append(_forest(a, b, ids_of[ids]))
        merged = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_id, out_links, out_root)]
        return pa.table({"id": pa.array(merged[0], group.schema.field("id").type), "links": pa.array(merged[1], pa.int64()), "root": pa.array(merged[2], group.schema.field("id").type)})

    found = stored(fetched.groupBy("place").applyInArrow(tidied_group(compare), f"id {kind}, links long, root {kind}"), "vector_links")
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found, "id", "root")
    state = single.select("id", "label", "v", "weight").join(linked, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    state = state.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("root", "id").alias("component"))
    state = stored(state, "vector_state")
    mine = good.join(state, ["label", "v"]).select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    rest = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return mine.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
