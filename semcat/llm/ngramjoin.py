"""Near copies by the Jaccard similarity of their word shingles: a grouped prefix join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semcat.llm.common import HashIndex, as_texts, bound_batches, bytes_of, discard, free_shuffles, hashed_sample, mixed, scratch, sent, shipped, slices, stored, tidied, words_of
from semcat.llm.graph import components

# Bound of the documents in which frequent shingles are looked for.  They only set
# the order in which shingles are compared; any order gives the same links.
SAMPLE_DOCS = 5000
RECENT = 4  # shared ids before one that tell whether a pair was met already


def _count_needed(size: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set must share with any set that it is linked to."""
    return (size * percent + 99) // 100


def shingles(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each document and their document, in order, with repeats.

    A document with fewer words has its whole sequence as its only shingle.
    """
    word, doc = words_of(data, bounds)
    n_docs = len(bounds) - 1
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    made = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    owner = np.repeat(np.arange(n_docs), made)
    start = np.repeat(first, made) + np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)
    length = np.minimum(words, count[owner])
    out = length.astype(np.uint64)
    for k in range(words):
        inside = k < length
        step = word[np.minimum(start + k, max(len(word) - 1, 0))] if len(word) else word
        out = np.where(inside, out * np.uint64(0x9FB21C651E98DF25) + step, out)
    return mixed(out), owner


def _distinct(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of each document in ascending order, once each."""
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], doc[new]


class ShingleOrder:
    """An id for each shingle whose order puts rare ones first: a count in the upper 7 bits, 56 bits of the hash below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.index = HashIndex(keys)
        self.counts = np.append(np.minimum(counts, 127), 0).astype(np.uint64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        low = hashes >> np.uint64(8)
        return (self.counts[self.index.find(low)] << np.uint64(56)) | low


def frequent_shingles(docs: DataFrame, words: int, bound: int = SAMPLE_DOCS) -> ShingleOrder:
    texts = [r["text"] for r in hashed_sample(docs.select("doc_id", "text"), bound, "shingles").collect()]
    found = []
    for low in range(0, len(texts), 500):
        value, doc = shingles(*bytes_of(as_texts(pa.array(texts[low : low + 500], pa.large_string()))), words)
        found.append(_distinct(value >> np.uint64(8), doc)[0])
    keys, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64),) * 2
    return ShingleOrder(keys[counts > 2], counts[counts > 2])


def _lists(flat: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def parities(value: np.ndarray, doc: np.ndarray, size: np.ndarray) -> pa.Array:
    """For each set a bit for every remainder of its ids: whether an odd number of them has it.

    Bits are a power of two, 64 or the set's size at least.  An id that stands in one of two sets only
    turns one bit, so sets differ in as many ids as their bits differ, or in more.
    """
    words = np.maximum(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), 64) >> 6
    ends = np.concatenate([[0], np.cumsum(words)])
    bit = (value & ((words[doc] << 6) - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount((ends[doc] << 6) + bit, minlength=ends[-1] << 6).astype(np.uint8) & 1
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.packbits(odd, bitorder="little").view(np.int64)))


def shingle_sets(docs: DataFrame, words: int, order, percent: int | None = None) -> DataFrame:
    """doc_id, n_shingles and the ids of the shingles in their order.

    With a percentage the ids are cut to the prefix: two sets that are linked
    share an id of their prefixes, and near copies mostly ``least``.  128-bit keys of
    the whole set (key1, key2) and of the prefix (prefix1, prefix2) and the parities
    of the whole set then come along.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = order()
        for batch in batches:
            for part, data, bounds in slices(batch):
                n = part.num_rows
                value, doc = shingles(data, bounds, words)
                value, doc = _distinct(table.ids(value), doc)
                size = np.bincount(doc, minlength=n)
                columns = {"doc_id": part.column("doc_id"), "n_shingles": pa.array(size.astype(np.int64))}
                if percent is None:
                    columns["ids"] = _lists(value, doc, n)
                else:
                    least = np.maximum(size // 20, 1)
                    reach = np.minimum(size - _count_needed(size, percent) + 1, size)
                    rank = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
                    kept = rank < reach[doc]
                    columns |= {"least": pa.array(least.astype(np.int64)), "ids": _lists(value[kept], doc[kept], n)}
                    for key, some in (("key", np.ones(len(doc), bool)), ("prefix", kept)):
                        for salt in (1, 2):
                            sums = np.zeros(n, np.uint64)
                            np.add.at(sums, doc[some], mixed(value[some] ^ mixed(np.full(1, salt, np.uint64))))
                            columns[f"{key}{salt}"] = pa.array(sums.view(np.int64))
                    columns["parity"] = parities(value, doc, size)
                yield pa.RecordBatch.from_pydict(columns)

    more = "" if percent is None else ", least long"
    tail = "" if percent is None else ", key1 long, key2 long, prefix1 long, prefix2 long, parity array<long>"
    return docs.select("doc_id", "text").mapInArrow(tidied(rows), f"doc_id {kind}, n_shingles long{more}, ids array<long>{tail}")


def _linked(pairs: DataFrame, docs: DataFrame, words: int, order, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough, with the sets made anew from the texts.

    Sets of b travel to their pairs and with them to the fewer sets of a.
    """
    pairs = stored(pairs, "pairs")

    def sets(name: str) -> DataFrame:
        wanted = sent(pairs.select(F.col(name).alias("doc_id")).distinct())
        made = shingle_sets(docs.join(wanted, "doc_id", "left_semi"), words, order)
        return made.select(F.col("doc_id").alias(name), F.col("ids").alias(f"{name}_ids"))

    both = F.size(F.array_intersect("a_ids", "b_ids"))
    enough = both * 100 >= (F.size("a_ids") + F.size("b_ids") - both) * percent
    return pairs.join(sets("b"), "b").join(sets("a"), "a").where(enough).select("a", "b")


def _compatible(percent: int, x: str, y: str):
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _enough(percent: int, both, x: str, y: str):
    return both * (100 + percent) >= (F.col(x) + F.col(y)) * percent


def _halved(parity, other):
    """The parity as it is with as few bits as the other has; sets of half the size at least have half the bits or as many."""
    half = (F.size(parity) / 2).cast("int")
    folded = F.zip_with(F.slice(parity, 1, half), F.slice(parity, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(parity) > F.size(other), folded).otherwise(parity)


def _alike(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of groups without those whose parities differ in too many bits for a link.

    A group without a parity, or of another number of bits, passes.
    """
    for name in ("a", "b"):
        pairs = pairs.join(marks.select(F.col("gid").alias(name), F.col("n_shingles").alias(f"{name}_size"), F.col("parity").alias(f"{name}_parity")), name)
    a, b = F.col("a_parity"), F.col("b_parity")
    turned = F.zip_with(_halved(a, b), _halved(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(turned, F.lit(0), lambda x, y: x + y)
    most = (F.col("a_size") + F.col("b_size") - apart) / 2
    return pairs.where(F.coalesce(_enough(percent, most, "a_size", "b_size"), F.lit(True))).select("a", "b").distinct()


def near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row.

    Documents are linked when 100 * |intersection| >= percent * |union| of their
    sets of distinct word shingles, lower-cased A-Z.  component_id is the
    smallest doc_id that links lead to, the row's own included.

    1. Rows with equal sets are one; those with equal prefixes and size are one
       group, named by its smallest doc_id.
    2. Every group meets the most central group of each list of a shingle, and every
       member its group: verified, these links join most of what belongs together.
    3. What is in lists of several components meets all others: group pairs are
       filtered by size, by the place of the first id they share, by the parities of groups of one set and by what their
       prefixes share, expanded to members of different components and verified.  So no link between components is lost,
       and no list of near copies is paired with itself.

    Null and empty texts, and texts without words, have no set and are alone.
    Rows of one doc_id count as one document that has each of their texts; a
    null doc_id is linked with nothing.  Empty tables give empty tables; other
    columns are ignored.  The result is a table; what it was made from is removed.
    """
    bound_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        return stored(_near_copies(docs, words, percent), "near_copies", keep=True)


def _near_copies(docs: DataFrame, words: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    order = shipped(spark, frequent_shingles(docs, words))
    made = shingle_sets(docs, words, order, percent).withColumn("row_no", F.monotonically_increasing_id())
    whole = stored(made, "prefixes")
    rows = stored(whole.select("doc_id", "n_shingles", "key1", "key2"), "row_keys")
    full = whole.where("n_shingles > 0 and doc_id is not null").withColumn("reach", F.size("ids"))
    one = F.min(F.struct("doc_id", "row_no", "least", "reach", "prefix1", "prefix2")).alias("one")
    copies = stored(full.groupBy("key1", "key2", "n_shingles").agg(one), "distinct_sets")
    unique = copies.select("n_shingles", "one.*")

    same_prefix = ["n_shingles", "prefix1", "prefix2"]
    lowest = F.min(F.struct("doc_id", "row_no", "least", "reach")).alias("low")
    grouped = unique.groupBy(*same_prefix).agg(lowest, F.count("*").alias("size"))
    # Texts of one doc_id may be in several groups; row_no tells these apart.
    named = grouped.select(*same_prefix, F.col("low.doc_id").alias("gid"), "low.row_no", "low.least", "low.reach", "size")
    groups = stored(named, "groups")
    several = groups.where("size > 1")
    member = unique.join(several.select(*same_prefix, "gid"), same_prefix, "left").select("doc_id", F.coalesce("gid", "doc_id").alias("gid"), "n_shingles")
    members = stored(member, "members")
    # Members of a group share the prefix only, so its parity is that of a lone member.
    alone = F.when(F.col("size") == 1, F.col("parity")).alias("parity")
    prefixes = stored(full.select("row_no", "ids", "parity").join(groups.select("row_no", "gid", "n_shingles", "size"), "row_no").select("row_no", "gid", "n_shingles", "ids", alone), "group_prefixes")
    discard(whole)
    marks = prefixes.select("gid", "n_shingles", "parity")
    index = prefixes.select(F.posexplode("ids").alias("pos", "id"), "row_no")
    # Lists of one group go.
    shared = index.withColumn("groups", F.count("*").over(Window.partitionBy("id"))).where("groups > 1").drop("groups")
    own = Window.partitionBy("row_no")
    listed = (
        shared.join(groups.select("row_no", "gid", F.col("n_shingles").cast("int"), F.col("least").cast("int"), "reach"), "row_no")
        .withColumn("recent", F.collect_list("id").over(own.orderBy("pos").rowsBetween(-RECENT, -1)))
        .withColumn("all_lone", (F.col("reach") - F.count("*").over(own)).cast("int"))
        .drop("reach", "row_no")
    )
    listed = stored(listed, "lists")
    free_shuffles(spark)
    # The group with the fewest ids of its own is the likeliest to be near all others.
    leads = listed.groupBy("id").agg(F.min(F.struct("all_lone", "gid")).alias("lead")).select("id", F.col("lead.gid").alias("lead"))
    sizes = groups.select(F.col("gid").alias("lead"), F.col("n_shingles").alias("l_size"), F.col("least").alias("l_least"))
    met = listed.join(leads, "id").where("gid != lead").groupBy("gid", "n_shingles", "least", "lead").count().join(sizes, "lead")
    near = met.where(_compatible(percent, "n_shingles", "l_size") & (F.col("count") >= F.least("least", "l_least")))
    first = _alike(near.select(F.col("lead").alias("a"), F.col("gid").alias("b")), marks, percent).unionByName(
        members.where("doc_id != gid").select(F.col("gid").alias("a"), F.col("doc_id").alias("b"))
    )
    links = stored(_linked(first, docs, words, order, percent), "links1")
    found = stored(components(links, "a", "b"), "components1")
    free_shuffles(spark)

    placed = members.join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", "gid", "n_shingles", F.coalesce("root", "doc_id").alias("root"))
    placed = stored(placed, "placed")
    spans = placed.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    known = listed.select("id", "gid", "n_shingles", "pos", "recent").join(spans, "gid")
    # Of two sets that are linked, the smaller has enough left from the first id that both have on: lists
    # where all stand later than that go, too.
    early = (F.col("n_shingles") - F.col("pos")) * F.lit(100 + percent).cast("long") >= F.col("n_shingles") * F.lit(2 * percent).cast("long")
    lists = known.groupBy("id").agg(F.min("low").alias("l"), F.max("high").alias("h"), F.max(early).alias("early"))
    mixed_lists = lists.where("l < h and early").select("id")
    open_lists = stored(known.join(mixed_lists.hint("shuffle_hash"), "id"), "open_lists")
    discard(listed)
    x, y = open_lists.alias("x"), open_lists.alias("y")
    apart = (F.col("x.low") != F.col("y.low")) | (F.col("x.low") != F.col("x.high")) | (F.col("y.low") != F.col("y.high"))
    # Ids stand in one order everywhere: at the first that two sets share, neither has one of the
    # other's before it, so what is left from there bounds the overlap.
    most = F.least(F.col("x.n_shingles") - F.col("x.pos"), F.col("y.n_shingles") - F.col("y.pos"))
    reachable = most * (100 + percent) >= (F.col("x.n_shingles") + F.col("y.n_shingles")) * percent
    # Where both had the same id shortly before, the pair is met there.
    opens = ~F.arrays_overlap("x.recent", "y.recent")
    met = x.join(y, (F.col("x.id") == F.col("y.id")) & (F.col("x.gid") < F.col("y.gid")) & apart & _compatible(percent, "x.n_shingles", "y.n_shingles") & reachable & opens)
    met = stored(met.select(F.col("x.gid").alias("a"), F.col("y.gid").alias("b")).distinct(), "group_pairs")
    discard(open_lists)
    met = stored(_alike(met, marks, percent).select(F.col("a").alias("g"), F.col("b").alias("o")), "alike_pairs")
    # Up to the end of the prefix that ends first, the prefixes tell all that is shared.
    wanted = sent(met.select(F.explode(F.array("g", "o")).alias("gid")).distinct())
    prefixes = prefixes.join(wanted, "gid", "left_semi")
    side = {n: prefixes.select(F.col("gid").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in ("ids", "n_shingles"))) for n in "go"}
    ends = F.element_at("g_ids", -1) <= F.element_at("o_ids", -1)
    rest = F.when(ends, F.col("g_n_shingles") - F.size("g_ids")).otherwise(F.col("o_n_shingles") - F.size("o_ids"))
    could = F.size(F.array_intersect("g_ids", "o_ids")) + rest
    pairs = met.join(side["g"], "g").join(side["o"], "o").where(_enough(percent, could, "g_n_shingles", "o_n_shingles")).select("g", "o")
    inner = placed.join(several.select("gid"), "gid", "left_semi").select(F.col("gid").alias("g"), F.col("gid").alias("o")).distinct()
    one = placed.select(F.col("gid").alias("g"), F.col("doc_id").alias("a"), F.col("root").alias("ra"))
    two = placed.select(F.col("gid").alias("o"), F.col("doc_id").alias("b"), F.col("root").alias("rb"))
    second = pairs.unionByName(inner).join(one, "g").join(two, "o").where("ra != rb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = stored(_linked(second, docs, words, order, percent), "links2")
    joined = stored(components(links.unionByName(more), "a", "b"), "components2")

    final = copies.select("key1", "key2", "n_shingles", F.col("one.doc_id").alias("rep"))
    final = final.join(joined, F.col("rep") == F.col("node"), "left").select("key1", "key2", "n_shingles", F.coalesce("root", "rep").alias("component"))
    out = rows.select("doc_id", "n_shingles", "key1", "key2").join(final, ["key1", "key2", "n_shingles"], "left")
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", "n_shingles", F.coalesce(linked, "doc_id").alias("component_id"))
