"""A Merkle manifest of a table: leaves per source, a tree per source, a tree of the sources.

Nodes are numbered within their tree and cut into blocks of 3^LEVELS, so that a run
of three never crosses a block.  Inside a block every level is one step of windows:
columns at a fixed distance before and after a node hold its siblings, and the first
of a run hashes the run's parent.  The blocks' tops are the next tier's nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semcat.llm.common import stored

ARITY = 3
LEVELS = 6  # of a block: 729 nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """A value with its length in bytes before it, or a dash: no two lists of values look alike."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return digest(*(encoded(v) for v in values))


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """The nodes with i, their place in the order of their key, from 0.

    Rows are dealt out by range, counted by part, and numbered within their part; a key
    that goes on from an earlier part starts after what stands there.  No key is in one task.
    """
    placed = stored(nodes.repartitionByRange("key", *order).withColumn("part", F.spark_partition_id()), "merkle_order")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("part", "key").count().withColumn("offset", F.sum("count").over(before))
    # A part goes on with one key at most: there are no more rows than parts.
    offsets = F.broadcast(counts.where("offset > 0").select("part", "key", "offset"))
    inside = F.row_number().over(Window.partitionBy("part", "key").orderBy(*order)) - 1
    numbered = placed.withColumn("inside", inside).join(offsets, ["part", "key"], "left")
    return numbered.withColumn("i", (F.col("inside") + F.coalesce("offset", F.lit(0))).cast("long")).drop("part", "inside", "offset")


def _tier(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes (key, i, node) with block, path (siblings of all levels of the block) and top (the block's, at its first row).

    A single node of a key stays as it is; elsewhere every run, even of one, has a parent.
    """
    size = ARITY**levels
    out = nodes.withColumn("block", F.floor(F.col("i") / size).cast("long")).withColumn("at", F.col("i") % size)
    out = out.withColumn("n", F.count("*").over(Window.partitionBy("key", "block"))).withColumn("top", F.col("node"))
    inside = Window.partitionBy("key", "block").orderBy("i")
    for level in range(levels):
        width = ARITY**level
        out = out.withColumns(
            {f"{side}{k}": move("top", k * width).over(inside) for side, move in (("lag", F.lag), ("lead", F.lead)) for k in (1, 2)}
        )
        here = F.ceil(F.col("n") / width)
        grows = (F.col("block") > 0) | (here > 1)
        place = F.floor(F.col("at") / width)
        slot, run = place % ARITY, F.least(F.lit(ARITY), here - ARITY * F.floor(place / ARITY))
        node_row = F.col("at") % width == 0

        def given(condition: Column, name: str) -> Column:
            return F.when(condition, F.col(name)).otherwise(F.lit(""))

        left = F.concat(given(slot == 2, "lag2"), given(slot >= 1, "lag1"))
        right = F.concat(given((slot <= 1) & (run > slot + 1), "lead1"), given((slot == 0) & (run > 2), "lead2"))
        step = F.when(grows & node_row, F.struct(left.alias("left"), right.alias("right")))
        out = out.withColumn(f"step{level}", step)
        parent = F.when(node_row & (slot == 0), digest(F.col("top"), F.col(f"step{level}.right")))
        out = out.withColumn("top", F.when(grows, parent).otherwise(F.col("top"))).drop("lag1", "lag2", "lead1", "lead2")
    # Steps stand at the first row below a node; all rows below it share them.
    down = inside.rowsBetween(Window.unboundedPreceding, 0)
    path = F.filter(F.array(*(F.last(f"step{level}", ignorenulls=True).over(down) for level in range(levels))), lambda s: s.isNotNull())
    return out.withColumn("path", path.cast(_PATH)).drop("n", *(f"step{level}" for level in range(levels)))


def _tree(nodes: DataFrame, largest: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of numbered keys with path (up to the key's root); and (key, tree_root).  ``largest``: nodes of a key at most."""
    tiers = [_tier(nodes, LEVELS)]
    while largest > ARITY**LEVELS:
        largest = -(-largest // ARITY**LEVELS)
        tops = tiers[-1].where("at = 0").select("key", F.col("block").alias("i"), F.col("top").alias("node"))
        tiers.append(_tier(stored(tops, "merkle_tier"), LEVELS))
    roots = stored(tiers[-1].where("at = 0").select("key", F.col("top").alias("tree_root")), "merkle_roots")
    above = None
    for tier in reversed(tiers):
        if above is not None:
            above = above.select("key", F.col("i").alias("block"), F.col("path").alias("path_above"))
            tier = tier.join(above, ["key", "block"]).withColumn("path", F.concat("path", "path_above")).drop("path_above")
        above = tier.drop("block", "at", "top")
    return above, roots


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))), 256)


def merkle_manifest(rows: DataFrame, group: Column, order: Column, leaf: Column, carried: dict[str, Column] | None = None) -> DataFrame:
    """leaf, subroot, root, path and the ``carried`` columns of every row.

    Per ``group`` leaves ascend by ``order``; runs of three become one node until one
    is left, the group's subroot.  Subroots, by group as text (null first, by bytes),
    become the root in the same way.  ``path`` holds the siblings (left, right) from
    the leaf to the root.  Rows that agree in ``order``, null first, stand by their leaf.
    An empty table gives an empty one.
    """
    carried = carried or {}
    name = group.cast("string")
    key = F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name))
    leaves = rows.select(key.alias("key"), order.alias("order"), leaf.alias("node"), F.monotonically_increasing_id().alias("tie"), *(c.alias(f"c_{n}") for n, c in carried.items()))
    # Equal rows may stand in any order; their number only spreads them.
    leaves = stored(leaves, "merkle_leaves")
    numbered = stored(_numbered(leaves, ["order", "node", "tie"]).drop("order", "tie"), "merkle_numbers")
    groups = numbered.groupBy("key").count()
    largest, n_groups = groups.agg(F.max("count"), F.count("*")).first()
    members, subroots = _tree(numbered, largest or 0)
    sources = subroots.select(F.lit("").alias("key"), F.col("key").alias("group"), F.col("tree_root").alias("node"))
    upper, roots = _tree(_numbered(sources, ["group"]), n_groups)
    upper = stored(upper.join(roots, "key").select(F.col("group").alias("key"), F.col("path").alias("path_above"), F.col("node").alias("subroot"), F.col("tree_root").alias("root")), "merkle_sources")
    out = members.join(upper, "key")
    return out.select(*(F.col(f"c_{n}").alias(n) for n in carried), F.col("node").alias("leaf"), "subroot", "root", F.concat("path", "path_above").alias("path"))


def document_manifest(docs: DataFrame, changed_text: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path and changed_leaf, that of the document with ``changed_text``, of every document.

    Leaves hash doc_id, source, lang, n_chars and text.  Nulls, empty texts, repeated
    rows and rows without an id each have a leaf; other columns are ignored.
    """
    values = [F.col(c) for c in FIELDS]
    changed = leaf_digest(*values[:-1], changed_text if changed_text is not None else F.col("text"))
    return merkle_manifest(docs, F.col("source"), F.col("doc_id"), leaf_digest(*values), {"doc_id": F.col("doc_id"), "changed_leaf": changed})
