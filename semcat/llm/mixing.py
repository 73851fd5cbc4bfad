"""Mixing sources to target weights by Pareto order sampling, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semcat.llm.common import stored

_SPACES = " \t\n\x0b\f\r"
# Bins of the order statistic per source.  Only the bin in which a source's
# budget runs out is sorted, so no task sorts a whole source.
BINS = 4096


def word_count(text: str | Column) -> Column:
    """Number of maximal runs without white space; null: 0."""
    bare = F.ltrim(text, F.lit(_SPACES))
    runs = F.regexp_replace(bare, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", ".")
    return F.coalesce(F.length(runs), F.lit(0)).cast("long")


def ordinals(df: DataFrame, *order: Column) -> DataFrame:
    """The frame with ``ordinal`` from 0 in the given order, without one task that sees all rows."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordinals")
    part = F.shiftright("_at", 33)
    parts = kept.groupBy(part.alias("_part")).count()
    # One row per partition of the sort, so this window is as small as the cluster.
    before = parts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return (
        kept.withColumn("_part", part)
        .join(before, "_part")
        .withColumn("ordinal", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_at", "_before")
    )


def source_targets(sizes: DataFrame, max_copies: int) -> DataFrame:
    """source, source_size, target: the words of all sources shared out by weight.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ...  No target is
    above ``max_copies`` times its source's size; what is cut off goes to the
    other sources by weight, until none is above.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = ordinals(sources, F.col("source").isNull().asc(), F.col("source").asc_nulls_last())
    table = stored(placed.withColumn("weight", F.col("ordinal") % 3 + 1), "sources")
    cap = F.col("source_size") * max_copies

    def sums(level: float | None):
        over = F.lit(False) if level is None else cap < F.lit(level) * F.col("weight")
        return table.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(over, cap).otherwise(0)).alias("capped"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(over.cast("long")).alias("n"),
        ).first()

    # Three sums a round reach the driver; a round more only where more sources hit the cap.
    level, n = None, -1
    while True:
        row = sums(level)
        if not row["words"] or row["n"] == n or not row["weight"]:
            break
        n = row["n"]
        level = (row["words"] - row["capped"]) / row["weight"]
    shared = F.lit(float(level or 0.0)) * F.col("weight")
    return table.select("source", "source_size", F.least(shared, cap.cast("double")).alias("target"))


def mixing_plan(docs: DataFrame, max_copies: int = 3, seed: str = "mix", bins: int = BINS) -> DataFrame:
    """How often each document enters the mix.

    Returns doc_id, source, row_no (1, 2, ... among rows of one doc_id), size,
    source_size, target, expected (copies), copies, taken.

    A document's expected copies grow with the bit length of its size, up to
    ``max_copies``, so that a source's expected words equal its target.  Whole
    expected copies are certain.  For the rest, documents are ranked by random
    odds divided by inclusion odds, and the first are taken until the words of
    the source are used up; the sample's size is fixed in words.  Two
    more documents, the largest that fits the gap and then the one that comes
    nearest, close it where that brings the sum nearer.

    Null texts and texts without a word have size 0 and are never taken.  Null
    sources are one source.  Rows that repeat an id are ranked each by itself;
    rows that agree in id, source and size are interchangeable.  An empty table
    gives an empty table.  Other columns are ignored.  Reruns agree.
    """
    slim = docs.select("doc_id", "source", word_count("text").alias("size"))
    numbered = slim.withColumn(
        "row_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("source", "size"))
    )
    sizes = stored(numbered, "sizes")
    targets = stored(source_targets(sizes, max_copies), "targets")

    # Sizes of one bit length share their odds: a source has some 40 classes at most.
    bits = F.length(F.bin("size"))
    classes = sizes.where("size > 0").groupBy("source", bits.alias("bits")).agg(F.sum("size").alias("words"))
    down = Window.partitionBy("source").orderBy(F.desc("bits"))
    same = F.col("source").eqNullSafe(F.col("t_source"))
    of_source = targets.withColumnRenamed("source", "t_source")
    rated = (
        classes.join(of_source, same)
        .withColumn("above", F.sum("words").over(down) - F.col("words"))
        .withColumn("rest", F.sum(F.col("words") * F.col("bits")).over(Window.partitionBy("source")))
        .withColumn("rest", F.col("rest") - F.sum(F.col("words") * F.col("bits")).over(down) + F.col("words") * F.col("bits"))
        .withColumn("rate", (F.col("target") - F.col("above") * max_copies) / F.col("rest"))
        .withColumn("fits", F.col("rate") * F.col("bits") <= F.lit(float(max_copies)))
        .withColumn("rate", F.max(F.when(F.col("fits"), F.struct("bits", "rate"))).over(Window.partitionBy("source"))["rate"])
        .withColumn("expected", F.least(F.coalesce(F.col("rate") * F.col("bits"), F.lit(float(max_copies))), F.lit(float(max_copies))))
        .withColumn("certain", F.floor("expected"))
        .withColumn("chance", F.col("expected") - F.col("certain"))
        .withColumn("left", F.col("target") - F.sum(F.col("words") * F.col("certain")).over(Window.partitionBy("source")))
    )
    odds_of = stored(rated.select(F.col("source").alias("c_source"), F.col("bits").alias("c_bits"), "expected", "certain", "chance", "left"), "odds")
    all_sizes = sizes.withColumn("bits", bits)
    in_class = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bits") == F.col("c_bits")) & (F.col("size") > 0)
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("row_no").cast("string")))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))
    drawn = (
        all_sizes.join(F.broadcast(odds_of) if _few(odds_of) else odds_of, in_class, "left")
        .withColumn("u", uniform)
        .withColumn("q", F.when(F.col("chance") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance")))))
        .withColumn("bin", F.floor(F.col("q") / (F.col("q") + 1) * bins))
        .drop("c_source", "c_bits", "u", "bits")
    )
    drawn = stored(drawn, "drawn")

    by_bin = drawn.where("q is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    edges = stored(
        by_bin.withColumn("upto", run)
        .where(F.col("upto") > F.col("left"))
        .groupBy("source")
        .agg(F.min(F.struct("bin", (F.col("left") - F.col("upto") + F.col("words")).alias("room"))).alias("edge"))
        .select(F.col("source").alias("e_source"), F.col("edge.bin").alias("edge"), F.col("edge.room").alias("room")),
        "edges",
    )
    at_edge = F.col("source").eqNullSafe(F.col("e_source"))
    marked = drawn.join(F.broadcast(edges) if _few(edges) else edges, at_edge, "left")
    inside = marked.where(F.col("bin") == F.col("edge"))
    cum = F.sum("size").over(Window.partitionBy("source").orderBy("q", "doc_id", "row_no"))
    partly = stored(inside.withColumn("picked", cum <= F.col("room")), "edge_bins")
    gaps = partly.groupBy("source").agg(
        (F.first("room") - F.sum(F.when(F.col("picked"), F.col("size")).otherwise(0))).alias("gap")
    ).select(F.col("source").alias("g_source"), "gap")
    row = ["doc_id", "row_no", "source", "size", "q"]
    passed = stored(
        marked.where(F.col("bin") > F.col("edge")).select(*row).unionByName(partly.where("not picked").select(*row)), "passed"
    )
    # The largest that fits, then the one that comes nearest.
    first = stored(_closing(passed, gaps, F.col("size") <= F.col("gap")), "closing")
    left = gaps.join(first, F.col("g_source").eqNullSafe(F.col("source")), "left").select(
        "g_source", (F.col("gap") - F.coalesce("size", F.lit(0))).alias("gap"),
        F.col("doc_id").alias("p_doc"), F.col("row_no").alias("p_row"),
    )
    fresh = ~(F.col("doc_id").eqNullSafe(F.col("p_doc")) & F.col("row_no").eqNullSafe(F.col("p_row")))
    second = _closing(passed, left, fresh)
    key = (F.col("doc_id").alias("x_doc"), F.col("row_no").alias("x_row"), F.lit(True).alias("closes"))
    chosen = [df.select(*key) for df in (first, second, partly.where("picked"))]
    extra = stored(chosen[0].unionByName(chosen[1]).unionByName(chosen[2]), "chosen")
    mine = F.col("doc_id").eqNullSafe(F.col("x_doc")) & (F.col("row_no") == F.col("x_row"))
    sampled = F.coalesce(F.col("q").isNotNull() & (F.col("edge").isNull() | (F.col("bin") < F.col("edge"))), F.lit(False))
    copies = F.coalesce("certain", F.lit(0)) + (sampled | F.coalesce("closes", F.lit(False))).cast("long")
    out = marked.join(extra, mine, "left").withColumn("copies", copies)
    of_all = F.col("source").eqNullSafe(F.col("t_source"))
    return out.join(F.broadcast(of_source) if _few(of_source) else of_source, of_all).select(
        "doc_id", "source", "row_no", "size", "source_size", "target",
        F.coalesce("expected", F.lit(0.0)).alias("expected"), "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )


def _closing(passed: DataFrame, gaps: DataFrame, fits: Column) -> DataFrame:
    """Per source, the passed document whose size comes nearest to the gap."""
    off = F.abs(F.col("size") - F.col("gap"))
    return (
        passed.join(gaps, F.col("source").eqNullSafe(F.col("g_source")))
        .where(fits & (off < F.col("gap")))
        .groupBy("source")
        .agg(F.min(F.struct(off.alias("off"), "q", "doc_id", "row_no", "size")).alias("best"))
        .select("source", "best.doc_id", "best.row_no", "best.size")
    )


def _few(table: DataFrame, limit: int = 100_000) -> bool:
    """Whether a stored table is small enough to send whole; both ways give the same rows."""
    return table.limit(limit + 1).count() <= limit


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with ``copy`` from 1.

    Rows of one doc_id are told apart by their order of source and size.
    """
    plan = mixing_plan(docs, **settings).where("taken > 0")
    key = plan.select(F.col("doc_id").alias("m_doc"), F.col("row_no").alias("m_row"), F.col("copies").alias("m_copies"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("source", word_count("text")))
    mine = F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("m_place") == F.col("m_row"))
    return (
        docs.withColumn("m_place", place)
        .join(key, mine)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m_copies").cast("int"))))
        .drop("m_doc", "m_row", "m_copies", "m_place")
    )
