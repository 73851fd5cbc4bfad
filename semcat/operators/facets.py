"""Facet values: one readable representative per group of spellings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semcat.functions.facet import UNKNOWN, facet_invalid, facet_key, facet_score, key_of
from semcat.functions.text import py_strip
from semcat.schema import FACET_COLUMNS, ORDER_COLUMN


def exploded_values(df: DataFrame, columns: Sequence[str], order_column: str) -> DataFrame:
    """Rows (column, value, pos, ord), one per non-null list entry, from one scan."""

    def entries(name: str):
        c = F.col(name)
        if not isinstance(df.schema[name].dataType, T.ArrayType):
            c = F.array(c.cast("string"))
        return F.transform(
            F.coalesce(c, F.array().cast("array<string>")),
            lambda value, pos: F.struct(F.lit(name).alias("column"), value.alias("value"), pos.alias("pos")),
        )

    packed = F.flatten(F.array(*[entries(name) for name in columns]))
    return (
        df.select(F.col(order_column).cast("long").alias("ord"), F.explode(packed).alias("e"))
        .select("e.column", "e.value", "e.pos", "ord")
        .filter(F.col("value").isNotNull())
    )


def facet_values(
    df: DataFrame,
    columns: Sequence[str] = FACET_COLUMNS,
    order_column: str = ORDER_COLUMN,
) -> DataFrame:
    """(column, value) of every facet, spellings folded, "Unknown" for junk.

    Equal values collapse in a hash aggregate on a fixed-width buffer before
    anything is shuffled, so a value that fills a third of the table costs one
    row per task; key and score are computed for distinct values only.
    """
    columns = tuple(columns) or FACET_COLUMNS
    c = F.col
    # Row and list position as one number: earlier is smaller.
    place = c("ord").cast("decimal(38,0)") * F.lit(1 << 31) + c("pos")
    first_seen = (
        exploded_values(df, columns, order_column)
        .select("column", "value", place.cast("decimal(38,0)").alias("place"))
        .groupBy("column", "value")
        .agg(F.min("place").alias("place"))
    )
    keyed = first_seen.withColumn("key", facet_key(c("value"))).withColumn(
        "valid", ~facet_invalid(c("value"), c("key"))
    )
    # Junk joins the group of the value that stands for it, without a say in
    # which spelling represents that group.
    rank = F.struct(facet_score(c("value")).alias("score"), (-c("place")).alias("earlier"), "value")
    best = keyed.groupBy(
        "column", F.when(c("valid"), c("key")).otherwise(F.lit(key_of(UNKNOWN))).alias("key")
    ).agg(
        F.max_by(F.when(c("valid"), c("value")), F.when(c("valid"), rank)).alias("value"),
        F.bool_or(~c("valid")).alias("junk"),
    )
    shown = F.array(py_strip(c("value")), F.when(c("junk"), F.lit(UNKNOWN)))
    return best.select("column", F.explode(F.array_distinct(F.array_compact(shown))).alias("value"))
