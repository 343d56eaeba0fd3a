"""Names of outputs that don't clash, for tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids of one block of a numbering; a stem's rows are numbered block by block.
BLOCK = 1 << 16


def stem(text: Column, longest: int = 32) -> Column:
    """The first line of a text as a file stem: its first ``longest`` characters, all but letters, digits, - and _
    replaced by _, and ``output`` where nothing is left."""
    line = F.substring(F.trim(F.split_part(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(1))), 1, longest)
    clean = F.regexp_replace(line, r"[^\p{L}\p{N}_-]", "_")
    return F.when(clean == "", F.lit("output")).otherwise(clean)


def prefix(stem: Column, number: Column) -> Column:
    """The name of a stem's n-th use: bare for the first, else with the number. A stem that itself ends like a
    numbered name always has its number, so two names are equal only if stem and number are."""
    bare = (number == 1) & ~stem.rlike(r"_[0-9]+$")
    return F.when(bare, stem).otherwise(F.concat(stem, F.lit("_"), number.cast("string")))


def numbered(rows: DataFrame, order: str, used: DataFrame | None = None) -> DataFrame:
    """``rows`` (stem, a whole-number ``order``, ...) with ``number`` and ``prefix``: each stem's uses are numbered from 1 in that
    order, or on from the greatest number in ``used`` (stem, number). Nulls come first; ties go by the other columns.

    Blocks of neighbouring rows are counted first and numbered apart, so a stem that most rows have is spread."""
    others = [c for c in rows.columns if c not in ("stem", order)]
    r = rows.withColumn("_block", F.coalesce(F.floor(F.col(order) / BLOCK), F.lit(-(1 << 62))))
    sizes = r.groupBy("stem", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("stem").orderBy("_block")) - F.col("_n")
    sizes = sizes.withColumn("_before", before).drop("_n")
    if used is not None:
        sizes = sizes.join(used.groupBy("stem").agg(F.max("number").alias("_used")), "stem", "left").withColumn("_before", F.col("_before") + F.coalesce("_used", F.lit(0))).drop("_used")
    place = F.row_number().over(Window.partitionBy("stem", "_block").orderBy(F.asc_nulls_first(order), *others))
    out = r.withColumn("_place", place).join(sizes, ["stem", "_block"]).withColumn("number", (F.col("_before") + F.col("_place")).cast("long"))
    return out.withColumn("prefix", prefix(F.col("stem"), F.col("number"))).drop("_block", "_place", "_before")
