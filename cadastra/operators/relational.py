"""Relational operators that the library's plans share: filters, joins, aggregates in a set order, first rows, ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.sources.tables import written


def all_of(conditions: list[Column]) -> Column:
    """The conjunction of any number of conditions; none is true."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def like_literal(text: str) -> str:
    """Text with LIKE's wildcards escaped."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ilike(c: Column, text: str, wildcards: bool = False) -> Column:
    """Case-insensitive containment. wildcards: % and _ in the text act as in LIKE."""
    return c.ilike(f"%{text if wildcards else like_literal(text)}%")


def joined_distinct(c: Column, separator: str = ", ") -> Column:
    """Distinct values as strings, sorted and joined; null where all are null. Combines before the shuffle."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(c.cast("string"))), separator), F.lit(""))


def joined_ordered(c: Column, by: list[Column], separator: str = " | ") -> Column:
    """Values as strings in a total order, nulls left out."""
    items = F.collect_list(F.when(c.isNotNull(), F.struct(*[b.alias(f"k{i}") for i, b in enumerate(by)], c.cast("string").alias("v"))))
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["v"]), separator)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def left_join_all(base: DataFrame, parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """base with the columns of each part, all joined on the same keys, so that one partitioning serves them all."""
    return reduce(lambda a, b: a.join(b, keys, "left"), parts, base)


def state_filter(c: Column, wanted: str) -> Column:
    """Rows for a wanted council: the same bare name, one that holds it, or none at all (state-wide)."""
    from cadastra.functions.text import lga_normalise

    bare = lga_normalise(F.lit(wanted))
    return c.isNull() | (lga_normalise(c) == bare) | F.contains(lga_normalise(c), bare)


def descendants(edges: DataFrame) -> DataFrame:
    """(id, root, depth) of a forest of edges (child, parent, null for roots): a join for each level of depth, of any number of rows.

    Children whose parents don't lead to a root have no row; a child with several parents has one for each way. A circle can't be reached from a root.
    """
    below = written(edges.filter("parent IS NOT NULL").select("child", "parent"), "edges")
    level, found, depth = written(edges.filter("parent IS NULL").select(F.col("child").alias("id"), F.col("child").alias("root")), "roots"), [], 0
    while not level.isEmpty():
        found.append(level.withColumn("depth", F.lit(depth)))
        level = written(below.join(level, F.col("parent") == F.col("id")).select(F.col("child").alias("id"), "root"), "level")
        depth += 1
    return reduce(DataFrame.unionByName, found) if found else level.withColumn("depth", F.lit(0))
