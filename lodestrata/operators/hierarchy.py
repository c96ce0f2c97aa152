"""The mutable store: deletes that reach children, reads that don't see what was deleted, updates of allowed columns, compaction.

Tables of a store form a tree by their parent columns (``Relation``). A delete is a set of tombstones: the ids asked for, and, table by table from parents to children, all ids below them. Tombstones are appended; reads apply
them by an anti join, and ``compacted`` rewrites a table without what is dead, after which its tombstones can go. Nothing is rewritten at the time of a delete, and a delete that is run again adds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    """Rows of ``child`` (with the id column ``key``) belong to the row of ``parent`` that ``column`` names."""

    child: str
    key: str
    column: str
    parent: str


TOMBSTONES = "table string, id string"


def parents_first(relations: list[Relation]) -> list[Relation]:
    """Relations in an order in which a table is complete before its children are looked for; a circle is an error."""
    left, done = list(relations), []
    while left:
        ready = [r for r in left if not any(x.child == r.parent for x in left)]
        if not ready:
            raise ValueError("tables are each other's parents")
        done += ready
        left = [r for r in left if r not in ready]
    return done


def cascade(asked: DataFrame, tables: dict[str, DataFrame], relations: list[Relation], keep: bool = True) -> DataFrame:
    """(table, id) asked for -> (table, id) of these and everything below; ``keep``: with those asked for themselves (else only what they hold)."""
    dead = asked.select("table", F.col("id").cast("string").alias("id")).distinct()
    found = {name: dead.filter(F.col("table") == name).select("id") for name in tables}
    for r in parents_first(relations):
        rows = tables[r.child].select(F.col(r.key).cast("string").alias("_id"), F.col(r.column).cast("string").alias("id"))
        below = rows.join(found[r.parent].distinct(), "id", "left_semi").select(F.col("_id").alias("id"))
        found[r.child] = found[r.child].union(below)
    every = reduce(DataFrame.union, (ids.select(F.lit(name).alias("table"), "id") for name, ids in found.items())).distinct()
    return every if keep else every.join(dead, ["table", "id"], "left_anti")


def bury(tombstones: DataFrame, path: str) -> None:
    """Append tombstones; those that are there already are not written again."""
    spark = tombstones.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        tombstones = tombstones.join(buried(tombstones.sparkSession, path), ["table", "id"], "left_anti")
    tombstones.write.mode("append").partitionBy("table").parquet(path)


def buried(spark, path: str) -> DataFrame:
    return spark.read.schema(TOMBSTONES).parquet(path).select("table", "id")


def alive(rows: DataFrame, table: str, key: str, tombstones: DataFrame) -> DataFrame:
    """The rows that no tombstone names; a null id is never dead."""
    dead = tombstones.filter(F.col("table") == table).select(F.col("id").alias("_dead")).distinct()
    return rows.join(dead, F.col(key).cast("string") == F.col("_dead"), "left_anti")


def compacted(rows: DataFrame, table: str, key: str, tombstones: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write what is alive to ``path`` -> (the table from there, the tombstones of the other tables)."""
    alive(rows, table, key, tombstones).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), tombstones.filter(F.col("table") != table)


def updated(rows: DataFrame, key: str, changes: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Rows with changes (``id, field, value, at``) of allowed columns; of several changes of one cell the last counts, a null value clears it, values that don't fit the column's type are no change."""
    columns = [c for c in allowed if c in rows.columns and c != key]
    last = changes.filter(F.col("field").isin(*columns)).groupBy(F.col("id").cast("string").alias("_id"), "field").agg(F.max_by(F.struct("value"), F.struct("at", "value"))["value"].alias("value"))
    cell = lambda c: F.max(F.when(F.col("field") == c, F.struct("value"))).alias(f"_new_{c}")
    wide = last.groupBy("_id").agg(*map(cell, columns))
    joined = rows.join(wide, F.col(key).cast("string") == F.col("_id"), "left")

    def value(c: str):
        new = F.col(f"_new_{c}")
        fitted = new["value"].try_cast(rows.schema[c].dataType)
        return F.when(new.isNotNull() & (new["value"].isNull() | fitted.isNotNull()), fitted).otherwise(rows[c]).alias(c)

    return joined.select(*[value(c) if c in columns else rows[c] for c in rows.columns])


def created(rows: DataFrame, key: str, new: DataFrame) -> DataFrame:
    """Rows with the new ones; an id that is there already is not created again."""
    return rows.unionByName(new.join(rows.select(key), key, "left_anti"), allowMissingColumns=True)
