"""Tables of other databases, read in ranges of a key with filters pushed down to them; and copies that can be proven.

A database is reached through a Python module of the common database interface, by each task for itself. What is read is whatever
`SELECT ... WHERE` says there: the range of the partition and the filters that the query puts on plain columns.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH = 10_000
_COMPARED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class DatabaseReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names, self.schema = options, schema.names, schema
        self.conditions: list[tuple[str, list]] = []

    def pushFilters(self, filters: list) -> Iterator:
        """Takes comparisons, lists and nulls of plain columns; what it can't take is left to Spark. Comparisons with null find nothing on either side."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name not in self.names:
                yield f
            elif type(f) in _COMPARED and isinstance(f.value, (int, float, str)):
                self.conditions.append((f"{_quoted(name)} {_COMPARED[type(f)]} ?", [f.value]))
            elif isinstance(f, ds.In) and len(f.value) <= 500 and all(isinstance(v, (int, float, str)) for v in f.value):
                self.conditions.append((f"{_quoted(name)} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            elif isinstance(f, (ds.IsNull, ds.IsNotNull)):
                self.conditions.append((f"{_quoted(name)} IS {'NOT ' * isinstance(f, ds.IsNotNull)}NULL", []))
            else:
                yield f

    def partitions(self) -> list[ds.InputPartition]:
        """Ranges of the key from below the lower to above the upper bound, so that no row is left out whatever the bounds; null keys are in the first."""
        low, high, n = int(self.options["lower"]), int(self.options["upper"]), max(1, int(self.options.get("ranges", 8)))
        cuts = sorted({low + (high - low) * k // n for k in range(1, n)})
        return [ds.InputPartition(x) for x in zip([None, *cuts], [*cuts, None])]

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        low, high = partition.value
        key, conditions = _quoted(self.options["key"]), list(self.conditions)
        if low is not None:
            conditions.append((f"{key} >= ?", [low]))
        if high is not None:
            conditions.append((f"({key} < ?{f' OR {key} IS NULL' if low is None else ''})", [high]))
        where = " AND ".join(c for c, _ in conditions) or "1 = 1"
        module = importlib.import_module(self.options["module"])
        connection = module.connect(*json.loads(self.options["connect"]))
        try:
            cursor = connection.cursor()
            cursor.execute(f"SELECT {', '.join(map(_quoted, self.names))} FROM {_quoted(self.options['table'])} WHERE {where}", [v for _, values in conditions for v in values])
            from pyspark.sql.pandas.types import to_arrow_schema

            schema = to_arrow_schema(self.schema)
            while rows := cursor.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        finally:
            connection.close()


class DatabaseSource(ds.DataSource):
    """Options: module (of the database interface), connect (its arguments, as a JSON list), table, key (a whole number), lower, upper, ranges."""

    @classmethod
    def name(cls) -> str:
        return "database_table"

    def reader(self, schema: StructType) -> DatabaseReader:
        return DatabaseReader(dict(self.options), schema)


def read_database(spark: SparkSession, module: str, connect: list, name: str, schema: str, key: str, lower: int, upper: int, ranges: int = 8) -> DataFrame:
    """A database's table in `ranges` ranges of its key. The bounds only say how to cut: rows beyond them are read, too."""
    spark.dataSource.register(DatabaseSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("database_table").schema(schema).options(module=module, connect=json.dumps(connect), table=name, key=key, lower=lower, upper=upper, ranges=ranges).load()


def _told(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """(part, n, keys, sum, mixed) of rows by a hash of the key: how many, how many keys, and two checksums over all columns by name."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in sorted(rows.columns)]
    told = rows.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), F.col(key).alias("_key"), F.xxhash64(*columns).alias("_h"))
    # a key's rows first, so that counting keys needs no sets
    by_key = told.groupBy("part", "_key").agg(F.count("*").alias("n"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("s"), F.bit_xor("_h").alias("x"))
    return by_key.groupBy("part").agg(F.sum("n").alias("n"), F.count("*").alias("keys"), F.sum("s").alias("sum"), F.bit_xor("x").alias("mixed"))


def manifest(source: DataFrame, copy: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """(part, source_n, copy_n, source_keys, copy_keys, same): for each part of the keys whether a copy has just the source's rows."""
    a, b = _told(source, key, parts), _told(copy.select(*source.columns), key, parts)
    names = ["n", "keys", "sum", "mixed"]
    both = a.select("part", *[F.col(c).alias(f"source_{c}") for c in names]).join(b.select("part", *[F.col(c).alias(f"copy_{c}") for c in names]), "part", "full")
    same = F.lit(True)
    for c in names:
        same = same & F.col(f"source_{c}").eqNullSafe(F.col(f"copy_{c}"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("part", n("source_n"), n("copy_n"), n("source_keys"), n("copy_keys"), same.alias("same"))


def copy_table(source: DataFrame, path: str, key: str, parts: int = 64, only: list[int] | None = None) -> DataFrame:
    """Copy rows to path in parts by a hash of the key, and give the manifest of what was copied.

    A part is written as a whole and takes the place of what was there, so a run that failed or is repeated leaves no row twice; with `only`, just these
    parts are written, as after a manifest that found some that differ.
    """
    rows = source.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    rows = rows if only is None else rows.filter(F.col("_part").isin(only))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)
    return manifest(source, source.sparkSession.read.parquet(path), key, parts)
