"""Reading inputs and writing results. Every reader is one partitioned scan; nothing is paged."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table under root."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def read_xml_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml) of whole XML files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("xml"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of whole Markdown files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def title_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, title) of XML files, the title attribute taken from the first 512 bytes, ordered by title."""
    files = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 512).alias("head"))
    title = F.regexp_extract(F.decode("head", "ISO-8859-1"), r'title="([^"]*)"', 1)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.nullif(title, F.lit("")).alias("title")).orderBy(F.collate("title", "UNICODE"), "file")


def read_json_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of an index file `{"epis": [...]}`; a missing path is an empty index."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(f"epis array<struct<{schema}>>").json(path, multiLine=True).select(F.explode("epis").alias("r")).select("r.*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_url_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header and a URL column; rows with a blank URL are left out."""
    return spark.read.csv(path, header=True).filter(F.trim("URL") != "")


def safe_code(code: str) -> str:
    """A document code cut down to what may stand in a file name; ValueError if nothing is left."""
    import re

    out = re.sub(r"[^a-z0-9-]", "", code.lower())
    if not out:
        raise ValueError("code is required")
    return out


def load_document(spark: SparkSession, root: str, code: str, state_policy: bool = False) -> str:
    """The XML of one instrument by its code, of the state policies' folder or the local plans'; FileNotFoundError, or ValueError for other than XML."""
    from pyspark.errors import AnalysisException

    path = f"{root}/{'SEPPs' if state_policy else 'LEPs'}/{safe_code(code)}.xml"
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise FileNotFoundError(path) from e
    if row is None or "<" not in row["value"]:
        raise ValueError(f"{path} holds no XML")
    return row["value"]


def flattened(df: DataFrame, separator: str = " | ") -> DataFrame:
    """All columns as strings, arrays joined by the separator."""

    def one(name: str, kind: str) -> Column:
        c = F.col(name)
        return (F.array_join(F.transform(c, lambda x: x.cast("string")), separator) if kind.startswith("array") else c.cast("string")).alias(name)

    return df.select(*[one(*x) for x in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled, null is written as the empty text."""
    flattened(df).write.mode("overwrite").csv(path, header=True, escape='"', nullValue="", emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_table(df: DataFrame, name: str) -> None:
    """Add rows to a table, which is made if it isn't there; columns are matched by name."""
    spark = df.sparkSession
    if spark.catalog.tableExists(name):
        df = df.select(*spark.table(name).columns)
    df.write.mode("append").saveAsTable(name)


def write_markdown(df: DataFrame, path: str, key: str = "path", title: str = "title", body: str = "body") -> None:
    """A folder for each key with its sections as Markdown text: rows key, pos, title, body in order of pos."""
    item = F.struct("pos", F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), F.col(body)).alias("text"))
    whole = df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), "\n\n").alias("value"))
    whole.write.mode("overwrite").partitionBy(key).text(path, lineSep="\n\n")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, which driver and executors share; tests may leave it unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that lost executors cost no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swap_table(df: DataFrame, name: str) -> None:
    """Write a table under a new name and put it in the old one's place."""
    spark = df.sparkSession
    df.write.mode("overwrite").saveAsTable(f"{name}_new")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {name}_new RENAME TO {name}")


def columns_like(spark: SparkSession, word: str) -> DataFrame:
    """(table, column, type) of the catalogue's columns whose name holds the word."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name) if word.lower() in c.name.lower()]
    return spark.createDataFrame(rows, "table string, column string, type string")
