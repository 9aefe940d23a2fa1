"""Reading the input tables.

Tables are Parquet, one folder or file per table. Only the listed columns are
read, so the scan's ReadSchema holds just what a query needs.
"""
from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def _jvm_context(spark: SparkSession):
    """The JVM SparkContext of a classic session; None for a remote (Connect) one."""
    try:
        return spark.sparkContext
    except Exception:          # a Connect session has no local context
        return None


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence through Hadoop's FileSystem, so local paths and any URI
    (file:, hdfs:, s3a:, ...) are answered alike. Without a local context
    (Spark Connect) the answer comes from listing the path through the
    DataFrame API instead."""
    sc = _jvm_context(spark)
    if sc is not None:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)
    from pyspark.errors import AnalysisException
    try:
        spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
        return True
    except AnalysisException:
        return False


def table_path(base_dir: str, name: str) -> str:
    """``<dir>/<name>.parquet`` when that file or folder exists, else ``<dir>/<name>``."""
    path = os.path.join(base_dir, f"{name}.parquet")
    local = "://" not in base_dir and not base_dir.startswith("file:")
    return path if not local or os.path.exists(path) else os.path.join(base_dir, name)


# The test tables' columns that the views read, and their types.
TABLE_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
}
TABLE_TYPES = {table: dict(column.split() for column in columns.split(", ")) for table, columns in TABLE_COLUMNS.items()}


def read_table(spark: SparkSession, base_dir: str, name: str,
               columns: Sequence[str] | None = None) -> DataFrame:
    """A test table, of the fixed types where they are stated: opening it then reads no file footer on
    the driver, however many files it has and whether or not the query keeps it."""
    types = TABLE_TYPES.get(name, {})
    if columns and all(c in types for c in columns):
        schema = ", ".join(f"{c} {types[c]}" for c in columns)
        return spark.read.schema(schema).parquet(table_path(base_dir, name))
    df = spark.read.parquet(table_path(base_dir, name))
    return df.select(*columns) if columns else df


def read_entity(spark: SparkSession, path: str, schema) -> DataFrame:
    """An entity table (materials, deliveries, suppliers, links) stored as
    Parquet, with exactly the columns of its fixed schema. A table that lacks
    one of them, or has it with another type, is refused when it is opened."""
    stored = {f.name: f.dataType for f in spark.read.parquet(path).schema.fields}
    wrong = [f"{f.name} is missing" if f.name not in stored
             else f"{f.name} is {stored[f.name].simpleString()}, not {f.dataType.simpleString()}"
             for f in schema.fields if stored.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"{path}: {'; '.join(wrong)}")
    return spark.read.schema(schema).parquet(path)


def read_json_records(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON-lines records with a fixed schema (no inference pass over the data)."""
    return spark.read.schema(schema).json(path)
