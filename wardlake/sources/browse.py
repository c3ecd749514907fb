"""What can be read: schemas, tables and columns as rows; result and audit export."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.functions.idents import check_name
from wardlake.operators.scope import enforce
from wardlake.session import prepare


def list_schemas(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW SCHEMAS").toDF("schema_name")


def list_tables(spark: SparkSession, schema: str | None = None) -> DataFrame:
    where = "" if schema is None else f" IN `{check_name(schema, 'schema')}`"
    return spark.sql(f"SHOW TABLES{where}").select("namespace", F.col("tableName").alias("table_name"))


def list_columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column of the named tables, in column order."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (table, position, name, kind)
        for table, df in tables.items()
        for position, (name, kind) in enumerate(df.dtypes)
    ]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")


def profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, column_name, records, nulls`` of every column, counted in one pass over each table."""

    def one(name: str, df: DataFrame) -> DataFrame:
        counts = [F.struct(F.lit(c).alias("column_name"), F.count(F.col(f"`{c}`")).alias("filled")) for c in df.columns]
        row = df.agg(F.count("*").alias("records"), F.array(*counts).alias("columns"))
        return row.select(F.lit(name).alias("table_name"), "records", F.explode("columns").alias("c")).select(
            "table_name", "c.column_name", "records", (F.col("records") - F.col("c.filled")).alias("nulls")
        )

    return reduce(DataFrame.unionByName, [one(name, df) for name, df in tables.items()])


def register(tables: Mapping[str, DataFrame]) -> None:
    """Make tables readable by name with ``spark.sql``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(check_name(name, "table"))


def governed_session(
    spark: SparkSession,
    tables: Mapping[str, Callable[[SparkSession], DataFrame]],
    grants: Callable[[SparkSession], DataFrame],
) -> SparkSession:
    """A session whose only tables are ``tables``, each cut to the rows that ``grants`` cover.

    Tables and grants are given as readers, so that they belong to the new session. It shares
    no views with others, and files cannot be named in its SQL.
    """
    own = prepare(spark.newSession())
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    held = grants(own)
    register({name: enforce(read(own), held) for name, read in tables.items()})
    return own


def governed_sql(session: SparkSession, query: str, **parameters) -> DataFrame:
    """Free SQL in such a session; values come as ``:name`` parameters, never as text.

    The text is taken as a subquery, so it can only read.
    """
    return session.sql(f"SELECT * FROM (\n{query}\n)", args=parameters)


def as_json(df: DataFrame, name: str = "record") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def export_json(df: DataFrame, path: str, newest_first: list[Column] | None = None, limit: int | None = None) -> None:
    """Write rows as JSON lines, newest first when limited."""
    rows = df if newest_first is None else df.orderBy(*newest_first)
    rows = rows if limit is None else rows.limit(limit)
    rows.write.mode("overwrite").json(path)
