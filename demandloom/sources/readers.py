"""Readers: CSV, JDBC, Kafka, landed JSON pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.functions import name_col
from demandloom.operators.relational import scan

KAFKA_DEFAULTS = {"startingOffsets": "earliest"}


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    encoding: str = "utf-8",
    parse_dates: Sequence[str] | None = None,
    usecols: Sequence[str] | None = None,
    schema: str | T.StructType | None = None,
) -> DataFrame:
    """A headed CSV file or folder. Give ``schema`` for large inputs: inference reads them twice."""
    reader = spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding)
    reader = reader.option("quote", '"').option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    if usecols is not None:
        df = df.select(*[name_col(c) for c in usecols])
    for c in parse_dates or []:
        df = df.withColumn(c, F.try_to_timestamp(name_col(c).cast("string")))
    return df


def jdbc_options(
    uri: str,
    table: str,
    partition_column: str | None = None,
    lower: Any = None,
    upper: Any = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options; with a partition column the table is read by ``partitions`` tasks."""
    options = {"url": uri, "dbtable": table, "fetchsize": str(fetch_size)}
    if partition_column:
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(
    spark: SparkSession,
    uri: str,
    table: str,
    filters: Mapping[str, Any] | None = None,
    columns: Sequence[str] | None = None,
    **partitioning: Any,
) -> DataFrame:
    """A relational table; the filters and the projection are pushed into the database."""
    reader = spark.read.format("jdbc").options(**jdbc_options(uri, table, **partitioning))
    return scan(reader.load(), filters, columns)


def kafka_options(topic: str, servers: str, max_messages: int | None = None) -> dict[str, str]:
    """``max_messages`` bounds a micro-batch; by default a batch takes all there is."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": KAFKA_DEFAULTS["startingOffsets"],
    }
    return options | ({"maxOffsetsPerTrigger": str(max_messages)} if max_messages else {})


def read_kafka_json(
    spark: SparkSession,
    topic: str,
    servers: str,
    schema: str | T.StructType,
    max_messages: int | None = None,
    malformed_col: str | None = None,
) -> DataFrame:
    """A streaming frame of the JSON message values of a topic."""
    raw = spark.readStream.format("kafka").options(**kafka_options(topic, servers, max_messages)).load()
    return parse_json_values(raw, schema, malformed_col=malformed_col)


def parse_json_values(raw: DataFrame, schema: str | T.StructType, value_col: str = "value", malformed_col: str | None = None) -> DataFrame:
    """The ``value`` column as JSON of the given schema, one column per field.

    Messages that do not parse are rows of NULLs. With ``malformed_col`` their text is in a column of
    that name, which is NULL for all others, so they can be told apart and kept as dead letters.
    """
    ddl = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    text = name_col(value_col).cast("string")
    if malformed_col is None:
        return raw.select(F.from_json(text, ddl).alias("v")).select("v.*")
    wide = T.StructType([*ddl.fields, T.StructField(malformed_col, T.StringType())])
    return raw.select(F.from_json(text, wide, {"columnNameOfCorruptRecord": malformed_col}).alias("v")).select("v.*")


def read_json_path(
    spark: SparkSession,
    path: str,
    json_path: str | None = None,
    schema: str | T.StructType | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Landed JSON documents: walk a dotted path; a list there gives rows, an object one row.

    One document per line, which can be split among tasks; ``multi_line`` for one per file.
    """
    reader = spark.read.option("multiLine", multi_line)
    if schema is not None:
        reader = reader.schema(schema)
    return rows_at(reader.json(path), json_path)


def rows_at(df: DataFrame, json_path: str | None) -> DataFrame:
    """The records found under a dotted path of nested columns."""
    if not json_path:
        return df
    found = df.select(F.col(json_path).alias("record"))
    if isinstance(found.schema["record"].dataType, T.ArrayType):
        found = found.select(F.explode("record").alias("record"))
    if isinstance(found.schema["record"].dataType, T.StructType):
        return found.select("record.*")
    return found


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested objects as columns named ``outer.inner``; lists stay as they are."""

    def walk(fields, column, prefix):
        for f in fields:
            name = f"{prefix}{sep}{f.name}" if prefix else f.name
            value = name_col(f.name) if column is None else column.getField(f.name)
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType.fields, value, name)
            else:
                yield value.alias(name)

    return df.select(*walk(df.schema.fields, None, ""))
