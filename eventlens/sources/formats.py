"""Readers and writers for event files; any URI Spark's file systems know."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Text encodings tried in this order.
ENCODINGS = ["UTF-8", "ISO-8859-1", "windows-1252"]


def detect_format(path: str) -> str:
    """Format by extension; anything unknown is CSV."""
    name = path.lower().rstrip("/")
    if name.endswith((".parquet", ".pq")):
        return "parquet"
    if name.endswith((".json", ".jsonl")):
        return "json"
    return "csv"


def _file() -> Column:
    """Path of a row's file as it is written; blanks and the like are percent-encoded in the metadata, a plus sign is not."""
    return F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))


def latin_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Files among text inputs with a line that is not valid UTF-8."""
    rows = spark.read.text(list(paths)).select(_file().alias("file"), F.is_valid_utf8("value").alias("valid"))
    return sorted(r["file"] for r in rows.where("NOT valid").select("file").distinct().collect())


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    """CSV with header: each file as UTF-8, or as Latin-1 where one of its lines is not valid UTF-8.

    Every byte is valid Latin-1, so the third encoding of the list is never reached.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
    if schema is None:
        schema = reader.option("inferSchema", True).csv(paths).schema
    broken = latin_files(spark, paths)
    whole = reader.schema(schema).csv(paths)
    if not broken:
        return whole
    latin = reader.schema(schema).option("encoding", ENCODINGS[1]).csv(paths)
    return whole.where(~_file().isin(broken)).unionByName(latin.where(_file().isin(broken)))


def is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether the text of an input starts with ``[``."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).select(F.ltrim("value").startswith("[")).first()
    return bool(first and first[0])


def read_json(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    """JSON lines; an input whose text starts with ``[`` is read as one array.

    An array of one record a line is read by byte ranges in many tasks; any other layout in one task for each file.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    arrays = [p for p in paths if is_json_array(spark, p)]
    lines = [p for p in paths if p not in arrays]
    parts = [reader.json(lines)] if lines else []
    if arrays:
        records = _array_lines(spark, arrays)
        parts.append(reader.option("multiLine", True).json(arrays) if records is None else _parsed(records, schema))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _array_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """The records of arrays as text, if every line is a bracket, a record or a record in brackets; else None."""
    text = F.trim(F.col("value"))
    opened = F.when(text.startswith("["), F.substring(text, 2, 1 << 30)).otherwise(text)
    record = F.trim(F.regexp_replace(F.regexp_replace(F.trim(opened), r"\]\s*$", ""), r",\s*$", ""))
    rows = spark.read.text(list(paths)).select(record.alias("value")).where("value <> ''")
    whole = F.col("value").startswith("{") & F.try_parse_json("value").isNotNull()
    return None if rows.where(~whole).limit(1).count() else rows


def _parsed(records: DataFrame, schema: StructType | str | None) -> DataFrame:
    """Columns of JSON records; without a schema numbers are bigint or double, and what has no single type is text."""
    if schema is None:
        found = records.agg(F.schema_of_variant_agg(F.try_parse_json("value")).alias("s")).first()["s"]
        schema = re.sub(r"DECIMAL\([^)]*\)|FLOAT", "DOUBLE", found.replace("OBJECT<", "STRUCT<"))
        schema = re.sub(r"\b(VOID|VARIANT)\b", "STRING", schema)
    return records.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_any(spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    fmt = fmt or detect_format(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    return read_json(spark, path, schema) if fmt == "json" else read_csv(spark, path, schema)


def preview(df: DataFrame, n: int, order: Sequence[str] = ()) -> DataFrame:
    """First n rows; with ``order`` the choice is repeatable."""
    return (df.orderBy(*order) if order else df).limit(n)


def read_batch(spark: SparkSession, paths: Sequence[str], prefix: str, schema: StructType | str | None = None) -> DataFrame:
    """Many inputs as one table, ``source = prefix:base name``; inputs of one layout are read by one reader.

    An input may be a file or a folder of part files. A CSV input with a line that is not UTF-8 is Latin-1, a JSON input that starts with
    ``[`` an array, whatever the others are. Columns that some inputs lack are NULL there.
    """
    def tail(path: str) -> str:
        """What the full path of an input's files holds: its own path without scheme and host."""
        return re.sub(r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", "", path.rstrip("/"))

    tails = "|".join(re.escape(t) for t in sorted({tail(p) for p in paths}, key=len, reverse=True))
    own = F.regexp_extract(_file(), f"({tails})(?:/|$)", 1)
    tables = [p for p in paths if detect_format(p) == "csv"]
    latin = latin_files(spark, tables) if tables else []
    groups: dict[tuple, list[str]] = {}
    for path in paths:
        fmt, key = detect_format(path), re.compile(re.escape(tail(path)) + "(/|$)")
        if fmt == "csv":
            layout = ENCODINGS[1] if any(key.search(f) for f in latin) else ENCODINGS[0]
        else:
            layout = fmt == "json" and is_json_array(spark, path)
        groups.setdefault((fmt, layout), []).append(path)
    parts = []
    for (fmt, layout), some in groups.items():
        reader = spark.read if schema is None else spark.read.schema(schema)
        if fmt == "csv":
            reader = reader.option("header", True).option("escape", '"').option("encoding", layout)
        elif fmt == "json":
            reader = reader.option("multiLine", layout)
        part = reader.format(fmt).load(some)
        name = F.regexp_replace(F.regexp_extract(own, "[^/]*$", 0), r"\.[^.]*$", "")
        parts.append(part.withColumn("source", F.concat(F.lit(f"{prefix}:"), name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_result(df: DataFrame, path: str, fmt: str) -> None:
    """csv, json or parquet; every task writes its own file."""
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        # Keep NULL fields, so that every record shows all columns.
        writer.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")
