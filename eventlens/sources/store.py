"""The event table on files: append, scan, delete, catalog, ingest log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from eventlens.functions.predicates import filter_view

PARTITIONS = ["source", "day"]


def conform(df: DataFrame, columns: Sequence[str], source: str | None = None) -> DataFrame:
    """Known columns only; ``source`` stamped when given."""
    out = df.select(*[c for c in columns if c in df.columns])
    return out.withColumn("source", F.lit(source)) if source else out


def append_events(df: DataFrame, path: str) -> None:
    """Append, partitioned by source and day.

    Adaptive execution deals the rows by their measured bytes: small (source, day) pairs share a task and get one file
    each, a hot pair is split over as many tasks as its size asks for (``spark.sql.adaptive.advisoryPartitionSizeInBytes``).
    """
    rows = df.withColumn("day", F.to_date("ts"))
    dealt = df.sparkSession.sql("SELECT /*+ REBALANCE(source, day) */ * FROM {rows}", rows=rows)
    dealt.write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path).drop("day")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The table with its sources as text, also where a folder's name looks like a number."""
    found = spark.read.parquet(path).schema
    fields = [StructField(f.name, StringType()) if f.name == "source" else f for f in found.fields]
    return spark.read.schema(StructType(fields)).parquet(path)


def scan_range(df: DataFrame, start: str, end: str, source: str | None = None) -> DataFrame:
    """Both ends inclusive; the conditions reach the file scan."""
    rows = df.where(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return rows.where(F.col("source") == source) if source else rows


def query_events(df: DataFrame, attributes: Mapping[str, str], start: str | None, end: str | None, limit: int) -> DataFrame:
    """Equality on identity columns, time range, first ``limit`` rows by time."""
    for name, value in attributes.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    if start:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return df.orderBy("ts", "event_id").limit(limit)


def advanced_query(
    df: DataFrame, where: Sequence[Mapping], select: Sequence[str], sort: Sequence[tuple[str, str]],
    offset: int, limit: int,
) -> DataFrame:
    """Filter, order, page, then project."""
    rows = filter_view(df, where)
    order = [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in sort if c in df.columns]
    page = rows.orderBy(*order, "ts", "event_id").offset(offset).limit(limit)
    return page.select(*[c for c in select if c in df.columns]) if select else page


def delete_source(spark: SparkSession, path: str, source: str) -> int:
    """Remove one source; returns the rows removed.

    Rows of a source live in their own partitions, so an overwrite limited to
    those partitions never touches other sources.
    """
    return _delete(spark, _stored(spark, path).where(F.col("source") == source))


def delete_all(spark: SparkSession, path: str) -> int:
    """Remove every source; returns the rows removed."""
    return _delete(spark, _stored(spark, path))


def _delete(spark: SparkSession, doomed: DataFrame) -> int:
    """Folders are taken from the rows' own files: Spark escapes some characters of a name.

    A source goes by one delete of its folder, so a failure in between leaves whole sources; the same call again ends the
    work and counts what it removed itself. Readers that started before may fail on files that are gone.
    """
    folder = F.regexp_extract(F.col("_metadata.file_path"), "^(.*/source=[^/]*)/", 1)
    folders = doomed.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n")).collect()
    jvm = spark.sparkContext._jvm
    for row in folders:
        partition = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row["folder"]))
        if not partition.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(partition, True):
            raise OSError(f"could not delete {row['folder']}")
    return sum(row["n"] for row in folders)


def source_counts(df: DataFrame) -> DataFrame:
    """Rows that deleting each source, or all of them, would remove."""
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("rows_removed"))


def source_catalog(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts")
    ).orderBy(F.desc("row_count"), "source")


#: Most keys that ``flatten_meta`` turns into columns by itself.
MAX_META_KEYS = 2000


def meta_keys(df: DataFrame, meta: str = "meta") -> list[str]:
    """All top-level keys of the JSON objects in a column, in order; each task passes on a key once."""
    found = df.select(F.explode(F.json_object_keys(meta)).alias("key")).distinct().orderBy("key").limit(MAX_META_KEYS + 1)
    keys = [r["key"] for r in found.collect()]
    if len(keys) > MAX_META_KEYS:
        raise ValueError(f"more than {MAX_META_KEYS} keys in {meta}: list the wanted ones")
    return keys


def flatten_meta(df: DataFrame, keys: Sequence[str] | None = None, meta: str = "meta") -> DataFrame:
    """JSON keys as text columns, by default all that occur; a standard column of that name wins.

    The object is parsed once; nested values stay JSON text, text that is no object has no keys.
    """
    keys = meta_keys(df, meta) if keys is None else keys
    parsed = F.from_json(meta, "map<string,string>")
    columns = {}
    for key in keys:
        value = F.try_element_at(F.col("__meta"), F.lit(key))
        columns[key] = F.coalesce(F.col(f"`{key}`").cast("string"), value) if key in df.columns else value
    return df.withColumn("__meta", parsed).withColumns(columns).drop("__meta") if columns else df


def parse_legs(legs: Column) -> Column:
    """Whole legs of a JSON list, each a variant; NULL for text that is no list."""
    return F.try_variant_get(F.try_parse_json(legs), "$", "array<variant>")


def explode_legs(df: DataFrame, legs: str = "legs") -> DataFrame:
    """One row per leg, with all its keys as JSON in ``leg``; events without legs keep one row with NULL leg fields."""
    rows = df.select("event_id", F.posexplode_outer(parse_legs(F.col(legs))).alias("leg_no", "leg"))

    def part(key: str):
        return F.try_variant_get("leg", f"$.{key}", "string")

    return rows.select("event_id", "leg_no", part("origin").alias("leg_origin"), part("dest").alias("leg_dest"), F.to_json("leg").alias("leg"))


# Accepted names per field of raw travel rows, in order.
TRAVEL_ALIASES = {
    "timestamp": ["ts", "timestamp", "time", "date", "datetime", "event_ts"],
    "etype": ["event_type", "etype", "type"],
    "user_id": ["user_id", "user"],
    "account_id": ["account_id", "account"],
    "device_id": ["device_id", "device"],
    "ip": ["ip", "ip_addr"],
    "geo_lat": ["geo_lat", "lat"],
    "geo_lon": ["geo_lon", "lon"],
}
TRAVEL_META = [
    "pnr", "tkt_number", "carrier", "origin", "dest", "dep_time", "arr_time", "pos_country", "issue_country",
    "card_country", "advance_hours", "stay_nights", "office_id", "user_sign", "organization", "card_hash",
]


def load_travel_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Raw text rows -> typed payload; travel fields go to ``meta`` as JSON."""

    def pick(names: Sequence[str]):
        cols = [F.when(F.col(n).cast("string") != "", F.col(n).cast("string")) for n in names if n in df.columns]
        return F.coalesce(*cols, F.lit(None).cast("string"))

    def text(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")

    def whole(name: str):
        number = F.col(name).cast("string").try_cast("double") if name in df.columns else F.lit(None).cast("double")
        return number.cast("bigint")

    meta = [(whole(n) if n in ("advance_hours", "stay_nights") else text(n)).alias(n) for n in TRAVEL_META]
    legs = parse_legs(text("legs")).alias("legs")
    return df.select(
        *keep,
        F.coalesce(pick(TRAVEL_ALIASES["timestamp"]), F.lit("")).alias("timestamp"),
        F.coalesce(pick(TRAVEL_ALIASES["etype"]), F.lit("event")).alias("etype"),
        *[F.coalesce(pick(TRAVEL_ALIASES[n]), F.lit("")).alias(n) for n in ("user_id", "account_id", "device_id", "ip")],
        pick(TRAVEL_ALIASES["geo_lat"]).try_cast("double").alias("geo_lat"),
        pick(TRAVEL_ALIASES["geo_lon"]).try_cast("double").alias("geo_lon"),
        text("country").alias("country"), text("city").alias("city"),
        F.coalesce(text("amount").try_cast("double"), F.lit(0.0)).alias("amount"),
        F.to_json(F.struct(*meta, legs)).alias("meta"),
    )


# --- entities and links ---------------------------------------------------------

# Which entity type a bare key resolves to first.
TYPE_PRIORITY = ["USER", "ACCOUNT", "DEVICE", "CARD", "IP"]


def upsert_entities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(type, key, props): the last incoming props win; others stay."""
    latest = incoming.groupBy("type", "key").agg(F.max_by("props", "seq").alias("props"))
    untouched = existing.join(latest, ["type", "key"], "left_anti")
    return untouched.select("type", "key", "props").unionByName(latest)


def resolve_links(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Keys replaced by entity ids, by type priority; links with an unknown end drop."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TYPE_PRIORITY]), F.col("type"))
    best = entities.groupBy("key").agg(F.min_by("id", F.struct(rank, "id")).alias("id"))
    source = best.select(F.col("key").alias("src_key"), F.col("id").alias("src_id"))
    target = best.select(F.col("key").alias("dst_key"), F.col("id").alias("dst_id"))
    return links.join(source, "src_key").join(target, "dst_key").select("src_id", "dst_id", "relation")


# --- ingest log ------------------------------------------------------------------

def append_logged(checked: DataFrame, path: str, sources: Sequence[str]) -> DataFrame:
    """Append the accepted rows of checked ones and return the log of the load: per source total, ingested, rejected and warning rows.

    The counts are observed on the write itself, so the input is read once. ``sources`` names the sources of the load; rows of others
    count under a NULL source.
    """
    keys = [*dict.fromkeys(sources), None]
    listed = F.coalesce(F.col("source").isin(*keys[:-1]), F.lit(False)) if keys[:-1] else F.lit(False)
    metrics = []
    for i, source in enumerate(keys):
        here = ~listed if source is None else F.col("source").eqNullSafe(F.lit(source))
        metrics += [F.count_if(here & test).alias(f"{name}{i}") for name, test in (
            ("total", F.lit(True)), ("ingested", ~F.col("rejected")), ("rejected", F.col("rejected")), ("warning", F.col("warned")))]
    seen = Observation()
    append_events(checked.observe(seen, *metrics).where("NOT rejected").drop("issues", "rejected", "warned"), path)
    got = seen.get
    rows = [(source, *(got[f"{name}{i}"] for name in ("total", "ingested", "rejected", "warning"))) for i, source in enumerate(keys)]
    return checked.sparkSession.createDataFrame(
        [r for r in rows if r[1]], "source string, total_rows bigint, ingested_rows bigint, rejected_rows bigint, warning_rows bigint")


def ingest_log(checked: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Per load: total, ingested, rejected and warning rows."""
    return checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(~F.col("rejected")).alias("ingested_rows"),
        F.count_if("rejected").alias("rejected_rows"), F.count_if("warned").alias("warning_rows"),
    )


def ingest_history(log: DataFrame) -> DataFrame:
    """Per source: rows ever ingested and the latest mapping."""
    return log.groupBy("source").agg(
        F.sum("ingested_rows").alias("total_ingested"), F.max_by("mapping", "started_at").alias("latest_mapping")
    )
