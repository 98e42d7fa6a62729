"""Sources, plans, streaming and session behaviour."""

import datetime as dt
import json
from pathlib import Path

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from eventlens import registry, session
from eventlens.catalog import streams
from eventlens.operators import profile
from eventlens.plans.steps import run_steps
from eventlens.plans.views import Views, select_sql
from eventlens.sources import formats, store
from eventlens.streaming import jobs

ROOT = Path(__file__).resolve().parent.parent


class FakeSession:
    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"app-{master}"})


def test_scratch_folder_comes_from_the_session():
    assert session.scratch_root(FakeSession("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(FakeSession("yarn"))
    local = FakeSession("local[2]")
    assert session.scratch_root(local) == session.scratch_root(local)
    assert session.scratch_path(local, "x") != session.scratch_path(local, "x")


def test_no_single_machine_shortcuts_in_the_library():
    text = "\n".join(p.read_text() for p in (ROOT / "eventlens").rglob("*.py"))
    assert "localCheckpoint" not in text and ".crossJoin(" not in text and ".rdd" not in text


def test_formats_by_extension():
    names = {"a.parquet": "parquet", "b.PQ": "parquet", "c.json": "json", "d.jsonl": "json", "e.csv": "csv", "f": "csv"}
    assert {n: formats.detect_format(n) for n in names} == names


def test_csv_encodings_and_json_shapes(spark, tmp_path):
    (tmp_path / "u.csv").write_text("name,n\nZoë,1\n", encoding="utf-8")
    (tmp_path / "l.csv").write_bytes("name,n\nZoë,1\n".encode("latin-1"))
    for name in ("u.csv", "l.csv"):
        assert formats.read_any(spark, f"{tmp_path}/{name}").first().name == "Zoë"
    (tmp_path / "a.json").write_text('[{"x": 1},\n {"x": 2}]')
    (tmp_path / "l.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    for name in ("a.json", "l.jsonl"):
        assert rows(formats.read_any(spark, f"{tmp_path}/{name}")) == [(1,), (2,)]


def test_batch_load_names_sources_by_file(spark, tmp_path):
    for name, n in (("one.csv", 2), ("two.csv", 3)):
        (tmp_path / name).write_text("x\n" + "1\n" * n)
    out = formats.read_batch(spark, [f"{tmp_path}/one.csv", f"{tmp_path}/two.csv"], "up", "x int")
    assert rows(out.groupBy("source").count()) == [("up:one", 2), ("up:two", 3)]


def test_append_then_delete_touches_one_source(spark, events, tmp_path):
    path = f"{tmp_path}/store"
    store.append_events(events.select("event_id", "ts", "source"), path)
    n = events.where("source = 'web_events'").count()
    assert store.delete_source(spark, path, "web_events") == n
    assert store.delete_source(spark, path, "web_events") == 0
    assert store.read_events(spark, path).count() == events.count() - n


def test_append_splits_a_hot_day_by_size_and_gathers_small_ones(spark, tmp_path):
    day = F.when(F.col("id") < 300_000, 0).otherwise(F.col("id") % 10 + 1).cast("int")
    df = spark.range(0, 300_100, 1, 16).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(day.cast("long") * 86_400).alias("ts"), F.lit("web").alias("source"),
        F.sha2(F.col("id").cast("string"), 256).alias("note"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "1m")
    try:
        store.append_events(df, f"{tmp_path}/hot")
    finally:
        spark.conf.set(size, before)
    files = {folder.name: len(list(folder.glob("*.parquet"))) for folder in (tmp_path / "hot" / "source=web").iterdir() if folder.is_dir()}
    assert files.pop("day=1970-01-01") > 8 and set(files.values()) == {1} and len(files) == 10
    assert store.read_events(spark, f"{tmp_path}/hot").distinct().count() == 300_100


def test_cleared_scratch_leaves_other_applications(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    other = tmp_path / "eventlens" / "other" / "x"
    other.mkdir(parents=True)
    assert session.materialize(spark.range(3), "some").count() == 3
    assert session.clear_scratch(spark) and not session.clear_scratch(spark)
    assert other.exists() and not Path(session.scratch_folder(spark)).exists()


def test_scan_prunes_partitions_and_columns(spark, events, tmp_path):
    path = f"{tmp_path}/pruned"
    store.append_events(events.select("event_id", "ts", "source", "user_id", "amount"), path)
    scan = store.scan_range(store.read_events(spark, path), "2024-01-05", "2024-01-06", "auth_events").select("event_id")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "source" in plan.split("PartitionFilters")[1] and "amount" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("plan,columns", [
    ([], ["id", "country", "amount"]),
    ([{"type": "filter", "config": {"conditions": [{"field": "country", "op": "eq", "value": "FR"}, {"field": "amount", "op": "gt", "value": 100}]}}], ["id", "country", "amount"]),
    ([{"type": "aggregate", "config": {"group_by": ["country"], "aggregations": [{"func": "count", "field": "*", "alias": "n"}]}}], ["country", "n"]),
    ([{"type": "select", "config": {"columns": [{"field": "id", "alias": "key"}]}}, {"type": "distinct", "config": {}}], ["key"]),
    ([{"type": "union", "config": {"tables": ["t", "missing"]}}, {"type": "drop", "config": {"columns": ["country"]}}], ["id", "amount"]),
])
def test_step_lists(spark, plan, columns):
    t = spark.createDataFrame([(1, "FR", 150.0), (2, "DE", 50.0)], "id int, country string, amount double")
    out = run_steps([{"type": "source", "config": {"table": "t"}}, *plan], {"t": t})
    assert out.columns == columns and out.count() >= 1


def test_step_lists_start_with_a_source(spark):
    with pytest.raises(ValueError, match="source"):
        run_steps([{"type": "limit", "config": {"count": 1}}], {})


def test_only_select_is_allowed(spark):
    for text in ("DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO x VALUES (1)"):
        with pytest.raises(ValueError):
            select_sql(spark, text)
    assert select_sql(spark, "SELECT :v AS v", {"v": "a' OR 1=1"}).first().v == "a' OR 1=1"


def test_materialized_view_changes_on_refresh_only(spark, tmp_path):
    path = f"{tmp_path}/src"
    spark.range(3).write.parquet(path)
    views = Views(spark, {"src": spark.read.parquet(path)})
    plan = [{"type": "source", "config": {"table": "src"}}]
    views.create("kept", plan, materialized=True)
    views.create("top", [{"type": "source", "config": {"table": "kept"}}, {"type": "limit", "config": {"count": 10}}])
    spark.range(2).write.mode("append").parquet(path)
    views.sources["src"] = spark.read.parquet(path)
    assert spark.table("kept").count() == 3 and views.refresh("kept").count() == 5
    assert views.lineage("top") == ["src"]


# --- streaming --------------------------------------------------------------------

def write_parts(spark, path, parts):
    schema = "event_id bigint, ts timestamp, user_id string"
    for i, part in enumerate(parts):
        data = [(e, dt.datetime.fromisoformat(t), u) for e, t, u in part]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{path}/p")
        if i == 0:
            out_schema = spark.read.parquet(f"{path}/p").schema
    return out_schema


def test_layouts_are_found_for_each_input(spark, tmp_path):
    """Multi-line arrays, arrays of one record a line, lines, two encodings, equal base names."""
    texts = {
        "a/x.json": '[\n  {"n": 1,\n   "t": "[{\\"}]"},\n  {"n": 2, "t": null}\n]\n', "b/x.json": '{"n": 3, "t": "c"}\n{"n": 4, "t": "d"}\n',
        "c/y.json": '[{"n": 5, "t": "e"},\n{"n": 6, "t": "f,]"}]', "a/z.csv": "n,t\n7,Zoë\n".encode("latin-1"), "b/z.csv": "n,t\n8,Zoë\n"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    out = formats.read_batch(spark, [f"{tmp_path}/{n}" for n in texts], "up", "n int, t string")
    assert rows(out, "n", "t", "source") == [
        (1, '[{"}]', "up:x"), (2, None, "up:x"), (3, "c", "up:x"), (4, "d", "up:x"), (5, "e", "up:y"), (6, "f,]", "up:y"), (7, "Zoë", "up:z"), (8, "Zoë", "up:z")]
    both = formats.read_json(spark, [f"{tmp_path}/{n}" for n in ("a/x.json", "b/x.json", "c/y.json")])
    assert rows(both, "n") == [(i,) for i in range(1, 7)]
    assert rows(formats.read_json(spark, f"{tmp_path}/c/y.json")) == [(5, "e"), (6, "f,]")]


def test_an_array_is_read_in_parts(spark, tmp_path):
    lines = [json.dumps({"n": i, "t": "x" * 200}) for i in range(20_000)]
    (tmp_path / "big.json").write_text("[\n" + ",\n".join(lines) + "\n]\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        out = formats.read_json(spark, f"{tmp_path}/big.json", "n int, t string")
        assert out.rdd.getNumPartitions() > 3 and out.agg(F.count("n"), F.sum("n")).first()[:] == (20_000, sum(range(20_000)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_too_many_keys_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(store, "MAX_META_KEYS", 2)
    df = spark.createDataFrame([(i, json.dumps({f"k{i}": i})) for i in range(3)] + [(9, "no json"), (10, None)], "event_id long, meta string")
    assert store.flatten_meta(df.where("event_id <> 0")).columns == ["event_id", "meta", "k1", "k2"]
    with pytest.raises(ValueError, match="keys"):
        store.flatten_meta(df)


def test_profile_counts_exactly_on_request(spark):
    df = spark.range(100_000).select("id", F.when(F.col("id") % 2 == 0, "").alias("t"))
    exact, near = ({r.column: r for r in profile.profile_columns(df, exact=e, width=3).collect()} for e in (True, False))
    assert exact["id"].uniques == 100_000 and abs(near["id"].uniques - 100_000) < 2_000
    assert exact["t"].uniques == near["t"].uniques == 1 and exact["id"].samples == "0|1|10|100|100"


def test_late_rows_are_dropped(spark, tmp_path):
    schema = write_parts(spark, tmp_path, [
        [(1, "2024-01-01T00:10:00", "u"), (2, "2024-01-01T05:00:00", "u")],
        [(3, "2024-01-01T05:10:00", "u")],
        [(4, "2024-01-01T00:20:00", "u"), (5, "2024-01-01T05:30:00", "u")],
    ])
    stream = jobs.open_stream(spark, str(tmp_path), "p", schema, files_per_batch=1)
    out = jobs.latest(jobs.run_to_table(jobs.tumbling_counts(stream), "late", "update"), ["bucket", "user_id"])
    # Event 4 is more than ten minutes behind event 2, whose batch was closed before.
    assert [n for *_, n in rows(out, "bucket", "user_id", "rows")] == [1, 3]


def test_running_mean_over_several_batches_equals_one(spark, tmp_path):
    parts = [[(10 * i + j, f"2024-01-{1 + i:02d}T{3 * j:02d}:00:01", f"u{j % 2}") for j in range(6)] for i in range(4)]
    schema = write_parts(spark, tmp_path, parts)
    tables = [jobs.run_to_table(jobs.online_ewma(jobs.open_stream(spark, str(tmp_path), "p", schema, n)), f"mean{n}", "update") for n in (1, None)]
    many, one = (jobs.latest(t, ["user_id", "bucket"]).withColumns({c: F.round(c, 12) for c in ("mu", "spread", "z")}) for t in tables)
    assert rows(many) == rows(one) and one.count() == 24
    # Each bucket is closed once at most; the last ones stay open and come out all the same.
    closed = tables[0].where("closed").groupBy("user_id", "bucket").count()
    assert closed.where("count > 1").count() == 0 and 0 < closed.count() < 24
    plain = {}
    for user in ("u0", "u1"):
        hours = {dt.datetime.fromisoformat(t).replace(minute=0, second=0, tzinfo=dt.UTC).timestamp() for p in parts for _, t, u in p if u == user}
        mu = spread = None
        for hour in range(int(min(hours)), int(max(hours)) + 1, 3600):
            x = float(hour in hours)
            mu = x if mu is None else 0.8 * mu + 0.2 * x
            spread = 0.0 if spread is None else 0.8 * spread + 0.2 * abs(x - mu)
            if x:
                plain[user, hour] = (mu, spread, (x - mu) / (1.4826 * (spread + 1e-6)))
    got = {(r.user_id, r.bucket): (r.mu, r.spread, r.z) for r in one.collect()}
    assert got.keys() == plain.keys() and all(abs(a - b) < 1e-6 for k in got for a, b in zip(got[k], plain[k], strict=True))


def test_buckets_come_out_while_none_has_closed(spark, tmp_path):
    schema = write_parts(spark, tmp_path, [[(1, "2024-01-01T00:10:00", "u"), (2, "2024-01-01T00:20:00", "u"), (3, "2024-01-01T00:30:00", None)]])
    out = jobs.run_to_table(jobs.online_ewma(jobs.open_stream(spark, str(tmp_path), "p", schema)), "open", "update")
    assert rows(out, "user_id", "rows", "mu", "closed") == [("u", 2, 2.0, False), (None, 1, 1.0, False)]


def test_late_rows_are_counted(spark, tmp_path):
    schema = write_parts(spark, tmp_path, [
        [(1, "2024-01-01T00:10:00", "u"), (2, "2024-01-01T05:00:00", "u")], [(3, "2024-01-01T05:10:00", "u")],
        [(4, "2024-01-01T00:20:00", "u"), (5, "2024-01-01T00:21:00", "u"), (6, "2024-01-01T05:30:00", "u")]])
    out = jobs.late_counts(jobs.open_stream(spark, str(tmp_path), "p", schema, files_per_batch=1))
    assert rows(out, "batch_id", "input_rows", "late_rows") == [(0, 2, 0), (1, 1, 0), (2, 3, 2)]


def test_first_seen_forgets_idle_pairs(spark, tmp_path):
    """Ten users, each on a day of its own; pairs idle for two days leave the state and would be new again."""
    days = [[(i, f"2024-01-{1 + i:02d}T00:00:00", f"u{i}")] for i in range(10)] + [[(99, "2024-01-11T00:00:00", "u0")]]
    schema = write_parts(spark, tmp_path, days)
    listener = jobs._Progress()
    kept = []
    listener.onQueryProgress = lambda e: kept.extend(o.numRowsTotal for o in e.progress.stateOperators)
    spark.streams.addListener(listener)
    stream = jobs.open_stream(spark, str(tmp_path), "p", schema, 1).withColumn("device", F.lit("d"))
    out = jobs.run_to_table(jobs.first_seen(stream, "device", keep_days=2), "idle", "update", listener=listener)
    assert listener.ended.wait(60)
    spark.streams.removeListener(listener)
    assert rows(out.where("user_id = 'u0'"), "event_id") == [(0,), (99,)] and out.count() == 11
    assert max(kept) <= 4 and len(kept) >= 10


def test_first_seen_over_several_batches(spark, tmp_path):
    schema = write_parts(spark, tmp_path, [[(2, "2024-01-01T02:00:00", "a")], [(1, "2024-01-01T01:00:00", "a"), (3, "2024-01-01T03:00:00", "b")]])
    stream = jobs.open_stream(spark, str(tmp_path), "p", schema, 1).withColumn("device", F.lit("d"))
    out = jobs.latest(jobs.run_to_table(jobs.first_seen(stream, "device"), "fs", "update"), ["user_id", "value"])
    assert rows(out, "user_id", "event_id") == [("a", 1), ("b", 3)]


def test_streams_read_a_single_file(spark):
    assert streams.stream(spark, SF).isStreaming


def test_registered_names():
    assert len(registry.QUERIES) > 180 and not any("pipeline" in n or n.startswith("op") for n in registry.QUERIES)
    assert registry.QUERIES.keys() <= entry_module.queries().keys()


def test_legs_keep_all_their_keys(spark):
    legs = [{"origin": "A", "dest": "B", "dep_time": "2024-01-01T10:00Z", "fare": {"amount": 120.5, "class": None}}, {"dest": "C", "stops": [1, 2]}]
    raw = spark.createDataFrame([(1, json.dumps(legs)), (2, ""), (3, "no json"), (4, '{"origin":"A"}'), (5, None)], "event_id long, legs string")
    out = store.explode_legs(raw).orderBy("event_id", "leg_no").collect()
    assert [json.loads(r.leg) for r in out[:2]] == legs
    assert [(r.event_id, r.leg_no, r.leg_origin, r.leg_dest) for r in out] == [(1, 0, "A", "B"), (1, 1, None, "C"), *[(i, None, None, None) for i in (2, 3, 4, 5)]]
    meta = {r.event_id: json.loads(r.meta) for r in store.load_travel_rows(raw, ["event_id"]).collect()}
    assert meta[1]["legs"] == legs and not any(meta[i].get("legs") for i in (2, 3, 4, 5))
