"""Expressions, predicates, validation and rules on hand-worked rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlens.functions import expressions as ex
from eventlens.functions import rules as ru
from eventlens.functions import validation as va
from eventlens.functions.predicates import filter_rows
from eventlens.operators import mapping as mp
from eventlens.operators import steps


def value(spark, make, text, dtype="string"):
    return spark.createDataFrame([(text,)], f"c {dtype}").select(make(F.col("c"))).first()[0]


@pytest.mark.parametrize("text,want", [
    ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("€ 12,5", 12.5), (" 7 ", 7.0), ("", None), ("n/a", None), ("1e3", 1000.0),
    ("-3,25 USD", -3.25), ("12-3", None), (None, None), ("free", None),
])
def test_try_float(spark, text, want):
    assert value(spark, ex.to_float, text) == want


@pytest.mark.parametrize("text,want", [("-3.9", -3), ("3,9", 3), ("x", None)])
def test_try_int_truncates(spark, text, want):
    assert value(spark, ex.to_int, text) == want


@pytest.mark.parametrize("text,want", [("YES", True), (" off ", False), ("maybe", None), ("  ", None), (None, None), ("1", True)])
def test_bool_words(spark, text, want):
    assert value(spark, ex.to_bool, text) is want


@pytest.mark.parametrize("text,want", [
    ("2024-01-02 03:04:05", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("03/04/2024", "2024-04-03 00:00:00"),
    ("04/25/2024", "2024-04-25 00:00:00"), ("2024-01-02T03:04:05.25", "2024-01-02 03:04:05.25"), ("never", None),
])
def test_dates_day_first(spark, text, want):
    assert value(spark, lambda c: ex.to_datetime(c).cast("string"), text) == want


def test_date_pattern():
    assert ex.date_pattern("%Y-%m-%dT%H:%M") == "yyyy-MM-dd'T'HH:mm"


@given(st.text(alphabet="ab1.;, ", max_size=12), st.integers(0, 3))
@settings(max_examples=15, deadline=None)
def test_split_equals_python(spark, text, index):
    parts = text.split(";")
    want = parts[index].strip(" ") if text.strip() and index < len(parts) else None
    assert value(spark, lambda c: ex.split_part(c, ";", index), text) == want


@pytest.mark.parametrize("spec,want", [
    ({"op": "substring", "col": "a", "start": 1, "end": 3}, "bc"), ({"op": "substring", "col": "a", "start": 4}, "e"),
    ({"op": "concat", "cols": ["a", "n", "a"], "sep": "-"}, "abcde--abcde"), ({"op": "coalesce", "cols": ["blank", "n"], "default": "d"}, "d"),
    ({"op": "map", "col": "a", "mapping": {"abcde": "hit"}}, "hit"), ({"op": "map", "col": "n", "mapping": {}, "default": "x"}, "x"),
    ({"op": "regex_extract", "col": "a", "pattern": "b(.)d", "group": 1}, "c"), ({"op": "regex_extract", "col": "a", "pattern": "zz"}, None),
    ({"op": "if_else", "col": "n", "condition": "is_null", "then": "T", "else": "F"}, "T"), ("${a}/${n}/${zz}$", "abcde//$"),
    ("prefix:p:q", "p:qabcde"), ("suffix:!", "abcde!"), ("unknown-op", "abcde"),
])
def test_expressions(spark, spec, want):
    df = spark.createDataFrame([("abcde", None, "  ")], "a string, n string, blank string")
    lookup = {c: F.col(c) for c in df.columns}
    assert df.select(ex.map_expression(spec, F.col("a"), lookup)).first()[0] == want


@pytest.mark.parametrize("op,left,right,want", [("/", 1.0, 0.0, None), ("%", -7.0, 3.0, 2.0), ("%", 7.0, -3.0, -2.0), ("%", 5.0, 0.0, None), ("*", 2.0, None, None)])
def test_arithmetic(spark, op, left, right, want):
    df = spark.createDataFrame([(left, right)], "l double, r double")
    assert df.select(ex.arithmetic(F.col("l"), op, F.col("r"))).first()[0] == want


def test_round_is_half_even(spark):
    assert value(spark, lambda c: ex.step_function("round", [c], ["double"], [0]), 2.5, "double") == 2.0


def test_filters_on_missing_values(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "B")], "id int, c string")

    def ids(*conds):
        return [r.id for r in filter_rows(df, [{"field": f, "op": o, "value": v} for f, o, v in conds]).orderBy("id").collect()]

    assert ids(("c", "ne", "a")) == [2, 3] and ids(("c", "nin", "a")) == [2, 3]
    assert ids(("c", "contains", "b")) == [3] and ids(("c", "regex", "B")) == [3]
    assert ids(("nope", "eq", 1), ("", "eq", 2)) == [1, 2, 3] and ids(("id", "between", [2, 3])) == [2, 3]


def test_aggregate_semantics(spark):
    df = spark.sql("""SELECT * FROM VALUES ('a', NULL, TIMESTAMP '2024-01-01', 1), ('a', NULL, TIMESTAMP '2024-01-02', 2), (NULL, 5D, TIMESTAMP '2024-01-01', 3),
        ('b', 2D, TIMESTAMP '2024-01-02', 4), ('b', NULL, TIMESTAMP '2024-01-03', 5), ('b', 4D, TIMESTAMP '2024-01-02', 6) AS t(k, v, ts, event_id)""")
    aggs = [{"func": f, "field": "v", "alias": f} for f in ("sum", "count", "first", "last", "std", "median", "nunique")]
    out = {r.k: r.asDict() for r in steps.aggregate(df, ["k"], aggs).collect()}
    assert set(out) == {"a", "b"}
    assert out["a"] == {"k": "a", "sum": 0.0, "count": 0, "first": None, "last": None, "std": None, "median": None, "nunique": 0}
    assert (out["b"]["first"], out["b"]["last"], out["b"]["median"], out["b"]["sum"]) == (2.0, 4.0, 3.0, 6.0)
    total = steps.aggregate(df, [], [{"func": "count", "field": "v", "alias": "n"}, {"func": "median", "field": "v", "alias": "m"}]).first()
    assert (total.n, total.m) == (6, 4.0)


def test_sort_puts_missing_last_and_breaks_ties(spark):
    df = spark.sql("SELECT * FROM VALUES (1, NULL, 3), (2, 5, 2), (3, 5, 1), (4, 9, 0) AS t(id, v, event_id)")
    for direction, want in (("asc", [3, 2, 4, 1]), ("desc", [4, 3, 2, 1])):
        out = steps.sort_rows(df, [{"field": "v", "direction": direction}])
        assert [r.id for r in out.collect()] == want


def test_later_rules_see_earlier_fixes(spark):
    df = spark.createDataFrame([(1, -4.0, "x"), (2, 500.0, " "), (3, None, None)], "event_id int, amount double, name string")
    rules = [
        {"name": "low", "target_field": "amount", "rule_type": "range", "on_failure": "fix", "config": {"min": 0}},
        {"name": "low again", "target_field": "amount", "rule_type": "range", "on_failure": "reject", "config": {"min": 0, "max": 400}},
        {"name": "name", "target_field": "name", "rule_type": "not_empty", "on_failure": "default", "default_value": "?"},
        {"name": "off", "target_field": "name", "rule_type": "required", "on_failure": "reject", "enabled": False},
    ]
    checked = va.run_checks(df, rules)
    out = {r.event_id: r for r in checked.collect()}
    assert out[1].amount == 0.0 and not out[1].rejected and out[1].warned
    assert out[2].rejected and not out[2].warned and out[2].name == "?"
    assert out[3].name == "?" and out[3].amount is None and not out[3].rejected
    counts = va.check_counts(checked).first()
    assert tuple(counts) == (3, 2, 1, 2)
    assert [r.rule for r in va.issue_rows(checked).where("event_id = 2").collect()] == ["low again", "name"]


def test_rules_on_absent_and_missing_fields(spark):
    df = spark.createDataFrame([(1, "x", "10"), (2, " ", "abc")], "event_id int, name string, n string")

    def hits(cond):
        rule = {"id": "r", "name": "r", "conditions": cond}
        return [r.event_id for r in ru.evaluate_rules(df, [rule]).where("size(rule_ids) > 0").orderBy("event_id").collect()]

    assert hits({"field": "gone", "op": "is_null"}) == [1, 2] and hits({"field": "gone", "op": "ne", "value": 1}) == []
    assert hits({"field": "name", "op": "is_null"}) == [2] and hits({"field": "name", "op": "ne", "value": "q"}) == [1]
    assert hits({"field": "n", "op": "gt", "value": 9}) == [1, 2]  # 10 > 9 by number, "abc" > "9" by text
    assert hits({"operator": "NOT", "rules": [{"field": "n", "op": "eq", "value": "10"}, {"field": "name", "op": "eq", "value": "x"}]}) == [2]
    assert hits({"operator": "OR", "rules": []}) == [1, 2]


def test_mapping_keeps_value_where_a_structured_expression_gives_nothing(spark):
    df = spark.createDataFrame([("a;b",), ("c",)], "raw string")
    out = mp.apply_mapping(df, {"part": "raw"}, {"part": {"op": "split", "col": "raw", "sep": ";", "index": 1}})
    assert [r.part for r in out.collect()] == ["b", "c"]


def test_ingest_needs_time_and_type(spark):
    df = spark.createDataFrame([("2024-01-01", "x")], "timestamp string, etype string")
    assert mp.ingest(df, {"ts": "timestamp", "event_type": "etype"}, "s").columns == ["ts", "event_type", "source"]
    with pytest.raises(ValueError, match="event_type"):
        mp.ingest(df, {"ts": "timestamp", "event_type": "nope"}, "s")


def test_heuristic_mapping_of_plain_names(spark):
    df = spark.createDataFrame([("f", "timestamp"), ("f", "etype"), ("f", "user"), ("f", "account"), ("f", "price")], "dataset string, column string")
    out = {r.target: r for r in mp.suggest_mapping(df).collect()}
    assert out["ts"].column == "timestamp" and out["event_type"].column == "etype" and out["user_id"].column == "user"
    assert out["amount"].expression == "try_float"
