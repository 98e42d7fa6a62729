"""Scalar functions and mapping expressions compiled to Columns.

``step_function`` serves transform steps; ``map_expression`` serves ingest
mappings. Both run JVM-side and work unchanged on batch and streaming frames.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens.functions.predicates import is_nullish, settled

# Date formats tried in this order (day-first before month-first).
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
    "yyyy-MM-dd",
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy",
]

# Words read as booleans.
TRUE_WORDS = ["true", "1", "yes", "y", "on", "t"]
FALSE_WORDS = ["false", "0", "no", "n", "off", "f"]

# strptime directives -> Spark datetime pattern letters.
_DIRECTIVES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm",
    "%S": "ss", "%f": "SSSSSS", "%j": "DDD", "%b": "MMM", "%B": "MMMM",
    "%I": "hh", "%p": "a", "%z": "Z",
}


def date_pattern(fmt: str) -> str:
    """Translate a strptime format; other letters become quoted literals."""
    pieces = re.findall(r"%[A-Za-z%]|[A-Za-z]+|[^A-Za-z%]+", fmt)
    out = []
    for piece in pieces:
        if piece.startswith("%"):
            out.append("%" if piece == "%%" else _DIRECTIVES[piece])
        elif piece[0].isalpha():
            out.append(f"'{piece}'")
        else:
            out.append(piece)
    return "".join(out)


def text(col: Column) -> Column:
    return col.cast("string")


def to_float(col: Column) -> Column:
    """Number from free text; the last of ``,`` and ``.`` is the decimal mark."""
    s = F.trim(text(col))
    comma = F.instr(s, ",") > 0
    dot = F.instr(s, ".") > 0
    comma_last = F.instr(F.reverse(s), ",") < F.instr(F.reverse(s), ".")
    european = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.replace(s, F.lit(","), F.lit(""))
    unified = (
        F.when(comma & dot, F.when(comma_last, european).otherwise(plain))
        .when(comma, F.replace(s, F.lit(","), F.lit(".")))
        .otherwise(s)
    )
    digits = F.regexp_replace(unified, r"[^\d.\-+eE]", "")
    number = F.when(digits != "", digits).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def to_int(col: Column) -> Column:
    return to_float(col).try_cast("bigint")


def to_bool(col: Column, is_number: bool = False) -> Column:
    """Boolean from words; a numeric column is true where it is not zero."""
    if is_number:
        return col != 0
    word = F.lower(F.trim(text(col)))
    return F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))


def to_datetime(col: Column, fmt: str | None = None) -> Column:
    s = F.trim(text(col))
    if fmt:
        return F.try_to_timestamp(s, F.lit(date_pattern(fmt)))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in DATE_FORMATS])


def when_present(col: Column, value: Column) -> Column:
    return F.when(~is_nullish(col), value)


def template(pattern: str, lookup: Mapping[str, Column]) -> Column:
    """``${a}-${b}``: names resolved once, here; a nullish part becomes empty."""
    parts = []
    for literal, name in re.findall(r"([^$]+|\$(?!\{[A-Za-z0-9_]+\}))|\$\{([A-Za-z0-9_]+)\}", pattern):
        if name:
            parts.append(or_empty(lookup[name]) if name in lookup else F.lit(""))
        else:
            parts.append(F.lit(literal))
    return F.concat(*parts) if parts else F.lit("")


def or_empty(col: Column) -> Column:
    return F.when(is_nullish(col), "").otherwise(text(col))


def join_text(cols: Sequence[Column], sep: str = "") -> Column:
    """Separator is kept around missing parts."""
    return F.concat_ws(sep, *[or_empty(c) for c in cols])


def first_present(cols: Sequence[Column], default: Any = None) -> Column:
    picks = [when_present(c, text(c)) for c in cols]
    if default is not None:
        picks.append(F.lit(str(default)))
    return F.coalesce(*picks)


def slice_text(col: Column, start: int = 0, end: int | None = None, length: int | None = None) -> Column:
    """0-based; ``length`` wins over ``end``."""
    if length is None and end:
        length = max(end - start, 0)
    size = F.lit(length) if length is not None else F.length(text(col))
    return when_present(col, F.substring(text(col), F.lit(start + 1), size))


def extract(col: Column, pattern: str, group: int = 0) -> Column:
    return when_present(col, F.when(text(col).rlike(pattern), F.regexp_extract(text(col), pattern, group)))


def split_part(col: Column, sep: str = ",", index: int = 0) -> Column:
    parts = F.split(text(col), re.escape(sep), -1)
    return when_present(col, F.trim(F.get(parts, F.lit(index)))) if index >= 0 else F.lit(None).cast("string")


_ORDERED = {
    "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b,
}


def test_value(col: Column, condition: str, value: Any = None) -> Column:
    """The conditions of ``if_else``; always true or false."""
    s = text(col)
    if condition == "eq":
        return settled(col == F.lit(value))
    if condition == "ne":
        return ~col.eqNullSafe(F.lit(value))
    if condition == "contains":
        return settled(~is_nullish(col) & s.contains(str(value)))
    if condition == "startswith":
        return settled(~is_nullish(col) & s.startswith(str(value)))
    if condition == "endswith":
        return settled(~is_nullish(col) & s.endswith(str(value)))
    if condition == "is_null":
        return is_nullish(col)
    if condition == "is_not_null":
        return ~is_nullish(col)
    if condition in _ORDERED:
        number = s.try_cast("double")
        return settled(~F.isnan(number) & _ORDERED[condition](number, F.lit(float(value))))
    if condition == "in":
        options = value if isinstance(value, list) else [value]
        return settled(col.isin(options))
    if condition == "regex":
        return settled(s.rlike(str(value)))
    raise ValueError(f"unknown condition {condition!r}")


def sum_of(cols: Sequence[Column], constant: float = 0) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(to_float(c), F.lit(0.0)) for c in cols], F.lit(float(constant)))


def product_of(cols: Sequence[Column], constant: float = 1) -> Column:
    return reduce(lambda a, b: a * b, [F.coalesce(to_float(c), F.lit(1.0)) for c in cols], F.lit(float(constant)))


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(to_float(top), to_float(bottom))


def lookup_value(col: Column, mapping: Mapping[str, Any], default: Any = None) -> Column:
    """Literal map, meant for code lists; join a table when there are many keys."""
    fallback = F.lit(None if default is None else str(default)).cast("string")
    if not mapping:
        return fallback
    pairs = [F.lit(str(x)) for kv in mapping.items() for x in kv]
    hit = F.create_map(*pairs)[text(col)]
    return F.when(is_nullish(col), fallback).otherwise(F.coalesce(hit, fallback))


def map_expression(spec: Any, own: Column | None, lookup: Mapping[str, Column]) -> Column:
    """Compile one mapping expression.

    ``own`` is the mapped source column; ``lookup`` resolves names. Text specs
    are unary operations or ``${}`` templates, dict specs carry ``op``.
    """
    def column(name: str | None) -> Column:
        return lookup[name] if name in lookup else F.lit(None).cast("string")

    if isinstance(spec, str):
        return _unary(spec, own if own is not None else F.lit(None).cast("string"), lookup)
    op = spec.get("op")
    col = column(spec.get("col"))
    cols = [column(c) for c in spec.get("cols", [])]
    if op == "concat":
        return join_text(cols, spec.get("sep", ""))
    if op == "coalesce":
        return first_present(cols, spec.get("default"))
    if op == "try_float":
        return to_float(col)
    if op == "try_int":
        return to_int(col)
    if op == "bool":
        return to_bool(col)
    if op == "parse_date":
        return to_datetime(col, spec.get("format"))
    if op in ("lower", "upper", "trim"):
        return _unary(op, col, lookup)
    if op == "substring":
        return slice_text(col, spec.get("start", 0), spec.get("end"), spec.get("length"))
    if op == "replace":
        return when_present(col, F.replace(text(col), F.lit(spec.get("pattern", "")), F.lit(spec.get("replacement", ""))))
    if op == "regex_replace":
        return when_present(col, F.regexp_replace(text(col), spec.get("pattern", ""), spec.get("replacement", "")))
    if op == "regex_extract":
        return extract(col, spec.get("pattern", ""), spec.get("group", 0))
    if op == "split":
        return split_part(col, spec.get("sep", ","), spec.get("index", 0))
    if op in ("if", "if_else"):
        hit = test_value(col, spec.get("condition", "eq"), spec.get("value"))
        return F.when(hit, F.lit(spec.get("then"))).otherwise(F.lit(spec.get("else")))
    if op == "add":
        return sum_of(cols, spec.get("constant", 0))
    if op == "multiply":
        return product_of(cols, spec.get("constant", 1))
    if op == "divide":
        return ratio(column(spec.get("numerator")), column(spec.get("denominator")))
    if op == "round":
        return F.bround(to_float(col), spec.get("decimals", 2))
    if op == "abs":
        return F.abs(to_float(col))
    if op in ("map", "lookup"):
        return lookup_value(col, spec.get("mapping", {}), spec.get("default"))
    return F.lit(None).cast("string")


def _unary(spec: str, col: Column, lookup: Mapping[str, Column]) -> Column:
    name, colon, argument = spec.partition(":")
    simple = {
        "try_float": to_float, "try_int": to_int, "bool": to_bool, "str": or_empty,
        "parse_ts": to_datetime, "parse_date": to_datetime,
        "lower": lambda c: when_present(c, F.lower(text(c))),
        "upper": lambda c: when_present(c, F.upper(text(c))),
        "trim": lambda c: when_present(c, F.trim(text(c))),
        "strip": lambda c: when_present(c, F.trim(text(c))),
    }
    if not colon and spec in simple:
        return simple[spec](col)
    if colon and name in ("default", "coalesce"):
        return F.when(is_nullish(col), F.lit(argument)).otherwise(text(col))
    if colon and name == "prefix":
        return when_present(col, F.concat(F.lit(argument), text(col)))
    if colon and name == "suffix":
        return when_present(col, F.concat(text(col), F.lit(argument)))
    if "${" in spec:
        return template(spec, lookup)
    return col


# --- transform-step functions -------------------------------------------------

def as_time(col: Column, dtype: str) -> Column:
    return col if dtype.startswith(("timestamp", "date")) else F.try_to_timestamp(text(col))


def step_function(name: str, cols: Sequence[Column], dtypes: Sequence[str], args: Sequence[Any] = ()) -> Column:
    """Named functions of transform steps; NULL input gives NULL output."""
    first, first_type = cols[0], dtypes[0]
    strings = {"upper": F.upper, "lower": F.lower, "trim": F.trim}
    if name in strings:
        return strings[name](text(first))
    if name in ("length", "len"):
        return F.length(text(first))
    if name == "concat":
        return F.concat(*[F.coalesce(text(c), F.lit("")) for c in cols])
    if name in ("coalesce", "ifnull"):
        return F.coalesce(*cols)
    parts = {
        "hour": F.hour, "date": F.to_date, "dayofweek": F.weekday, "dow": F.weekday,
        "year": F.year, "month": F.month, "day": F.dayofmonth,
    }
    if name in parts:
        return parts[name](as_time(first, first_type))
    if name == "round":
        return F.bround(first.cast("double"), int(args[0]) if args else 0)
    if name == "abs":
        return F.abs(first)
    if name in ("floor", "ceil"):
        return getattr(F, name)(first.cast("double")).cast("double")
    if name == "isnull":
        return first.isNull()
    if name == "notnull":
        return first.isNotNull()
    raise ValueError(f"unknown function {name!r}")


def arithmetic(left: Column, op: str, right: Column) -> Column:
    """``/`` and ``%`` by zero give NULL."""
    if op == "+":
        return left + right
    if op == "-":
        return left - right
    if op == "*":
        return left * right
    if op == "/":
        return F.try_divide(left, right)
    if op == "%":
        return F.when(right != 0, left - right * F.floor(left / F.when(right != 0, right)))
    raise ValueError(f"unknown operator {op!r}")
