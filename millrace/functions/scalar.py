"""The scalar functions, each an expression of built-in ones, so that Catalyst sees through them.

Unless a function says otherwise a null argument gives null, numbers that are counts or parts of dates are bigint, and
array positions count from 1. Arguments are Columns; where one is marked as a literal it shapes the expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "millrace 0.1"


def _double(x: Column) -> Column:
    return x.cast("double")


def _big(x: Column) -> Column:
    return x.cast("bigint")


def _whole(x: Column) -> Column:
    """To bigint, halves to the even neighbour."""
    return F.bround(_double(x)).cast("bigint")


# Math


def log(x: Column) -> Column:
    """-inf at 0 and NaN below, where the built-in one gives null."""
    return _log(F.ln, x)


def log2(x: Column) -> Column:
    return _log(F.log2, x)


def log10(x: Column) -> Column:
    return _log(F.log10, x)


def _log(f: Callable[[Column], Column], x: Column) -> Column:
    edge = F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))
    return edge.otherwise(f(_double(x)))


def round_(x: Column, digits: int = 0) -> Column:
    """Halves away from zero; digits is a literal. A number just below a half counts as one if times 10 ** digits it is one."""
    x = _double(x)
    if digits <= 0:
        return F.round(x, digits)
    scaled = x * F.lit(10.0**digits)
    return F.when(F.abs(scaled) < F.lit(float("inf")), F.round(scaled) / F.lit(10.0**digits)).otherwise(x)


def _integral(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """f gives bigint; what has no fraction, or is no number, stays."""
    return lambda x: F.when(F.abs(_double(x)) < F.lit(2.0**53), _double(f(x))).otherwise(_double(x))


def divide(a: Column, b: Column) -> Column:
    """Always double; anything over zero is infinity."""
    a, b = _double(a), _double(b)
    return F.when(a.isNotNull() & (b == 0), F.lit(float("inf"))).otherwise(a / F.nullif(b, F.lit(0.0)))


def modulo(a: Column, b: Column) -> Column:
    """Of whole numbers, with the dividend's sign; an error for zero."""
    return _whole(a) % _whole(b)


def int_div(a: Column, b: Column) -> Column:
    """Of whole numbers, towards zero; an error for zero."""
    return F.call_function("div", _whole(a), _whole(b))


def _extreme(f: Callable[..., Column]) -> Callable[..., Column]:
    return lambda *xs: f(*xs) if len(xs) > 1 else xs[0]


# Strings


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """From position start, at least 1; a length below 0 counts as 0."""
    return F.substring(s, F.greatest(start.cast("int"), F.lit(1)), F.lit(2**31 - 1) if length is None else F.greatest(length.cast("int"), F.lit(0)))


def concat(*xs: Column) -> Column:
    """Nulls are skipped; never null."""
    return F.concat_ws("", *[x.cast("string") for x in xs])


def concat_operator(a: Column, b: Column) -> Column:
    """a || b: if one is null the other."""
    return F.coalesce(F.concat(a.cast("string"), b.cast("string")), a.cast("string"), b.cast("string"))


def _quoted(separator: Column) -> Column:
    return F.concat(F.lit(r"\Q"), separator, F.lit(r"\E"))


def split_by_char(separator: Column, s: Column) -> Column:
    return F.split(s, _quoted(F.left(separator, F.lit(1))), -1)


def split_by_string(separator: Column, s: Column) -> Column:
    """An empty separator gives the whole string."""
    return F.when(separator == "", F.array(s)).otherwise(F.split(s, _quoted(separator), -1))


def array_string_concat(arr: Column, separator: str = "") -> Column:
    """Null elements count as empty."""
    return F.array_join(F.transform(arr, lambda e: e.cast("string")), separator, "")


#: Number formats that {i:X} and {i:Xn} may name, as Java's with n in place, and the type they are for.
NUMBER_FORMATS = {"D": ("0{n}d", "bigint"), "F": (".{n}f", "double"), "N": (",.{n}f", "double"), "X": ("0{n}X", "bigint")}


def format_(pattern: str, *xs: Column) -> Column:
    """{0}, {1}, ... in the literal pattern stand for the arguments, {0:F2} and the like for numbers in a format of
    NUMBER_FORMATS; other use of braces gives the pattern itself."""
    holes = re.findall(r"\{([^{}]*)\}", pattern)
    parsed = [re.fullmatch(r"(\d+)(?::([DFNX])(\d*))?", h) for h in holes]
    if not all(m and int(m[1]) < len(xs) for m in parsed) or re.search(r"[{}]", re.sub(r"\{[^{}]*\}", "", pattern)) or not xs:
        return F.lit(pattern)
    java, args = pattern.replace("%", "%%"), []
    for k, m in enumerate(parsed, 1):
        x, sign, kind = xs[int(m[1])], "s", None
        if m[2]:
            form, kind = NUMBER_FORMATS[m[2]]
            sign = form.format(n=m[3] or ("2" if m[2] in "FN" else "1")).replace("01d", "d").replace("01X", "X")
        java = java.replace("{" + m[0] + "}", f"%{k}${sign}", 1)
        args.append(x.cast(kind) if kind else F.coalesce(x.cast("string"), F.lit("")))
    return F.format_string(java, *args)


def empty(x: Column) -> Column:
    """True for null and the empty string."""
    return x.isNull() | (x == "")


def empty_array(x: Column) -> Column:
    return x.isNull() | (F.size(x) == 0)


# Dates and times


def _time(x: Column) -> Column:
    return x.cast("timestamp")


def to_date(x: Column, seconds: bool = False) -> Column:
    """seconds: x counts seconds since 1970."""
    return F.timestamp_seconds(x).cast("date") if seconds else x.cast("date")


def to_datetime(x: Column, seconds: bool = False) -> Column:
    return F.timestamp_seconds(x) if seconds else _time(x)


#: Units of dateAdd, dateSub and dateDiff; a plural s may follow.
UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


def _unit(unit: str) -> str:
    name = unit.lower().removesuffix("s")
    if name not in UNITS:
        raise ValueError(f"no such unit: {unit}")
    return name


def date_add(unit: str, n: Column, d: Column) -> Column:
    """A timestamp; a day past a month's end becomes its last."""
    return F.timestamp_add(_unit(unit).upper(), n.cast("int"), _time(d))


def date_sub(unit: str, n: Column, d: Column) -> Column:
    return date_add(unit, -n, d)


def date_diff(unit: str, a: Column, b: Column) -> Column:
    """b - a: years, quarters and months by the calendar, other units by elapsed time, towards zero."""
    unit, a, b = _unit(unit), _time(a), _time(b)
    per_year = {"year": (1, lambda d: F.lit(0)), "quarter": (4, F.quarter), "month": (12, F.month)}
    if unit in per_year:
        n, part = per_year[unit]
        return _big((F.year(b) - F.year(a)) * n + part(b) - part(a))
    return _big(F.timestamp_diff(unit.upper(), a, b))


#: What each sign of a format stands for.
FORMAT_SIGNS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "%": "'%'"}


def format_datetime(d: Column, pattern: str) -> Column:
    """Signs as in FORMAT_SIGNS; anything else stands for itself."""
    parts = re.findall(r"%(.)|([^%]+)", pattern, re.S)
    java = "".join(FORMAT_SIGNS.get(sign, f"'{sign}'") if sign else "'" + text.replace("'", "''") + "'" for sign, text in parts)
    return F.date_format(_time(d), java)


# Types


def _to_signed(kind: str) -> Callable[..., Column]:
    """Halves go to the even neighbour; text is parsed; what doesn't fit is an error."""
    return lambda x, text=False: x.cast(kind) if text else F.bround(_double(x)).cast(kind)


def _to_unsigned(kind: str, most: int) -> Callable[..., Column]:
    """The next wider signed type, with a check of the range."""

    def convert(x: Column, text: bool = False) -> Column:
        wide = (x if text else F.bround(x.cast("decimal(38,9)"))).cast("decimal(38,0)")
        error = F.raise_error(F.concat(F.lit(f"not from 0 to {most}: "), wide.cast("string")))
        return F.when(wide.isNull() | wide.between(F.lit(0), F.lit(str(most)).cast("decimal(38,0)")), wide).otherwise(error).cast(kind)

    return convert


def to_decimal(x: Column, precision: int = 10, scale: int = 0) -> Column:
    return x.cast(f"decimal({precision},{scale})")


# Conditions


def multi_if(*xs: Column) -> Column:
    """condition, value, ..., else: null conditions are false; without an else null."""
    pairs, other = xs[: len(xs) // 2 * 2], xs[-1] if len(xs) % 2 else F.lit(None)
    out = F.when(pairs[0], pairs[1])
    for c, v in zip(pairs[2::2], pairs[3::2], strict=True):
        out = out.when(c, v)
    return out.otherwise(other)


# Arrays


def array_element(arr: Column, i: Column) -> Column:
    """Null outside the array."""
    return F.get(arr, i.cast("int") - 1)


def has(arr: Column, v: Column) -> Column:
    """A null is found if it is there."""
    return F.exists(arr, lambda e: e.eqNullSafe(v))


def array_concat(*arrays: Column) -> Column:
    """Null arrays are skipped."""
    return F.concat(*[F.coalesce(a, F.array()) for a in arrays])


def _shorter(arr: Column, start: int) -> Column:
    return F.slice(arr, start, F.greatest(F.size(arr) - 1, F.lit(0)))


def array_slice(arr: Column, offset: Column, length: Column | None = None) -> Column:
    """A negative offset counts from the end, 0 is 1; a negative length is 0."""
    offset = offset.cast("int")
    start = F.when(offset > 0, offset).when(offset == 0, 1).otherwise(F.greatest(F.size(arr) + offset, F.lit(0)) + 1)
    most = F.size(arr) if length is None else F.coalesce(length.cast("int"), F.size(arr))
    return F.slice(arr, start, F.greatest(most, F.lit(0)))


def empty_array_to_single(arr: Column, default: Column) -> Column:
    """default: the element type's default value."""
    return F.when(F.size(arr) == 0, F.array(default)).otherwise(arr)


def range_(a: Column, b: Column | None = None, step: Column | None = None) -> Column:
    """Without the end; empty where the step leads away from it or is 0."""
    start, end = (F.lit(0), a) if b is None else (a, b)
    start, end, step = _big(start), _big(end), _big(F.lit(1) if step is None else step)
    forward = ((step > 0) & (start < end)) | ((step < 0) & (start > end))
    # both branches may be evaluated: where there is nothing to count, count one step
    safe_step = F.when(forward, step).otherwise(F.lit(1).cast("bigint"))
    safe_end = F.when(forward, end - F.signum(step).cast("bigint")).otherwise(start)
    return F.when(forward, F.sequence(start, safe_end, safe_step)).otherwise(F.array().cast("array<bigint>"))


# Tuples, maps and others


def tuple_(*xs: Column) -> Column:
    return F.struct(*[x.alias(f"_{i}") for i, x in enumerate(xs, 1)])


def tuple_element(t: Column, which: int | str) -> Column:
    """By literal position from 1 or by name."""
    return t.getField(f"_{which}" if isinstance(which, int) else which)


def map_(*xs: Column) -> Column:
    """Of equal keys the last one holds; a key without value at the end is left out."""
    keys, values = xs[: len(xs) // 2 * 2 : 2], xs[1::2]
    pairs = F.array(*[F.struct(k.alias("k"), v.alias("v")) for k, v in zip(keys, values, strict=True)])
    later = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(later)


def row_number_in_all_blocks() -> Column:
    """Distinct numbers from 1 on, rising within a partition, without a shuffle; operators.windows.numbered leaves no gaps."""
    return F.monotonically_increasing_id() + 1


def rand() -> Column:
    return F.floor(F.rand() * 2147483647).cast("bigint")


def rand64() -> Column:
    return F.conv(F.substring(F.sha2(F.uuid(), 256), 1, 16), 16, 10).cast("decimal(20,0)")


_TYPE_NAMES = {
    T.ByteType: "Int8", T.ShortType: "Int16", T.IntegerType: "Int32", T.LongType: "Int64", T.FloatType: "Float32",
    T.DoubleType: "Float64", T.StringType: "String", T.BooleanType: "Bool", T.DateType: "Date", T.TimestampType: "DateTime",
    T.TimestampNTZType: "DateTime", T.NullType: "Nullable(Nothing)",
}


def to_type_name(x: Column | T.DataType) -> Column:
    """The dialect's name of a value's or a data type."""
    if isinstance(x, T.DataType):
        return F.lit(type_name(x))
    name = F.typeof(x)
    for kind, own in _TYPE_NAMES.items():
        if not issubclass(kind, T.NullType):
            name = F.regexp_replace(name, rf"\b{kind().simpleString()}\b", own)
    name = F.regexp_replace(F.regexp_replace(name, "decimal\\((\\d+),(\\d+)\\)", "Decimal($1, $2)"), ",(?! )", ", ")
    for spark, own in (("array<", "Array("), ("map<", "Map("), ("struct<", "Tuple("), (">", ")")):
        name = F.replace(name, F.lit(spark), F.lit(own))
    name = F.regexp_replace(name, r"\w+:", "")
    return F.when(F.typeof(x) == "void", type_name(T.NullType())).otherwise(name)


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return f"Decimal({kind.precision}, {kind.scale})"
    if isinstance(kind, T.ArrayType):
        return f"Array({type_name(kind.elementType)})"
    if isinstance(kind, T.MapType):
        return f"Map({type_name(kind.keyType)}, {type_name(kind.valueType)})"
    if isinstance(kind, T.StructType):
        return f"Tuple({', '.join(type_name(f.dataType) for f in kind.fields)})"
    return _TYPE_NAMES[type(kind)]


_BLANK = r"[\s\p{Z}]+"
#: By name. Lambdas are those that a built-in function says whole.
SCALARS: dict[str, Callable[..., Column]] = {
    "abs": lambda x: F.abs(_double(x)), "ceil": _integral(F.ceil), "floor": _integral(F.floor),
    "round": round_, "sqrt": lambda x: F.sqrt(_double(x)), "pow": F.pow, "exp": F.exp, "log": log, "log2": log2, "log10": log10,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2,
    "pi": F.pi, "e": F.e, "sign": lambda x: _big(F.signum(_double(x))), "modulo": modulo, "intDiv": int_div,
    "greatest": _extreme(F.greatest), "least": _extreme(F.least), "divide": divide,
    "length": lambda s: _big(F.char_length(s)), "lower": F.lower, "upper": F.upper,
    "trim": lambda s: F.regexp_replace(s, f"^{_BLANK}|{_BLANK}$", ""), "trimLeft": lambda s: F.regexp_replace(s, f"^{_BLANK}", ""),
    "trimRight": lambda s: F.regexp_replace(s, f"{_BLANK}$", ""), "substring": substring, "concat": concat, "replace": F.replace,
    "reverse": F.reverse, "position": lambda s, sub: _big(F.call_function("instr", s, sub)), "startsWith": F.startswith,
    "endsWith": F.endswith, "repeat": lambda s, n: F.repeat(s, n.cast("int")), "left": lambda s, n: F.left(s, n.cast("int")),
    "right": lambda s, n: F.right(s, n.cast("int")), "splitByChar": split_by_char, "splitByString": split_by_string,
    "arrayStringConcat": array_string_concat, "format": format_, "toString": lambda x: x.cast("string"),
    "empty": empty, "notEmpty": lambda x: ~empty(x), "emptyArray": empty_array, "notEmptyArray": lambda x: ~empty_array(x),
    "concatOperator": concat_operator,
    "now": F.current_timestamp, "today": F.current_date, "yesterday": lambda: F.date_sub(F.current_date(), 1),
    "toYear": lambda d: _big(F.year(d)), "toMonth": lambda d: _big(F.month(d)), "toDayOfMonth": lambda d: _big(F.dayofmonth(d)),
    "toHour": lambda d: _big(F.hour(_time(d))), "toMinute": lambda d: _big(F.minute(_time(d))),
    "toSecond": lambda d: _big(F.second(_time(d))), "toDayOfWeek": lambda d: _big(F.weekday(d) + 1),
    "toDayOfYear": lambda d: _big(F.dayofyear(d)), "toQuarter": lambda d: _big(F.quarter(d)), "toDate": to_date,
    "toDateTime": to_datetime, "toUnixTimestamp": lambda d: F.unix_timestamp(_time(d)), "fromUnixTimestamp": F.timestamp_seconds,
    "dateAdd": date_add, "dateSub": date_sub, "dateDiff": date_diff, "formatDateTime": format_datetime,
    "toInt8": _to_signed("tinyint"), "toInt16": _to_signed("smallint"), "toInt32": _to_signed("int"), "toInt64": _to_signed("bigint"),
    "toUInt8": _to_unsigned("smallint", 2**8 - 1), "toUInt16": _to_unsigned("int", 2**16 - 1),
    "toUInt32": _to_unsigned("bigint", 2**32 - 1), "toUInt64": _to_unsigned("decimal(20,0)", 2**64 - 1),
    "toFloat32": lambda x: x.cast("float"), "toFloat64": _double, "toDecimal": to_decimal,
    "if": lambda c, a, b=None: F.when(c, a).otherwise(F.lit(None) if b is None else b), "ifNull": F.ifnull, "nullIf": F.nullif,
    "coalesce": F.coalesce, "multiIf": multi_if, "assumeNotNull": lambda x: x,
    "array": F.array, "arrayLength": lambda a: _big(F.size(a)), "arrayElement": array_element, "has": has,
    "indexOf": F.array_position, "arrayConcat": array_concat, "arrayPushBack": F.array_append, "arrayPushFront": F.array_prepend,
    "arrayPopBack": lambda a: _shorter(a, 1), "arrayPopFront": lambda a: _shorter(a, 2), "arraySlice": array_slice,
    "arrayReverse": F.reverse, "arrayDistinct": F.array_distinct, "arraySort": lambda a: F.sort_array(a, True),
    "emptyArrayToSingle": empty_array_to_single, "range": range_, "tuple": tuple_, "tupleElement": tuple_element,
    "map": map_, "mapKeys": F.map_keys, "mapValues": F.map_values, "rowNumberInAllBlocks": row_number_in_all_blocks,
    "rand": rand, "rand64": rand64, "generateUUIDv4": F.uuid, "version": lambda: F.lit(VERSION),
    "toTypeName": to_type_name,
}

#: Other names of the same functions.
ALIASES = {
    "ceiling": "ceil", "ln": "log", "substr": "substring", "mid": "substring", "locate": "position", "lcase": "lower",
    "ucase": "upper", "size": "length", "char_length": "length", "character_length": "length", "year": "toYear",
    "month": "toMonth", "day": "toDayOfMonth", "hour": "toHour", "minute": "toMinute", "second": "toSecond",
    "unixTimestamp": "toUnixTimestamp", "ltrim": "trimLeft", "rtrim": "trimRight", "replicate": "repeat",
}
SCALARS |= {alias: SCALARS[name] for alias, name in ALIASES.items()}
