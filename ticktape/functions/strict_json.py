"""Strict JSON on top of ``from_json``, with built-in expressions only.

``from_json`` stops at the end of the first JSON value, turns scalars into strings and keeps the first good
value of a repeated key.  The helpers here close those gaps, so that a frame or field is accepted exactly
when a strict, typed JSON reader would accept it.  The usual frame takes two JSON scans and a few substring
searches; the expensive checks sit behind a cheap test that such a frame does not meet.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A frame may nest 127 levels; the array around it adds one.
STRICT = {
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "maxNestingDepth": "128",
    "maxNumLen": "2147483647",
    "maxStringLen": "2147483647",
}
# The parser reads no key longer than this, and has no setting for it.
LONGEST_NAME = 50_000
ERROR_FIELD = "_error"  # set by from_json when a field does not have its type

_JSON_SPACE = " \t\n\r"
_SURROGATE_PAIR = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
_SURROGATE = r"\\u[dD][89a-fA-F]"
_BACKSLASH = r"\\\\"
_ESCAPED_QUOTE = r"\\(\"|u0022)"
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NUMBER = r"-?[0-9][0-9.]*+(?:[eE][-+]?[0-9]++)?+"
_MINUS_ZERO = r"((?:^|[\[,:])[ \t\n\r]*)-0(?=[ \t\n\r]*(?:[,\]}]|$))"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


# --- frames -----------------------------------------------------------------------------------------


def starts_with(text: Column, char: str) -> Column:
    """Whether the first JSON token begins with ``char``."""
    return F.when(text.startswith(char), True).otherwise(F.ltrim(text, F.lit(_JSON_SPACE)).startswith(char))


def has_escape(text: Column) -> Column:
    return F.contains(text, F.lit("\\"))


def with_signed_zeros(frame: Column) -> Column:
    """The integer token ``-0`` as ``-0.0``: it is a float and keeps its sign, which the parser would drop."""
    pieces = F.regexp_extract_all(frame, F.lit(_STRING + '|[^"]++|"'), F.lit(0))
    signed = F.transform(
        pieces, lambda p: F.when(p.startswith('"'), p).otherwise(F.regexp_replace(p, _MINUS_ZERO, "$1-0.0"))
    )
    return F.when(
        F.contains(frame, F.lit("-0")) & _outside_strings(frame).rlike(_MINUS_ZERO), F.array_join(signed, "")
    ).otherwise(frame)


def _outside_strings(frame: Column) -> Column:
    return F.regexp_replace(frame, _STRING, '""')


def sealed_parts(text: Column) -> Column:
    """The frame parsed as the first of two array entries, the second being a hash of the frame.

    An array frame gives ``[[elements...], [hash]]`` and any other value ``[[value, hash]]``.
    """
    seal = _seal(text)
    as_array = F.concat(F.lit("["), text, F.lit(',["'), seal, F.lit('"]]'))
    as_value = F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]'))
    return F.when(starts_with(text, "["), F.from_json(as_array, "array<array<string>>", STRICT)).otherwise(
        F.array(F.from_json(as_value, "array<string>", STRICT))
    )


def _seal(text: Column) -> Column:
    return F.xxhash64(text).cast("string")


def unsealed(text: Column, parts: Column) -> Column:
    """The elements in ``sealed_parts``, NULL unless the frame is one JSON value with nothing after it.

    Only then is the hash the second and last entry.
    """
    head, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    of_array = F.when((F.size(parts) == 2) & (second == F.array(_seal(text))), head)
    of_value = F.when((F.size(head) == 2) & (F.get(head, F.lit(1)) == _seal(text)), F.slice(head, 1, 1))
    return F.when(starts_with(text, "["), of_array).otherwise(of_value)


def is_readable(frame: Column, elements: Column) -> Column:
    """Whether the frame is valid JSON: it parsed, no surrogate escape stands alone, no number overflows."""
    escapes = F.regexp_replace(F.regexp_replace(frame, _BACKSLASH, ""), _SURROGATE_PAIR, "")
    lone_surrogate = F.when(has_escape(frame), escapes.rlike(_SURROGATE)).otherwise(False)
    # The parser writes an overflowing float as Infinity and leaves an integer of any length as it is.
    suspect = F.contains(F.array_join(elements, " "), F.lit("Infinity")) | (
        (F.octet_length(frame) >= 309) & frame.rlike("[0-9]{309}")
    )
    numbers = F.regexp_extract_all(_outside_strings(frame), F.lit(_NUMBER), F.lit(0))
    infinite = F.exists(numbers, lambda n: F.abs(n.try_cast("double")) == float("inf"))
    return elements.isNotNull() & ~lone_surrogate & ~F.when(suspect, infinite).otherwise(False)


def has_long_name(frame: Column) -> Column:
    """Whether a key is longer than the parser reads."""
    return (F.octet_length(frame) > LONGEST_NAME) & frame.rlike(rf'"[^"\\]{{{LONGEST_NAME + 1},}}+"[{_JSON_SPACE}]*:')


def object_flags(frame: Column) -> Column:
    """``array<boolean>``: which elements are objects; NULL when the elements' own text tells.

    Elements are text, so a string element may look like an object.  With a field name in it that takes an
    escaped quote, so only frames with a backslash are split again, with those quotes replaced.
    """
    plain = F.regexp_replace(F.regexp_replace(frame, _BACKSLASH, ""), _ESCAPED_QUOTE, "'")
    elements = F.get(F.from_json(F.concat(F.lit("["), plain, F.lit("]")), "array<array<string>>", STRICT), 0)
    return F.when(
        has_escape(frame),
        F.when(
            starts_with(frame, "["), F.transform(elements, lambda e: F.coalesce(e.startswith('{"'), F.lit(False)))
        ).otherwise(F.array(starts_with(frame, "{"))),
    )


# --- elements ---------------------------------------------------------------------------------------
# An element is the compact text the parser wrote for it, in which a key is always spelled "key": and a
# quote inside a string is always escaped.  Substring searches on it are therefore exact.


def key_is_repeated(raw: str, key: str) -> str:
    """SQL text: whether ``key`` occurs more than once, at any depth."""
    return f"substring_index({raw}, '\"{key}\":', 2) != {raw}"


def code_by_text(raw: str, key: str, codes) -> str:
    """SQL text: the one of ``codes`` that ``key`` holds as a string, else NULL; exact unless ``key`` is repeated.

    For an element with that key only inside a nested object this is the nested value.
    """
    cases = " ".join(f"""WHEN contains({raw}, '"{key}":"{c}"') THEN '{c}'""" for c in codes)
    return f"CASE {cases} END"


def code_by_parse(raw: Column, key: str, codes) -> Column:
    value = F.from_json(raw, f"`{key}` string", STRICT).getField(key)
    return F.when(value.isin(*codes), value)


def typed_fields(raw: str, fields: dict[str, T.DataType], optional=()) -> Column:
    """The fields of the element in column ``raw``, the last value of a repeated key winning.

    ``ERROR_FIELD`` is set if a field has another type.  Integers and floats are kept apart; a string field
    may hold another scalar's text, which ``is_complete`` finds out.
    """
    schema = T.StructType([T.StructField(k, t) for k, t in fields.items()] + [T.StructField(ERROR_FIELD, T.StringType())])
    typed = F.from_json(F.col(raw), schema, {**STRICT, "columnNameOfCorruptRecord": ERROR_FIELD})
    # A bad value does not undo the one before it, so for repeated keys the last values are judged apart:
    # by kind as VARIANT, and as text, because a VARIANT does not take objects that repeat a key themselves.
    options = ", ".join(f"'{k}', '{v}'" for k, v in STRICT.items())
    read = lambda kind: f"from_json({raw}, '{', '.join(f'`{k}` {kind}' for k in fields)}', map({options}))"
    good = " AND ".join(_last_is(f"x.v.`{k}`", f"x.t.`{k}`", t, k in optional) for k, t in fields.items())
    last_values_good = F.expr(f"transform(array(struct({read('variant')} AS v, {read('string')} AS t)), x -> {good})[0]")
    return F.when(
        F.expr(_repeats_any(raw, fields, optional)), typed.withField(ERROR_FIELD, F.when(~last_values_good, F.col(raw)))
    ).otherwise(typed)


def _repeats_any(raw: str, keys, optional) -> str:
    """SQL text: whether one of ``keys`` is repeated.

    Having as many keys as it should, the optional ones among them, settles it for most elements.
    """
    usual = [f"octet_length({raw}) - octet_length(replace({raw}, '\":', '')) = {2 * len(keys)}"]
    usual += [f"contains({raw}, '\"{k}\":')" for k in optional]
    return f"NOT ({' AND '.join(usual)}) AND ({' OR '.join(key_is_repeated(raw, k) for k in keys)})"


def _last_is(value: str, text: str, dtype: T.DataType, optional: bool) -> str:
    """SQL text: whether the last value of a key has this type.  An integer is a good double, a float no integer."""
    tests = {
        "string": "{0} = 'STRING' AND try_variant_get({1}, '$', 'string') = {2}",
        "bigint": "{0} = 'BIGINT' AND NOT contains({2}, '{{')",
        "double": "({0} IN ('BIGINT', 'DOUBLE') OR startswith({0}, 'DECIMAL')) AND NOT contains({2}, '{{')",
        "array<bigint>": "{0} IN ('ARRAY<BIGINT>', 'ARRAY<VOID>') AND NOT contains({2}, '{{')",
        "array<array<double>>": "{0} RLIKE '^ARRAY<(VOID|ARRAY<(VOID|BIGINT|DOUBLE|DECIMAL[(][0-9,]+[)])>)>$' "
        "AND NOT contains({2}, '{{')",
    }
    kind = f"schema_of_variant({value})"
    ok = f"coalesce({tests[dtype.simpleString()].format(kind, value, text)}, false)"
    return f"({text} IS NULL AND ({value} IS NULL OR {kind} = 'VOID') OR {ok})" if optional else ok


def is_complete(raw: str, struct: str, fields: dict[str, T.DataType], optional=()) -> str:
    """SQL text: whether a ``typed_fields`` struct has every field, with its type."""
    tests = [f"{struct}.{ERROR_FIELD} IS NULL"]
    for k, t in fields.items():
        value = f"{struct}.`{k}`"
        good = _has_no_null(value, t)
        if isinstance(t, T.StringType):
            good = f"({good} AND contains({raw}, '\"{k}\":\"'))"
        tests.append(f"({value} IS NULL OR {good})" if k in optional else good)
    return f"coalesce({' AND '.join(tests)}, false)"


def _has_no_null(value: str, dtype: T.DataType) -> str:
    ok = f"{value} IS NOT NULL"
    if isinstance(dtype, T.ArrayType):
        inner = value.replace(".", "_").replace("`", "") + "_x"
        ok = f"({ok} AND forall({value}, {inner} -> {_has_no_null(inner, dtype.elementType)}))"
    return ok
