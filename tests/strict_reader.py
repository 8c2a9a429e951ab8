"""A plain strict reader of frames, written apart from the library, to check it against."""

from __future__ import annotations

import json
import math

from ticktape import schemas as S


FAMILY_OF = {code: family for family in S.FAMILIES.values() for code in family.event_types}


class Bad(ValueError):
    pass


def _float(text):
    value = float(text)
    if math.isinf(value):
        raise Bad("overflow")
    return value


def _int(text):
    _float(text)
    return -0.0 if text == "-0" else int(text)


def _object(pairs):
    """All pairs must be readable, also those that a later one replaces."""
    for pair in pairs:
        _check(list(pair))
    return dict(pairs)


def _constant(text):
    raise Bad(text)


def _check(value, depth=1):
    if isinstance(value, str):
        value.encode("utf-8")
    elif isinstance(value, (list, dict)):
        if depth > 127:
            raise Bad("too deep")
        for v in value if isinstance(value, list) else [*value.keys(), *value.values()]:
            _check(v, depth + 1)


def _is(value, dtype):
    kind = dtype.simpleString()
    if kind == "string":
        return isinstance(value, str)
    if kind == "bigint":
        return isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63
    if kind == "double":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, list) and all(_is(v, dtype.elementType) for v in value)


def _typed(value, dtype):
    kind = dtype.simpleString()
    if kind == "double":
        return float(value)
    return [_typed(v, dtype.elementType) for v in value] if kind.startswith("array") else value


def read_frame(frame: str):
    """``[(pos, family name, values) or (pos, 'reject', reason)]``."""
    try:
        value = json.loads(frame, parse_float=_float, parse_int=_int, parse_constant=_constant, object_pairs_hook=_object)
        _check(value)
    except (ValueError, UnicodeEncodeError, RecursionError):
        return [(0, "reject", S.BAD_JSON)]
    out = []
    for pos, element in enumerate(value if isinstance(value, list) else [value]):
        code = element.get("ev") if isinstance(element, dict) else None
        if not isinstance(code, str) or code not in FAMILY_OF:
            out.append((pos, "reject", S.UNKNOWN_EVENT_TYPE))
            continue
        family = FAMILY_OF[code]
        values = {}
        for f in family.fields:
            v = element.get(f.key)
            if v is None and f.optional:
                values[f.column] = None
            elif _is(v, f.type):
                values[f.column] = _typed(v, f.type)
            else:
                out.append((pos, "reject", S.SCHEMA_MISMATCH))
                break
        else:
            out.append((pos, family.name, values))
    return out
