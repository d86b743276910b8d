"""Functions of the filter language as native column expressions, in a registry that can be added to."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidValueError, UnsupportedFunctionError

MAX_PATTERN = 256


def _index(s: Column, part: Column) -> Column:
    return F.call_function("instr", s, part) - 1


def _substring(s: Column, start: Column, length: Column | None = None) -> Column:
    begin = start.cast("int") + 1
    return F.substr(s, begin) if length is None else F.substr(s, begin, length.cast("int"))


#: name -> (kinds of the arguments, kind of the result, expression). Kinds: str num time date datetime bool any.
REGISTRY: dict[str, tuple[tuple[str, ...], str, Callable[..., Column]]] = {
    "contains": (("str", "str"), "bool", lambda s, x: F.contains(s, x)),
    "startswith": (("str", "str"), "bool", lambda s, x: F.startswith(s, x)),
    "endswith": (("str", "str"), "bool", lambda s, x: F.endswith(s, x)),
    "length": (("str",), "num", F.length),
    "concat": (("any", "any"), "str", lambda a, b: F.concat_ws("", a, b)),
    "indexof": (("str", "str"), "num", _index),
    "substring": (("str", "num", "num"), "str", _substring),
    "tolower": (("str",), "str", F.lower),
    "toupper": (("str",), "str", F.upper),
    "trim": (("str",), "str", F.trim),
    "year": (("moment",), "num", F.year),
    "month": (("moment",), "num", F.month),
    "day": (("moment",), "num", F.dayofmonth),
    "hour": (("moment",), "num", F.hour),
    "minute": (("moment",), "num", F.minute),
    "second": (("moment",), "num", F.second),
    "date": (("moment",), "date", F.to_date),
    "time": (("moment",), "time", lambda t: F.date_format(t, "HH:mm:ss.SSSSSS")),
    "now": ((), "datetime", F.current_timestamp),
    "round": (("num",), "num", lambda x: F.round(x, 0)),
    "floor": (("num",), "num", F.floor),
    "ceiling": (("num",), "num", F.ceil),
    "matchespattern": (("str", "str"), "bool", lambda s, p: F.rlike(s, p)),
}

#: These take a string literal as their second argument.
NEEDS_TEXT = {"contains", "startswith", "endswith", "matchespattern"}


def check_pattern(pattern: str) -> None:
    if len(pattern) > MAX_PATTERN:
        raise InvalidValueError(f"a pattern has at most {MAX_PATTERN} characters", "matchesPattern")
    try:
        re.compile(pattern)
    except re.error as e:
        raise InvalidValueError(f"not a pattern: {e}", "matchesPattern", pattern) from e


def lookup(name: str) -> tuple[tuple[str, ...], str, Callable[..., Column]]:
    if name not in REGISTRY:
        raise UnsupportedFunctionError(f"unsupported function {name}", name)
    return REGISTRY[name]
