"""JSON as people write it, read into VARIANT values, and JSON texts with the signs escaped that scripts stumble over.

Read leniently: comments (``//`` and ``/* */``), a byte order mark, missing commas and commas before a closing bracket, numbers such as
``.5`` or ``1.``, and anything after the first value. Each text is read once by tokens with a stack, so depth costs no recursion.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

BLANK = re.compile(r"(?:\s|\ufeff|//[^\n\r]*|/\*.*?\*/)+", re.S)
TOKEN = re.compile(r'(?P<text>"(?:[^"\\]|\\.)*")|(?P<number>-?[\d.]+(?:[eE][+-]?\d+)?)|(?P<word>true|false|null)(?!\w)|(?P<sign>[][{}:,])', re.S)
ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
WORDS = {"true": True, "false": False, "null": None}
#: Beside control characters, quotes and backslashes: signs that are invisible or end lines in scripts. Fixed values.
UNSAFE = "[\\x7f-\\x9f\\xad\\u0600-\\u0604\\u070f\\u17b4\\u17b5\\u200c-\\u200f\\u2028-\\u202f\\u2060-\\u206f\\ufeff\\ufff0-\\uffff]"
#: An array may have holes up to this many places, or if at least half of its places are filled.
HOLES = 10


class _Unreadable(ValueError):
    pass


def _text(token: str) -> str:
    plain = ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else ESCAPES.get(m[2], m[2]), token[1:-1])
    return plain.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _number(token: str) -> int | float:
    try:
        return int(token)
    except ValueError:
        found = float(token)
        if not math.isfinite(found):
            raise _Unreadable(token) from None
        return found


def _tokens(text: str):
    at = 0
    while True:
        blank = BLANK.match(text, at)
        at = blank.end() if blank else at
        met = TOKEN.match(text, at)
        if not met:
            raise _Unreadable(f"at {at}")
        at = met.end()
        kind = met.lastgroup
        yield kind, _text(met[0]) if kind == "text" else _number(met[0]) if kind == "number" else WORDS[met[0]] if kind == "word" else met[0]


def read(text: str):
    """The first value of a text; an error if there is none, or if an entry of an object has no key. Of equal keys the last counts."""
    tokens = _tokens(text)
    stack: list[list] = []  # container, key that waits for its value or None, whether a comma may follow
    while True:
        kind, value = next(tokens)
        if kind == "sign":
            if value in "[{":
                stack.append([[] if value == "[" else {}, None, False])
                continue
            if not stack:
                raise _Unreadable(value)
            own, key, after = stack[-1]
            if value == "," and after:
                stack[-1][2] = False
                continue
            if value != ("]" if isinstance(own, list) else "}") or key is not None:
                raise _Unreadable(value)
            value = stack.pop()[0]
        if not stack:
            return value
        own, key, _ = stack[-1]
        if isinstance(own, list):
            own.append(value)
        elif key is None:
            if not isinstance(value, str | int | float) or next(tokens) != ("sign", ":"):
                raise _Unreadable("no key")
            stack[-1][1:] = [value if isinstance(value, str) else json.dumps(value), False]
            continue
        else:
            own[key] = value
        stack[-1][1:] = [None, True]


def _strict(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(read(text), ensure_ascii=False)
    except ValueError:
        return None


def strict(text: Column) -> Column:
    """The first value of each text as strict JSON; null for null and unreadable texts."""

    @pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_strict)

    return run(text)


def variant(text: Column) -> Column:
    """The first value of each text as VARIANT; null for null and unreadable texts."""
    return F.try_parse_json(strict(text))


def escaped(text: Column) -> Column:
    """A JSON string as ``jsonside.quoted`` makes it, with unsafe signs as ``\\uXXXX`` too."""
    from foliospark.sources.jsonside import quoted

    signs = F.transform(F.split(quoted(text), ""), lambda c: F.when(c.rlike(UNSAFE), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))).otherwise(c))
    return F.when(text.rlike(UNSAFE), F.array_join(signs, "")).otherwise(quoted(text))


def array_or_object(entries: Column) -> Column:
    """JSON of a map from numbers to JSON texts: an array, with null in its holes, if the numbers count places from 1 and are dense
    enough; else an object, its keys in order. Null stays null; an empty map is an empty array.
    """
    keys = F.array_sort(F.map_keys(entries))
    most, n = F.coalesce(F.array_max(keys), F.lit(0)), F.size(keys)
    places = (F.coalesce(F.array_min(keys), F.lit(1)) >= 1) & ~((most > HOLES) & (most > 2 * n))
    filled = F.transform(F.filter(F.sequence(F.lit(0), F.when(places, most).otherwise(0)), lambda i: i > 0), lambda i: F.coalesce(F.get(F.map_values(entries), F.array_position(F.map_keys(entries), i).cast("int") - 1), F.lit("null")))
    pairs = F.transform(keys, lambda k: F.concat(F.lit('"'), k.cast("string"), F.lit('":'), F.coalesce(F.get(F.map_values(entries), F.array_position(F.map_keys(entries), k).cast("int") - 1), F.lit("null"))))
    array = F.concat(F.lit("["), F.array_join(filled, ","), F.lit("]"))
    return F.when(entries.isNull(), None).when(places, array).otherwise(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))
