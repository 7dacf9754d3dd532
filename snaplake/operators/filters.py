"""Filter trees, as JSON request bodies give them, compiled to one Column."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = re.compile(r"(\d+)([smhdw])")
_UNIT = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def glob_pattern(glob: str) -> str:
    """A regular expression for the whole text: * any characters, ? one, [..] a set."""
    out = []
    for part in re.findall(r"\[[^\]]+\]|.", glob, re.S):
        if part == "*":
            out.append(".*")
        elif part == "?":
            out.append(".")
        elif len(part) > 1:
            out.append("[" + ("^" + part[2:-1] if part[1] == "!" else part[1:-1]) + "]")
        else:
            out.append(re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", part))
    return "(?s)^" + "".join(out) + "$"


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _words(query: str) -> list[str]:
    return [w for w in re.split(r"[^\w]|_", query.lower()) if w]


def text_match(c: Column, operator: str, query: str) -> Column:
    """all_tokens, any_token, phrase (tokens in a row), prefix (the last token may go on), glob, iglob, regex."""
    words = _words(query)
    found = tokens(c)
    if operator == "all_tokens":
        return reduce(lambda a, b: a & b, [F.array_contains(found, w) for w in words], F.lit(True))
    if operator == "any_token":
        return F.arrays_overlap(found, F.array(*map(F.lit, words))) if words else F.lit(False)
    joined = F.concat(F.lit(" "), F.concat_ws(" ", found), F.lit(" "))
    if operator == "phrase":
        return F.contains(joined, F.lit(" " + " ".join(words) + " "))
    if operator == "prefix":
        return F.contains(joined, F.lit(" " + " ".join(words)))
    if operator == "glob":
        return c.rlike(glob_pattern(query))
    if operator == "iglob":
        return c.rlike("(?i)" + glob_pattern(query))
    if operator == "regex":
        return c.rlike(query)
    raise ValueError(f"operator {operator!r}")


_COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c.isNull() if v is None else c == F.lit(v),
    "ne": lambda c, v: c.isNotNull() if v is None else c != F.lit(v),
    "in": lambda c, v: c.isin(list(v)) if v else F.lit(False),
    "nin": lambda c, v: ~c.isin(list(v)) if v else F.lit(True),
    "gt": lambda c, v: c > F.lit(v),
    "gte": lambda c, v: c >= F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
    "contains": lambda c, v: F.contains(c, F.lit(v)),
}


def _field(c: Column, value) -> Column:
    if not isinstance(value, dict):
        return _COMPARE["eq"](c, value)
    parts = []
    for operator, v in value.items():
        name = operator.removeprefix("$")
        if name == "not":
            parts.append(~_field(c, v))
        else:
            parts.append(_COMPARE[name](c, v) if name in _COMPARE else text_match(c, name, v))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def compile_filter(tree: dict, columns: dict[str, str] | None = None) -> Column:
    """{field: value}, {field: {operator: value}} with or without $, $and, $or, $nor, $not; siblings are joined by AND. columns: names of fields, if they differ."""
    both = lambda xs: reduce(lambda a, b: a & b, xs, F.lit(True))
    either = lambda xs: reduce(lambda a, b: a | b, xs, F.lit(False))
    parts = []
    for key, value in tree.items():
        if key in ("$and", "and"):
            parts.append(both([compile_filter(t, columns) for t in value]))
        elif key in ("$or", "or"):
            parts.append(either([compile_filter(t, columns) for t in value]))
        elif key in ("$nor", "nor"):
            parts.append(~either([compile_filter(t, columns) for t in value]))
        elif key in ("$not", "not"):
            parts.append(~compile_filter(value, columns))
        else:
            parts.append(_field(F.col((columns or {}).get(key, key)), value))
    return both(parts)


def time_filter(body: dict, now: datetime) -> Column:
    """{field, since: '7d', gte, gt, lte, lt}; now is given, so that runs repeat."""
    c, parts = F.col(body["field"]), []
    if "since" in body:
        amount, unit = _SPAN.fullmatch(body["since"]).groups()
        parts.append(c >= F.lit(now - timedelta(**{_UNIT[unit]: int(amount)})))
    parts += [_COMPARE[k](c, v) for k, v in body.items() if k in ("gte", "gt", "lte", "lt")]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def host_allowed(url: Column, hosts: list[str], strict: bool = True) -> Column:
    """The url's host is one of hosts or below one; not strict: or ends like one."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(reduce(lambda a, b: a | b, [(host == h) | host.endswith(("." if strict else "") + h) for h in hosts], F.lit(False)), F.lit(False))


def blocked_path(path: Column, exact: list[str], globs: list[str], ids: list[str]) -> Column:
    """The path is listed, matches a glob, its last part's stem ends in an id, or a part is an id's transcript."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    parts = [path.isin(exact) if exact else F.lit(False), *(path.rlike(glob_pattern(g)) for g in globs), *(stem.endswith(i) | F.contains(path, F.lit(f"/{i}.jsonl")) | F.contains(path, F.lit(f"/{i}.txt")) for i in ids)]
    return reduce(lambda a, b: a | b, parts)


def lacks(fields: list[str]) -> Column:
    """One of the fields is null or an empty text."""
    out = F.lit(False)
    for f in fields:
        out = out | F.col(f).isNull() | (F.col(f).cast("string") == "")
    return out
