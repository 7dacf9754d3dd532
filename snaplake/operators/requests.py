"""Search requests as bodies: a ranked query, a text filter, filters and a time; what matched is told beside each row."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.operators import search, sessions
from snaplake.operators.filters import compile_filter, text_match, time_filter

#: Ways of ranking, operators of text filters and of filters, and the number of results unless the body says another.
MODES = ["hybrid", "keyword", "semantic", "recent"]
TEXT_OPERATORS = ["all_tokens", "any_token", "phrase", "prefix", "glob", "iglob", "regex"]
OPERATORS = ["eq", "ne", "in", "nin", "gt", "gte", "lt", "lte", "contains", "glob", "iglob", "regex"]
LIMIT = 50


def catalog(rows: DataFrame, text_fields: list[str]) -> dict:
    """What a body may hold for these rows: fields with their types, operators, modes."""
    return {"filterable_attributes": [{"name": c, "type": t} for c, t in rows.dtypes if c not in text_fields], "text_fields": list(text_fields), "operators": OPERATORS, "text_match_operators": TEXT_OPERATORS, "logical_operators": ["$and", "$or", "$not", "$nor"], "modes": MODES, "limit": LIMIT}


def fields_of(tree: dict) -> list[str]:
    """The fields that a filter tree asks about, each once, in its order."""
    out: list[str] = []
    for key, value in tree.items():
        if key.removeprefix("$") in ("and", "or", "nor"):
            out += [f for t in value for f in fields_of(t)]
        elif key.removeprefix("$") == "not":
            out += fields_of(value)
        else:
            out.append(key)
    return list(dict.fromkeys(out))


def text_filter(body: dict, columns: dict[str, str]) -> Column:
    """{query, operator: all_tokens unless given, field, negate}; a null text matches nothing, and everything if negated."""
    hit = F.coalesce(text_match(F.col(columns.get(body.get("field", "search_text"), body.get("field", "search_text"))), body.get("operator", "all_tokens"), body["query"]), F.lit(False))
    return ~hit if body.get("negate") else hit


def search_rows(rows: DataFrame, body: dict, id_col: str, text_col: str, now: datetime | None = None, time_col: str | None = None, vectors: DataFrame | None = None, vector: list[float] | None = None, tenant: Column | None = None) -> DataFrame:
    """The best rows for a body, all columns of rows (ids are unique), with place (from 1), score and search_match.

    body: query, mode (hybrid unless given), last_as_prefix, text_match, filters, time, limit. search_match has
    matched_fields (the text's, if it has one of the query's words or meets text_match), filter_fields and
    rank_sources. Filters and the tenant's predicate hold before ranking. Without a query, or in mode recent,
    rows are ranked by time, latest first. vectors (id, embedding) and vector serve the modes semantic and
    hybrid; without them hybrid is by words alone. Rows are joined by id only once the limit is taken.
    """
    mode = body.get("mode", "hybrid")
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}")
    columns = {"search_text": text_col}
    chosen = rows if tenant is None else rows.where(tenant)
    if body.get("filters"):
        chosen = chosen.where(compile_filter(body["filters"], columns))
    if body.get("time"):
        chosen = chosen.where(time_filter(body["time"], now))
    if body.get("text_match"):
        chosen = chosen.where(text_filter(body["text_match"], columns))
    query, limit = body.get("query") or "", body.get("limit", LIMIT)
    by_words = by_vector = None
    if query and mode in ("hybrid", "keyword"):
        by_words = search.bm25(chosen, id_col, text_col, query, bool(body.get("last_as_prefix")))
    if vectors is not None and vector is not None and mode in ("hybrid", "semantic"):
        near = vectors.join(chosen.select(F.col(id_col).alias("id")), "id", "left_semi")
        by_vector = search.semantic(near, "id", "embedding", vector)
    if by_words is not None and by_vector is not None:
        best, used = search.hybrid(by_words, by_vector, limit), ["keyword", "semantic"]
    elif by_words is not None or by_vector is not None:
        best, used = search.top(by_words if by_words is not None else by_vector, limit), ["keyword" if by_words is not None else "semantic"]
    else:
        if time_col is None:
            raise ValueError("a request without a query needs a time to rank by")
        best, used = search.recent(chosen, id_col, time_col, limit), ["recent"]
    best = search.placed(best)
    found = chosen.join(best.withColumnRenamed("id", id_col), id_col)
    words = F.coalesce(text_match(F.col(text_col), "any_token", query), F.lit(False)) if query else F.lit(False)
    meets = text_filter({**body["text_match"], "negate": False}, columns) if body.get("text_match") else F.lit(False)
    asked = F.array(*(F.lit(f) for f in fields_of(body.get("filters") or {}))).cast("array<string>")
    match = F.struct(F.when(words | meets, F.array(F.lit("search_text"))).otherwise(F.array().cast("array<string>")).alias("matched_fields"), asked.alias("filter_fields"), F.array(*map(F.lit, used)).alias("rank_sources"))
    return found.withColumn("search_match", match)


def search_activity(entries: DataFrame, body: dict, now: datetime, id_col: str = "id", time_col: str = "at", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A page of entries of several sources, latest first: body has q (text that occurs, whatever the case), sources, time, limit and cursor, as sessions.page has them."""
    if body.get("sources"):
        entries = entries.where(F.col(source_col).isin(list(body["sources"])))
    if body.get("time"):
        entries = entries.where(time_filter({"field": time_col, **body["time"]}, now))
    if body.get("q"):
        entries = entries.where(F.contains(F.lower(text_col), F.lit(body["q"].lower())))
    return sessions.page(entries, body.get("limit", LIMIT), body.get("cursor"), id_col, time_col)
