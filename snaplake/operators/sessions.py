"""Sessions: the append log of their index, pages of them, stores over one another, forks and replays, budgets."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplake.catalog import durable
from snaplake.operators import segments


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key. A max of structs, so that it is merged before the shuffle and a long log of one key is no burden."""
    rest = [c for c in log.columns if c != key and c not in order]
    packed = F.max(F.struct(*order, F.struct(*rest).alias("_rest")) if rest else F.struct(*order)).alias("_last")
    out = log.groupBy(key).agg(packed)
    return out.select(key, *(F.col(f"_last.{c}").alias(c) for c in order), *(F.col(f"_last._rest.{c}").alias(c) for c in rest)).select(*log.columns)


def freshest(rows: DataFrame, key: str, seen: str) -> DataFrame:
    """The row of each key that was seen last; rows that were never seen come behind."""
    return latest(rows, key, [seen])


def first_store_wins(stores: list[DataFrame], key: str) -> DataFrame:
    """The rows of all stores, of each key that of the first store that has it."""
    ranked = [s.withColumn("_store", F.lit(-i)) for i, s in enumerate(stores)]
    out = ranked[0]
    for part in ranked[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return latest(out, key, ["_store"]).drop("_store")


def cursor_of(last_active: str | None, session_id: str) -> str:
    """The place after a row, as text that fits a URL."""
    raw = json.dumps({"la": last_active, "id": session_id}, separators=(",", ":"))
    return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")


def cursor_place(cursor: str) -> tuple[str | None, str]:
    got = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    return got["la"], got["id"]


def page(sessions: DataFrame, limit: int = 50, cursor: str | None = None, id_col: str = "id", time_col: str = "last_active") -> DataFrame:
    """One row more than `limit` (1 to 200) of sessions, newest first, ids descending; the further row tells that there is more."""
    if cursor:
        la, sid = cursor_place(cursor)
        t, i = F.col(time_col), F.col(id_col)
        after = (t < F.lit(la)) | t.isNull() | ((t == F.lit(la)) & (i < F.lit(sid))) if la is not None else t.isNull() & (i < F.lit(sid))
        sessions = sessions.where(after)
    return sessions.orderBy(F.desc_nulls_last(time_col), F.desc(id_col)).limit(max(1, min(200, limit)) + 1)


def listed(sessions: DataFrame, tool: str | None = None, cwd: str | None = None, since: str | None = None, query: str | None = None, tenant: Column | None = None) -> DataFrame:
    """Sessions of a tool and folder that were active since a time (as text; none: before any), that the query occurs in and that belong to the tenant."""
    parts = [F.col(c) == F.lit(v) for c, v in (("tool", tool), ("cwd", cwd)) if v is not None]
    if since is not None:
        parts.append(F.coalesce(F.col("last_active").cast("string"), F.lit("")) >= since)
    if query:
        parts.append(matches_query(query, ["id", "tool", "cwd", "title"]))
    if tenant is not None:
        parts.append(tenant)
    for p in parts:
        sessions = sessions.where(p)
    return sessions


def matches_query(query: str, columns: list[str]) -> Column:
    """The query occurs in the columns, joined by blanks, whatever the case."""
    return F.contains(F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))), F.lit(query.lower()))


def overlay(page_rows: DataFrame, others: DataFrame, id_col: str, time_col: str) -> DataFrame:
    """page_rows and those rows of other stores that sort within them; of equal ids the page's row."""
    ends = page_rows.agg(F.min(F.struct(time_col, id_col)).alias("low"), F.max(F.struct(time_col, id_col)).alias("high"))
    inside = others.crossJoin(F.broadcast(ends)).where(F.struct(time_col, id_col).between(F.col("low"), F.col("high"))).drop("low", "high")  # ends is one row
    return first_store_wins([page_rows, inside], id_col)


def ancestors(sessions: DataFrame, id_col: str = "id", parent_col: str = "forked_from", point_col: str = "fork_point") -> DataFrame:
    """(id, ancestor, depth, cap) for each session and all that it was forked from, itself at depth 0.

    Paths double in each round (an ancestor's ancestors are joined at once), so that rounds grow with the
    logarithm of the longest chain; each round is written to the shared folder. Parents that don't exist end
    a chain; on a cycle no session is walked twice. cap: the rows of the ancestor that belong to the session,
    null for all. Repeated ids count once, with the smallest parent. No sessions: no rows.
    """
    base = sessions.groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct(F.col(parent_col).alias("parent"), F.col(point_col).cast("long").alias("cap"))).alias("f"))
    base = durable(base.select("id", "f.parent", "f.cap"))
    # far: the ancestor exactly `reach` steps away; near: all that are less than that away.
    far = durable(base.where("parent <> id").join(base.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", F.col("parent").alias("ancestor"), "cap"))
    near = base.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("cap"))
    reach = 1
    while not far.isEmpty():
        hop = far.select("id", F.col("ancestor").alias("via"), F.col("cap").alias("via_cap"))
        beyond = near.select(F.col("id").alias("via"), "ancestor", "depth", "cap")
        more = hop.join(beyond, "via").select("id", "ancestor", (F.col("depth") + reach).alias("depth"), F.when(F.col("depth") == 0, F.col("via_cap")).otherwise(F.col("cap")).alias("cap"))
        next_far = hop.join(far.select(F.col("id").alias("via"), "ancestor", "cap"), "via").select("id", "ancestor", "cap")
        first = near.unionByName(more).groupBy("id", "ancestor").agg(F.min(F.struct("depth", "cap")).alias("m"))
        near = durable(first.select("id", "ancestor", "m.depth", "m.cap"))
        far = durable(next_far.join(near.select("id", "ancestor"), ["id", "ancestor"], "left_anti"))
        reach *= 2
    return near


def replay(chains: DataFrame, events: DataFrame, session_col: str, seq_col: str) -> DataFrame:
    """The events of each chain from its root on, of each ancestor as many as cap says; place: the order within the chain."""
    numbered = events.withColumn("nth", F.row_number().over(Window.partitionBy(session_col).orderBy(seq_col)))
    joined = chains.join(numbered, chains.ancestor == numbered[session_col]).where("cap is null or nth <= cap")
    return joined.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("depth"), "nth")))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def suffix_within(events: DataFrame, session_col: str, seq_col: str, cost: Column, budget: int, parts: int | None = None) -> DataFrame:
    """The longest run of last events of each session whose costs fit the budget. parts: sessions are cut into so many parts by position, where one may be too long for a task."""
    if parts:
        return segments.running_from_end(events, session_col, seq_col, cost, parts).where(F.col("running") <= budget)
    later = Window.partitionBy(session_col).orderBy(F.desc(seq_col)).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("cost", cost).withColumn("running", F.sum("cost").over(later)).where(F.col("running") <= budget)


def first_known(events: DataFrame, session_col: str, seq_col: str, columns: dict[str, Column]) -> DataFrame:
    """(session, names): of each session the first value that isn't null of every named column. Aggregates, so that a long session costs no more than its partial sums."""
    return events.groupBy(session_col).agg(*(F.min_by(c, F.when(c.isNotNull(), F.col(seq_col))).alias(n) for n, c in columns.items()))


def exchange_summary(events: DataFrame, session_col: str, seq_col: str, asked: Column, text_col: str = "text") -> DataFrame:
    """(session, n, asked, first_text, last_text): events, those that ask, and the first and last text of these."""
    at = F.when(asked, F.col(seq_col))
    return events.groupBy(session_col).agg(F.count("*").alias("n"), F.count_if(asked).alias("asked"), F.min_by(text_col, at).alias("first_text"), F.max_by(text_col, at).alias("last_text"))


def answered(calls: DataFrame, results: DataFrame, keys: list[str], left: bool = False) -> DataFrame:
    """Calls with their results, by the keys; left: calls without a result stay."""
    return calls.join(results, keys, "left" if left else "inner")


def merged_page(stores: list[DataFrame], limit: int = 50, cursor: str | None = None, id_col: str = "id", time_col: str = "last_active") -> DataFrame:
    """A page over several stores, of equal ids the first store's row. Each store gives a page of the ids that no former one has, so that the merge holds no more than that of each."""
    parts, before = [], None
    for store in stores:
        own = store if before is None else store.join(before, id_col, "left_anti")
        before = store.select(id_col) if before is None else before.unionAll(store.select(id_col))
        parts.append(page(own, limit, cursor, id_col, time_col))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return page(out, limit, cursor, id_col, time_col)


def carried_forward(events: DataFrame, session_col: str, seq_col: str, value: Column, name: str, parts: int | None = None) -> DataFrame:
    """events with the last value that isn't null up to each row, and whether it differs from that before. parts: as for suffix_within."""
    if parts:
        return segments.last_known(events, session_col, seq_col, value, name, parts)
    w = Window.partitionBy(session_col).orderBy(seq_col)
    out = events.withColumn(name, F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag(name).over(w)
    return out.withColumn(f"{name}_changed", F.coalesce((before != F.col(name)) & before.isNotNull(), F.lit(False)))


def changes_of(events: DataFrame, session_col: str, seq_col: str, name: str, parts: int | None = None) -> DataFrame:
    """The rows at which the value differs from that of the row before, with it as `previous`; the first value is no change. parts: as for suffix_within."""
    if parts:
        return segments.value_before(events, session_col, seq_col, name, parts).where(F.col("previous") != F.col(name))
    before = F.lag(name).over(Window.partitionBy(session_col).orderBy(seq_col))
    return events.withColumn("previous", before).where(F.col("previous") != F.col(name))


def by_prefix(sessions: DataFrame, prefix: str, id_col: str = "id") -> DataFrame:
    """The first two sessions whose id starts so; the second tells that the prefix is ambiguous."""
    return sessions.where(F.col(id_col).startswith(prefix)).orderBy(id_col).limit(2)


#: Kinds of events that compaction leaves out, tokens kept free for the summary or without one, refinement passes.
NOISE, RESERVES, PASSES = ["attachment", "lifecycle", "assistant_reasoning", "opaque", "token_usage"], (2500, 1000), 4


def compacted(events: DataFrame, session_col: str, seq_col: str, cost: Column, budget: int, emitted: Column | None = None, max_output: int | None = None, marker: str = "...", summary: bool = True, type_col: str = "type", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The events of each session that fit a budget, and (session, n_dropped, n_kept, user_messages, tool_calls) of what goes.

    Noise goes, longer outputs of tools are cut to max_output characters and a mark. The session_start rows
    at the head stay, then the longest run of last events that fits beside a reserve; a session that fits
    whole is kept whole, one whose head alone doesn't fit keeps the head. With `emitted`, the costs as they
    are written, up to four passes leave out the first fifth of what is kept (one event at least) while the
    session is still over the budget. Sessions where nothing goes have no second row. No events: no rows.
    """
    kept = events.where(~F.coalesce(F.col(type_col), F.lit("")).isin(NOISE))
    if max_output is not None:
        long = (F.col(type_col) == "tool_result") & (F.char_length(text_col) > max_output)
        kept = kept.withColumn(text_col, F.when(long, F.concat(F.substring(text_col, 1, max_output), F.lit(marker))).otherwise(F.col(text_col)))
    w = Window.partitionBy(session_col)
    up_to = w.orderBy(seq_col).rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.col(type_col) == "session_start", F.lit(False))
    kept = kept.withColumn("_cost", cost).withColumn("_out", F.lit(0) if emitted is None else emitted).withColumn("_head", F.min(start).over(up_to))
    body = F.when(~F.col("_head"), F.col("_cost")).otherwise(0)
    totals = kept.groupBy(session_col).agg(F.sum(F.when(F.col("_head"), F.col("_cost")).otherwise(0)).alias("_h"), F.sum(body).alias("_b"))
    later = w.orderBy(F.desc(seq_col)).rowsBetween(Window.unboundedPreceding, 0)
    room = budget - F.col("_h")
    fits = F.when(room <= 0, False).when(F.col("_b") <= room, True).otherwise(F.col("_running") <= room - RESERVES[0 if summary else 1])
    marked = kept.withColumn("_running", F.sum(body).over(later)).withColumn("_nth", F.sum((~F.col("_head")).cast("long")).over(later)).join(totals, session_col).withColumn("_in", F.col("_head") | fits)
    n_of = marked.groupBy(session_col).agg(F.count_if(F.col("_in") & ~F.col("_head")).alias("_n0"))
    for k in range(PASSES if emitted is not None else 0):
        n_of = n_of.withColumn(f"_n{k + 1}", F.col(f"_n{k}") - F.when(F.col(f"_n{k}") > 0, F.greatest(F.lit(1), F.floor(F.col(f"_n{k}") / 5))).otherwise(0))
    if emitted is None:
        n_of = n_of.withColumn("_n", F.col("_n0"))
    else:
        at = [F.sum(F.when(F.col("_head") | (F.col("_nth") <= F.col(f"_n{k}")), F.col("_out")).otherwise(0)).alias(f"_t{k}") for k in range(PASSES)]
        written = marked.join(n_of, session_col).groupBy(session_col).agg(*at)
        choice = F.coalesce(*(F.when(F.col(f"_t{k}") <= budget, F.col(f"_n{k}")) for k in range(PASSES)), F.col(f"_n{PASSES}"))
        n_of = n_of.join(written, session_col).withColumn("_n", choice)
    done = marked.join(n_of.select(session_col, "_n"), session_col).withColumn("_in", F.col("_head") | (F.col("_nth") <= F.col("_n")))
    gone = ~F.col("_in")
    dropped = done.groupBy(session_col).agg(
        F.count_if(gone).alias("n_dropped"), F.count_if(F.col("_in") & ~F.col("_head")).alias("n_kept"), F.count_if(gone & (F.col(type_col) == "user_message")).alias("user_messages"), F.count_if(gone & (F.col(type_col) == "tool_call")).alias("tool_calls")
    ).where("n_dropped > 0")
    return done.where("_in").select(*events.columns), dropped
