"""Text quality as a sparse rule ensemble (RuleFit: Friedman and Popescu, 2008), scored by Spark columns.

Shallow trees are boosted on statistics of the labelled texts; each path from a root to a node is a
conjunctive rule over the statistics. A logistic model with an L1 penalty weighs the rules, most of them
with zero. Those left are compiled into one column expression, so that scoring is a map without Python.
Statistics come from the text alone. Fitting takes a bounded sample of labelled rows (SAMPLE); everything
else sees all rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit takes at most: those with the least hashes of their ids.
SAMPLE = 20_000
#: Trees, their depth, least rows of a node, thresholds tried per statistic, boosting rate.
TREES, DEPTH, LEAST_ROWS, BINS, RATE = 40, 3, 15, 48, 0.3
#: Penalties tried; the sparsest within TOLERANCE of the best log loss on the validation part is taken.
PENALTIES, TOLERANCE = (0.03, 0.01, 0.003, 0.001, 0.0003), 0.01
#: Score from which a text is predicted to have label 1.
ACCEPT = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Name and expression of each statistic of the text (null: as if empty). Shares of an empty text are 0."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return {"chars": F.char_length(text), "words": words, "solid": F.char_length(F.regexp_replace(text, r"\s+", "")), "other": F.regexp_replace(text, r"[\p{L}\s]+", ""), "lines": F.split(text, "\n"), "upper": F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", "")), "stops": F.regexp_count(text, F.lit(r"[.!?](?=\s|$)"))}


def features() -> dict[str, Column]:
    """What the rules look at, from the columns that statistics() gives."""
    c, per = F.col, lambda a, b: (a / F.greatest(b, F.lit(1))).cast("double")
    n = F.size("words")
    plain = F.char_length(F.regexp_replace(c("other"), r"""[\d.,;:!?'"()\-]+""", ""))
    return {
        "word_count": n.cast("double"),
        "word_length": per(c("solid"), n),
        "upper_share": per(c("upper"), c("solid")),
        "other_share": per(F.char_length("other"), c("solid")),
        "symbol_share": per(plain, c("solid")),
        "digit_share": per(F.char_length(F.regexp_replace(c("other"), r"\D+", "")), c("solid")),
        "shout_share": per(F.char_length(F.regexp_replace(c("other"), r"[^!]+", "")), n),
        "distinct_share": per(F.size(F.array_distinct("words")), n),
        "short_share": per(F.size(F.filter("words", lambda w: F.char_length(w) <= 3)), n),
        "stop_share": per(c("stops"), n),
        "line_words": per(n, F.size("lines")),
        "distinct_lines": per(F.size(F.array_distinct("lines")), F.size("lines")),
        "longest_word": F.coalesce(F.array_max(F.transform("words", F.char_length)), F.lit(0)).cast("double"),
    }


def with_features(texts: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """Two projections, so that each statistic is computed once a row."""
    base = texts.select(*keep, *(e.alias(n) for n, e in statistics(F.col(text_col)).items()))
    names = [c for c in base.columns if c not in statistics(F.lit(""))]
    return base.select(*names, *(e.alias(n) for n, e in features().items()))


def _grow(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: tuple, depth: int, rules: dict, step: np.ndarray) -> None:
    """Adds the paths of one regression tree to rules and its leaf values to step."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None, None)
    if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS:
        for f in range(x.shape[1]):
            if not len(cuts[f]):
                continue
            bins = binned[rows, f]
            size = len(cuts[f]) + 1
            gl = np.cumsum(np.bincount(bins, grad[rows], size))[:-1]
            hl = np.cumsum(np.bincount(bins, hess[rows], size))[:-1]
            nl = np.cumsum(np.bincount(bins, minlength=size))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS)] = -1
            if (top := int(np.argmax(gain))) is not None and gain[top] > best[0]:
                best = (gain[top], f, top)
    if best[1] is None:
        step[rows] = -RATE * g / (h + 1)
        return
    _, f, cut = best
    below = binned[rows, f] <= cut
    for side, low in ((rows[below], True), (rows[~below], False)):
        longer = (*path, (f, float(cuts[f][cut]), low))
        rules[_simplest(longer)] = None
        _grow(x, cuts, binned, grad, hess, side, longer, depth + 1, rules, step)


def _simplest(path: tuple) -> tuple:
    """The path as a sorted conjunction with one bound per statistic and side."""
    bounds: dict = {}
    for f, cut, low in path:
        old = bounds.get((f, low))
        bounds[f, low] = cut if old is None else min(old, cut) if low else max(old, cut)
    return tuple(sorted((f, low, cut) for (f, low), cut in bounds.items()))


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Different rules ((statistic, at most?, bound), ...) of boosted trees."""
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
    cuts = [c[c < col.max()] if len(c) else c for c, col in zip(cuts, x.T)]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T)], axis=1)
    score, rules = np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        _grow(x, cuts, binned, p - y, p * (1 - p), np.arange(len(y)), (), 0, rules, step)
        score += step
    return list(rules)


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, low, cut in rule:
        out &= x[:, f] <= cut if low else x[:, f] > cut
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; columns are centred and scaled inside."""
    mean, sd = z.mean(axis=0), np.maximum(z.std(axis=0), 0.05)
    s = (z - mean) / sd
    w, b = np.zeros(z.shape[1]), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    v, vb, t = w.copy(), b, 1.0
    rate = 4 / (np.linalg.norm(s, 2) ** 2 / len(y) + 1)
    for _ in range(rounds):
        err = (1 / (1 + np.exp(-(s @ v + vb))) - y) / len(y)
        nw = v - rate * (s.T @ err)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = vb - rate * err.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        if np.abs(nw - w).max(initial=0) < 1e-7 and abs(nb - b) < 1e-7:
            w, b = nw, nb
            break
        w, b, t = nw, nb, nt
    return w / sd, float(b - (w / sd) @ mean)


class RuleEnsemble:
    """rules with weights and an intercept. Without labels of both kinds: the share of label 1 for all texts."""

    def __init__(self, x: np.ndarray, y: np.ndarray, names: list[str]):
        self.names, self.rules, self.weights, self.intercept = names, [], np.empty(0), 0.0
        share = (y.sum() + 1) / (len(y) + 2)
        self.intercept = float(np.log(share / (1 - share)))
        if len(set(y.tolist())) < 2:
            return
        rules = tree_rules(x, y)
        if not rules:
            return
        z = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
        held = np.arange(len(y)) % 5 == 0
        loss = []
        for penalty in PENALTIES if 0 < y[~held].mean() < 1 and held.any() else ():
            w, b = lasso_logistic(z[~held], y[~held], penalty)
            p = np.clip(1 / (1 + np.exp(-(z[held] @ w + b))), 1e-6, 1 - 1e-6)
            loss.append(-np.mean(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)))
        chosen = next((p for p, v in zip(PENALTIES, loss) if v <= min(loss) + TOLERANCE), PENALTIES[1])
        w, b = lasso_logistic(z, y, chosen)
        live = np.flatnonzero(np.abs(w) > 1e-6)
        self.rules, self.weights, self.intercept = [rules[k] for k in live], w[live], b

    def scores(self, x: np.ndarray) -> np.ndarray:
        """What column() computes, on an array of statistics."""
        total = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights):
            total += w * holds(rule, x)
        return 1 / (1 + np.exp(-total))

    def column(self) -> Column:
        """The score as an expression over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            bounds = [F.col(self.names[f]) <= F.lit(cut) if low else F.col(self.names[f]) > F.lit(cut) for f, low, cut in rule]
            total = total + F.when(reduce(Column.__and__, bounds), F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    """A model of label_col from labelled rows with fold() not 0, `sample` at most. Null ids, texts or labels are left out; of rows that repeat an id the one with the least text counts, of labels the larger."""
    names = list(features())
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    known = known.where(fold("_id") != 0).groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    once = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_y").alias("_y"))
    rows = with_features(once, "_text", [F.col("_id"), F.col("_y")])
    frame = rows.select("_id", "_y", *names).toPandas()
    frame = frame.assign(order=lambda f: (f["_id"].to_numpy(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).sort_values("order")
    return RuleEnsemble(frame[names].to_numpy(float), frame["_y"].to_numpy(float), names)


def quality_scores(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null texts score like empty ones, which have all statistics 0; repeated rows score alike, null ids stay
    null; other columns don't matter. No rows: no rows.
    """
    scored = with_features(docs, text_col, [F.col(id_col).cast("long").alias("doc_id")]).select("doc_id", model.column().alias("score"))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, model: RuleEnsemble, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model accepts, with docs' columns."""
    held = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    scored = with_features(docs, text_col, [held]).where(model.column() >= ACCEPT)
    return scored.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
