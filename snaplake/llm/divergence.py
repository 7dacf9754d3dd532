"""How the term frequencies of a language's sources differ, from wide term vectors.

Terms are counted once over all documents, in Arrow batches: occurrences for each language and source, and
documents for each language. Each kept term of a language then becomes one row with an array of its smoothed
frequencies, a place for each source. Higher-order functions emit the differences of a term between all pairs
of sources from that array, and partial sums of them meet before the shuffle.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snaplake.llm.common import durable, slices

#: Documents of the language that a kept term is in at least, share of frequencies, added occurrences, ranks of the report's terms.
LEAST_DOCS, SCALE, ADDED, RANKS = 30, 1_000_000_000, 5, 50
#: Different terms that a task counts before it hands them on.
HELD = 500_000
#: Bytes that are part of a term: letters of ASCII and all beyond it. Others are blanks; only A-Z are lowered.
_LOWERED = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_LOWERED).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (null: the group's documents), n (occurrences), docs (documents with the term)."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter, list]] = {}

        def told():
            for (lang, source), (n, docs, total) in held.items():
                words = [None, *n]
                kinds = pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()
                columns = [lang] * len(words), [source] * len(words), words, [0, *n.values()], [total[0], *(docs[w] for w in n)]
                for i in range(0, len(words), 50_000):
                    yield pa.record_batch([pa.array(c[i : i + 50_000], k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text"))):
                    n, docs, total = held.setdefault((lang, source), (Counter(), Counter(), [0]))
                    words = terms_of(text)
                    n.update(words)
                    docs.update(set(words))
                    total[0] += 1
                if sum(len(x[0]) + 1 for x in held.values()) > HELD:
                    yield from told()
        yield from told()

    counted = texts.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n, total, kept):
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * kept)), exact; null where no term is kept."""
    added = n + F.lit(ADDED)
    whole = total + F.lit(ADDED) * kept
    return F.when(whole > 0, F.call_function("div", F.lit(SCALE) * added.cast("decimal(28,0)"), whole.cast("decimal(28,0)")) + 1)


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language its difference from every other one
    (part pair), and the kept terms that it uses more than the language does (part term, `ranks` of them).

    Null lang, source and text count as ''. Terms are runs of ASCII letters and characters beyond ASCII, A-Z
    lowered; a language keeps those in at least `least_docs` of its documents. A kept term's share of a group is
    1 + floor(10**9 * (count + 5) / (N + 5 * V)). Sources without terms take part; where a language keeps no term
    all differences are 0. Repeated rows count each time. Equal values: the smaller item by UTF-8 first. Other
    columns are ignored, an empty table gives no rows. A row holds a number for each source of its language.
    """
    counts = durable(term_counts(docs))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = durable(counts.where("term is null").select("lang", "source").withColumn("at", place))
    used = counts.where("term is not null").join(groups, ["lang", "source"])
    wide = used.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("n"))
    wide = durable(wide.where(F.col("docs") >= least_docs).select("lang", "term", "total", "n"))

    # of each language: the kept terms, and a place for each source with the occurrences of them
    summed = wide.select("lang", F.explode("n").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n"))
    sources = groups.join(summed, ["lang", "at"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "source", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))
    kept = wide.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("whole"))
    langs = sources.join(kept, "lang", "left").select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("whole", F.lit(0)).alias("whole"), F.col("s.source").alias("sources"), F.col("s.n").alias("totals"))
    langs = durable(langs)

    p = F.transform("totals", lambda total, i: share(F.coalesce(F.try_element_at("n", i), F.lit(0)), total, F.col("kept")))
    vectors = durable(wide.join(langs.drop("sources"), "lang").select("lang", "term", "n", share(F.col("total"), F.col("whole"), F.col("kept")).alias("q"), p.alias("p")))

    # a row for each first source of a term, then one for each second: no row holds all pairs
    firsts = vectors.select("lang", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("i")).where(F.col("i") < F.size("p") - 1)
    rest = F.expr("transform(slice(p, i + 2, size(p)), (x, k) -> struct(i + 1 + k as j, abs(x - p[i]) as f))")
    apart = firsts.select("lang", "i", F.explode(rest).alias("x")).groupBy("lang", "i", F.col("x.j").alias("j")).agg(F.sum("x.f").alias("value"))
    both = apart.unionByName(apart.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    named = groups.select("lang", F.col("source"), F.col("at").alias("i")).join(langs.select("lang", F.posexplode("sources").alias("j", "item")), "lang").where("i <> j")
    pairs = named.join(both, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    more = vectors.select("lang", "q", F.col("term").alias("item"), F.explode(F.map_entries("n")).alias("e"), "p")
    more = more.select("lang", F.col("e.key").alias("at"), "item", (F.get("p", F.col("e.key")) - F.col("q")).alias("value"), F.col("e.value").alias("n")).where("n > 0 and value > 0")
    best = F.row_number().over(Window.partitionBy("lang", "at").orderBy(F.desc("value"), "item"))
    more = more.withColumn("rank", best).where(F.col("rank") <= ranks)
    more = more.join(groups, ["lang", "at"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", order).select(*more.columns).unionByName(more)
