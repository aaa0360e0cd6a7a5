"""Source divergence audit: how far apart the sources of a language are, and which terms set each one apart.

Counts by (lang, source, term) are sparse: a source has few of its language's terms. All arithmetic is on
whole numbers. A term that neither of two sources has adds the same to their divergence, the baseline, so a
pair is V baselines, plus a correction for the counts that one side has, which needs only how often each
count occurs, plus a correction for the terms that both have, from a join on the term.

The k highest terms of each group are found by radix selection (radix_top): histograms over DIGIT_BITS bits
of the values, from the highest, find the digit in which the k-th value lies; rows above it are in, rows below
it are out, and only those of this digit go on. Rows that tie in the whole value are refined by the bytes of
their item in the same way. What is shuffled are partial histograms; no group is ever sorted or in one task.

Defined cases: null text, lang and source are ''; each row is a document, repeated ones too; a group or a
language without kept terms has pairs of value 0 and no terms; a lone source has no pairs; other columns of
the documents are not looked at, so their names may clash; an empty table gives no rows; texts of any length
are cut into words on the JVM, one row at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import lower_ascii, maybe_broadcast, store, table

MIN_DOCS, TOP = 10, 10
SCALE_STEPS, STEP = 3, 1000  # shares are in units of 1 / STEP ** SCALE_STEPS
EXTRA = 2  # added to each count
DIGIT_BITS, DIGIT_BYTES = 11, 2
#: What a term is made of once A-Z are lower-cased. Said by two ranges, as a class of what it is not is matched far more slowly.
TERM = r"[a-z\x{80}-\x{10FFFF}]+"


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """1 + floor(STEP ** SCALE_STEPS * count / total), digit by digit, so that counts up to 9e15 are exact in 64 bits."""
    out, rest = F.lit(0).cast("long"), count
    for _ in range(SCALE_STEPS):
        out, rest = out * STEP + div(rest * STEP, total), (rest * STEP) % total
    return out + 1


def distance(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), p + q)


# -- counts ------------------------------------------------------------------------------------------


def term_counts(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, c, total, first: occurrences in the source and in the language, of the terms that at least
    ``min_docs`` documents of the language have; first marks one row of each term."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    words = documents.select(text("lang").alias("lang"), text("source").alias("source"), F.regexp_extract_all(lower_ascii(text("text")), F.lit(TERM), F.lit(0)).alias("terms"))
    # each term once more, behind the others, counts the document; an outer explode, as Spark would else cut the text twice
    both = words.select("lang", "source", F.size("terms").alias("n"), F.posexplode_outer(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    counts = both.groupBy("lang", "source", "term").agg(F.count_if(F.col("at") < F.col("n")).alias("c"), F.count_if(F.col("at") >= F.col("n")).alias("df"))
    own = W.partitionBy("lang", "term")  # at most a row for each source
    whole = counts.filter("term IS NOT NULL").withColumns({"docs": F.sum("df").over(own), "total": F.sum("c").over(own), "first": F.col("source") == F.min("source").over(own)})
    return whole.filter(F.col("docs") >= min_docs).select("lang", "source", "term", "c", "total", "first")


def group_sizes(documents: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, source, own (N + EXTRA V of the group), whole (of the language), v, base (share of a term that the group lacks,
    null without kept terms), for each occurring group."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    groups = documents.select(text("lang"), text("source")).distinct()
    n = counts.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count_if("first").alias("v"))
    langs = n.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("v").alias("v"))
    sizes = groups.join(n.drop("v"), ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "lang_n", "v"])
    own, whole = F.col("n") + EXTRA * F.col("v"), F.col("lang_n") + EXTRA * F.col("v")
    return sizes.select("lang", "source", own.alias("own"), whole.alias("whole"), "v", F.when(F.col("v") > 0, share(F.lit(EXTRA).cast("long"), own)).alias("base"))


def pair_divergence(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, source, item, value: each two sources of a language, both ways round.

    ``counts`` has (lang, source, term, c, p, base). The rows of a result are those of the report; the one self-join is
    on the term, of rows that have it, and its sums are pre-aggregated."""
    left = sizes.select("lang", F.col("source").alias("a"), F.col("base").alias("ab"), "v")
    right = sizes.select("lang", F.col("source").alias("b"), F.col("base").alias("bb"))
    flat = left.join(right, "lang").filter("a < b")
    base = flat.select("lang", "a", "b", F.coalesce(F.col("v") * distance(F.col("ab"), F.col("bb")), F.lit(0)).alias("value"))
    levels = store(counts.groupBy("lang", "source", "c").agg(F.count("*").alias("k"), F.first("p").alias("p"), F.first("base").alias("base")), "divergence-levels")
    others = sizes.select("lang", F.col("source").alias("other"), F.col("base").alias("ob"))
    alone = levels.join(maybe_broadcast(others, others.count()), "lang").filter("source <> other")
    alone = alone.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (F.col("k") * (distance(F.col("p"), F.col("ob")) - distance(F.col("base"), F.col("ob")))).alias("value"))
    x = counts.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("ap"), F.col("base").alias("ab"))
    y = counts.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("bp"), F.col("base").alias("bb"))
    ap, ab, bp, bb = (F.col(n) for n in ("ap", "ab", "bp", "bb"))
    both = x.join(y, ["lang", "term"]).filter("a < b").select("lang", "a", "b", (distance(ap, bp) - distance(ap, bb) - distance(ab, bp) + distance(ab, bb)).alias("value"))
    parts = [p.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for p in (alone, both)]
    value = base.unionByName(parts[0]).unionByName(parts[1]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w")
    return value.select("lang", ways, "value").select("lang", "w.source", "w.item", "value")


# -- radix selection ---------------------------------------------------------------------------------


def _cut(rows: DataFrame, keys: list[str], digit: Column, falling: bool) -> tuple[DataFrame, DataFrame]:
    """One round for rows (keys, item, value, need, …): those that are surely among the best ``need`` of their group, and those
    of the digit in which the last of them lies, with what is still needed."""
    dealt = rows.withColumn("digit", digit)
    counts = dealt.groupBy(*keys, "digit").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    order = W.partitionBy(*keys).orderBy(F.desc("digit") if falling else F.asc("digit"))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    steps = counts.withColumn("before", before).filter("before < need")  # the digits that the best reach into
    last = F.max_by(F.struct("digit", "before", "n", "need"), "before")
    cuts = store(steps.groupBy(*keys).agg(last.alias("x")).select(*keys, F.col("x.digit").alias("at"), F.col("x.before").alias("before"), (F.col("x.before") + F.col("x.n") <= F.col("x.need")).alias("whole")), "radix-cuts")
    placed = dealt.join(maybe_broadcast(cuts, cuts.count()), keys)
    beyond = F.col("digit") > F.col("at") if falling else F.col("digit") < F.col("at")
    here = F.col("digit") == F.col("at")
    placed = store(placed.filter(beyond | here).withColumn("sure", beyond | F.col("whole")), "radix-rows")
    open_ = placed.filter("not sure").withColumn("need", F.col("need") - F.col("before"))
    columns = [c for c in rows.columns]
    return placed.filter("sure").select(*keys, "item", "value"), open_.select(*columns)


@F.pandas_udf(IntegerType())
def _common_bytes(a: pd.Series, b: pd.Series) -> pd.Series:
    def shared(x: bytes, y: bytes) -> int:
        n = min(len(x), len(y))
        return next((i for i in range(n) if x[i] != y[i]), n) if x[:n] != y[:n] else n

    return pd.Series([shared(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def radix_top(values: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, item, value, rank: the ``k`` rows of each group with the highest ``value`` (long, not negative), ties by the UTF-8
    bytes of ``item``, ascending. Items of a group are distinct; fewer than ``k`` rows all come back."""
    rows = values.select(*keys, "item", "value").withColumn("need", F.lit(k).cast("long"))
    found = []
    bits = int(values.agg(F.max("value")).first()[0] or 0).bit_length()
    for shift in range(-(-max(bits, 1) // DIGIT_BITS) * DIGIT_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        sure, rows = _cut(rows, keys, F.shiftright("value", shift).bitwiseAND((1 << DIGIT_BITS) - 1), True)
        found.append(sure)
    while rows.limit(1).count():  # ties in the whole value: skip what their items share, then take the next bytes
        ends = rows.groupBy(*keys).agg(F.min("item").alias("lo"), F.max("item").alias("hi"))
        same = store(ends.select(*keys, _common_bytes(F.encode("lo", "utf-8"), F.encode("hi", "utf-8")).alias("same")), "radix-ties")
        told = rows.join(maybe_broadcast(same, same.count()), keys)
        digit = F.hex(F.substring(F.encode("item", "utf-8"), F.col("same") + 1, F.lit(DIGIT_BYTES)))
        sure, rows = _cut(told, keys, digit, False)
        rows = rows.drop("same")
        found.append(sure)
    best = found[0]
    for f in found[1:]:
        best = best.unionByName(f)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("value"), "item"))  # of at most k rows
    return best.withColumn("rank", rank)


def divergence(documents: DataFrame, top: int = TOP, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: part pair has the other sources of the language, part term the ``top`` terms that
    are more frequent in the source than in its language."""
    counts = store(term_counts(documents, min_docs), "divergence-counts")
    sizes = store(group_sizes(documents, counts), "divergence-sizes")
    known = counts.join(maybe_broadcast(sizes, sizes.count()), ["lang", "source"])
    extra = F.lit(EXTRA).cast("long")
    known = store(known.select("lang", "source", "term", "c", share(F.col("c") + extra, F.col("own")).alias("p"), share(F.col("total") + extra, F.col("whole")).alias("q"), "base"), "divergence-shares")
    pairs = pair_divergence(known, sizes)
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    above = known.filter("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    terms = radix_top(above, ["lang", "source"], top)
    both = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = {
    "op11_source_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM (SELECT lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
n AS (SELECT lang, source, sum(c) AS n FROM f GROUP BY ALL),
l AS (SELECT lang, term, sum(c) AS c FROM f GROUP BY ALL),
ln AS (SELECT lang, sum(c) AS n FROM l GROUP BY lang),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 2)::HUGEINT) // (n + 2 * v)::HUGEINT AS q FROM l JOIN ln USING (lang) JOIN v USING (lang)),
p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 2)::HUGEINT) // (n + 2 * v)::HUGEINT AS p FROM f JOIN n USING (lang, source) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
QUALIFY part = 'pair' OR rank <= 10"""
}
