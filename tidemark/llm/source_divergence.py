"""Source divergence audit: how far the sources of a language are apart in their words, and which words set a source apart.

Wide term vectors: the counts of a term are pivoted into an array with one place for each source of the language. Higher-order
functions turn it into smoothed shares p and emit the contribution floor((p - q)^2 / q) of every ordered pair of sources; they
are summed by language and pair, map-side first, so a shuffle carries one row a pair and task. All arithmetic is on
integers, exact for languages of up to 2.9e14 words.

Only DataFrame functions are used. Terms are counted map-side first, so a hot source or a frequent term costs each task one row; a term
meets one row a task, or one a source. Pairs of sources that both lack a term get the same from each such term: they are counted, not emitted. The
frames of one row a language (its sources, their totals) hold as many numbers as there are groups; they are broadcast up to
FEW groups, and beyond that they are copied SALTS times and joined with the vectors by language and salt. The pairs that come
out are as many as the contract asks for, the square of a language's sources.

Defined cases: null text, lang and source count as ''; a group or language without kept terms is there, with value 0 for each
pair and no term rows; ties are broken by the UTF-8 order of the item; repeated rows are documents of their own; ids
aren't looked at; very long texts are counted whole; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textops import written

#: What stands between terms; splitting is linear in a text, extracting matches isn't.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A share of 1 is this many units; as a product of two factors, so that a division can be done in two steps within 64 bits.
STEP, REST = 32_000, 31_250
#: Up to so many groups, what is known of languages is broadcast (about 50 MB); beyond, it is copied SALTS times for a join.
FEW, SALTS = 1_000_000, 64
#: Up to so many sources of a language, vectors are summed place by place; beyond, their places are collected from counts by source.
WIDE = 32


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(STEP * REST * (count + 1) / (total + terms)), exactly."""
    d, x = total + terms, (count + 1) * STEP
    return 1 + div(x, d) * REST + div((x % d) * REST, d)


def apart(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), q)


def words(docs: DataFrame) -> DataFrame:
    """The columns of docs but the text, and each term of each text: `term`, and `first`, 1 at a term's first place in its document, else 0."""
    # lower() changes other letters too, so only texts in ASCII get it. An outer explode has no filter before it that would split and sort once more.
    text = F.when(F.octet_length("text") == F.char_length("text"), F.lower("text")).otherwise(F.translate("text", UPPER, LOWER))
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(*rest, F.sort_array(F.split(text, GAP)).alias("_w")).select(*rest, "_w", F.posexplode_outer("_w").alias("_k", "term"))
    first = F.when(F.col("_k") == 0, 1).when(F.get("_w", F.col("_k") - 1) != F.col("term"), 1).otherwise(0)
    return rows.where("term <> ''").select(*rest, "term", first.cast("long").alias("first"))


def vectors(docs: DataFrame, groups: DataFrame, sources: DataFrame, least: int, few: bool) -> DataFrame:
    """lang, term, counts (by place of the source among those of the language) of the terms in at least `least` documents."""
    k = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    if few and k <= WIDE:
        # One sum for each place, so that the vectors grow map-side and are shuffled once.
        placed = sources.select(F.col("lang"), F.posexplode("sources").alias("_place", "source"))
        rows = words(docs.join(F.broadcast(placed), ["lang", "source"]).select("lang", "_place", "text"))
        sums = [F.sum(F.when(F.col("_place") == i, F.lit(1)).otherwise(F.lit(0)).cast("long")).alias(f"_{i}") for i in range(k)]
        kept = rows.groupBy("lang", "term").agg(F.sum("first").alias("docs"), *sums).where(F.col("docs") >= least)
        return _meet(kept, sources, few).select("lang", "term", F.slice(F.array(*[f"_{i}" for i in range(k)]) if k else F.array().cast("array<bigint>"), F.lit(1), F.size("sources")).alias("counts"))
    counts = words(docs).groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum("first").alias("docs"))
    pivot = F.map_from_entries(F.collect_list(F.struct("source", "n")))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), pivot.alias("by_source")).where(F.col("docs") >= least)
    return _meet(kept, sources, few).select("lang", "term", F.transform("sources", lambda s: F.coalesce(F.try_element_at("by_source", s), F.lit(0).cast("long"))).alias("counts"))


def _meet(vectors: DataFrame, langs: DataFrame, few: bool) -> DataFrame:
    """vectors (lang, term, ..) with what is known of their language."""
    if few:
        return vectors.join(F.broadcast(langs), "lang")
    salted = langs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return vectors.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "_salt"]).drop("_salt")


def audit(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part (pair: item is another source of the language; term: item is a term), item, value, rank. least: documents of
    a language that a kept term is in; top: ranks of part term."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    groups, _ = written(docs.select("lang", "source").distinct(), "audit-groups")
    few = groups.count() <= FEW
    sources = groups.groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources"))

    kept, _ = written(vectors(docs, groups, sources, least, few), "audit-vectors")

    totals = kept.select("lang", F.posexplode("counts").alias("place", "n")).groupBy("lang", "place").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    langs = totals.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "n"))), lambda t: t["n"]).alias("totals"), F.max("terms").alias("terms"), F.sum("n").alias("total"))
    shares = _meet(kept, langs, few).select(
        "lang",
        "term",
        "counts",
        F.transform("counts", lambda c, k: share(c, F.get("totals", k), F.col("terms"))).alias("p"),
        share(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c), F.col("total"), F.col("terms")).alias("q"),
    )

    # Of a source that has the term the contributions to all sources, of another those to the sources that have it; where neither has it, all terms contribute alike.
    some = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.get("counts", i) > 0)
    near = shares.select("lang", "counts", "p", some.alias("some")).select("*", F.transform("some", lambda i: F.get("p", i)).alias("p_some"))
    near = near.select("*", F.posexplode_outer("p").alias("i", "own")).withColumn("has", F.get("counts", F.col("i")) > 0)
    each = F.transform(F.when(F.col("has"), F.col("p")).otherwise(F.col("p_some")), lambda q: apart(F.col("own"), q))
    near = near.select("lang", "i", "has", "some", F.posexplode_outer(each).alias("at", "f")).select("lang", "i", F.when(F.col("has"), F.col("at")).otherwise(F.get("some", F.col("at"))).alias("j"), "f")
    sums = near.where("j is not null").groupBy("lang", "i", "j").agg(F.sum("f").alias("f"), F.count("*").alias("n"))
    placed = sources.select("lang", F.posexplode("sources").alias("i", "source"))
    rest = langs.select("lang", "terms", F.posexplode("totals").alias("i", "n")).select("lang", "terms", "i", share(F.lit(0).cast("long"), F.col("n"), F.col("terms")).alias("none"))
    placed = placed.join(rest, ["lang", "i"], "left")
    pairs = placed.join(placed.select("lang", F.col("i").alias("j"), F.col("source").alias("item"), F.col("none").alias("other")), "lang").where("i != j").join(sums, ["lang", "i", "j"], "left")
    alike = (F.col("terms") - F.coalesce("n", F.lit(0))) * apart(F.col("none"), F.col("other"))
    value = F.coalesce(F.coalesce("f", F.lit(0)) + alike, F.lit(0).cast("long"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by))

    over = shares.select("lang", "term", "q", F.posexplode_outer(F.arrays_zip("counts", "p")).alias("i", "own"))
    over = over.where((F.col("own.counts") > 0) & (F.col("own.p") > F.col("q"))).select("lang", "i", F.col("term").alias("item"), apart(F.col("own.p"), F.col("q")).alias("value"))
    # The limit on ranks goes before the shuffle, so a group's terms never meet in one task.
    over = over.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "i").orderBy(F.col("value").desc(), "item"))).where(F.col("rank") <= top)
    terms = over.join(placed.select("lang", "i", "source"), ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
own AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
c AS (SELECT g.lang, g.source, kept.term, coalesce(own.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS p FROM c WINDOW w AS (PARTITION BY lang, source)),
a AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS q FROM a WINDOW w AS (PARTITION BY lang)),
s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source != y.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g JOIN g h ON g.lang = h.lang AND g.source != h.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms)) WHERE part = 'pair' OR rank <= 200"""
