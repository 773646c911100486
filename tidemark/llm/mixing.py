"""Mixing sources to target weights: cube-method balanced sampling.

Every document of a source is wanted target / source_size times in expectation, between
0 and 2. Its whole part is taken outright; its fraction is settled by the cube method,
which keeps each source's taken words and number of documents where they are expected.
The flight runs in blocks of about BLOCK documents of one source, each on its own; what a
block leaves open (two documents, and LANDING of spread sizes that sat out) meets the leftovers of
other blocks on the next level, until a source has one block: the landing problem.

Defined cases: null text has size 0; a document of size 0 is never taken; null sources form
one source that sorts last; an empty table gives an empty one; a table without any word has
all targets 0; repeated rows are units of their own, counted first and dealt to blocks one by
one, so that rows that are alike can't fill a block; results depend on the rows and the seed
alone, so reruns agree. Other columns of the table aren't looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents that a block of the flight phase holds on average.
BLOCK = 4096
#: Documents kept for the landing problem, which tries all ways to round them.
LANDING = 12
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, n_docs, target. sizes: source, size, one row per document."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # One row per source from here on; a window over all of them is as large as the number of sources.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.lit(list(weights)).cast("array<double>"), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    rank = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The level at which the shares of the sources not yet stopped add up, if all sources before this one are stopped.
    level = (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level)
    final = F.min(F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct((F.col("cap") / F.col("w")).alias("r"), "level"))).over(everything)
    return per.withColumn("_final", final["level"]).select(
        "source", "source_size", "n_docs", F.when(F.col("_final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("_final") * F.col("w"))).cast("double").alias("target")
    )


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, last: bool = False) -> np.ndarray:
    """Moves p to 0 or 1 along the null space of (size, 1) until a few entries are open; with last, those too."""
    p, eps = p.astype(float).copy(), 1e-9
    p[p < eps], p[p > 1 - eps] = 0.0, 1.0
    order, s, back = np.flatnonzero((p > 0) & (p < 1)), size.astype(float), np.zeros(0, np.int64)
    if len(order) > 4:
        # A few documents of spread sizes wait for the landing.
        by_size = order[np.argsort(s[order], kind="stable")]
        back = by_size[np.unique(np.linspace(0, 0.7 * (len(order) - 1), min(LANDING, len(order) // 2)).astype(int))]
        order = np.setdiff1d(order, back)
    held, draws, k = [], rng.random(len(order) + 4), 0
    for i in order.tolist():
        held.append((i, s[i], p[i]))
        if len(held) < 3:
            continue
        (a, sa, pa), (b, sb, pb), (c, sc, pc) = held
        ua, ub, uc = sb - sc, sc - sa, sa - sb
        if ua == ub == uc == 0:
            ua, ub, uc = 1.0, -1.0, 0.0
        up = min((1 - x) / u if u > 0 else -x / u for x, u in ((pa, ua), (pb, ub), (pc, uc)) if u)
        down = min(x / u if u > 0 else (x - 1) / u for x, u in ((pa, ua), (pb, ub), (pc, uc)) if u)
        step = up if draws[k] * (up + down) < down else -down
        k += 1
        held = []
        for j, sj, pj in ((a, sa, pa + step * ua), (b, sb, pb + step * ub), (c, sc, pc + step * uc)):
            pj = 0.0 if pj < eps else 1.0 if pj > 1 - eps else pj
            p[j] = pj
            if 0 < pj < 1:
                held.append((j, sj, pj))
    if last and (held or len(back)):
        # Landing: of all ways to round what is open, the one whose words, then whose number, come nearest to what is expected.
        at = np.array([*[j for j, _, _ in held], *back.tolist()], np.int64)
        ways = np.arange(1 << len(at))[:, None] >> np.arange(len(at)) & 1
        words, number = np.abs(ways @ s[at] - s[at] @ p[at]), np.abs(ways.sum(1) - p[at].sum())
        p[at] = ways[np.lexsort((np.arange(len(ways)), number, words + 0.05 * s[at].mean() * number))[0]]
    return p


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 1, block: int = BLOCK, mark: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (copies x size) of each row of docs (doc_id, text, source); with mark, an expression that tells rows apart, that as `mark` too."""
    from .textops import written

    own = ["mark"] if mark is not None else []
    like = docs.select("doc_id", "source", words(F.col("text")).alias("size"), *([mark.alias("mark")] if own else []))
    # Rows that are alike are counted, then numbered: no group of them meets in one task.
    like = like.groupBy("doc_id", "source", "size", *own).agg(F.count("*").alias("_n"))
    sized, _ = written(like.withColumn("unit", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("_n"), "mix-sizes")
    per = targets(sized, weights, share, most)
    wish = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = sized.join(per.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    units = units.withColumn("wish", wish).withColumn("whole", F.floor("wish").cast("long")).withColumn("open", F.col("wish") - F.col("whole"))
    blocks = F.greatest(F.ceil(F.col("n_docs") / block), F.lit(1))
    units = units.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "unit", *own), blocks)).drop("wish", "n_docs")
    largest = per.agg(F.max("n_docs")).first()[0] or 0
    schema = units.schema

    def settle(last: bool, level: int):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["doc_id", "size", *own, "unit"], kind="stable", na_position="last", ignore_index=True)
            key = int(pdf["block"].iloc[0]) if len(pdf) else 0
            rng = np.random.default_rng([seed, level, key, int(pdf["size"].sum()) & 0xFFFFFFFF])
            pdf["open"] = flight(pdf["size"].to_numpy(), pdf["open"].to_numpy(), rng, last)
            return pdf

        return one

    done, count, level = None, -(-largest // block), 0
    while True:
        last = count <= 1
        moved = units.groupBy("source", "block").applyInPandas(settle(last, level), schema)
        if not last:
            moved, _ = written(moved, f"mix-level{level}")
        shut = moved.where("open <= 0 or open >= 1")
        done = shut if done is None else done.unionByName(shut)
        if last:
            break
        fan = max(2, block // (2 * LANDING + 4))
        units, count, level = moved.where("open > 0 and open < 1").withColumn("block", F.floor(F.col("block") / fan)), -(-count // fan), level + 1
    copies = (F.col("whole") + F.round("open").cast("long")).alias("copies")
    return done.select("doc_id", "source", "size", "source_size", "target", copies, ((F.col("whole") + F.round("open").cast("long")) * F.col("size")).alias("taken"), *own)
