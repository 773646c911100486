"""Periodic run detection: all maximal repetitions of words in each text, by Kolpakov and Kucherov's algorithm.

A run is a stretch of words [start, start + length) with smallest period q (words q apart are equal) that no neighbouring
word extends, and of length max(least, 2 * q) or more. A text is cut into LZ factors with a suffix automaton of its words.
A run that crosses or touches a factor's edge is found with Main's extensions to both sides of the edge; every other run
lies inside a factor and is copied from that factor's earlier occurrence. All of it is linear in the words and the runs.

Before that, what can't hold a run is set aside, exactly: with least >= 12, the pairs of equal words q apart that make up a
run are at least GRAM in a row, so every word of a run lies in a GRAM-gram that the text has twice, and so does no
word beside it that would extend the run. The algorithm gets the stretches of such words, one at a time.

One text is looked at by one task, in memory that is linear in its words (some hundred bytes a word of a stretch); texts never meet, so
no key, source or group of copies matters, and a lost executor costs the rows of its partitions.

Defined cases: null and empty texts and texts of white space have no runs and collapse to an empty text; a text of
one word repeated is one run of period 1; null ids, repeated rows and ids are rows of their own; ties among runs are broken
by start, then period; an empty table gives an empty one; columns other than the text come out if they are asked for by name.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import U64, lean, mix64, shingles, slices, word_hashes

#: Words of a gram that a run repeats: a run of 12 words or more has at least 6 pairs of equal words in a row.
GRAM = 6
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
GAP = r"[\x20\x09-\x0D]+"


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """LZ factors (start, end, start of an earlier occurrence or -1) of w: each is the longest stretch that also starts earlier, or one new word."""
    # The suffix automaton: a state's first transition stands in `word`, `to`, any others in `more`.
    length, link, seen, word, to = (array("q", [v]) for v in (0, -1, -1, -1, -1))
    more: dict[int, dict[int, int]] = {}
    last = 0
    for i, x in enumerate(w):
        now = len(length)
        length.append(length[last] + 1)
        link.append(0)
        seen.append(i)
        word.append(-1)
        to.append(-1)
        p, q = last, -1
        while p >= 0:
            y = word[p]
            if y == x:
                q = to[p]
                break
            if y < 0:
                word[p], to[p] = x, now
            else:
                m = more.get(p)
                if m is None:
                    more[p] = {x: now}
                elif x in m:
                    q = m[x]
                    break
                else:
                    m[x] = now
            p = link[p]
        if q >= 0:
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                seen.append(seen[q])
                word.append(word[q])
                to.append(to[q])
                if q in more:
                    more[twin] = dict(more[q])
                while p >= 0:
                    if word[p] == x:
                        if to[p] != q:
                            break
                        to[p] = twin
                    else:
                        m = more.get(p)
                        if m is None or m.get(x) != q:
                            break
                        m[x] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    out, i, n = [], 0, len(w)
    while i < n:
        s, j, end = 0, i, -1
        while j < n:
            s = to[s] if word[s] == w[j] else more[s][w[j]]
            if seen[s] >= j:
                break
            end = seen[s]
            j += 1
        if j == i:
            out.append((i, i + 1, -1))
            i += 1
        else:
            out.append((i, j, end - (j - i) + 1))
            i = j
    return out


def prefixes(s: list[int]) -> list[int]:
    """The length of the longest common prefix of s and each of its ends (0 for s itself)."""
    n, z, left, right = len(s), [0] * len(s), 0, 0
    first = s[0] if s else None
    for i in range(1, n):
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        elif s[i] != first:
            continue
        else:
            k = 1
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i], left, right = k, i, i + k
    return z


def runs(w: list[int], least: int = 12) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of w by start, then period."""
    n, found = len(w), {}

    def add(s: int, e: int, p: int) -> None:
        ends = found.setdefault(s, {})
        if p < ends.get(e, n):
            ends[e] = p

    def at_edge(s: int, e: int, p: int) -> None:
        if e - s >= least and not (s > 0 and w[s - 1] == w[s - 1 + p]) and not (e < n and w[e] == w[e - p]):
            add(s, e, p)

    before = 0
    for b, c, source in [*factors(w), (n, n, -1)]:
        here = c - b
        if b and 2 * (before + here) > least:
            # A run that ends in (b, c] starts less than 2 * before + here words before b, else the factor before would have been longer.
            left, right = w[max(0, b - 2 * before - here) : b], w[b:c]
            nl, nr = len(left), len(right)
            on = prefixes([*right, -1, *left, *right])
            back = left[::-1]
            back = prefixes([*back, -1, *right[::-1], *back])
            # Runs that reach a period or more to the right of b, and those that reach a period or more to its left.
            for p in range(1, nr + 1):
                more = on[nr + 1 + nl + p] if p < nr else 0
                less = back[nl + 1 + nr - p]
                if more + less >= p:
                    at_edge(b - less, b + p + more, p)
            for p in range(1, min(nl, before + here) + 1):
                more = on[nr + 1 + nl - p]
                less = back[nl + 1 + nr + p] if p < nl else 0
                if more + less >= p:
                    at_edge(b - p - less, b + more, p)
        if found and source >= 0 and here > least + 1:
            far, stop = b - source, source + here
            for s in range(source + 1, stop - least):
                for e, p in list(found.get(s, {}).items()):
                    if e < stop:
                        add(s + far, e + far, p)
        before = here
    return sorted((s, e - s, p) for s, ends in found.items() for e, p in ends.items())


def _stretches(hashes: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Of each row that has a gram twice, the stretches (word numbers from, to) of words in such grams."""
    h, off = shingles(hashes, first, GRAM)
    row = np.repeat(np.arange(len(first) - 1), np.diff(off))
    key = mix64(h + row.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return {}
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    hit = np.flatnonzero(twice[at] == key)
    start = first[row[hit]] + hit - off[row[hit]]
    covered = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(covered, start, 1)
    np.add.at(covered, start + GRAM, -1)
    covered = np.cumsum(covered)[:-1] > 0
    out = {}
    for r in np.unique(row[hit]).tolist():
        edges = np.flatnonzero(np.diff(np.concatenate(([False], covered[first[r] : first[r + 1]], [False])).astype(np.int8)))
        out[r] = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    return out


def runs_of_words(words: list, stretches: list[tuple[int, int]], least: int) -> tuple[list, np.ndarray | None]:
    """The runs of a text by start, then period, and which words stay when each run keeps its first period only (None: all)."""
    out, drop = [], None
    for a, b in stretches:
        if b - a < least:
            continue
        ids: dict = {}
        got = runs([ids.setdefault(x, len(ids)) for x in words[a:b]], least)
        out += [(a + s, n, p) for s, n, p in got]
    if out:
        drop = np.zeros(len(words) + 1, np.int64)
        for s, n, p in out:
            drop[s + p] += 1
            drop[s + n] -= 1
        drop = np.cumsum(drop)[:-1] > 0
    return out, drop


def detect(docs: DataFrame, keep: list[str], text: str | Column = "text", least: int = 12) -> DataFrame:
    """The columns `keep`, `runs` (array of start, length, period by start, then period) and `collapsed` (the words that stay when
    each run keeps its first period only, joined by one space) of every row. least: words that a run has at least, 12 or more."""
    if least < 2 * GRAM:
        raise ValueError(f"least must be {2 * GRAM} or more")
    kept = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), f"runs {RUNS}", "collapsed string"])

    def apply(batches):
        for batch in batches:
            at = batch.schema.names.index("_text")
            own = [batch.column(k) for k in range(batch.num_columns) if k != at]
            for a, data, off in slices(batch.column(at)):
                n = len(off) - 1
                hashes, first = word_hashes(data, off)
                some = _stretches(hashes, first) if len(hashes) else {}
                found, ends, texts = [], [0], []
                for r in range(n):
                    words = data[off[r] : off[r + 1]].tobytes().split()
                    if r in some:
                        got, drop = runs_of_words(words, some[r], least)
                        found += got
                        if drop is not None:
                            words = [x for x, d in zip(words, drop.tolist(), strict=True) if not d]
                    ends.append(len(found))
                    texts.append(b" ".join(words))
                each = np.array(found, np.int64).reshape(-1, 3)
                each = pa.StructArray.from_arrays([pa.array(each[:, k]) for k in range(3)], ["start", "length", "period"])
                each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, n) for c in own), each, pa.array(texts, pa.binary()).view(pa.string())], [*keep, "runs", "collapsed"])

    column = F.col(text) if isinstance(text, str) else text
    return docs.select(*keep, column.alias("_text")).mapInArrow(lean(apply), schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, of which each id with crc32(id) % 10 = 0 has its words from a = g % n on, g = floor(crc32(id) / 10), replaced by repeats of the first 1 + floor((n - a) / (3 + g % 8)) of them."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, GAP), lambda w: w != "")

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # One array of words, whatever reads it: a let through transform.
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(F.lit(""))), F.lit(0))
    return F.when(h % 10 == 0, changed).otherwise(text)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; nulls without runs) and the digests of all runs and of the collapsed text."""
    found = detect(docs, ["doc_id"], planted(F.col("doc_id"), F.col("text")))
    # The greatest of (length, -start, -period): among runs of one length the first start, then the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, period = -F.col("b.start"), -F.col("b.period")
    return found.select("doc_id", "n_runs", start.alias("start"), F.col("b.length").alias("length"), period.alias("period"), F.expr("(1000 * b.length) div (-b.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
