"""Periodic runs against all periods of all stretches, and the query's digests against plain Python."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F
from tidemark.llm import periodic_runs


def brute(w, least=12):
    """Every maximal stretch of each period, smallest period first."""
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, 2 * p):
                out.setdefault((s, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def sequences(n=600, longest=120):
    rng = random.Random(4)
    for trial in range(n):
        size, letters = rng.randint(0, longest), rng.choice([1, 2, 2, 3, 6])
        w = []
        while len(w) < size:
            if w and trial % 3 and rng.random() < 0.6:
                a = rng.randrange(len(w))
                for k in range(rng.randint(1, 30)):
                    w.append(w[a + k])
            else:
                w.append(rng.randrange(letters))
        yield w


def test_runs_are_brute_force():
    for w in sequences():
        for least in (1, 4, 12):
            assert periodic_runs.runs(w, least) == brute(w, least), w


def test_factors_are_the_longest_earlier_stretches():
    for w in sequences(200, 60):
        i = 0
        for b, c, source in periodic_runs.factors(w):
            assert b == i
            longest = max((next((k for k in range(len(w) - b) if w[j + k] != w[b + k]), len(w) - b) for j in range(b)), default=0)
            assert c - b == max(longest, 1) and (source == -1) == (longest == 0) and (source < 0 or w[source : source + c - b] == w[b:c])
            i = c
        assert i == len(w)


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    drop = {k for s, length, p in found for k in range(s + p, s + length)}
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in drop).encode()).hexdigest())


def test_query_is_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        w = [rng.choice("aAbcdefghijklmnopqé") * rng.randint(1, 2) for _ in range(rng.choice([1, 2, 11, 12, 30, 200]))]
        if i % 4 == 0:
            q, a = rng.randint(1, 20), rng.randrange(len(w))
            w[a:] = (w[a : a + q] * (len(w) // q + 1))[: len(w) - a]
        if i % 9 == 0:
            w += w[: rng.randint(1, len(w))] * 3
        rows.append((i, " ".join(w).replace(" b", "\n\tb")))
    rows += [(1000, None), (1001, ""), (1002, " \n\t\x0b"), (1003, "ho " * 5000), (None, "x y " * 20), (None, None), (3, rows[3][1]), (1004, "　   " * 9), (1005, "A a " * 30 + "é É " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("runs", "collapsed", "b", "start", "_text2")}).repartition(3)
    got = periodic_runs.digest(df)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes[1:6]} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert periodic_runs.digest(df.where("false")).count() == 0


def test_operator_returns_runs_and_texts(spark):
    text = "intro " + "one two three " * 5 + "end"
    (row,) = periodic_runs.detect(spark.createDataFrame([(7, text, "s")], "doc_id long, text string, source string"), ["source", "doc_id"]).collect()
    assert row.asDict(True) == {"source": "s", "doc_id": 7, "runs": [{"start": 1, "length": 15, "period": 3}], "collapsed": "intro one two three end"}
