"""The audit against plain Python and its SQL, on awkward tables."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from tidemark.llm import source_divergence

FOLD = str.maketrans(source_divergence.UPPER, source_divergence.LOWER)


def expected(rows, least=3, top=200):
    docs = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(FOLD))) for t, la, so in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, counts = Counter(), defaultdict(Counter)
        for la, so, words in docs:
            if la == lang:
                df.update(set(words))
                counts[so].update(words)
        kept = sorted(t for t, n in df.items() if n >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {so: share(c) for so, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        apart = lambda a, b: (a - b) ** 2 // b
        for so in p:
            found = {"pair": [(sum(apart(p[so][t], p[other][t]) for t in kept), other) for other in p if other != so], "term": [(apart(p[so][t], q[t]), t) for t in kept if counts[so][t] > 0 and p[so][t] > q[t]]}
            for part, items in found.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, so, part, item, value, k + 1) for k, (value, item) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcXYZéÉß") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    rows = [(" ".join(rng.choice(vocab) + rng.choice(["", ",", "'s", "2", "-"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", "en", None]), rng.choice(["a", "b", "a", "é", "B", None, ""])) for _ in range(300)]
    rows += [(None, "en", "only null"), ("", "en", "empty"), ("12 34 !", "num", "x"), ("once", "lone", "y"), ("seen twice", "lone", "z"), ("Hot hot " * 20000, "en", "a"), rows[0], rows[0], ("日本 日本 𝔘𝔫 𝔘", "en", "cjk"), ("日本 𝔘 Å", "en", "cjk"), ("日本 𝔘 å", "en", "a"), (None, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("term", "n", "i", "p", "item", "value", "counts")})


@pytest.mark.parametrize("few, wide, top", [(10**6, 32, 200), (10**6, 2, 200), (0, 32, 3)])
def test_audit_is_plain_python(spark, corpus, monkeypatch, few, wide, top):
    monkeypatch.setattr(source_divergence, "FEW", few)
    monkeypatch.setattr(source_divergence, "WIDE", wide)
    got = source_divergence.audit(frame(spark, corpus).repartition(3), top=top)
    assert got.dtypes[4:] == [("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == expected(corpus, top=top)


def test_sql_is_plain_python(corpus):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [(k, *r) for k, r in enumerate(corpus)])
    assert sorted(con.sql(source_divergence.ORACLE_SQL).fetchall()) == expected(corpus)


def test_empty_table(spark, corpus):
    assert source_divergence.audit(frame(spark, corpus[:1]).where("false")).count() == 0


def test_shares_are_exact_where_products_pass_64_bits(spark):
    rows = [(c, n, v) for c in (0, 7, 10**10, 12345678901234) for n in (c, 10**13, 29 * 10**13) for v in (1, 10**6) if n >= c]
    got = spark.createDataFrame(rows, "c long, n long, v long").select("c", "n", "v", source_divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 1) // (r.n + r.v) for r in got)
