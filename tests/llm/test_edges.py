"""Every query and pipeline stage over tables of awkward rows (nulls in each column, clashing extra columns, copies, one long text) and over empty ones."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tidemark.llm import queries

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
}
#: Names that operators use inside or return.
CLASH = ("size", "score", "n", "part", "extra", "term", "row", "_id", "_to", "component_id", "host", "path", "rule", "verdict", "n_shingles", "taken", "target", "copies", "predicted", "head", "prev", "spans", "lang_pred", "fingerprint", "bucket", "band", "item", "h", "key", "label", "w", "u")


def rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 7))) for _ in range(120)]
    bench = [(k, " ".join(rng.choice(vocab) for _ in range(25))) for k in range(4)]
    docs, labels = [], []
    for i in range(60):
        t = " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 4, 5, 30, 90])))
        if i % 10 == 3:
            t += " " + bench[i % 4][1]
        if i % 3 == 0:
            t += " vile grumpf"
        docs.append((i, t, "en" if i % 2 else "xx", f"s{i % 2}", len(t)))
        labels.append((i, 1, int(i % 3 == 0)))
    odd = [(60, None, None, None, None), (61, "", None, "s1", 0), (None, "null id words here to share now", "en", "s0", 5), (None, None, None, None, None), (62, " \t\n", "en", None, 3), (63, "wide " * 20000, "xx", "s0", 100000), (64, "x" * 100000, None, "s1", None)]
    docs += odd + docs[:3] + [(70 + k, docs[4][1], "en", "s0", 1) for k in range(12)]
    labels += [(None, None, None), (60, None, 1), (61, 0, None), (3, 1, 1), (9999, 1, 1)]
    page = "<html><body><nav>home about</nav><article><p>{}</p><p>second &amp; last</p></article><footer>foot</footer></body></html>"
    pages = [(k, f"http://h{k % 2}.example.net/en/{k}", page.format(" ".join(rng.choice(vocab) for _ in range(40)))) for k in range(12)]
    pages += [(None, None, None), (20, None, ""), (21, "no scheme", "<p>" * 3000), (22, "http://a.net/", "plain & text"), (0, "http://h0.example.net/en/0", None)]
    return {"documents": docs, "pages": pages, "benchmark": [*bench, (None, None), (9, ""), (9, bench[0][1])], "labels": labels}


@pytest.fixture(scope="module", params=["odd", "empty"])
def tables(request, spark, tmp_path_factory):
    root, every = str(tmp_path_factory.mktemp(request.param)), rows()
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(every[name] if request.param == "odd" else [], schema)
        df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns}).write.parquet(f"{root}/{name}.parquet")
    return root, {k: len(v) if request.param == "odd" else 0 for k, v in every.items()}


#: What the defined cases of each query are: (id column, {id: what the row must hold}) for the awkward rows.
CASES = {
    "op1_html_extraction": ("page_id", {None: {"text": "", "n_chars": 0}, 20: {"text": ""}, 21: {"text": ""}, 22: {"text": "plain & text"}}),
    "op2_secrets": ("doc_id", {60: {"n_assign": 0, "spans": ""}, 61: {"n_hex": 0, "spans": ""}, 64: {"spans": ""}}),
    "op3_jaccard_join": ("doc_id", {60: {"n_shingles": 0, "component_id": 60}, 61: {"n_shingles": 0}, 62: {"n_shingles": 0, "component_id": 62}, 63: {"n_shingles": 1}, 64: {"n_shingles": 1}, None: {"component_id": None}, 75: {"component_id": 4}}),
    "op4_fingerprints": ("doc_id", {60: {"n_chars": 0}, 61: {"n_chars": 0}, 63: {"n_chars": 100000}, 64: {"n_chars": 100000}}),
    "op5_toxicity": ("doc_id", {60: {"predicted": 0}, 61: {"predicted": 0}, 0: {"predicted": 1}, 1: {"predicted": 0}}),
    "op7_url_filters": ("page_id", {None: {"host": "", "path": "", "rule": None}, 21: {"host": "", "verdict": "allow"}, 22: {"host": "a.net", "rule": "net/", "verdict": "block"}}),
    "op8_mixing": ("doc_id", {60: {"size": 0, "taken": 0}, 62: {"size": 0, "taken": 0}, 63: {"size": 20000}, 64: {"size": 1}}),
    "op9_language_id": ("doc_id", {60: {"lang_pred": "und", "score": 0.0}, 61: {"lang_pred": "und"}, 62: {"lang_pred": "und"}}),
    "op11_periodic_runs": ("doc_id", {60: {"n_runs": 0, "start": None, "exponent_milli": None}, 61: {"n_runs": 0}, 62: {"n_runs": 0, "length": None}, 63: {"n_runs": 1, "start": 0, "length": 20000, "period": 1, "exponent_milli": 20_000_000}, 64: {"n_runs": 0}}),
    "op10_lm_scoring": ("doc_id", {60: {"n_words": 0, "log_prob": 0.0, "mean_log_prob": None}, 61: {"n_words": 0}, 63: {"n_words": 20000}, 64: {"n_words": 1}}),
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, tables, name):
    root, n = tables
    out = queries.queries()[name](spark, root).collect()
    if name == "op6_decontamination":  # one row a leak
        docs = {r["doc_id"] for r in out}
        assert docs <= {r[0] for r in rows()["documents"]} and (not n["documents"] or {i for i in range(60) if i % 10 == 3} <= docs)
        return
    if name == "op12_source_divergence":  # one row a pair of sources, or a term
        groups = {(d[2] or "", d[3] or "") for d in rows()["documents"]} if n["documents"] else set()
        pairs = {(la, so, other) for la, so in groups for lb, other in groups if la == lb and so != other}
        assert sorted((r["lang"], r["source"], r["item"]) for r in out if r["part"] == "pair") == sorted(pairs) and {r["part"] for r in out} == ({"pair", "term"} if pairs else set())
        assert {r["value"] for r in out if r["lang"] == "" and r["part"] == "pair"} <= {0} and not [r for r in out if r["lang"] == "" and r["part"] == "term"]
        return
    if name == "op13_packing":  # one row a piece
        per = Counter((r["doc_id"], r["piece"] == 0) for r in out)
        assert sum(m for (_, first), m in per.items() if first) == n["documents"] and all(0 < r["length"] <= 2048 for r in out)
        assert not n["documents"] or ({r["length"] for r in out if r["doc_id"] in (60, 61)} == {1} and per[63, False] > 5 and per[0, True] == 2)
        return
    assert len(out) == n["pages" if name.startswith(("op1_", "op7_")) else "documents"]
    key, want = CASES[name]
    for i, values in want.items() if out else ():
        found = [r for r in out if r[key] == i]
        assert found and all(r[c] == v for r in found for c, v in values.items()), (i, found[:2])


def test_stages(spark, tables):
    """Each stage returns rows of its input, as often as they were there at most, and keeps those that it has nothing against."""
    root, n = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    count = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, root)
        assert out.count() <= n["documents"], name
        if k < 4:
            assert set(SCHEMAS["documents"].replace(",", "").split()[::2]) <= set(out.columns), name
        if n["documents"]:
            before, after = count(docs), count(out)
            if name == "toxicity":
                assert after <= before and {i for i, _ in after} >= {60, 61, 62, None, 1, 2, 4} and not {0, 6} & {i for i, _ in after}
            elif name == "near duplicates":
                whole = {r.doc_id: r.component_id for r in queries.jaccard_join.link(docs).collect()}
                assert after == Counter({x: m for x, m in before.items() if x[0] is None or whole[x[0]] == x[0]})
            elif name == "benchmark decontamination":
                assert after == Counter({x: m for x, m in before.items() if x[0] not in {r.doc_id for r in queries.decontamination.find(docs, spark.read.parquet(f"{root}/benchmark.parquet"), ["doc_id"]).collect()}})
            elif name == "secrets":
                assert {i for i, _ in after} == {i for i, _ in before} and out.count() == docs.count()
            else:
                copies = {(r.doc_id, r.text): r for r in out.collect()}
                assert after <= before and all(r.taken == r.copies * r.size for r in copies.values()) and None in {i for i, _ in after}
        docs = out if k == 4 else spark.createDataFrame(out.collect(), out.schema)


def test_components_of_nodes_with_very_many_links(spark):
    """Two nodes that share most of their neighbours, each with more links than HOT, a chain, and a node that only later rounds reach."""
    from tidemark.llm.components import HOT, components

    n = 3 * HOT
    star = [(7, 1000 + i) for i in range(n)] + [(6, 1000 + i) for i in range(0, n, 2)] + [(5, 1000 + n - 1)]
    chain = [(9000 + i, 9001 + i) for i in range(20)] + [(9010, 9010), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(star + chain, "a long, b long")).collect()}
    want = {x: 5 for x in (5, 6, 7, *range(1000, 1000 + n))} | {x: 9000 for x in range(9000, 9021)}
    assert got == want
