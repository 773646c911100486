"""The operators as queries over the synthetic tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprints, html_extraction, jaccard_join, language_id, lm_scoring, mixing, packing, periodic_runs, secrets, source_divergence, textops, toxicity, url_filters

# The rules of the URL query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(k: int):
    return F.crc32(F.col("doc_id").cast("string")) % k


def op1_html_extraction(spark, sf_dir):
    return html_extraction.main_text(_read(spark, sf_dir, "pages"))


def op2_secrets(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return secrets.digest(docs, secrets.dictionary(docs))


def op3_jaccard_join(spark, sf_dir):
    return jaccard_join.link(_read(spark, sf_dir, "documents"))


def op4_fingerprints(spark, sf_dir):
    return fingerprints.with_edited(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(_fold(5) != 0))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_decontamination(spark, sf_dir):
    return decontamination.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), ["doc_id"])


def op7_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(RULES, url_filters.RULE_SCHEMA)
    return url_filters.judge(_read(spark, sf_dir, "pages"), rules, ["page_id"])


def op8_mixing(spark, sf_dir):
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_language_id(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(_fold(3) != 1).select("doc_id", "text", "lang"))
    said = language_id.predict(docs, model, ["doc_id"])
    return said.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op10_lm_scoring(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    vocab = lm_scoring.vocabulary(docs)
    docs, _ = textops.written(lm_scoring.coded(docs, vocab, ["doc_id"]), "lm-units")
    return lm_scoring.score(docs, vocab, lm_scoring.train(docs, vocab), ["doc_id"])


def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.digest(_read(spark, sf_dir, "documents"))


def op12_source_divergence(spark, sf_dir):
    return source_divergence.audit(_read(spark, sf_dir, "documents"))


def op13_packing(spark, sf_dir):
    import public_tokenizers

    return packing.pack(packing.pieces(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def queries() -> dict:
    return {f.__name__: f for f in (op1_html_extraction, op2_secrets, op3_jaccard_join, op4_fingerprints, op5_toxicity, op6_decontamination, op7_url_filters, op8_mixing, op9_language_id, op10_lm_scoring, op11_periodic_runs, op12_source_divergence, op13_packing)}


def oracle_sql() -> dict[str, str]:
    rest = "substr(url, instr(url, '://') + 3)"
    has = "instr(coalesce(url, ''), '://') > 0"
    lower = f"translate(regexp_extract({rest}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    op7 = f"""
WITH rules(action, rhost, rpath) AS (VALUES {rules}),
p AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN {has} THEN {lower} ELSE '' END AS host,
             CASE WHEN {has} THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
hit AS (SELECT p.r, first(rhost || rpath ORDER BY length(rhost || rpath) DESC, action DESC, rhost || rpath DESC) AS rule,
               first(action ORDER BY length(rhost || rpath) DESC, action DESC, rhost || rpath DESC) AS action
        FROM p JOIN rules ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath) GROUP BY p.r)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN hit USING (r)"""
    op3 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
n AS (SELECT r, doc_id, len(g) AS n FROM s),
t AS (SELECT r, unnest(g) AS x FROM s WHERE doc_id IS NOT NULL),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM t a JOIN t b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT na.doc_id AS a, nb.doc_id AS b FROM p JOIN n na ON na.r = p.a JOIN n nb ON nb.r = p.b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT DISTINCT a AS node, a AS reach FROM e UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.reach),
m AS (SELECT node, min(reach) AS least FROM c GROUP BY 1)
SELECT doc_id, n AS n_shingles, coalesce(least, doc_id) AS component_id FROM n LEFT JOIN m ON m.node = n.doc_id"""
    return {"op3_jaccard_join": op3, "op7_url_filters": op7, "op12_source_divergence": source_divergence.ORACLE_SQL}
