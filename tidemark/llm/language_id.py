"""Language identification: nearest of several clustered centroids per language, by cosine of TF-IDF byte n-grams.

Features are hashed counts of 2- and 3-byte windows of the text with A-Z folded and ASCII
non-letters turned into spaces. A bounded sample of SAMPLE documents a language
gives the IDF weights and, by spherical k-means, CENTROIDS centroids per language; every
document's whole text is classified.

Defined cases: null text, or text without a letter, is `und` with score 0; a document further
than `reject` from every centroid keeps its nearest language but is marked rejected; ties go to
the language that sorts first; with nothing to learn from everything is `und`; other columns
aren't looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import lean

DIMS = 2048
#: Documents a language to learn from, at most about.
SAMPLE = 1000
CENTROIDS = 4
#: Cosine below which a document is marked as rejected.
REJECT = 0.15

# Letters are Unicode category L: number characters such as a superscript 2 are none.
_LETTER = re.compile(r"\p{L}")


def _counts(col):
    """(first row, counts of hashed n-grams: rows x DIMS) of runs of rows."""
    from .textops import slices

    fold = np.full(256, 32, np.uint32)
    fold[97:123] = np.arange(97, 123)
    fold[65:91] = np.arange(97, 123)
    fold[128:] = np.arange(128, 256)
    for a, data, off in slices(col, rows=256):
        b, n = fold[data], len(off) - 1
        row = np.repeat(np.arange(n), np.diff(off))
        out = np.zeros(n * DIMS, np.int64)
        for k in (2, 3):
            if len(b) >= k:
                gram = b[: len(b) - k + 1].copy()
                for j in range(1, k):
                    gram = gram * np.uint32(257) + b[j : len(b) - k + 1 + j]
                cell = (gram * np.uint32(2654435761)) >> np.uint32(32 - DIMS.bit_length() + 1)
                same = row[: len(b) - k + 1] == row[k - 1 :]
                out += np.bincount(row[: len(same)][same] * DIMS + cell[same], minlength=n * DIMS)
        yield a, out.reshape(n, DIMS)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def learn(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, seed: int = 3) -> dict:
    """A model from the text and lang of docs (doc_id, text, lang)."""
    docs = docs.where("text is not null and lang is not null")
    per = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return {"langs": [], "idf": np.ones(DIMS, np.float32), "centroids": np.zeros((0, DIMS), np.float32), "of": np.zeros(0, int)}
    share = F.create_map(*[F.lit(x) for lang, n in per.items() for x in (lang, min(1.0, sample / n))])[F.col("lang")]
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003).select("lang", "text")

    def features(batches):
        for batch in batches:
            for a, c in _counts(batch.column("text")):
                rows = [x.astype(np.uint16).tobytes() for x in np.minimum(c, 65535)]
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, len(rows)), pa.array(rows, pa.binary())], names=["lang", "x"])

    got = some.mapInArrow(lean(features), "lang string, x binary").toPandas().sort_values(["lang", "x"])
    langs = sorted(per)
    label = got["lang"].map({v: i for i, v in enumerate(langs)}).to_numpy()
    c = np.frombuffer(b"".join(got["x"]), np.uint16).reshape(-1, DIMS)
    idf = np.log((1 + len(c)) / (1 + (c > 0).sum(0))).astype(np.float32) + 0.1
    x, rng, mid, of = _vectors(c, idf), np.random.default_rng(seed), [], []
    for k in range(len(langs)):
        own = x[label == k]
        if not len(own):
            continue
        m = own[rng.permutation(len(own))[: min(centroids, len(own))]]
        for _ in range(8):
            near = (own @ m.T).argmax(1)
            m = np.array([own[near == j].mean(0) if (near == j).any() else m[j] for j in range(len(m))])
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        mid, of = [*mid, m], [*of, *[k] * len(m)]
    return {"langs": langs, "idf": idf, "centroids": np.concatenate(mid).astype(np.float32), "of": np.array(of)}


def predict(docs: DataFrame, model: dict, keep: list[str], reject: float = REJECT) -> DataFrame:
    """The columns `keep` of each row, then lang_pred, score, rejected."""
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def apply(batches):
        langs, of, mid = model["langs"], model["of"], model["centroids"]
        for batch in batches:
            text = batch.column(len(keep))
            for a, c in _counts(text):
                n = len(c)
                said, score, far = ["und"] * n, np.zeros(n), [False] * n
                if len(mid):
                    cos = _vectors(c, model["idf"]) @ mid.T
                    best = np.full((n, len(langs)), -1.0, np.float32)
                    for j, k in enumerate(of):
                        best[:, k] = np.maximum(best[:, k], cos[:, j])
                    top, soft = best.argmax(1), np.exp(20 * (best - best.max(1, keepdims=True)))
                    soft /= soft.sum(1, keepdims=True)
                    for i, t in enumerate(text.slice(a, n).to_pylist()):
                        if t and _LETTER.search(t):
                            said[i], score[i], far[i] = langs[top[i]], float(soft[i, top[i]]), bool(best[i, top[i]] < reject)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(j).slice(a, n) for j in range(len(keep))), pa.array(said, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(far, pa.bool_())], names=[f.name for f in schema.fields]
                )

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(lean(apply), schema)
