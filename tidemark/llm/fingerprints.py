"""Document fingerprints: I-Match over several randomised lexicon subsets.

Terms are words with A-Z folded. The lexicon holds the terms found in LEAST to MOST of all
documents (a band of inverse document frequency); as a document has T distinct terms on
average, it has T / LEAST terms at most, whatever the corpus' size. A fingerprint holds the
hash of a document's sorted distinct lexicon terms under the whole lexicon and under COPIES random
subsets of it at each of len(RATES) rates: sparse subsets miss most edits of long texts, dense
ones keep some terms of short texts. The likeness of two fingerprints is the largest, over
rates, share of equal hashes among the subsets in which either has a term (with one unequal
subset more, so that few subsets say little); 1.0 if all are equal. Terms outside the lexicon
have subsets of their own, for texts that consist of rare terms.

Defined cases: null text is empty text; texts without terms have the fingerprint of their exact text alone, and are alike
(1.0) only if equal; equal texts have equal fingerprints; the next document is by
descending doc_id, nulls last, then by a hash of the text and the text itself; in a table of one row the next document is itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import lean

LEAST, MOST = 1 / 500, 1 / 3
RATES = (1 / 8, 1 / 32, 1 / 128, 1 / 512)
COPIES = 24
#: Subsets of the terms outside the lexicon, a rate.
OUTER = 7
#: Neighbouring documents that one range holds on average.
RANGE = 4096
#: Quantiles of doc_id that the ranges follow, and ranges up to which their heads are broadcast.
QUANTILES, BROADCAST_RANGES = 100, 200_000
#: Ids of more than a range's documents that are split by hash; more of them aren't (which costs balance only).
HEAVY_IDS = 1_000


def document_frequency(docs: DataFrame) -> DataFrame:
    """term (64-bit hash), n: in how many rows of docs (text) each term is."""
    from .textops import distinct_by_row, slices, word_hashes

    def count(batches):
        for batch in batches:
            parts = [distinct_by_row(*word_hashes(data, off))[0] for _, data, off in slices(batch.column("text"))]
            h, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["term", "n"])

    return docs.select("text").mapInArrow(lean(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> np.ndarray:
    """The sorted term hashes of the band: at most (mean distinct terms) / least of them."""
    n = docs.count()
    band = document_frequency(docs).where((F.col("n") >= max(2, least * n)) & (F.col("n") <= max(2.0, most * n)))
    return np.sort(band.select("term").toPandas()["term"].to_numpy(np.int64).view(np.uint64))


def _subset_bits(terms: np.ndarray) -> np.ndarray:
    """Packed bits of terms x (1 + len(RATES) * COPIES): which subsets have the term; the first is the whole lexicon."""
    from .textops import mix64, mix_int

    out = np.ones((len(terms), 1 + len(RATES) * COPIES), bool)
    for i, rate in enumerate(RATES):
        for j in range(COPIES):
            out[:, 1 + i * COPIES + j] = mix64(terms ^ np.uint64(mix_int(1000 * i + j + 1))) < np.uint64(int(rate * 2.0**64))
    return np.packbits(out, axis=1)


def _outer_bits(terms: np.ndarray) -> np.ndarray:
    """terms x (len(RATES) * OUTER) booleans for terms outside the lexicon: groups of bits of one hash a rate."""
    from .textops import mix64, mix_int

    out = np.empty((len(terms), len(RATES) * OUTER), bool)
    for i, rate in enumerate(RATES):
        h, k = mix64(terms ^ np.uint64(mix_int(77 + i))), round(-np.log2(rate))
        for j in range(OUTER):
            out[:, i * OUTER + j] = (h >> np.uint64(j * k)) & np.uint64((1 << k) - 1) == 0
    return out


def _per_row(member: np.ndarray, value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """rows x subsets: 16 bits of the hash of each row's member terms, 0 where there are none. row ascends."""
    out = np.zeros((rows, member.shape[1]), np.uint16)
    if len(row):
        from .textops import mix64

        at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        s = mix64(np.add.reduceat(np.where(member, value[:, None], np.uint64(0)), at, axis=0))
        some = np.logical_or.reduceat(member, at, axis=0)
        out[row[at]] = np.where(some, (s & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1), 0)
    return out


def fingerprints(texts: list[str], words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """rows x subsets of 16-bit hashes, 0 where the row has no term of the subset."""
    from .textops import distinct_by_row, mix64, slices, word_hashes

    n = 1 + len(RATES) * COPIES
    out = np.zeros((len(texts), n + len(RATES) * OUTER), np.uint16)
    for a, data, off in slices(pa.array(texts, pa.large_string()), 1 << 18):
        h, first = distinct_by_row(*word_hashes(data, off))
        rows = len(first) - 1
        row = np.repeat(np.arange(rows), np.diff(first))
        at = np.searchsorted(words, h)
        known = (words[np.minimum(at, max(len(words) - 1, 0))] == h) if len(words) else np.zeros(len(h), bool)
        value = mix64(h + np.uint64(0x51ED270B)) | np.uint64(1)
        out[a : a + rows, :n] = _per_row(np.unpackbits(bits[at[known]], axis=1, count=n).view(bool), value[known], row[known], rows)
        out[a : a + rows, n:] = _per_row(_outer_bits(h[~known]), value[~known], row[~known], rows)
    return out


def as_text(fp: np.ndarray, texts: list[str]) -> list[str]:
    """Hexadecimal text; a text without terms has its own digest after a mark instead."""
    return [x.tobytes().hex() if x.any() else "=" + hashlib.sha256(t.encode()).hexdigest() for x, t in zip(fp, texts, strict=True)]


def likeness(a: str, b: str) -> float:
    """Of two fingerprints' texts."""
    if a == b:
        return 1.0
    if a[0] == "=" or b[0] == "=":
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(v), np.uint16)[None] for v in (a, b))
    return float(_alike(x, y, [a], [b])[0])


def _alike(x: np.ndarray, y: np.ndarray, xt: list[str], yt: list[str]) -> np.ndarray:
    used, same = (x != 0) | (y != 0), (x == y) & (x != 0)
    share = []
    for start, copies in ((1, COPIES), (1 + len(RATES) * COPIES, OUTER)):
        part = slice(start, start + len(RATES) * copies)
        n = (len(x), len(RATES), copies)
        share.append((same[:, part].reshape(n).sum(2) / (used[:, part].reshape(n).sum(2) + 1)).max(1))
    return np.where([a == b for a, b in zip(xt, yt, strict=True)], 1.0, np.maximum(*share))


def with_edited(docs: DataFrame, words: np.ndarray | None = None, span: int = RANGE) -> DataFrame:
    """The rows of op4's contract for docs (doc_id, text).

    Neighbours are found by ranges of doc_id: each range is one sorted run of a shuffle, and the
    first document of a range is sent to the range before it too.
    """
    from .textops import written

    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if words is None:
        words = lexicon(docs)
    n = docs.count()
    # Ranges count from the largest ids down, as the documents follow each other: quantiles, each cut into equal widths.
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    want = max(1, n // span)
    cuts = sorted(set(docs.where("doc_id is not null").stat.approxQuantile("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 0.2 / QUANTILES))) if want > 1 else []
    if len(cuts) > 1:
        fine = -(-want // (len(cuts) - 1))
        edges = F.lit(cuts).cast("array<double>")
        k = F.least(F.greatest(F.size(F.filter(edges, lambda c: c <= key)), F.lit(1)), F.lit(len(cuts) - 1))
        lo, hi = F.element_at(edges, k), F.element_at(edges, k + 1)
        inside = F.least(F.greatest(F.floor((key - lo) / (hi - lo) * fine), F.lit(0)), F.lit(fine - 1))
        part = F.when(F.col("doc_id").isNull(), F.lit(2**40)).otherwise(-(k * fine + inside))
    else:
        fine, part = 1, F.lit(0)
    docs = docs.withColumn("hash", F.xxhash64("text"))
    # An id with more documents than a range holds (null, say) is a run of ranges of the hash; ids on both sides of it in its range make runs of their own.
    heavy = sorted((r for r in docs.groupBy("doc_id").count().where(F.col("count") > span).limit(HEAVY_IDS + 1).collect()), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    heavy = heavy if len(heavy) <= HEAVY_IDS else []
    if heavy:
        ids = F.lit([float("-inf") if r.doc_id is None else float(r.doc_id) for r in heavy]).cast("array<double>")
        own = F.array_position(ids, key)
        pieces = F.element_at(F.lit([-(-r["count"] // span) for r in heavy]).cast("array<double>"), F.greatest(own, F.lit(1)).cast("int"))
        piece = F.when(own > 0, F.least(F.floor((F.col("hash").cast("double") + 2.0**63) / 2.0**64 * pieces), pieces - 1)).otherwise(0)
        before = F.size(F.filter(ids, lambda c: c > key)) * 2 + (own > 0).cast("int")
        part = F.struct(part.cast("long").alias("range"), before.cast("long").alias("ids"), piece.cast("long").alias("piece"), (own > 0).alias("heavy"))
    else:
        part = F.struct(part.cast("long").alias("range"), F.lit(0).cast("long").alias("ids"), F.lit(0).cast("long").alias("piece"), F.lit(False).alias("heavy"))
    keyed = docs.withColumn("at", part)
    # One row a run: its number, the largest id in it, the least hash, and the number of the run that the documents before it are in.
    order = Window.orderBy("at")
    first = keyed.groupBy("at").agg(F.max("doc_id").alias("head"), F.min("hash").alias("least")).withColumn("part", F.row_number().over(order).cast("long"))
    first = first.withColumn("prev", F.coalesce(F.lag("part").over(order), F.max("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    first, _ = written(first, "ranges")
    ranges = first.count()
    met = keyed.join(F.broadcast(first) if ranges <= BROADCAST_RANGES else first, "at")
    # All copies of a run's head (same id; of a heavy id those of the least hash) go along; the reader takes the one that comes first.
    own = F.struct(F.col("part"), F.lit(0).alias("extra"))
    leads = F.col("doc_id").eqNullSafe(F.col("head")) & (~F.col("at.heavy") | (F.col("hash") == F.col("least")))
    also = F.when(leads, F.array(own, F.struct(F.col("prev").alias("part"), F.lit(1).alias("extra")))).otherwise(F.array(own))
    runs = met.withColumn("_to", F.explode(also)).select(F.col("_to.part").alias("part"), F.col("_to.extra").alias("extra"), "doc_id", "hash", "text")
    runs = runs.repartition(max(1, ranges), "part").sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), "hash", "text").drop("hash")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = T._parse_datatype_string(schema)
    schema = T.StructType([docs.schema["doc_id"], *schema.fields[1:]])

    def apply(batches):
        bits, held, last = _subset_bits(words), [], None

        def out(rows, nxt):
            """rows: consecutive (part, extra, id, text); nxt: what follows the last."""
            texts = [r[3] for r in rows]
            following = [r[3] for r in rows[1:]] + [nxt[3]]
            edited = []
            for t, f in zip(texts, following, strict=True):
                k = len(t) // 3
                edited.append(t[: len(t) - k] + f[:k])
            fp = fingerprints([*texts, nxt[3]], words, bits)
            fe, m = fingerprints(edited, words, bits), len(texts)
            own, ed = as_text(fp, [*texts, nxt[3]]), as_text(fe, edited)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[2] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(own[:m]), pa.array(ed),
                    pa.array(_alike(fp[:m], fe, own[:m], ed)), pa.array(_alike(fp[:m], fp[1:], own[:m], own[1:])),
                ],
                names=[f.name for f in schema.fields],
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "extra", "doc_id", "text")), strict=True):
                if last is not None and last[0] == row[0]:
                    if row[1] and last[1]:
                        continue  # further copies of the next range's head
                    if not last[1]:
                        held.append(last)
                        if row[1] or len(held) >= 512:
                            yield out(held, row)
                            held = []
                last = row

    return runs.mapInArrow(lean(apply), schema)
