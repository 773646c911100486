"""LM scoring: masked pseudo-likelihood under a bidirectional window network, trained in numpy.

The network predicts each word from the SIDE words on its left and right: embeddings, a tanh
layer, then a two-level softmax over CLASSES x CLASSES units. Units are the most frequent
words of the whole corpus and buckets for all others, chosen by a word's ending and length. Within a bucket a word
has the probability of its own frequency among the bucket's words, read from CELLS counters by the word's hash (words that
share a counter share its count evenly). A document's score is the sum over its words of the log probability given both sides.

Counts come from all words. Training is data-parallel and reads every word as a target once: rows are dealt by hash to
shards of about SHARD words, each shard trains a copy in the order of the rows' hashes, and the copies
are averaged in Spark, weighted by words, in the order of the shards; round r takes the words at places r, r + ROUNDS, ... of each text.
So the parameters depend on the rows alone, not on how they are partitioned. Defined cases: null and empty texts have no words,
sum 0 and a null mean; a word that was never counted has the count 1; with an empty table there is nothing to score;
repeated rows give repeated results; other columns aren't looked at.
Words are turned into units once (`coded`); both rounds and the scores read those.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import lean

SIDE, DIM, HIDDEN, CLASSES, BUCKETS = 2, 16, 32, 32, 128
UNITS = CLASSES * CLASSES
ROUNDS, BATCH, RATE = 2, 4096, 0.1
#: Counters of the words in buckets, words that a shard has on average, shards at most (beyond, they have more words), and words whose order is mixed at once.
CELLS, SHARD, SHARDS, MIXED = 1 << 22, 1 << 20, 1 << 16, 8 * BATCH
#: Counters that come to the driver as one value.
PACK = 1 << 16
#: Copies of the parameters that one task averages.
FAN = 32
SHAPES = {"e": (UNITS + 1, DIM), "h": (2 * SIDE * DIM, HIDDEN), "hb": (HIDDEN,), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "w": (CLASSES, HIDDEN, CLASSES), "wb": (CLASSES, CLASSES)}


def _bucket(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bucket of each word by its last two bytes and its length."""
    from .textops import _LOWER

    last, prev, n = _LOWER[data[ends - 1]].astype(np.int64), _LOWER[data[np.maximum(ends - 2, starts)]].astype(np.int64), ends - starts
    return ((last * 31 + prev * 7 + np.minimum(n // 4, 3) * 101) * 2654435761 >> 7) % BUCKETS


def vocabulary(docs: DataFrame) -> dict:
    """The units: sorted hashes of the frequent words with their ids; the log count of a word by counter; the log of all such counts of a bucket; and words in all."""
    from .textops import hashes_of, slices, word_spans

    def count(batches):
        for batch in batches:
            hs, bs = [], []
            for _, data, off in slices(batch.column("text")):
                if len(data):
                    s, e, _ = word_spans(data, off)
                    hs.append(hashes_of(data, s, e))
                    bs.append(_bucket(data, s, e) if len(s) else np.zeros(0, np.int64))
            words = pa.array(np.concatenate([np.zeros(0, np.uint64), *hs]).view(np.int64)).dictionary_encode()
            at, b = words.indices.to_numpy(), np.zeros(len(words.dictionary), np.int32)
            b[at] = np.concatenate([np.zeros(0, np.int64), *bs])
            yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(b), pa.array(np.bincount(at, minlength=len(b)))], names=["word", "bucket", "n"])

    from .textops import forget, written

    counts, path = written(docs.select("text").mapInArrow(lean(count), "word long, bucket int, n long").groupBy("word").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n")), "lm-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(UNITS - BUCKETS).toPandas()
    h = top["word"].to_numpy(np.int64).view(np.uint64)
    rare = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(int(x),) for x in top["word"]], "word long")), "word", "left_anti")
    both, cells = written(rare.groupBy(F.pmod("word", F.lit(CELLS)).cast("int").alias("cell"), "bucket").agg(F.count("*").alias("t"), F.sum("n").alias("n")), "lm-cells")
    cell = both.groupBy("cell").agg((F.sum("n") / F.sum("t")).alias("each"))
    mass = {r.bucket: r.m for r in both.join(cell, "cell").groupBy("bucket").agg(F.sum(F.col("t") * F.col("each")).alias("m")).collect()}

    def packed(t: pa.Table) -> pa.Table:
        at, v = t.column("cell").to_numpy(), np.zeros(PACK, np.float32)
        v[at % PACK] = np.log(t.column("each").to_numpy())
        return pa.table({"part": pa.array([int(at[0]) // PACK], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})

    # A fixed number of counters, however large the corpus is.
    table = np.zeros(CELLS, np.float32)
    for r in cell.groupBy(F.floor(F.col("cell") / PACK).alias("part")).applyInArrow(packed, "part int, v binary").collect():
        table[r.part * PACK : (r.part + 1) * PACK] = np.frombuffer(r.v, np.float32)
    order = np.argsort(h)
    spread = np.zeros(UNITS)
    for b, m in mass.items():
        spread[UNITS - BUCKETS + b] = np.log(max(m, 1.0))
    total = counts.agg(F.sum("n")).first()[0] or 0
    forget(counts.sparkSession, path, cells)
    return {"words": h[order], "ids": order.astype(np.int64), "cells": counts.sparkSession.sparkContext.broadcast(table), "spread": spread, "total": total}


def units(data: np.ndarray, off: np.ndarray, vocab: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit of each word, each row's first word, and each word's log probability within its unit."""
    from .textops import hashes_of, word_spans

    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64), np.zeros(0)
    s, e, first = word_spans(data, off)
    if not len(s):
        return np.zeros(0, np.int64), first, np.zeros(0)
    h = hashes_of(data, s, e)
    out, own = UNITS - BUCKETS + _bucket(data, s, e), (h.view(np.int64) % CELLS)
    within = vocab["cells"].value[own] - vocab["spread"][out]
    if len(vocab["words"]):
        at = np.minimum(np.searchsorted(vocab["words"], h), len(vocab["words"]) - 1)
        known = vocab["words"][at] == h
        out, within = np.where(known, vocab["ids"][at], out), np.where(known, 0.0, within)
    return out, first, within


def windows(u: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Units on both sides of the words at places `at`; UNITS beyond the text's ends."""
    row = np.searchsorted(first, at, "right") - 1
    lo, hi = first[row], first[row + 1]
    out = np.empty((len(at), 2 * SIDE), np.int64)
    for k, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        p = at + d
        ok = (p >= lo) & (p < hi)
        out[:, k] = np.where(ok, u[np.clip(p, 0, len(u) - 1)], UNITS)
    return out


def start(seed: int = 5) -> dict:
    rng = np.random.default_rng(seed)
    return {k: (rng.normal(0, 0.1, s) if k in ("e", "h", "c", "w") else np.zeros(s)).astype(np.float32) for k, s in SHAPES.items()}


def flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def shaped(v: np.ndarray) -> dict:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k], at = v[at : at + n].reshape(s).astype(np.float32), at + n
    return out


def _exp(x: np.ndarray) -> tuple:
    """What is taken from the logits x (one number, or one a row where they lie far apart), their exponentials then, and each row's sum of these."""
    most = x.max(initial=0)
    if most - x.min(initial=0) > 60:
        most = x.max(1, keepdims=True)
    e = np.exp(x - most)
    return most, e, e @ np.ones((x.shape[1], 1), x.dtype)


def _inner(p: dict, hid: np.ndarray, c: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Logits of the units of each row's class; rows are ordered by class."""
    z = p["wb"][c]
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        i = slice(cuts[k], cuts[k + 1])
        z[i] += hid[i] @ p["w"][k]
    return z


def _by_class(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the targets by class, and in that order their class, their place in it, and where each class begins (CLASSES + 1)."""
    order = np.argsort((y // CLASSES).astype(np.uint8), kind="stable")
    c, w = np.divmod(y[order], CLASSES)
    return order, c, w, np.searchsorted(c, np.arange(CLASSES + 1))


def log_probs(p: dict, ctx: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log probability of units y given their windows."""
    order, c, w, cuts = _by_class(y)
    n = np.arange(len(y))
    hid = np.tanh(np.take(p["e"], ctx[order], axis=0).reshape(len(y), -1) @ p["h"] + p["hb"])
    out = np.zeros(len(y), hid.dtype)
    for x, own in ((hid @ p["c"] + p["cb"], c), (_inner(p, hid, c, cuts), w)):
        most, _, total = _exp(x)
        out += x[n, own] - (most + np.log(total))[:, 0]
    back = np.empty_like(out)
    back[order] = out
    return back


def step(p: dict, g2: dict, ctx: np.ndarray, y: np.ndarray, rate: float = RATE) -> None:
    """One Adagrad step on a batch of windows."""
    order, c, w, cuts = _by_class(y)
    n, ctx = len(y), ctx[order]
    at = np.arange(n)
    x = np.take(p["e"], ctx, axis=0).reshape(n, -1)
    hid = np.tanh(x @ p["h"] + p["hb"])
    dc, d = (e * (1 / (n * total)) for _, e, total in map(_exp, (hid @ p["c"] + p["cb"], _inner(p, hid, c, cuts))))
    for g, own in ((dc, c), (d, w)):
        g[at, own] -= 1 / n
    each, some = np.ones(n, hid.dtype), np.flatnonzero(np.diff(cuts))
    grads = {"c": hid.T @ dc, "cb": each @ dc, "w": np.zeros(SHAPES["w"], hid.dtype), "wb": np.zeros(SHAPES["wb"], hid.dtype)}
    grads["wb"][some] = np.add.reduceat(d, cuts[some], axis=0)
    dh = dc @ p["c"].T
    for k in some.tolist():
        i = slice(cuts[k], cuts[k + 1])
        grads["w"][k] = hid[i].T @ d[i]
        dh[i] += d[i] @ p["w"][k].T
    dz = dh * (1 - hid * hid)
    grads["h"], grads["hb"] = x.T @ dz, each @ dz
    dx = (dz @ p["h"].T).reshape(n * 2 * SIDE, DIM)
    ids = ctx.ravel().astype(np.uint16)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    uniq, de = ids[first], np.add.reduceat(np.take(dx, order, axis=0), first, axis=0)
    for k, g in grads.items():
        g2[k] += g * g
        p[k] -= rate * g / (np.sqrt(g2[k]) + 1e-6)
    g2["e"][uniq] += de * de
    p["e"][uniq] -= rate * de / (np.sqrt(g2["e"][uniq]) + 1e-6)


def coded(docs: DataFrame, vocab: dict, keep: list[str]) -> DataFrame:
    """The columns `keep` of each row of docs (text, and doc_id if there is one), its hash, the units of all its words (two bytes each) and the sum of their log probabilities within the units."""
    schema = T.StructType([docs.schema[c] for c in keep] + T._parse_datatype_string("_hash long, _units binary, _within double").fields)

    def apply(batches):
        from .textops import slices

        for batch in batches:
            for a, data, off in slices(batch.column(len(keep) + 1), 1 << 18):
                u, first, within = units(data, off, vocab)
                c = np.concatenate(([0.0], np.cumsum(within)))
                own = pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(2 * first.astype(np.int64)), pa.py_buffer(u.astype(np.uint16))])
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(a, len(own)) for j in range(len(keep) + 1)), own.cast(pa.binary()), pa.array(c[first[1:]] - c[first[:-1]])], names=[f.name for f in schema.fields])

    h = F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns])
    return docs.select(*keep, h.alias("_hash"), F.col("text").alias("_text")).mapInArrow(lean(apply), schema)


def _words(col, most: int = 1 << 16):
    """(first row, units, each row's first word) of runs of rows of about `most` words."""
    from .textops import slices

    for a, data, off in slices(col, 2 * most):
        yield a, np.frombuffer(data, np.uint16).astype(np.int64), off // 2


def train(docs: DataFrame, vocab: dict, rounds: int = ROUNDS) -> dict:
    """Averaged parameters after training over docs (text, and doc_id if there is one; or as `coded` gives them) in `rounds` rounds, which share out the words."""
    shards = min(max(1, -(-vocab["total"] // SHARD)), SHARDS)
    docs = docs if "_units" in docs.columns else coded(docs, vocab, [])
    dealt = docs.where(F.length("_units") > 0).select(F.pmod("_hash", F.lit(shards)).alias("shard"), "_hash", "_units").repartition("shard").sortWithinPartitions("shard", "_hash").drop("_hash")
    params = start()
    for r in range(rounds):
        now = flat(params)

        def local(batches, now=now, r=r):
            state: dict = {}

            def begin(shard):
                state.update(shard=shard, p=shaped(now.copy()), g2={k: np.full(s, 1e-4, np.float32) for k, s in SHAPES.items()}, x=[], y=[], held=0, seen=0)

            def learn(last):
                """Steps over the words held, MIXED at a time; with last, over all of them."""
                x, y = np.concatenate([np.zeros((0, 2 * SIDE), np.int64), *state["x"]]), np.concatenate([np.zeros(0, np.int64), *state["y"]])
                k = 0
                while len(y) - k >= (1 if last else MIXED):
                    n = min(MIXED, len(y) - k)
                    at = k + np.random.default_rng([r, state["seen"]]).permutation(n)
                    for i in range(0, n, BATCH):
                        step(state["p"], state["g2"], x[at[i : i + BATCH]], y[at[i : i + BATCH]])
                    k += n
                    state["seen"] += n
                state.update(x=[x[k:]], y=[y[k:]], held=len(y) - k)

            def end():
                learn(True)
                if state["seen"]:
                    yield pa.RecordBatch.from_arrays([pa.array([state["shard"]], pa.int64()), pa.array([float(state["seen"])]), pa.array([flat(state["p"]).tobytes()], pa.binary())], names=["shard", "n", "p"])

            for batch in batches:
                shard = batch.column("shard").to_numpy()
                cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)] if len(shard) else [0]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if state.get("shard") != shard[a]:
                        if state:
                            yield from end()
                        begin(int(shard[a]))
                    for _, u, first in _words(batch.column("_units").slice(a, b - a)):
                        place = np.arange(len(u)) - np.repeat(first[:-1], np.diff(first))
                        at = np.flatnonzero(place % rounds == r)
                        state["x"].append(windows(u, first, at))
                        state["y"].append(u[at])
                        state["held"] += len(at)
                        if state["held"] >= MIXED:
                            learn(False)
            if state:
                yield from end()

        def mean(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("shard")
            n = pdf["n"].to_numpy(float)
            v = sum(np.frombuffer(b, np.float32).astype(float) * x for b, x in zip(pdf["p"], n, strict=True)) / n.sum()
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0] // FAN], "n": [n.sum()], "p": [v.astype(np.float32).tobytes()]})

        copies, left = dealt.mapInArrow(lean(local), "shard long, n double, p binary"), shards
        while left > 1:
            copies = copies.groupBy(F.floor(F.col("shard") / FAN).alias("part")).applyInPandas(mean, "shard long, n double, p binary")
            left = -(-left // FAN)
        got = copies.collect()  # one row
        if not got:
            break
        params = shaped(np.frombuffer(got[0].p, np.float32))
    return params


def score(docs: DataFrame, vocab: dict, params: dict, keep: list[str]) -> DataFrame:
    """The columns `keep` of each row of docs (with text, or as `coded` gives them), then n_words, log_prob (sum) and mean_log_prob."""
    schema = T.StructType([docs.schema[c] for c in keep] + T._parse_datatype_string("n_words long, log_prob double, mean_log_prob double").fields)
    docs = docs if "_units" in docs.columns else coded(docs, vocab, keep)

    def apply(batches):
        for batch in batches:
            within = batch.column(len(keep) + 1).to_numpy()
            for a, u, first in _words(batch.column(len(keep))):
                n = np.diff(first)
                lp = np.concatenate([np.zeros(0), *(log_probs(params, windows(u, first, at), u[at]).astype(float) for at in (np.arange(k, min(k + 8192, len(u))) for k in range(0, len(u), 8192)))])
                c = np.concatenate(([0.0], np.cumsum(lp)))
                total = c[first[1:]] - c[first[:-1]] + within[a : a + len(n)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(j).slice(a, len(n)) for j in range(len(keep))), pa.array(n.astype(np.int64)), pa.array(total), pa.array(total / np.maximum(n, 1), mask=n == 0)], names=[f.name for f in schema.fields]
                )

    return docs.select(*keep, "_units", "_within").mapInArrow(lean(apply), schema)
