"""Benchmark decontamination: SimHash of item-sized windows, a multi-index search, then weighted-shingle similarity.

A window has as many words (A-Z folded) as an item, or all words of a text that has fewer. It counts as a leak
when the weighted Jaccard similarity of its five-word shingles with the item's is SIMILAR or more; a shingle weighs
1 + ln(items / items that have it), both counted over the whole benchmark.

Windows and items have PRINTS SimHashes of 64 bits over their sets of shingles, each shingle with the square root of its
weight. So the cosine of a pair at SIMILAR is 2 SIMILAR / (1 + SIMILAR) = 0.857 at least whatever the weights are, and its prints are 11.0
bits apart with a deviation of 3.0 at most. The index holds the neighbourhoods of RADIUS // BLOCKS bits of each
print's BLOCKS blocks, so that a lookup finds every item within RADIUS bits; a pair is a candidate if one of its PRINTS is so near.
Pairs at SIMILAR miss that in about 1 of 200 cases, nearer ones less often. There is no other way to a candidate.

An item's window must hold SIMILAR of the weight of the lightest item of its length, in shingles that items have, and again in
shingles that items of its length have. Windows that don't are skipped before: that bound is exact and
loses nothing that the last test would keep.

The benchmark goes to the tasks in blocks of about ITEMS items or BYTES bytes, one pass over the documents a
block, so a broadcast is bounded. Defined cases: null and empty texts and items match nothing;
an item of fewer than five words has one shingle of all its words; very long texts are read whole, their prints in pieces; ties go to the earliest
window; repeated rows give repeated results; an empty benchmark or table of documents gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .textops import lean

K, SIMILAR, BLOCKS, RADIUS, PRINTS, ITEMS, BYTES = 5, 0.75, 4, 15, 2, 2_000, 1 << 24
_BITS = 64 // BLOCKS
#: Shingles whose signs, and windows whose candidates, a task holds at once.
PIECE = 4096
#: Steps of a weight of 1 in a print, whose sums are whole numbers.
STEPS = 64


def _masks(most: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(most + 1) for bits in combinations(range(_BITS), r)]


def _signs(h: np.ndarray) -> np.ndarray:
    """shingles x 64 of +1 and -1."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _pack(v: np.ndarray) -> np.ndarray:
    return np.packbits(v > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


def prints_of(g: np.ndarray, heavy: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """PRINTS x starts: the SimHashes of the sets g[start : start + span] of shingles that weigh heavy (whole numbers). starts ascend."""
    from .textops import mix64, mix_int

    out, i = np.zeros((PRINTS, len(starts)), np.uint64), 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, a + PIECE)))
        at = starts[i:j] - a
        h = g[a : int(starts[j - 1]) + span]
        order = np.argsort(h, kind="stable")
        last = np.full(len(h), -1)
        again = h[order[1:]] == h[order[:-1]]
        last[order[1:][again]] = order[:-1][again]
        twice = np.flatnonzero(last >= 0)
        for p in range(PRINTS):
            signs = _signs(mix64(h + np.uint64(mix_int(100 + p)))) * heavy[a : a + len(h), None]
            sums = np.concatenate((np.zeros((1, 64), np.int64), np.cumsum(signs, axis=0, dtype=np.int64)))
            v = sums[at + span] - sums[at]
            if len(twice):
                # A shingle that the window has before counts once.
                for k, s in enumerate(at.tolist()):
                    r = twice[np.searchsorted(twice, s) : np.searchsorted(twice, s + span)]
                    v[k] -= signs[r[last[r] >= s]].sum(0)
            out[p, i:j] = _pack(v)
        i = j
    return out


def _grams(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles at each place of one text."""
    from .textops import mix64, mix_int

    if len(w) < k:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        h += mix64(w[j : len(w) - k + 1 + j] + np.uint64(mix_int(j + 1)))
    return mix64(h)


def _words_and_grams(t: str | None) -> tuple[np.ndarray, set]:
    from .textops import word_hashes

    d = np.frombuffer((t or "").encode(), np.uint8)
    w = word_hashes(d, np.array([0, len(d)]))[0]
    return w, set(_grams(w, min(K, len(w))).tolist()) if len(w) else set()


def _heavy(weight: np.ndarray) -> np.ndarray:
    return np.rint(STEPS * np.sqrt(weight)).astype(np.int64)


def index(items: list[tuple], whole: tuple | None = None) -> dict:
    """The lookup tables of items (id, text). whole: of the benchmark they are a block of, its items with words, and the
    shingles of the block that two items or more have, with the items of each."""
    parts, df = [], {}
    for i, t in items:
        w, g = _words_and_grams(t)
        if len(w):
            parts.append((i, w, g))
            for s in g:
                df[s] = df.get(s, 0) + 1
    total, shared, times = whole or (len(parts), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    top = 1 + np.log(max(1, total))
    if whole:
        df = dict.fromkeys(df, 1)
        df.update(zip(shared.tolist(), times.tolist(), strict=True))
    weight = {s: float(top - np.log(n)) for s, n in df.items()}
    known = np.array(sorted(set().union(*(g for _, _, g in parts))), np.uint64)
    maybe = np.zeros(1 << 20, bool)
    maybe[(known >> np.uint64(44)).astype(np.int64)] = True
    at = {"parts": parts, "weight": weight, "top": float(top), "known": known, "weights": np.array([weight[s] for s in known.tolist()]), "maybe": maybe}
    by_length: dict[int, list] = {}
    for j, (_, w, _) in enumerate(parts):
        by_length.setdefault(len(w), []).append(j)
    return at | {"lengths": [(n, _near(js, at)) for n, js in sorted(by_length.items())]}


def _near(js: list[int], at: dict) -> dict:
    """Of the items js, all of one length: their prints, and for each print and block the neighbourhoods (sorted keys, places in js)."""
    sets = [np.array(sorted(at["parts"][j][2]), np.uint64) for j in js]
    prints = np.zeros((PRINTS, len(js)), np.uint64)
    for k, g in enumerate(sets):
        prints[:, k] = prints_of(g, _heavy(np.array([at["weight"][s] for s in g.tolist()])), np.zeros(1, np.int64), len(g))[:, 0]
    masks = np.array(_masks(RADIUS // BLOCKS), np.uint16)
    near = []
    for p in range(PRINTS):
        for b in range(BLOCKS):
            keys = ((prints[p] >> np.uint64(b * _BITS)).astype(np.uint16)[:, None] ^ masks).ravel()
            order = np.argsort(keys, kind="stable")
            near.append((p, b, keys[order], (order // len(masks)).astype(np.int32)))
    least = min(sum(at["weight"][s] for s in g.tolist()) for g in sets)
    return {"items": js, "least": least, "prints": prints, "near": near, "mine": np.searchsorted(at["known"], np.unique(np.concatenate(sets)))}


def candidates(f: np.ndarray, group: dict) -> list[tuple[int, int]]:
    """(place of a window, place of an item in the group) for all pairs of which one of the PRINTS is within RADIUS bits. f: PRINTS x windows."""
    m, got = len(group["items"]), [np.zeros(0, np.int64)]
    for a in range(0, f.shape[1], PIECE):
        for p, b, keys, items in group["near"]:
            mine = f[p, a : a + PIECE]
            part = (mine >> np.uint64(b * _BITS)).astype(np.uint16)
            lo = np.searchsorted(keys, part)
            n = np.searchsorted(keys, part, "right") - lo
            window = np.repeat(np.arange(len(mine)), n)
            item = items[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(window))]
            ok = np.bitwise_count(mine[window] ^ group["prints"][p, item]) <= RADIUS
            got.append((window[ok] + a) * m + item[ok])
    return [divmod(x, m) for x in np.unique(np.concatenate(got)).tolist()]


def leaks(w: np.ndarray, at: dict) -> dict:
    """{item's place: (similarity, -start, words, bits apart in the nearest print)} of one text's word hashes."""
    best: dict[int, tuple] = {}
    grams: dict[int, tuple] = {}
    for n, group in at["lengths"]:
        k, m = min(K, n), min(n, len(w))
        if m < k:
            break
        if k not in grams:
            g = _grams(w, k)
            hit = np.flatnonzero(at["maybe"][(g >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(at["known"], g[hit]), len(at["known"]) - 1)
            ok = at["known"][place] == g[hit]
            hit, place = hit[ok], place[ok]
            v = np.zeros(len(g) + 1)
            v[hit + 1] = at["weights"][place]
            grams[k] = (g, np.cumsum(v), hit, place)
        g, c, hit, place = grams[k][:4]
        if not len(hit):
            continue
        span, least = m - k + 1, SIMILAR * group["least"] - 1e-6
        starts = np.flatnonzero(c[span:] - c[:-span] >= least)
        if not len(starts):
            continue
        own = np.concatenate(([0.0], np.cumsum(np.where(np.isin(place, group["mine"]), at["weights"][place], 0.0))))
        starts = starts[own[np.searchsorted(hit, starts + span)] - own[np.searchsorted(hit, starts)] >= least]
        if not len(starts):
            continue
        if len(grams[k]) == 4:
            heavy = np.full(len(g), int(_heavy(np.array(at["top"]))))
            heavy[hit] = _heavy(at["weights"][place])
            grams[k] = (g, c, hit, place, heavy)
        f = prints_of(g, grams[k][4], starts, span)
        for i, x in candidates(f, group):
            s, j = int(starts[i]), group["items"][x]
            ours, theirs = set(g[s : s + span].tolist()), at["parts"][j][2]
            both = sum(at["weight"][y] for y in sorted(ours & theirs))
            either = sum(at["weight"].get(y, at["top"]) for y in sorted(ours | theirs))
            if both >= SIMILAR * either - 1e-12:
                apart = int(np.bitwise_count(f[:, i] ^ group["prints"][:, x]).min())
                best[j] = max(best.get(j, (-1.0, 0, 0, 0)), (both / either, -s, m, apart))
    return best


def shingled(benchmark: DataFrame, blocks: int) -> DataFrame:
    """(block, grams): each item's block and its shingles, items with words only."""

    def grams(batches):
        for batch in batches:
            got = [(b, np.array(sorted(g), np.uint64).view(np.int64)) for b, (_, g) in zip(batch.column("block").to_pylist(), map(_words_and_grams, batch.column("text").to_pylist()), strict=True) if g]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in got], pa.int64()), pa.array([g for _, g in got], pa.list_(pa.int64()))], names=["block", "grams"])

    return benchmark.select(_block(blocks).alias("block"), "text").mapInArrow(lean(grams), "block long, grams array<long>")


def _block(k: int):
    return F.pmod(F.xxhash64("item_id", "text"), F.lit(k))


def _blocks(benchmark: DataFrame, most: int):
    """(items of a block, what `index` takes as whole, or None if one block holds the benchmark); the driver holds one block at a time."""
    from .textops import forget, written

    n, size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    k = max(-(-n // most), -(-size // BYTES))
    if k > 1:
        each, path = written(shingled(benchmark, k), "benchmark-shingles")
        total = each.count()
        times, path2 = written(each.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "benchmark-counts")
    for b in range(k):
        part, whole = benchmark.select("item_id", "text"), None
        if k > 1:
            part = part.where(_block(k) == b)
            mine = each.where(F.col("block") == b).select(F.explode("grams").alias("gram")).distinct().join(times, "gram").toPandas()
            whole = total, mine["gram"].to_numpy(np.int64).view(np.uint64), mine["n"].to_numpy(np.int64)
        yield sorted(((r.item_id, r.text) for r in part.collect()), key=lambda x: (x[0] is None, 0 if x[0] is None else x[0], x[1] or "")), whole
    if k > 1:
        forget(benchmark.sparkSession, path, path2)


def _per_text(batch_column, at: dict):
    from .textops import slices, word_hashes

    for a, data, off in slices(batch_column):
        w, first = word_hashes(data, off)
        for i, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            yield a + i, (leaks(w[x:y], at) if y > x and at["parts"] else {})


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str], most: int = ITEMS) -> DataFrame:
    """A row for each row of docs and item found in it: `keep`, item_id, similarity, start_word, n_words, hamming (best window)."""
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    fields = T._parse_datatype_string("similarity double, start_word long, n_words long, hamming int").fields
    schema = T.StructType([docs.schema[c] for c in keep] + [benchmark.schema["item_id"], *fields])
    out = None
    for items, whole in _blocks(benchmark, most):

        def apply(batches, items=items, whole=whole):
            at = index(items, whole)
            for batch in batches:
                rows, got = [], []
                for i, found in _per_text(batch.column(len(keep)), at):
                    for j in sorted(found):
                        rows.append(i)
                        got.append((at["parts"][j][0], *found[j]))
                cols = list(zip(*got, strict=True)) or [[]] * 5
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(take) for c in range(len(keep))), pa.array(cols[0], item_type), pa.array(cols[1], pa.float64()), pa.array([-x for x in cols[2]], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32())],
                    names=[f.name for f in schema.fields],
                )

        one = docs.select(*keep, F.col("text").alias("_text")).mapInArrow(lean(apply), schema)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, most: int = ITEMS) -> DataFrame:
    """The rows of docs in which no item is found, with all columns."""
    place = docs.columns.index("text")
    for items, whole in _blocks(benchmark, most):

        def apply(batches, items=items, whole=whole):
            at = index(items, whole)
            for batch in batches:
                yield batch.filter(pa.array([not found for _, found in _per_text(batch.column(place), at)], pa.bool_()))

        docs = docs.mapInArrow(lean(apply), docs.schema)
    return docs
