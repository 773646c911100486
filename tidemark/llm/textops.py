"""Vectorised text helpers shared by the corpus operators (numpy over Arrow buffers)."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text hashed at a time; bounds the helper arrays of a task.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer on uint64 arrays (a bijection)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix64(np.array([x & (2**64 - 1)], dtype=U64))[0])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS.get("p", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, b in (("p", BASE), ("i", pow(BASE, -1, 2**64))):
            a = np.full(size, b, dtype=U64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["i"]


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string array, or the bytes of a binary one; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    binary = pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)
    col = pc.fill_null(col.cast(pa.large_binary() if binary else pa.large_string()), b"" if binary else "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(col, most: int = SLICE_BYTES, rows: int = 1 << 20):
    """(first row, rows' bytes, offsets) of runs of at most `rows` rows and about `most` bytes; a longer row stands alone."""
    data, off = buffers(col)
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        b = min(b, n, a + rows)
        yield a, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs of non-space bytes, and each row's first word (n + 1 offsets)."""
    w = _IS_WORD[data]
    prev = np.empty_like(w)
    prev[1:] = w[:-1]
    cuts = off[:-1][off[:-1] < len(w)]
    prev[cuts] = False
    starts = np.flatnonzero(w & ~prev)
    nxt = np.empty_like(w)
    nxt[:-1] = w[1:]
    ends = off[1:][off[1:] > 0] - 1
    nxt[ends] = False
    return starts, np.flatnonzero(w & ~nxt) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word with A-Z folded, and each row's first word (n + 1 offsets)."""
    if len(data) == 0:
        return np.zeros(0, U64), np.zeros(len(off), np.int64)
    starts, ends, first = word_spans(data, off)
    return hashes_of(data, starts, ends), first


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes with A-Z folded."""
    p, inv = _powers(len(data) + 1)
    c = np.empty(len(data) + 1, U64)
    c[0] = 0
    np.cumsum((_LOWER[data].astype(U64) + U64(1)) * p[: len(data)], out=c[1:])
    h = (c[ends] - c[starts]) * inv[starts]
    return mix64(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row and n + 1 offsets; a row of 1 to k - 1 words has one of all of them."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    off = np.concatenate(([0], np.cumsum(count)))
    row = np.repeat(np.arange(len(n)), count)
    at = first[row] + (np.arange(off[-1]) - off[row])
    left = first[row + 1] - at
    h = np.zeros(len(at), U64)
    if len(words):
        for j in range(k):
            use = left > j
            h += np.where(use, mix64(words[np.minimum(at + j, len(words) - 1)] + U64(mix_int(j + 1))), U64(0))
    return mix64(h), off


def distinct_by_row(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's sorted distinct hashes, and n + 1 offsets."""
    row, h = np.repeat(np.arange(len(off) - 1), np.diff(off)), h.copy()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(off) - 1))))


def lean(apply):
    """A mapInArrow function whose worker gives freed memory back to the system, as workers outlive their tasks."""

    def run(batches):
        import ctypes

        pa.set_memory_pool(pa.system_memory_pool())
        yield from apply(batches)
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass

    return run


def checkpoint_dir(spark) -> str:
    """The shared folder that the session names; where none is set, a folder of its own in local mode (as in tests), and an error on a cluster."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = found.get() if found.isDefined() else None
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        d = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(d)
    return d


def written(df, name: str):
    """df written as Parquet to the shared folder and read again: the lineage ends, and any executor can read it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark, *paths: str) -> None:
    """Deletes folders that `written` made."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
