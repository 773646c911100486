"""Best-fit packing: documents cut into pieces of tokens and packed into sequences of at most MOST tokens, with local search.

`pieces` tokenizes (a document's ids, then the id END) and cuts: only documents longer than a sequence are cut, so that all
pieces but the first are whole sequences. `pack` spreads the other pieces over blocks by hash of a row number (so copies
don't meet in one block), fills the bins of a block best fit first, longest first, and then searches locally: between
underfull bins it exchanges one piece for one, two for one or one for two, or moves a piece, each time from an emptier
to a fuller bin, so that the sum of squared fills grows, until bins are empty. The OPEN emptiest bins of a block are taken apart
and packed again with those of FAN other blocks, level by level, so that about what one block can't fill stays underfull in all.

Text is tokenized in chunks that begin with white space or with marks after a word (see `cuts`). The chunks of SLICE bytes of texts are coded by Arrow as a
dictionary, each new one of it is tokenized once, and the ids are put together by gathering. A Python worker keeps 2 x CACHE bytes of chunks and
their ids over its tasks (the least recent go). These are the ids of the whole text, as no token of a byte-level vocabulary goes over such an edge;
with another vocabulary every distinct text is one chunk.

A block has about BLOCK pieces on the first level and at most FAN x OPEN x MOST later (pieces of one token only), so
no task and no group grows with the input. The tables between levels are written to the shared folder, so executors may be lost. Nothing goes to the driver but a count.

Defined cases: null and empty texts are one piece of the id END alone; null ids and repeated rows are documents of their own; ties are broken by
the row number; texts of any length are tokenized whole; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import zlib
from bisect import insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import buffers, lean, slices, written

MOST, END = 2048, 0
BLOCK, OPEN, FAN = 16384, 24, 8
#: Bytes of chunks and ids in the newer half of what a Python worker keeps.
CACHE = 16 << 20
#: Bytes of texts (a longer text stands alone) and chunks taken at a time, and chunks tokenized as one text.
SLICE, GROUP, TOGETHER = 8 << 20, 1 << 20, 256


def _table(of: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


_SPACE, _LETTER = _table(b"\t\n\v\f\r "), _table([*range(65, 91), *range(97, 123)])
#: White space, and the marks that a word of letters may be cut from.
_EDGES = _SPACE | _table([c for c in range(33, 127) if not chr(c).isalnum()])
#: ASCII that nobody calls white space (some do 0x1C to 0x1F).
_PLAIN = _table(range(128)) & ~_SPACE & ~_table(range(0x1C, 0x20))


def cuts(data: np.ndarray, off: np.ndarray, edges: np.ndarray = _EDGES) -> np.ndarray:
    """Places, in order, at which texts in UTF-8 (with n + 1 offsets) may be cut without a change of their ids, as no token goes over them: before ASCII
    white space after other characters and before ASCII marks after Latin letters (nowhere in the first three bytes; only before those in the table
    `edges`), and at the texts' ends. Characters that may be white space (0x85, 0xA0, 0x180E, 0x2000 and so on) count as such."""
    at = np.flatnonzero(edges[data])
    at = at[at > 2]
    p, q, r = data[at - 1], data[at - 2], data[at - 3]
    wide = p >= 0x80
    latin = (q == 0xC3) & wide & (p != 0x97) & (p != 0xB7)
    maybe = (q == 0x81) | (q == 0x9A) | (q == 0xA0) | ((q == 0x80) & ((p < 0x90) | (p >= 0xA8)))
    space = ((q == 0xC2) & ((p == 0x85) | (p == 0xA0))) | ((r >= 0xE1) & (r <= 0xE3) & maybe)
    may = np.where(_SPACE[data[at]], _PLAIN[p] | (wide & ~space), _LETTER[p] | latin)
    mark = np.zeros(len(data) + 1, bool)
    mark[at[may]] = True
    mark[off] = True
    return np.flatnonzero(mark)


def _numbered(at: pa.Array, n: int) -> pa.Array:
    """The numbers of `at`, with its nulls numbered from n on."""
    null = np.asarray(pc.is_null(at))
    return pa.array(np.where(null, n + np.cumsum(null) - 1, np.asarray(pc.fill_null(at, 0))))


class Chunks:
    """Token ids of texts, with each distinct chunk tokenized once. Chunks are rows of Arrow arrays, so none is an object of Python."""

    def __init__(self, tokenizer: str, most: int = CACHE):
        import json
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model, self.most, self.size = Tokenizer.from_str(tokenizer), most, 0
        vocabulary = self.model.get_vocab()
        #: Bytes of each token: in a byte-level vocabulary a byte is written as one character.
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        # No cut is made within an added token, and none at all if one looks at what is around it or words aren't told apart as `cuts` has it.
        read = json.loads(tokenizer)
        added, split = read["added_tokens"], read["pre_tokenizer"] or {}
        self.edges = _EDGES & ~_table("".join(t["content"] for t in added).encode())
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added) or read["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            self.edges = np.zeros(256, bool)
        self._none = pa.array([], pa.large_binary()), pa.array([], pa.large_list(pa.uint32()))
        (self.kept, self.kept_ids), (self.older, self.older_ids) = self._none, self._none

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def each(self, chunks: pa.LargeBinaryArray) -> pa.LargeListArray:
        """Ids of each chunk. Up to TOGETHER chunks are tokenized as one text where `cuts` may cut it between them; the tokens' widths tell them apart."""
        if not len(chunks):
            return self._none[1]
        data, off = buffers(chunks)
        apart = np.ones(len(data) + 1, bool)
        apart[cuts(data, off[[0, -1]], self.edges)] = False
        apart = apart[off]
        apart[::TOGETHER] = apart[-1] = True
        text, at, ids = data.tobytes(), off[apart].tolist(), []
        for k in range(0, len(at) - 1, 256):
            own = at[k : k + 257]
            ids += self.whole([text[a:b].decode() for a, b in zip(own, own[1:], strict=False)])
        ids = np.concatenate(ids)
        ends = np.concatenate(([0], np.cumsum(self.width[ids])))
        to = np.searchsorted(ends, off)
        if to[-1] == len(ends) or (ends[to] != off).any():  # a vocabulary that leaves out characters
            ids = self.whole([c.decode() for c in chunks.to_pylist()])
            to, ids = np.cumsum([0, *map(len, ids)]), np.concatenate(ids)
        return pa.LargeListArray.from_arrays(pa.array(to, pa.int64()), pa.array(ids))

    def known(self, chunks: pa.LargeBinaryArray) -> pa.LargeListArray:
        """Ids of distinct chunks: kept ones are looked up, others tokenized. Chunks that come again move from the older half to the newer one."""
        at = pc.index_in(chunks, value_set=self.kept)
        new = chunks.filter(pc.is_null(at))
        if not len(new):
            return self.kept_ids.take(at)
        before = pc.index_in(new, value_set=self.older)
        strange = self.each(new.filter(pc.is_null(before)))
        found = pa.concat_arrays([self.older_ids, strange]).take(_numbered(before, len(self.older)))
        ids = pa.concat_arrays([self.kept_ids, found])
        out = ids.take(_numbered(at, len(self.kept)))
        self.kept, self.kept_ids = pa.concat_arrays([self.kept, new]), ids
        self.size = self.kept.nbytes + ids.nbytes
        if self.size > self.most:
            self.older, self.older_ids, (self.kept, self.kept_ids), self.size = self.kept, ids, self._none, 0
        return out

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in UTF-8 with n + 1 offsets, and n + 1 offsets of theirs."""
        at = cuts(data, off, self.edges)
        ids, count = [np.zeros(0, np.uint32)], np.zeros(len(at), np.int64)
        for k in range(0, len(at) - 1, GROUP):
            own = at[k : k + GROUP + 1]
            chunks = pa.Array.from_buffers(pa.large_binary(), len(own) - 1, [None, pa.py_buffer(own), pa.py_buffer(data)]).dictionary_encode()
            found = self.known(chunks.dictionary).take(chunks.indices)
            ids.append(found.flatten().to_numpy())
            count[k + 1 : k + len(own)] = np.diff(found.offsets.to_numpy())
        return np.concatenate(ids), np.cumsum(count)[np.searchsorted(at, off)]

    def ids(self, text: str) -> bytes:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode(data, np.array([0, len(data)]))[0].astype("<u4").tobytes()


@lru_cache(1)
def _chunks(tokenizer: str) -> Chunks:
    """One of them in each Python worker, for all of its tasks."""
    return Chunks(tokenizer)


def pieces(docs: DataFrame, tokenizer: str, most: int = MOST, end: int = END, ids: bool = False) -> DataFrame:
    """doc_id, piece, start (the document's ids before it), length, ids_crc32 of each piece; with ids, its `ids` (array of int) too. tokenizer: the path of a tokenizers file."""
    with open(tokenizer) as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file of fixed size
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if ids else "")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]

    def apply(batches):
        chunks = _chunks(model.value)
        for batch in batches:
            for first, data, off in slices(batch.column(1), SLICE):
                tokens, to = chunks.encode(data, off)
                tokens = np.insert(tokens, to[1:], end).astype("<u4", copy=False)
                to = (to + np.arange(len(to))).tolist()
                view, rows = memoryview(tokens).cast("B"), []
                for r, (a, b) in enumerate(zip(to, to[1:], strict=False)):
                    many = -(-(b - a) // most)
                    at = a
                    for k in range(many):
                        cut = b - (many - 1 - k) * most
                        rows.append((first + r, k, at - a, cut - at, zlib.crc32(view[4 * at : 4 * cut])))
                        at = cut
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                row, *cols = (pa.array(own, kind) for own, kind in zip(zip(*rows, strict=True), kinds, strict=True))
                cols = [batch.column(0).take(row), *cols]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(r[3] for r in rows)]), pa.int32()), pa.array(tokens.view(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(apply), schema)


class Bins:
    """Bins of at most `most` tokens, filled best fit and bettered by local search. Pieces are numbers into `length`."""

    def __init__(self, length: list[int], most: int = MOST):
        self.length, self.most = length, most
        self.bins: list[list[int]] = []
        self.fill: list[int] = []
        gaps: list[list[int]] = [[] for _ in range(most + 1)]
        there = 0  # bit g: a bin has a gap of g
        for i in sorted(range(len(length)), key=lambda i: -length[i]):
            n = length[i]
            fits = there >> n
            if fits:
                g = n + (fits & -fits).bit_length() - 1
                b = gaps[g].pop()
                if not gaps[g]:
                    there ^= 1 << g
                self.bins[b].append(i)
                self.fill[b] += n
            else:
                g, b = most, len(self.bins)
                self.bins.append([i])
                self.fill.append(n)
            if g > n:
                gaps[g - n].append(b)
                there |= 1 << (g - n)

    def least(self) -> int:
        """No packing has fewer bins."""
        return -(-sum(self.fill) // self.most)

    def search(self, donors: int = OPEN) -> None:
        """Exchanges and moves from the emptiest bins to fuller ones until no exchange is left in a pass, or no bin can be spared."""
        while self._round(donors):
            alive = [b for b in range(len(self.bins)) if self.bins[b]]
            self.bins, self.fill = [self.bins[b] for b in alive], [self.fill[b] for b in alive]

    def _round(self, donors: int) -> bool:
        order = sorted((b for b in range(len(self.bins)) if self.fill[b] < self.most), key=lambda b: self.fill[b])
        length, bins, fill = self.length, self.bins, self.fill
        if len(order) < 2:
            return False
        given, rest = order[:donors], order[donors:]
        if not rest:
            # All underfull bins give: the emptiest half to the fullest half.
            given, rest = order[: len(order) // 2], order[len(order) // 2 :]
        # Pieces of the bins that give, by length; bit n of `have`: one of n tokens is there. The emptiest bin gives first.
        stock: dict[int, list[tuple[int, int]]] = {}
        have = 0
        for rank, b in enumerate(given):
            for i in bins[b]:
                insort(stock.setdefault(length[i], []), (rank, i))
                have |= 1 << length[i]
        changed = False

        def take(n: int) -> tuple[int, int]:
            nonlocal have
            at = stock[n].pop(0)
            if not stock[n]:
                have ^= 1 << n
            return at

        def put(rank: int, i: int) -> None:
            nonlocal have
            insort(stock.setdefault(length[i], []), (rank, i))
            have |= 1 << length[i]

        for x in reversed(rest):
            while fill[x] < self.most and have:
                gap, own = self.most - fill[x], bins[x]
                best, gone, want = 0, (), ()
                sums = [(0, ()), *((length[i], (i,)) for i in own)]
                # A piece for none (a move), for one, or for two of this bin's.
                few = own if len(own) <= 12 else sorted(own, key=lambda i: length[i])[:12]
                sums += [(length[i] + length[j], (i, j)) for k, i in enumerate(few) for j in few[:k]]
                for n, out in sums:
                    most = n + gap
                    fit = have & ((1 << (most + 1)) - 1)
                    got = fit.bit_length() - 1
                    if got - n > best:
                        best, gone, want = got - n, out, (got,)
                        if best == gap:
                            break
                if best < gap:
                    # Two pieces for one of this bin's, to fill the gap to the last token.
                    for n, out in sums[: 1 + len(own)]:
                        most = n + gap
                        for one in stock:
                            other = most - one
                            if not stock[one] or one > other or not have >> other & 1 or (one == other and len(stock[one]) < 2):
                                continue
                            # The bin that gives the longer one gets this bin's; the squares have to grow all the same.
                            b, c = given[stock[other][0][0]], given[stock[one][one == other][0]]
                            after = {x: self.most, b: fill[b] - other + n}
                            after[c] = after.get(c, fill[c]) - one
                            if after[b] <= self.most and sum(f * f - fill[k] ** 2 for k, f in after.items()) > 0:
                                best, gone, want = gap, out, (other, one)
                                break
                        if best == gap:
                            break
                if not best:
                    break
                changed = True
                came = [take(n) for n in want]
                back = came[0][0]
                for i in gone:
                    own.remove(i)
                    bins[given[back]].append(i)
                    fill[given[back]] += length[i]
                    fill[x] -= length[i]
                for rank, i in came:
                    bins[given[rank]].remove(i)
                    fill[given[rank]] -= length[i]
                    own.append(i)
                    fill[x] += length[i]
                for i in gone:
                    put(back, i)
        return changed


def pack(parts: DataFrame, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The rows of parts (any columns, with `length` from 1 to most) with sequence_id and offset: where a piece is, gapless from 0 in each sequence."""
    table, _ = written(parts.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    names = parts.columns
    whole = table.where(F.col("length") >= most).select(*names, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = table.where(F.col("length") < most)
    blocks = max(1, -(-rest.count() // block))
    units = rest.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("long"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields), "sequence_id bigint", "offset bigint"])

    def settle(last: bool, level: int):
        def one(group: pa.Table) -> pa.Table:
            group = group.sort_by("_row").combine_chunks()
            key = group.column("_block")[0].as_py()
            packed = Bins(group.column("length").to_pylist(), most)
            packed.search()
            held = set() if last else set(sorted((b for b in range(len(packed.bins)) if packed.fill[b] < most), key=lambda b: packed.fill[b])[:OPEN])
            n = group.num_rows
            sequence, offset = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
            for b, own in enumerate(packed.bins):
                if b not in held:
                    sequence[own] = (level << 58) + (key << 22) + b
                    size = np.array([packed.length[i] for i in own], np.int64)
                    offset[own] = np.cumsum(size) - size
            return group.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

        return one

    done, level = whole, 0
    while True:
        last = blocks == 1
        moved = units.groupBy("_block").applyInArrow(settle(last, level), schema)
        if not last:
            moved, _ = written(moved, f"pack-level{level}")
        done = done.unionByName((moved if last else moved.where("sequence_id >= 0")).select(*names, "sequence_id", "offset"))
        if last:
            return done
        blocks, level = -(-blocks // FAN), level + 1
        units = moved.where("sequence_id < 0").drop("sequence_id", "offset").withColumn("_block", F.expr(f"_block div {FAN}"))
