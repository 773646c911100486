"""Packing: exact round trips of ids, the local search's invariants, and how near the sequences come to the least number."""

import itertools
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from tidemark.llm import packing

P = pytest.importorskip("public_tokenizers")
FILE = P.path("byte_bpe_50k.json")
FILE_TEXT = open(FILE).read()


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def test_chunks_are_the_ids_of_whole_texts():
    rng = random.Random(1)
    parts = ["word", " ", "  ", "\n", "\t ", "'s", "'", "don't", "é", "ß1", "²3", "日本", " ", "　", "\x1c", "\x1f ", "\x85", "​", "<|endoftext|>", ".", "...", "12", "_", "\U0001d518", "á", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    model, want = packing.Chunks(open(FILE).read(), most=20_000), tokenizer()
    for t in texts:
        assert model.ids(t) == struct.pack(f"<{len(e := want.encode(t, add_special_tokens=False).ids)}I", *e), t
    assert model.older and model.size < 60_000


PARTS = ["word", " ", "  ", "\n", "\t ", "'s", "'re", "'", "\"", "don't", "é", "ß1", "×", "ÿ", "日本", "。", "\x1c", "\x1f ", "\x85", "\xa0", "\u180e", "\u2003", "\u2028", "\u200b", "\u3000", "“", "…", "<|endoftext|>", "<|", "|", "***", ".", "12", "_", "\U0001f600"]


def test_cuts_change_no_ids():
    import numpy as np

    rng, model, edges = random.Random(2), tokenizer(), packing.Chunks(FILE_TEXT).edges
    own = lambda t: model.encode(t, add_special_tokens=False).ids
    for _ in range(2000):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(3)]
        data, off = "".join(texts).encode(), np.cumsum([0, *(len(t.encode()) for t in texts)])
        at = packing.cuts(np.frombuffer(data, np.uint8), off, edges).tolist()
        assert set(off.tolist()) <= set(at)
        for t, a, b in zip(texts, off, off[1:], strict=False):
            assert [i for x, y in itertools.pairwise(c for c in at if a <= c <= b) for i in own(data[x:y].decode())] == own(t), t
    assert edges.sum() == 6 + 32 - 3  # but <, | and > of <|endoftext|>
    text = "uno «mot» “Erüst” *was***, don't\xa0 x\u3000  y"
    at = packing.cuts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])).tolist()
    assert [text.encode()[a:b].decode() for a, b in zip(at, at[1:], strict=False)] == ["uno", " «mot»", " “Erüst”", " *was", "***,", " don", "'t\xa0 x\u3000  y"]


def test_texts_are_tokenized_together(monkeypatch):
    """The tokenizer sees each distinct chunk once, and few texts: neither grows with the number of texts of the same words."""
    import numpy as np

    seen, whole = [], packing.Chunks.whole
    monkeypatch.setattr(packing.Chunks, "whole", lambda self, texts: seen.append(texts) or whole(self, texts))
    rng, model, want = random.Random(7), packing.Chunks(open(FILE).read()), tokenizer()
    texts = [" ".join(rng.choice(["wordle", "Foo", "bär", "$$$", "x!!"]) + str(rng.randint(0, 40)) for _ in range(30)) for _ in range(500)]
    data, off = "".join(texts).encode(), np.cumsum([0, *(len(t.encode()) for t in texts)])
    for _ in range(2):
        ids, to = model.encode(np.frombuffer(data, np.uint8), off)
        for t, a, b in zip(texts, to, to[1:], strict=False):
            assert ids[a:b].tolist() == want.encode(t, add_special_tokens=False).ids
    assert len(seen) <= 2 and sum(len(t) for own in seen for t in own) < 5000
    assert packing._chunks(FILE_TEXT) is packing._chunks(FILE_TEXT)


def test_other_vocabularies():
    from tokenizers import AddedToken, Tokenizer, models, pre_tokenizers

    vocab = {t: i for i, t in enumerate(["a", "b", "Ġ", ".", "]", "aĠ", "bĠ", "a."])}
    texts = ["aa b", "aaa bc a", "caa. b", "aaa.a]", "a[a] b", "aaa a[a]. [a]", "aab a b  a.a c", "", "aaa a b a"] * 2
    for regex in (True, False):  # without the pattern, tokens go over white space; c isn't in the vocabulary
        for more in ([], ["a[a]"], ["b a"], [AddedToken("a[a]", lstrip=True, rstrip=True)], [AddedToken("a", single_word=True)]):
            model = Tokenizer(models.BPE(vocab, [("a", "Ġ"), ("b", "Ġ"), ("a", ".")]))
            model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=regex)
            model.add_tokens(more)
            chunks = packing.Chunks(model.to_str())
            for t in texts:
                want = model.encode(t, add_special_tokens=False).ids
                assert chunks.ids(t) == struct.pack(f"<{len(want)}I", *want), (regex, more, t)


def fills(b):
    assert sorted(i for own in b.bins for i in own) == list(range(len(b.length)))
    for own, fill in zip(b.bins, b.fill, strict=True):
        assert own and sum(b.length[i] for i in own) == fill <= b.most
    return sum(f * f for f in b.fill)


@pytest.mark.parametrize("kind", ["uniform", "large", "third", "one", "same", "few", "none", "mixed"])
def test_search_only_betters(kind):
    rng = random.Random(5)
    for n in (0, 1, 2, 7, 60, 900):
        length = {
            "uniform": [rng.randint(1, 2047) for _ in range(n)], "large": [rng.randint(600, 1100) for _ in range(n)], "third": [rng.randint(500, 800) for _ in range(n)],
            "one": [1] * n, "same": [700] * n, "few": [rng.choice([900, 1148, 1149, 600]) for _ in range(n)], "none": [2047] * n, "mixed": [min(2047, int(rng.lognormvariate(6, 1)) + 1) for _ in range(n)],
        }[kind]
        b = packing.Bins(length)
        before, bins = fills(b), len(b.bins)
        b.search()
        assert fills(b) >= before and b.least() <= len(b.bins) <= bins
        if kind == "mixed":
            assert len(b.bins) <= b.least() + 1


def test_exchanges_empty_bins():
    """Best fit leaves 5 + 5 + .. in more bins than the exchanges of each kind need."""
    saved = {}
    rng = random.Random(11)
    for trial in range(400):
        length = [rng.randint(15, 60) for _ in range(40)]
        b = packing.Bins(length, 100)
        before = len(b.bins)
        b.search()
        fills(b)
        saved[before - len(b.bins)] = saved.get(before - len(b.bins), 0) + 1
    assert min(saved) >= 0 and sum(n for k, n in saved.items() if k > 0) >= 5, saved


def rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    out = [(i, " ".join(rng.choice(vocab) for _ in range(int(rng.lognormvariate(5, 1)) + 1))) for i in range(240)]
    out += [(300, None), (301, ""), (302, " \n "), (303, "wide " * 9000), (None, "null id"), (None, None), out[0], out[0], (304, "x" * 20000), (305, "the " * 2047), (306, "the " * 2046 + "the")]
    return out


def test_round_trip(spark):
    docs, model = rows(), tokenizer()
    ids = lambda t: [*model.encode(t or "", add_special_tokens=False).ids, 0]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("length", "offset", "sequence_id", "_row", "_block", "piece")})
    for block in (40, packing.BLOCK):
        got = packing.pack(packing.pieces(df.repartition(3), FILE, ids=True), block=block).collect()
        texts = {}
        for r in got:
            assert len(r.ids) == r.length and zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) == r.ids_crc32 and (r.piece == 0 or r.length == 2048)
            texts.setdefault(r.doc_id, []).append((r.piece, r.start, r.ids))
        for i, t in docs:
            want, at, whole = ids(t), 0, [p for p in sorted(texts[i], key=lambda p: p[0])]
            if i in (None, docs[0][0]):
                continue
            for k, (piece, start, part) in enumerate(whole):
                assert (piece, start) == (k, at) and part == want[at : at + len(part)]
                at += len(part)
            assert at == len(want)
        assert sorted(p[2] for p in texts[None]) == sorted([ids("null id"), [0]]) and len([p for p in texts[docs[0][0]] if p[0] == 0]) == 3
        sequences = {}
        for r in got:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in sequences.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
        least = -(-sum(r.length for r in got) // 2048)
        assert least <= len(sequences) <= least + 1


def test_empty_and_tiny_pieces(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert packing.pack(packing.pieces(none, FILE)).collect() == []
    many = spark.range(5000).select(F.col("id").cast("string").alias("doc_id"), F.lit(None).alias("text"))
    got = packing.pack(packing.pieces(many, FILE), block=300).collect()
    assert len({r.sequence_id for r in got}) == 3 and {r.doc_id for r in got} == {str(k) for k in range(5000)}
