"""The corpus operators on small tables: brute force, and the defined cases (nulls, empty, very long, repeated, empty tables, clashing names)."""

import itertools
import hashlib
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import decontamination, fingerprints, html_extraction, jaccard_join, language_id, lm_scoring, mixing, secrets, toxicity, url_filters
from tidemark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, host string, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1.0, "h", 1) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    line = " ".join(rng.choice(vocab) for _ in range(14))
    rows = []
    for i in range(160):
        w = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 20, 60, 150]))]
        if i % 4 == 0:
            w += line.split()
        rows.append((i, " ".join(w), f"s{i % 3}" if i % 7 else None))
    for i in range(160, 320):
        w = rows[rng.randrange(160)][1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w), "s0"))
    return [*rows, (320, None, None), (321, "", "s1"), (322, " \n\t", "s1"), (323, "Zed " * 30000, "s2"), (5, rows[5][1], "s0"), (None, "a b c d e f", "s0"), (324, "é É ü", "s2")]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t, *_ in rows]
    par = {i: i for i, _ in sets if i is not None}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                par[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


@pytest.mark.parametrize("frequent", [16, 2])
def test_jaccard_join_is_brute_force(spark, corpus, monkeypatch, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "LOCAL", 2)
    got = jaccard_join.link(frame(spark, corpus).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(corpus)


@pytest.fixture(scope="module")
def near_copies():
    """A passage with words changed at random, so that many copies share keys but only some pairs link; and pairs at the threshold."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(4000)]
    base, rows = [rng.choice(vocab) for _ in range(120)], []
    for i in range(260):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 3, 4])):
            w[rng.randrange(120)] = rng.choice(vocab)
        rows.append((i, " ".join(w), "s"))
    return rows


@pytest.mark.parametrize("tile", [1024, 20])
def test_jaccard_join_of_a_large_group_of_near_copies(spark, near_copies, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000 if tile > 20 else 30)
    try:
        got = jaccard_join.link(frame(spark, near_copies).repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=repr) == brute_components(near_copies)


def test_a_key_of_many_is_sent_once():
    ids, sizes = np.arange(100, 130), np.full(30, 8)
    sizes[29] = 100
    full, fo = np.array([7] * 12 + [8, 9], np.uint64), np.array([*range(12), 3, 4])
    gone, go = np.array([7] * 3 + [11] * 10 + [8], np.uint64), np.array([20, 21, 29, *range(12, 22), 5])
    (f, a, g, b), star, large = jaccard_join._represented(full, fo, gone, go, ids, sizes)
    assert sorted(zip(f.tolist(), a.tolist(), strict=True)) == [(7, 0), (7, 0), (8, 3), (9, 4)] and sorted(zip(g.tolist(), b.tolist(), strict=True)) == [(8, 5), *((11, k) for k in range(12, 22))]
    assert set(zip(*(v.tolist() for v in star), strict=True)) == {(100, 100 + k) for k in [*range(1, 12), 20, 21]}
    assert set(zip(*(v.tolist() for v in large), strict=True)) == {(100, 100 + k) for k in [*range(1, 12), 20, 21, 29]}


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(2)
    for trial in range(60):
        base = [rng.integers(0, 2**63, int(rng.integers(1, 80))).astype(np.uint64) * np.uint64(2) for _ in range(3)]
        sets = [np.zeros(0, np.uint64)]
        for _ in range(int(rng.integers(1, 50))):
            b = base[int(rng.integers(3))].copy()
            b[rng.integers(0, len(b), len(b) // 4)] = rng.integers(0, 2**63, len(b) // 4).astype(np.uint64)
            sets.append(np.unique(b))
        m = len(sets)
        label, side = rng.integers(0, m, m), (rng.integers(0, 2, m) if trial % 2 else None)
        pairs = [(a, b) for a in range(m) for b in range(a) if (side is None or side[a] != side[b]) and len(sets[a]) * len(sets[b]) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))]

        def joined(edges, label=label):
            of = {int(x): int(x) for x in label}
            for a, b in edges:
                x, y = of[int(label[a])], of[int(label[b])]
                of = {k: min(x, y) if v in (x, y) else v for k, v in of.items()}
            return of

        got = jaccard_join.forest(sets, label, side)
        assert joined(got) == joined(pairs) and len(got) < len({*label.tolist()})
        assert {(max(e), min(e)) for e in got} <= set(pairs)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.link(frame(spark, [])).count() == 0


def test_pigeonhole_meets_every_linked_pair(spark):
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(4, 200))
        a = np.sort(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        drop = int(n * 0.14)
        b = np.sort(np.concatenate((rng.permutation(a)[: n - drop], rng.integers(0, 2**63, drop).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (2 * n - both):
            continue
        common = np.sort(rng.permutation(a)[: int(rng.integers(0, n))])
        f, fo, g, go = jaccard_join.keys(np.concatenate((a, b)), np.array([0, n, 2 * n]), 10**6, common)
        full, gone = [set(f[fo == k].tolist()) for k in (0, 1)], [set(g[go == k].tolist()) for k in (0, 1)]
        assert full[0] & full[1] or full[0] & gone[1] or gone[0] & full[1]


def test_pigeonhole_meets_subsets_of_common_tokens():
    rng = np.random.default_rng(11)
    lost = []
    for k in range(400):
        n = int(rng.integers(4, 40)) if k % 2 else int(rng.integers(4, 8))
        a = np.sort(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.sort(rng.permutation(a)[: -(-3 * n // 4)])
        f, fo, g, go = jaccard_join.keys(np.concatenate((a, b)), np.array([0, n, n + len(b)]), 10**6, b)
        full, gone = [set(f[fo == k].tolist()) for k in (0, 1)], [set(g[go == k].tolist()) for k in (0, 1)]
        if not (full[0] & full[1] or full[0] & gone[1] or gone[0] & full[1]):
            lost.append(n)
    assert not lost


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(50, 60), (60, 70), (45, 45), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(41)} | {50: 50, 60: 50, 70: 50}


def test_secrets(spark):
    texts = [
        "Password: 'abcdefgh1' then token=short api-key=zzzzzzzzzz API_KEY = 12345678.", "x AKIAABCDEFGHIJKL y AKIAABC " + "0af" * 11, "paſſword=abcdefghij Kpassword=abcdefghij",
        "pwd: qwerty12 and pwd: xK9#vQ2!mZ7p. done", None, "", "secret:=abcdefgh secret=abcdefghsecret=abcdefgh", "é" * 5 + "passwd=aaaaaaaaaa" + " z" * 50000,
    ]
    got = {r.doc_id: r for r in secrets.digest(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
        spans = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]
    assert got[3].spans == "guess:23:35"
    clean = {r.doc_id: r.text for r in secrets.redact(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert clean[3] == "pwd: qwerty12 and pwd: [SECRET]. done" and clean[4] is None and "AKIAABCDEFGHIJKL" not in clean[1]


def test_guess_cost_orders_values():
    c = secrets.guess_cost
    assert c("password") < c("passw0rd1987") < c("xK9#vQ2!mZ7p")
    assert c("qwertyuiop") < c("qmwnebrvtc") and c("abababab") < c("aqzbxcyd") and c("") == 0


def exhaustive_cost(value, ranks):
    """The least sum over all segmentations, each piece priced on its own."""
    low = value.lower()
    plain = low.translate(str.maketrans("4301$5@7", "aeoissat"))
    kinds = [any(c.isascii() and c.islower() for c in value), any(c.isascii() and c.isupper() for c in value), any(c.isdigit() for c in value), any(not (c.isascii() and c.isalnum()) for c in value)]
    each = math.log10(sum(k for k, has in zip((26, 26, 10, 33), kinds, strict=True) if has) or 1)

    def piece(i, j):
        v, n = low[i:j], j - i
        out = [each] if n == 1 else []
        if plain[i:j] in ranks:
            out.append(math.log10(ranks[plain[i:j]] + 1) + 0.3 * (value[i:j] != v) + 0.5 * (plain[i:j] != v))
        if (m := secrets._DATE.match(low, i)) and m.end() == j:
            out.append(4.5)
        if n >= 3 and all(v[k : k + 2] in {r[x : x + 2] for row in secrets.ROWS for r in (row, row[::-1]) for x in range(len(row) - 1)} for k in range(n - 1)):
            out.append(2.0 + math.log10(n))
        for u in range(1, 9):
            if n % u == 0 and n >= max(3, 2 * u) and (v == v[:u] * (n // u) if u == 1 else value[i:j] == value[i : i + u] * (n // u)):
                out.append(u * each + math.log10(n / u))
        return min(out, default=math.inf)

    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + piece(i, j) for i in range(j)))
    return best[-1]


def test_guess_cost_is_the_least_of_all_segmentations():
    from tidemark.llm.textops import hashes_of

    rng = random.Random(3)
    own = ["well", "known", "snow", "covered", "blå", "ok"]
    h = np.concatenate([hashes_of(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())])) for w in own])
    order = np.argsort(h)
    words = {"hash": h[order], "rank": order + 1, "sizes": sorted({*map(len, own)})}
    ranks = dict(secrets.RANK)
    for k, w in enumerate(own):
        ranks[w] = min(k + 1, ranks.get(w, 10**9))
    parts = [*own, "password", "Dragon", "pa55word", "1999-12-31", "20240101", "qwert", "4321", "aaaa", "abab", "xyzxyz", "-", "Q", "7", "é", "%"]
    for _ in range(400):
        v = "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
        assert secrets.guess_cost(v, words=words) == pytest.approx(exhaustive_cost(v, ranks))


def test_guess_spans_know_the_words_of_the_corpus(spark):
    texts = ["The pin is well-known, and the pass is snow-covered"] + [f"well known snow covered roads {k}" for k in range(30)] + ["passphrase: qzjxkvbwpfmhgtyrndlc here"]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r.spans for r in secrets.digest(docs, secrets.dictionary(docs)).collect()}
    assert got[0] == "" and got[31] == "guess:12:32"


def test_copies_of_a_secret_stay_secrets(spark):
    """However many documents hold a leaked value, it is no word; long words are, as they stand in running text."""
    leak, long = "passphrase: qzvxkjwpmbhgtrfydncl", "donaudampfschifffahrtsgesellschaft"
    for copies in (7, 8, 60):
        texts = [f"{leak} in copy {k}" for k in range(copies)] + [f"die {long} fährt wieder" for _ in range(9)] + [f"passwort: {long} und mehr", None, ""]
        docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
        words = secrets.dictionary(docs)
        got = {r.doc_id: r.spans for r in secrets.digest(docs, words).collect()}
        assert len(long) in words["sizes"] and {i for i, x in got.items() if x} == set(range(copies)) and got[0] == "guess:12:32"
    assert secrets.guess_cost(long) > 40 and secrets.guess_cost(long, words=words) < 2
    assert secrets.guess_cost((long + "-") * 200, secrets.LEAST, words) >= secrets.LEAST
    none = secrets.dictionary(frame(spark, [(1, None, "s")]).limit(0))
    assert none["sizes"] == [] and secrets.guess_cost("password", words=none) == secrets.guess_cost("password")
    # A share of the corpus, once that is more than the least number of documents.
    assert not len(secrets.dictionary(docs, share=0.9)["hash"])


def test_secrets_are_whole(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefXYZ0189+/") for _ in range(400))
    texts = ["password: Tr0ub4dor9&3horse!Battery end", f"pwd: {long} end", "password: " + "a" * 7 + "&" + "a" * 300, "pwd: " + "1xy" * 80]
    assert secrets.guess_spans(texts[0], secrets.base_spans(texts[0])) == [(10, 3, 35)]
    assert secrets.guess_spans(texts[1], secrets.base_spans(texts[1])) == [(5, 3, 405)]
    assert secrets.guess_spans("password: abcdefgh1x9Q.", secrets.base_spans("password: abcdefgh1x9Q.")) == []
    clean = [r.text for r in secrets.redact(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()]
    assert clean[:2] == ["[SECRET] end", "pwd: [SECRET] end"] and clean[3] == texts[3]
    assert secrets.guess_cost("1" * 500) < 5 and secrets.guess_cost("1xy" * 80) < secrets.LEAST <= secrets.guess_cost(long, secrets.LEAST)


def test_fingerprints(spark, corpus):
    # Null ids and one id with many texts fill several ranges.
    rows = [*corpus, *((None, f"text without id {k}", "s") for k in range(130)), *((77, f"more of one id {k % 90}", "s") for k in range(120)), (400, "", "s")]
    df = frame(spark, rows)
    got = fingerprints.with_edited(df, span=40).collect()
    hashes = {r.text: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda x: (x[0] is None, -(x[0] or 0), hashes[x[1]], x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        q = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
    text, by_text = {i: t for i, t in order if i not in (None, 5, 77)}, {}
    for r in got:
        assert r.doc_id not in text or by_text.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_edited == pytest.approx(fingerprints.likeness(r.fingerprint, r.edited_fingerprint))
    long = [r for r in got if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.2
    assert fingerprints.with_edited(frame(spark, [])).count() == 0


def test_fingerprints_are_i_match(spark):
    """Fingerprints and likeness against sets of words, the published rule and plain loops."""
    from tidemark.llm.textops import mix64, mix_int

    rng = random.Random(12)
    vocab = [f"t{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choice(vocab[: 20 + i]) for _ in range(rng.randint(5, 40))), "s") for i in range(40)] + [(50, "Only Rare Terms here", "s"), (51, None, "s"), (None, "t1 t2 t3", "s"), (60, "t4 t5 t6 t7", "s"), (60, "t4 t5 t6 t7", "s")]
    df = frame(spark, rows)
    band = fingerprints.lexicon(df, 1 / 20, 1 / 3)
    hashes = {w: int(jaccard_hash(w)) for _, t, _ in rows for w in words(t)}
    found = {w: sum(w in words(t) for _, t, _ in rows) for w in hashes}
    assert {int(x) for x in band} == {hashes[w] for w, n in found.items() if max(2, len(rows) / 20) <= n <= len(rows) / 3}
    got = fingerprints.with_edited(df, band).collect()

    def plain(t):
        inside, outside = ([w for w in {*words(t)} if (hashes[w] in {int(x) for x in band}) == known] for known in (True, False))
        number = lambda ws: mix64(np.array([sum(int(mix64(np.array([hashes[w] + 0x51ED270B & 2**64 - 1], np.uint64))[0]) | 1 for w in ws) & 2**64 - 1], np.uint64))[0] if ws else None
        subsets = [inside]
        for i, rate in enumerate(fingerprints.RATES):
            subsets += [[w for w in inside if mix_int(hashes[w] ^ mix_int(1000 * i + j + 1)) < int(rate * 2.0**64)] for j in range(fingerprints.COPIES)]
        for i, rate in enumerate(fingerprints.RATES):
            k = round(-np.log2(rate))
            subsets += [[w for w in outside if mix_int(hashes[w] ^ mix_int(77 + i)) >> (j * k) & ((1 << k) - 1) == 0] for j in range(fingerprints.OUTER)]
        return [0 if (x := number(ws)) is None else int(x) & 0xFFFF | 1 for ws in subsets]

    def alike(x, y):
        shares, n = [], len(fingerprints.RATES)
        for start, copies in ((1, fingerprints.COPIES), (1 + n * fingerprints.COPIES, fingerprints.OUTER)):
            for i in range(n):
                part = list(zip(x, y, strict=True))[start + i * copies : start + (i + 1) * copies]
                shares.append(sum(a == b != 0 for a, b in part) / (sum(a or b for a, b in ((a != 0, b != 0) for a, b in part)) + 1))
        return max(shares)

    by_text = {}
    for r in got:
        t = [t for i, t, _ in rows if i == r.doc_id][0] or ""
        by_text[r.fingerprint] = t
        if words(t):
            assert np.frombuffer(bytes.fromhex(r.fingerprint), np.uint16).tolist() == plain(t)
    for r in got:
        if r.fingerprint != r.edited_fingerprint and "=" not in r.fingerprint + r.edited_fingerprint:
            x, y = (np.frombuffer(bytes.fromhex(v), np.uint16).tolist() for v in (r.fingerprint, r.edited_fingerprint))
            assert r.near_edited == pytest.approx(alike(x, y))
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 1


def jaccard_hash(word):
    from tidemark.llm.textops import word_hashes

    d = np.frombuffer(word.encode(), np.uint8)
    return word_hashes(d, np.array([0, len(d)]))[0][0]


def test_toxicity_matches_as_a_naive_search_does():
    rng = random.Random(2)
    keys = [" ab", " abc ", " cad", " bad", " dab ", " acc", " bca"]
    lexicon = {k: rng.random() + 0.1 for k in keys}
    phrases = ("bad cad", "abcd", "da")
    automaton = toxicity.matcher(lexicon, phrases)
    for _ in range(500):
        text = toxicity.fold(" ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 12))))
        spared = [(a, a + len(f) - 1) for f in map(toxicity.fold, phrases) for a in range(len(text)) if text.startswith(f, a)]
        want = 0.0
        for a in range(len(text)):
            best = max((w for k, w in lexicon.items() if text.startswith(k, a)), default=0.0)
            want += 0.0 if any(x <= a < y for x, y in spared) else best
        assert toxicity.evidence(text, automaton) == pytest.approx(want)


def test_toxicity(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(["lorem", "ipsum", "dolor", "clean", "words", "zorblights"]) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["grumpf", "zorbling", "gr0mpa"]))
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(bad)))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(frame(spark, rows[:320]), lab)
    extra = [(900, None, "s"), (901, "", "s"), (902, "lorem GRUMPF ipsum", "s"), (903, "lorem grμmpf".replace("μ", "u") + " x", "s"), (904, "zorblights only", "s"), (905, "lorem gгumpf ipsum".replace("г", "r"), "s")]
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, rows + extra), model, ["doc_id"]).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(320, 400))
    assert got[900] == got[901] < 0.5 and got[902] > 0.5 and got[904] < 0.5
    kept = {r.doc_id for r in toxicity.without_toxic(frame(spark, rows[320:] + extra), model).collect()}
    assert {i for i in range(320, 400) if i % 5} | {900, 901, 904} <= kept and 902 not in kept
    nothing = toxicity.learn(frame(spark, rows), lab.limit(0))
    assert {r.score for r in toxicity.score(frame(spark, rows[:5]), nothing, ["doc_id"]).collect()} == {0.0}


def test_fold():
    assert toxicity.fold("IDI0T, mоrоn! stück $c") == " idiot moron stück c "
    assert toxicity.fold(None) == " "


def test_decontamination(spark, corpus):
    rng = random.Random(4)
    items = [(k, " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) for _ in range(n))) for k, n in enumerate([3, 5, 12, 30, 45, 45])] + [(9, None), (10, "")]
    rows = [(i, (t or "") + (" " + items[i % 6][1].upper() + " end" if i % 9 == 0 else ""), s) for i, t, s in corpus if i is not None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.find(frame(spark, rows), bench, ["doc_id"]).collect()}
    for i, t, _ in rows:
        w = " " + " ".join(words(t)) + " "
        for k, item in items[:6]:
            if f" {' '.join(words(item))} " in w:
                assert got[(i, k)].similarity == pytest.approx(1.0)
    two_blocks = {(r.doc_id, r.item_id) for r in decontamination.find(frame(spark, rows), bench, ["doc_id"], most=4).collect()}
    assert {k for k, r in got.items() if r.similarity > 0.999} <= two_blocks
    left = {r.doc_id for r in decontamination.clean(frame(spark, rows), bench).collect()}
    assert left == {i for i, _, _ in rows} - {i for i, _ in got}
    assert decontamination.find(frame(spark, []), bench, ["doc_id"]).count() == 0 == decontamination.find(frame(spark, rows), bench.limit(0), ["doc_id"]).count()


def test_decontamination_of_short_and_changed_copies(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(7))
    lead = [word() for _ in range(12)]
    items = [[*(lead if k % 2 else []), *(word() for _ in range(38 if k % 2 else 50))] for k in range(40)]
    docs = [(k, " ".join(w[1:] if k % 3 else w[:-2]), "s") for k, w in enumerate(items)]
    docs += [(100 + k, " ".join(w[:20] + w[21:]), "s") for k, w in enumerate(items)]
    docs += [(200 + k, " ".join([*w[:44], *(word() for _ in range(6)), "end"]), "s") for k, w in enumerate(items) if k % 2 == 0]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.find(frame(spark, docs), bench, ["doc_id"]).collect()}
    assert set(got) == {(i, i % 100) for i, *_ in docs}
    assert all(r.n_words == min(len(items[i]), len(docs[i][1].split())) for (i, _), r in got.items() if i < 40)
    split = {(r.doc_id, r.item_id): r for r in decontamination.find(frame(spark, docs), bench, ["doc_id"], most=15).collect()}
    assert set(split) == set(got) and all(split[k].similarity == pytest.approx(got[k].similarity) for k in got)


def test_decontamination_takes_ids_of_any_type(spark):
    bench = spark.createDataFrame([("b", "one two three four five six seven"), ("a", "eight nine ten eleven twelve"), (None, "one two three four five six seven"), (None, None)], "item_id string, text string")
    got = decontamination.find(frame(spark, [(1, "x one two three four five six seven y", "s"), (2, "eight nine ten eleven twelve", "s")]), bench, ["doc_id"]).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, "b"), (1, None), (2, "a")}


def test_decontamination_against_all_windows(spark):
    """Every item-sized window of every text against every item: exact similarities, and how many near passages are found."""
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(500)]
    items = [[rng.choice(vocab) for _ in range(rng.choice([4, 8, 12, 25, 45]))] for _ in range(20)]
    items[3][:6] = items[4][:6] if len(items[4]) > 6 else items[3][:6]
    docs = []
    for k in range(150):
        w = list(items[k % 20])
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            w[rng.choice([0, len(w) - 1, rng.randrange(len(w))])] = rng.choice(vocab)
        lead, tail = ([rng.choice(vocab) for _ in range(rng.randint(0, 40))] for _ in range(2))
        docs.append((k, " ".join([*lead, *w, *tail]), "s"))
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    df = {}
    for w in items:
        for g in grams(w):
            df[g] = df.get(g, 0) + 1
    weigh = lambda gs: sum(1 + np.log(len(items) / df.get(g, 1)) for g in gs)
    want = {}
    for i, t, _ in docs:
        w = t.split()
        for k, item in enumerate(items):
            n = min(len(item), len(w))
            best = max(weigh(a & grams(item)) / weigh(a | grams(item)) for a in (grams(w[s : s + n]) for s in range(len(w) - n + 1)))
            if best >= decontamination.SIMILAR - 1e-9:
                want[(i, k)] = best
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    for most in (2000, 6):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.find(frame(spark, docs), bench, ["doc_id"], most=most).collect()}
        assert set(got) <= set(want) and all(got[k] == pytest.approx(want[k]) for k in got)
        assert len(got) >= 0.99 * len(want) and len(want) > 60 and sum(v < 0.999 for v in want.values()) > 20


def test_multi_index_finds_all_within_radius():
    from tidemark.llm.decontamination import PRINTS, RADIUS, candidates, index

    rng = random.Random(2)
    at = index([(k, " ".join(rng.choice("abcdefghijklm") for _ in range(10))) for k in range(40)] + [(40, "of another length")])
    group = dict(at["lengths"])[10]
    windows = np.zeros((PRINTS, 600), np.uint64)
    for i in range(600):
        for p in range(PRINTS):
            f = int(group["prints"][p, i % 40])
            for b in rng.sample(range(64), rng.choice([0, 5, RADIUS, RADIUS + 1, 30])):
                f ^= 1 << b
            windows[p, i] = f
    near = lambda i, j: any((int(windows[p, i]) ^ int(group["prints"][p, j])).bit_count() <= RADIUS for p in range(PRINTS))
    assert candidates(windows, group) == [(i, j) for i in range(600) for j in range(40) if near(i, j)]


def test_candidates_come_from_the_multi_index_alone():
    from tidemark.llm.decontamination import index, leaks
    from tidemark.llm.textops import word_hashes

    text = "one two three four five six seven eight nine ten"
    at = index([(1, text), (2, "short item")])
    d = np.frombuffer(f"so {text} and short item".encode(), np.uint8)
    w = word_hashes(d, np.array([0, len(d)]))[0]
    assert leaks(w, at) == {0: (1.0, -1, 10, 0), 1: (1.0, -12, 2, 0)}
    for _, group in at["lengths"]:
        group["near"] = [(p, b, keys[:0], items[:0]) for p, b, keys, items in group["near"]]
    assert leaks(w, at) == {}


def test_prints_are_of_sets_of_shingles():
    """Prints by cumulative sums, over several pieces and with repeated shingles, against sums over each window's set."""
    from tidemark.llm import decontamination as d
    from tidemark.llm.textops import mix64, mix_int

    rng = np.random.default_rng(4)
    g = mix64(rng.integers(0, 300, 3 * d.PIECE).astype(np.uint64))
    heavy = (g % np.uint64(190)).astype(np.int64) + 64
    starts = np.unique(rng.integers(0, len(g) - 40, 300))
    got = d.prints_of(g, heavy, starts, 40)
    weight = dict(zip(g.tolist(), heavy.tolist(), strict=True))
    for i, s in enumerate(starts.tolist()):
        for p in range(d.PRINTS):
            sums = [0] * 64
            for x in set(g[s : s + 40].tolist()):
                h = int(mix64(np.array([(x + mix_int(100 + p)) % 2**64], np.uint64))[0])
                for b in range(64):
                    sums[b] += weight[x] if h >> b & 1 else -weight[x]
            assert int(got[p, i]) == sum(1 << b for b in range(64) if sums[b] > 0)


def test_url_filters(spark):
    urls = ["http://a.net/x", "https://b.example.net/en/1?x", "http://EXAMPLE.com/de/", "http://example.com/de", "http://x.org/fr/é", "http://net/", "http://xnet/", None, "nothing", "://", "http://a.net?x/", "ftp://e.net:80/", "http://w.net/\nq#f"]
    pages = spark.createDataFrame([(i, u, "action") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, verdict string")
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", None, "/")]
    got = sorted(map(tuple, url_filters.judge(pages, spark.createDataFrame(rules, url_filters.RULE_SCHEMA), ["page_id"]).collect()))
    want = []
    for i, u in enumerate([*urls, urls[0]]):
        m = re.search(r"^.*?://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, a) for a, h, p in rules if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((i, host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"))
    assert got == sorted(want)
    assert url_filters.judge(pages.limit(0), spark.createDataFrame(rules, url_filters.RULE_SCHEMA), ["page_id"]).count() == 0


def test_url_filters_with_very_many_path_lengths(spark):
    rules = [("allow", "a.net", "/" + "x" * n) for n in range(0, 10_050)] + [("block", "a.net", "/" + "x" * 10_100)]
    pages = spark.createDataFrame([(1, "http://a.net/" + "x" * 10_200), (2, "http://a.net/" + "x" * 50)], "page_id long, url string")
    got = {r.page_id: (r.verdict, len(r.rule)) for r in url_filters.judge(pages, spark.createDataFrame(rules, url_filters.RULE_SCHEMA), ["page_id"]).collect()}
    assert got == {1: ("block", 10_106), 2: ("allow", 56)}


def brute_targets(sizes):
    names = sorted((k for k in sizes if k is not None), key=str) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full, out = 1.5 * sum(sizes.values()), set(), {}
    while True:
        left, ws = total - sum(2 * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        out = {s: 2.0 * sizes[s] if s in full else left * w[s] / ws for s in names}
        over = {s for s in names if s not in full and out[s] > 2 * sizes[s]}
        if not over:
            return out
        full |= over


def test_mixing(spark, corpus):
    a = sorted(map(tuple, mixing.mix(frame(spark, corpus), block=32).collect()), key=repr)
    assert a == sorted(map(tuple, mixing.mix(frame(spark, corpus).repartition(5), block=32).collect()), key=repr)
    sizes, taken = {}, {}
    for _, source, size, _, _, copies, took in a:
        sizes[source] = sizes.get(source, 0) + size
        taken[source] = taken.get(source, 0) + took
        assert took == copies * size <= 2 * size
    want = brute_targets(sizes)
    for _, source, _, source_size, target, *_ in a:
        assert source_size == sizes[source] and target == pytest.approx(want[source])
    assert all(abs(taken[s] - want[s]) <= max(30, 0.01 * want[s]) for s in want if s != "s2")
    assert len(a) == len(corpus) and mixing.mix(frame(spark, [])).count() == 0


def test_mixing_of_rows_that_are_alike(spark):
    rows = [(None, "one two three", "s")] * 300 + [(1, "four five", "s")] * 100 + [(2, "six", "t")]
    got = mixing.mix(frame(spark, rows), block=32).collect()
    assert sorted((r.doc_id is None, r.size) for r in got) == sorted((i is None, len(t.split())) for i, t, _ in rows)
    assert abs(sum(r.taken for r in got if r.source == "s") - got[0].target) < 0.02 * got[0].target


def test_mixed_stage_returns_every_row_taken(spark):
    import corpus_pipeline

    rows = [(1, "one two three four", "s"), (1, "five six seven eight", "s"), (None, "nine ten", "s"), (None, "nine ten", "s"), (None, "eleven twelve", "t"), *((k, f"w{k} " * 4, "t") for k in range(10, 40))]
    docs = frame(spark, rows)
    took = mixing.mix(docs, mark=F.xxhash64("text")).where("copies > 0").collect()
    out = corpus_pipeline.mixed(spark, docs, "").collect()
    assert len(out) == len(took) and sum(r.taken for r in out) == sum(r.taken for r in took)
    assert all(r.taken == r.copies * r.size == r.copies * len(r.text.split()) for r in out)
    assert {(r.doc_id, r.text, r.source) for r in out} <= set(rows)
    assert {r.text for r in out if r.doc_id == 1} == {"one two three four", "five six seven eight"}


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 500, 300), np.full(300, 0.37)
    out = mixing.flight(size, p, rng)
    assert ((out >= 0) & (out <= 1)).all() and ((out > 0) & (out < 1)).sum() <= mixing.LANDING + 2
    assert (out * size).sum() == pytest.approx((p * size).sum(), rel=1e-6) and out.sum() == pytest.approx(p.sum(), rel=1e-6)


def test_language_id(spark):
    rng, rows = random.Random(5), []
    parts = {"aa": ["the", "ing", "er", "th"], "bb": ["que", "ção", "os", "ñi"], "cc": ["sch", "ung", "ei", "ß"]}
    for i in range(240):
        lang = sorted(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang))
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !!", None), (902, "", None), (903, "\u00bd \u00b2 \u2460", None)], "doc_id long, text string, lang string")
    model = language_id.learn(docs.where("doc_id < 150"))
    got = {r.doc_id: r for r in language_id.predict(docs, model, ["doc_id"]).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows[150:]]) > 0.98
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902, 903))
    assert {r.lang_pred for r in language_id.predict(docs, language_id.learn(docs.limit(0)), ["doc_id"]).collect()} == {"und"}


def test_language_id_is_the_nearest_centroid(spark):
    """Counts, TF-IDF, cosine and the choice by plain loops over byte strings."""
    rng, rows = random.Random(9), []
    for i in range(60):
        rows.append((i, " ".join("".join(rng.choice(("ab", "de", "Ça", "x1") if i % 2 else ("fg", "hé", "ij", "ab")) for _ in range(3)) for _ in range(rng.randint(1, 12))), ("bb", "aa")[i % 2]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model, ["doc_id"]).collect()}
    for i, t, _ in rows:
        raw = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in t.encode()]
        x = np.zeros(language_id.DIMS)
        for k in (2, 3):
            for a in range(len(raw) - k + 1):
                n = 0
                for b in raw[a : a + k]:
                    n = (n * 257 + b) & 0xFFFFFFFF
                x[(n * 2654435761 & 0xFFFFFFFF) >> (32 - 11)] += 1
        x = np.log1p(x) * model["idf"]
        cos = [float(x @ m) / np.linalg.norm(x) for m in model["centroids"]]
        best = {lang: max(c for c, of in zip(cos, model["of"], strict=True) if model["langs"][of] == lang) for lang in model["langs"]}
        top = max(sorted(best), key=lambda lang: best[lang])
        assert got[i].lang_pred == top and got[i].score == pytest.approx(np.exp(20 * best[top]) / sum(np.exp(20 * v) for v in best.values()), rel=1e-3)
        assert got[i].rejected == (best[top] < language_id.REJECT)


def lm_forward(p, ctx, y):
    """Log probability of one unit given its window, plainly."""
    x = np.concatenate([p["e"][c] for c in ctx]).astype(float)
    hid = np.tanh(x @ p["h"] + p["hb"])
    c, w = divmod(int(y), lm_scoring.CLASSES)
    top, low = hid @ p["c"] + p["cb"], hid @ p["w"][c] + p["wb"][c]
    return top[c] - np.log(np.exp(top).sum()) + low[w] - np.log(np.exp(low).sum())


def test_lm_scoring(spark):
    rng, rows = random.Random(6), []
    for i in range(200):
        rows.append((i, " ".join(f"w{j % 9}" for j in range(rng.randint(0, 5), rng.randint(40, 90))), "s"))
    rows += [(300 + i, f"w1 w2 w3 rare{i} w5 w6 rare{i}", "s") for i in range(3)] + [(400, "w1 w2 w3 rare1 w5 w6 rare1", "s")]
    shuffled = [(1000 + i, " ".join(rng.sample(t.split(), len(t.split()))), "s") for i, t, _ in rows[:40]]
    docs = frame(spark, rows)
    vocab = lm_scoring.vocabulary(docs)
    params = lm_scoring.train(docs, vocab)
    got = {r.doc_id: r for r in lm_scoring.score(frame(spark, rows + shuffled + [(2000, None, "s"), (2001, "", "s")]), vocab, params, ["doc_id"]).collect()}
    assert np.mean([got[i].mean_log_prob for i in range(40)]) > np.mean([got[1000 + i].mean_log_prob for i in range(40)]) + 0.2
    assert got[2000].n_words == 0 and got[2000].log_prob == 0 and got[2001].mean_log_prob is None
    # Every document's sum, word by word, with the network written out plainly; words here are all frequent enough for units of their own.
    for i, t, _ in [*rows[:5], rows[-1]]:
        u, first, within = lm_scoring.units(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), vocab)
        padded = [lm_scoring.UNITS] * 2 + u.tolist() + [lm_scoring.UNITS] * 2
        total = sum(lm_forward(params, padded[k : k + 2] + padded[k + 3 : k + 5], u[k]) + within[k] for k in range(len(u)))
        assert got[i].log_prob == pytest.approx(total, rel=1e-3)
    # The parameters don't depend on the partitions.
    for n in (1, 5):
        again = lm_scoring.train(docs.repartition(n), vocab)
        assert all((again[k] == params[k]).all() for k in params)


def test_lm_words_share_a_bucket_by_frequency(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "UNITS", lm_scoring.BUCKETS + 1)  # on the driver: one word has a unit of its own
    texts = ["the the the the the", "aab aab aab", "bab", "xab"]
    vocab = lm_scoring.vocabulary(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    assert len(vocab["words"]) == 1 and vocab["total"] == 10
    data = np.frombuffer(b"the aab bab xab", np.uint8)
    within = lm_scoring.units(data, np.array([0, len(data)]), vocab)[2]
    assert np.exp(within) == pytest.approx([1.0, 0.6, 0.2, 0.2], rel=1e-5)


def test_lm_words_are_coded_once(spark):
    """Training and scores from coded words, without the texts, are those from texts."""
    rows = [(i, None if i % 7 == 0 else " " * (i % 3) + " ".join(f"w{j * i % 23}" for j in range(i % 40)), "s") for i in range(90)]
    docs = frame(spark, rows)
    vocab = lm_scoring.vocabulary(docs)
    coded = lm_scoring.coded(docs, vocab, ["doc_id"]).cache()
    assert "text" not in coded.columns and {r.doc_id: len(r._units) // 2 for r in coded.collect()} == {i: len((t or "").split()) for i, t, _ in rows}
    params, plain = lm_scoring.train(coded, vocab), lm_scoring.train(docs, vocab)
    assert all((params[k] == plain[k]).all() for k in params)
    scores = [{r.doc_id: tuple(r) for r in lm_scoring.score(x, vocab, params, ["doc_id"]).collect()} for x in (coded, docs)]
    assert scores[0] == scores[1] and len(scores[0]) == 90


def test_lm_probabilities_of_far_logits():
    """One number is taken from all logits only where no row vanishes by it."""
    p = {k: v.astype(np.float64) for k, v in lm_scoring.start().items()}
    ctx, y = np.arange(12).reshape(3, 4), np.array([5, 40, 1000])
    for far in (0, 50, 300):
        p["cb"][:16] = far
        p["wb"][31, :16] = -2 * far
        q = {k: v.astype(np.float32) for k, v in p.items()}
        assert lm_scoring.log_probs(q, ctx, y) == pytest.approx([lm_forward(p, c, v) for c, v in zip(ctx, y, strict=True)], rel=1e-4)


def test_lm_gradient_is_the_slope():
    rng = np.random.default_rng(4)
    p = {k: v.astype(np.float64) for k, v in lm_scoring.start().items()}
    ctx, y = rng.integers(0, lm_scoring.UNITS + 1, (7, 4)), rng.integers(0, lm_scoring.UNITS, 7)
    ctx[0] = ctx[1]
    loss = lambda q: -np.mean([lm_forward(q, c, v) for c, v in zip(ctx, y, strict=True)])
    g2 = {k: np.zeros(v.shape) for k, v in p.items()}
    lm_scoring.step({k: v.copy() for k, v in p.items()}, g2, ctx, y)
    for k, v in p.items():
        # Adagrad's sums start at 0 here, so they are the squared gradient.
        at = np.unravel_index(np.argmax(g2[k]), v.shape)
        up, down = ({**p, k: v + np.where(np.arange(v.size).reshape(v.shape) == np.ravel_multi_index(at, v.shape), d, 0)} for d in (1e-5, -1e-5))
        assert abs((loss(up) - loss(down)) / 2e-5) == pytest.approx(np.sqrt(g2[k][at]), rel=1e-3)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div>{main}
<div id="comments"><p>Nice read</p></div><form><input name=q><button>Go</button></form><footer>&copy; x</footer></body></html>"""


def test_html_extraction(spark):
    pages, want = [], {}
    for i in range(30):
        paras = "".join(f"<p>Para  {i}.{k} &amp; more\n text" + ("</p>" if k % 2 else "") for k in range(i % 4 + 1))
        tag = ("article", "div class=content")[i % 2]
        main = f"<{tag}><h1>Head {i}</h1>{paras}<aside>side</aside><!-- no --></{tag.split()[0]}>"
        pages.append((i, f"http://{'ab'[i % 2]}.org/{i}", PAGE.format(main=main)))
        want[i] = "\n".join([f"Head {i}", *(f"Para {i}.{k} & more text" for k in range(i % 4 + 1))])
    pages += [(100, "http://a.org/n", None), (101, None, ""), (102, "x", "<p>lone <b>text</b> a < b"), (103, "http://a.org/t", "<body><article><p>cut of <a href='")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extraction.main_text(df).collect()}
    assert {i: got[i].text for i in want} == want
    assert got[100].text == "" == got[101].text and got[102].text == "lone text a < b" and got[103].text == "cut of" and got[0].n_chars == len(want[0])
    assert html_extraction.main_text(df.limit(0)).count() == 0
    w = {r.host: r for r in html_extraction.wrappers(df).collect()}
    assert [json.loads(w["a.org"].labels)[i] for i in w["a.org"].main] == ["2article"] and ")+" in w["a.org"].wrapper and ")?" in w["a.org"].wrapper


def rule_of(pages):
    """The rule of one host's pages, as wrappers() finds it, from the distinct streams in the order of their numbers."""
    seen = {}
    for html in pages:
        labels, texts = html_extraction.tokens(html)
        items = html_extraction.fold(labels)
        slots = []
        for x, members in items:
            for leaf, places in zip(html_extraction.leaves(x), members, strict=True):
                if leaf == "#":
                    of = [t for i in places for t in texts.get(i, ())]
                    h = hash(tuple(of))
                    slots.append([1, sum(len(t[0]) for t in of), sum(t[1] for t in of), h, h, int(any(t[2] for t in of))])
        key = tuple(x for x, _ in items)
        n, old = seen.get(key, (0, None))
        seen[key] = (n + 1, slots if old is None else [html_extraction._joined(u, v) for u, v in zip(old, slots, strict=True)])
    streams = []
    for key, (_, slots) in sorted(seen.items(), key=lambda x: -x[1][0]):
        left = iter(slots)
        streams.append([(x, False, [next(left) for y in html_extraction.leaves(x) if y == "#"]) for x in key])
    wrapper, main = html_extraction.infer(streams)
    return {"wrapper": [x for x, _, _ in wrapper], "main": set(main)}, wrapper


BOXES = "<html><body><div>Top of the house</div>{extra}<div><p>{text}</p>{more}</div><div>All rights of the house</div></body></html>"


def boxes(n):
    """Pages without any telling name: only what changes from page to page says where the text is."""
    pages, want = [], []
    for k in range(n):
        more = f"<h2>Part {k}</h2><p>more {k}</p>" if k % 2 else ""
        pages.append(BOXES.format(text=f"story number {k} of many", extra="<div>Breaking!</div>" if k % 3 == 0 else "", more=more))
        want.append(f"story number {k} of many" + (f"\nPart {k}\nmore {k}" if k % 2 else ""))
    return pages, want


def test_html_extraction_follows_the_aligned_wrapper(spark, monkeypatch):
    pages, want = boxes(12)
    rule, wrapper = rule_of(pages)
    assert [html_extraction.extract(p, rule) for p in pages] == want
    assert ")?" in html_extraction.written_out(wrapper) and ")+" in html_extraction.written_out(wrapper)
    df = spark.createDataFrame([(i, f"http://h.org/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extraction.main_text(df).collect()} == dict(enumerate(want))
    monkeypatch.setattr(html_extraction, "align", lambda a, b: [])
    rule, _ = rule_of(pages)
    assert [html_extraction.extract(p, rule) for p in pages] != want


@pytest.mark.parametrize("n", [1, 2, 7, 8, 30])
def test_html_extraction_of_equal_pages_and_fixed_headings(spark, n):
    same = "<html><body><div class=content><p>always the same text</p></div></body></html>"
    head = "<html><body><nav>menu</nav><article><header><h1>Title {k}</h1></header><h2>Summary</h2><p>text {k}</p></article></body></html>"
    rows = [(k, f"http://same.org/{k}", same) for k in range(n)] + [(100 + k, f"http://head.org/{k}", head.format(k=k)) for k in range(n)]
    got = {r.page_id: r.text for r in html_extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "always the same text" for k in range(n)} | {100 + k: f"Title {k}\nSummary\ntext {k}" for k in range(n)}


def test_align_is_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(4)

    def longest(a, b):
        return max((len(x) for k in range(1 << len(a)) for x in [[t for i, t in enumerate(a) if k >> i & 1]] if is_part(x, b)), default=0)

    def is_part(x, b):
        at = iter(b)
        return all(t in at for t in x)

    for _ in range(150):
        a, b = ([("+", (rng.choice("pqr"),)) for _ in range(rng.randint(0, 8))] for _ in range(2))
        pairs = html_extraction.align(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    # Both streams are found in what the wrapper accepts: take away optional pieces and the stream is left.
    a, b = ["0x", "1p", "#", "/1p", "/0x"], ["0x", "1h", "#", "/1h", "1p", "#", "/1p", "/0x"]
    piece = lambda s: [(t, False, [[1, 1, 0, 5, 5, 0]] if t == "#" else []) for t in s]
    w = html_extraction.extended(piece(a), piece(b))
    assert [t for t, _, _ in w] == b and [t for t, o, _ in w if not o] == a
    # A box more comes in whole, wherever it stands.
    box, story = ["1d", "#", "/1d"], ["1d", "2s", "#", "/2s", "/1d"]
    a, b = [*box, *story, *box], [*box, *box, *story, *box]
    w = html_extraction.extended(piece(a), piece(b))
    assert [t for t, _, _ in w] == b and [o for _, o, _ in w] == [False] * 3 + [True] * 3 + [False] * 8
    assert html_extraction.fold(["1p", "#", "/1p"] * 3)[0][0] == ("+", ("1p", "#", "/1p"))
    monkeypatch.setattr(html_extraction, "CELLS", 3)
    one = lambda s: [("+", (c,)) for c in s]
    assert html_extraction.align(one("pqrs"), one("pxys")) == [(0, 0), (3, 3)]


@pytest.mark.parametrize("words", [1000, 12000])
@pytest.mark.parametrize("sides", [20, 60, 90, 150])
def test_html_extraction_between_many_boxes(sides, words):
    """Boxes with classes of their own on every page, around an unnamed element that holds the text."""
    box = lambda k, side: "".join(f'<div class="{side}{chr(97 + k)}x{"abcdefghij"[i % 10]}{"klmnopqrst"[i // 10 % 10]}{"uvwxyz"[i // 100]}">offer {i} of {side}</div>' for i in range(sides))
    texts = [" ".join(f"w{k}n{i}" for i in range(words)) for k in range(6)]
    pages = [f"<html><body>{box(k, 'l')}<div>{text}</div>{box(k, 'r')}</body></html>" for k, text in enumerate(texts)]
    rule, _ = rule_of(pages)
    assert [html_extraction.extract(p, rule) for p in pages] == texts


def many_streams(few, rest):
    """Pages of one host: `few` frequent distinct streams whose text is in the first box, and `rest` rare ones whose text is in the second."""
    page = "<html><body><div>Top of the house</div><div><div class=intro><p>{intro}</p></div><div class=story>{story}</div></div></body></html>"
    tags = [x for x in itertools.product(("h2", "h3", "h4", "p"), repeat=6) if all(a != b for a, b in zip(x, x[1:], strict=False))]
    random.Random(3).shuffle(tags)
    pages, want = [], []
    for k in range(few + rest):
        for c in range(2 if k < few else 1):
            intro, story = f"intro {k} {c} " + "word " * (400 if k < few else 1), f"story {k} {c} " + "word " * (1 if k < few else 40)
            pages.append(page.format(intro=intro, story="".join(f"<{x}>{story} {b}</{x}>" for b, x in enumerate(tags[k]))))
            want.append("\n".join([intro.strip(), *(f"{' '.join(story.split())} {b}" for b in range(6))]))
    return pages, want


def test_html_extraction_reads_every_stream_of_a_host(spark, monkeypatch):
    """What only streams beyond the STREAMS most frequent ones say of the main region counts too."""
    pages, want = many_streams(48, 430)
    df = spark.createDataFrame([(i, f"http://h.org/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").cache()
    rules = html_extraction.wrappers(df).cache()
    (r,) = rules.collect()
    assert [json.loads(r.labels)[i] for i in r.main] == ["2div"]
    assert {x.page_id: x.text for x in html_extraction.main_text(df, rules).collect()} == dict(enumerate(want))
    # The same where wrappers come before the pages of their hosts.
    monkeypatch.setattr(html_extraction, "ROW_CHARS", 0)
    more = df.unionByName(spark.createDataFrame([(9000, "http://other.org/", "<p>lone</p>"), (9001, None, None)], df.schema))
    assert {x.page_id: x.text for x in html_extraction.main_text(more, rules).collect()} == dict(enumerate(want)) | {9000: "lone", 9001: ""}


def test_wrappers_of_parts_join_to_one_that_accepts_all():
    pages, _ = many_streams(3, 20)
    piece = lambda p: [(x, False, [[1, 1, 0, 5, 5, 0] for y in html_extraction.leaves(x) if y == "#"]) for x, _ in html_extraction.fold(html_extraction.tokens(p)[0])]
    streams = [piece(p) for p in pages]
    whole = html_extraction.joined([html_extraction.joined(streams[k : k + 4]) for k in range(0, len(streams), 4)])
    for s in streams:
        left = iter(x for x, _, _ in s)
        now = next(left)
        for x, optional, _ in whole:
            if x == now:
                now = next(left, None)
            else:
                assert optional
        assert now is None
    assert sum(v[0] for _, _, slots in whole for v in slots) == sum(v[0] for s in streams for _, _, slots in s for v in slots)
    # Alignments that go no deeper than to the main places give those the same partners.
    labels = [x for x, _, _ in whole]
    for k in (x[0] for x in html_extraction.elements(labels)):
        for s in streams:
            other = [x for x, _, _ in s]
            assert [p for p in html_extraction.align(labels, other) if p[0] == k] == [p for p in html_extraction.align(html_extraction.Fitted(labels, {k}), other) if p[0] == k]


def test_html_extraction_of_names_inside_an_article():
    page = """<html><body><div class="search-engines">menu</div><article><section id="search-engines">engines</section><div class="share-price">price</div>
    <div class="share-buttons">share it</div><div class="comment-list">they said</div><div class="related">more</div><p>end</p></article></body></html>"""
    assert html_extraction.extract(page, None) == "engines\nprice\nend"


def test_html_extraction_of_deep_pages_takes_linear_time():
    from time import monotonic

    n, before = 100_000, monotonic()
    for page in ("<div>" * n + "deep", "<div>" * n + "</p>" * n + "deep", "<body><p>" + "<button>" * n + "</p><p>" * n + "deep"):
        labels, texts = html_extraction.tokens(page)
        html_extraction.elements(labels)
        assert [t[0] for of in texts.values() for t in of] == ["deep"]
    assert monotonic() - before < 30


def test_anchors_keep_order_and_alignment_is_whole_beyond_the_cells(monkeypatch):
    """Long lists of children are cut at anchors; what both hold once, in the same order, always meets."""
    rng = random.Random(8)
    for _ in range(60):
        both = [f"1div.u{i}" for i in range(rng.randint(1, 12))]
        sides = []
        for s in "ab":
            own = [f"1div.{s}{rng.randrange(5)}" for _ in range(rng.randint(0, 25))]
            places = sorted(rng.sample(range(len(both) + len(own)), len(both)))
            line, o = [], iter(own)
            for i in range(len(both) + len(own)):
                line.append(both[places.index(i)] if i in places else next(o))
            sides.append([y for x in line for y in (x, "#", "/" + x)])
        for cells in (1 << 14, 4, 0):
            monkeypatch.setattr(html_extraction, "CELLS", cells)
            pairs = html_extraction.align(*sides)
            assert all(sides[0][i] == sides[1][j] for i, j in pairs)
            assert all(i < p and j < q for (i, j), (p, q) in zip(pairs, pairs[1:], strict=False))
            assert {sides[0][i] for i, _ in pairs} >= set(both)


def test_html_extraction_of_long_pages():
    """Pages that don't fold and are too different to align keep all their text."""
    rng = random.Random(1)
    page = lambda k: "<body><article>" + "".join(f"<div><h{rng.randint(1, 6)}>{k} {i}</h></div>" if i % 2 else f"<div>{k} {i}</div>" for i in range(3000)) + "</article><div>foot</div></body>"
    pages = [page(k) for k in range(3)]
    rule, _ = rule_of(pages)
    for k, p in enumerate(pages):
        assert html_extraction.extract(p, rule) == "\n".join(f"{k} {i}" for i in range(3000))


@pytest.mark.parametrize("name", ["op3_jaccard_join", "op7_url_filters"])
def test_oracle(spark, name):
    import duckdb
    from tidemark.llm import queries

    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    want = db.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    rows = out.collect()
    assert rows and {r.doc_id for r in rows} <= docs and all(r.taken == r.copies * r.size for r in rows)
    assert out.where(F.col("text").rlike("AKIA[A-Z0-9]{12}|password=[0-9a-f]{8}")).count() == 0
    assert jaccard_join.link(out).where("component_id != doc_id").count() == 0
