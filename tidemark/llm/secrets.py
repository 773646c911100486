"""Secret scans: fixed patterns, and a guess-cost dynamic program on values in credential contexts.

The guess cost of a value is the smallest sum, over all ways to cut it into words, dates,
repeats, keyboard walks and brute-force spans, of the log10 guesses of its pieces. Words are common passwords and
the corpus' own words of letters, ranked by the number of documents that have them (`dictionary`); what stands
as a value in a credential context isn't counted, so that a leaked secret doesn't become a word by being copied. A value
that a credential name is assigned (`pwd: ...`, `passphrase = ...`) and that no fixed patterns
cover wholly is added as kind `guess` when its cost reaches LEAST. Values, and repeats and walks in them,
have no longest length, nor have words; the program takes time linear in the value for each length that
words have, and stops once LEAST is sure.

Defined cases: null text is empty text and has no spans; an empty table gives an empty dictionary and no rows; spans count code points, end
exclusive; words in equally many documents are ranked by their hash; very long texts and values are read whole; repeated rows give repeated results
(and count as documents); other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import lean

#: log10 guesses from which an assigned value counts as a secret.
LEAST = 10.0
#: Words of the dictionary, and documents that a word must be in: FOUND, or SHARE of all if that is more.
DICTIONARY, FOUND, SHARE = 200_000, 8, 1e-4
#: Longest unit of a repeat, in characters.
UNIT = 8
#: Characters after which the dynamic program looks whether it may stop, if no word is longer; no date is.
CHECK = 24
#: Characters whose parts are looked up in the dictionary at once, if no word is longer.
STRETCH = 1024

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")
# Names that put a value into a credential context.
CONTEXT = re.compile(r"""\b(?:pwd|pass|pin|passphrase|passcode|passwort|kennwort|credentials?|auth|bearer|private_?key|client_?secret|access_?key|secret_?key|auth_?token|password|passwd|secret|token|api_?key)["']?\s{0,4}(?::|=|\bis\b)\s{0,4}["']?([^\s"'<>]{4,})""", re.I | re.A)
MAYBE = r"(?i)(?:pwd|pass|pin|kennwort|credential|auth|bearer|key|secret|token|AKIA)|[0-9a-f]{32}"
# Common words of guessed passwords, most common first.
WORDS = """password qwerty admin welcome monkey dragon letmein login master hello secret shadow sunshine princess football
baseball superman batman trustno access flower hunter ranger summer winter spring autumn love test user root guest
default changeme example sample demo token service server client database public private company account""".split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
# Rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {a + b for r in ROWS for x in (r, r[::-1]) for a, b in zip(x, x[1:], strict=False)}
_LEET = str.maketrans("4301$5@7", "aeoissat")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")


def without_values(text: str) -> str:
    """The text without what it gives as values of credentials."""
    for pattern, value in ((CONTEXT, 1), (ASSIGN, 2)):
        text = pattern.sub(lambda m, v=value: m[0][: m.start(v) - m.start()] + " ", text)
    return text


def dictionary(docs: DataFrame, most: int = DICTIONARY, found: int = FOUND, share: float = SHARE) -> dict:
    """The words of letters that most documents have outside credential contexts: sorted hashes, their ranks from 1, and the
    lengths that there are, in characters. Words in all of docs (text) are counted."""
    from .textops import distinct_by_row, slices, word_hashes, word_spans

    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = letter[128:] = True

    def count(batches):
        for batch in batches:
            text = batch.column("text")
            maybe = pc.fill_null(pc.match_substring_regex(text, MAYBE), False)
            if pc.any(maybe).as_py():
                text = pc.replace_with_mask(text, maybe, pa.array([without_values(t) for t in text.filter(maybe).to_pylist()], text.type))
            parts, sizes = [], []
            for _, data, off in slices(text):
                if not len(data):
                    continue
                h, first = word_hashes(data, off)
                s, e, _ = word_spans(data, off)
                odd = np.concatenate(([0], np.cumsum(~letter[data])))
                ok = (odd[e] == odd[s]) & (e - s >= 2)
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                parts.append(distinct_by_row(h[ok], np.concatenate(([0], np.cumsum(ok)))[first])[0])
                h, i = np.unique(h[ok], return_index=True)
                sizes.append((h, (chars[e[ok][i]] - chars[s[ok][i]]).astype(np.int64)))
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
            known, i = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in sizes)]), return_index=True)
            size = np.concatenate([np.zeros(0, np.int64), *(x for _, x in sizes)])[i]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(size[np.searchsorted(known, h)])], names=["word", "n", "size"])

    every = docs.select("text").mapInArrow(lean(count), "word long, n long, size long").groupBy("word").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    least = max(found, math.ceil(share * docs.count()))
    top = every.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).toPandas()
    h = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return {"hash": h[order], "rank": order + 1, "sizes": sorted({*top["size"].tolist()} - {1})}


def _ranks(plain: str, words: dict) -> dict:
    """(start, end): rank of the parts of a value that are words of the dictionary."""
    if not plain:
        return {}
    from .textops import hashes_of

    data, at = np.frombuffer(plain.encode(), np.uint8), np.concatenate(([0], np.cumsum([len(c.encode()) for c in plain])))
    out = {}
    for k in words["sizes"]:
        if k > len(plain):
            break
        h = hashes_of(data, at[:-k], at[k:])
        i = np.minimum(np.searchsorted(words["hash"], h), len(words["hash"]) - 1)
        hit = np.flatnonzero(words["hash"][i] == h)
        out.update(((x, x + k), r) for x, r in zip(hit.tolist(), words["rank"][i[hit]].tolist(), strict=True))
    return out


def guess_cost(value: str, enough: float = math.inf, words: dict | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation of the value takes; or a part's cost, once no segmentation costs less than `enough`."""
    n = len(value)
    low, best = value.lower(), [0.0] + [math.inf] * n
    low = low if len(low) == n else value
    plain = low.translate(_LEET)
    sizes = words["sizes"] if words else []
    longest = max([CHECK, *sizes[-1:]])
    stretch, known = max(STRETCH, longest), {}
    lengths = sorted({*sizes, *map(len, WORDS)})
    alphabet = sum(k for k, p in ((26, r"[a-z]"), (26, r"[A-Z]"), (10, r"\d"), (33, r"[^A-Za-z0-9]")) if re.search(p, value)) or 1
    each = math.log10(alphabet)
    ends: list[int] = []
    # Open starts of walks (unit 0) and repeats, per unit and place modulo it.
    opened: list[list[list[int]]] = [[[0] if q == 0 else [] for q in range(max(1, u))] for u in range(UNIT + 1)]
    for j in range(1, n + 1):
        if sizes and j % stretch == 1:
            a = max(0, j - 1 - longest)
            known = {(a + x, a + y): r for (x, y), r in _ranks(plain[a : j - 1 + stretch], words).items()}
        m = _DATE.match(low, j - 1)
        ends.append(m.end() if m else 0)
        here = best[j - 1] + each
        for k in lengths:
            i = j - k
            if i < 0:
                break
            if (r := min(RANK.get(plain[i:j], math.inf), known.get((i, j), math.inf))) < math.inf:
                here = min(here, best[i] + math.log10(r + 1) + 0.3 * (value[i:j] != low[i:j]) + 0.5 * (plain[i:j] != low[i:j]))
        for i in range(max(0, j - CHECK), j):
            if ends[i] == j:
                here = min(here, best[i] + 4.5)
        for u in range(UNIT + 1):
            # The last character breaks the pieces that began so early that they compare it.
            if u == 0:
                broken, least, price = j >= 2 and low[j - 2 : j] not in _NEXT, 3, 2.0
            else:
                of = low if u == 1 else value
                broken, least, price = j > u and of[j - 1] != of[j - 1 - u], max(3, 2 * u), u * each
            if broken:
                first = j - max(1, u)
                opened[u] = [[i for i in starts if i >= first] if starts and starts[0] < first else starts for starts in opened[u]]
            starts = opened[u][j % max(1, u)]
            if not starts or j - starts[0] < least:
                continue
            keep, lowest = [], math.inf
            for i in starts:
                if j - i < least:
                    keep.append(i)
                    continue
                c = best[i] + math.log10((j - i) / max(1, u))
                # A later start that costs more now costs more at every later end.
                if c < lowest:
                    lowest = c
                    keep.append(i)
            opened[u][j % max(1, u)] = keep
            here = min(here, lowest + price)
        best[j] = here
        for u in range(UNIT + 1):
            opened[u][j % max(1, u)].append(j)
        if j % longest == 0 and j < n and min(best[j - longest : j + 1]) >= enough and all(best[i] >= enough for x in opened for starts in x for i in starts):
            return min(best[j - longest : j + 1])
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def guess_spans(text: str, base: list[tuple[int, int, int]], least: float = LEAST, words: dict | None = None) -> list[tuple[int, int, int]]:
    """Values in credential contexts that base spans don't cover wholly and whose guess cost reaches least."""
    out = []
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        while b > a and text[b - 1] in ".,;:!?)]}":
            b -= 1
        done = a
        for s, _, e in base:
            done = max(done, e) if s <= done else done
        if b - a >= 4 and done < b and guess_cost(text[a:b], least, words) >= least:
            out.append((a, 3, b))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, keep: list[str], words: dict | None = None, least: float = LEAST) -> DataFrame:
    """The columns `keep` of each row, then base and guess: arrays of (start, kind, end), kind's place in KINDS."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("base", span), T.StructField("guess", span)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def apply(batches):
        for batch in batches:
            text = batch.column(len(keep))
            maybe = pc.fill_null(pc.match_substring_regex(text, MAYBE), False)
            base, more = [[] for _ in range(len(text))], [[] for _ in range(len(text))]
            for i in pc.indices_nonzero(maybe).to_pylist():
                t = text[i].as_py()
                base[i] = base_spans(t)
                more[i] = guess_spans(t, base[i], least, words)
            as_rows = lambda x: pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in y] for y in x], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], as_rows(base), as_rows(more)], names=[f.name for f in schema.fields])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(lean(apply), schema)


def digest(docs: DataFrame, words: dict | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of docs (doc_id, text)."""
    name = F.lit(list(KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    every = F.array_sort(F.concat("base", "guess"))
    return scan(docs, ["doc_id"], words, least).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(every).alias("spans")
    )


def redact(docs: DataFrame, words: dict | None = None, least: float = LEAST, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span of text replaced by the mark; the other columns stay as they are."""
    names = docs.columns
    at = names.index("text")

    def apply(batches):
        for batch in batches:
            text = batch.column(at)
            maybe = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(text, MAYBE), False)).to_pylist()
            if maybe:
                new = text.to_pylist()
                for i in maybe:
                    t, out, done = new[i], [], 0
                    base = base_spans(t)
                    for a, _, b in sorted(base + guess_spans(t, base, least, words)):
                        if a >= done:
                            out += [t[done:a], mark]
                        done = max(done, b)
                    new[i] = "".join([*out, t[done:]])
                batch = pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(new, text.type), *batch.columns[at + 1 :]], names=batch.schema.names)
            yield batch

    return docs.mapInArrow(lean(apply), docs.schema)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
