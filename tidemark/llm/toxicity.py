"""Toxicity: a weighted lexicon, learned from labels, matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs and digit or symbol substitutions to letters and turns
everything else into spaces. The lexicon holds whole words and word beginnings whose documents are
mostly labelled toxic, weighted by log odds; exception phrases (given ones, and learned
words that begin like a lexicon entry but are usual in clean documents) cancel the matches
inside them. The summed weight, alone and normalised by length, goes through a logistic
function fitted on the same labelled rows.

Learning takes a bounded sample: SAMPLE labelled rows at most, about, which bounds what the lexicon can hold; scoring takes every
document's whole text. Defined cases: null and empty text have no evidence and get the base
score; without labels of both classes every score is 0; exact copies with the same label count once;
repeated rows give repeated results; other columns aren't looked at.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import lean

#: Labelled rows to learn from, at most about.
SAMPLE = 20_000
#: Toxic documents an entry must be found in, and the least log odds of an entry.
SUPPORT, ODDS = 4, 2.0
PREFIXES = (4, 5, 6, 7)
# Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clownfish", "scum line", "loser bracket")
# Letters that look like Latin ones, and substitutions.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ℓ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "!": "i",
}
# Wide forms follow a rule: U+FF41 to U+FF5A stand for a to z.
_TABLE = str.maketrans(HOMOGLYPHS | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_GAP = re.compile(r"[\W\d_]+")
# A substitution counts only between letters: `!` or `1` at a word's end stays what it is.
_SWAP = re.compile(r"(?<=[^\W\d_])[013457 8@$€!]+(?=[^\W\d_])".replace(" ", ""))


def fold(text: str | None) -> str:
    """The words of the text, folded, with one space before, between and after."""
    if not text:
        return " "
    low = text.lower()
    if not low.isascii():
        low = low.translate(_HOMO)
    low = _SWAP.sub(lambda m: m[0].translate(_TABLE), low)
    return f" {_GAP.sub(' ', low).strip()} ".replace("  ", " ")


_HOMO = {k: v for k, v in _TABLE.items() if not chr(k).isascii()}


def fragments(folded: str) -> set[str]:
    """Whole words (` word `) and word beginnings (` wor`) to learn from."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if len(w) >= k)
    return out


def matcher(lexicon: dict[str, float], exceptions):
    import ahocorasick

    a = ahocorasick.Automaton()
    for key, w in lexicon.items():
        a.add_word(key, (len(key), float(w)))
    for phrase in exceptions:
        if (key := fold(phrase)).strip():
            a.add_word(key, (len(key), -1.0))
    if len(a):
        a.make_automaton()
    return a


def evidence(folded: str, automaton) -> float:
    """Sum over words of the largest weight matched at the word's start, without words inside an exception."""
    if not len(automaton):
        return 0.0
    found, spared = {}, []
    for end, (n, w) in automaton.iter(folded):
        a = end - n + 1
        if w < 0:
            spared.append((a, end))
        elif w > found.get(a, 0.0):
            found[a] = w
    if not spared:
        return sum(found.values())
    # One sweep: a match is spared if an exception that began at or before it ends after it.
    spared.sort()
    i, until, total = 0, 0, 0.0
    for a in sorted(found):
        while i < len(spared) and spared[i][0] <= a:
            until = max(until, spared[i][1])
            i += 1
        if a >= until:
            total += found[a]
    return total


def _features(text: list, automaton) -> np.ndarray:
    out = np.zeros((len(text), 2))
    for i, t in enumerate(text):
        f = fold(t)
        out[i] = evidence(f, automaton), f.count(" ") - 1
    return out


def _inputs(x: np.ndarray) -> np.ndarray:
    """Intercept, summed weight, and weight normalised by length."""
    e, n = x[:, 0], np.maximum(x[:, 1], 1)
    return np.stack([np.ones(len(e)), np.log1p(e), np.log1p(100 * e / n)], axis=1)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions=EXCEPTIONS) -> dict:
    """A model from docs (doc_id, text) and labels (doc_id, toxic)."""
    labels = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic")
    n = labels.count()
    bounded = F.broadcast(labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < min(1.0, sample / max(n, 1)) * 1_000_003))
    rows = docs.select("doc_id", "text").join(bounded, "doc_id").select("toxic", "text")
    # An exact copy adds nothing to learn.
    rows = rows.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.first("text").alias("text")).select("toxic", "text")
    shown = " "

    def count(batches):
        for batch in batches:
            toxic, seen = batch.column("toxic").to_pylist(), {}
            for t, text in zip(toxic, batch.column("text").to_pylist(), strict=True):
                for f in fragments(fold(text)):
                    x = seen.setdefault(f, [0, 0])
                    x[t] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["f", "clean", "toxic"])
            yield pa.RecordBatch.from_arrays([pa.array([shown]), pa.array([toxic.count(0)], pa.int64()), pa.array([toxic.count(1)], pa.int64())], names=["f", "clean", "toxic"])

    counts = rows.mapInArrow(lean(count), "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kept = counts.where((F.col("toxic") >= SUPPORT) | (F.col("f") == shown)).where((F.col("clean") <= 4 * F.col("toxic")) | (F.col("f") == shown)).collect()
    total = next((r for r in kept if r.f == shown), None)
    if total is None or not total.clean or not total.toxic:
        return {"lexicon": {}, "exceptions": (), "beta": None}
    odds = {r.f: math.log((r.toxic + 0.5) / (total.toxic + 1)) - math.log((r.clean + 0.5) / (total.clean + 1)) for r in kept if r.f != shown}
    lexicon: dict[str, float] = {}
    for f in sorted((f for f, w in odds.items() if w >= ODDS), key=lambda f: (len(f), f)):
        # A longer entry is kept only if it says more than its beginning does.
        if not any(lexicon.get(f[:k], -1.0) >= odds[f] - 0.5 for k in range(3, len(f))):
            lexicon[f] = odds[f]
    spared = [f.strip() for f, w in odds.items() if f.endswith(" ") and w < 0.5 and any(f[:k] in lexicon for k in range(4, len(f)))]
    model = {"lexicon": lexicon, "exceptions": tuple(exceptions) + tuple(sorted(spared)), "beta": None}

    def measure(batches):
        a = matcher(model["lexicon"], model["exceptions"])
        for batch in batches:
            x = _features(batch.column("text").to_pylist(), a)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["toxic", "e", "n"])

    got = rows.select(F.col("toxic").cast("int"), "text").mapInArrow(lean(measure), "toxic int, e double, n double").toPandas().sort_values(["e", "n", "toxic"])
    x, y, beta = _inputs(got[["e", "n"]].to_numpy()), got["toxic"].to_numpy(float), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.1, 0.1])
        beta = beta + np.linalg.solve(h, x.T @ (y - p) - np.array([1e-3, 0.1, 0.1]) * beta)
    model["beta"] = beta
    return model


def _scores(text: list, automaton, beta) -> np.ndarray:
    if beta is None:
        return np.zeros(len(text))
    return 1 / (1 + np.exp(-np.clip(_inputs(_features(text, automaton)) @ beta, -30, 30)))


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns `keep` of each row, then score."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def apply(batches):
        a = matcher(model["lexicon"], model["exceptions"])
        for batch in batches:
            s = _scores(batch.column(len(keep)).to_pylist(), a, model["beta"])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s)], names=[f.name for f in schema.fields])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(lean(apply), schema)


def without_toxic(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below least, with all columns."""
    at = docs.columns.index("text")

    def apply(batches):
        a = matcher(model["lexicon"], model["exceptions"])
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at).to_pylist(), a, model["beta"]) < least))

    return docs.mapInArrow(lean(apply), docs.schema)
