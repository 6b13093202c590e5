"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

A text becomes lower-case letters with one blank between words; its n-grams of 1 to 3 characters are hashed
into a fixed number of features. Document frequencies are counted over all learning rows. Weights are
learned from a bounded sample of them by follow-the-regularised-leader with elastic-net penalties (which
leaves most weights at exactly 0), and the scores are calibrated by a temperature on sample rows that the
weights didn't see. A text's scores need only the sum of its n-grams' weighted entries, so whole texts of
any length are scored in one pass.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, trim

ORDERS = (1, 2, 3)
#: Hashed features; a power of two.
FEATURES = 1 << 16
#: Rows that the weights are learned from, at most; the smallest hashes of doc_id.
FIT_ROWS = 4000
#: One in so many sample rows is kept for the temperature.
CALIBRATE_EVERY = 5
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.02, 3
#: Characters that are hashed at once.
STRIP = 1 << 19
UNKNOWN = "und"
#: Stands between texts that are hashed together; n-grams with it are dropped.
BORDER = "\x01"


@cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter's code point, or 0 if it is no letter; marks on letters stand for themselves."""
    table = np.zeros(0x110000, np.uint32)
    table[ord(BORDER)] = ord(BORDER)
    for c in range(2, 0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
        elif unicodedata.category(s) in ("Mn", "Mc"):
            table[c] = c
    return table


@cache
def real_letters() -> np.ndarray:
    """For each code point that letters() gives whether it is a letter, not a mark."""
    table = letters()
    return np.array([c > 1 and chr(c).isalpha() for c in range(len(table))])


def _points(text: str) -> np.ndarray:
    return letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def _single(points: np.ndarray) -> np.ndarray:
    """Where points are that stay when blanks between words are made one."""
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    return np.flatnonzero(keep)


def grams(points: np.ndarray, known: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the features of the n-grams and where they begin; single blanks, those over a border and those within the first known points are left out."""
    where = _single(points)
    p = points[where].astype(np.uint64)
    borders = np.flatnonzero(p == ord(BORDER))
    for n in ORDERS:
        if len(p) < n:
            continue
        h = np.full(len(p) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + p[i : len(p) - n + 1 + i]
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        full = p[: len(h)] != 0 if n == 1 else np.ones(len(h), bool)
        for i in range(n):
            over = borders - i
            full[over[(over >= 0) & (over < len(h))]] = False
        full[: max(0, known - n + 1)] = False
        yield (h[full] >> np.uint64(48)).astype(np.int64) & (FEATURES - 1), where[: len(h)][full]


def strips(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """A text's points with a blank on either side, a strip at a time: each begins with the last points of the one before, and their number."""
    reach, size = max(ORDERS) - 1, STRIP
    before, known = np.zeros(1, np.uint32), 0
    for at in range(0, len(text), size):
        now = np.concatenate([before, _points(text[at : at + size]), np.zeros(int(at + size >= len(text)), np.uint32)])
        now = now[_single(now)]
        yield now, known
        before = now[-reach:]
        known = len(before)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often each occurs."""
    found = np.concatenate([f for s, known in strips(text) for f, _ in grams(s, known)] or [np.zeros(0, np.int64)])
    return np.unique(found, return_counts=True)


@dataclass(frozen=True)
class Model:
    """Weights (features x languages, each already times its inverse document frequency), intercepts and temperature."""

    languages: tuple[str, ...]
    weights: np.ndarray
    intercept: np.ndarray
    temperature: float

    def probabilities(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """From summed weights of n-grams and their number."""
        z = (sums / np.maximum(n, 1)[:, None] + self.intercept) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Most probable language and its probability; UNKNOWN and 0 for texts without a letter."""
        k = len(self.languages)
        sums, n, any_letter = np.zeros((len(texts), k)), np.zeros(len(texts)), np.zeros(len(texts), bool)
        batch: list[str] = []
        owners: list[int] = []

        def flush() -> None:
            if not batch:
                return
            joined = _points("".join(f" {t} {BORDER}" for t in batch))
            lengths = np.array([len(t) + 3 for t in batch])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            for i, o in enumerate(owners):
                any_letter[o] = bool(real_letters()[joined[starts[i] : starts[i] + lengths[i]]].any())
            for f, at in grams(joined):
                cut = np.searchsorted(at, np.append(starts, len(joined)))
                filled = np.flatnonzero(np.diff(cut))
                if not len(filled):
                    continue
                for c in range(k):
                    part = np.add.reduceat(self.weights[c].take(f), cut[filled], dtype=np.float64)
                    np.add.at(sums[:, c], np.array(owners)[filled], part)
                np.add.at(n, np.array(owners)[filled], np.diff(cut)[filled])
            batch.clear()
            owners.clear()

        size = 0
        for i, t in enumerate(texts):
            if t and len(t) > STRIP:
                for s, known in strips(t):
                    any_letter[i] |= bool(real_letters()[s].any())
                    for f, _ in grams(s, known):
                        sums[i] += self.weights[:, f].sum(axis=1, dtype=np.float64)
                        n[i] += len(f)
            elif t:
                batch.append(t)
                owners.append(i)
                size += len(t)
                if size >= STRIP:
                    flush()
                    size = 0
        flush()
        if not k:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        p = self.probabilities(sums, n)
        best = p.argmax(axis=1)
        return [self.languages[b] if a else UNKNOWN for a, b in zip(any_letter, best, strict=True)], [float(p[i, b]) if any_letter[i] else 0.0 for i, b in enumerate(best)]


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """rows: language, features, their counts. Follow-the-regularised-leader, one row at a time."""
    languages = tuple(sorted({x[0] for x in rows}))
    k = len(languages)
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))  # the last feature is the intercept
    name = {x: i for i, x in enumerate(languages)}
    vectors = []
    for language, f, c in rows:
        v = c * idf[f] / c.sum()
        vectors.append((name[language], np.append(f, FEATURES), np.append(v * SCALE, 1.0)))

    def weights(f: np.ndarray) -> np.ndarray:
        zf = z[f]
        l1 = np.where(f == FEATURES, 0.0, L1)[:, None]
        return np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((BETA + np.sqrt(n[f])) / ALPHA + L2))

    fit = [v for i, v in enumerate(vectors) if i % CALIBRATE_EVERY] or vectors
    held = vectors[::CALIBRATE_EVERY]
    for _ in range(PASSES):
        for y, f, v in fit:
            w = weights(f)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
            z[f] += g - sigma * w
            n[f] += g * g
    final = weights(np.arange(FEATURES + 1))
    logits = np.array([v @ final[f] for _, f, v in held]).reshape(-1, k)
    # truths are smoothed by one row in all, else a sample without an error would ask for temperature 0
    smooth = 1 / (len(held) + 2)
    truth = np.full((len(held), k), smooth / max(1, k - 1))
    truth[np.arange(len(held)), [y for y, _, _ in held]] = 1 - smooth

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1, keepdims=True)) * truth - s * truth).sum(axis=1).mean())

    low, high = np.log(0.05), np.log(20.0)
    for _ in range(60):  # ternary search over the temperature's logarithm
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, high)
    by_language = np.ascontiguousarray((final[:FEATURES] * (SCALE * idf)[:, None]).T.astype(np.float32))
    return Model(languages, by_language, final[FEATURES], float(np.exp((low + high) / 2)))


#: Term frequencies are small numbers; they are scaled so that the penalties mean something.
SCALE = 10.0


def frequencies(learn: DataFrame, text: str = "text") -> DataFrame:
    """feature, n: in how many of the learning texts each feature occurs. Counted over all rows, whole texts."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                seen = np.zeros(FEATURES, bool)
                for s, known in strips(t or ""):
                    for f, _ in grams(s, known):
                        seen[f] = True
                n += seen
                docs += 1
        trim()
        f = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(f, FEATURES), pa.int32()), pa.array(np.append(n[f], docs), pa.int64())], names=["feature", "n"])

    return learn.select(text).mapInArrow(part, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))


def fit(learn: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model:
    """A model from all rows with a language: frequencies from every one, weights from a sample of fit_rows."""
    ready(learn.sparkSession)
    learn = learn.filter(F.col(language).isNotNull() & F.col(text).isNotNull())
    n = np.zeros(FEATURES + 1, np.int64)
    for r in frequencies(learn, text).toLocalIterator():  # FEATURES + 1 rows at most
        n[r["feature"]] = r["n"]
    idf = np.log((1 + n[FEATURES]) / (1 + n[:FEATURES])) + 1

    @F.arrow_udf("struct<f: binary, c: binary>")
    def sparse(batch: pa.Array) -> pa.Array:
        found = [counts(t) for t in batch.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[i].astype(np.int32).tobytes() for x in found], pa.binary()) for i in (0, 1)], names=["f", "c"])

    hashed = learn.select(F.col(language).alias("y"), F.xxhash64(F.col(key)).alias("h"), F.col(text).alias("t"))
    most = hashed.select("h").orderBy("h").limit(fit_rows).agg(F.max("h").alias("h")).first()["h"]
    if most is None:
        return Model((), np.zeros((0, FEATURES), np.float32), np.zeros(0), 1.0)
    sample = hashed.filter(F.col("h") <= most).select("y", "h", sparse("t").alias("x")).orderBy("h", "y", "x.f").limit(fit_rows)
    rows = [
        (r["y"], f.astype(np.int64), np.frombuffer(r["x"]["c"], np.int32).astype(np.float64))
        for r in sample.toLocalIterator()
        if len(f := np.frombuffer(r["x"]["f"], np.int32))
    ]
    if not rows:
        return Model((), np.zeros((0, FEATURES), np.float32), np.zeros(0), 1.0)
    model = train(rows, idf)
    rows.clear()
    trim()  # the driver goes on with what it had before
    return model


def predicted(text: Column | str, model: Model) -> Column:
    """Arrow function: struct<lang_pred, score> of a text column."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(batch: pa.Array) -> pa.Array:
        names, scores = model.predict(batch.to_pylist())
        trim()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return run(text)


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_id(docs: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> DataFrame:
    """key, held_out, lang_pred, score for each row of docs.

    Learns from the rows that aren't held out and have a text and a language. Nulls: a null text, or one
    without a letter, is `und` with score 0; a null key isn't held out and is passed on; rows without a
    language are only predicted. Repeated rows get equal results. Other columns are not read. With no row to
    learn from (an empty table too) every row is `und`. Predictions and document frequencies take whole texts.
    """
    model = fit(docs.filter(~held_out(F.col(key))), text, language, key, fit_rows)
    done = docs.select(F.col(key), held_out(F.col(key)).alias("held_out"), predicted(F.col(text), model).alias("_p"))
    return done.select(key, "held_out", "_p.lang_pred", "_p.score")
