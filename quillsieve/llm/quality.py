"""A quality classifier learned from preferences between documents.

Of two labelled documents the one with label 1 is preferred. A Bradley-Terry model gives each
document the strength w . x of its text features x, so the chance that a is preferred to b is the
logistic function of w . (x_a - x_b), and w is fitted by logistic loss on such differences. The
threshold is a quantile of the strengths of the fitted documents: the share of label 0 among all
labels that may be used. The score is the logistic function of strength minus threshold, so the
documents above the threshold have 0.5 or more.

Features are surface counts and a profile of words: shares of hashed words and of hashed pairs of
words that follow each other, in `BUCKETS` buckets each, under a heavier ridge.

The model is fitted on at most `fit_rows` labelled rows of either label, those of the least
hashed ids, put in the order of their ids and features, so that a model doesn't depend on how rows
arrive; everything else covers all rows. Whole texts are read, and only texts.

Defined results: a null text counts as empty and is scored like it; rows without a label or id
are not fitted on; a row labelled twice is fitted on twice; without rows of both labels every
score is 0.5; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import ragged
from .common import fresh

FIT_ROWS = 10_000
PAIRS_A_ROW = 8
BUCKETS = 64
RIDGE, PROFILE_RIDGE = 1e-3, 1e-1

MARKS = np.zeros(256, bool)
MARKS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(0xC0, 256)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.zeros(256, bool)
STOP[[ord("."), ord(",")]] = True
NAMES = ("size", "upper", "marks", "stops", "digits", "again", "distinct", "length", "bare", "tails", "lines", "most", "pairs", "same_lines")
WIDTH = len(NAMES) + 2 * BUCKETS


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers for each text; zeros for one without words."""
    data, offsets = ragged.utf8(texts)
    out = np.zeros((len(texts), WIDTH))
    for i, j in ragged.chunks(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = ragged.words(part, at)
        h = ragged.span_hashes(ragged.LOWER[part], starts, ends)

        def per_text(flags: np.ndarray, at: np.ndarray = at) -> np.ndarray:
            run = np.append(0, np.cumsum(flags, dtype=np.int64))
            return np.diff(run[at])

        def per_word(flags: np.ndarray, first: np.ndarray = first) -> np.ndarray:
            return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[first])

        bytes_, words = np.maximum(np.diff(at), 1), np.diff(first)
        many = np.maximum(words, 1)
        letters = np.maximum(per_text(LETTER[part]), 1)
        run = np.append(0, np.cumsum(LETTER[part]))
        bare = run[ends] == run[starts]
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[first[:-1][first[:-1] < len(h)]] = False  # nothing before a text counts
        last = ends - 1
        tails = (ends - starts > 2) & MARKS[part[last]] & (part[last] == part[np.maximum(last - 1, 0)])
        distinct, most, pairs, same_lines = (np.zeros(j - i) for _ in range(4))
        lines = part == 10
        two = ragged.mixed(h[1:] + h[:-1] * np.uint64(0x9E3779B97F4A7C15)) if len(h) > 1 else h[:0]
        line_ends = np.flatnonzero(lines)
        for k in range(j - i):
            a, b = first[k], first[k + 1]
            if b > a:
                _, count = np.unique(h[a:b], return_counts=True)
                distinct[k], most[k] = len(count), count.max()
                pairs[k] = len(np.unique(two[a : b - 1])) / max(1, b - a - 1)
                cuts = line_ends[np.searchsorted(line_ends, at[k]) : np.searchsorted(line_ends, at[k + 1])]
                if len(cuts):
                    s, e = np.append(at[k], cuts + 1), np.append(cuts, at[k + 1])
                    same_lines[k] = 1 - len(np.unique(ragged.span_hashes(part[at[k] : at[k + 1]], s - at[k], e - at[k]))) / len(s)
        rows = [
            np.log1p(words),
            np.sqrt(per_text(UPPER[part]) / letters),
            np.sqrt(per_text(MARKS[part]) / bytes_),
            np.sqrt(per_text(STOP[part]) / many),
            np.sqrt(per_text(DIGIT[part]) / bytes_),
            np.sqrt(per_word(same) / (words + 8)),
            distinct / np.maximum(many, 1) ** 0.8,
            letters / many / 10,
            np.sqrt(per_word(bare) / (words + 8)),
            np.sqrt(per_word(tails) / (words + 8)),
            np.sqrt(per_text(lines) / many),
            np.sqrt(most / (words + 8)),
            np.where(words > 1, pairs, 1.0),
            np.sqrt(same_lines),
        ]
        out[i:j, : len(NAMES)] = np.where(words[:, None] > 0, np.stack(rows, 1), 0.0)
        text = np.repeat(np.arange(j - i), words)
        for k, some, which in ((0, h, text), (1, two, np.where(text[1:] == text[:-1], text[1:], j - i) if len(h) > 1 else text[:0])):  # pairs across texts go to a row of their own
            bucket = (some >> np.uint64(40)).astype(np.int64) % BUCKETS
            tally = np.bincount(which * BUCKETS + bucket, minlength=(j - i + 1) * BUCKETS)[: (j - i) * BUCKETS].reshape(-1, BUCKETS)
            at = len(NAMES) + k * BUCKETS
            out[i:j, at : at + BUCKETS] = np.sqrt(tally / np.maximum(words - k, 1)[:, None])
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold, -500, 500)))

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight


def gradient(w: np.ndarray, good: np.ndarray, bad: np.ndarray, pairs: np.ndarray, ridge: np.ndarray, step: int = 1 << 13) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the mean logistic loss over pairs of rows, with a ridge; differences of a few pairs at a time."""
    slope, bend = ridge * w, np.diag(ridge)
    for i in range(0, len(pairs), step):
        d = good[pairs[i : i + step, 0]] - bad[pairs[i : i + step, 1]]
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        slope = slope - d.T @ p / len(pairs)
        bend = bend + (d * (p * (1 - p))[:, None]).T @ d / len(pairs)
    return slope, bend


def fit(good: np.ndarray, bad: np.ndarray, share_bad: float, seed: int = 5) -> Model:
    """good, bad: features of documents with label 1 and 0."""
    k = good.shape[1]
    if not len(good) or not len(bad):
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 0.0)
    both = np.vstack([good, bad])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    rng = np.random.default_rng(seed)
    n = PAIRS_A_ROW * max(len(good), len(bad))
    pairs = np.stack([rng.integers(0, len(good), n), rng.integers(0, len(bad), n)], 1)
    ridge = np.where(np.arange(k) < len(NAMES), RIDGE, PROFILE_RIDGE)
    w = np.zeros(k)
    for _ in range(30):  # Newton's method
        slope, bend = gradient(w, good / scale, bad / scale, pairs, ridge)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    model = Model(mean, scale, w, 0.0)
    strength = np.concatenate([model.strength(good), model.strength(bad)])
    weight = np.concatenate([np.full(len(good), (1 - share_bad) / len(good)), np.full(len(bad), share_bad / len(bad))])
    order = np.argsort(strength, kind="stable")
    at = int(np.searchsorted(np.cumsum(weight[order]), share_bad))
    near = strength[order][max(0, min(at, len(order) - 2)) :][:2]  # the quantile lies between these two
    return Model(mean, scale, w, float(near.mean()))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _features():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(2)).astype("<f8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "quality", "x"])

    return run


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """A model from the labels (doc_id, quality) of rows that aren't held out."""
    ship(docs.sparkSession)
    usable = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality")).where(F.col("id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("id")))
    seen = {r.quality: r.n for r in usable.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return fit(np.zeros((0, WIDTH)), np.zeros((0, WIDTH)), 0.5)
    picked = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("id"), "id").limit(fit_rows) for q in (0, 1)]
    sample = picked[0].unionByName(picked[1])  # at most 2 * fit_rows rows of two numbers
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    rows = texts.select(F.col("id").cast("string").alias("id"), "quality", "text").mapInArrow(_features(), "id string, quality int, x binary").collect()
    rows.sort(key=lambda r: (r.id, r.quality, bytes(r.x)))
    x, y = np.frombuffer(b"".join(r.x for r in rows), "<f8").reshape(-1, WIDTH), np.array([r.quality for r in rows])
    return fit(x[y == 1], x[y == 0], seen[0] / (seen[0] + seen[1]))


def _score(model: Model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(features(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], [*batch.schema.names[1:], name])

    return run


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with a column of scores, and its name."""
    ship(docs.sparkSession)
    (score,) = fresh(docs, "score")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns)
    rows = docs.select(F.col(text_col).cast("string").alias("quality_text__"), *[F.col(f"`{c}`") for c in docs.columns])
    return rows.mapInArrow(_score(model, score), f"{schema}, `{score}` double"), score


def annotate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = learn(docs, labels, id_col, text_col, **how)
    rows, _ = scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that the model doesn't reject, with their columns."""
    rows, score = scored(docs, learn(docs, labels, id_col, text_col, **how), text_col)
    return rows.where(F.col(score) >= 0.5).select(docs.columns)
