"""Quality scores by regularised quadratic discriminant analysis over document statistics.

Each document becomes a vector of transformed statistics (shares as shrunk logits, counts as logarithms), which are closer to
normal than the raw ones. Each class has its mean and a covariance shrunk towards a multiple of the identity; a score is the
difference of the two log densities, from Mahalanobis distances by Cholesky factors cached in the model, calibrated by a
logistic curve. All labelled training rows are used: the fit needs sums that merge (counts, sums, products; later a histogram
of margins), so only a few hundred numbers reach the driver however large the tables are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import owners, picked, steps, words_of, written

#: Classes of bytes, by their place: lower-case letters, capitals, digits, symbols, sentence ends, other punctuation, white space, beyond ASCII.
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>{}[]\\^~=_@", ".!?", ",;:'\"()-/+`", " \t\n\x0b\x0c\r")
FEATURES = ("log_words", "mean_word", "capitals", "digits", "symbols", "ends", "punctuation", "beyond_ascii", "distinct", "most_common", "same_as_last", "lines", "short_words", "long_words", "symbol_words")
THRESHOLD = 0.3
#: Bins of the margins' histogram and the margin at which it ends.
BINS, EDGE = 400, 40.0
#: Rows' worth of weight that the identity has in a class covariance.
SHRINK = 50.0

_LOOKUP = np.full(256, len(_CLASSES), dtype=np.int64)  # the last class: control characters and beyond ASCII
for _i, _letters in enumerate(_CLASSES):
    _LOOKUP[[ord(c) for c in _letters]] = _i


#: Ordinary shares, which a text's own are shrunk to by so many bytes or words, so that a text of two words isn't odd.
_BYTES, _WORDS = 60.0, 12.0
_USUAL_BYTES = {1: 0.03, 2: 0.004, 3: 0.003, 4: 0.02, 5: 0.02, 7: 0.03}
_USUAL_WORDS = {"distinct": 0.85, "most_common": 0.1, "same_as_last": 0.005, "short_words": 0.2, "long_words": 0.1, "symbol_words": 0.01}


def _logit(part: np.ndarray, whole: np.ndarray, usual: float, weight: float) -> np.ndarray:
    return np.log((part + usual * weight) / (whole - part + (1 - usual) * weight))


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; null is as empty. All finite."""
    n, kinds = len(texts), len(_CLASSES) + 1
    words, offsets = words_of(texts)
    counts, owner = np.diff(offsets).astype(float), owners(offsets)
    if len(words):
        ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        letters = _LOOKUP[np.frombuffer(words.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]]
        ends -= ends[0]
        sizes = np.diff(ends)
        by_kind = np.bincount(np.repeat(owner, sizes) * kinds + letters, minlength=n * kinds).reshape(n, kinds).astype(float)
        symbolic = np.maximum.reduceat((letters == 3).astype(np.int8), ends[:-1])
        codes = words.dictionary_encode().indices.to_numpy()
        again = np.concatenate(([False], (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])))
        per_text = lambda flags: np.bincount(owner, weights=flags, minlength=n)
        order = np.lexsort((codes, owner))
        new = np.concatenate(([True], (codes[order][1:] != codes[order][:-1]) | (owner[order][1:] != owner[order][:-1])))
        firsts = np.flatnonzero(new)
        runs = np.diff(np.concatenate((firsts, [len(codes)])))
        distinct, most = np.bincount(owner[order][firsts], minlength=n).astype(float), np.zeros(n)
        np.maximum.at(most, owner[order][firsts], runs)
        same, short, long, symbol_words = per_text(again), per_text(sizes <= 2), per_text(sizes >= 12), per_text(symbolic)
    else:
        by_kind, distinct, most, same, short, long, symbol_words = np.zeros((n, kinds)), *(np.zeros(n) for _ in range(6))
    total = by_kind.sum(axis=1)
    lines = np.array([0 if t.as_py() is None else t.as_buffer().to_pybytes().count(b"\n") for t in texts], dtype=float)
    by_word = dict(zip(_USUAL_WORDS, (distinct, most, same, short, long, symbol_words), strict=True))
    shares = {k: _logit(np.minimum(v, counts), counts, _USUAL_WORDS[k], _WORDS) for k, v in by_word.items()}
    columns = [np.log1p(counts), np.log((total + 6 * _WORDS) / (counts + _WORDS))]
    columns += [_logit(by_kind[:, i], total, usual, _BYTES) for i, usual in _USUAL_BYTES.items()]
    columns += [shares[k] for k in ("distinct", "most_common", "same_as_last")]
    columns += [np.log((lines + 0.2) / (counts + _WORDS))]
    columns += [shares[k] for k in ("short_words", "long_words", "symbol_words")]
    return np.column_stack(columns)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        x = features(batch.column("text"))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], ["doc_id", "x"])


def document_features(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): FEATURES of each row's whole text, all finite. Null, empty and blank texts have those of no words; repeated
    rows are read each, a null id stays null, an empty table gives none. Other columns, also of like names, play no part."""
    return picked(docs, doc_id=id, text=text).mapInArrow(_featured, "doc_id long, x array<double>")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        x, y = batch.column("x").flatten().to_numpy().reshape(-1, d), batch.column("y").to_numpy()
        for label in np.unique(y).tolist():
            own = x[y == label]
            totals[label] = totals.get(label, 0) + np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
    for label, values in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(values), pa.int32()), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["y", "at", "value"])


@dataclass
class Model:
    """Means, inverted Cholesky factors and log priors less log determinants of the classes 0 and 1, and the calibration of
    their margin. A row of z = inverse @ (x - mean) has the Mahalanobis distance as its squared length."""

    means: np.ndarray
    inverses: np.ndarray
    logs: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        """log density and prior of class 1 less those of class 0."""
        parts = []
        for mean, inverse, log in zip(self.means, self.inverses, self.logs, strict=True):
            z = inverse @ (x - mean).T
            parts.append(log - 0.5 * (z * z).sum(axis=0))
        return np.clip(parts[1] - parts[0], -EDGE, EDGE)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margins(x) + self.shift)))


def fitted(training: DataFrame) -> Model | float:
    """The model of training (x array<double>, y 0 or 1), or the constant score where a class is missing (0.5 without rows)."""
    d = len(FEATURES)
    rows = training.mapInArrow(_sums, "y int, at int, value double").groupBy("y", "at").agg(F.sum("value").alias("value")).collect()  # 2 (1 + d + d d) numbers
    sums = {label: np.zeros(1 + d + d * d) for label in (0, 1)}
    for r in rows:
        sums[r["y"]][r["at"]] = r["value"]
    counts = [sums[label][0] for label in (0, 1)]
    if not all(counts):
        return (counts[1] + 0.5) / (sum(counts) + 1)
    means, inverses, logs = [], [], []
    pooled = sum(sums[label][1 + d :].reshape(d, d) for label in (0, 1)) / sum(counts)
    centre = sum(sums[label][1 : 1 + d] for label in (0, 1)) / sum(counts)
    spread = np.maximum(np.diag(pooled) - centre * centre, 1e-6)
    for label, n in zip((0, 1), counts, strict=True):
        mean = sums[label][1 : 1 + d] / n
        own = sums[label][1 + d :].reshape(d, d) / n - np.outer(mean, mean)
        share = SHRINK / (SHRINK + n)
        means.append(mean)
        factor = np.linalg.cholesky((1 - share) * own + (share + 1e-4) * np.diag(spread))
        inverses.append(np.linalg.inv(factor))
        logs.append(np.log(n / sum(counts)) - np.log(np.diag(factor)).sum())
    model = Model(np.array(means), np.array(inverses), np.array(logs))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = model.margins(batch.column("x").flatten().to_numpy().reshape(-1, d))
            at = np.minimum((margin + EDGE) / (2 * EDGE) * BINS, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.int32()), pa.array(at)], ["y", "at"])

    bins = np.zeros((2, BINS))
    for r in training.mapInArrow(binned, "y int, at int").groupBy("y", "at").count().collect():  # at most 2 BINS rows
        bins[r["y"], r["at"]] = r["count"]
    return calibrated(model, bins)


def calibrated(model: Model, bins: np.ndarray) -> Model:
    """The model with a logistic curve fitted to the binned margins by Newton steps, each class with one row more at either end."""
    middle = (np.arange(BINS) + 0.5) / BINS * 2 * EDGE - EDGE
    bins = bins.copy()
    bins[:, 0] += 1
    bins[:, -1] += 1
    total, ones = bins.sum(axis=0), bins[1]

    def loss(w: np.ndarray) -> float:
        at = w[0] * middle + w[1]
        return float((total * np.logaddexp(0, at) - ones * at).sum())

    w = np.array([0.1, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(w[0] * middle + w[1])))
        rest, curve = ones - total * p, total * p * (1 - p)
        h = np.array([[(curve * middle * middle).sum(), (curve * middle).sum()], [(curve * middle).sum(), curve.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, [(rest * middle).sum(), rest.sum()])
        share = 1.0
        while share > 1e-9 and loss(w + share * step) > loss(w):  # a whole Newton step may go too far
            share /= 2
        w = w + share * step
        if np.abs(share * step).max() < 1e-12:
            break
    model.slope, model.shift = max(1e-3, float(w[0])), float(w[1])
    return model


def _scorer(model: Model | float):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            score = np.full(len(x), model) if isinstance(model, float) else model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return scored


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Learns from labelled rows whose crc32(doc_id as text) mod folds isn't 0, by the text's statistics alone. Labels other
    than 0 and 1 are passed over; of an id labelled both ways both count. Null and empty texts are scored like any other. A
    null id is scored, never learned from, and not held out. Without labels of both kinds every score is the same. Repeated rows
    are scored each, and learned from each if labelled. Other columns of either table play no part.
    """
    table = written(document_features(docs), "features")
    part = F.crc32(F.col("doc_id").cast("string")) % folds
    known = picked(labels, doc_id="doc_id", quality="quality").select("doc_id", F.col("quality").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (part != 0)).distinct()
    model = fitted(written(table.join(known, "doc_id").select("x", "y"), "training"))
    scored = table.mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quadratic_discriminant(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
