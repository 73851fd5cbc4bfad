"""Toxicity by class-conditional Kneser-Ney models over words and their stems."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcat.llm.common import HashIndex, as_texts, bytes_of, hashed_sample, lowered, mixed, slices, span_hashes, stored, tidied, word_spans

TRAIN_DOCS = 3000  # bound of labelled documents of each class that are learned from
DISCOUNT = 2.0  # taken from every count: an expression that stands in two documents of a class or fewer has no weight of its own
STEMS = (4, 5, 7)  # bytes of a word's stems
_CALIBRATE = 4  # one labelled document in so many sets the scale of the score, the others the counts

# Letters, digits and all bytes of other scripts belong to a word.
_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct lower-cased words of each document: hashes from the shortest stem to the word, and the document."""
    start, end, doc = word_spans(data, bounds, _APART)
    data = lowered(data)
    words = span_hashes(data, start, end)
    _, first = np.unique(mixed(words ^ mixed(doc.astype(np.uint64) + np.uint64(1))), return_index=True)
    first.sort()
    start, end, doc = start[first], end[first], doc[first]
    return [*(_stems(data, start, end, k) for k in STEMS), words[first]], doc


def _stems(data: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    return span_hashes(data, start, np.minimum(end, start + size))


@dataclass
class ClassModels:
    """Two Kneser-Ney models (ordinary, toxic) over the same units, and the scale of the score."""

    units: list[HashIndex]  # stems, the shortest first, and words
    chance: list[np.ndarray]  # 2 x (units + 1) each; the last where the unit is unknown
    left: np.ndarray  # 2 x levels: mass that a level leaves to the one below
    scale: np.ndarray
    prior: float


def count_models(levels: list[np.ndarray], doc: np.ndarray, labels: np.ndarray) -> ClassModels:
    """Interpolated Kneser-Ney models of both classes.

    A unit's count is the number of contexts, here documents, that it stands in.
    What is discounted goes to the next shorter stem, and at the shortest to the
    counts of both classes together, so an expression that is rare in one class
    is judged by what it shares with others.
    """
    units, chance, left = [], [], np.ones((2, len(levels)))
    below = keys_below = None
    for level, hashes in enumerate(levels):
        keys, unit = np.unique(hashes, return_inverse=True)
        stands = np.unique(unit * len(labels) + doc)
        label = labels[stands % len(labels)]
        n = [np.bincount(stands[label == c] // len(labels), minlength=len(keys)).astype(float) for c in (0, 1)]
        both = n[0] + n[1] + 0.5
        if level == 0:
            share = np.append(both, 0.5) / (both.sum() + 0.5)
            under = np.stack([share, share])
        else:
            # A unit's share of its stem, the same for both classes, times the stem's chance.
            stem = np.zeros(len(keys), np.int64)
            stem[unit] = below
            share = both / (np.bincount(stem, both, keys_below) + 0.5)[stem]
            under = np.stack([np.append(share * chance[-1][c][stem], 0) for c in (0, 1)])
        p = np.empty((2, len(keys) + 1))
        for c in (0, 1):
            total = max(n[c].sum(), 1.0)
            if n[c].any():
                left[c, level] = np.minimum(n[c], DISCOUNT).sum() / total
            p[c] = np.append(np.maximum(n[c] - DISCOUNT, 0) / total, 0) + left[c, level] * under[c]
        units.append(HashIndex(keys))
        chance.append(p)
        below, keys_below = unit, len(keys)
    return ClassModels(units, chance, left, np.zeros(0), 0.5)


def token_evidence(model: ClassModels, levels: list[np.ndarray]) -> np.ndarray:
    """Log odds of each word, toxic against ordinary."""
    place = model.units[-1].find(levels[-1])
    missing = np.flatnonzero(place < 0)
    base = np.stack([model.chance[-1][c].take(place) for c in (0, 1)])
    # Unknown words: the longest known stem; shares within a stem cancel out.
    passed = model.left[:, -1].copy()
    for level in range(len(levels) - 2, -1, -1):
        if not len(missing):
            break
        at = model.units[level].find(levels[level][missing])
        hit = (at >= 0) if level else np.ones(len(at), bool)
        base[:, missing[hit]] = passed[:, None] * model.chance[level][:, at[hit]]
        missing = missing[~hit]
        passed *= model.left[:, level]
    return np.log(base[1] / base[0])


def features(model: ClassModels, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: 1, log-likelihood ratios by length and by its root, whole and above 1 per word, the largest; and the number of words."""
    levels, doc = tokens(data, bounds)
    n_docs = len(bounds) - 1
    n = np.bincount(doc, minlength=n_docs)
    evidence = token_evidence(model, levels)
    some, root = np.maximum(n, 1), np.sqrt(np.maximum(n, 1))
    whole = np.bincount(doc, evidence, n_docs)
    strong = np.bincount(doc, np.maximum(evidence - 1, 0), n_docs)
    top = np.zeros(n_docs)
    np.maximum.at(top, doc, evidence)
    return np.stack([np.ones(n_docs), 10 * whole / some, whole / root, 10 * strong / some, strong / root, top], 1), n


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps on the penalised likelihood; the first column is not penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> ClassModels | None:
    """Models from the texts of docs (doc_id, text) and labels (doc_id, toxic).

    At most ``bound`` labelled documents of each class are read, by a hash of the
    id; their ids, not the texts of all documents, are joined.  Rows without a
    label are left out.  None if a class has no document.
    """
    labels = labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = dict.fromkeys((0, 1), 0) | {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    drawn = [hashed_sample(labels.where(F.col("toxic") == c), bound, "toxicity", counts[c]) for c in (0, 1)]
    few = stored(drawn[0].unionByName(drawn[1]), "toxicity_labels")
    place = F.xxhash64(F.lit("calibrate"), F.col("doc_id").cast("string"))
    rows = docs.join(F.broadcast(few), "doc_id").select("text", "toxic", place.alias("u")).collect()
    rows.sort(key=lambda r: (r["toxic"], r["u"], r["text"] or ""))
    label, turn = np.array([r["toxic"] for r in rows], int), np.array([r["u"] for r in rows], np.int64)
    aside = turn % _CALIBRATE == 0
    if len(np.unique(label[aside])) < 2 or len(np.unique(label[~aside])) < 2:
        aside = np.zeros(len(label), bool)

    def part(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return bytes_of(as_texts(pa.array([r["text"] for r, m in zip(rows, mask) if m], pa.large_string())))

    levels, doc = tokens(*part(~aside))
    if len(np.unique(label)) < 2 or not len(doc):
        return None
    model = count_models(levels, doc, label[~aside])
    scaled = aside if aside.any() else ~aside
    x, _ = features(model, *part(scaled))
    y = label[scaled].astype(float)
    model.scale = _logistic(x, y)
    # The classes were drawn by themselves: set the odds back to those of all labelled rows.
    model.prior = counts[1] / max(counts[0] + counts[1], 1)
    model.scale[0] += np.log(max(counts[1], 1) / max(counts[0], 1)) - np.log(max(y.sum(), 1) / max((1 - y).sum(), 1))
    return model


def score_toxicity(docs: DataFrame, model: ClassModels | None) -> DataFrame:
    """All columns of the documents with toxicity, from 0 to 1, and toxicity_words.

    Texts that are null or have no word get the share of toxic labels among the
    learned rows.  Without a model every score is 0.  Whole texts are read;
    repeated rows score alike; columns of these names are replaced.
    """
    docs = docs.drop("toxicity", "toxicity_words")
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "toxicity double, toxicity_words long"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in slices(batch):
                if model is None:
                    value, n = np.zeros(part.num_rows), np.zeros(part.num_rows, np.int64)
                else:
                    x, n = features(model, data, bounds)
                    value = np.where(n > 0, 1 / (1 + np.exp(-np.clip(x @ model.scale, -30, 30))), model.prior)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(value), pa.array(n.astype(np.int64))], [*names, "toxicity", "toxicity_words"])

    return docs.mapInArrow(tidied(score), schema)
