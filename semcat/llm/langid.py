"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcat.llm.common import bound_batches, free_name, slices, tidied

WINDOW = 64  # bytes that one run of the network sees
HIDDEN = 8  # units of each direction
TRAIN_WINDOWS = 4096  # bound of the training sample, shared out over the languages
WINDOWS_PER_DOC = 4
_ROWS = 1024  # windows of one numpy step; its state stays in the processor's cache

_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[65:91] = _LETTER_BYTE[97:123] = _LETTER_BYTE[128:] = True


@dataclass
class ByteTagger:
    """Weights; index 0 of each pair reads forward, index 1 backward."""

    languages: list[str]
    gates_in: np.ndarray  # 2 x 256 x 2H, update and reset gate
    state_in: np.ndarray  # 2 x 256 x H
    gates: np.ndarray  # 2 x H x 2H
    state: np.ndarray  # 2 x H x H
    out: np.ndarray  # 2H x languages
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.gates_in, self.state_in, self.gates, self.state, self.out, self.bias]


def new_tagger(languages: list[str], seed: int = 7) -> ByteTagger:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    h = HIDDEN
    return ByteTagger(
        languages,
        draw(2, 256, 2 * h, scale=0.3), draw(2, 256, h, scale=0.5),
        draw(2, h, 2 * h, scale=0.3), draw(2, h, h, scale=0.3),
        draw(2 * h, len(languages), scale=0.3), np.zeros(len(languages), np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _states(model: ByteTagger, windows: np.ndarray, tape: list | None = None) -> np.ndarray:
    """Hidden states at every position: T x B x 2H.  With a tape, what the way back needs."""
    rows, length = windows.shape
    out = np.empty((length, rows, 2 * HIDDEN), np.float32)
    columns = np.ascontiguousarray(windows.T)
    for way, order in ((0, range(length)), (1, range(length - 1, -1, -1))):
        h = np.zeros((rows, HIDDEN), np.float32)
        for t in order:
            byte = columns[t]
            gate = model.gates_in[way].take(byte, 0)
            gate += h @ model.gates[way]
            gate = _sigmoid(gate)
            update, reset = gate[:, :HIDDEN], gate[:, HIDDEN:]
            inner = h @ model.state[way]
            new = inner * reset
            new += model.state_in[way].take(byte, 0)
            np.tanh(new, out=new)
            if tape is not None:
                tape.append((way, t, byte, h, gate, inner, new))
            h = new + update * (h - new)
            out[t, :, way * HIDDEN : (way + 1) * HIDDEN] = h
    return out


def position_probabilities(model: ByteTagger, windows: np.ndarray, tape: list | None = None, states: list | None = None) -> np.ndarray:
    """Probability of each language at each position: T x B x languages."""
    hidden = _states(model, windows, tape)
    if states is not None:
        states.append(hidden)
    logits = hidden.reshape(-1, 2 * HIDDEN) @ model.out
    logits += model.bias
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits.reshape(*hidden.shape[:2], -1)


def _gradients(model: ByteTagger, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy over the letters of a batch, by backpropagation through time."""
    tape, kept = [], []
    prob = position_probabilities(model, windows, tape, kept)
    weight = _LETTER_BYTE[windows].T.astype(np.float32)
    weight /= max(weight.sum(), 1)
    prob[:, np.arange(len(labels)), labels] -= 1
    prob *= weight[:, :, None]
    flat, hidden = prob.reshape(-1, prob.shape[2]), kept[0]
    grads = [np.zeros_like(part) for part in model.parts()]
    grads[4] = hidden.reshape(-1, 2 * HIDDEN).T @ flat
    grads[5] = flat.sum(0)
    back = (flat @ model.out.T).reshape(hidden.shape)
    carry, seen = np.zeros((len(labels), HIDDEN), np.float32), None
    for way, t, byte, before, gate, inner, new in reversed(tape):
        if way != seen:
            carry, seen = np.zeros_like(carry), way
        update, reset = gate[:, :HIDDEN], gate[:, HIDDEN:]
        d = carry + back[t, :, way * HIDDEN : (way + 1) * HIDDEN]
        d_new = d * (1 - update) * (1 - new * new)
        d_gate = np.concatenate([d * (before - new), d_new * inner], 1) * gate * (1 - gate)
        d_inner = d_new * reset
        np.add.at(grads[0][way], byte, d_gate)
        np.add.at(grads[1][way], byte, d_new)
        grads[2][way] += before.T @ d_gate
        grads[3][way] += before.T @ d_inner
        carry = d * update + d_gate @ model.gates[way].T + d_inner @ model.state[way].T
    return grads


def train(windows: np.ndarray, labels: list[str], epochs: int = 8, batch: int = 256, rate: float = 0.02, least_steps: int = 200) -> ByteTagger:
    """Adam over shuffled batches; the same sample gives the same network.  Small samples are gone through more often."""
    languages = sorted(set(labels))
    model = new_tagger(languages)
    target = np.searchsorted(np.array(languages), np.array(labels))
    rng = np.random.default_rng(11)
    parts = model.parts()
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    batches = -(-len(labels) // batch)
    epochs = max(epochs, -(-least_steps // batches))
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for low in range(0, len(labels), batch):
            chosen = order[low : low + batch]
            step += 1
            pace = rate * (1 - 0.9 * step / steps)
            for p, m, v, g in zip(parts, first, second, _gradients(model, windows[chosen], target[chosen])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def cut(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of all documents as windows: rows of bytes, their lengths, their documents."""
    sizes = np.diff(bounds)
    count = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[doc] + at * WINDOW
    length = np.minimum(WINDOW, bounds[doc + 1] - start)
    place = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < length[:, None]
    return np.where(inside, data[np.minimum(place, max(len(data) - 1, 0))], 0).astype(np.uint8), length, doc


def document_probabilities(model: ByteTagger, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean of the probabilities at the letters of each document; without a letter, zeros."""
    windows, _, doc = cut(data, bounds)
    total = np.zeros((len(bounds) - 1, len(model.languages)))
    letters = np.zeros(len(bounds) - 1)
    for low in range(0, len(doc), _ROWS):
        part = windows[low : low + _ROWS]
        weight = _LETTER_BYTE[part].astype(np.float32)
        # Whole 64-byte windows without a letter are not run.
        live = np.flatnonzero(weight.any(1))
        if not len(live):
            continue
        prob = position_probabilities(model, part[live])
        pooled = np.einsum("tbl,bt->bl", prob, weight[live])
        np.add.at(total, doc[low : low + _ROWS][live], pooled)
        np.add.at(letters, doc[low : low + _ROWS][live], weight[live].sum(1))
    return total / np.maximum(letters, 1)[:, None]


def training_windows(docs: DataFrame, bound: int = TRAIN_WINDOWS) -> tuple[np.ndarray, list[str]]:
    """At most ``bound`` windows of labelled documents, in about equal shares of the languages.

    ``docs`` has doc_id, text, lang.  Documents are chosen by a hash of the id,
    windows evenly over the whole text.
    """
    labelled = docs.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), []
    share = max(bound // len(counts), 1)
    keep = F.lit(False)
    for lang, n in counts.items():
        keep |= (F.col("lang") == lang) & (F.col("_u") < min(1.0, 2.0 * share / WINDOWS_PER_DOC / n))
    place = F.xxhash64(F.lit("langid"), F.col("doc_id").cast("string"))
    chosen = labelled.withColumn("_u", F.pmod(place, F.lit(1 << 20)) / F.lit(1 << 20)).where(keep)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in slices(batch):
                rows, length, doc = cut(data, bounds)
                count = np.bincount(doc, minlength=part.num_rows)
                rank = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                step = np.maximum(count[doc] // WINDOWS_PER_DOC, 1)
                good = np.flatnonzero((rank % step == 0) & (rank // step < WINDOWS_PER_DOC) & _LETTER_BYTE[rows].any(1))
                if len(good):
                    ids = pa.array(doc[good])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("lang").take(ids).cast(pa.string()), pa.array([rows[i].tobytes() for i in good], pa.binary()), part.column("_u").take(ids), pa.array(rank[good])],
                        ["lang", "window", "u", "rank"],
                    )

    found = chosen.select("lang", "text", "_u").mapInArrow(tidied(windows), "lang string, window binary, u double, rank long")
    rows = found.orderBy("u", "rank", "lang", "window").limit(2 * bound).collect()
    taken, left = [], dict.fromkeys(counts, share)
    for row in rows:
        if left[row["lang"]] > 0:
            left[row["lang"]] -= 1
            taken.append(row)
    return np.stack([np.frombuffer(r["window"], np.uint8) for r in taken]) if taken else np.zeros((0, WINDOW), np.uint8), [r["lang"] for r in taken]


def fit_tagger(docs: DataFrame, bound: int = TRAIN_WINDOWS) -> ByteTagger | None:
    windows, labels = training_windows(docs, bound)
    return train(windows, labels) if labels else None


def identify(docs: DataFrame, model: ByteTagger | None) -> DataFrame:
    """All columns of the documents with lang_pred and lang_score.

    Every byte of every text is labelled, in windows of 64 bytes; the document
    gets the language with the largest mean probability over its letters, and
    that mean as its score.  A text that is null or has no letter is ``und``
    with score 0; so is every text without a trained model.  Repeated rows are
    scored alike; a tie goes to the language first in code-point order.  Columns
    of the input named lang_pred or lang_score are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score")
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, lang_score double"])
    bound_batches(docs.sparkSession)
    hidden = free_name(docs, "letters")
    flagged = docs.withColumn(hidden, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in slices(batch):
                known = part.column(hidden).to_numpy(zero_copy_only=False)
                pred, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                if model is not None:
                    prob = document_probabilities(model, data, bounds)
                    best = prob.argmax(1)
                    score = np.where(known, np.clip(prob[np.arange(len(best)), best], 0, 1), 0.0)
                    pred = np.where(known, np.array(model.languages, object)[best], "und")
                columns = [part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score)], [*names, "lang_pred", "lang_score"])

    return flagged.mapInArrow(tidied(label), schema)
