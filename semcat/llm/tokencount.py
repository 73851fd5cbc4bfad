"""Token counts by a table of frequent pre-tokens and a cache in each worker."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from semcat.llm.common import as_texts, bytes_of, hashed_sample, slices, tidied

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SAMPLE_DOCS = 2000  # bound of the documents that the frequent pre-tokens are found in
FREQUENT = 1 << 16  # pre-tokens in the table that every worker receives
CACHE = 1 << 19  # pre-tokens that a worker remembers besides; then it starts anew

# Fixed values of the tokenizer: contractions that its pattern splits off.
_SHORT, _LONG = "stmd", ("re", "ve", "ll")
_SPACE, _LETTER, _NUMBER, _OTHER, _RARE = range(5)
# Code points that are looked at here; a text with any other is left to the library.
_PLAIN = [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of each code point up to 0x20AC."""
    kind, lower = np.full(0x20AD, _RARE, np.uint8), np.arange(0x20AD, dtype=np.uint32)
    for code in _PLAIN:
        c, low = chr(code), chr(code).lower()
        if len(low) > 1 or ord(low) not in _PLAIN or unicodedata.normalize("NFC", c) != c:
            continue
        lower[code] = ord(low)
        kinds = (r"\p{White_Space}", r"\p{L}", r"\p{N}")
        kind[code] = next((k for k, p in enumerate(kinds) if regex.fullmatch(p, low)), _OTHER)
    return kind, lower


_KIND_OF, _LOWER_OF = _tables()


def pretokens(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces of the lower-cased texts, pre-tokens and white space, the document of each; documents left to the library.

    Of the last, the pieces mean nothing.
    """
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    at = heads[bounds]
    inside = np.minimum(codes, 0x20AC)
    kind = np.where(codes <= 0x20AC, _KIND_OF[inside], _RARE)
    rare = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(kind == _RARE, out=rare[1:])
    left = rare[at[1:]] > rare[at[:-1]]
    low = np.where(kind == _RARE, 0x20, _LOWER_OF[inside]).astype(np.uint32)

    opens = np.ones(len(codes) + 1, bool)
    opens[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    opens[at] = True
    ends = np.zeros(len(codes) + 3, bool)  # a match does not go past its text
    ends[at] = True
    tick = np.flatnonzero((low == ord("'")) & opens[:-1])
    after = np.concatenate([low, np.zeros(3, np.uint32)])
    one, two = after[tick + 1], after[tick + 2]
    inner = ~ends[tick + 1]
    short = inner & np.isin(one, [ord(c) for c in _SHORT])
    long = inner & ~ends[tick + 2] & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in _LONG])
    opens[tick[short] + 1] = False
    opens[tick[short] + 2] = True
    opens[tick[long & ~short] + 1] = False
    opens[tick[long & ~short] + 3] = True

    start = np.flatnonzero(opens)
    width = 1 + (low >= 0x80).astype(np.int64) + (low >= 0x800)
    place = np.zeros(len(low) + 1, np.int64)
    np.cumsum(width, out=place[1:])
    text = low.tobytes().decode("utf-32-le").encode()
    pieces = pa.LargeStringArray.from_buffers(len(start) - 1, pa.py_buffer(place[start]), pa.py_buffer(text))
    return pieces, np.searchsorted(at, start[:-1], "right") - 1, left


class Counts:
    """Tokens of pre-tokens: the frequent ones from the table, others encoded once and remembered."""

    def __init__(self, path: str, frequent: tuple[pa.Array, np.ndarray] | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.frequent = dict(zip(frequent[0].to_pylist(), frequent[1].tolist())) if frequent else {}
        self.seen: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def of_pieces(self, pieces: list[str]) -> np.ndarray:
        out = np.zeros(len(pieces), np.int64)
        missing = []
        for i, piece in enumerate(pieces):
            n = self.frequent.get(piece)
            if n is None:
                n = self.seen.get(piece)
            if n is None:
                if not piece or _KIND_OF[ord(piece[0])] == _SPACE:
                    n = 0
                else:
                    missing.append(i)
                    continue
            out[i] = n
        for low in range(0, len(missing), 4096):
            part = missing[low : low + 4096]
            counts = self.whole([pieces[i] for i in part])
            out[part] = counts
            if len(self.seen) > CACHE:
                self.seen.clear()
            self.seen.update((pieces[i], n) for i, n in zip(part, counts))
        return out

    def of_texts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        pieces, doc, left = pretokens(data, bounds)
        coded = pieces.dictionary_encode()
        counts = self.of_pieces(coded.dictionary.to_pylist())
        total = np.bincount(doc, counts[coded.indices.to_numpy()], len(bounds) - 1).astype(np.int64)
        raw = data.tobytes()
        # Special strings are found before anything is split.
        if any(s in raw for s in self.specials):
            for i in np.flatnonzero(~left):
                left[i] = any(s in raw[bounds[i] : bounds[i + 1]] for s in self.specials)
        for i in np.flatnonzero(left):
            total[i] = self.whole([raw[bounds[i] : bounds[i + 1]].decode()])[0]
        return total


def frequent_pretokens(docs: DataFrame, path: str, sample: int = SAMPLE_DOCS, size: int = FREQUENT) -> tuple[pa.Array, np.ndarray]:
    """The most frequent pre-tokens of a sample of whole documents and their token counts."""
    texts = [r["text"] or "" for r in hashed_sample(docs.select("doc_id", "text"), sample, "tokens").collect()]
    tally: Counter[str] = Counter()
    for low in range(0, len(texts), 200):
        pieces, doc, left = pretokens(*bytes_of(as_texts(pa.array(texts[low : low + 200], pa.large_string()))))
        kept = pieces.filter(pa.array(~left[doc]))
        for pair in kept.value_counts().to_pylist():
            tally[pair["values"]] += pair["counts"]
    chosen = [w for w, _ in sorted(tally.items(), key=lambda kv: (-kv[1], kv[0]))[:size]]
    return pa.array(chosen, pa.string()), Counts(path).of_pieces(chosen)


def count_tokens(docs: DataFrame, path: str = WORD_BPE) -> DataFrame:
    """All columns of the documents with n_tokens, as the library counts them, without added tokens.

    Whole texts are counted; null and empty texts have 0; repeated rows count
    alike; a column of this name is replaced.  Nothing is shuffled: every worker
    has the table of frequent pre-tokens and encodes what it lacks.
    """
    docs = docs.drop("n_tokens")
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_tokens long"])
    table = docs.sparkSession.sparkContext.broadcast(frequent_pretokens(docs, path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(path, table.value)
        for batch in batches:
            for part, data, bounds in slices(batch):
                total = counts.of_texts(data, bounds)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(total)], [*names, "n_tokens"])

    return docs.mapInArrow(tidied(count), schema)
