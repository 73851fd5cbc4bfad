"""Benchmark passages in documents: CGK embedding, bit sampling, exact edit distance.

The CGK random walk reads a sequence with a coin for each step and symbol: heads
move on, tails stay.  Sequences a few edits apart soon walk in step again, so
their embeddings agree in most places; keys of a few sampled places meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcat.llm.common import HashIndex, as_texts, bytes_of, lowered, mixed, sent, shipped, slices, span_hashes, tidied, word_spans

EDITS = 0.2  # words of an item that may be inserted, deleted or replaced, as a share of its words
LEAST_WORDS = 4  # shorter items are ordinary phrases: found where they stand word for word, and no reason to drop a document
PLACES = 3  # places of the embedding in one key
RECALL = 0.99  # that the keys reach on copies of the items themselves with as many edits as are allowed
MOST_KEYS = 96  # where these don't reach it, word pairs are counted instead, which loses nothing
PIECE_WORDS = 64  # longer items are looked for by pieces of at most as many words
TRIED = 480  # edited copies that the recall of a size is measured on
BLOCK_ITEMS = 20_000  # items that one pass over the documents looks for
BLOCK_BYTES = 8 << 20  # of their texts, about

# Letters, digits and all bytes of other scripts belong to a word.
_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False


def _unspaced(data: np.ndarray) -> np.ndarray:
    """First bytes of characters of scripts that put no spaces between words: Thai to Lao, Burmese, Khmer, Japanese, Chinese."""
    lead = np.flatnonzero((data[:-2] == 0xE0) | (data[:-2] == 0xE1) | (data[:-2] >= 0xE3) & (data[:-2] <= 0xE9)) if len(data) > 2 else np.zeros(0, np.int64)
    first, second = data[lead], data[lead + 1]
    thai, burmese, khmer = (first == 0xE0) & (second >= 0xB8) & (second <= 0xBB), (first == 0xE1) & (second <= 0x82), (first == 0xE1) & (second >= 0x9E) & (second <= 0x9F)
    return lead[(first >= 0xE3) | thai | burmese | khmer]


def _symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word; in unspaced scripts every character is one."""
    start, end, doc = word_spans(data, bounds, _APART)
    lead = _unspaced(data)
    if not len(lead) or not len(start):
        return start, end, doc
    cut = np.unique(np.concatenate([lead, lead + 3]))
    run = np.searchsorted(start, cut, "right") - 1
    cut = cut[(run >= 0) & (cut > start[run]) & (cut < end[run])]
    parts = np.sort(np.concatenate([start, cut]))
    run = np.searchsorted(start, parts, "right") - 1
    return parts, np.minimum(end[run], np.append(parts[1:], len(data))), doc[run]


def words_and_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word without punctuation; bounds of the documents among them."""
    start, end, doc = _symbols(data, bounds)
    count = np.bincount(doc, minlength=len(bounds) - 1)
    return span_hashes(lowered(data), start, end), np.concatenate([[0], np.cumsum(count)])


def _pairs(words: np.ndarray) -> np.ndarray:
    return mixed(words[:-1] * np.uint64(0x9FB21C651E98DF25) + words[1:]) if len(words) > 1 else np.zeros(0, np.uint64)


def walk_keys(words: np.ndarray, start: np.ndarray, end: np.ndarray, coins: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys of the sequences words[start:end]: repetitions x sequences.

    ``coins`` has an odd number for each repetition and step; ``places`` the
    sampled steps of each repetition, in order.
    """
    at = np.repeat(start[None, :], len(coins), 0)
    key = np.repeat(np.arange(1, len(coins) + 1, dtype=np.uint64)[:, None], len(start), 1)
    padded = np.append(words, np.uint64(0))
    for step in range(coins.shape[1]):
        inside = at < end
        symbol = np.where(inside, padded[np.minimum(at, len(words))], np.uint64(0))
        for row in np.flatnonzero((places == step).any(1)):
            key[row] = mixed(key[row] ^ symbol[row])
        at += inside & ((symbol * coins[:, step][:, None]) >> np.uint64(63)).astype(bool)
    return key


def edit_distance(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edits that turn the item into some part of the text, and where that part ends (Myers' bit vectors)."""
    size = len(item)
    full, top = (1 << size) - 1, 1 << (size - 1)
    seen: dict[int, int] = {}
    for i, word in enumerate(item):
        seen[word] = seen.get(word, 0) | 1 << i
    up, down, score, best, where = full, 0, size, size, 0
    for i, word in enumerate(text):
        eq = seen.get(word, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(xh | up) & full, up & xh
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | ~(xv | plus) & full, plus & xv
        if score < best:
            best, where = score, i + 1
    return best, where


@dataclass
class SizeClass:
    """Pieces of similar length and their keys; their word pairs where no number of keys reaches RECALL."""

    span: int  # words that hold any match of a piece
    need: int  # word pairs of the benchmark in such a span
    coins: np.ndarray
    places: np.ndarray
    exact: bool
    index: HashIndex
    heads: np.ndarray
    owners: np.ndarray  # pieces of each key


@dataclass
class Matcher:
    """All that a task needs to look for one block of items."""

    ids: list[int]
    words: np.ndarray
    bounds: np.ndarray
    pairs: HashIndex
    classes: list[SizeClass]
    piece_item: np.ndarray
    piece_offset: np.ndarray  # of a piece in its item
    reach: np.ndarray  # words of an item that hold any match of it
    slack: np.ndarray  # words that a match may start before a hit, beyond the edits
    short: list[tuple[int, HashIndex, np.ndarray, np.ndarray]]  # items of each size below LEAST_WORDS, by their whole sequence


def _edited(rng: np.random.Generator, words: np.ndarray, edits: int) -> np.ndarray:
    out = list(words)
    for _ in range(edits):
        kind, i = rng.integers(3), rng.integers(max(len(out), 1))
        new = np.uint64(rng.integers(1 << 62))
        if kind == 0 and out:
            out[min(i, len(out) - 1)] = new
        elif kind == 1 and len(out) > 1:
            del out[min(i, len(out) - 1)]
        else:
            out.insert(i, new)
    return np.array(out, np.uint64)


def _pieces(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, offset and words of the pieces of all items, of nearly equal length within an item.

    Whatever the edits of a copy, one of its pieces has no more than its share of them.
    """
    n = -(-size // PIECE_WORDS)
    item = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(item)) - (np.cumsum(n) - n)[item]
    low, high = k * size[item] // n[item], (k + 1) * size[item] // n[item]
    return item, low, high - low


def _grouped(keys: np.ndarray, owners: np.ndarray) -> tuple[HashIndex, np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    distinct, first = np.unique(keys[order], return_index=True)
    return HashIndex(distinct), np.append(first, len(keys)), owners[order]


def _flat(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _reached(rng: np.random.Generator, words: np.ndarray, start: np.ndarray, size: np.ndarray, coins: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Share of copies with all edits that are allowed, in other text, that the first 1, 2, ... keys find."""
    tried = rng.permutation(len(start))[:TRIED]
    tried = np.repeat(tried, -(-TRIED // len(tried)))
    copies = []
    for i in tried:
        after = rng.integers(0, 1 << 63, coins.shape[1], dtype=np.uint64)
        copies.append(np.concatenate([_edited(rng, words[start[i] : start[i] + size[i]], int(size[i] * EDITS)), after]))
    ends = np.cumsum([len(c) for c in copies])
    ours = walk_keys(words, start[tried], start[tried] + size[tried], coins, places)
    theirs = walk_keys(np.concatenate(copies), ends - [len(c) for c in copies], ends, coins, places)
    return np.maximum.accumulate(ours == theirs, 0).mean(1)


def build_matcher(ids: list[int], texts: list[str], seed: int = 3) -> Matcher:
    """Keys of all items; as many repetitions as reach RECALL on copies of the pieces of a class with all allowed edits."""
    words, bounds = words_and_bounds(*bytes_of(as_texts(pa.array(texts, pa.large_string()))))
    size = np.diff(bounds)
    rng = np.random.default_rng(seed)
    inner = np.ones(max(len(words) - 1, 0), bool)
    inner[bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(words))] - 1] = False
    all_pairs = _pairs(words)
    pairs = np.unique(all_pairs[inner])
    piece_item, piece_offset, piece_size = _pieces(size)
    piece_start = bounds[piece_item] + piece_offset
    reach, slack = size + (size * EDITS).astype(np.int64), np.zeros(len(size), np.int64)
    classes, low = [], LEAST_WORDS
    while piece_size.size and low <= piece_size.max():
        high = max(low + 1, int(low * 1.25))
        chosen = np.flatnonzero((piece_size >= low) & (piece_size < high))
        if len(chosen):
            start, count, item = piece_start[chosen], piece_size[chosen], piece_item[chosen]
            # An edit breaks two pairs at most, so a match keeps this many, whatever the piece of the class.
            need = min(int(m - 1 - 2 * int(m * EDITS)) for m in range(low, high))
            span = max(m + int(m * EDITS) for m in range(low, high))
            steps = 2 * low
            coins = rng.integers(0, 1 << 63, (MOST_KEYS, steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            places = np.sort(np.stack([rng.choice(steps, PLACES, False) for _ in range(MOST_KEYS)]), 1)
            reached = _reached(rng, words, start, count, coins, places) >= RECALL
            exact = not reached.any()
            used = 0 if exact else int(np.argmax(reached)) + 1
            if exact:
                owners = np.repeat(chosen, count - 1)
                keys = all_pairs[_flat(start, count - 1)]
                _, once = np.unique(np.stack([keys, owners.astype(np.uint64)]), axis=1, return_index=True)
                keys, owners = keys[once], owners[once]
                slack[item] = np.maximum(slack[item], span)
            else:
                keys = walk_keys(words, start, start + count, coins[:used], places[:used]).ravel()
                owners = np.tile(chosen, used)
            whole = item[size[item] == count]
            reach[whole] = span
            classes.append(SizeClass(span, max(need, 1), coins[:used], places[:used], exact, *_grouped(keys, owners)))
        low = high
    short = []
    for n in range(1, LEAST_WORDS):
        owners = np.flatnonzero(size == n)
        if len(owners):
            short.append((n, *_grouped(_sequences(words, n)[bounds[owners]], owners)))
    return Matcher(ids, words, bounds, HashIndex(pairs), classes, piece_item, piece_offset, reach, slack, short)


def _sequences(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on."""
    out = words[: max(len(words) - n + 1, 0)]
    for k in range(1, n):
        out = mixed(out * np.uint64(0x9FB21C651E98DF25) + words[k : k + len(out)])
    return out


def _short_matches(matcher: Matcher, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """The same as ``matches`` for items that are too short to allow an edit: the first place in each document."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for n, index, heads, owners in matcher.short:
        place = index.find(_sequences(words, n))
        at = np.flatnonzero(place >= 0)
        at = at[at + n <= bounds[1:][doc[at]]]
        _, once = np.unique(np.stack([doc[at], place[at]]), axis=1, return_index=True)
        for i in at[once]:
            for item in owners[heads[place[i]] : heads[place[i] + 1]]:
                yield int(doc[i]), int(item), 0, int(i - bounds[doc[i]])


def _met(kind: SizeClass, words: np.ndarray, ends: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Starts whose keys meet those of pieces, and these."""
    for low in range(0, len(start), 4096):
        part = start[low : low + 4096]
        place = kind.index.find(walk_keys(words, part, ends[part], kind.coins, kind.places).ravel())
        for flat in np.flatnonzero(place >= 0):
            yield int(part[flat % len(part)]), np.unique(kind.owners[kind.heads[place[flat]] : kind.heads[place[flat] + 1]])


PAIR_ROWS = 1 << 22  # occurrences of pairs that are counted at once, about


def _counted(kind: SizeClass, pairs: np.ndarray, doc: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The same for classes without keys: the first of as many pairs of a piece as any match has."""
    at = np.flatnonzero(hit)
    place = kind.index.find(pairs[at])
    at, place = at[place >= 0], place[place >= 0]
    n = kind.heads[place + 1] - kind.heads[place]
    low, sums = 0, np.cumsum(n)
    while low < len(at):
        # Whole documents; a longer one passes whole.
        high = int(np.searchsorted(sums, (sums[low - 1] if low else 0) + PAIR_ROWS, "right"))
        last = doc[at[min(high, len(at) - 1)]] if high < len(at) else doc[at[-1]] + 1
        high = int(np.searchsorted(doc[at], last))
        high = high if high > low else int(np.searchsorted(doc[at], doc[at[low]], "right"))
        position = np.repeat(at[low:high], n[low:high])
        piece = kind.owners[_flat(kind.heads[place[low:high]], n[low:high])]
        order = np.lexsort((position, piece))
        position, piece = position[order], piece[order]
        i = np.arange(len(position) - kind.need + 1)
        j = i + kind.need - 1
        found = (piece[i] == piece[j]) & (position[j] - position[i] < kind.span) & (doc[position[i]] == doc[position[j]])
        for k in np.flatnonzero(found):
            yield int(position[k]), piece[k : k + 1]
        low = high


def matches(matcher: Matcher, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Document, item, edits and first word of each match; one for each pair of document and item."""
    yield from _short_matches(matcher, words, bounds)
    if len(words) < 2:
        return
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pairs = _pairs(words)
    hit = np.zeros(len(words), bool)
    hit[:-1] = matcher.pairs.find(pairs) >= 0
    hit[:-1] &= doc[1:] == doc[:-1]
    if not hit.any():
        return
    sums = np.concatenate([[0], np.cumsum(hit)])
    ends = bounds[1:][doc]
    done: dict[tuple[int, int], set[int]] = {}
    for kind in matcher.classes:
        if kind.exact:
            met = _counted(kind, pairs, doc, hit)
        else:
            stop = np.minimum(np.arange(len(words)) + kind.span, ends)
            met = _met(kind, words, ends, np.flatnonzero(sums[stop] - sums[:-1] >= kind.need))
        for begin, owners in met:
            for piece in owners:
                item = int(matcher.piece_item[piece])
                done.setdefault((int(doc[begin]), item), set()).add(begin - int(matcher.piece_offset[piece]))
    for (d, item), found in sorted(done.items()):
        own = matcher.words[matcher.bounds[item] : matcher.bounds[item + 1]].tolist()
        allowed, best, checked = int(len(own) * EDITS), None, None
        span, slack = int(matcher.reach[item]), int(matcher.slack[item])
        for begin in sorted(found):
            if checked is not None and begin < checked:
                continue
            low = max(begin - allowed - slack, int(bounds[d]))
            high = min(begin + 2 * span + allowed, int(bounds[d + 1]))
            edits, last = edit_distance(own, words[low:high].tolist())
            # Starts up to half an item further lie in the part just read.
            checked = begin + span // 2
            if edits <= allowed and (best is None or edits < best[0]):
                best = (edits, max(low + last - len(own) - int(bounds[d]), 0))
        if best is not None:
            yield d, item, *best


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, first_word, item_words of each benchmark item found in a document.

    Words are lower-cased and without punctuation.  An item is found where some
    part of the whole text is at most EDITS of its words away.  Candidates are
    starts whose next words hold as many word pairs of the benchmark as any match
    must; their keys are looked up among the keys of the items, or of the pieces of
    long ones, and what meets is verified exactly.  Where a size has no keys that
    reach RECALL, the word pairs of each piece are counted instead.  A pair of
    document and item stands once, with the fewest edits.  In scripts without spaces every
    character is a word.  Items of fewer than LEAST_WORDS words (``item_words`` tells them)
    are found where they stand word for word.  Null and empty texts, and items without a
    word, match nothing; repeated rows are one; ids may be null.  Items are sent to the tasks
    in blocks of about BLOCK_ITEMS or BLOCK_BYTES, one pass over the documents each.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).where("text is not null")
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_blocks = max(-(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = []
    for block in range(n_blocks):
        chosen = items.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == block).collect()
        ids = [r["item_id"] for r in chosen]
        matcher = shipped(spark, build_matcher(ids, [r["text"] for r in chosen]))

        def find(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            known = matcher()
            for batch in batches:
                for part, data, bounds in slices(batch):
                    words, ends = words_and_bounds(data, bounds)
                    rows = list(matches(known, words, ends))
                    if rows:
                        at = [r[1] for r in rows]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": part.column("doc_id").take(pa.array([r[0] for r in rows])),
                                "item_id": pa.array([known.ids[i] for i in at], pa.int64()),
                                "edits": pa.array([r[2] for r in rows], pa.int64()),
                                "first_word": pa.array([r[3] for r in rows], pa.int64()),
                                "item_words": pa.array([int(known.bounds[i + 1] - known.bounds[i]) for i in at], pa.int64()),
                            }
                        )

        schema = f"doc_id {kind}, item_id long, edits long, first_word long, item_words long"
        parts.append(docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(tidied(find), schema))
    if not parts:
        return spark.createDataFrame([], f"doc_id {kind}, item_id long, edits long, first_word long, item_words long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    least = F.min(F.struct("edits", "first_word", "item_words")).alias("least")
    return found.groupBy("doc_id", "item_id").agg(least).select("doc_id", "item_id", "least.*")


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all columns, in which no item of LEAST_WORDS words or more is found.  Rows with a null id are kept."""
    bad = contaminated(docs, items).where(F.col("item_words") >= LEAST_WORDS).select(F.col("doc_id").alias("cd__id")).distinct()
    return docs.join(sent(bad), F.col("doc_id") == F.col("cd__id"), "left_anti")
