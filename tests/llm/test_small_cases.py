"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from semcat.llm import decontaminate, ngramjoin
from semcat.llm.common import as_texts, bytes_of
from semcat.llm.decontaminate import contaminated, edit_distance, without_contaminated
from semcat.llm.katz import backoff_weights, discounts, katz_scores
from semcat.llm.langid import fit_tagger, identify
from semcat.llm.mixing import mixed_documents, mixing_plan
from semcat.llm.neardup import similar_vectors
from semcat.llm.ngramjoin import near_copies
from semcat.llm.quality import document_statistics, fit_quality, isotonic, score_quality
from semcat.llm.suffixdedup import deduplicated, without_repeats
from semcat.llm.tokencount import WORD_BPE, Counts, count_tokens
from semcat.llm.toxicity import fit_toxicity, score_toxicity

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, taken string, k string, t string, "
    "ids string, lang_pred string, toxicity string, n_tokens string, node string, root string"
)
RNG = np.random.default_rng(4)
SYLLABLES = {"en": ["the", "and", "th", "ing", "er", "on"], "de": ["sch", "ung", "ich", "ein", "ü", "ß"]}


def prose(lang, n):
    return " ".join("".join(RNG.choice(SYLLABLES[lang], RNG.integers(1, 5))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, x, lang, s, len(x or ""), *["?"] * 11) for i, x, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    base = prose("en", 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    out = [(i, prose("en" if i % 2 else "de", 40 + i), "en" if i % 2 else "de", f"s{i % 3}") for i in range(24)]
    out += [(30, base, "en", "s0"), (31, near, "en", "s1"), (32, base, "en", None), (33, base, "en", None)]
    out += [(40, None, None, None), (41, "", "en", "s0"), (42, " \n\t ", "de", "s1"), (43, "%% 12 .", None, "s2"), (44, "Word", "en", "s2")]
    out += [(50, prose("de", 30_000), "de", "s0"), (51, "aaaa" * 200, "en", "s1"), (9, prose("en", 30), "en", "s0"), (30, base, "en", "s0")]
    out += [(None, prose("en", 50), "en", "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def words_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def test_mixing(docs, none, rows):
    out = mixing_plan(docs).toPandas()
    assert len(out) == len(rows) and mixing_plan(none).count() == 0
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(words_of(text))
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), sum(sizes.values())
    while True:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= 3 * sizes[s]
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    for s in order:
        mine = out[out.source.isna() if s is None else out.source == s]
        assert mine.source_size.eq(sizes[s]).all() and np.allclose(mine.target, target[s])
    assert (out.taken <= 3 * out["size"]).all() and (out.taken == out.copies * out["size"]).all()
    again = mixing_plan(docs.repartition(5)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(str, out[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    taken = mixed_documents(docs)
    assert taken.count() == out.copies.sum() and {"text", "copy"} <= set(taken.columns)


def test_mixing_comes_near(spark):
    many = table(spark, [(i, prose("en", int(RNG.integers(5, 60))), "en", f"s{i % 4}") for i in range(400)])
    out = mixing_plan(many).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).toPandas()
    assert (abs(out.taken - out.target) <= 0.01 * out.target + 2).all()


def test_near_copies_of_one_of_several_texts(spark, monkeypatch):
    # Any order of shingles gives the same links; here that of their hashes.
    monkeypatch.setattr(ngramjoin, "frequent_shingles", lambda docs, words: ngramjoin.ShingleOrder(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    rows = []
    for c in range(300):
        w = [f"c{c}w{k}" for k in range(200)]
        y, z = w[:100], w[:199] + ["other"]
        y[50], y[55] = "new", f"c{c}new"
        x = [f"c{c}x{k}" for k in range(100)]
        # The lists' central groups, of 0 and 1, are of another size; the short text of 2 has shingles of 3 that its long text lacks.
        rows += [(10 * c, w), (10 * c, x), (10 * c + 1, z), (10 * c + 1, [*x[:99], "other"])]
        rows += [(10 * c + 2, w[:100]), (10 * c + 2, y[46:60]), (10 * c + 3, y)]
    out = near_copies(table(spark, [(i, " ".join(x), "en", "s") for i, x in rows])).toPandas()
    want = {i: i - i % 10 + (0 if i % 10 < 2 else 2) for i, _ in rows}
    assert dict(zip(out.doc_id, out.component_id)) == want


def brute_components(rows, words, percent):
    sets = []
    for i, text, *_ in rows:
        w = words_of(text)
        sets.append((i, frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w and i is not None else frozenset()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80)])
def test_near_copies(spark, docs, none, rows, words, percent):
    out = near_copies(docs, words, percent).toPandas()
    want = brute_components(rows, words, percent)
    assert len(out) == len(rows) and near_copies(none).count() == 0
    for i, c in zip(out.doc_id, out.component_id):
        assert (math.isnan(i) and math.isnan(c)) or c == want[i]


def test_near_copies_chain(spark):
    """Chains of small changes, where the ends are not similar, and members of one prefix group that differ."""
    text, rows = [f"w{k}" for k in range(200)], []
    for i in range(40):
        rows.append((100 - i, " ".join(text), "en", "s"))
        text[int(RNG.integers(200))] = f"x{i}"
    out = near_copies(table(spark, rows), 4, 85).toPandas()
    want = brute_components(rows, 4, 85)
    assert dict(zip(out.doc_id, out.component_id)) == want


def test_near_copies_verifies_few_pairs(spark, monkeypatch):
    """Of families that share much, but too little for a link, hardly a pair of whole sets is made; links in them are found."""
    monkeypatch.setattr(ngramjoin, "frequent_shingles", lambda docs, words: ngramjoin.ShingleOrder(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    verified, linked = [], ngramjoin._linked
    monkeypatch.setattr(ngramjoin, "_linked", lambda pairs, *rest: verified.append(pairs.count()) or linked(pairs, *rest))
    rows = []
    for c in range(4):
        for k in range(30):
            text = [f"c{c}w{n}" for n in range(180)] + [f"c{c}k{k}w{n}" for n in range(30)]
            rows.append((100 * c + k, " ".join(text), "en", "s"))
        rows.append((100 * c + 50, " ".join([*text[:-1], "other"]), "en", "s"))
    out = near_copies(table(spark, rows), 4, 85).toPandas()
    assert dict(zip(out.doc_id, out.component_id)) == brute_components(rows, 4, 85) == {i: i - 21 if i % 100 == 50 else i for i, *_ in rows}
    assert sum(verified) < 300


def test_parities_bound_what_sets_differ_in():
    sizes = [0, 1, 63, 64, 65, 127, 128, 129, 1000]
    sets = [RNG.integers(0, 1 << 63, n).astype(np.uint64) for n in sizes]
    doc = np.repeat(np.arange(len(sets)), sizes)
    bits = ngramjoin.parities(np.concatenate(sets), doc, np.array(sizes)).to_pylist()
    assert [64 * len(b) for b in bits] == [64, 64, 64, 64, 128, 128, 128, 256, 1024]
    for ids, words in zip(sets, bits):
        want = [0] * len(words)
        for i in ids.tolist():
            at = i % (64 * len(words))
            want[at // 64] ^= 1 << at % 64
        assert [w % (1 << 64) for w in words] == want


def test_suffix_dedup(docs, none, rows):
    out = without_repeats(docs)
    assert without_repeats(none).count() == 0 and {"k", "t", "lang"} <= set(out.columns)
    got = {(r.doc_id, r.text): r for r in out.collect()}
    seen = set()
    for i, text, *_ in sorted({(r[0], r[1]): r for r in rows}.values(), key=lambda r: (r[0] is None, r[0] or 0)):
        if i == 9:
            continue  # two texts of one id stand in an order of hashes
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\x01" * 100
            seen.add(raw[s : s + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        row = got[i, text]
        assert bytes(row.kept) == kept and (row.n_bytes, row.n_removed) == (len(raw), sum(gone))
        assert row.n_spans == len(re.findall(rb"\x01+", bytes(gone)))
    left = deduplicated(docs)
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    assert 30 in ids and 32 not in ids and 40 in ids


def test_suffix_dedup_hot_anchor(spark, monkeypatch):
    """The shuffle of hashes gives what the transforms give."""
    from semcat.llm import suffixdedup

    passage = prose("en", 60)
    rows = [(i, prose("en", 5) + " " + passage + " " + prose("en", 5), "en", "s") for i in range(30)]
    frame = table(spark, rows)
    want = without_repeats(frame).select("doc_id", "kept", "n_spans").orderBy("doc_id").collect()
    monkeypatch.setattr(suffixdedup, "HOT_SEGMENTS", 2)
    routed = suffixdedup.frequent_anchors(frame.select(F.col("doc_id").alias("k"), F.lit(0).alias("t"), "text"), 100)
    assert len(routed)
    assert without_repeats(frame).select("doc_id", "kept", "n_spans").orderBy("doc_id").collect() == want


def test_decontamination(spark, docs, none, rows):
    item = " ".join(rows[5][1].split()[3:23])
    spoiled = item.split()
    spoiled[4], spoiled[11] = "other", "words"
    items = spark.createDataFrame([(1, item.upper()), (2, " ".join(spoiled)), (3, None), (4, ""), (5, prose("en", 20)), (6, "the")], "item_id long, text string")
    found = contaminated(docs, items).where("item_words >= 4").toPandas()
    assert sorted(zip(found.doc_id, found.item_id, found.edits)) == [(5, 1, 0), (5, 2, 2)]
    assert contaminated(none, items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0
    left = without_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == len(rows) - 1


def long_copies(size, n, even):
    """Items of so many words and texts that hold a copy of each with all allowed edits."""
    items, texts = [], []
    for i in range(n):
        words = [f"w{x}" for x in RNG.integers(0, 1 << 40, size)]
        copy, allowed = list(words), int(size * decontaminate.EDITS)
        # Spread evenly, or all in front: the rest of the copy is whole.
        for at in (RNG.choice(size, allowed, False) if even else np.arange(allowed)):
            copy[at] = f"n{RNG.integers(0, 1 << 40)}"
        items.append(" ".join(words))
        texts.append(" ".join([f"x{x}" for x in RNG.integers(0, 1 << 40, 50)] + copy + ["end"] * 40))
    return items, texts


def found_in(items, texts):
    matcher = decontaminate.build_matcher(list(range(len(items))), items)
    words, bounds = decontaminate.words_and_bounds(*bytes_of(as_texts(pa.array(texts, pa.large_string()))))
    return {(d, i): e for d, i, e, _ in decontaminate.matches(matcher, words, bounds)}


@pytest.mark.parametrize("size", [275, 800, 1500])
@pytest.mark.parametrize("even", [True, False])
def test_long_items(size, even):
    items, texts = long_copies(size, 8, even)
    assert found_in(items, texts) == {(i, i): int(size * 0.2) for i in range(8)}


@pytest.mark.parametrize("size", [5, 20, 60, 300])
def test_sizes_without_keys(monkeypatch, size):
    monkeypatch.setattr(decontaminate, "RECALL", 2.0)
    monkeypatch.setattr(decontaminate, "PAIR_ROWS", 50)
    items, texts = long_copies(size, 30, True)
    assert found_in(items, [*texts, "short", "", " ".join(texts[:3])]) == {(i, i): int(size * 0.2) for i in range(30)} | {(32, i): int(size * 0.2) for i in range(3)}


def test_blocks_of_items(spark, docs, rows, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(rows[i][1].split()[3:23])) for i in range(8)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()} == {(i, i) for i in range(8)}


def test_edit_distance():
    for _ in range(200):
        a, b = RNG.integers(0, 4, RNG.integers(1, 9)).tolist(), RNG.integers(0, 4, RNG.integers(0, 15)).tolist()
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        assert edit_distance(a, b)[0] == min(row)


def test_language(docs, none, rows):
    model = fit_tagger(docs.select("doc_id", "text", "lang"))
    out = identify(docs, model).toPandas()
    assert len(out) == len(rows) and out.lang_score.between(0, 1).all()
    plain = out[(out.doc_id < 30) & out.doc_id.notna()]
    assert (plain.lang == plain.lang_pred).mean() > 0.95
    assert set(out[out.doc_id.isin([40, 41, 42, 43])].lang_pred) == {"und"}
    assert identify(none, model).count() == 0 and fit_tagger(none.select("doc_id", "text", "lang")) is None
    assert set(identify(docs, None).toPandas().lang_pred) == {"und"}


def test_toxicity(spark, docs, none):
    bad = ["nasty", "vile"]
    many = table(spark, [(i, prose("en", 60) + (" " + " ".join(RNG.choice(bad, 4)) if i % 4 == 0 else ""), "en", "s") for i in range(300)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(201, None)], "doc_id long, toxic int")
    model = fit_toxicity(many, labels)
    out = score_toxicity(many, model).toPandas()
    held = out[out.doc_id >= 200]
    assert ((held.toxicity >= 0.3) == (held.doc_id % 4 == 0)).mean() > 0.95
    edge = score_toxicity(docs, model).toPandas()
    assert edge.toxicity.between(0, 1).all() and (edge[edge.doc_id == 40].toxicity == model.prior).all()
    assert score_toxicity(none, model).count() == 0 and fit_toxicity(none, labels) is None
    assert (score_toxicity(docs, None).toPandas().toxicity == 0).all()


def test_quality(spark, docs, none):
    many = table(spark, [(i, " | ".join(prose("en", 40).split()) if i % 3 == 0 else prose("en", 50) + ".", "en", "s") for i in range(200)])
    stats = document_statistics(many)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(140)] + [(150, None)], "doc_id long, label int")
    model = fit_quality(stats.join(labels, "doc_id"))
    out = score_quality(stats, model).toPandas()
    held = out[out.doc_id >= 140]
    assert ((held.quality >= 0.7) == (held.doc_id % 3 > 0)).mean() > 0.95 and out.quality.between(0, 1).all()
    edge = score_quality(document_statistics(docs), model).toPandas()
    assert edge.quality.between(0, 1).all() and len(edge) == docs.count()
    assert document_statistics(none).count() == 0
    assert fit_quality(stats.limit(0).withColumn("label", F.lit(1))) is None


def test_isotonic():
    assert isotonic(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 0, 1])).tolist() == [0, 1 / 3, 1 / 3, 1]


def test_tokens(docs, none, rows):
    out = count_tokens(docs).toPandas()
    whole = Counts(WORD_BPE)
    texts = [r[1] or "" for r in rows] + ["It's 'RE <|endoftext|> é 12", "İΣ 日本", "a'b"]
    want = whole.whole(texts)
    assert sorted(out.n_tokens) == sorted(want[:-3]) and count_tokens(none).count() == 0
    from semcat.llm.common import as_texts, bytes_of
    import pyarrow as pa

    assert whole.of_texts(*bytes_of(as_texts(pa.array(texts)))).tolist() == want


def test_tokens_of_a_long_run(spark):
    run = "".join(RNG.choice(list("bcdfghjklmnpqrstvwxz"), 400_000))
    out = count_tokens(table(spark, [(1, run, "en", "s0"), (2, f"{run} end", "en", "s0"), (3, "end", "en", "s0")]))
    want = Counts(WORD_BPE).whole([run, f"{run} end", "end"])
    assert want[0] > 65_535 and [r.n_tokens for r in out.orderBy("doc_id").collect()] == want


def test_vectors(spark):
    base = RNG.normal(size=(40, 16))
    vectors = np.concatenate([base, base[:10] + RNG.normal(size=(10, 16)) * 0.02, np.repeat(base[:1], 20, 0), base[1:3] * 7])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(vectors)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, [None] + [1.0] * 15, 1), (204, base[0].tolist(), None), (205, [1.0, 2.0], 0)]
    frame = spark.createDataFrame([(i, v, x, "?") for i, v, x in rows], "vec_id long, embedding array<double>, label int, n_links string")
    out = similar_vectors(frame).toPandas().set_index("vec_id")
    assert len(out) == len(rows)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    close = (unit @ unit.T >= 0.98) & (np.arange(len(unit))[:, None] % 2 == np.arange(len(unit)) % 2)
    got = out.n_links.reindex(range(len(unit))).to_numpy()
    assert (got <= close.sum(1) - 1).all() and got.sum() >= 0.9 * (close.sum() - len(close))
    rest = out.loc[200:]
    assert (rest.n_links == 0).all() and rest.kept.all() and (rest.component_id == rest.index).all()
    assert similar_vectors(frame.limit(0)).count() == 0


def test_vectors_in_blocks(spark, monkeypatch):
    """Crowded keys in pairs of blocks give what one block gives."""
    from semcat.llm import neardup

    base = RNG.normal(size=16)
    frame = spark.createDataFrame([(i, (base + RNG.normal(size=16) * 0.05).tolist(), 1) for i in range(120)], "vec_id long, embedding array<double>, label int")
    want = similar_vectors(frame).orderBy("vec_id").collect()
    monkeypatch.setattr(neardup, "BLOCK", 16)
    assert similar_vectors(frame).orderBy("vec_id").collect() == want


def test_katz(docs, none, rows):
    train = F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True))
    scored, total = katz_scores(docs.withColumn("train", train))
    out = scored.toPandas()
    one, two = Counter(), Counter()
    tokens = [words_of(text) + [None] for _, text, *_ in rows]
    for (i, *_), t in zip(rows, tokens):
        if i is None or i % 5 != 1:
            one.update(t)
            two.update(zip(["<s>"] + t[:-1], t))
    n = sum(one.values())
    assert total == n and len(out) == len(rows) and out.n_tokens.sum() == sum(map(len, tokens))
    base = [sum(math.log10((one[w] + 0.5) / (n + 0.5 * (len(one) + 1))) for w in t) for t in tokens]
    assert np.allclose(sorted(out.base_score), sorted(base))
    spread = lambda c: np.bincount(np.minimum(list(c.values()), 7), minlength=8)[:7].astype(float)
    from semcat.llm.katz import Unigrams

    model, discount = Unigrams(spread(one), n, len(one)), discounts(spread(two))
    chance = {w: float(model.chance(np.array([c]))[0]) for w, c in one.items()}
    assert math.isclose(sum(chance.values()) + model.unknown, 1)
    context = {}
    for (x, y), c in two.items():
        context.setdefault(x, {})[y] = c
    rule = {}
    for x, seen in context.items():
        kinds = np.array([[sum(c == r for c in seen.values()) for r in range(1, 6)]])
        scale, weight = backoff_weights(np.array([sum(seen.values())]), kinds, np.array([sum(chance[y] for y in seen)]), discount)
        rule[x] = float(scale[0]), float(weight[0])

    def probability(x, w):
        c = context.get(x, {}).get(w, 0)
        if c:
            return discount[min(c, 6)] * c / sum(context[x].values()) * rule[x][0]
        return (rule[x][1] if x in rule else 1.0) * chance.get(w, model.unknown)

    for x in list(context)[:3]:
        assert math.isclose(sum(probability(x, w) for w in one) + probability(x, "never"), 1)
    want = [sum(math.log10(probability(a, w)) for a, w in zip(["<s>"] + t[:-1], t)) for t in tokens]
    assert np.allclose(sorted(out.score), sorted(want))
    assert katz_scores(none.withColumn("train", F.lit(True)))[0].count() == 0
    assert np.isfinite(katz_scores(docs.withColumn("train", F.lit(False)))[0].toPandas().score).all()


def test_stages(spark, docs, none, rows, tmp_path):
    spark.createDataFrame([(1, " ".join(rows[5][1].split()[3:23]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        if name != "mixing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        if name == "language_id":
            assert not ids & {40, 41, 42, 43} and set(range(24)) <= ids
        if name == "near_duplicates":
            assert 30 in ids and not ids & {31, 32, 33} and kept.where("doc_id = 30").count() == 1
        if name == "decontamination":
            assert 5 not in ids and set(range(24)) - {5} <= ids
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_short_items_and_unspaced_scripts(spark):
    chinese = "".join(chr(0x4E00 + int(c)) for c in RNG.integers(0, 3000, 40))
    changed = chinese[:10] + chr(0x4E00) + chinese[11:]
    thai = "".join(chr(0x0E01 + int(c)) for c in RNG.integers(0, 40, 30))
    other = "".join(chr(0x4E00 + int(c)) for c in RNG.integers(3000, 6000, 60))
    items = spark.createDataFrame([(1, "Capital city"), (2, "one"), (3, chinese), (4, thai), (5, "..."), (6, "of the year"), (7, chinese[:2])], "item_id long, text string")
    texts = ["the capital, city of one", "capitalcity city capital", other + changed + other, "x " + thai + " y", "", None, "of the  YEAR of the year", "of the"]
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    found = {(r.doc_id, r.item_id, r.edits, r.first_word) for r in contaminated(docs, items).collect()}
    assert found == {(0, 1, 0, 1), (0, 2, 0, 4), (2, 3, 1, 60), (3, 4, 0, 1), (6, 6, 0, 0), (2, 7, 0, 60)}
    assert {r.doc_id for r in without_contaminated(docs, items).collect()} == {0, 1, 4, 5, 6, 7}


def test_a_column_may_have_any_name(spark, docs):
    clash = docs.withColumn("letters", F.lit(1)).withColumn("letters_", F.lit(2))
    model = fit_tagger(docs.select("doc_id", "text", "lang").where("doc_id < 24"))
    assert {"letters", "letters_", "lang_pred"} <= set(identify(clash, model).columns)
    assert identify(clash, model).select("letters").distinct().count() == 1
