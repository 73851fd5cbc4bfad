"""Merkle manifest, spelling variants and threshold search against brute force."""

import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from semcat.llm import merkle, spelling, topksearch
from semcat.llm.merkle import document_manifest, folded, proof_digest
from semcat.llm.spelling import near_pairs, spelling_forms, spelling_variants, with_typo, word_counts, word_lists
from semcat.llm.topksearch import threshold_search, top_inner_products

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, key string, i string, node string, word string, n string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), *["?"] * 6) for i, t, g, s in rows], DOCS)


# -- Merkle manifest ----------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source):
    values = (doc_id, source, lang, None if text is None else len(text), text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root of the nodes, and each one's siblings (left, right) on the way."""
    paths, owners, nodes = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(nodes) > 1:
        up, owned = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for k in range(len(run)):
                for i in owners[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha("".join(run)))
            owned.append(list(itertools.chain(*owners[at : at + 3])))
        nodes, owners = up, owned
    return nodes[0], paths


def manifest_by_hand(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[3]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted(((r[0] is not None, r[0] or 0, leaf_of(*r), r) for r in groups[s]), key=lambda x: x[:3]) for s in names}
    trees = {s: climb([x[2] for x in leaves[s]]) for s in names}
    root, above = climb([trees[s][0] for s in names])
    out = []
    for s, upper in zip(names, above):
        for (_, _, leaf, row), path in zip(leaves[s], trees[s][1]):
            path = path + upper
            doc_id, text, lang, _ = row
            h = leaf if text is None else sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, s, lang, len(text), text.replace("\n", ""))))
            for left, right in path:
                h = sha(left + h + right)
            out.append((doc_id, leaf, trees[s][0], root, sha("".join(a + b for a, b in path)), h))
    return sorted(map(repr, out))


def manifest(docs):
    found = document_manifest(docs, F.translate("text", "\n", ""))
    rows = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")), folded(F.col("changed_leaf"), F.col("path"))).collect()
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_hashing_by_hand(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = [(i, f"line {i}\n" * (i % 3), "en", "hot") for i in range(40)]
    rows += [(100 + i, f"text {i}", None, f"s{i % 7}é") for i in range(30)]
    rows += [(1, None, None, None), (2, "", "de", None), (2, "", "de", None), (3, "x", "en", ""), (None, "y", "en", "hot"), (None, "a\nb", "en", "hot")]
    rows += [(9, "lone\n", "fr", "~alone"), (5, "other text", "en", "hot"), (5, "line 5\n" * 2, "en", "hot"), (7, "long " * 40_000, "en", "ü")]
    rows += [(200 + i, "z", "en", "ten") for i in range(10)]
    assert manifest(documents(spark, rows)) == manifest_by_hand(rows)


def test_manifest_of_one_row_and_of_none(spark):
    assert manifest(documents(spark, [(4, "a\n", "en", "s")])) == manifest_by_hand([(4, "a\n", "en", "s")])
    assert document_manifest(documents(spark, [])).collect() == []


def test_untampered_leaves_give_the_root(spark):
    docs = documents(spark, [(i, f"t{i}\n", "en", f"s{i % 4}") for i in range(50)])
    found = document_manifest(docs).select("root", folded(F.col("changed_leaf"), F.col("path")).alias("again"))
    assert found.where("again != root").count() == 0 and found.select("root").distinct().count() == 1


# -- spelling variants --------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def forms_by_hand(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, words[w], form[w], root, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def vocabulary(seed, letters="abé", n=260, longest=9):
    rng = np.random.default_rng(seed)
    words = {"".join(rng.choice(list(letters), rng.integers(2, longest + 1))): int(rng.integers(1, 40)) for _ in range(n)}
    return {**words, "aaaa": 7, "aaaaa": 7, "aaaaaa": 15, "b" * 300: 4, "b" * 301: 9, "b" * 150 + "a" + "b" * 150: 5}


@pytest.mark.parametrize("most", [3, 20, spelling.LIST_WORDS])
def test_forms_equal_all_pairs(spark, most):
    words = vocabulary(most)
    found = spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long"), most)
    assert found.columns == ["word", "n", "form", "root", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect()), key=repr) == forms_by_hand(words)


def test_long_lists_are_cut(spark):
    words = vocabulary(1, "ab", 600)
    lists = word_lists(spark.createDataFrame(list(words.items()), "word string, n long"), 8)
    assert lists.where("b - a > 1").groupBy("key").count().where("count > 8").isEmpty()
    assert not lists.where("b - a = 1").isEmpty()


def test_scan_in_small_chunks(monkeypatch):
    monkeypatch.setattr(spelling, "STATES", 64)
    words = sorted({w for w in vocabulary(5, "ab", 900, 6) if len(w) in (5, 6)})
    text = np.array([w.encode("latin-1") for w in words], "S6")
    i, j = near_pairs(text, np.zeros(len(words), int), 5, 0, 5)  # one list whose window is the whole word
    found = sorted(sorted((words[x], words[y])) for x, y in zip(i, j))
    assert found == sorted(sorted(p) for p in itertools.combinations(words, 2) if one_edit(*p) and min(map(len, p)) == 5)


def test_words_of_documents(spark):
    texts = ["Straße straße STRASSE naïve naïve×÷ abc", None, "", "  \n", "word" * 30_000, "Straße, x1yellow2 yellow_yellow Ünder ünder"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts * 60)] + [(None, "nobody knows", "en", "s"), (1, "twice seen", "en", "s"), (1, "twice seen", "en", "s")]
    counts = Counter()
    for i, t, *_ in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for run in "".join(c if "a" <= c <= "z" or "À" <= c <= "ÿ" else " " for c in lowered).split(" "):
            word = with_typo("" if i is None else str(i), run) if run else ""
            if len(word) >= 5:
                counts[word] += 1
    docs = documents(spark, rows)
    assert {r["word"]: r["n"] for r in word_counts(docs).collect()} == counts
    kept = {w: n for w, n in counts.items() if n >= 3}
    assert sorted(map(tuple, spelling_variants(docs).collect()), key=repr) == forms_by_hand(kept)
    assert spelling_variants(documents(spark, [])).collect() == []


# -- threshold search ---------------------------------------------------------


@pytest.mark.parametrize("bound", [None, -30, 40])
def test_threshold_search_equals_scoring_all(bound):
    rng = np.random.default_rng(3)
    for n, dim, spread in ((1, 3, 4), (7, 4, 2), (300, 6, 5), (2000, 5, 40), (500, 3, 1)):
        vectors = rng.integers(-spread, spread + 1, (n, dim))
        lists = np.argsort(vectors.T, axis=1, kind="stable").astype(np.int32)
        for query in [*rng.integers(-spread, spread + 1, (8, dim)), np.zeros(dim, int)]:
            scores = vectors @ query
            best = [(r, scores[r]) for r in np.lexsort((np.arange(n), -scores))[:10] if bound is None or scores[r] >= bound]
            rows, found, _ = threshold_search(query, vectors, lists, 10, bound)
            assert list(zip(rows, found)) == best


def test_threshold_search_stops_early():
    rng = np.random.default_rng(4)
    vectors = rng.integers(0, 100, (20_000, 2))
    lists = np.argsort(vectors.T, axis=1, kind="stable").astype(np.int32)
    assert threshold_search(np.array([3, 5]), vectors, lists, 10)[2] < 5_000


def top_by_hand(rows, k):
    whole = []
    for vec_id, v in rows:
        if vec_id is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((vec_id, np.floor(1024 * np.array(v, float)).astype(int)))
    out = []
    for at, (query_id, q) in enumerate(whole):
        if query_id % 10 == 0:
            scored = sorted((-int(q @ v), vec_id) for k, (vec_id, v) in enumerate(whole) if k != at and len(v) == len(q))
            out += [(query_id, r + 1, vec_id, -s) for r, (s, vec_id) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_values, chunk_values", [(60, 20), (1 << 19, 1 << 17)])
def test_top_inner_products(spark, block_values, chunk_values):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(150)]
    rows += [(200 + i, [0.5, -0.5, 0.25, 0.1]) for i in range(30)]  # ties
    rows += [(10, [0.5, -0.5, 0.25, 0.1]), (10, [0.5, -0.5, 0.25, 0.1]), (20, [1.0, 0.0, 0.0, 0.0]), (300, [0.0] * 4)]
    rows += [(310, None), (320, [1.0, None, 0.0, 0.0]), (330, [float("nan"), 0.0, 0.0, 0.0]), (340, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (350, [1.0, 2.0]), (351, [2.0, 2.0]), (360, []), (361, []), (370, [5.0] * 5)]
    frame = spark.createDataFrame([(i, v, i, "?", "?", "?") for i, v in rows], "vec_id long, embedding array<float>, label long, v string, dim string, rank string")
    found = top_inner_products(frame, F.col("vec_id") % 10 == 0, 10, block_values=block_values, chunk_values=chunk_values)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == top_by_hand([(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 10)


def test_top_inner_products_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_inner_products(empty, F.col("vec_id") % 10 == 0).collect() == []
    nobody = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert top_inner_products(nobody, F.col("vec_id") % 10 == 0).collect() == []


def test_blocks_are_bounded():
    assert topksearch.BLOCK_VALUES * (8 + 4) < 16 << 20


# -- repeated passages --------------------------------------------------------


def test_expansion_decides_not_the_order():
    """Equal strings are told by the intervals alone: the order of suffixes goes to the end of each segment."""
    from semcat.llm.suffixdedup import repeats_by_transform

    rng = np.random.default_rng(11)
    for trial in range(150):
        length = int(rng.integers(2, 12))
        pool = [bytes(rng.integers(97, 99, 40).tolist()) for _ in range(3)]
        segments = []
        for _ in range(int(rng.integers(1, 12))):
            size, piece = int(rng.integers(length, 24)), pool[rng.integers(3)]
            at = int(rng.integers(0, 40 - size + 1))
            segments.append(piece[at : at + size])
        starts = [(s, p) for s, seg in enumerate(segments) for p in range(len(seg) - length + 1)]
        rank = rng.permutation(len(starts))
        first = {}
        for (s, p), r in zip(starts, rank):
            key = segments[s][p : p + length]
            first[key] = min(first.get(key, r), r)
        want = [r > first[segments[s][p : p + length]] for (s, p), r in zip(starts, rank)]
        assert repeats_by_transform(segments, rank, length).tolist() == want


def test_clashing_names_and_repeated_ids_in_dedup(spark):
    from semcat.llm.suffixdedup import deduplicated, without_repeats

    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a " + passage), (2, passage + " b"), (2, "other " + passage), (2, passage + " b"), (None, passage), (None, "lost words"), (3, None)]
    frame = spark.createDataFrame([(i, t, *["?"] * 7) for i, t in rows], "doc_id long, text string, k string, t string, row string, `all` string, cut_kept string, sd__k string, twice string")
    found = without_repeats(frame)
    assert found.columns == [*frame.columns, "kept", "n_bytes", "n_removed", "n_spans"] and found.count() == len(rows)
    assert found.where("doc_id = 1").first()["n_removed"] == 0
    assert {r["n_spans"] for r in found.where("doc_id = 2 or text like 'w0%'").collect()} == {1}
    left = deduplicated(frame)
    assert left.columns == frame.columns and {r["text"] for r in left.where("doc_id is null").collect()} == {"lost words"}


# -- rotation codes -----------------------------------------------------------


def test_estimates_are_unbiased_and_bounds_hold():
    """Over many rotations the estimate's mean is the cosine, and pairs at the threshold are left open."""
    from semcat.llm import neardup

    rng = np.random.default_rng(2)
    for size in (32, 64):
        x = rng.normal(size=(40, size))
        near = x + rng.normal(size=x.shape) * 0.2
        x, near = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, near))
        cosines = (x * near).sum(1)
        sums, missed = np.zeros(40), 0
        for seed in range(300):
            turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]
            code, factor, _, _ = neardup.encode(x, turn)
            _, _, steps, step = neardup.encode(near, turn)
            signs = code.astype(np.float32) * 2 - 1
            found = np.diag(neardup.estimates(signs, factor, steps.astype(np.float32), step))
            sums += found
            for i in range(40):
                one = slice(i, i + 1)
                missed += not neardup.may_reach(signs[one], factor[one], steps[one].astype(np.float32), step[one], cosines[i])[0, 0]
        assert np.abs(sums / 300 - cosines).max() < 0.01
        assert missed <= 300 * 40 * 0.001


def test_few_vectors_are_fetched(spark, monkeypatch):
    """Most vectors have no partner; their codes alone are shuffled."""
    from semcat.llm import neardup

    rng = np.random.default_rng(9)
    base = rng.normal(size=(1500, 64))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(base)] + [(2000 + i, (base[i] + rng.normal(size=64) * 0.05).tolist(), 1) for i in range(40)]
    tables = {}
    store = neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda df, name, *a: tables.setdefault(name, store(df, name, *a)))
    found = neardup.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert {r.vec_id for r in found.where("n_links > 0").collect()} >= {2000 + i for i in range(38)}
    assert "v" not in tables["coded_vectors"].columns and "v" not in tables["open_rows"].columns
    assert tables["open_rows"].select("id").distinct().count() < 300


def test_vectors_that_share_an_id(spark):
    from semcat.llm.neardup import similar_vectors

    one, two = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.2, 0.0]
    rows = [(1, one), (1, two), (5, one), (6, two), (7, [1.0, 0.01, 0.0, 0.1])]
    found = similar_vectors(spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, label int"))
    assert found.count() == 5 and found.where("vec_id = 6").first()["n_links"] >= 1
