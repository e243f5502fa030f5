"""Whitening, language-model scores and hard negatives against brute force."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from promolift.llm import lm
from promolift.llm import negatives as N
from promolift.llm.elias_fano import EliasFano, Trie
from promolift.llm.lm import score_texts
from promolift.llm.negatives import hard_negatives
from promolift.llm.tokens import encode_all
from promolift.llm.whitening import components, whitened_components

VECTORS = "vec_id long, embedding array<float>, label int, key string, vector string"


def vectors(spark, rows):
    """Rows with two more columns whose names the operators use themselves."""
    return spark.createDataFrame([(*row, "k", "v") for row in rows], VECTORS)


# --- whitening ----------------------------------------------------------------

@pytest.mark.parametrize("values", [
    [5.0], [3.0, 3.0, 3.0], [9.0, 1.0, 0.0, 0.0], [1e6, 1.0, 1.0, 1e-3, 0.0], list(np.linspace(1, 2, 40)),
    [2.0 ** -i for i in range(30)],
])
def test_components_are_those_of_the_covariance(values):
    rng = np.random.default_rng(len(values))
    turn = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    matrix = (turn * values) @ turn.T
    found, basis = components(matrix)
    scale = max(values)
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-12 * scale
    assert np.abs(basis.T @ basis - np.eye(len(values))).max() < 1e-12
    assert np.abs(matrix @ basis - basis * found).max() < 1e-12 * scale


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(x) for x in rng.standard_normal(6) * (1, 2, 3, 4, 5, 6)], 0) for i in range(80)]
    good += [good[3], (None, good[4][1], 0)]
    bad = [(90, None, 0), (91, [1.0, None] + [0.0] * 4, 0), (92, [math.inf] + [0.0] * 5, 0),
           (93, [math.nan] * 6, 0), (94, [1.0], 0), (95, [], 0), (96, [1e30] * 6, 0)]
    rows = whitened_components(vectors(spark, good + bad).repartition(5), most=4).collect()
    x = np.floor(1024 * np.array([r[1] for r in good], np.float32).astype(float)).astype(np.int64) + 100000
    n = len(x)
    apart = n * x - x.sum(axis=0)
    centred = apart / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    assert len(rows) == 4 * n and {r.n for r in rows} == {n}
    expected = {}
    for row, far, made in zip(good, apart, centred @ basis[:, :4] / np.sqrt(values[:4])):
        expected.setdefault(row[0], (int((far * far).sum()), made))
    signs = {}
    for r in rows:
        deviation, made = expected[r.vec_id]
        assert r.deviation == deviation
        sign = signs.setdefault(r.component, np.sign(r.whitened * made[r.component - 1]))
        assert abs(sign * r.whitened - made[r.component - 1]) < 1e-9
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12
        assert r.identity_error < 1e-9


def test_whitening_of_flat_and_empty_tables(spark):
    flat = whitened_components(vectors(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in flat] == [(0, None, None, None)] * 4
    line = whitened_components(vectors(spark, [(i, [float(i), 2.0], 0) for i in range(4)])).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)}
    assert whitened_components(vectors(spark, [])).collect() == []
    assert whitened_components(vectors(spark, [(1, None, 0)])).collect() == []


# --- language model -----------------------------------------------------------

@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 1), (1, 1 << 40), (7, 2), (900, 30), (900, 1 << 50)])
def test_elias_fano_values_and_successors(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
    sequence = EliasFano.from_parts(EliasFano.of(values).parts())
    assert (sequence.value(np.arange(n)) == values).all()
    asked = rng.integers(0, top + top // 2 + 2, 500).astype(np.uint64)
    if n:
        assert (sequence.successor(asked) == np.searchsorted(values, asked)).all()


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("words", [3, 60, 1 << 30])
def test_trie_finds_its_grams_and_no_others(order, words):
    rng = np.random.default_rng(order)
    grams = np.unique(rng.integers(0, words, (700, order)).astype(np.uint64), axis=0)
    codes = rng.integers(1, 65536, len(grams))
    trie = Trie.mapped(Trie.of(grams, codes).image())
    held = dict(zip(map(tuple, grams.tolist()), codes.tolist()))
    asked = np.vstack([grams, rng.integers(0, words + 2, (700, order)).astype(np.uint64)])
    assert trie.lookup(asked).tolist() == [held.get(tuple(g), 0) for g in asked.tolist()]


def brute_scores(rows):
    """(n_tokens, n_known, train_tokens, base_score, score) of every row, in their order."""
    texts = [(text or "").encode().lower().split() + [b""] for _, text, _ in rows]
    taught = [t for t, row in zip(texts, rows) if row[2]]
    single = Counter(w for t in taught for w in t)
    pairs = Counter(p for t in taught for p in zip([None] + t, t))
    total, different = sum(single.values()), len(single)
    out = []
    for text in texts:
        share = [(single[w] + 1) / (total + different + 1) for w in text]
        code = 0
        for before, word, p in zip([None] + text, text, share):
            seen = pairs[before, word]
            context = len(taught) if before is None else single[before]
            code += max(min(seen, 1), round(-lm.STEPS * math.log10((seen + lm.MU * p) / (context + lm.MU))))
        out.append((len(text), sum(single[w] > 0 for w in text), total, sum(map(math.log10, share)), -code / lm.STEPS))
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 50])
def test_scores_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", chunk)
    rng = np.random.default_rng(2)
    words = [f"W{i}" for i in range(40)] + ["å", " x", "a b"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60))) + "\x0b \n", i % 7 != 2) for i in range(60)]
    rows += [(60, None, True), (61, "", False), (None, "w1 w2", True), (62, "new words only", None), rows[5], rows[2]]
    rows += [(63, "w1 " * 50_000, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, training boolean").withColumn("chunk", F.lit("x"))
    found = score_texts(docs.repartition(3), F.col("training")).collect()
    ours = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in found)
    assert ours == sorted(
        (str(row[0]), *brute[:3], round(brute[3], 6), brute[4]) for row, brute in zip(rows, brute_scores(rows)))


def test_scores_without_training_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    found = score_texts(docs, F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in found) == [
        (1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]
    assert score_texts(docs.where("doc_id > 5"), F.lit(True)).collect() == []


def test_held_out_texts_score_better_than_by_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    found = score_texts(docs, ~held_out).where("not training").agg(F.sum("score"), F.sum("base_score")).head()
    assert zlib.crc32(b"2") == 450215437 and found[0] > 0.97 * found[1]


# --- hard negatives -----------------------------------------------------------

def brute_negatives(rows, positives=5, top=10):
    held = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = tuple(math.floor(256 * float(np.float32(x))) for x in vector)
        held[i] = min(held.get(i, (label, whole)), (label, whole))
    out = []
    for a in [i for i in held if i % 10 == 0]:
        score = {i: sum(p * q for p, q in zip(held[a][1], held[i][1])) for i in held if i != a}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if held[i][0] == held[a][0]][:positives]:
            fits = [i for i in ranked if held[i][0] != held[a][0]
                    and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:top]
            out += [(a, p, rank + 1, i, score[p], score[i]) for rank, i in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("leaf_rows", [1024, 8])
def test_negatives_equal_brute_force(spark, monkeypatch, leaf_rows):
    monkeypatch.setattr(N, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(leaf_rows)
    centres = rng.standard_normal((4, 5))
    rows = []
    for i in range(300):
        label = int(rng.integers(0, 4))
        # Half steps make ties; some vectors occur many times.
        vector = np.round(2 * (centres[label] + rng.standard_normal(5))) / 2 if i % 5 else centres[0]
        rows.append((i, [float(x) for x in vector], label))
    rows += [(10, rows[20][1], 0), (300, None, 1), (301, [1.0, None, 0.0, 0.0, 0.0], 1), (302, [math.nan] * 5, 1),
             (303, [1.0] * 5, None), (None, [1.0] * 5, 1), (310, [0.0] * 5, 1)]
    found = hard_negatives(vectors(spark, rows), F.col("id") % 10 == 0).collect()
    ours = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found)
    assert ours == brute_negatives(rows)


def test_the_tree_leaves_out_leaves_that_a_window_cannot_meet():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.integers(-9, 9, (200, 4)) + shift for shift in (0, 1000, -1000, 3000)])
    tree = N.fit_tree(rows, 16)
    place = N.leaf_of(tree, rows)
    ranges = {}
    for leaf, points in N.leaf_paths(tree):
        own = rows[place == leaf]
        if len(own):
            apart, long = np.sqrt(N.squared(own, points)), (own.astype(float) ** 2).sum(axis=1)
            ranges[leaf] = N.Ranges(apart.min(axis=0), apart.max(axis=0), long.min(), long.max())
    router = N.Router(tree, ranges)
    scores = rows @ rows[:1].T
    for low, high in ((100, 300), (-1e18, 1e18), (5000, 9000)):
        found = router.leaves_for(rows[:1], np.array([low], float), np.array([high], float))
        needed = set(place[((scores >= low) & (scores <= high))[:, 0]].tolist())
        assert needed <= set(found)
    near = router.leaves_for(rows[250:251], np.array([3.9e6]), np.array([4.1e6]))
    assert len(near) < len(ranges) / 2


def test_negatives_of_tables_without_rows_or_pairs(spark):
    assert hard_negatives(vectors(spark, []), F.col("id") % 10 == 0).collect() == []
    alone = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 2)]
    assert hard_negatives(vectors(spark, alone), F.col("id") % 10 == 0).collect() == []


def test_anchors_are_never_broadcast_and_the_sample_is_cut_before_the_driver(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF_ROWS", 8)
    monkeypatch.setattr(N, "SAMPLE", 20)
    rng = np.random.default_rng(5)
    given = vectors(spark, [(i, [float(x) for x in rng.standard_normal(4)], i % 3) for i in range(200)])
    rows, length = N.whole_vectors(given.repartition(20), 256, "vec_id", "label", "embedding")
    queries = rows.select("*", F.lit(0).alias("slot"), F.lit(N.LEAST).alias("low"), F.lit(N.MOST).alias("high"))
    plan = N.search(N.build_index(rows, length), queries, 3, True, False)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Broadcast" not in plan
    hashed = rows.select("vector", F.xxhash64("id").alias("h"), "id")
    everything = hashed.orderBy("h", "id").limit(20).collect()
    # Also where fewer rows than expected have small hashes.
    for count in (200, 10 ** 6):
        assert N.smallest_hashes(rows, count) == everything


# --- token ids ----------------------------------------------------------------

@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "kept")])
def test_strings_with_an_id_of_their_own_get_it(name, spaces):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    texts = ["a<|endoftext|>b", "x <|endoftext|> y", "<|endoftext|>", "plain words", "<|startoftext|> z\n\n<|endoftext|>"]
    ids = encode_all(path, spaces, texts, 1)
    assert [i[:-1].tolist() for i in ids] == [library.encode(t, add_special_tokens=False).ids for t in texts]
