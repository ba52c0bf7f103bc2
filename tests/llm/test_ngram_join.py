"""Word n-gram classes against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from utilscope.llm.graph import components
from utilscope.llm.ngram_join import Similarity, ngram_classes, one_of_each
from utilscope.llm.shingles import shingle_sets

LIKE = Similarity(words=4, numerator=85, denominator=100)


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def classes(pairs, like):
    sets = [shingles(t, like.words) for _, t in pairs]
    label = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common * like.denominator >= len(sets[i] | sets[j]) * like.numerator:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return {
        pairs[i][0]: (len(sets[i]), min(pairs[j][0] for j in range(len(pairs)) if label[j] == label[i]))
        for i in range(len(pairs))
    }


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5)))
    bases = [[word() for _ in range(rng.randint(3, 120))] for _ in range(12)]
    texts = []
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
            words[rng.randrange(len(words))] = word()
        texts.append(rng.choice([" ", "  ", "\n"]).join(words).title() if rng.random() < 0.3 else " ".join(words))
    return list(enumerate(texts + ["", None, " \t", "one", "ONE", "a b", texts[0], texts[0]]))


@pytest.mark.parametrize("like", [LIKE, Similarity(), Similarity(words=2, numerator=50, orders=1)])
def test_classes_are_those_of_all_pairs(documents, like):
    pairs = corpus(like.words)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_classes(documents(pairs), like).collect()}
    assert got == classes(pairs, like)


def test_a_large_near_copy_group_is_one_class(documents):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    pairs = []
    for i in range(600):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        pairs.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_classes(documents(pairs), LIKE).collect()}
    assert got == classes(pairs, LIKE)


@pytest.mark.parametrize("seed", [11, 12])
def test_pairs_at_the_threshold_with_shingles_beyond_the_other_prefix(documents, seed):
    """Copies that also differ in length and share passages across groups: prefixes end at unlike places."""
    rng = random.Random(seed)
    passages = [[f"p{k}w{i}" for i in range(40)] for k in range(4)]
    pairs = []
    for base in range(25):
        words = [f"b{base}w{i}" for i in range(rng.randint(30, 70))] + rng.choice(passages)
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(60)}"
            copy += [f"t{rng.randrange(10**6)}" for _ in range(rng.randint(0, 6))]
            pairs.append((len(pairs), " ".join(copy[rng.randint(0, 4):])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_classes(documents(pairs), LIKE).collect()}
    assert got == classes(pairs, LIKE)


def test_ids_null_and_repeated_and_an_empty_table(documents):
    text = "a b c d e f g"
    got = ngram_classes(documents([(None, text), (5, text), (5, text), (None, "q r s t")]), LIKE).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 5), (5, 5), (5, 5)]
    assert ngram_classes(documents([]), LIKE).collect() == []


def test_one_of_each_keeps_one_row_of_a_class(documents):
    pairs = corpus(3) + [(400, None), (400, None)]
    kept = one_of_each(documents(pairs), LIKE)
    assert kept.columns == documents(pairs).columns
    want = [i for i, (_, c) in classes(pairs, LIKE).items() if i == c]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_a_very_long_text_and_small_chunks_give_the_same_sets():
    column = pa.array(["x y z " * 50_000, "a b c d", None, "x y z x y"])
    whole = [s for s in shingle_sets(column, 3)]
    parts = [s for s in shingle_sets(column, 3, chunk_bytes=5)]
    assert np.array_equal(np.concatenate([s.hashes for s in whole]), np.concatenate([s.hashes for s in parts]))
    assert np.concatenate([s.counts for s in parts]).tolist() == [3, 2, 0, 3]


def test_components_of_a_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(chain, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}
    assert components(chain.limit(0), "a", "b").collect() == []


def test_components_of_many_partitions(spark):
    rng = random.Random(8)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1040)]
    links += [(2000, i) for i in range(2001, 2200)]
    label = {i: i for i in range(2300)}
    for a, b in links:
        x, y = label[a], label[b]
        label = {i: min(x, y) if c in (x, y) else c for i, c in label.items()}
    found = components(spark.createDataFrame(links, "a long, b long"), "a", "b", file_rows=40).collect()
    linked = {i for pair in links for i in pair if pair[0] != pair[1]}
    assert {r["node"]: r["component"] for r in found} == {i: label[i] for i in linked}
    assert len(found) == len(linked)
