"""Benchmark passages against brute force."""

from __future__ import annotations

import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from utilscope.llm import decontaminate
from utilscope.llm.decontaminate import Budget, Index, _scan, align, drop_leaks, find_leaks, gram_hashes, normal_rows
from utilscope.llm.shingles import utf8


def normal(text):
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", (text or "").lower()).lstrip(" ").encode()


def least_edits(pattern, text):
    """Edits of the whole pattern against any part of the text."""
    costs = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        row = [i + 1]
        for j, x in enumerate(text):
            row.append(min(costs[j] + (c != x), costs[j + 1] + 1, row[j] + 1))
        costs = row
    return min(costs)


def test_normal_form_of_rows():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB .,é\n") for _ in range(rng.randint(0, 12))).lower() for _ in range(2000)]
    offsets, data = utf8(pa.array(texts))
    out, starts = normal_rows(data, offsets)
    assert [out[a:b].tobytes() for a, b in zip(starts, starts[1:])] == [normal(t) for t in texts]


def test_alignment_is_the_least_number_of_edits():
    rng = random.Random(2)
    draw = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    for _ in range(1500):
        pattern, k = draw(rng.randint(4, 14)), rng.randint(0, 3)
        text = draw(rng.randint(0, 8)) + bytes(c for c in pattern if rng.random() > 0.15) + draw(rng.randint(0, 8))
        want, got = least_edits(pattern, text), align(pattern, text, k)
        assert (got is not None) == (want <= k)
        if got:
            assert got[0] == want and least_edits(pattern, text[got[1]:got[2]]) == want


def test_planted_edits_within_the_budget_are_found():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(10)]
    budget = Budget()
    index = Index(items, budget)
    for _ in range(150):
        item, text = rng.choice(items)
        letters = list(text)
        for _ in range(rng.randint(0, budget.edits(len(text)))):
            at, way = rng.randrange(len(letters)), rng.randrange(3)
            if letters[at] != " ":
                letters[at:at + 1] = [["x"], [], [letters[at], "y"]][way]
        doc = " ".join(word() for _ in range(40)) + " " + "".join(letters) + " " + " ".join(word() for _ in range(9))
        edits = least_edits(normal(text), normal(doc))
        found = [f for f in _scan(pa.array([doc]), index) if f[1] == item]
        assert (edits > budget.edits(len(text))) or (len(found) == 1 and found[0][2] == edits)


def test_rows_of_documents_blocks_short_items_and_nulls(spark, documents):
    rng = random.Random(4)
    text = "Some passage, of a benchmark; with enough words to be told from others"
    noise = " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(2000))
    items = spark.createDataFrame(
        [(1, text, "e"), (2, "x y", "e"), (3, None, "e"), (4, "", "e"), (None, text, "e")], "item_id long, text string, edits string")
    pairs = [(1, noise + text.upper() + noise * 20), (1, "ax y"), (2, "A x  Y!"), (None, text), (3, None), (4, ""), (5, text[:40])]
    for budget in (Budget(), Budget(block_bytes=20)):
        found = find_leaks(documents(pairs), items, budget).collect()
        got = sorted((r["doc_id"] or -1, r["item_id"] or -1, r["edits"]) for r in found)
        assert got == [(-1, -1, 0), (-1, 1, 0), (1, -1, 0), (1, 1, 0), (2, 2, 0)]
        kept = drop_leaks(documents(pairs), items, budget)
        assert kept.columns == documents(pairs).columns
        assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]
    assert find_leaks(documents(pairs), items.limit(0)).collect() == []
    assert find_leaks(documents([]), items).collect() == [] and drop_leaks(documents([]), items).collect() == []


def test_every_verbatim_item_of_the_test_tables_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).collect()}
    plain = [(r["item_id"], normal(r["text"]).rstrip()) for r in items.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, p in plain if p in normal(r["text"])}
    assert want and found == want


def test_an_item_at_the_end_of_a_buffer():
    index = Index([(1, "abcdefghijkl mnop")], Budget())
    assert list(index.matches(np.frombuffer(b"zz abcdefghijkl mnop", np.uint8), np.array([0, 20]))) == [(0, 1, 0, 3, 20)]


def plain_regions(index, data, starts):
    """Every place of every q-gram against every place of it in an item."""
    grams = gram_hashes(data, index.budget.q).tolist()
    counts = {}
    for row in range(len(starts) - 1):
        for at in range(starts[row], starts[row + 1] - index.budget.q + 1):
            for n in np.flatnonzero(index.hashes == grams[at]):
                item = int(index.owners[n])
                band = int((at - starts[row] - index.places[n]) // index.bands[item])
                for b in (band, band - 1):
                    counts[row, item, b] = counts.get((row, item, b), 0) + 1
    return sorted(key for key, n in counts.items() if n >= index.needed[key[1]])


@pytest.mark.parametrize("slice_size", [7, 64, 1 << 18])
def test_regions_are_those_of_all_places_whatever_the_slices(monkeypatch, slice_size):
    monkeypatch.setattr(decontaminate, "SLICE", slice_size)
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", slice_size + 30)
    rng = random.Random(6)
    for budget in (Budget(q=3, percent=10), Budget(q=4, percent=0)):
        items = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(4, 40)))) for i in range(6)] + [(9, "0" * 30), (10, "ha " * 9)]
        index = Index(items, budget)
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(5)]
        texts += ["0" * 90, "", "ha " * 30, "x" + "0" * 31 + "y" + items[0][1]]
        offsets, raw = utf8(pa.array(texts))
        data, starts = normal_rows(raw, offsets)
        assert index.regions(data, starts) == plain_regions(index, data, starts)


def test_a_repeating_text_takes_bounded_memory():
    """A long text of zeros against an item of zeros, in a process of its own."""
    code = """
import resource, numpy as np, pyarrow as pa
from utilscope.llm.decontaminate import Budget, Index, _scan
index, column = Index([(1, "0" * 200), (2, "0 " * 60)], Budget()), pa.array(["0" * 1_000_000, "0 " * 200_000])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = sorted(_scan(column, index))
assert [f[:4] for f in found] == [(0, 1, 0, 0), (1, 2, 0, 0)], found
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=decontaminate.__file__.rsplit("/utilscope", 1)[0])
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 300


def test_an_item_repeated_many_times_is_indexed_once(spark, documents):
    text = "Some passage of a benchmark with enough words to be told from others"
    items = spark.range(100_000).selectExpr("id as item_id", f"'{text}' as text")
    assert len(list(decontaminate.item_blocks(decontaminate.folded_items(items)[0], Budget(block_bytes=100)))) <= 2
    found = find_leaks(documents([(1, f"x {text} y"), (2, "clean")]), items)
    assert found.selectExpr("count(distinct item_id)", "count(*)", "min(doc_id)", "max(doc_id)").first()[:] == (100_000, 100_000, 1, 1)
    assert [r["doc_id"] for r in drop_leaks(documents([(1, f"x {text} y"), (2, "clean")]).withColumnRenamed("key", "lower"), items).collect()] == [2]
