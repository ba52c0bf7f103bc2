"""Jump hash shards against the published loop."""

from __future__ import annotations

import zlib

from utilscope.llm.sharding import shard_rows


def jump(key, shards):
    at, following, key = -1, 0, key % 2**64
    while following < shards:
        at = following
        key = (key * 2862933555777941757 + 1) % 2**64
        following = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_shards_follow_the_loop_and_slots_have_no_gap(documents):
    ids = [*range(300), -1, -(2**63), 2**63 - 1, 7, 7, 7]
    pairs = [(i, f"text {i} é") for i in ids] + [(None, None), (None, "")]
    rows = shard_rows(documents(pairs), 16).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        key = r["doc_id"] or 0
        text = f"text {r['doc_id']} é" if r["doc_id"] is not None else ""
        assert (r["shard"], r["grown_shard"]) == (jump(key, 16), jump(key, 17))
        assert (r["size"], r["text_crc32"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    for shard in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_one_hot_id_and_an_empty_table(documents):
    rows = shard_rows(documents([(3, "same")] * 500), 16).collect()
    assert {r["shard"] for r in rows} == {jump(3, 16)}
    assert sorted(r["slot"] for r in rows) == list(range(500))
    assert shard_rows(documents([]), 4).collect() == []


def test_the_plan_runs_no_python(documents):
    plan = shard_rows(documents([(1, "a")]).selectExpr("doc_id", "text"), 16)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
