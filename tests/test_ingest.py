"""Incremental ingest: exactly once, resumable, totals kept up batch by batch."""

import re

import pytest
from raw_fixture import raw_row, write_year

from utilscope.operators.aggregates import market_year
from utilscope.rules import DIABETES_RULES
from utilscope.schema import RAW_COLUMNS
from utilscope.streaming import ingest, upkeep
from utilscope.streaming.upkeep import Partial, Upkeep


@pytest.fixture
def paths(tmp_path):
    return ingest.IngestPaths(*(str(tmp_path / name) for name in ("landing", "sink", "checkpoint", "partials")))


def up(spark, paths):
    return Upkeep(spark, paths, DIABETES_RULES)


def first_arrival(tmp_path):
    write_year(tmp_path / "landing", 2023, [raw_row(), raw_row(Brnd_Name="Wegovy"), raw_row(Prscrbr_NPI="8")])


def second_arrival(tmp_path):
    write_year(tmp_path / "landing", 2024, [raw_row(), raw_row(Gnrc_Name="Insulin Lispro", Brnd_Name="Humalog")])
    write_year(tmp_path / "landing", 2023, [raw_row(Gnrc_Name="Metformin", Brnd_Name="Metformin")], "late.csv")


def check(kept):
    fact = kept.fact()
    assert {(r.ingest_run, r["count"]) for r in fact.groupBy("ingest_run").count().collect()} == {(0, 2), (1, 3)}
    totals = kept.market_year()
    assert sorted(totals.collect()) == sorted(market_year(fact).collect())
    assert {(r.year, r.prescribers, r.products) for r in totals.collect()} == {(2023, 2, 2), (2024, 1, 2)}
    assert {(r.year, round(r.prescribers_estimate)) for r in kept.estimated_prescribers().collect()} == {(2023, 2), (2024, 1)}


def test_ingest_takes_each_file_once(spark, tmp_path, paths):
    first_arrival(tmp_path)
    assert [(m["scanned"], m["kept"]) for m in up(spark, paths).ingest_available(0)] == [(3, 2)]
    second_arrival(tmp_path)
    up(spark, paths).ingest_available(1)
    assert up(spark, paths).ingest_available(1) == []  # nothing new: a repeated run changes nothing
    check(up(spark, paths))


@pytest.mark.parametrize("dies_after", ["fact", "totals", "ledger"])
def test_a_batch_that_died_is_repeated_without_a_trace(spark, tmp_path, paths, monkeypatch, dies_after):
    first_arrival(tmp_path)
    up(spark, paths).ingest_available(0)
    second_arrival(tmp_path)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        if dies_after == "fact":
            broken.setattr(Upkeep, "_write", die)
        elif dies_after == "totals":
            broken.setattr(upkeep.Ledger, "publish", die)
        else:  # the ledger has the batch, the stream does not know yet
            publish = upkeep.Ledger.publish
            broken.setattr(upkeep.Ledger, "publish", lambda *a: (publish(*a), die()))
        with pytest.raises(Exception, match="lost"):
            up(spark, paths).ingest_available(1)
    known = {(r.year, r.prescribers) for r in up(spark, paths).market_year().collect()}
    assert known == ({(2023, 2)} if dies_after != "ledger" else {(2023, 2), (2024, 1)})
    up(spark, paths).ingest_available(1)
    check(up(spark, paths))


def test_partials_stay_few_and_exact(spark, paths):
    kept, rows = up(spark, paths), []
    for batch in range(9):
        new = [raw_row(Prscrbr_NPI=str(1 + batch * 7 % 20), Tot_Clms=str(11 + batch))]
        rows += new
        raw = spark.createDataFrame([[r[c] or None for c in RAW_COLUMNS] + [2020 + batch % 2] for r in new], ingest.LANDING_SCHEMA)
        if batch == 5:
            kept.take_batch(raw, batch, 0)  # delivered twice
        kept.take_batch(raw, batch, 0)
        live = kept.ledger.live()
        assert len(live) <= (batch + 1).bit_length() + 1
        assert [p.first for p in live] == [0, *[p.last + 1 for p in live[:-1]]] and live[-1].last == batch
    fact = kept.fact()
    assert fact.count() == 9
    assert sorted(kept.market_year().collect()) == sorted(market_year(fact).collect())
    folders = [f for tier in (spark._jvm.java.io.File(paths.partials).listFiles()) if "tier" in tier.getName() for f in tier.listFiles()]
    assert len([f for f in folders if f.isDirectory()]) == len(live)


def test_totals_of_a_batch_take_one_pass(spark, paths):
    raw = spark.createDataFrame([], ingest.LANDING_SCHEMA)
    plan = upkeep.partial_totals(ingest.typed_fact(raw, DIABETES_RULES))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("Expand", plan)) == 1 and "Join" not in plan and "Union" not in plan


def test_an_empty_batch_and_no_batch(spark, paths):
    kept = up(spark, paths)
    assert kept.market_year().collect() == [] and kept.estimated_prescribers().collect() == []
    kept.take_batch(spark.createDataFrame([], ingest.LANDING_SCHEMA), 0, 0)
    assert kept.ledger.live() == [Partial(0, 0, 0)] and kept.market_year().collect() == []


def test_raw_candidates_keep_the_raw_layout(spark, tmp_path, paths):
    write_year(tmp_path / "landing", 2024, [raw_row(), raw_row(Gnrc_Name="Aspirin")])
    ingest.ingest_available(spark, paths, DIABETES_RULES, ingest.raw_candidates, 0)
    row = spark.read.parquet(paths.sink).collect()
    assert len(row) == 1 and row[0].Tot_30day_Fills == "25.5" and row[0].Tot_Benes == "12"
