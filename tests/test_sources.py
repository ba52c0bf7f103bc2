"""Strict CSV scan, cleaning to the fact, other sources and sinks."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from raw_fixture import csv_text, raw_row, write_year

from utilscope.operators.clean import RejectedRows, rejected_rows, require_integral, standardize
from utilscope.rules import DIABETES_RULES, INGREDIENT_CLASSES, ScopeRules, parse_terms
from utilscope.schema import FACT_COLUMNS, RAW_COLUMNS
from utilscope.streaming import ingest
from utilscope.sources import files, manifest, rule_files


def scan(spark, tmp_path, text, encoding="utf-8"):
    (tmp_path / "x_2024.csv").write_text(text, encoding=encoding)
    return files.read_strict_csv(spark, str(tmp_path / "x_2024.csv"))


def test_reads_quotes_and_blanks(spark, tmp_path):
    rows = [raw_row(Prscrbr_Last_Org_Name='O"Neil, Jr', Tot_Benes="")]
    row = scan(spark, tmp_path, csv_text(rows)).first()
    assert row.Prscrbr_Last_Org_Name == 'O"Neil, Jr' and row.Tot_Benes is None
    assert row.Tot_30day_Fills == "25.5"


def test_byte_order_mark_is_accepted(spark, tmp_path):
    assert scan(spark, tmp_path, csv_text([raw_row()]), "utf-8-sig").count() == 1
    assert scan(spark, tmp_path, csv_text([raw_row()]), "utf-8-sig").first().Prscrbr_NPI == "1003000126"


@pytest.mark.parametrize("damage", ["swapped", "renamed", "short", "long"])
def test_wrong_layout_fails(spark, tmp_path, damage):
    header = list(RAW_COLUMNS)
    if damage == "swapped":
        header[0], header[1] = header[1], header[0]
    if damage == "renamed":
        header[3] = "City"
    text = csv_text([raw_row()], header)
    if damage == "short":
        text += ",".join(["1"] * 21) + "\n"
    if damage == "long":
        text += ",".join(["1"] * 23) + "\n"
    with pytest.raises((PySparkException, Py4JJavaError)):
        scan(spark, tmp_path, text).collect()


@pytest.mark.parametrize("fields", [9, 25])
@pytest.mark.parametrize("query", [
    lambda df: df.count(), lambda df: df.select("Gnrc_Name").collect(), lambda df: df.groupBy("Brnd_Name").count().collect(),
])
def test_a_damaged_row_fails_queries_of_few_columns(spark, tmp_path, fields, query):
    text = csv_text([raw_row()]) + ",".join(["Semaglutide"] * fields) + "\n"
    with pytest.raises((PySparkException, Py4JJavaError)):
        query(scan(spark, tmp_path, text))


def test_a_damaged_row_fails_the_stream(spark, tmp_path):
    folder = tmp_path / "landing" / "year=2024"
    folder.mkdir(parents=True)
    (folder / "x.csv").write_text(csv_text([raw_row()]) + ",".join(["Semaglutide"] * 9) + "\n")
    root = tmp_path
    paths = ingest.IngestPaths(f"{root}/landing", f"{root}/sink", f"{root}/checkpoint", f"{root}/partials")
    narrow = lambda raw, rules: raw.select("Gnrc_Name", "year")
    with pytest.raises((PySparkException, Py4JJavaError)):
        ingest.ingest_available(spark, paths, DIABETES_RULES, narrow, 0)


def test_year_from_file_name(spark, tmp_path):
    assert files.stamp_year(scan(spark, tmp_path, csv_text([raw_row()]))).first().year == 2024


def test_standardize(spark, tmp_path):
    rows = [
        raw_row(Prscrbr_NPI="7", Prscrbr_Type="\tMD ", Tot_Clms=" 12 ", Tot_Benes="", Tot_30day_Fills="0"),
        raw_row(Prscrbr_NPI="1003000126.0", Tot_Clms="1e3", Tot_30day_Fills="inf", Tot_Drug_Cst="NaN"),
    ]
    raw = files.stamp_year(scan(spark, tmp_path, csv_text(rows)))
    fact = standardize(raw, DIABETES_RULES)
    assert fact.columns == FACT_COLUMNS and len(FACT_COLUMNS) == 32
    seven, other = fact.orderBy("provider_npi").collect()
    assert (seven.provider_npi, seven.provider_masked_id) == ("0000000007", "NPI-******0007")
    assert (seven.provider_specialty, seven.total_claims) == ("MD", 12)
    assert seven.total_beneficiaries is None and seven.beneficiary_count_suppressed
    assert seven.cost_per_30day_fill is None and seven.cost_per_claim == 1000.10 / 12
    assert (other.provider_npi, other.total_claims) == ("1003000126", 1000)
    assert other.total_30day_fills is None and other.total_drug_cost is None
    assert (seven.year, seven.drug_class, seven.is_selected_class) == (2024, "GLP-1 receptor agonists", True)
    assert seven.age65_suppression_flag == "" and seven.age65_total_claims is None


def test_fraction_in_integer_column_is_rejected(spark, tmp_path):
    raw = scan(spark, tmp_path, csv_text([raw_row(), raw_row(Tot_Day_Suply="12.5")]))
    assert rejected_rows(raw).count() == 1
    with pytest.raises(RejectedRows):
        require_integral(raw)
    good = raw.filter(F.col("Tot_Day_Suply") == "600")
    assert require_integral(good) is good


def test_manifest(spark, tmp_path):
    rows = [raw_row(), raw_row(Brnd_Name="Wegovy"), raw_row(Gnrc_Name="Aspirin"),
            raw_row(Gnrc_Name="Insulin Pump Cartridge", Tot_Benes="")]
    write_year(tmp_path / "in", 2024, rows)
    write_year(tmp_path / "in", 2023, [raw_row(Gnrc_Name="Aspirin")])
    raw = files.read_strict_csv(spark, str(tmp_path / "in"))
    grouped = manifest.extract_counts(raw, DIABETES_RULES)
    observed = manifest.extract(raw, DIABETES_RULES, [2023, 2024], str(tmp_path / "out"))
    assert sorted(observed.collect()) == sorted(grouped.collect())
    counts = grouped.filter("year = 2024").first()
    assert (counts.source_rows_scanned, counts.candidate_rows, counts.excluded_rows) == (4, 2, 1)
    kept = manifest.read_extract(raw, str(tmp_path / "out"))
    assert sorted(r.Gnrc_Name for r in kept.collect()) == ["Insulin Pump Cartridge", "Semaglutide"]
    row = manifest.manifest(observed, DIABETES_RULES).filter("year = 2024").first()
    assert (row.filtered_row_count, row.column_count, row.excluded_brands) == (2, 22, "saxenda|wegovy|zepbound")
    shuffled = raw.repartition(3).orderBy(F.rand(1))
    assert sorted(manifest.extract_counts(shuffled, DIABETES_RULES).collect()) == sorted(grouped.collect())
    size = files.file_sizes(spark, str(tmp_path / "in")).filter("year = 2024").first()
    assert size.source_bytes_scanned == (tmp_path / "in/year=2024/extract.csv").stat().st_size


def scanned(spark, landing, out):
    raw = files.read_strict_csv(spark, str(landing))
    counts = manifest.extract(raw, DIABETES_RULES, [2023, 2024], str(out))
    return counts, manifest.file_counts(spark, str(out), str(landing))


def test_file_counts_add_up_and_name_a_damaged_file(spark, tmp_path):
    landing = tmp_path / "in"
    write_year(landing, 2023, [raw_row(), raw_row(Gnrc_Name="Aspirin"), raw_row(Prscrbr_NPI="9")])
    folder = landing / "year=2024"
    folder.mkdir()
    for name, rows in {"a": [raw_row()] * 3, "b": [raw_row(), raw_row(Gnrc_Name="Aspirin")], "bare": [], "c d": [raw_row(Prscrbr_NPI="8")]}.items():
        (folder / f"{name}.csv").write_text(csv_text(rows))
    counts, by_file = scanned(spark, landing, tmp_path / "one")
    rows = {r.file.split("/")[-1].replace("%20", " "): r for r in by_file.collect()}
    assert {n: (r.source_rows_scanned, r.candidate_rows) for n, r in rows.items()} == {
        "extract.csv": (3, 2), "a.csv": (3, 3), "b.csv": (2, 1), "bare.csv": (0, 0), "c d.csv": (1, 1)}
    assert rows["bare.csv"].bytes > 0 and rows["bare.csv"].fingerprint is None
    by_year = {r.year: r for r in counts.collect()}
    assert (by_year[2024].source_rows_scanned, by_year[2024].candidate_rows) == (6, 5)
    assert int(by_year[2024].fingerprint) == sum(int(r.fingerprint or 0) for r in rows.values() if r.year == 2024)

    (folder / "a.csv").write_text(csv_text([raw_row()] * 2))
    (folder / "b.csv").write_text(csv_text([raw_row(Tot_Clms="99"), raw_row(Gnrc_Name="Aspirin")]))
    (folder / "new.csv").write_text(csv_text([raw_row()]))
    (folder / "c d.csv").unlink()
    _, now = scanned(spark, landing, tmp_path / "two")
    wrong = manifest.differing_files(by_file, now).collect()
    assert sorted((r.file.split("/")[-1].replace("%20", " "), r.difference, r.rows_expected, r.rows_found) for r in wrong) == [
        ("a.csv", "short", 3, 2), ("b.csv", "changed", 2, 2), ("c d.csv", "missing", 1, None), ("new.csv", "extra", None, 1)]


def test_an_extract_without_candidates_or_files_of_a_year(spark, tmp_path):
    write_year(tmp_path / "in", 2024, [raw_row(Gnrc_Name="Aspirin")])
    counts, by_file = scanned(spark, tmp_path / "in", tmp_path / "out")
    assert {tuple(r) for r in counts.collect()} == {(2023, 0, 0, 0, None), (2024, 1, 0, 0, None)}
    raw = files.read_strict_csv(spark, str(tmp_path / "in"))
    assert manifest.read_extract(raw, str(tmp_path / "out")).count() == 0


def test_the_extract_reads_the_raw_text_once(spark, tmp_path):
    """Counters and rows in scope come from one scan; reading the rows in scope opens no other folder."""
    write_year(tmp_path / "in", 2024, [raw_row(), raw_row(Gnrc_Name="Aspirin")])
    raw = files.read_strict_csv(spark, str(tmp_path / "in"))
    counts = manifest.extract(raw, DIABETES_RULES, [2024], str(tmp_path / "out"))
    kept = manifest.read_extract(raw, str(tmp_path / "out"))
    assert "csv" not in counts._jdf.queryExecution().executedPlan().toString().lower()
    assert [f for f in kept.inputFiles() if "_kept=false" not in f] and "PartitionFilters: [isnotnull(_kept" in (
        kept._jdf.queryExecution().executedPlan().toString())


def test_fact_roundtrip_is_partitioned(spark, tmp_path):
    write_year(tmp_path / "in", 2023, [raw_row()])
    write_year(tmp_path / "in", 2024, [raw_row(), raw_row(Prscrbr_NPI="8")])
    fact = standardize(files.read_strict_csv(spark, str(tmp_path / "in")), DIABETES_RULES)
    for balance in (False, True):
        files.write_fact(fact, str(tmp_path / "out"), balance)
        back = files.read_fact(spark, str(tmp_path / "out"))
        assert sorted(p.name for p in (tmp_path / "out").glob("year=*")) == ["year=2023", "year=2024"]
        assert sorted(back.select(FACT_COLUMNS).collect()) == sorted(fact.collect())
        pruned = back.filter("year = 2024").select("total_claims")
        assert "total_drug_cost" not in pruned._jdf.queryExecution().executedPlan().toString()
        assert pruned.count() == 2


def test_json_records(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", float("nan"), 1), ("b", float("inf"), None), ("c", 2.5, 3)], "k string, v double, n int"
    )
    files.write_json_records(df, str(tmp_path / "j"))
    back = files.read_json_records(spark, str(tmp_path / "j"), df.schema)
    assert {r.k: r.v for r in back.collect()} == {"a": None, "b": None, "c": 2.5}
    lines = "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    assert '"n":null' in lines and "NaN" not in lines


def test_rule_files(spark, tmp_path):
    (tmp_path / "map.csv").write_text(
        "match_term,component_class,priority,notes\n"
        + "".join(f"{line},note\n" for line in INGREDIENT_CLASSES.strip().splitlines())
    )
    (tmp_path / "brands.txt").write_text("# comment\n\n  WEGOVY \nSaxenda\nsaxenda!\n")
    terms = rule_files.load_terms(spark, str(tmp_path / "map.csv"))
    assert terms == parse_terms(INGREDIENT_CLASSES) == DIABETES_RULES.terms and len(terms) == 30
    assert rule_files.load_term_list(spark, str(tmp_path / "brands.txt")) == ("saxenda", "wegovy")
    assert ScopeRules(terms=terms).by_priority()[0].text == "tirzepatide"


def test_rule_inputs_from_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("requires,label_class\nA|B,Both\nC,Alone\n")
    (tmp_path / "s.txt").write_text("# states\n\n FL \nCA\n")
    (tmp_path / "w.json").write_text('{"p": {"scale": 1, "growth": 0, "class_gap": 0.5, "completeness": 0}}')
    (tmp_path / "bad.json").write_text('{"p": {"scale": 1}}')
    pairs = [(c.requires, c.label_class) for c in rule_files.load_combinations(spark, str(tmp_path / "c.csv"))]
    assert pairs == [(("A", "B"), "Both"), (("C",), "Alone")]
    assert rule_files.load_lines(spark, str(tmp_path / "s.txt")) == ("FL", "CA")
    assert rule_files.load_weights(spark, str(tmp_path / "w.json")).scenarios["p"]["class_gap"] == 0.5
    with pytest.raises(ValueError):
        rule_files.load_weights(spark, str(tmp_path / "bad.json"))
