"""The label dimension and the term index against rules applied row by row."""

import random
import re
from dataclasses import replace

import pytest
from raw_fixture import raw_row

from utilscope.operators import labels
from utilscope.operators.classify import candidate_filter, classify, included, label_hits
from utilscope.operators.clean import rename_raw, standardize
from utilscope.operators.containment import contained_terms
from utilscope.rules import DIABETES_RULES, Term
from utilscope.schema import RAW_COLUMNS

GENERICS = ["Metformin Hcl", "Semaglutide", "Insulin Glargine/Lixisenatide", "Insulin Pen,reusable,bt Lispro",
            "Empagliflozin/Linagliptin", "Aspirin", " Glipizide ", "Pramlintide Acetate", None, ""]
BRANDS = ["Wegovy", "Metformin Hcl", "Brand", None]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [raw_row(Brnd_Name=b, Gnrc_Name=g, Prscrbr_NPI=str(n)) for n in range(3) for b in BRANDS for g in GENERICS]
    schema = ", ".join(f"{c} string" for c in RAW_COLUMNS) + ", year int"
    return spark.createDataFrame([tuple(r[c] for c in RAW_COLUMNS) + (2024,) for r in rows], schema)


@pytest.fixture(scope="module")
def dimension(spark, raw, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("labels") / "dimension")
    labels.label_dimension(rename_raw(raw), DIABETES_RULES).write.parquet(path)
    return spark.read.parquet(path)


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_fact_is_that_of_rules_on_every_row(raw, dimension):
    wanted = included(standardize(candidate_filter(raw, DIABETES_RULES, "Brnd_Name", "Gnrc_Name"), DIABETES_RULES))
    assert dimension.count() == len(GENERICS) * len(BRANDS)
    assert rows(labels.fact_of(raw, dimension)) == rows(wanted) and wanted.count() > 20


def test_rows_get_decisions_by_a_join_of_a_kind_chosen_by_size(spark, raw, dimension):
    small = plan_of(labels.fact_of(raw, dimension))
    assert "BroadcastHashJoin" in small and "semaglutide" not in small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan_of(labels.fact_of(raw, dimension))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


R = DIABETES_RULES
CHANGES = {
    "term added": replace(R, terms=(*R.terms, Term("aspirin", "Other", 5))),
    "term removed": replace(R, terms=R.terms[:-1]),
    "class of a term": replace(R, terms=tuple(replace(t, label_class="X") if t.text == "metformin" else t for t in R.terms)),
    "precedence of a term": replace(R, terms=tuple(replace(t, priority=1) if t.text == "insulin" else t for t in R.terms)),
    "brand allowed": replace(R, excluded_brands=R.excluded_brands[1:]),
    "brand excluded": replace(R, excluded_brands=(*R.excluded_brands, "brand")),
    "pattern added": replace(R, excluded_patterns=(*R.excluded_patterns, "acetate")),
    "combinations": replace(R, combinations=()),
    "selected classes": replace(R, selected_classes=("Insulin",)),
    "order of terms": replace(R, terms=R.terms[::-1]),
}


@pytest.mark.parametrize("change", CHANGES)
def test_a_rule_change_gives_the_dimension_of_the_new_rules(raw, dimension, change):
    after = CHANGES[change]
    assert rows(labels.reclassified(dimension, R, after)) == rows(labels.label_dimension(rename_raw(raw), after))


def test_only_touched_labels_are_classified_again(dimension):
    again = dimension.filter(labels.touched(R, CHANGES["term added"]))
    assert {r.generic_name for r in again.collect()} == {"Aspirin"}
    assert dimension.filter(labels.touched(R, R)).count() == 0
    assert dimension.filter(labels.touched(R, CHANGES["combinations"])).count() == dimension.count()


@pytest.mark.parametrize("q", [1, 3])
def test_contained_terms_are_those_of_all_pairs(spark, q):
    rng = random.Random(q)
    word = lambda most: "".join(rng.choice("ab c") for _ in range(rng.randint(0, most)))
    texts, terms = [word(14) for _ in range(120)] + [None, ""], [word(5) for _ in range(60)] + [None, "", "a", "zzz"]
    found = contained_terms(spark.createDataFrame([(t,) for t in texts], "x string"), "x",
                            spark.createDataFrame([(t,) for t in terms], "y string"), "y", q)
    wanted = {(x, y) for x in texts for y in terms if x and y and y in x}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == wanted and len(got) == len(wanted)
    none = spark.createDataFrame([], "y string")
    assert contained_terms(spark.createDataFrame([("a",)], "x string"), "x", none, "y").collect() == []


def test_exploded_grams_are_never_broadcast(spark):
    """Long and short terms; Spark takes exploded rows for as small as the table that they come from."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("01") for _ in range(24)) for _ in range(80)]
    terms = sorted({t[i:i + n] for t in texts for i, n in [(rng.randint(0, 9), rng.randint(1, 15))]} | {"2", "0123456789"})
    found = contained_terms(spark.createDataFrame([(t,) for t in texts], "x string"), "x",
                            spark.createDataFrame([(t,) for t in terms], "y string"), "y")
    assert "Broadcast" not in plan_of(found) and "NestedLoop" not in plan_of(found)
    assert sorted(map(tuple, found.collect())) == sorted({(x, y) for x in texts for y in terms if y in x})


def test_five_thousand_terms_are_met_by_an_equi_join(spark):
    rng = random.Random(5)
    terms = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 9))) for _ in range(5000)})
    names = [f"{rng.choice(terms)} {rng.choice(terms)} {i}" for i in range(300)]
    rules = replace(R, terms=tuple(Term(t, "C", 1) for t in terms))
    df = spark.createDataFrame([(n,) for n in names], "generic_name string")
    found = label_hits(df, rules)
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {tuple(r) for r in found.collect()} == {(n, t) for n in names for t in terms if t in n}
    assert not re.search(r"array<struct<term", plan)


def test_classify_is_unchanged_for_a_dimension(dimension):
    again = classify(dimension.select("brand_name", "generic_name"), DIABETES_RULES)
    assert rows(again) == rows(dimension.select(again.columns))
