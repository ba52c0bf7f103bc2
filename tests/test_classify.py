"""Label decisions under the full ingredient rules."""

import pytest

from utilscope.operators.classify import (
    candidate_filter, classify, included, label_hits, scope_audit, unmapped,
)
from utilscope.rules import DIABETES_RULES, RANKABLE_STATES

GLP1, EXCLUDED = "GLP-1 receptor agonists", "Excluded non-drug device/supply"
LISTED, BRANDED = "generic-name listed", "brand-identifiable"
CASES = [
    ("Metformin Hcl", "Metformin Hcl", "Biguanides", "metformin", False, LISTED),
    ("Metformin Hcl Er", "Metformin Hcl", "Biguanides", "metformin", False, BRANDED),
    ("Ozempic", "Semaglutide", GLP1, "semaglutide", True, BRANDED),
    ("Soliqua 100-33", "Insulin Glargine/Lixisenatide", "Fixed-ratio insulin/GLP-1",
     "insulin|lixisenatide", True, BRANDED),
    ("Glyxambi", "Empagliflozin/Linagliptin", "SGLT2/DPP-4 combination",
     "empagliflozin|linagliptin", False, BRANDED),
    ("Janumet", "Sitagliptin Phos/Metformin Hcl", "DPP-4 inhibitors", "metformin|sitagliptin",
     False, BRANDED),
    ("Symlinpen 60", "Pramlintide Acetate", "Other diabetes therapies", "pramlintide", False, BRANDED),
    ("Trijardy Xr", "Empaglifloz/Linaglip/Metformin", "Biguanides", "metformin", False, BRANDED),
    ("V-Go 20", "Sub-Q Insulin Device, 20 Unit", EXCLUDED, "insulin", False, "not applicable"),
    ("Inpen (For Humalog)", "Insulin Pen,reusable,bt Lispro", EXCLUDED, "insulin", False,
     "not applicable"),
    ("Aspirin", "Aspirin", "Unmapped", "", False, LISTED),
    (None, None, "Unmapped", "", False, LISTED),
]


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(2024, b, g) for b, g, *_ in CASES]
    return spark.createDataFrame(rows, "year int, brand_name string, generic_name string")


def test_decisions(labels):
    decided = {
        (r.brand_name, r.generic_name): (
            r.drug_class, r.matched_terms, r.is_selected_class, r.marketed_name_type
        )
        for r in classify(labels, DIABETES_RULES).collect()
    }
    assert decided == {(b, g): tuple(rest) for b, g, *rest in CASES}


def test_exclusion_wins_over_everything(labels):
    statuses = classify(labels, DIABETES_RULES).groupBy("scope_status").count().collect()
    assert {r.scope_status: r["count"] for r in statuses} == {
        "included": len(CASES) - 2, "excluded_non_drug": 2,
    }


def test_candidates_need_a_term_and_an_allowed_brand(spark):
    rows = [("Wegovy", "Semaglutide"), ("Ozempic", "SEMAGLUTIDE"), ("Aspirin", "Aspirin"),
            ("ZEPBOUND ", "tirzepatide"), (None, "insulin lispro"), ("x", None)]
    kept = candidate_filter(
        spark.createDataFrame(rows, "brand_name string, generic_name string"), DIABETES_RULES
    )
    assert [r.generic_name for r in kept.collect()] == ["SEMAGLUTIDE", "insulin lispro"]


def test_unmapped_labels_are_reported(labels):
    found = unmapped(classify(labels, DIABETES_RULES), DIABETES_RULES).collect()
    assert {r.brand_name for r in found} == {"Aspirin", None}


def test_truncated_combination_is_flagged(labels):
    audit = included(scope_audit(labels, DIABETES_RULES)).filter("has_unrecognized_part").collect()
    assert "Trijardy Xr" in {r.brand_name for r in audit}
    assert "Janumet" not in {r.brand_name for r in audit}


def test_label_hits(labels):
    hits = {(r.generic_name, r.match_term) for r in label_hits(labels, DIABETES_RULES).collect()}
    assert ("Insulin Glargine/Lixisenatide", "lixisenatide") in hits
    assert not any(label == "Aspirin" for label, _ in hits)


def test_state_list():
    assert len(RANKABLE_STATES) == 56 and not {"ZZ", "AA"} & set(RANKABLE_STATES)


def test_rules_without_terms(labels):
    from utilscope.rules import ScopeRules

    decided = classify(labels, ScopeRules(terms=())).select("drug_class", "matched_terms").distinct()
    assert [tuple(r) for r in decided.collect()] == [("Unmapped", "")]
