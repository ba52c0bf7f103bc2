"""Scope rules as data: which labels are in the market and which class they carry.

A rule set is small configuration (tens of terms).  It is held on the driver and
compiled into plain column expressions, so applying it never needs a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Term:
    """An ingredient term, the class it points to and its precedence (low wins)."""

    text: str
    label_class: str
    priority: int


@dataclass(frozen=True)
class Combination:
    """A class given to labels whose terms cover all of `requires`."""

    requires: tuple[str, ...]
    label_class: str


@dataclass(frozen=True)
class ScopeRules:
    terms: tuple[Term, ...]
    combinations: tuple[Combination, ...] = ()
    excluded_patterns: tuple[str, ...] = ()
    excluded_brands: tuple[str, ...] = ()
    selected_classes: tuple[str, ...] = ()
    excluded_class: str = "Excluded non-drug device/supply"
    excluded_term: str = "insulin"
    unmapped_class: str = "Unmapped"

    def by_priority(self) -> list[Term]:
        """Terms in precedence order; equal priorities keep their file order."""
        return sorted(self.terms, key=lambda term: term.priority)

    def distinct_terms(self) -> list[str]:
        return sorted({term.text for term in self.terms})


@dataclass(frozen=True)
class ScoreWeights:
    """Scenario name -> weight of each opportunity component."""

    scenarios: dict[str, dict[str, float]] = field(default_factory=dict)


COMPONENTS = ("scale", "growth", "class_gap", "completeness")

# The ingredient map (term, class, priority), combinations, selected classes,
# exclusion lists, score weights and state codes.  Results depend on these exact words and numbers.
INGREDIENT_CLASSES = """
tirzepatide,GLP-1 receptor agonists,10
semaglutide,GLP-1 receptor agonists,10
dulaglutide,GLP-1 receptor agonists,10
liraglutide,GLP-1 receptor agonists,10
exenatide,GLP-1 receptor agonists,10
lixisenatide,GLP-1 receptor agonists,10
canagliflozin,SGLT2 inhibitors,20
dapagliflozin,SGLT2 inhibitors,20
empagliflozin,SGLT2 inhibitors,20
ertugliflozin,SGLT2 inhibitors,20
bexagliflozin,SGLT2 inhibitors,20
sitagliptin,DPP-4 inhibitors,30
linagliptin,DPP-4 inhibitors,30
saxagliptin,DPP-4 inhibitors,30
alogliptin,DPP-4 inhibitors,30
insulin,Insulin,40
metformin,Biguanides,50
glimepiride,Sulfonylureas,60
glipizide,Sulfonylureas,60
glyburide,Sulfonylureas,60
chlorpropamide,Sulfonylureas,60
tolazamide,Sulfonylureas,60
tolbutamide,Sulfonylureas,60
pioglitazone,Thiazolidinediones,70
rosiglitazone,Thiazolidinediones,70
repaglinide,Other diabetes therapies,80
nateglinide,Other diabetes therapies,80
acarbose,Other diabetes therapies,80
miglitol,Other diabetes therapies,80
pramlintide,Other diabetes therapies,80
"""
COMBINATIONS = (
    Combination(("Insulin", "GLP-1 receptor agonists"), "Fixed-ratio insulin/GLP-1"),
    Combination(("SGLT2 inhibitors", "DPP-4 inhibitors"), "SGLT2/DPP-4 combination"),
)
SELECTED_CLASSES = ("GLP-1 receptor agonists", "Fixed-ratio insulin/GLP-1")
EXCLUDED_BRANDS = ("wegovy", "saxenda", "zepbound")
EXCLUDED_GENERIC_PATTERNS = (
    "insulin pump", "insulin device", "syringe", "pen reusable",
    "insulin administration supplies", "insulin delivery device",
)
OPPORTUNITY_WEIGHTS = ScoreWeights({
    "primary": {"scale": 0.35, "growth": 0.25, "class_gap": 0.25, "completeness": 0.15},
    "growth_led": {"scale": 0.25, "growth": 0.40, "class_gap": 0.20, "completeness": 0.15},
    "gap_led": {"scale": 0.25, "growth": 0.20, "class_gap": 0.40, "completeness": 0.15},
})
US_STATE_CODES = (
    "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN "
    "MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA "
    "WV WI WY PR VI GU AS MP AA AE AP ZZ"
).split()
NON_GEOGRAPHIC_STATE_CODES = ("ZZ", "AA", "AE", "AP")
# End of fixed values.

RANKABLE_STATES = tuple(c for c in US_STATE_CODES if c not in NON_GEOGRAPHIC_STATE_CODES)


def parse_terms(text: str) -> tuple[Term, ...]:
    """`term,class,priority` lines to terms, in file order."""
    rows = (line.split(",") for line in text.strip().splitlines())
    return tuple(Term(term, label_class, int(priority)) for term, label_class, priority in rows)


DIABETES_RULES = ScopeRules(
    terms=parse_terms(INGREDIENT_CLASSES),
    combinations=COMBINATIONS,
    excluded_patterns=EXCLUDED_GENERIC_PATTERNS,
    excluded_brands=EXCLUDED_BRANDS,
    selected_classes=SELECTED_CLASSES,
)
