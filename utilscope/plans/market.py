"""The market tables that most reports share, each written once per workspace."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilscope.operators import aggregates, concentration, cube, headline, opportunity, prescribers, ranking
from utilscope.operators.ranking import RankedValues
from utilscope.rules import DIABETES_RULES, OPPORTUNITY_WEIGHTS, RANKABLE_STATES, ScopeRules, ScoreWeights
from utilscope.workspace import Workspace

FILLS = "total_30day_fills"


@dataclass(frozen=True)
class MarketSettings:
    years: list[int]
    rules: ScopeRules = DIABETES_RULES
    ranked_states: tuple[str, ...] = RANKABLE_STATES
    weights: ScoreWeights = field(default_factory=lambda: OPPORTUNITY_WEIGHTS)
    kept_specialties: int = 40
    outlier_min_fills: float = 50
    outlier_percentile: float = 0.999

    @property
    def first_year(self) -> int:
        return min(self.years)

    @property
    def latest_year(self) -> int:
        return max(self.years)


class Market:
    """A fact and the tables derived from it.

    The fact, the provider ranking, the cube, the yearly aggregates and the scores are written
    to the workspace on first use; everything else is a plan over them.  A fact that is stored already (`stored`) is read
    where it lies.
    """

    def __init__(
        self, workspace: Workspace, build_fact: Callable[[], DataFrame], settings: MarketSettings,
        stored: bool = False,
    ):
        self.workspace = workspace
        self.settings = settings
        self._build_fact, self._stored = build_fact, stored
        self._order: RankedValues | None = None

    @property
    def fact(self) -> DataFrame:
        if self._stored:
            return self._build_fact()
        return self.workspace.table("fact", self._build_fact, ["year"])

    @property
    def provider_order(self) -> RankedValues:
        """Providers of each year by descending fills, the identifier breaking ties."""
        if self._order is None:
            totals = aggregates.provider_totals(self.fact)
            self._order = RankedValues(
                self.workspace, "providers", totals, ["year"], FILLS, ["provider_npi"]
            )
        return self._order

    def provider_deciles(self) -> DataFrame:
        return ranking.volume_deciles(self.provider_order)

    def provider_year(self) -> DataFrame:
        """Provider totals with their volume decile and percentile."""
        return ranking.volume_ranks(self.provider_order)

    def provider_percentile(self) -> DataFrame:
        return ranking.volume_percentile(self.provider_order)

    @property
    def cube(self) -> DataFrame:
        return self.workspace.table(
            "cube", lambda: aggregates.dashboard_cube(self.fact, self.provider_deciles())
        )

    @property
    def prescriber_cube(self) -> DataFrame:
        """Bits and sketches of the prescribers of the cube's cells."""
        def build() -> DataFrame:
            deciles = self.provider_deciles()
            return prescribers.prescriber_cube(
                self.fact, deciles, prescribers.provider_numbers(self.workspace, deciles)
            )

        return self.workspace.table("prescriber_cube", build)

    def prescriber_cells(self) -> DataFrame:
        """Prescriber cube with the smaller specialties merged, as `collapsed`."""
        return self._collapse(self.prescriber_cube)

    def market_year(self) -> DataFrame:
        return self.workspace.table("market_year", lambda: aggregates.market_year(self.fact))

    def class_year(self) -> DataFrame:
        return self.workspace.table("class_year", lambda: aggregates.class_year(self.fact))

    def product_year(self) -> DataFrame:
        return self.workspace.table("product_year", lambda: aggregates.product_year(self.fact))

    def state_year(self) -> DataFrame:
        return self.workspace.table("state_year", lambda: aggregates.segment_year(self.fact, "provider_state"))

    def specialty_year(self) -> DataFrame:
        return self.workspace.table("specialty_year", lambda: aggregates.segment_year(self.fact, "provider_specialty"))

    def city_year(self) -> DataFrame:
        return self.workspace.table("city_year", lambda: aggregates.city_year(self.fact))

    def ranked_states(self) -> DataFrame:
        return opportunity.allow_listed(
            self.state_year(), "provider_state", self.settings.ranked_states
        )

    def collapsed(self) -> DataFrame:
        """Cube with the smaller specialties merged, cells not yet regrouped."""
        return self._collapse(self.cube)

    def _collapse(self, cells: DataFrame) -> DataFrame:
        return ranking.collapse_rare(
            cells, self.specialty_year(), "provider_specialty", FILLS,
            self.settings.kept_specialties, "Other specialties",
        )

    def cube_collapsed(self) -> DataFrame:
        return self.workspace.table("cube_collapsed", lambda: cube.cube_collapsed(self.collapsed()))

    def dictionaries(self) -> DataFrame:
        """Codes of the collapsed cube's labels."""
        return self.workspace.table("dictionaries", lambda: cube.dictionaries(self.cube_collapsed()))

    def opportunity(self, segments: DataFrame, dimension: str) -> DataFrame:
        s = self.settings
        return opportunity.opportunity_table(
            self.workspace, segments, dimension, s.first_year, s.latest_year, s.weights
        )

    def state_opportunity(self) -> DataFrame:
        return self.workspace.table(
            "state_opportunity", lambda: self.opportunity(self.ranked_states(), "provider_state")
        )

    def specialty_opportunity(self, k: int = 60) -> DataFrame:
        table = self.workspace.table(
            "specialty_opportunity", lambda: self.opportunity(self.specialty_year(), "provider_specialty")
        )
        return ranking.leaders(table, "score_primary", ["provider_specialty"], k)

    def concentration(self) -> DataFrame:
        return concentration.concentration(self.provider_order, 1)

    def outlier_review(self, k: int = 25) -> DataFrame:
        """Highest unit costs of the latest year among cells of a minimum volume."""
        s = self.settings
        cost = F.col("cost_per_30day_fill")
        scored = self.fact.filter(
            (F.col("year") == s.latest_year) & (F.col(FILLS) >= s.outlier_min_fills) & cost.isNotNull()
        ).select("provider_masked_id", "brand_name", "generic_name", FILLS, cost)
        return ranking.top_percentile(
            scored, "cost_per_30day_fill",
            ["provider_masked_id", "brand_name", "generic_name"], s.outlier_percentile, k,
        )

    def headline_leaders(self) -> DataFrame:
        return headline.headline_leaders(
            self.class_year(), self.product_year(), self.state_year(), self.specialty_year(),
            self.settings.latest_year,
        )

    def headline_metrics(self) -> DataFrame:
        return headline.headline_metrics(
            self.market_year(), self.headline_leaders(), self.concentration(),
            self.state_opportunity(), "provider_state", self.settings.latest_year,
        )
