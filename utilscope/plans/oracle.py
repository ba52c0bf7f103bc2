"""The same questions as plain SQL over the star tables, one statement per catalog entry.

Common table expressions rebuild the raw extract, the labels and the fact; labels are
classified by joining them to the rule rows, unlike the column expressions of the library.
"""

from __future__ import annotations

from utilscope.schema import RAW_COLUMNS

#: Reporting years of the test tables; they name columns.
YEARS = list(range(1995, 2002))
FIRST, LATEST = YEARS[0], YEARS[-1]
PERIODS = LATEST - FIRST

BASE = r"""
WITH rules(term, class, priority, position) AS (VALUES
  ('hot','H',10,1), ('widget','W',20,2), ('cold','C',30,3), ('gear','G',40,4), ('ring','R',50,5),
  ('rod','D',60,6), ('plate','P',70,7), ('gizmo','Z',80,8), ('bolt','B',80,9)),
part_labels AS (
  SELECT p_partkey, CASE WHEN p_size <= 10 THEN p_name ELSE p_brand END AS brand_name,
         p_name AS generic_name
  FROM part),
pairs AS (SELECT DISTINCT brand_name, generic_name FROM part_labels),
norms AS (
  SELECT brand_name, generic_name,
         trim(regexp_replace(lower(brand_name), '[^a-z0-9]+', ' ', 'g')) AS brand_norm,
         trim(regexp_replace(lower(generic_name), '[^a-z0-9]+', ' ', 'g')) AS generic_norm
  FROM pairs),
hits AS (
  SELECT n.brand_name, n.generic_name, count(term) AS n_hits,
         coalesce(string_agg(term, '|' ORDER BY term), '') AS terms,
         coalesce(bool_or(class = 'G'), false) AND bool_or(class = 'H') AS gh,
         coalesce(bool_or(class = 'W'), false) AND bool_or(class = 'C') AS wc,
         arg_min(class, priority * 100 + position) AS first_class
  FROM norms n LEFT JOIN rules r ON contains(n.generic_norm, r.term)
  GROUP BY ALL),
labels AS (
  SELECT n.brand_name, n.generic_name, n.brand_norm, n.generic_norm, n_hits,
         contains(generic_norm, 'anvil') AS device,
         n_hits > 0 AND brand_norm <> 'brand 13' AS candidate,
         CASE WHEN device THEN 'Excluded non-drug device/supply' WHEN gh THEN 'Fixed G/H'
              WHEN wc THEN 'W/C combination' ELSE coalesce(first_class, 'Unmapped') END AS drug_class,
         CASE WHEN device THEN 'anvil' ELSE terms END AS matched_terms,
         CASE WHEN device THEN 'not applicable' WHEN brand_norm = generic_norm
              THEN 'generic-name listed' ELSE 'brand-identifiable' END AS marketed_name_type,
         CASE WHEN device THEN 'excluded_non_drug' ELSE 'included' END AS scope_status,
         NOT device AND drug_class IN ('H', 'Fixed G/H') AS is_selected_class
  FROM norms n JOIN hits h USING (brand_name, generic_name)),
lines AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey, o_orderkey, c_nationkey, n_name,
         c_mktsegment, brand_name, generic_name, l_quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price, l_linestatus = 'F' AS old
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part_labels ON l_partkey = p_partkey),
cells AS (
  SELECT year, o_custkey, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS provider_npi,
         'Customer, ' || o_custkey AS provider_last_org_name, '' AS provider_first_name,
         n_name || ' ' || (o_custkey % 20) AS provider_city, n_name AS provider_state,
         CAST(c_nationkey AS VARCHAR) AS provider_state_fips,
         CASE WHEN o_custkey % 97 = 0 THEN '' ELSE c_mktsegment END AS provider_specialty,
         'S' AS provider_type_source, brand_name, generic_name,
         count(*) AS total_claims, sum(l_quantity) AS total_30day_fills,
         CAST(sum(l_quantity) AS BIGINT) * 30 AS total_day_supply,
         sum(price) AS cost,
         CASE WHEN sum(l_quantity) >= 11 THEN count(DISTINCT o_orderkey) END AS total_beneficiaries,
         CASE WHEN bool_or(old) THEN '' ELSE '*' END AS age65_suppression_flag,
         CASE WHEN bool_or(old) THEN count(*) FILTER (old) END AS age65_total_claims,
         sum(l_quantity) FILTER (old) AS age65_total_30day_fills,
         sum(price) FILTER (old) AS age65_cost,
         CAST(sum(l_quantity) FILTER (old) AS BIGINT) * 30 AS age65_total_day_supply
  FROM lines GROUP BY year, o_custkey, n_name, c_nationkey, c_mktsegment, brand_name, generic_name),
raw AS (
  SELECT CASE WHEN o_custkey % 7 = 0 THEN o_custkey || '.0' ELSE CAST(o_custkey AS VARCHAR) END
           AS Prscrbr_NPI,
         provider_last_org_name AS Prscrbr_Last_Org_Name, provider_first_name AS Prscrbr_First_Name,
         ' ' || provider_city || ' ' AS Prscrbr_City, provider_state AS Prscrbr_State_Abrvtn,
         provider_state_fips AS Prscrbr_State_FIPS, provider_specialty AS Prscrbr_Type,
         provider_type_source AS Prscrbr_Type_Src, brand_name AS Brnd_Name, generic_name AS Gnrc_Name,
         CAST(total_claims AS VARCHAR) AS Tot_Clms,
         CAST(CAST(total_30day_fills AS DECIMAL(18,1)) AS VARCHAR) AS Tot_30day_Fills,
         CAST(total_day_supply AS VARCHAR) AS Tot_Day_Suply, CAST(cost AS VARCHAR) AS Tot_Drug_Cst,
         coalesce(CAST(total_beneficiaries AS VARCHAR), '') AS Tot_Benes,
         age65_suppression_flag AS GE65_Sprsn_Flag,
         coalesce(CAST(age65_total_claims AS VARCHAR), '') AS GE65_Tot_Clms,
         coalesce(CAST(CAST(age65_total_30day_fills AS DECIMAL(18,1)) AS VARCHAR), '')
           AS GE65_Tot_30day_Fills,
         coalesce(CAST(age65_cost AS VARCHAR), '') AS GE65_Tot_Drug_Cst,
         coalesce(CAST(age65_total_day_supply AS VARCHAR), '') AS GE65_Tot_Day_Suply,
         '#' AS GE65_Bene_Sprsn_Flag, '' AS GE65_Tot_Benes, year
  FROM cells),
candidates AS (
  SELECT provider_npi, provider_last_org_name, provider_first_name, provider_city, provider_state,
         provider_state_fips, provider_specialty, provider_type_source, c.brand_name,
         c.generic_name, total_claims, total_30day_fills, total_day_supply,
         CAST(cost AS DOUBLE) AS total_drug_cost, total_beneficiaries, age65_suppression_flag,
         age65_total_claims, age65_total_30day_fills, CAST(age65_cost AS DOUBLE) AS age65_total_drug_cost,
         age65_total_day_supply, '#' AS age65_bene_suppression_flag,
         CAST(NULL AS BIGINT) AS age65_total_beneficiaries,
         'NPI-******' || right(provider_npi, 4) AS provider_masked_id, drug_class, matched_terms,
         is_selected_class, marketed_name_type, scope_status,
         CAST(cost AS DOUBLE) / total_claims AS cost_per_claim,
         CASE WHEN total_30day_fills <> 0 THEN CAST(cost AS DOUBLE) / total_30day_fills END
           AS cost_per_30day_fill,
         total_beneficiaries IS NULL AS beneficiary_count_suppressed, year
  FROM cells c JOIN labels l ON c.brand_name = l.brand_name AND c.generic_name = l.generic_name
  WHERE candidate),
fact AS (SELECT * FROM candidates WHERE scope_status = 'included'),
exact AS (
  SELECT *, CAST(total_drug_cost AS DECIMAL(18,2)) AS cost,
         CASE WHEN is_selected_class THEN total_30day_fills ELSE 0 END AS selected
  FROM fact),
market AS (
  SELECT year, CAST(sum(total_claims) AS BIGINT) AS total_claims,
         sum(total_30day_fills) AS total_30day_fills, CAST(sum(cost) AS DOUBLE) AS total_drug_cost,
         count(DISTINCT provider_npi) AS prescribers,
         count(DISTINCT (brand_name, generic_name)) AS products,
         CAST(sum(cost) AS DOUBLE) / sum(total_claims) AS avg_cost_per_claim,
         CAST(sum(cost) AS DOUBLE) / nullif(sum(total_30day_fills), 0) AS avg_cost_per_30day_fill,
         sum(selected) / nullif(sum(total_30day_fills), 0) AS selected_class_share
  FROM exact GROUP BY year),
classes AS (
  SELECT year, drug_class, CAST(sum(total_claims) AS BIGINT) AS total_claims,
         sum(total_30day_fills) AS total_30day_fills, CAST(sum(cost) AS DOUBLE) AS total_drug_cost,
         count(DISTINCT provider_npi) AS prescribers,
         sum(total_30day_fills) / nullif(sum(sum(total_30day_fills)) OVER (PARTITION BY year), 0)
           AS fill_share
  FROM exact GROUP BY year, drug_class),
products AS (
  SELECT year, drug_class, brand_name, generic_name, marketed_name_type,
         CAST(sum(total_claims) AS BIGINT) AS total_claims,
         sum(total_30day_fills) AS total_30day_fills, CAST(sum(cost) AS DOUBLE) AS total_drug_cost,
         count(DISTINCT provider_npi) AS prescribers,
         CAST(sum(cost) AS DOUBLE) / sum(total_claims) AS avg_cost_per_claim,
         CAST(sum(cost) AS DOUBLE) / nullif(sum(total_30day_fills), 0) AS avg_cost_per_30day_fill
  FROM exact GROUP BY ALL),
states AS (
  SELECT year, coalesce(nullif(provider_state, ''), 'Unknown') AS provider_state,
         CAST(sum(total_claims) AS BIGINT) AS total_claims,
         sum(total_30day_fills) AS total_30day_fills, CAST(sum(cost) AS DOUBLE) AS total_drug_cost,
         count(DISTINCT provider_npi) AS prescribers, sum(selected) AS selected_class_fills,
         sum(CASE WHEN total_beneficiaries IS NOT NULL THEN total_claims ELSE 0 END)::DOUBLE
           / sum(total_claims)::DOUBLE AS beneficiary_completeness
  FROM exact GROUP BY 1, 2),
specialties AS (
  SELECT year, coalesce(nullif(provider_specialty, ''), 'Unknown') AS provider_specialty,
         CAST(sum(total_claims) AS BIGINT) AS total_claims,
         sum(total_30day_fills) AS total_30day_fills, CAST(sum(cost) AS DOUBLE) AS total_drug_cost,
         count(DISTINCT provider_npi) AS prescribers, sum(selected) AS selected_class_fills,
         sum(CASE WHEN total_beneficiaries IS NOT NULL THEN total_claims ELSE 0 END)::DOUBLE
           / sum(total_claims)::DOUBLE AS beneficiary_completeness
  FROM exact GROUP BY 1, 2),
cities AS (
  SELECT year, provider_state, provider_city, CAST(sum(total_claims) AS BIGINT) AS total_claims,
         sum(total_30day_fills) AS total_30day_fills, CAST(sum(cost) AS DOUBLE) AS total_drug_cost,
         count(DISTINCT provider_npi) AS prescribers
  FROM exact GROUP BY 1, 2, 3),
provider_sums AS (
  SELECT year, provider_npi, provider_masked_id, min(provider_state) AS provider_state,
         min(provider_city) AS provider_city, min(provider_specialty) AS provider_specialty,
         CAST(sum(total_claims) AS BIGINT) AS total_claims,
         sum(total_30day_fills) AS total_30day_fills, CAST(sum(cost) AS DOUBLE) AS total_drug_cost,
         sum(selected) AS selected_class_fills
  FROM exact GROUP BY year, provider_npi, provider_masked_id),
providers AS (
  SELECT *,
         CAST(ntile(10) OVER (PARTITION BY year ORDER BY total_30day_fills DESC, provider_npi)
              AS INTEGER) AS volume_decile,
         cume_dist() OVER (PARTITION BY year ORDER BY total_30day_fills) AS volume_percentile
  FROM provider_sums),
cube AS (
  SELECT f.year, coalesce(nullif(f.provider_state, ''), 'Unknown') AS provider_state,
         coalesce(nullif(f.provider_specialty, ''), 'Unknown') AS provider_specialty,
         f.drug_class, f.marketed_name_type, p.volume_decile,
         CAST(sum(f.total_claims) AS BIGINT) AS total_claims,
         sum(f.total_30day_fills) AS total_30day_fills, CAST(sum(f.cost) AS DOUBLE) AS total_drug_cost,
         count(DISTINCT f.provider_npi) AS prescribers, sum(f.selected) AS selected_class_fills
  FROM exact f JOIN providers p ON p.year = f.year AND p.provider_npi = f.provider_npi
  GROUP BY 1, 2, 3, 4, 5, 6),
kept AS (
  SELECT provider_specialty FROM specialties GROUP BY 1
  ORDER BY sum(total_30day_fills) DESC, 1 LIMIT 3),
collapsed AS (
  SELECT * REPLACE (CASE WHEN provider_specialty IN (SELECT provider_specialty FROM kept)
                         THEN provider_specialty ELSE 'Other specialties' END AS provider_specialty)
  FROM cube),
collapsed_cube AS (
  SELECT year, provider_state, provider_specialty, drug_class, marketed_name_type, volume_decile,
         CAST(sum(total_claims) AS BIGINT) AS total_claims, sum(total_30day_fills) AS total_30day_fills,
         CAST(sum(CAST(total_drug_cost AS DECIMAL(18,2))) AS DOUBLE) AS total_drug_cost,
         CAST(sum(prescribers) AS BIGINT) AS prescriber_cells,
         sum(selected_class_fills) AS selected_class_fills
  FROM collapsed GROUP BY 1, 2, 3, 4, 5, 6),
filtered AS (
  SELECT * FROM collapsed_cube
  WHERE provider_specialty = 'Other specialties' AND marketed_name_type = 'brand-identifiable'),
sorted AS (
  SELECT year, total_30day_fills AS x,
         row_number() OVER (PARTITION BY year ORDER BY total_30day_fills) AS i,
         row_number() OVER (PARTITION BY year ORDER BY total_30day_fills DESC) AS j,
         count(*) OVER (PARTITION BY year) AS n,
         sum(total_30day_fills) OVER (PARTITION BY year) AS total
  FROM providers),
concentrations AS (
  SELECT year, count(*) AS prescribers,
         round(2 * sum(i * x) / (any_value(n) * any_value(total)) - (any_value(n) + 1) / any_value(n), 12)
           AS gini,
         round(sum(x * x) / (any_value(total) * any_value(total)), 12) AS hhi,
         sum(CASE WHEN j <= greatest(1, (n * 1 + 99) // 100) THEN x ELSE 0 END) / any_value(total) AS top_1_share,
         sum(CASE WHEN j <= greatest(1, (n * 5 + 99) // 100) THEN x ELSE 0 END) / any_value(total) AS top_5_share,
         sum(CASE WHEN j <= greatest(1, (n * 10 + 99) // 100) THEN x ELSE 0 END) / any_value(total) AS top_10_share,
         sum(CASE WHEN j <= greatest(1, (n * 20 + 99) // 100) THEN x ELSE 0 END) / any_value(total) AS top_20_share
  FROM sorted GROUP BY year),
ranked_states AS (
  SELECT * FROM states
  WHERE provider_state NOT IN ('NATION_22', 'NATION_23', 'NATION_24', 'Unknown'))
"""


def _with(ctes: str, query: str) -> str:
    """A statement with further CTEs: BASE goes in front as it stands."""
    return f", {ctes.strip().rstrip(',')}\n{query}"


def _scored(segments: str, dim: str) -> str:
    """CTEs of the opportunity score over a yearly segment table."""
    def pct(c: str) -> str:
        return f"""CASE WHEN {c} IS NULL THEN 0.5 ELSE
          (rank() OVER (ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)::DOUBLE
          / (count({c}) OVER ())::DOUBLE END"""

    def scenario(s: str, a: str, b: str, c: str, d: str) -> str:
        return f"""round(100 * (scale_component * {a}::DOUBLE + growth_component * {b}::DOUBLE
          + class_gap_component * {c}::DOUBLE + completeness_component * {d}::DOUBLE), 10) AS score_{s}"""

    return f"""
seg_pivot AS (
  SELECT {dim}, max(total_30day_fills) FILTER (year = @FIRST) AS fills_@FIRST,
         max(total_30day_fills) FILTER (year = @LATEST) AS fills_@LATEST
  FROM {segments} GROUP BY 1),
seg_cagr AS (
  SELECT *, round(pow(fills_@LATEST / nullif(fills_@FIRST, 0), 1::DOUBLE / {PERIODS}) - 1, 10) AS fill_cagr
  FROM seg_pivot WHERE fills_@LATEST IS NOT NULL),
seg_limits AS (
  SELECT quantile_cont(fill_cagr, 0.05) AS low, quantile_cont(fill_cagr, 0.5) AS mid,
         quantile_cont(fill_cagr, 0.95) AS high, count(fill_cagr) AS known
  FROM seg_cagr),
seg_growth AS (
  SELECT c.*, round(CASE WHEN known < 4 THEN coalesce(fill_cagr, 0) WHEN fill_cagr IS NULL THEN mid
                         ELSE least(greatest(fill_cagr, low), high) END, 10) AS winsorized_cagr
  FROM seg_cagr c, seg_limits),
seg_gap AS (
  SELECT *, selected_class_fills / nullif(total_30day_fills, 0) AS selected_class_share,
         sum(selected_class_fills) OVER () / sum(total_30day_fills) OVER () AS benchmark_share,
         round(CASE WHEN selected_class_share IS NOT NULL
                    THEN greatest(benchmark_share - selected_class_share, 0) * 100 END, 10) AS peer_gap_pp
  FROM {segments} WHERE year = @LATEST),
seg_basis AS (
  SELECT g.*, fills_@FIRST, fill_cagr, winsorized_cagr, round(beneficiary_completeness, 10) AS completeness
  FROM seg_gap g JOIN seg_growth USING ({dim})),
seg_components AS (
  SELECT * EXCLUDE (completeness), {pct('total_30day_fills')} AS scale_component,
         {pct('winsorized_cagr')} AS growth_component,
         {pct('peer_gap_pp')} AS class_gap_component, {pct('completeness')} AS completeness_component
  FROM seg_basis),
seg_scores AS (
  SELECT *, {scenario('primary', '0.35', '0.25', '0.25', '0.15')},
         {scenario('growth_led', '0.25', '0.40', '0.20', '0.15')},
         {scenario('gap_led', '0.25', '0.20', '0.40', '0.15')}
  FROM seg_components),
seg_ranks AS (
  SELECT *, CAST(rank() OVER (ORDER BY score_primary DESC) AS INTEGER) AS rank_primary,
         CAST(rank() OVER (ORDER BY score_growth_led DESC) AS INTEGER) AS rank_growth_led,
         CAST(rank() OVER (ORDER BY score_gap_led DESC) AS INTEGER) AS rank_gap_led
  FROM seg_scores),
seg_table AS (
  SELECT *, greatest(rank_primary, rank_growth_led, rank_gap_led)
            - least(rank_primary, rank_growth_led, rank_gap_led) AS rank_range,
         CASE WHEN peer_gap_pp > 0
              THEN 'Observed scale with selected-class share below the national benchmark'
              ELSE 'Observed scale/growth signal without a positive selected-class gap' END
           AS observed_interpretation
  FROM seg_ranks),
"""


STATE_SCORE = _scored("ranked_states", "provider_state")
SPECIALTY_SCORE = _scored("specialties", "provider_specialty")

TOPS = """
tops AS (
  (SELECT 'top_class' AS metric, drug_class AS label, total_30day_fills AS value FROM classes
   WHERE year = @LATEST ORDER BY value DESC, label LIMIT 1)
  UNION ALL
  (SELECT 'top_product', brand_name || ' / ' || generic_name, total_30day_fills FROM products
   WHERE year = @LATEST ORDER BY total_30day_fills DESC, brand_name, generic_name LIMIT 1)
  UNION ALL
  (SELECT 'top_state', provider_state, total_30day_fills FROM states WHERE year = @LATEST
   ORDER BY total_30day_fills DESC, provider_state LIMIT 1)
  UNION ALL
  (SELECT 'top_specialty', provider_specialty, total_30day_fills FROM specialties WHERE year = @LATEST
   ORDER BY total_30day_fills DESC, provider_specialty LIMIT 1)),
"""

NULLED = ", ".join(f"nullif({c}, '') AS {c}" for c in RAW_COLUMNS)
FIELDS = ", ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in (f"nullif({c}, '')" for c in RAW_COLUMNS))
FINGERPRINT = f"sum(CAST('0x' || substr(md5(concat_ws('|', {FIELDS})), 1, 15) AS BIGINT))"
PROFILED = ["Tot_Clms", "Tot_30day_Fills", "Tot_Day_Suply", "Tot_Drug_Cst"]

DECIDED = """brand_name, generic_name, drug_class, matched_terms, is_selected_class,
  marketed_name_type, scope_status"""
LATE = "year = @LATEST AND CAST(provider_npi AS BIGINT) % 7 = 0"
CANDIDATE_RAW = "raw JOIN labels ON Brnd_Name = brand_name AND Gnrc_Name = generic_name"

CORE = """CAST(sum(total_claims) AS BIGINT) AS total_claims,
  sum(total_30day_fills) AS total_30day_fills, CAST(sum(cost) AS DOUBLE) AS total_drug_cost"""

CUBE_CORE = """CAST(sum(total_claims) AS BIGINT) AS total_claims,
  sum(total_30day_fills) AS total_30day_fills,
  CAST(sum(CAST(total_drug_cost AS DECIMAL(18,2))) AS DOUBLE) AS total_drug_cost"""

LAYERS = """left_layer AS ({left}), right_layer AS ({right}),
compared AS (
  SELECT coalesce(l.year, r.year) AS year, m.check_name,
         CASE m.check_name WHEN 'rows' THEN l.rows WHEN 'total_claims' THEN l.claims
              WHEN 'total_30day_fills' THEN l.fills ELSE l.cost END::DOUBLE AS left_value,
         CASE m.check_name WHEN 'rows' THEN r.rows WHEN 'total_claims' THEN r.claims
              WHEN 'total_30day_fills' THEN r.fills ELSE r.cost END::DOUBLE AS right_value
  FROM left_layer l FULL JOIN right_layer r ON l.year = r.year, (VALUES {metrics}) m(check_name))"""
COMPARED = """SELECT *, coalesce(abs(left_value - right_value)
    <= 1e-9 * greatest(abs(left_value), abs(right_value), 1), false) AS passed
FROM compared
"""
FACT_LAYER = """SELECT year, count(*) AS rows, sum(total_claims) AS claims,
  sum(total_30day_fills) AS fills, sum(cost) AS cost FROM exact GROUP BY year"""
CORE_METRICS = "('total_claims'), ('total_30day_fills'), ('total_drug_cost')"


def _layers(left: str, metrics: str = CORE_METRICS) -> str:
    return _with(LAYERS.format(left=left, right=FACT_LAYER, metrics=metrics), COMPARED)


def _violations(**rules: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, count(*) FILTER ({rule}) AS violations FROM fact"
        for name, rule in rules.items()
    )
    return _with(f"v AS ({rows})", "SELECT *, violations = 0 AS passed FROM v")


def _leaders(dim: str, source: str, k: int) -> str:
    return f"""SELECT {dim}, total_claims, total_30day_fills, total_drug_cost, prescribers,
      selected_class_fills / nullif(total_30day_fills, 0) AS selected_class_share
      FROM {source} WHERE year = @LATEST ORDER BY total_30day_fills DESC, {dim} LIMIT {k}"""


def _slice_leaders(dim: str, where: str, k: int) -> str:
    return f"""SELECT {dim}, sum(total_30day_fills) AS total_30day_fills FROM {where}
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {k}"""


def _compact(v: str, prefix: str = "") -> str:
    return f"""'{prefix}' || CASE WHEN {v} >= 1e9 THEN format('{{:.2f}}B', ({v})::DOUBLE / 1e9)
      WHEN {v} >= 1e6 THEN format('{{:.1f}}M', ({v})::DOUBLE / 1e6)
      ELSE format('{{:,}}', CAST(round_even({v}, 0) AS BIGINT)) END"""


CODED = " JOIN ".join(["collapsed_cube"] + [
    f"(SELECT label AS l{i}, code AS {c}_code FROM codes WHERE filter_name = '{c}') ON {c} = l{i}"
    for i, c in enumerate(["provider_state", "provider_specialty", "drug_class", "marketed_name_type"])
])
OPTIONS = " UNION ALL ".join(
    f"SELECT '{c}' AS filter_name, {c} AS label FROM collapsed_cube"
    for c in ["provider_state", "provider_specialty", "drug_class", "marketed_name_type"]
)
PLACED = f"""(SELECT filter_name, label,
  CAST(row_number() OVER (PARTITION BY filter_name ORDER BY label) AS INTEGER) AS position
  FROM (SELECT DISTINCT * FROM ({OPTIONS})))"""

CELLS = "year, provider_state, provider_specialty, drug_class, marketed_name_type, volume_decile"
SEEN = """
seen AS (
  SELECT f.year, f.provider_npi, coalesce(nullif(f.provider_state, ''), 'Unknown') AS provider_state,
         CASE WHEN coalesce(nullif(f.provider_specialty, ''), 'Unknown') IN (SELECT provider_specialty FROM kept)
              THEN coalesce(nullif(f.provider_specialty, ''), 'Unknown') ELSE 'Other specialties' END AS provider_specialty,
         f.drug_class, f.marketed_name_type, p.volume_decile
  FROM exact f JOIN providers p ON p.year = f.year AND p.provider_npi = f.provider_npi),
"""

HEADLINE = TOPS + """
growth AS (
  SELECT *, total_30day_fills / nullif(lag(total_30day_fills) OVER (ORDER BY year), 0) - 1
    AS yoy_fill_growth FROM market),
wide AS (
  SELECT m.total_claims::DOUBLE AS total_claims, m.total_30day_fills, m.total_drug_cost,
         m.prescribers::DOUBLE AS prescribers, m.products::DOUBLE AS products,
         m.avg_cost_per_claim, m.avg_cost_per_30day_fill, m.selected_class_share, m.yoy_fill_growth,
         c.prescribers::DOUBLE AS concentration_prescribers, c.gini AS concentration_gini,
         c.hhi AS concentration_hhi, c.top_1_share AS concentration_top_1_share,
         c.top_5_share AS concentration_top_5_share, c.top_10_share AS concentration_top_10_share,
         c.top_20_share AS concentration_top_20_share
  FROM growth m JOIN concentrations c ON m.year = c.year WHERE m.year = @LATEST)
"""
HEADLINE_ROWS = """SELECT name AS metric, '' AS label, value FROM (UNPIVOT wide ON * INTO NAME name VALUE value)
UNION ALL SELECT * FROM tops
UNION ALL (SELECT 'opportunity_rank_' || rank_primary, provider_state, score_primary FROM seg_table
           ORDER BY score_primary DESC, provider_state LIMIT 10)
"""

# Name -> query, to be appended to BASE.
STATEMENTS: dict[str, str] = {
    "csv_strict_scan": f"SELECT {NULLED}, year FROM raw",
    "fact_parquet_roundtrip": "SELECT * FROM fact",
    "load_class_map": """SELECT term AS match_term, class AS component_class, priority,
        (SELECT count(DISTINCT generic_name) FROM norms WHERE contains(generic_norm, term)
         HAVING count(*) > 0) AS labels FROM rules""",
    "load_exclusions": """SELECT brand_norm AS term, count(*) AS parts
        FROM part_labels JOIN norms USING (brand_name, generic_name)
        WHERE brand_norm IN ('brand 13', 'brand 21') GROUP BY 1""",
    "json_records_roundtrip": """SELECT *, CASE WHEN selected_class_fills / total_30day_fills >= 0.12::DOUBLE
        THEN sqrt(selected_class_fills / total_30day_fills - 0.12::DOUBLE) END AS signal FROM states""",
    "opportunity_export": _with(STATE_SCORE, """SELECT rank_primary AS rank, provider_state, score_primary AS score, total_30day_fills AS fills,
          fill_cagr AS cagr, selected_class_share, peer_gap_pp AS gap_pp, rank_range
        FROM seg_table WHERE provider_state ILIKE '%nation_1%'
          AND contains(lower(provider_state), 'nation_1')
        ORDER BY score_primary DESC, provider_state LIMIT 20"""),
    "extract_manifest": f"""SELECT year, count(*) AS source_rows_scanned,
        count(*) FILTER (candidate) AS filtered_row_count, 22 AS column_count,
        'bolt|cold|gear|gizmo|hot|plate|ring|rod|widget' AS filter_terms,
        'brand 13' AS excluded_brands, CAST({FINGERPRINT} FILTER (candidate) AS VARCHAR) AS fingerprint
        FROM {CANDIDATE_RAW} GROUP BY year""",
    "extract_fingerprint": f"""SELECT year, CAST({FINGERPRINT} FILTER (candidate) AS VARCHAR) AS fingerprint
        FROM {CANDIDATE_RAW} GROUP BY year""",
    "ingest_counts": f"""SELECT CAST(year = @LATEST AS INTEGER) AS ingest_run, count(*) AS scanned,
        count(*) FILTER (candidate) AS kept FROM {CANDIDATE_RAW} GROUP BY 1""",
    "incremental_ingest": f"""SELECT {NULLED}, year, CAST(year = @LATEST AS INTEGER) AS ingest_run
        FROM {CANDIDATE_RAW} WHERE candidate""",
    "incremental_market_year": "SELECT * FROM market",
    "ingest_replaced_file": """SELECT * FROM fact
        WHERE year > @FIRST AND (year < @LATEST OR CAST(provider_npi AS BIGINT) % 2 = 0)""",
    "incremental_prescribers": "SELECT year, prescribers, true AS within_bound FROM market",
    "standardize_fact": "SELECT * FROM candidates",
    "provider_id_normalize": """SELECT DISTINCT Prscrbr_NPI, provider_npi,
        'NPI-******' || right(provider_npi, 4) AS provider_masked_id
        FROM (SELECT Prscrbr_NPI, lpad(replace(Prscrbr_NPI, '.0', ''), 10, '0') AS provider_npi FROM raw)""",
    "normalize_labels": "SELECT brand_name, generic_name, brand_norm, generic_norm FROM norms",
    "numeric_coerce": """SELECT CAST((l_orderkey + l_linenumber) % 8 AS INTEGER) AS form, count(*) AS rows,
        CASE WHEN form < 4 THEN count(*) ELSE 0 END AS integers,
        CAST(CASE WHEN form < 3 THEN sum(l_quantity) WHEN form = 3 THEN sum(l_quantity) * 100 END AS BIGINT)
          AS integer_sum,
        CASE WHEN form < 3 OR form = 7 THEN sum(l_quantity) WHEN form = 3 THEN sum(l_quantity) * 100
             WHEN form = 4 THEN sum(l_quantity + 0.5) WHEN form = 6 THEN sum(l_quantity + 0.25) END AS double_sum,
        CASE WHEN form IN (4, 6, 7) THEN count(*) ELSE 0 END AS rejects
        FROM lineitem GROUP BY 1""",
    "row_unit_costs": """SELECT year, provider_npi, brand_name, generic_name, cost_per_claim,
        cost_per_30day_fill, beneficiary_count_suppressed FROM fact""",
    "suppression_profile": """SELECT year, count(*) AS row_count,
        count(*) FILTER (beneficiary_count_suppressed) AS suppressed_rows,
        (count(*) FILTER (beneficiary_count_suppressed))::DOUBLE / count(*)::DOUBLE AS suppressed_share
        FROM fact GROUP BY year""",
    "candidate_filter": f"SELECT year, Prscrbr_NPI, Brnd_Name, Gnrc_Name FROM {CANDIDATE_RAW} WHERE candidate",
    "allowlist_semi_join": "SELECT * FROM ranked_states",
    "headline_formatted": f"""SELECT year, {_compact('total_30day_fills')} AS fills_text,
        {_compact('total_claims')} AS claims_text, {_compact('total_drug_cost', '$')} AS cost_text,
        format('{{:.1f}}%', selected_class_share * 100) AS share_text FROM market""",
    "classify_labels": """SELECT brand_name, generic_name, drug_class, matched_terms,
        is_selected_class, marketed_name_type, scope_status FROM labels""",
    "label_dimension": f"SELECT {DECIDED}, candidate AS in_scope FROM labels",
    "fact_by_labels": "SELECT * FROM fact",
    "labels_after_rule_change": """SELECT brand_name, generic_name,
        CASE WHEN device OR matched_terms <> 'bolt' THEN drug_class ELSE 'Unmapped' END AS drug_class,
        CASE WHEN device THEN matched_terms ELSE regexp_replace(matched_terms, '^bolt([|]|$)', '') END AS matched_terms,
        is_selected_class, marketed_name_type, scope_status, candidate AND terms <> 'bolt' AS in_scope
        FROM labels JOIN (SELECT brand_name, generic_name, terms FROM hits) USING (brand_name, generic_name)""",
    "many_terms_contained": """SELECT c_name, CAST(p_partkey AS VARCHAR) AS number
        FROM (SELECT DISTINCT c_name FROM customer) JOIN part
        ON p_partkey >= 100 AND contains(c_name, CAST(p_partkey AS VARCHAR))""",
    "theta_contains_join": """SELECT DISTINCT generic_name, term AS match_term
        FROM norms JOIN rules ON contains(generic_norm, term)""",
    "scope_audit": """SELECT DISTINCT year, brand_name, generic_name, drug_class, matched_terms,
        marketed_name_type, scope_status,
        1 > CASE WHEN matched_terms = '' THEN 0 ELSE len(string_split(matched_terms, '|')) END
          AS has_unrecognized_part
        FROM cells JOIN labels USING (brand_name, generic_name)""",
    "scope_counts": """SELECT scope_status, count(DISTINCT (year, brand_name, generic_name)) AS labels
        FROM cells JOIN labels USING (brand_name, generic_name) GROUP BY 1""",
    "observed_labels": "SELECT DISTINCT year, brand_name, generic_name FROM cells",
    "selected_class_share": """SELECT year, sum(total_30day_fills) AS total_30day_fills,
        sum(selected) AS selected_class_fills,
        sum(selected) / nullif(sum(total_30day_fills), 0) AS selected_class_share FROM exact GROUP BY year""",
    "name_type_mix": f"""SELECT year, marketed_name_type, {CORE},
        count(DISTINCT provider_npi) AS prescribers FROM exact GROUP BY 1, 2""",
    "check_unmapped": """SELECT year, brand_name, generic_name, count(*) AS row_count
        FROM cells JOIN labels USING (brand_name, generic_name)
        WHERE NOT device AND matched_terms = 'bolt' GROUP BY ALL""",
    "market_year": "SELECT * FROM market",
    "class_year": "SELECT * FROM classes",
    "product_year": "SELECT * FROM products",
    "state_year": "SELECT * FROM states",
    "specialty_year": "SELECT * FROM specialties",
    "city_year": "SELECT * FROM cities",
    "provider_year": "SELECT * FROM providers",
    "dashboard_cube": "SELECT * FROM cube",
    "cube_collapsed": "SELECT * FROM collapsed_cube",
    "class_row_counts": "SELECT year, drug_class, count(*) AS row_count FROM fact GROUP BY 1, 2",
    "grain_duplicates": """SELECT l_orderkey, l_linenumber, count(*) AS duplicate_count
        FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "market_size_and_growth": """SELECT year, total_claims, total_30day_fills, total_drug_cost,
        prescribers, total_30day_fills / nullif(lag(total_30day_fills) OVER (ORDER BY year), 0) - 1
          AS yoy_fill_growth, selected_class_share FROM market""",
    "provider_deciles": "SELECT year, provider_npi, total_30day_fills, volume_decile FROM providers",
    "provider_percentile": "SELECT year, provider_npi, total_30day_fills, volume_percentile FROM providers",
    "percentile_rank_avg": """SELECT year, provider_npi, total_30day_fills,
        (rank() OVER (PARTITION BY year ORDER BY total_30day_fills)
         + (count(*) OVER (PARTITION BY year, total_30day_fills) - 1) / 2.0)::DOUBLE
        / (count(*) OVER (PARTITION BY year))::DOUBLE AS fills_percentile FROM providers""",
    "class_leaders": """SELECT * FROM classes QUALIFY row_number() OVER
        (PARTITION BY year ORDER BY total_30day_fills DESC, drug_class) <= 10""",
    "city_top_n": """SELECT * FROM cities QUALIFY row_number() OVER
        (PARTITION BY year ORDER BY total_30day_fills DESC, provider_state, provider_city) <= 100""",
    "products_top_n_per_year": """SELECT * FROM products QUALIFY row_number() OVER (PARTITION BY year
        ORDER BY total_30day_fills DESC, drug_class, brand_name, generic_name, marketed_name_type) <= 60""",
    "product_leaders": """SELECT brand_name, generic_name, drug_class, total_claims, total_30day_fills,
        total_drug_cost, avg_cost_per_claim FROM products WHERE year = @LATEST
        ORDER BY total_30day_fills DESC, brand_name, generic_name LIMIT 20""",
    "state_leaders": _leaders("provider_state", "states", 20),
    "specialty_leaders": _leaders("provider_specialty", "specialties", 20),
    "outlier_review": """SELECT * FROM (
        SELECT provider_masked_id, brand_name, generic_name, total_30day_fills, cost_per_30day_fill,
          percent_rank() OVER (ORDER BY cost_per_30day_fill) AS cost_percentile
        FROM fact WHERE year = @LATEST AND total_30day_fills >= 20 AND cost_per_30day_fill IS NOT NULL)
        WHERE cost_percentile >= 0.99
        ORDER BY cost_per_30day_fill DESC, provider_masked_id, brand_name, generic_name LIMIT 25""",
    "product_scatter": """SELECT brand_name, generic_name, drug_class, marketed_name_type,
        total_30day_fills, total_drug_cost, prescribers,
        total_drug_cost / nullif(total_30day_fills, 0) AS cost_per_fill FROM products WHERE year = @LATEST
        ORDER BY total_30day_fills DESC, brand_name, generic_name LIMIT 80""",
    "collapse_rare": "SELECT * FROM collapsed",
    "concentration": "SELECT * FROM concentrations",
    "pareto_shares": " UNION ALL ".join(
        f"""SELECT year, {p} AS top_percent, greatest(1, (prescribers * {p} + 99) // 100) AS providers,
        top_{p}_share AS fill_share FROM concentrations""" for p in (1, 5, 10, 20)
    ),
    "lorenz_curve": """SELECT g.year, CAST(p AS INTEGER) AS provider_pct,
        coalesce((SELECT sum(x) FROM sorted s WHERE s.year = g.year
                  AND i <= least(g.n, round_even(g.n * p / 100.0, 0))), 0) / g.total * 100 AS fill_pct
        FROM (SELECT year, any_value(n) AS n, any_value(total) AS total FROM sorted GROUP BY year) g,
             (SELECT unnest(range(0, 101, 2)) AS p)""",
    "segment_pivot": "SELECT provider_state, " + ", ".join(
        f"max(total_30day_fills) FILTER (year = {y}) AS fills_{y}" for y in YEARS
    ) + " FROM states GROUP BY 1",
    "segment_cagr": f"""SELECT * FROM (SELECT provider_state,
          max(total_30day_fills) FILTER (year = {FIRST}) AS fills_{FIRST},
          max(total_30day_fills) FILTER (year = {LATEST}) AS fills_{LATEST},
          round(pow(fills_{LATEST} / nullif(fills_{FIRST}, 0), 1::DOUBLE / {PERIODS}) - 1, 10) AS fill_cagr
        FROM states GROUP BY 1) WHERE fills_{LATEST} IS NOT NULL""",
    "benchmark_gap": _with(STATE_SCORE, """SELECT provider_state, selected_class_share, benchmark_share, peer_gap_pp FROM seg_gap"""),
    "winsorize": _with(STATE_SCORE, """SELECT provider_state, fill_cagr, winsorized_cagr FROM seg_growth"""),
    "opportunity_components": _with(STATE_SCORE, """SELECT provider_state, scale_component, growth_component, class_gap_component,
          completeness_component FROM seg_components"""),
    "opportunity_state": _with(STATE_SCORE, "SELECT * FROM seg_table"),
    "opportunity_specialty": _with(SPECIALTY_SCORE, """SELECT * FROM seg_table ORDER BY score_primary DESC, provider_specialty LIMIT 60"""),
    "slice_kpis": f"""SELECT *, total_drug_cost / greatest(total_30day_fills, 1) AS cost_per_fill,
        selected_class_fills / greatest(total_30day_fills, 1) AS selected_class_share
        FROM (SELECT {CUBE_CORE}, sum(selected_class_fills) AS selected_class_fills
              FROM filtered WHERE year = @LATEST)""",
    "slice_yoy": """SELECT *, fills / nullif(prior_fills, 0) - 1 AS yoy_fill_growth FROM (
        SELECT sum(total_30day_fills) FILTER (year = @LATEST) AS fills,
               sum(total_30day_fills) FILTER (year = @LATEST - 1) AS prior_fills FROM filtered)""",
    "slice_trend": """SELECT year, sum(total_30day_fills) AS total_30day_fills,
        sum(total_30day_fills) / nullif(lag(sum(total_30day_fills)) OVER (ORDER BY year), 0) - 1 AS growth
        FROM filtered GROUP BY year""",
    "slice_class_leaders": _slice_leaders("drug_class", "filtered WHERE year = @LATEST", 8),
    "slice_state_leaders": _slice_leaders("provider_state", "filtered WHERE year = @LATEST", 10),
    "slice_specialty_leaders": _slice_leaders(
        "provider_specialty", "collapsed_cube WHERE year = @LATEST AND volume_decile = 1", 8
    ),
    "slice_products": """SELECT * FROM products WHERE year = @LATEST AND drug_class = 'H'
        AND marketed_name_type = 'brand-identifiable'
        ORDER BY total_30day_fills DESC, brand_name, generic_name LIMIT 10""",
    "cube_prescribers_exact": _with(SEEN, f"""SELECT s.*, prescriber_cells
        FROM (SELECT {CELLS}, count(DISTINCT provider_npi) AS prescribers FROM seen GROUP BY {CELLS}) s
        JOIN collapsed_cube USING ({CELLS})"""),
    "cube_prescribers_sketch": _with(SEEN, """SELECT provider_state, provider_specialty,
        count(DISTINCT provider_npi) AS prescribers, true AS within_bound FROM seen GROUP BY 1, 2"""),
    "slice_prescribers": _with(SEEN, """SELECT year, count(DISTINCT provider_npi) AS prescribers FROM seen
        WHERE provider_specialty = 'Other specialties' AND marketed_name_type = 'brand-identifiable'
        GROUP BY GROUPING SETS ((year), ())"""),
    "filter_options": f"SELECT * FROM {PLACED}",
    "cube_dictionary_encode": _with(
        f"codes AS (SELECT filter_name, label, position - 1 AS code FROM {PLACED})",
        f"""SELECT year, volume_decile, total_claims, total_30day_fills, total_drug_cost, prescriber_cells,
          selected_class_fills, provider_state_code, provider_specialty_code, drug_class_code,
          marketed_name_type_code FROM {CODED}""",
    ),
    "cube_dictionary_roundtrip": "SELECT * FROM collapsed_cube",
    "headline_leaders": _with(TOPS, "SELECT * FROM tops"),
    "headline_metrics": _with(STATE_SCORE + HEADLINE, HEADLINE_ROWS),
    "profile_rows": "SELECT year, count(*) AS row_count, 22 AS column_count FROM raw GROUP BY year",
    "profile_blank_counts": " UNION ALL ".join(
        f"""SELECT year, '{c}' AS column_name, count(*) FILTER ({c} = '') AS blank_count
        FROM raw GROUP BY year""" for c in RAW_COLUMNS
    ),
    "profile_missing_rate": """SELECT year, count(*) AS row_count, count(*) FILTER (Tot_Benes = '') AS blank_count,
        (count(*) FILTER (Tot_Benes = ''))::DOUBLE / count(*)::DOUBLE AS blank_share FROM raw GROUP BY year""",
    "check_grain": f"""SELECT 'grain_unique' AS check_name, count(*) AS violations, violations = 0 AS passed
        FROM fact WHERE {LATE}""",
    "provider_grain_validation": f"""SELECT year, provider_npi, brand_name, generic_name, 2::BIGINT AS duplicate_count
        FROM fact WHERE {LATE}""",
    "check_published_row": """SELECT year, check_name, value AS left_value, value AS right_value, true AS passed
        FROM (UNPIVOT (SELECT year, total_claims::DOUBLE AS total_claims, total_30day_fills::DOUBLE AS total_30day_fills,
                         total_drug_cost::DOUBLE AS total_drug_cost FROM market WHERE year = @LATEST)
              ON total_claims, total_30day_fills, total_drug_cost INTO NAME check_name VALUE value)""",
    "reconcile_published": _layers(
        """SELECT year, 0 AS rows, total_claims AS claims, total_30day_fills AS fills, total_drug_cost AS cost
        FROM market"""
    ),
    "profile_duplicate_keys": """SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS row_count,
        count(*) AS distinct_keys, CAST(sum(n - 1) AS BIGINT) AS duplicate_keys
        FROM (SELECT l_returnflag, count(*) AS n FROM lineitem
              GROUP BY l_returnflag, l_orderkey, l_linenumber) GROUP BY 1""",
    "profile_label_pairs": """SELECT year, count(DISTINCT (Brnd_Name, Gnrc_Name)) AS label_pairs
        FROM raw GROUP BY year""",
    "profile_numeric_range": " UNION ALL ".join(
        f"""SELECT year, '{c}' AS column_name, min(CAST({c} AS DOUBLE)) AS min_value,
        max(CAST({c} AS DOUBLE)) AS max_value FROM raw GROUP BY year""" for c in PROFILED
    ),
    "check_years": """SELECT year, true AS expected, true AS observed, 32 AS column_count, true AS passed
        FROM (SELECT DISTINCT year FROM fact)""",
    "check_required": _violations(
        provider_npi_length="provider_npi IS NULL OR length(provider_npi) <> 10",
        brand_name_missing="brand_name IS NULL", generic_name_missing="generic_name IS NULL",
        drug_class_missing="drug_class IS NULL", total_claims_missing="total_claims IS NULL",
        total_30day_fills_missing="total_30day_fills IS NULL",
        total_drug_cost_missing="total_drug_cost IS NULL",
    ),
    "check_domains": _violations(
        total_claims_below_minimum="total_claims < 11",
        total_30day_fills_negative="total_30day_fills < 0",
        total_day_supply_negative="total_day_supply < 0",
        total_drug_cost_negative="total_drug_cost < 0",
        beneficiaries_below_minimum="total_beneficiaries < 11",
    ),
    "check_scope": _violations(
        unmapped_class="drug_class = 'Unmapped'", not_included="scope_status <> 'included'",
        excluded_pattern="generic_name ILIKE '%anvil%'", excluded_brand="brand_name = 'Brand#13'",
    ),
    "check_suppression": """SELECT count(*) FILTER (beneficiary_count_suppressed) AS suppressed_rows,
        count(*) FILTER (total_beneficiaries IS NULL) AS missing_rows,
        suppressed_rows = missing_rows AND suppressed_rows > 0 AS passed FROM fact""",
    "check_score_bounds": _with(STATE_SCORE + "v AS (" + " UNION ALL ".join(
        f"""SELECT 'score_{s}' AS check_name,
        count(*) FILTER (score_{s} IS NULL OR score_{s} NOT BETWEEN 0 AND 100) AS violations
        FROM seg_table""" for s in ("primary", "growth_led", "gap_led")
    ) + ")", "SELECT *, violations = 0 AS passed FROM v"),
    "reconcile_layers": _layers(
        f"""SELECT year, count(*) AS rows, sum(CAST(Tot_Clms AS BIGINT)) AS claims,
        sum(CAST(Tot_30day_Fills AS DOUBLE)) AS fills, sum(CAST(Tot_Drug_Cst AS DECIMAL(18,2))) AS cost
        FROM {CANDIDATE_RAW} WHERE candidate AND NOT device GROUP BY year""",
        "('rows'), " + CORE_METRICS,
    ),
    "reconcile_rows": """SELECT year, provider_npi, brand_name, generic_name, 1::BIGINT AS left_rows,
        CASE WHEN id % 97 = 0 THEN 0 WHEN id % 89 = 0 THEN 1 ELSE 2 END::BIGINT AS right_rows,
        CASE WHEN id % 97 = 0 THEN 'missing' ELSE 'changed' END AS difference
        FROM (SELECT *, CAST(provider_npi AS BIGINT) AS id FROM fact)
        WHERE year = @LATEST AND (id % 97 = 0 OR id % 89 = 0 OR id % 83 = 0)""",
    "reconcile_counts": f"""SELECT c.*, candidate_rows AS input_rows, f.processed_rows,
        candidate_rows = processed_rows + excluded_rows AS passed
        FROM (SELECT year, count(*) AS source_rows_scanned,
                count(*) FILTER (candidate) AS candidate_rows,
                count(*) FILTER (candidate AND device) AS excluded_rows
              FROM {CANDIDATE_RAW} GROUP BY year) c
        JOIN (SELECT year, count(*) AS processed_rows FROM fact GROUP BY year) f ON c.year = f.year""",
    "reconcile_class_rollup": _layers(
        """SELECT year, 0 AS rows, sum(total_claims) AS claims, sum(total_30day_fills) AS fills,
        sum(CAST(total_drug_cost AS DECIMAL(18,2))) AS cost FROM classes GROUP BY year"""
    ),
    "cube_join_fanout": _layers(
        """SELECT year, 0 AS rows, sum(total_claims) AS claims, sum(total_30day_fills) AS fills,
        sum(CAST(total_drug_cost AS DECIMAL(18,2))) AS cost FROM cube GROUP BY year"""
    ),
}


def oracle_sql() -> dict[str, str]:
    """Complete statement per catalog entry."""
    return {
        name: (BASE + body).replace("@LATEST", str(LATEST)).replace("@FIRST", str(FIRST))
        for name, body in STATEMENTS.items()
    }
