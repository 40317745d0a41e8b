"""DuckDB equivalents of the registered queries, written from the formulas.

``_STEPS`` are named sub-selects over the raw tables; a statement takes along
those it needs.  Doubles are rounded as in ``catalog.present``.
"""

from __future__ import annotations

import re

from carbonsplit.plans.catalog import decimals

_STEPS: dict[str, str] = {}
_STATEMENTS: dict[str, str] = {}


def _step(name: str, sql: str) -> None:
    _STEPS[name] = sql


def _number(column: str) -> str:
    rounded = f"round(CAST({column} AS DOUBLE), {decimals(column)})"
    return f"CASE WHEN {rounded} = 0 THEN 0.0::DOUBLE ELSE {rounded} END AS {column}"


def _statement(name: str, source: str, plain: str = "", ints: str = "", doubles: str = "") -> None:
    """Final select over a step (or ``(select)``): columns by kind, space separated."""
    columns = [f'"{c}"' for c in plain.split()]
    columns += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    columns += [_number(c) for c in doubles.split()]
    _STATEMENTS[name] = f"SELECT {', '.join(columns)} FROM {source} AS result"


def _needed(sql: str) -> list[str]:
    """Steps mentioned by ``sql``, in definition order, with all they need."""
    wanted: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        fresh = [s for s in _STEPS if s in words and s not in wanted]
        wanted.update(fresh)
        todo.extend(_STEPS[s] for s in fresh)
    return [s for s in _STEPS if s in wanted]


def _mentions(step: str, needed: list[str], sql: str) -> int:
    texts = [sql, *[_STEPS[s] for s in needed]]
    return sum(re.findall(r"\w+", text).count(step) for text in texts)


def statements() -> dict[str, str]:
    """Statement per query; a step that is used more than once is worked out once."""
    result = {}
    for name, sql in _STATEMENTS.items():
        needed = _needed(sql)
        kept = {s: "MATERIALIZED " if _mentions(s, needed, sql) > 1 else "" for s in needed}
        steps = ",\n".join(f"{s} AS {kept[s]}({_STEPS[s]})" for s in needed)
        result[name] = f"WITH {steps}\n{sql}"
    return result


# Sum that is null if any input is null.
def _strict(column: str) -> str:
    return f"CASE WHEN count({column}) = count(*) THEN sum({column}) END"


# -- base ----------------------------------------------------------------------

_step(
    "cust",
    """
    SELECT c_custkey AS custkey, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS country,
      c_nationkey AS nation,
      CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
        WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 END AS seg,
      lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || '-' || c_custkey AS city,
      lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || '.' || seg || '_1' AS region,
      lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || ' ' || c_mktsegment AS name,
      c_name AS city_name, c_acctbal AS balance
    FROM customer""",
)
_step(
    "line_facts",
    """
    SELECT o_custkey AS custkey, year(o_orderdate) AS year, l_returnflag AS flag,
      sum(l_quantity) * 1.047197551::DOUBLE AS amount,
      sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS landuse
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
)
_step(
    "city_gas",
    """
    SELECT city, country, region, name, nation, seg, year, amount, landuse,
      CASE flag WHEN 'A' THEN 'CO2' WHEN 'N' THEN 'CH4' WHEN 'R' THEN 'N2O' END AS gas
    FROM line_facts JOIN cust USING (custkey)""",
)
_step(
    "region_gas",
    """
    SELECT country, region, name, nation, seg, year, gas, sum(amount) AS amount
    FROM city_gas GROUP BY ALL""",
)
_step(
    "city_orders",
    """
    SELECT city, country, region, name, nation, seg, year(o_orderdate) AS year,
      count(*) AS n_orders, sum(CAST(o_totalprice AS DECIMAL(14,2))) AS turnover
    FROM orders JOIN cust ON o_custkey = custkey GROUP BY ALL""",
)
_step(
    "region_orders",
    """
    SELECT country, region, name, nation, seg, year, sum(n_orders) AS n_orders,
      sum(turnover) AS turnover
    FROM city_orders GROUP BY ALL""",
)
_step(
    "pop",
    "SELECT country, region, year, CAST(n_orders AS DOUBLE) AS population FROM region_orders",
)
_step(
    "pop_gaps",
    """
    SELECT country, region, year,
      CASE WHEN country = '021' AND year = 1996 THEN NULL ELSE population END AS population
    FROM pop""",
)
_step(
    "gdp_rows",
    """
    SELECT country, region, year, CASE WHEN country = '023' OR region = '022.1_1' THEN 0.0
      ELSE CAST(turnover AS DOUBLE) END AS gdp
    FROM region_orders""",
)
_step(
    "hist",
    """
    SELECT country, region, name, year, (coalesce(sum(amount) FILTER (gas = 'CO2'), 0)
      + 25 * coalesce(sum(amount) FILTER (gas = 'CH4'), 0)
      + 298 * coalesce(sum(amount) FILTER (gas = 'N2O'), 0)) / 1e6 AS ghg_mt
    FROM region_gas WHERE year <= 1998 GROUP BY ALL""",
)
_step(
    "hist_strict",
    """
    SELECT country, region, name, year, (sum(amount) FILTER (gas = 'CO2')
      + 25 * sum(amount) FILTER (gas = 'CH4') + 298 * sum(amount) FILTER (gas = 'N2O')) / 1e6
      AS ghg_mt
    FROM region_gas WHERE year <= 1998 AND NOT (country = '024' AND gas = 'CH4') GROUP BY ALL""",
)
_step(
    "city_hist",
    """
    SELECT city, year, (coalesce(sum(amount) FILTER (gas = 'CO2'), 0)
      + 25 * coalesce(sum(amount) FILTER (gas = 'CH4'), 0)
      + 298 * coalesce(sum(amount) FILTER (gas = 'N2O'), 0)) / 1e6 AS ghg_mt
    FROM city_gas WHERE year <= 1998 GROUP BY ALL""",
)
_step("city_pop", "SELECT city, year, CAST(n_orders AS DOUBLE) AS population FROM city_orders")
_step("scen", "SELECT * FROM (VALUES ('s15', 0.537219), ('s20', 0.912743)) AS v(scenario_id, factor)")

# -- panel ---------------------------------------------------------------------

_statement("d01_stitch_eras", "pop", "country region", "year", "population")
_step(
    "rounded",
    """
    SELECT country, city, year, CAST(round_even(n_orders * 0.25::DOUBLE, 0) AS DOUBLE) AS population
    FROM city_orders""",
)
_statement(
    "d02_zero_count_census",
    "(SELECT country, count(*) AS n FROM rounded WHERE population = 0 GROUP BY 1)",
    "country",
    "n",
)
_statement("d02_round_population", "rounded", "country city", "year", "population")
_statement(
    "d03_co2e_total",
    "(SELECT * FROM hist_strict WHERE year >= 1996)",
    "country region name",
    "year",
    "ghg_mt",
)
_statement(
    "d03_co2e_total_city",
    """(SELECT city, year, (sum(amount) FILTER (gas = 'CO2') + 25 * sum(amount) FILTER (gas = 'CH4')
      + 298 * sum(amount) FILTER (gas = 'N2O')) / 1e6 AS ghg_mt
    FROM city_gas WHERE year BETWEEN 1996 AND 1998 GROUP BY ALL)""",
    "city",
    "year",
    "ghg_mt",
)
_step(
    "panel_rows",
    """
    SELECT country, region, name, year, ghg_mt, population, gdp
    FROM hist LEFT JOIN pop_gaps USING (country, region, year)
      LEFT JOIN gdp_rows USING (country, region, year)""",
)
_statement(
    "d04_entity_year_panel", "panel_rows", "country region name", "year", "ghg_mt population gdp"
)
_step(
    "profile_sums",
    f"""
    SELECT region, country, name, {_strict('ghg_mt')} AS ghg_mt,
      {_strict('population')} AS population, {_strict('gdp')} AS gdp
    FROM panel_rows GROUP BY ALL""",
)
_step(
    "profile",
    f"""
    SELECT *, ghg_mt * 1e6 / nullif(population, 0) AS ghg_t_per_person,
      ghg_mt * 1e6 / nullif(gdp, 0) AS ghg_t_per_gdp, ghg_mt * 1e6 / 53 AS ghg_t_per_year,
      ghg_mt * 100 / nullif((SELECT {_strict('ghg_mt')} FROM profile_sums), 0) AS ghg_share_pct,
      name || ', ' || country AS label
    FROM profile_sums""",
)
_statement(
    "d05_intensity_profile",
    "profile",
    "region country name label",
    "",
    "ghg_mt population gdp ghg_t_per_person ghg_t_per_gdp ghg_t_per_year ghg_share_pct",
)
_step(
    "small",
    """
    SELECT country, region, min(population) AS min_population FROM pop_gaps GROUP BY 1, 2
    HAVING count(population) = count(*) AND min(population) < 8""",
)
_statement(
    "d06_small_population_screen",
    "(SELECT * FROM pop_gaps JOIN small USING (country, region) "
    "LEFT JOIN gdp_rows USING (country, region, year))",
    "country region",
    "year",
    "population gdp min_population",
)
_statement(
    "d07_zero_gdp_screen", "(SELECT * FROM profile WHERE gdp = 0)", "country region", "", "gdp ghg_mt"
)
_statement(
    "d07_zero_population_screen",
    "(SELECT * FROM profile WHERE population = 0)",
    "country region",
    "",
    "population",
)
_statement(
    "d08_code_screen",
    "(SELECT * FROM profile WHERE country IN ('021', '022'))",
    "country region",
    "",
    "ghg_mt",
)
_SCREENED = """country NOT IN ('021', '022') AND region NOT IN (SELECT region FROM small)
    AND region NOT IN (SELECT region FROM profile WHERE gdp = 0)"""
_statement(
    "d09_apply_screens",
    f"(SELECT * FROM hist WHERE {_SCREENED})",
    "country region name",
    "year",
    "ghg_mt",
)
_statement(
    "d09_apply_screens_population",
    f"(SELECT * FROM pop_gaps WHERE {_SCREENED})",
    "country region",
    "year",
    "population",
)
_statement(
    "d10_coverage_share",
    f"(SELECT {_strict('ghg_share_pct')} AS covered_pct FROM profile WHERE {_SCREENED})",
    "",
    "",
    "covered_pct",
)

# -- pathway -------------------------------------------------------------------

_step(
    "world_gas",
    """
    SELECT year, sum(amount) FILTER (gas = 'CO2') AS co2, sum(amount) FILTER (gas = 'CH4') AS ch4,
      sum(amount) FILTER (gas = 'N2O') AS n2o
    FROM region_gas WHERE year IN (1995, 1997, 1999, 2001) GROUP BY 1""",
)
_step(
    "sheet_long",
    """
    SELECT 'star' AS model, scenario_id, 'World' AS region, unit, variable, year, value * factor AS value
    FROM (
      SELECT year, 'Mt CO2/yr' AS unit, 'Emissions|CO2' AS variable, co2 / 1e6 AS value FROM world_gas
      UNION ALL SELECT year, 'Mt CH4/yr', 'Emissions|CH4', ch4 / 1e6 FROM world_gas
      UNION ALL SELECT year, 'kt N2O/yr', 'Emissions|N2O', n2o / 1e3 FROM world_gas
      UNION ALL SELECT year, 'Mt CO2/yr', 'Emissions|CO2|AFOLU',
        co2 / 1e6 * CASE WHEN year < 1999 THEN 0.05 WHEN year > 1999 THEN -0.05 ELSE 0 END
        FROM world_gas
    ) CROSS JOIN scen""",
)
_step("melted", "SELECT * FROM sheet_long WHERE year >= 1997 AND value <> 0")
_statement(
    "d11_melt_scenario", "melted", "model scenario_id region unit variable", "year", "value"
)
_step(
    "net_anchor",
    """
    SELECT scenario_id, year, sum(CASE variable WHEN 'Emissions|CH4' THEN value * 25
      WHEN 'Emissions|N2O' THEN value / 1000 * 298 ELSE value END) AS value
    FROM melted GROUP BY ALL""",
)
_statement("d12_scenario_co2e", "net_anchor", "scenario_id", "year", "value")
_step(
    "removal_anchor",
    """
    SELECT scenario_id, year, sum(value) / 10000 AS value FROM sheet_long
    WHERE year >= 1997 AND value >= 0 GROUP BY ALL""",
)


def _line(points: str, keys: str) -> str:
    """Yearly values between the known (key, year, value) points of ``points``."""
    return f"""
    SELECT {keys}, y.year, coalesce(
        max(value) FILTER (p.year = y.year),
        arg_max(value, p.year) FILTER (p.year < y.year)
          + (arg_min(value, p.year) FILTER (p.year > y.year)
             - arg_max(value, p.year) FILTER (p.year < y.year))
            * (y.year - max(p.year) FILTER (p.year < y.year))
            / (min(p.year) FILTER (p.year > y.year) - max(p.year) FILTER (p.year < y.year))
      ) AS value
    FROM {points} AS p JOIN (
      SELECT {keys}, unnest(generate_series(min(year), max(year))) AS year
      FROM {points} GROUP BY {keys} HAVING count(*) >= 2) AS y USING ({keys})
    GROUP BY {keys}, y.year"""


_step("net_line", _line("net_anchor", "scenario_id"))
_step("net", "SELECT scenario_id, year, value AS net_mt FROM net_line")
_step("removal_line", _line("removal_anchor", "scenario_id"))
_step("removal", "SELECT scenario_id, year, -value AS removal_mt FROM removal_line")
_step(
    "city_points_all",
    "SELECT city, gas, year, amount AS value FROM city_gas WHERE year <= 1998 "
    "UNION ALL SELECT city, 'CO2bio', year, amount * 2 FROM city_gas "
    "WHERE year <= 1998 AND gas = 'CO2'",
)
_step("city_line", _line("city_points_all", "city, gas"))
_statement(
    "d13_interpolate_yearly",
    "(SELECT *, value AS amount_t FROM city_line)",
    "city gas",
    "year",
    "amount_t",
)
_statement("d13_net_pathway", "net", "scenario_id", "year", "net_mt")
_statement("d14_removal_pathway", "removal", "scenario_id", "year", "removal_mt")
_step(
    "landuse_rows",
    """
    SELECT year, CAST(sum(landuse) AS DOUBLE) / 1e7 / 2.0 AS landuse_mt FROM city_gas GROUP BY 1""",
)
_statement("d15_pick_landuse", "landuse_rows", "", "year", "landuse_mt")
_step(
    "path",
    """
    SELECT scenario_id, year, net_mt, removal_mt, landuse_mt,
      net_mt - landuse_mt AS net_excl_landuse_mt, net_mt - landuse_mt - removal_mt AS positive_mt
    FROM net LEFT JOIN removal USING (scenario_id, year) LEFT JOIN landuse_rows USING (year)""",
)
_statement(
    "d16_decompose_pathway",
    "path",
    "scenario_id",
    "year",
    "net_mt removal_mt landuse_mt net_excl_landuse_mt positive_mt",
)

# -- sources ---------------------------------------------------------------------

_step(
    "csv_rows",
    """
    SELECT country, CASE WHEN custkey % 7 <> 0 THEN 2030 END AS year,
      CASE WHEN custkey % 13 <> 0 AND custkey % 11 <> 0 THEN balance END AS value,
      custkey % 7 = 0 AS bad_year, custkey % 13 = 0 AS bad_value
    FROM cust""",
)
_STATEMENTS["p02_csv_scan"] = (
    "SELECT country, CAST(year AS BIGINT) AS year, CASE WHEN value = 0 THEN 0.0 ELSE value END AS value FROM csv_rows"
)
_statement(
    "p02_unparsed_cells",
    """(SELECT 'year' AS "column", count(*) AS n_rows, count(*) FILTER (bad_year) AS n_cells FROM csv_rows
    UNION ALL SELECT 'value', count(*), count(*) FILTER (bad_value) FROM csv_rows)""",
    "column",
    "n_rows n_cells",
)

# -- several models --------------------------------------------------------------

_step(
    "sheet_models",
    """
    SELECT v.model, CASE WHEN v.name <> '' THEN v.name ELSE scenario_id END AS scenario, v.region,
      variable, year, value * v.factor AS value
    FROM sheet_long CROSS JOIN (VALUES ('star', 'World', 1.0::DOUBLE, ''), ('nova', 'World', 1.137::DOUBLE, ''),
      ('star', 'Europe', 0.25::DOUBLE, ''), ('nova', 'World', 1.511::DOUBLE, 's30')) AS v(model, region, factor, name)
    WHERE v.name = '' OR scenario_id = 's20'""",
)
_step(
    "pathway_ids",
    """
    SELECT CASE WHEN n > 1 THEN model || '|' || scenario ELSE scenario END AS scenario_id, model, scenario,
      'World' AS region, CASE scenario WHEN 's15' THEN 1.6 WHEN 's30' THEN 2.7 ELSE 2.0 END AS temperature
    FROM (SELECT DISTINCT model, scenario FROM sheet_models WHERE region = 'World')
      JOIN (SELECT scenario, count(DISTINCT model) AS n FROM sheet_models WHERE region = 'World' GROUP BY 1)
        USING (scenario)""",
)
_statement("d11_pathway_catalogue", "pathway_ids", "scenario_id model scenario region", "", "temperature")
_step(
    "model_values",
    """
    SELECT scenario_id, variable, year, value FROM sheet_models
      JOIN pathway_ids USING (model, scenario, region)""",
)
_step(
    "model_net_anchor",
    """
    SELECT scenario_id, year, sum(CASE variable WHEN 'Emissions|CH4' THEN value * 25
      WHEN 'Emissions|N2O' THEN value / 1000 * 298 ELSE value END) AS value
    FROM model_values WHERE year >= 1997 AND value <> 0 GROUP BY ALL""",
)
_statement("d12_scenario_co2e_models", "model_net_anchor", "scenario_id", "year", "value")
_step(
    "model_removal_anchor",
    """
    SELECT scenario_id, year, sum(value) / 10000 AS value FROM model_values
    WHERE year >= 1997 AND value >= 0 GROUP BY ALL""",
)
_step("model_net_line", _line("model_net_anchor", "scenario_id"))
_step("model_net", "SELECT scenario_id, year, value AS net_mt FROM model_net_line")
_step("model_removal_line", _line("model_removal_anchor", "scenario_id"))
_step("model_removal", "SELECT scenario_id, year, -value AS removal_mt FROM model_removal_line")
_statement("d13_net_pathway_models", "model_net", "scenario_id", "year", "net_mt")
_statement("d14_removal_pathway_models", "model_removal", "scenario_id", "year", "removal_mt")
_step(
    "model_landuse",
    """
    SELECT scenario_id, year, total / level AS landuse_mt
    FROM (SELECT scenario_id, (SELECT arg_min(l, (abs(l - temperature), l))
        FROM (VALUES (1.5::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)) AS levels(l)) AS level FROM pathway_ids)
      CROSS JOIN (SELECT year, CAST(sum(landuse) AS DOUBLE) / 1e7 AS total FROM city_gas GROUP BY 1)""",
)
_statement("d15_landuse_by_scenario", "model_landuse", "scenario_id", "year", "landuse_mt")
_step(
    "model_path",
    """
    SELECT scenario_id, year, net_mt, removal_mt, landuse_mt,
      net_mt - landuse_mt AS net_excl_landuse_mt, net_mt - landuse_mt - removal_mt AS positive_mt
    FROM model_net LEFT JOIN model_removal USING (scenario_id, year)
      LEFT JOIN model_landuse USING (scenario_id, year)""",
)
_statement(
    "d16_decompose_pathway_models",
    "model_path",
    "scenario_id",
    "year",
    "net_mt removal_mt landuse_mt net_excl_landuse_mt positive_mt",
)

_step("world_hist", f"SELECT year, {_strict('ghg_mt')} AS value_mt FROM hist GROUP BY 1")
_statement(
    "d17_history_and_pathway_long",
    """(SELECT NULL::VARCHAR AS scenario_id, year, 'Historic Emissions' AS series, value_mt FROM world_hist
      UNION ALL SELECT scenario_id, year, 'Net Emissions with LULUCF', net_mt FROM path
      UNION ALL SELECT scenario_id, year, 'Negative Emissions', removal_mt FROM path
      UNION ALL SELECT scenario_id, year, 'LULUCF Emissions', landuse_mt FROM path
      UNION ALL SELECT scenario_id, year, 'Net Emissions without LULUCF', net_excl_landuse_mt FROM path
      UNION ALL SELECT scenario_id, year, 'Positive Emissions', positive_mt FROM path)""",
    "scenario_id series",
    "year",
    "value_mt",
)
_statement("d18_world_history", "world_hist", "", "year", "value_mt")
_statement(
    "d18_world_history_city",
    f"(SELECT year, {_strict('ghg_mt')} AS value_mt FROM city_hist GROUP BY 1)",
    "",
    "year",
    "value_mt",
)
_statement(
    "d18_world_history_incomplete",
    f"(SELECT year, {_strict('ghg_mt')} AS value_mt FROM hist_strict GROUP BY 1)",
    "",
    "year",
    "value_mt",
)
_step("fut", "SELECT * FROM path WHERE year > 1998")
_step(
    "budget",
    f"""
    SELECT scenario_id, {_strict('positive_mt')} AS positive_budget,
      {_strict('removal_mt')} AS removal_budget
    FROM fut GROUP BY 1""",
)
_statement(
    "d19_remaining_budget",
    "(SELECT *, positive_budget AS budget_mt FROM budget)",
    "scenario_id",
    "",
    "budget_mt",
)
_statement(
    "d19_remaining_budget_removal",
    "(SELECT *, removal_budget AS budget_mt FROM budget)",
    "scenario_id",
    "",
    "budget_mt",
)
_statement(
    "d51_pathway_sanity",
    """(SELECT scenario_id, (SELECT sum(ghg_mt) / 1000 FROM hist WHERE year = 1998) AS observed_gt,
      sum(positive_mt) / 1000 AS projected_gt
    FROM path WHERE year = 1998 GROUP BY 1)""",
    "scenario_id",
    "",
    "observed_gt projected_gt",
)

# -- responsibility --------------------------------------------------------------


def _responsibility(entity: str, hist: str, pop: str, fut: str = "fut", budget: str = "budget") -> str:
    return f"""
    SELECT scenario_id, {entity}, f.year, entity_hist, entity_population, world_hist,
      world_population, entity_population / nullif(world_population, 0) AS share,
      f.positive_mt AS world_positive, f.removal_mt AS world_removal,
      positive_budget, removal_budget,
      ((positive_budget + world_hist) * share - entity_hist) / nullif(positive_budget, 0)
        * f.positive_mt AS positive_mt,
      removal_budget * share / nullif(removal_budget, 0) * f.removal_mt AS removal_mt
    FROM (SELECT {entity}, {_strict('ghg_mt')} AS entity_hist FROM {hist} GROUP BY 1)
      LEFT JOIN (SELECT {entity}, {_strict('population')} AS entity_population FROM {pop} GROUP BY 1)
        USING ({entity})
      CROSS JOIN (SELECT {_strict('ghg_mt')} AS world_hist FROM {hist})
      CROSS JOIN (SELECT {_strict('population')} AS world_population FROM pop)
      CROSS JOIN {fut} AS f JOIN {budget} USING (scenario_id)"""


_step("resp", _responsibility("region", "hist", "pop"))
_statement(
    "d20_responsibility_positive",
    """(SELECT scenario_id, region, year, entity_hist AS entity_hist_mt, entity_population,
      world_positive AS world_mt, positive_budget AS budget_mt, world_hist AS world_hist_mt,
      positive_budget + world_hist AS cumulative_mt, world_population, share AS population_share,
      (positive_budget + world_hist) * share AS entity_cumulative_mt,
      (positive_budget + world_hist) * share - entity_hist AS entity_budget_mt,
      positive_mt AS allocation_mt FROM resp)""",
    "scenario_id region",
    "year",
    "entity_hist_mt entity_population world_mt budget_mt world_hist_mt cumulative_mt "
    "world_population population_share entity_cumulative_mt entity_budget_mt allocation_mt",
)
_statement(
    "d21_responsibility_removal",
    """(SELECT scenario_id, region, year, 0.0 AS entity_hist_mt, entity_population,
      world_removal AS world_mt, removal_budget AS budget_mt, 0.0 AS world_hist_mt,
      removal_budget AS cumulative_mt, world_population, share AS population_share,
      removal_budget * share AS entity_cumulative_mt, removal_budget * share AS entity_budget_mt,
      removal_mt AS allocation_mt FROM resp)""",
    "scenario_id region",
    "year",
    "entity_hist_mt entity_population world_mt budget_mt world_hist_mt cumulative_mt "
    "world_population population_share entity_cumulative_mt entity_budget_mt allocation_mt",
)
_statement(
    "d22_responsibility_wide",
    "(SELECT *, positive_mt + removal_mt AS allocation_mt FROM resp)",
    "scenario_id region",
    "year",
    "positive_mt removal_mt allocation_mt",
)


def _series(entity: str, hist: str, allocation: str) -> str:
    return f"""
    SELECT scenario_id, {entity}, year, ghg_mt AS value_mt FROM {hist} CROSS JOIN scen
    UNION ALL SELECT scenario_id, {entity}, year, positive_mt + removal_mt FROM {allocation}"""


_step("resp_series", _series("region", "hist", "resp"))
_statement("d22_responsibility_total", "resp_series", "scenario_id region", "year", "value_mt")
_step("city_resp", _responsibility("city", "city_hist", "city_pop"))
_step("city_resp_series", _series("city", "city_hist", "city_resp"))
_statement("d29_responsibility_subset", "city_resp_series", "scenario_id city", "year", "value_mt")

# -- capacity ----------------------------------------------------------------------

_step(
    "country_weights",
    """
    SELECT country, year, population, gdp, population * population / gdp AS pop2_gdp
    FROM (SELECT country, year, sum(population) AS population FROM pop WHERE year > 1998 GROUP BY ALL)
      JOIN (SELECT country, year, sum(gdp) AS gdp FROM gdp_rows WHERE year > 1998 GROUP BY ALL)
        USING (country, year)
    WHERE gdp <> 0""",
)
_step(
    "country_wide",
    """
    SELECT scenario_id, country, year, population, gdp, pop2_gdp, pop2_gdp_total, gdp_total,
      f.positive_mt AS given_positive_mt, f.removal_mt AS given_removal_mt,
      f.positive_mt * pop2_gdp / nullif(pop2_gdp_total, 0) AS positive_mt,
      f.removal_mt * gdp / nullif(gdp_total, 0) AS removal_mt, NULL::VARCHAR AS region
    FROM country_weights
      JOIN (SELECT year, sum(pop2_gdp) AS pop2_gdp_total, sum(gdp) AS gdp_total
            FROM country_weights GROUP BY 1) USING (year)
      CROSS JOIN scen LEFT JOIN fut AS f USING (scenario_id, year)""",
)
_step(
    "region_weights",
    """
    SELECT country, region, year, population, gdp, population * population / gdp AS pop2_gdp
    FROM pop JOIN gdp_rows USING (country, region, year) WHERE year > 1998 AND gdp <> 0""",
)
_step(
    "region_wide",
    """
    SELECT scenario_id, country, w.region, year, w.population, w.gdp, w.pop2_gdp, t.pop2_gdp_total,
      t.gdp_total, c.positive_mt AS given_positive_mt, c.removal_mt AS given_removal_mt,
      c.positive_mt * w.pop2_gdp / nullif(t.pop2_gdp_total, 0) AS positive_mt,
      c.removal_mt * w.gdp / nullif(t.gdp_total, 0) AS removal_mt
    FROM region_weights AS w
      JOIN (SELECT country, year, sum(pop2_gdp) AS pop2_gdp_total, sum(gdp) AS gdp_total
            FROM region_weights GROUP BY ALL) AS t USING (country, year)
      CROSS JOIN scen LEFT JOIN country_wide AS c USING (scenario_id, country, year)""",
)
for _level, _ids in (("country", "country"), ("region", "country region")):
    _number_of = {"country": (23, 24, 25), "region": (26, 27, 28)}[_level]
    _statement(
        f"d{_number_of[0]}_capacity_{_level}_positive",
        f"(SELECT *, positive_mt AS allocation_mt FROM {_level}_wide)",
        f"scenario_id {_ids}",
        "year",
        "population gdp given_positive_mt pop2_gdp pop2_gdp_total allocation_mt",
    )
    _statement(
        f"d{_number_of[1]}_capacity_{_level}_removal",
        f"(SELECT *, removal_mt AS allocation_mt FROM {_level}_wide)",
        f"scenario_id {_ids}",
        "year",
        "population gdp given_removal_mt gdp_total allocation_mt",
    )
    _statement(
        f"d{_number_of[2]}_capacity_{_level}_wide",
        f"(SELECT *, positive_mt + removal_mt AS allocation_mt FROM {_level}_wide)",
        f"scenario_id {_ids}",
        "year",
        "population gdp pop2_gdp pop2_gdp_total gdp_total given_positive_mt given_removal_mt "
        "positive_mt removal_mt allocation_mt",
    )
_step("country_hist", "SELECT country, year, sum(ghg_mt) AS ghg_mt FROM hist GROUP BY ALL")
_step("country_cap_series", _series("country", "country_hist", "country_wide"))
_statement(
    "d25_capacity_country_total", "country_cap_series", "scenario_id country", "year", "value_mt"
)
_step("region_cap_series", _series("region", "hist", "region_wide"))
_statement(
    "d28_capacity_region_total", "region_cap_series", "scenario_id region", "year", "value_mt"
)

# -- cities ------------------------------------------------------------------------

_step(
    "city_ratio_rows",
    """
    SELECT c.city, p.country, c.region, p.year, p.population AS region_population, q.population,
      q.population / nullif(p.population, 0) AS own_ratio
    FROM cust AS c JOIN pop AS p USING (region) LEFT JOIN city_pop AS q USING (city, year)
    WHERE year > 1998""",
)
_step(
    "city_ratio",
    """
    SELECT r.* EXCLUDE (own_ratio), max_ratio,
      CASE WHEN max_ratio > 0.3 THEN 1.0 ELSE own_ratio END AS pop_ratio
    FROM city_ratio_rows AS r JOIN (
      SELECT city, max(own_ratio) AS max_ratio FROM city_ratio_rows GROUP BY 1
      HAVING count(own_ratio) = count(*) AND max(own_ratio) < 0.4) USING (city)""",
)
_statement(
    "d30_city_population_ratios",
    "city_ratio",
    "city country region",
    "year",
    "population region_population pop_ratio max_ratio",
)
_step(
    "city_wide",
    """
    SELECT scenario_id, city, country, r.region, year, r.population, region_population, pop_ratio,
      max_ratio, w.positive_mt + w.removal_mt AS region_allocation_mt,
      (w.positive_mt + w.removal_mt) * pop_ratio AS allocation_mt
    FROM city_ratio AS r CROSS JOIN scen
      LEFT JOIN region_wide AS w USING (scenario_id, country, region, year)""",
)
_statement(
    "d30_downscale_by_population",
    "city_wide",
    "scenario_id city country region",
    "year",
    "population region_population pop_ratio max_ratio region_allocation_mt allocation_mt",
)
_step(
    "city_cap_series",
    """
    SELECT scenario_id, city, year, ghg_mt AS value_mt FROM city_hist CROSS JOIN scen
    UNION ALL SELECT scenario_id, city, year, allocation_mt FROM city_wide""",
)
_statement("d30_city_capacity_total", "city_cap_series", "scenario_id city", "year", "value_mt")
_step("city_xy", "SELECT city, custkey % 360 - 180 AS lon, custkey % 180 - 90 AS lat FROM cust")
_statement("d48_point_from_geojson", "city_xy", "city", "", "lon lat")

# -- gaps --------------------------------------------------------------------------


def _gap(series: str, entity: str, second: int) -> str:
    return f"""
    SELECT *, lag(value_mt) OVER (PARTITION BY scenario_id, {entity} ORDER BY year) AS base_mt,
      value_mt - base_mt AS gap_mt
    FROM {series} WHERE year IN (1998, {second})"""


def _clamped(limit: float) -> str:
    return f"greatest(least(gap_mt * 100 / nullif(base_mt, 0), {limit}), -{limit}) AS gap_pct"


_step("gap_resp_next", _gap("resp_series", "region", 1999))
_step("gap_resp", _gap("resp_series", "region", 2000))
_step("gap_country", _gap("country_cap_series", "country", 2000))
_step("gap_region", _gap("region_cap_series", "region", 2000))
_GAP = ("year", "value_mt gap_mt")
_statement("d31_year_gap_responsibility", "gap_resp_next", "scenario_id region", *_GAP)
_statement("d31_year_gap_responsibility_check_year", "gap_resp", "scenario_id region", *_GAP)
_statement("d31_year_gap_capacity_country", "gap_country", "scenario_id country", *_GAP)
_statement("d31_year_gap_capacity_region", "gap_region", "scenario_id region", *_GAP)


def _pct(gap: str, limit: float) -> str:
    return f"""
    SELECT *, {_clamped(limit)}, gap_mt * 100 / nullif(base_mt, 0) AS gap_pct_raw
    FROM {gap} WHERE gap_mt IS NOT NULL AND base_mt <> 0"""


_step("pct_resp", _pct("gap_resp", 50))
_PCT = ("", "gap_mt gap_pct gap_pct_raw")
_statement("d32_pct_gap_responsibility", "pct_resp", "scenario_id region", *_PCT)
_statement(
    "d32_pct_gap_capacity_region", f"({_pct('gap_region', 50)})", "scenario_id region", *_PCT
)
_statement(
    "d32_pct_gap_capacity_country", f"({_pct('gap_country', 50)})", "scenario_id country", *_PCT
)
_statement(
    "d33_rollup_gap",
    """(SELECT scenario_id, substr(region, 1, 3) AS country, year,
      coalesce(sum(gap_mt), 0) AS gap_mt, coalesce(sum(value_mt), 0) AS value_mt
    FROM gap_resp_next GROUP BY ALL)""",
    "scenario_id country",
    "year",
    "gap_mt value_mt",
)


def _rolled(country: str) -> str:
    return f"""
    SELECT *, lag(value_mt) OVER (PARTITION BY scenario_id, country ORDER BY year) AS base_mt
    FROM (SELECT scenario_id, {country} AS country, year, coalesce(sum(gap_mt), 0) AS gap_mt,
        coalesce(sum(value_mt), 0) AS value_mt
      FROM gap_resp GROUP BY ALL)"""


_step("rolled", _rolled("substr(region, 1, 3)"))
_step("pct_rolled", _pct("rolled", 20))
_statement("d33_rollup_pct_gap", "pct_rolled", "scenario_id country", *_PCT)
_SOVEREIGN = (
    "lpad(CAST(CAST({0} AS INT) - CASE WHEN CAST({0} AS INT) % 5 = 4 THEN 1 ELSE 0 END AS VARCHAR), 3, '0')"
)
_step("rolled_sovereign", _rolled(_SOVEREIGN.format("substr(region, 1, 3)")))
_statement(
    "d33_rollup_pct_gap_sovereign",
    f"({_pct('rolled_sovereign', 20)})",
    "scenario_id country",
    *_PCT,
)
_step("rolled_country", _rolled("substr(region, 1, 3)"))
_statement(
    "d33_rollup_gap_levels",
    """(SELECT 'country' AS level, scenario_id, country, NULL::VARCHAR AS sovereign, year, gap_mt, value_mt FROM rolled_country
      UNION ALL SELECT 'sovereign', scenario_id, NULL, country, year, gap_mt, value_mt FROM rolled_sovereign)""",
    "level scenario_id country sovereign",
    "year",
    "gap_mt value_mt",
)
_step(
    "map_units",
    """
    SELECT DISTINCT substr(region, 1, 3) AS country, region, name, hex(encode(region)) AS geometry
    FROM region_orders""",
)
_statement(
    "d34_sovereign_remap",
    f"""(SELECT * REPLACE ({_SOVEREIGN.format('country')} AS country) FROM map_units
    WHERE {_SOVEREIGN.format('country')} <> '010')""",
    "country region name geometry",
)
_step(
    "country_units",
    """
    SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS country, hex(encode(n_name)) AS geometry
    FROM nation""",
)
_statement(
    "d34_drop_codes", "(SELECT * FROM country_units WHERE country <> '010')", "country geometry"
)
_step(
    "class_rows",
    """
    SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS country,
      CASE WHEN n_nationkey <> 17 THEN r_name END AS class_region,
      CASE WHEN n_nationkey IN (13, 17) THEN NULL WHEN n_nationkey % 3 = 0 THEN 'Low'
        WHEN n_nationkey % 3 = 1 THEN 'Middle' ELSE 'High' END AS income_group,
      CASE WHEN n_nationkey % 4 = 0 THEN 'MEMBER' END AS override_group,
      coalesce(override_group, class_region) AS "group"
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)


def _enriched(entity: str, resp: str, cap: str, population: str) -> str:
    return f"""
    SELECT *, avg(population) OVER (PARTITION BY scenario_id, "group") AS group_mean_population
    FROM (
      SELECT r.scenario_id, r.{entity}, r.year, r.value_mt AS resp_mt, c.value_mt AS capc_mt,
        k.country, class_region, income_group, override_group, "group", population,
        r.value_mt * 1e6 / nullif(population, 0) AS resp_t_pc,
        c.value_mt * 1e6 / nullif(population, 0) AS capc_t_pc
      FROM {resp} AS r LEFT JOIN {cap} AS c USING (scenario_id, {entity}, year)
        LEFT JOIN class_rows AS k ON substr(r.{entity}, 1, 3) = k.country
        LEFT JOIN {population} AS p ON p.{entity} = r.{entity} AND p.year = r.year)"""


_step("region_enriched", _enriched("region", "resp_series", "region_cap_series", "pop"))
_step("city_enriched", _enriched("city", "city_resp_series", "city_cap_series", "city_pop"))
_ATTRIBUTES = "country class_region income_group override_group group"
_VALUES = "resp_mt capc_mt population resp_t_pc capc_t_pc"
for _query, _mean in (("attribute_entities", ""), ("group_mean", " group_mean_population")):
    _statement(
        "d35_" + _query,
        "(SELECT * FROM region_enriched "
        "LEFT JOIN (SELECT DISTINCT region, name FROM region_orders) USING (region))",
        f"scenario_id region name {_ATTRIBUTES}",
        "year",
        _VALUES + _mean,
    )
    _statement(
        f"d35_{_query}_city",
        "city_enriched",
        f"scenario_id city {_ATTRIBUTES}",
        "year",
        _VALUES + _mean,
    )

_statement(
    "d35_name_violations",
    """(SELECT DISTINCT 'region_names' AS "table", 'region' AS key, region AS value, 2 AS n_rows
    FROM region_orders WHERE CAST(country AS INT) % 3 = 0)""",
    "table key value",
    "n_rows",
)
_statement(
    "d35_attribute_entities_one_name",
    """(SELECT * FROM region_enriched LEFT JOIN (
      SELECT DISTINCT region, CASE WHEN CAST(country AS INT) % 3 = 0 THEN least(name, 'A ' || name) ELSE name END AS name
      FROM region_orders) USING (region))""",
    f"scenario_id region name {_ATTRIBUTES}",
    "year",
    _VALUES,
)
_statement(
    "d37_base_year_violations",
    """(SELECT scenario_id, city, count(*) FILTER (year = 1998) AS n_rows FROM city_enriched
    GROUP BY ALL HAVING count(*) FILTER (year = 1998) <> 1)""",
    "scenario_id city",
    "n_rows",
)


def _per_capita(by: str) -> str:
    return f"""
    SELECT *, resp_mt * 1e6 / nullif(population, 0) AS resp_t_pc,
      capc_mt * 1e6 / nullif(population, 0) AS capc_t_pc
    FROM (SELECT scenario_id, {by}, year, coalesce(sum(resp_mt), 0) AS resp_mt,
        coalesce(sum(capc_mt), 0) AS capc_mt, coalesce(sum(population), 0) AS population
      FROM region_enriched GROUP BY ALL)"""


_step("country_rollup", _per_capita("country"))
_step("group_rollup", _per_capita('"group"'))
_ROLLUP = ("year", "resp_mt capc_mt population resp_t_pc capc_t_pc")
_step("class_sums", _per_capita("class_region"))
_statement(
    "d36_rollup_levels",
    """(SELECT 'country' AS level, scenario_id, country, NULL::VARCHAR AS "group", NULL::VARCHAR AS class_region, year,
      resp_mt, capc_mt, population, resp_t_pc, capc_t_pc FROM country_rollup
    UNION ALL SELECT 'group', scenario_id, NULL, "group", NULL, year,
      resp_mt, capc_mt, population, resp_t_pc, capc_t_pc FROM group_rollup
    UNION ALL SELECT 'class', scenario_id, NULL, NULL, class_region, year,
      resp_mt, capc_mt, population, resp_t_pc, capc_t_pc FROM class_sums)""",
    "level scenario_id country group class_region",
    *_ROLLUP,
)
_statement("d36_rollup_per_capita_country", "country_rollup", "scenario_id country", *_ROLLUP)
_statement("d36_rollup_per_capita_group", "group_rollup", "scenario_id group", *_ROLLUP)
_statement(
    "d36_year_slice",
    '(SELECT * FROM group_rollup WHERE year = 2000 AND "group" IS NOT NULL)',
    "scenario_id group",
    *_ROLLUP,
)
_statement(
    "d36_rollup_by_class",
    """(SELECT scenario_id, year, class_region, coalesce(sum(resp_mt), 0) AS resp_mt,
      coalesce(sum(capc_mt), 0) AS capc_mt
    FROM region_enriched WHERE class_region IS NOT NULL GROUP BY ALL)""",
    "scenario_id class_region",
    "year",
    "resp_mt capc_mt",
)
for _entity, _source in (
    ("region", "region_enriched"),
    ("country", "country_rollup"),
    ("city", "city_enriched"),
):
    _statement(
        f"d37_index_{_entity}",
        f"""(SELECT t.scenario_id, t.{_entity}, t.year,
          list_position(['007', '003', '018', '001'], t.country) AS display_rank,
          b.capc_t_pc AS capc_base_t_pc, b.resp_t_pc AS resp_base_t_pc,
          t.capc_t_pc / nullif(b.capc_t_pc, 0) AS capc_index,
          t.resp_t_pc / nullif(b.resp_t_pc, 0) AS resp_index
        FROM {_source} AS t LEFT JOIN (SELECT * FROM {_source} WHERE year = 1998) AS b
          USING (scenario_id, {_entity})
        WHERE t.country IN ('007', '003', '018', '001'))""",
        f"scenario_id {_entity}",
        "year display_rank",
        "capc_base_t_pc resp_base_t_pc capc_index resp_index",
    )


def _trend(series: str, value: str, by: str) -> str:
    return f"(SELECT {by} year, {_strict(value)} AS {value} FROM {series} GROUP BY ALL)"


_statement(
    "d50_world_trend_responsibility",
    _trend("resp_series", "value_mt", "scenario_id,"),
    "scenario_id",
    "year",
    "value_mt",
)
_statement(
    "d50_world_trend_capacity",
    _trend("region_cap_series", "value_mt", "scenario_id,"),
    "scenario_id",
    "year",
    "value_mt",
)
_statement(
    "d50_world_trend_city_population",
    _trend("city_pop", "population", ""),
    "",
    "year",
    "population",
)
_statement(
    "d52_attach_to_region_layer",
    """(SELECT * FROM map_units LEFT JOIN (SELECT scenario_id, region, gap_mt, gap_pct, gap_pct_raw
      FROM pct_resp) USING (region))""",
    "region country name geometry scenario_id",
    *_PCT,
)
_statement(
    "d52_attach_to_country_layer",
    """(SELECT * FROM country_units LEFT JOIN (SELECT scenario_id, country, gap_mt, gap_pct, gap_pct_raw
      FROM pct_rolled) USING (country))""",
    "country geometry scenario_id",
    *_PCT,
)

# -- targets -----------------------------------------------------------------------

_step(
    "region_pledge",
    """
    SELECT h.region, h.name, h.country, ghg_mt * 1e6 AS baseline_value,
      CASE WHEN (r.nation * 10 + r.seg) % 5 <> 0 THEN 1995 END AS baseline_year,
      (((r.nation * 10 + r.seg) * 7) % 101 - 40) * 1.001373719::DOUBLE AS cut_pct
    FROM hist AS h JOIN region_orders AS r USING (region, year) WHERE year = 1995""",
)
_step(
    "region_point",
    """
    SELECT region, name, country, baseline_year AS year, baseline_value AS value FROM region_pledge
    WHERE baseline_year IS NOT NULL
    UNION SELECT region, name, country, 2000, baseline_value - cut_pct / 100 * baseline_value
    FROM region_pledge""",
)
_statement(
    "d38_target_points",
    "(SELECT *, value AS value_t FROM region_point)",
    "region name country",
    "year",
    "value_t",
)
_step(
    "city_pledge",
    """
    SELECT city, city_name AS name, country, abs(balance) * 1.001373719::DOUBLE / 1e6 AS baseline_value,
      CASE WHEN custkey % 6 <> 0 THEN 1996 END AS baseline_year,
      CASE WHEN custkey % 101 = 100 THEN 100.0 ELSE custkey % 101 * 1.001373719::DOUBLE END AS cut_pct
    FROM cust""",
)
_step(
    "city_point",
    """
    SELECT city, name, country, baseline_year AS year, baseline_value AS value, 0.0::DOUBLE AS cut_pct
    FROM city_pledge WHERE baseline_year IS NOT NULL AND baseline_value IS NOT NULL
    UNION SELECT city, name, country, 2000,
      CASE WHEN cut_pct = 100 THEN 0 ELSE baseline_value - cut_pct / 100 * baseline_value END, cut_pct
    FROM city_pledge WHERE baseline_value IS NOT NULL""",
)
_statement("d38_target_points_city", "city_point", "city name country", "year", "value cut_pct")
_step(
    "national_raw",
    """
    SELECT country, 2000 AS year, category, CASE WHEN ambition = 'low' AND CAST(country AS INT) % 6 = 5
      THEN NULL ELSE ghg_mt * factor * (0.3::DOUBLE + (CAST(country AS INT) % 7) * 0.17::DOUBLE) END AS value_mt
    FROM country_hist CROSS JOIN (VALUES ('Current', 'low', 0.813579::DOUBLE),
      ('Current', 'high', 0.617283::DOUBLE), ('Other', 'low', 1.234567::DOUBLE),
      ('Other', 'high', 1.012345::DOUBLE)) AS v(category, ambition, factor)
    WHERE year = 1998 AND country <> '024'""",
)
_step(
    "national_point",
    """
    SELECT country, year, avg(value_mt) * 1e6 AS value FROM national_raw
    WHERE category = 'Current' AND value_mt IS NOT NULL GROUP BY ALL
    UNION ALL SELECT country, year + 2, ghg_mt * 1e6 * 0.912345::DOUBLE
    FROM country_hist WHERE country = '024'""",
)
_statement(
    "d39_average_national_pledges",
    "(SELECT *, value AS value_t FROM national_point)",
    "country",
    "year",
    "value_t",
)


def _single(points: str, entity: str) -> str:
    return f"""
    SELECT {entity}, name, country, 1998 AS year, any_value(value) AS value
    FROM {points} GROUP BY {entity}, name, country HAVING count(*) = 1"""


_step("region_anchor", _single("region_point", "region"))
_statement(
    "d40_anchor_single_targets",
    "(SELECT *, value AS value_t FROM region_anchor)",
    "region name country",
    "year",
    "value_t",
)
_statement(
    "d40_anchor_single_targets_observed",
    """(SELECT a.region, a.name, a.country, a.year, ghg_mt * 1e6 AS value_t
    FROM region_anchor AS a LEFT JOIN hist AS h ON h.region = a.region AND h.year = 1998)""",
    "region name country",
    "year",
    "value_t",
)


def _lowest(points: str, anchors: str, entity: str) -> str:
    return f"""
    SELECT {entity}, name, country, year, min(value) AS value
    FROM (SELECT {entity}, name, country, year, value FROM {points}
      UNION SELECT {entity}, name, country, year, value FROM {anchors})
    GROUP BY ALL"""


_step("region_lowest", _lowest("region_point", "region_anchor", "region"))
_step("region_track", _line("region_lowest", "region, name, country"))
_step("region_target", "SELECT * EXCLUDE (value), value / 1e6 AS target_mt FROM region_track")
_statement("d41_target_trajectory", "region_target", "region name country", "year", "target_mt")
_step("city_anchor", _single("city_point", "city"))
_step("city_lowest", _lowest("city_point", "city_anchor", "city"))
_step("city_track", _line("city_lowest", "city, name, country"))
_step("city_target", "SELECT * EXCLUDE (value), value AS target_mt FROM city_track")
_statement("d41_target_trajectory_city", "city_target", "city name country", "year", "target_mt")
_step("country_target", "SELECT country, year, value / 1e6 AS target_mt FROM national_point")


def _flags(values: str, target: str, entity: str) -> str:
    return f"""(
    SELECT scenario_id, {entity}, year, target_mt, resp_mt, capc_mt,
      CASE WHEN resp_mt > target_mt THEN 1 WHEN resp_mt < target_mt THEN 0 END AS resp_fair,
      CASE WHEN capc_mt > target_mt THEN 1 WHEN capc_mt < target_mt THEN 0 END AS capc_fair,
      CAST(resp_fair + capc_fair AS VARCHAR) AS fair_rules
    FROM {target} CROSS JOIN scen
      LEFT JOIN (SELECT scenario_id, {entity}, year, resp_mt, capc_mt FROM {values})
        USING (scenario_id, {entity}, year)
    WHERE year = 2000)"""


_FLAGS = ("year resp_fair capc_fair", "target_mt resp_mt capc_mt")
_statement(
    "d42_fairness_flags_region",
    _flags("region_enriched", "region_target", "region"),
    "scenario_id region fair_rules",
    *_FLAGS,
)
_statement(
    "d42_fairness_flags_country",
    _flags("country_rollup", "country_target", "country"),
    "scenario_id country fair_rules",
    *_FLAGS,
)

# -- alignment ---------------------------------------------------------------------


def _pair(values: str, entity: str) -> str:
    return f"""
    SELECT w.{entity}, w.year, w.resp_mt AS resp_mt_20, w.capc_mt AS capc_mt_20,
      t.resp_mt AS resp_mt_15, t.capc_mt AS capc_mt_15
    FROM (SELECT * FROM {values} WHERE scenario_id = 's20') AS w
      LEFT JOIN (SELECT * FROM {values} WHERE scenario_id = 's15') AS t USING ({entity}, year)"""


_step("model_fut", "SELECT * FROM model_path WHERE year > 1998")
_step(
    "model_budget",
    f"""
    SELECT scenario_id, {_strict('positive_mt')} AS positive_budget,
      {_strict('removal_mt')} AS removal_budget
    FROM model_fut GROUP BY 1""",
)
_step("model_resp", _responsibility("region", "hist", "pop", "model_fut", "model_budget"))
_step(
    "model_allocations",
    """
    SELECT model, scenario, m.region, year, positive_mt + removal_mt AS allocation_mt
    FROM model_resp AS m JOIN pathway_ids USING (scenario_id)""",
)
_statement(
    "d43_pair_scenarios_models",
    """(SELECT w.model, w.region, w.year, w.allocation_mt AS allocation_mt_20, t.allocation_mt AS allocation_mt_15
    FROM (SELECT * FROM model_allocations WHERE scenario = 's20') AS w
      LEFT JOIN (SELECT * FROM model_allocations WHERE scenario = 's15') AS t USING (model, region, year))""",
    "model region",
    "year",
    "allocation_mt_20 allocation_mt_15",
)


def _classes(entity: str, drop_null: bool) -> str:
    kept = "WHERE alignment IS NOT NULL" if drop_null else ""
    country = "" if entity == "country" else "t.country, "
    return f"""
    SELECT * FROM (
      SELECT t.{entity}, {country}t.year, target_mt, (resp_mt_15 + capc_mt_15) / 2 AS mean_15_mt,
        (resp_mt_20 + capc_mt_20) / 2 AS mean_20_mt,
        CASE WHEN mean_15_mt > target_mt THEN '1.5 °C' WHEN mean_20_mt > target_mt THEN '2.0 °C'
          WHEN mean_20_mt < target_mt THEN '> 2.0 °C' END AS alignment
      FROM {entity}_target AS t LEFT JOIN {entity}_pair AS p USING ({entity}, year)
      WHERE t.year = 2000) {kept}"""


_step(
    "city_allocations",
    """
    SELECT scenario_id, city, year, r.value_mt AS resp_mt, c.value_mt AS capc_mt
    FROM city_resp_series AS r LEFT JOIN city_cap_series AS c USING (scenario_id, city, year)""",
)
for _entity, _source, _drop in (
    ("region", "region_enriched", False),
    ("country", "country_rollup", True),
    ("city", "city_allocations", True),
):
    _step(f"{_entity}_pair", _pair(_source, _entity))
    _statement(
        f"d43_pair_scenarios_{_entity}",
        f"{_entity}_pair",
        _entity,
        "year",
        "resp_mt_20 capc_mt_20 resp_mt_15 capc_mt_15",
    )
    _step(f"{_entity}_class", _classes(_entity, _drop))
    _statement(
        f"d44_classify_alignment_{_entity}",
        f"{_entity}_class",
        f"{_entity} alignment" + ("" if _entity == "country" else " country"),
        "year",
        "target_mt mean_15_mt mean_20_mt",
    )
_statement(
    "d48_classified_city_points",
    "(SELECT * FROM city_class LEFT JOIN city_xy USING (city))",
    "city country alignment",
    "year",
    "target_mt mean_15_mt mean_20_mt lon lat",
)
_step(
    "alignment_counts",
    """
    SELECT 'Region' AS entity_type, alignment, count(*) AS n FROM region_class GROUP BY ALL
    UNION ALL SELECT 'Country', alignment, count(*) FROM country_class GROUP BY ALL
    UNION ALL SELECT 'City', alignment, count(*) FROM city_class GROUP BY ALL""",
)
_PERCENT = "round_even(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY entity_type) * 100, 2) AS percent"
_statement(
    "d45_alignment_summary",
    f"(SELECT *, {_PERCENT} FROM alignment_counts)",
    "entity_type alignment",
    "n",
    "percent",
)
_step(
    "ambition_rows",
    """
    SELECT e.country, entity_id, e.year, e.alignment AS entity_alignment, entity_type,
      c.alignment AS country_alignment,
      CASE WHEN e.alignment IN ('1.5 °C', '2.0 °C') AND c.alignment = '> 2.0 °C' THEN 'More Ambitious'
        WHEN e.alignment = c.alignment THEN 'As Ambitious' ELSE 'Less Ambitious' END AS ambition,
      list_position(['1.5 °C', '2.0 °C', '> 2.0 °C'], e.alignment)
        - list_position(['1.5 °C', '2.0 °C', '> 2.0 °C'], c.alignment) AS lead_by
    FROM (SELECT country, region AS entity_id, year, alignment, 'Region' AS entity_type FROM region_class
      UNION ALL SELECT country, city, year, alignment, 'City' FROM city_class) AS e
      LEFT JOIN country_class AS c USING (country, year)""",
)
_AMBITION = "country entity_id entity_alignment entity_type country_alignment ambition"
_statement("d46_relative_ambition", "ambition_rows", _AMBITION, "year")
_statement(
    "d46_relative_ambition_strict",
    """(SELECT * REPLACE (CASE WHEN entity_alignment IS NULL OR country_alignment IS NULL THEN NULL
      WHEN lead_by < 0 THEN 'More Ambitious' WHEN lead_by = 0 THEN 'As Ambitious'
      ELSE 'Less Ambitious' END AS ambition) FROM ambition_rows)""",
    _AMBITION,
    "year",
)
_statement(
    "d47_ambition_summary",
    f"""(SELECT *, {_PERCENT} FROM (
      SELECT entity_type, ambition, count(*) AS n FROM ambition_rows GROUP BY ALL))""",
    "entity_type ambition",
    "n",
    "percent",
)

# -- scale -------------------------------------------------------------------------


def _breaks(bounds: str, curve: str = "", back: str = "") -> str:
    return f"""(
    SELECT position, break FROM (SELECT {curve}(lo) AS lo, {curve}(hi) AS hi FROM ({bounds}))
      CROSS JOIN LATERAL (VALUES (0, {back}(lo)), (1, {back}(lo * (2.0::DOUBLE / 3))),
        (2, {back}(lo / 3)), (3, 0.0::DOUBLE), (4, {back}(hi / 3)), (5, {back}(hi * (2.0::DOUBLE / 3))),
        (6, {back}(hi))) AS v(position, break))"""


_BREAKS = ("", "position", "break")
_statement(
    "d49_diverging_breaks_linear",
    _breaks("SELECT min(gap_pct_raw) / 100 AS lo, max(gap_pct_raw) / 100 AS hi FROM pct_resp"),
    *_BREAKS,
)
_statement(
    "d49_diverging_breaks_linear_bounded",
    _breaks("SELECT -50.0::DOUBLE AS lo, max(gap_pct_raw) AS hi FROM pct_resp"),
    *_BREAKS,
)
_statement(
    "d49_diverging_breaks_asinh",
    _breaks(
        "SELECT min(gap_mt) / 0.01::DOUBLE AS lo, max(gap_mt) / 0.01::DOUBLE AS hi FROM pct_resp",
        "asinh",
        "sinh",
    ),
    *_BREAKS,
)
_statement(
    "d49_diverging_breaks_asinh_bounded",
    _breaks("SELECT min(gap_pct_raw) AS lo, 300.0::DOUBLE AS hi FROM pct_resp", "asinh", "sinh"),
    *_BREAKS,
)
