"""Domain frames derived from the star-schema tables.

Country = nation, region = nation x market segment, city = customer, year =
order year, gas = return flag.  The one expensive pass (lineitem, orders,
customer) is written once as a city x year table in the shared folder, and a
region x year table is summed from it; every frame below starts from those two.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from carbonsplit.operators import capacity, cities, enrich, panel, pathway, responsibility, targets
from carbonsplit.operators.constraints import Uniqueness
from carbonsplit.sources import (
    SCHEMAS,
    bucketed_table,
    counted_csv,
    read_parquet,
    release_tables,
    shared_path,
    shared_table,
    written_tables,
)

CUTOFF = 1998
BASE_YEAR = 1998
CHECK_YEAR = 2000
PANEL_START = 1995
PATHWAY_START = 1997
ANCHOR_YEARS = (1995, 1997, 1999, 2001)
LEVEL = 2.0
TIGHT, WIDE = "s15", "s20"
# Many digits keep results away from rounding ties at the query boundary.
SCENARIO_FACTORS = {TIGHT: 0.537219, WIDE: 0.912743}
CUT_FACTOR = 1.001373719
TONNES_PER_UNIT = 1.047197551
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
GASES = {"A": "co2_t", "N": "ch4_t", "R": "n2o_t"}
GAS_NAMES = {"co2_t": "CO2", "ch4_t": "CH4", "n2o_t": "N2O"}
SHEET_IDS = ("model", "scenario_id", "region", "unit", "variable")
SMALL_POPULATION = 8
RATIO_LO, RATIO_HI = 0.3, 0.4
MICRO_CODES = ("021", "022")
DROPPED_SOVEREIGNS = ("010",)
# Warming levels that scenarios name, between those of the land-use table.
SCENARIO_LEVELS = {"s15": 1.6, "s30": 2.7}
# Tables of one row or more per city, kept in buckets of the city.
BY_CITY = frozenset(
    {"city_year", "city_map_table", "city_history_table", "city_responsibility", "city_wide", "city_capacity", "city_attributed", "city_targets"}
)
DISPLAY_COUNTRIES = ("007", "003", "018", "001")


class Star:
    """Frames over one folder of star-schema tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._stored: dict[str, DataFrame] = {}
        self._folders: set[str] = set()

    def table(self, name: str) -> DataFrame:
        return read_parquet(self.spark, f"{self.folder}/{name}.parquet")

    def stored(self, name: str) -> DataFrame:
        """The frame ``name`` as a table in the shared folder, written on first use.

        Results that several later steps read are kept this way, so each is
        computed once and the plans after it start from files.
        """
        if name not in self._stored:
            frame = getattr(self, name)
            before = set(written_tables(self.spark))
            self._stored[name] = bucketed_table(frame, name, "city") if name in BY_CITY else shared_table(frame, name)
            self._folders |= set(written_tables(self.spark)) - before
        return self._stored[name]

    def once(self, name: str) -> DataFrame:
        """The stored table if there is one, else the frame itself: for steps that need few of its rows or columns."""
        return self._stored[name] if name in self._stored else getattr(self, name)

    def close(self) -> None:
        """Remove the stored tables; frames of this object must not be used any more."""
        release_tables(self.spark, self._folders)
        self._folders.clear()
        self._stored.clear()

    # -- base tables ---------------------------------------------------------

    @cached_property
    def customers(self) -> DataFrame:
        """City attributes, straight from the customer table."""
        segment = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment")) - 1
        return (
            self.table("customer")
            .withColumns({"segment": segment.cast("int"), "country": _code("c_nationkey")})
            .select(
                F.col("c_custkey").alias("custkey"),
                F.concat_ws("-", "country", F.col("c_custkey").cast("string")).alias("city"),
                "country",
                F.concat(
                    "country", F.lit("."), F.col("segment").cast("string"), F.lit("_1")
                ).alias("region"),
                F.col("c_nationkey").alias("nation"),
                "segment",
                F.concat_ws(" ", "country", "c_mktsegment").alias("region_name"),
                F.col("c_name").alias("city_name"),
                F.col("c_acctbal").alias("balance"),
            )
        )

    @cached_property
    def city_year(self) -> DataFrame:
        """Orders, turnover and gas amounts per city and year.

        Money is summed in whole hundredths (exact, and cheaper than decimals).
        Lines are summed per order first: one shuffle of the line table, hot
        orders collapse before it, and the join with orders reuses its
        partitioning.  Customers are attached after the sum per customer and
        year, so a customer with most of the orders is a handful of rows there.
        """
        lines = self.table("lineitem").groupBy("l_orderkey").agg(
            *[
                F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))).alias(gas)
                for flag, gas in GASES.items()
            ],
            F.sum(_hundredths("l_extendedprice") * _hundredths("l_discount")).alias("landuse_e4"),
        )
        orders = self.table("orders").select(
            "o_orderkey",
            F.col("o_custkey").alias("custkey"),
            F.year("o_orderdate").alias("year"),
            _hundredths("o_totalprice").alias("price_e2"),
        )
        per_city = (
            orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .groupBy("custkey", "year")
            .agg(
                F.count(F.lit(1)).alias("n_orders"),
                F.sum("price_e2").alias("turnover_e2"),
                *[F.sum(gas).alias(gas) for gas in GAS_NAMES],
                F.sum("landuse_e4").alias("landuse_e4"),
            )
        )
        return per_city.join(self.customers, "custkey")

    @cached_property
    def region_year(self) -> DataFrame:
        return self.stored("city_year").groupBy(
            "country", "region", "nation", "segment", F.col("region_name").alias("name"), "year"
        ).agg(
            F.sum("n_orders").alias("n_orders"),
            F.sum("turnover_e2").alias("turnover_e2"),
            *[F.sum(gas).alias(gas) for gas in GAS_NAMES],
            F.sum("landuse_e4").alias("landuse_e4"),
        )

    # -- region panels -------------------------------------------------------

    @cached_property
    def region_emissions_long(self) -> DataFrame:
        """Gas rows up to the cutoff; the CH4 amounts of country 024 are unknown."""
        rows = _gas_rows(
            self.stored("region_year").withColumn("sector", F.lit("TOTAL")),
            ["country", "region", "name", "sector"],
        )
        unknown = (F.col("country") == "024") & (F.col("gas") == "CH4")
        return rows.withColumn("amount_t", F.when(~unknown, F.col("amount_t")))

    @property
    def history(self) -> DataFrame:
        return self.stored("history_table")

    @property
    def city_history(self) -> DataFrame:
        return self.stored("city_history_table")

    @cached_property
    def history_table(self) -> DataFrame:
        """Regional history with unreported gases taken as zero."""
        long = _gas_rows(
            self.stored("region_year").withColumn("sector", F.lit("TOTAL")),
            ["country", "region", "name", "sector"],
        )
        return panel.co2e_total(
            long, ["country", "region", "name", "sector"], since=PANEL_START, missing=0.0
        )

    @cached_property
    def population(self) -> DataFrame:
        return self.stored("region_year").select(
            "country", "region", "year", F.col("n_orders").cast("double").alias("population")
        )

    @cached_property
    def population_with_gaps(self) -> DataFrame:
        """As ``population``, but unknown in country 021 in 1996."""
        gap = (F.col("country") == "021") & (F.col("year") == 1996)
        return self.population.withColumn("population", F.when(~gap, F.col("population")))

    @cached_property
    def fractional_city_population(self) -> DataFrame:
        """Quarter people per order, so that rounding has ties."""
        return self.stored("city_year").select(
            "country", "city", "year", (F.col("n_orders") * F.lit(0.25)).alias("population")
        )

    @cached_property
    def gdp(self) -> DataFrame:
        """Turnover; zero in country 023 and in one region of country 022."""
        zero = (F.col("country") == "023") | (F.col("region") == "022.1_1")
        return self.stored("region_year").select(
            "country",
            "region",
            "year",
            F.when(zero, F.lit(0.0)).otherwise(F.col("turnover_e2") / F.lit(1e2)).alias("gdp"),
        )

    @cached_property
    def profile(self) -> DataFrame:
        return panel.intensity_profile(
            panel.entity_year_panel(self.history, self.population_with_gaps, self.gdp)
        )

    @cached_property
    def screens(self) -> list[tuple[DataFrame, str]]:
        """The ids that any screen lists, written once for all frames that are screened."""
        return panel.screened_ids(self._screens())

    def _screens(self) -> list[tuple[DataFrame, str]]:
        return [
            (
                panel.small_population_screen(
                    self.population_with_gaps, self.gdp, SMALL_POPULATION
                ),
                "region",
            ),
            (panel.zero_denominator_screen(self.stored("profile"), "gdp"), "region"),
            (panel.code_screen(self.stored("profile"), MICRO_CODES), "country"),
        ]

    # -- pathway -------------------------------------------------------------

    @cached_property
    def sheet(self) -> DataFrame:
        """Wide scenario sheet with one column per anchor year."""
        yearly = (
            self.stored("region_year").where(F.col("year").isin(*ANCHOR_YEARS))
            .groupBy("year")
            .agg(
                *[(F.sum(gas) * F.lit(TONNES_PER_UNIT)).alias(gas) for gas in GAS_NAMES],
                (_wide_sum("turnover_e2") / F.lit(1e2)).alias("turnover"),
            )
        )
        factors = F.explode(
            F.array(
                *[
                    F.struct(F.lit(s).alias("scenario_id"), F.lit(f).alias("factor"))
                    for s, f in SCENARIO_FACTORS.items()
                ]
            )
        )
        factor = F.col("f.factor")
        swing = F.when(F.col("year") < 1999, 0.05).when(F.col("year") > 1999, -0.05).otherwise(0.0)
        variables = {
            ("Emissions|CO2", "Mt CO2/yr"): F.col("co2_t") / 1e6 * factor,
            ("Emissions|CH4", "Mt CH4/yr"): F.col("ch4_t") / 1e6 * factor,
            ("Emissions|N2O", "kt N2O/yr"): F.col("n2o_t") / 1e3 * factor,
            ("Emissions|CO2|AFOLU", "Mt CO2/yr"): F.col("co2_t") / 1e6 * factor * swing,
            ("Price|Carbon", "USD"): F.col("turnover") / 1e6,
        }
        values = F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("variable"), F.lit(unit).alias("unit"), v.alias("value")
                    )
                    for (name, unit), v in variables.items()
                ]
            )
        )
        return (
            yearly.withColumn("f", factors)
            .withColumn("v", values)
            .select(
                F.lit("star").alias("model"),
                F.col("f.scenario_id").alias("scenario_id"),
                F.lit("World").alias("region"),
                "v.unit",
                "v.variable",
                "year",
                "v.value",
            )
            .groupBy(*SHEET_IDS)
            .pivot("year", list(ANCHOR_YEARS))
            .agg(F.sum("value"))
        )

    @cached_property
    def sheet_of_models(self) -> DataFrame:
        """The sheet with a second model, a second region, and a scenario that one model alone has."""
        copies = F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("model"), F.lit(r).alias("region"), F.lit(f).alias("factor"), F.lit(n).alias("name"))
                    for m, r, f, n in (
                        ("star", "World", 1.0, ""),
                        ("nova", "World", 1.137, ""),
                        ("star", "Europe", 0.25, ""),
                        ("nova", "World", 1.511, "s30"),
                    )
                ]
            )
        )
        rows = self.sheet.withColumn("c", copies).where((F.col("c.name") == "") | (F.col("scenario_id") == WIDE))
        return rows.select(
            F.col("c.model").alias("model"),
            F.when(F.col("c.name") != "", F.col("c.name")).otherwise(F.col("scenario_id")).alias("scenario_id"),
            F.col("c.region").alias("region"),
            "unit",
            "variable",
            *[(F.col(str(y)) * F.col("c.factor")).alias(str(y)) for y in ANCHOR_YEARS],
        )

    @cached_property
    def catalogue(self) -> DataFrame:
        return pathway.pathway_catalogue(self.sheet_of_models, "World", LEVEL, SCENARIO_LEVELS)

    @cached_property
    def sheet_by_pathway(self) -> DataFrame:
        return pathway.select_pathways(self.sheet_of_models, self.stored("catalogue"))

    @cached_property
    def pathway_of_models(self) -> DataFrame:
        return pathway.decompose_pathway(
            pathway.net_pathway(self.sheet_by_pathway, SHEET_IDS, since=PATHWAY_START),
            pathway.removal_pathway(self.sheet_by_pathway, SHEET_IDS, since=PATHWAY_START),
            pathway.landuse_by_scenario(self.landuse_table, self.stored("catalogue")),
        )

    @cached_property
    def landuse_table(self) -> DataFrame:
        """Land-use series per warming level."""
        return (
            self.stored("region_year").groupBy("year")
            .agg((_wide_sum("landuse_e4") / F.lit(1e4)).alias("total"))
            .withColumn("temperature", F.explode(F.array(F.lit(1.5), F.lit(2.0), F.lit(3.0))))
            .select(
                "temperature",
                "year",
                (F.col("total") / F.lit(1e7) / F.col("temperature")).alias("landuse_mt"),
                (F.col("total") / F.lit(1e7)).alias("landuse_total_mt"),
            )
        )

    @cached_property
    def net(self) -> DataFrame:
        return pathway.net_pathway(self.sheet, SHEET_IDS, since=PATHWAY_START)

    @cached_property
    def removal(self) -> DataFrame:
        return pathway.removal_pathway(self.sheet, SHEET_IDS, since=PATHWAY_START)

    @cached_property
    def landuse(self) -> DataFrame:
        return pathway.pick_landuse(self.landuse_table, LEVEL)

    @cached_property
    def pathway(self) -> DataFrame:
        return pathway.decompose_pathway(self.net, self.removal, self.landuse)

    @cached_property
    def scenarios(self) -> DataFrame:
        return responsibility.scenarios(self.stored("pathway"))

    # -- allocations ---------------------------------------------------------

    @cached_property
    def region_responsibility(self) -> DataFrame:
        return responsibility.responsibility_total(
            self.history, self.population, self.stored("pathway"), CUTOFF
        )

    @cached_property
    def country_capacity_wide(self) -> DataFrame:
        return capacity.capacity_country_wide(self.population, self.gdp, self.stored("pathway"), CUTOFF)

    @cached_property
    def country_capacity(self) -> DataFrame:
        return capacity.capacity_country_total(
            self.history, self.population, self.gdp, self.stored("pathway"), CUTOFF
        )

    @cached_property
    def region_capacity_wide(self) -> DataFrame:
        return capacity.capacity_region_wide(
            self.population, self.gdp, self.country_capacity_wide, self.stored("pathway"), CUTOFF
        )

    @cached_property
    def region_capacity(self) -> DataFrame:
        return capacity.capacity_region_total(
            self.history, self.region_capacity_wide, self.stored("pathway")
        )

    # -- cities --------------------------------------------------------------

    @cached_property
    def city_emissions_long(self) -> DataFrame:
        """City gas rows up to the cutoff, with a gas that carries no weight."""
        rows = self.stored("city_year").withColumns(
            {"sector": F.lit("TOTAL"), "bio_t": F.col("co2_t") * F.lit(2.0)}
        )
        return _gas_rows(rows, ["city", "sector"], {**GAS_NAMES, "bio_t": "CO2bio"})

    @cached_property
    def city_history_table(self) -> DataFrame:
        return panel.co2e_total(
            self.city_emissions_long, ["city", "sector"], since=PANEL_START, missing=0.0
        )

    @cached_property
    def city_population(self) -> DataFrame:
        return self.stored("city_year").select(
            "city", "year", F.col("n_orders").cast("double").alias("population")
        )

    @property
    def city_map(self) -> DataFrame:
        return self.stored("city_map_table")

    @cached_property
    def city_map_table(self) -> DataFrame:
        return self.customers.select("city", "region")

    @cached_property
    def city_responsibility(self) -> DataFrame:
        return responsibility.responsibility_total(
            self.city_history,
            self.city_population,
            self.stored("pathway"),
            CUTOFF,
            entity="city",
            world_population=self.population,
        )

    @cached_property
    def city_wide(self) -> DataFrame:
        return cities.downscale_by_population(
            self.city_map,
            self.population,
            self.city_population,
            self.stored("region_capacity_wide"),
            self.stored("pathway"),
            CUTOFF,
            RATIO_LO,
            RATIO_HI,
        )

    @cached_property
    def city_capacity(self) -> DataFrame:
        return cities.city_capacity_total(self.city_history, self.stored("city_wide"), self.stored("pathway"))

    @cached_property
    def city_points(self) -> DataFrame:
        key = F.col("custkey")
        return self.customers.select(
            "city",
            F.format_string(
                '{"type":"Point","coordinates":[%d,%d]}', key % 360 - 180, key % 180 - 90
            ).alias("centroid"),
        )

    # -- dimensions ----------------------------------------------------------

    @cached_property
    def nations(self) -> DataFrame:
        return self.table("nation").withColumn("country", _code("n_nationkey"))

    @cached_property
    def names(self) -> DataFrame:
        return self.stored("region_year").select("region", "name").distinct()

    @cached_property
    def several_names(self) -> DataFrame:
        """Region names with a second one for the regions of every third country."""
        second = self.names.where(F.substring("region", 1, 3).cast("int") % 3 == 0)
        return self.names.unionByName(second.withColumn("name", F.concat(F.lit("A "), "name")))

    def unique_names(self) -> tuple[DataFrame, DataFrame]:
        """One name per region, and the regions that had several."""
        unique = Uniqueness()
        return unique.one_per_key("region_names", self.several_names, ["region"]), unique.violations()

    def scanned_csv(self) -> tuple[DataFrame, dict[str, int]]:
        """Pledges written as CSV with columns of other names and cells that are no numbers, and read back."""
        key = F.col("custkey")
        path = shared_path(self.spark, "pledges-csv")
        text = self.customers.select(
            F.col("country").alias("iso"),
            F.when(key % 7 == 0, "n/a").when(key % 5 == 0, "2030.0").otherwise("2030").alias("when"),
            F.when(key % 13 == 0, "x").when(key % 11 != 0, F.col("balance").cast("string")).alias("amount"),
            F.col("city_name").alias("more"),
        )
        text.write.option("header", True).csv(path)
        names = {"iso": "country", "when": "year", "amount": "value"}
        rows, seen = counted_csv(self.spark, path, SCHEMAS["extra_pledges"], names)
        return shared_table(rows, "pledges"), dict(seen.get)

    @cached_property
    def classes(self) -> DataFrame:
        """Class region and income group; country 017 has neither, 013 no income group."""
        key = F.col("n_nationkey")
        income = F.when(key != 13, F.element_at(F.array(F.lit("Low"), F.lit("Middle"), F.lit("High")), (key % 3 + 1).cast("int")))
        return (
            self.nations.join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                "country",
                F.when(key != 17, F.col("r_name")).alias("class_region"),
                F.when(key != 17, income).alias("income_group"),
            )
        )

    @cached_property
    def members(self) -> DataFrame:
        return self.nations.where(F.col("n_nationkey") % 4 == 0).select(
            "country", F.lit("MEMBER").alias("override_group")
        )

    @cached_property
    def sovereigns(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.nations.select(
            "country",
            F.lpad((key - F.when(key % 5 == 4, 1).otherwise(0)).cast("string"), 3, "0").alias(
                "sovereign"
            ),
        )

    @cached_property
    def region_layer(self) -> DataFrame:
        """Map units: every region ever seen, geometry as opaque bytes."""
        return self.names.select(
            F.substring("region", 1, 3).alias("country"),
            "region",
            "name",
            F.encode("region", "UTF-8").alias("geometry"),
        )

    @cached_property
    def country_layer(self) -> DataFrame:
        return self.nations.select("country", F.encode("n_name", "UTF-8").alias("geometry"))

    # -- enriched views ------------------------------------------------------

    @cached_property
    def region_attributed(self) -> DataFrame:
        return enrich.attribute_entities(
            self.stored("region_responsibility"),
            self.stored("region_capacity"),
            self.population,
            self.classes,
            self.members,
            names=self.names,
        )

    @cached_property
    def city_attributed(self) -> DataFrame:
        return enrich.attribute_entities(
            self.stored("city_responsibility"),
            self.stored("city_capacity"),
            self.city_population,
            self.classes,
            self.members,
            entity="city",
        )

    @cached_property
    def country_rollup(self) -> DataFrame:
        return enrich.rollup_per_capita(self.stored("region_attributed"), ["country", "year"])

    # -- pledges -------------------------------------------------------------

    @cached_property
    def region_pledges(self) -> DataFrame:
        """Cut against 1995; every fifth region states no baseline year."""
        number = F.col("nation") * 10 + F.col("segment")
        ids = self.stored("region_year").where(F.col("year") == 1995).select("region", "nation", "segment")
        return (
            self.history.where(F.col("year") == 1995)
            .join(ids, "region")
            .select(
                "region",
                "name",
                "country",
                (F.col("ghg_mt") * F.lit(1e6)).alias("baseline_value"),
                F.when(number % 5 != 0, F.lit(1995)).alias("baseline_year"),
                (((number * 7) % 101 - 40) * F.lit(CUT_FACTOR)).alias("cut_pct"),
                F.lit(CHECK_YEAR).alias("target_year"),
            )
        )

    @cached_property
    def city_pledges(self) -> DataFrame:
        """Cut against 1996, up to all of it; every sixth city states no baseline year."""
        cut = F.col("custkey") % 101
        return self.customers.select(
            "city",
            F.col("city_name").alias("name"),
            "country",
            (F.abs("balance") * F.lit(CUT_FACTOR)).alias("baseline_value"),
            F.when(F.col("custkey") % 6 != 0, F.lit(1996)).alias("baseline_year"),
            F.when(cut == 100, F.lit(100.0)).otherwise(cut * F.lit(CUT_FACTOR)).alias("cut_pct"),
            F.lit(CHECK_YEAR).alias("target_year"),
        )

    @cached_property
    def country_history(self) -> DataFrame:
        return self.history.groupBy("country", "year").agg(F.sum("ghg_mt").alias("ghg_mt"))

    @cached_property
    def national_pledges(self) -> DataFrame:
        """Two ambition variants per country and category, some of them unknown."""
        key = F.col("country").cast("int")
        variants = F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("category"),
                        F.lit(a).alias("ambition"),
                        F.lit(f).alias("factor"),
                    )
                    for c, a, f in (
                        ("Current", "low", 0.813579),
                        ("Current", "high", 0.617283),
                        ("Other", "low", 1.234567),
                        ("Other", "high", 1.012345),
                    )
                ]
            )
        )
        unknown = (F.col("v.ambition") == "low") & (key % 6 == 5)
        value = F.col("ghg_mt") * F.col("v.factor") * (F.lit(0.3) + (key % 7) * F.lit(0.17))
        return (
            self.country_history.where((F.col("year") == CUTOFF) & (F.col("country") != "024"))
            .withColumn("v", variants)
            .select(
                "country",
                "v.category",
                "v.ambition",
                F.lit(CHECK_YEAR).alias("year"),
                F.when(~unknown, value).alias("value_mt"),
            )
        )

    @cached_property
    def extra_pledges(self) -> DataFrame:
        """A whole series of its own for country 024, in tonnes."""
        return self.country_history.where(F.col("country") == "024").select(
            "country",
            (F.col("year") + 2).alias("year"),
            (F.col("ghg_mt") * F.lit(1e6) * F.lit(0.912345)).alias("value"),
        )

    @cached_property
    def region_points(self) -> DataFrame:
        return targets.target_points(self.region_pledges)

    @cached_property
    def region_targets(self) -> DataFrame:
        anchors = targets.anchor_single_targets(self.region_points, year=BASE_YEAR)
        return targets.target_trajectory(self.region_points, anchors)

    @cached_property
    def country_targets(self) -> DataFrame:
        return targets.average_national_pledges(
            self.national_pledges, self.extra_pledges
        ).select("country", "year", (F.col("value") / F.lit(1e6)).alias("target_mt"))

    @cached_property
    def city_target_points(self) -> DataFrame:
        return targets.target_points(
            self.city_pledges, entity="city", scale=panel.TONNES_PER_MT, with_cut=True
        )

    @cached_property
    def city_targets(self) -> DataFrame:
        points = self.city_target_points.drop("cut_pct")
        anchors = targets.anchor_single_targets(points, entity="city", year=BASE_YEAR)
        return targets.target_trajectory(points, anchors, entity="city", scale=1.0)


def _hundredths(column: str) -> Column:
    return F.rint(F.col(column) * F.lit(100.0)).cast("bigint")


def _wide_sum(column: str) -> Column:
    """Exact sum of many large integers, as a double."""
    return F.sum(F.col(column).cast("decimal(38,0)")).cast("double")


def _code(column: str) -> Column:
    return F.lpad(F.col(column).cast("string"), 3, "0")


def _gas_rows(rows: DataFrame, ids: list[str], gases: dict[str, str] | None = None) -> DataFrame:
    """Gas columns to rows, up to the cutoff year; a gas nobody reported has no row."""
    gases = gases or GAS_NAMES
    return (
        rows.where(F.col("year") <= CUTOFF)
        .unpivot([*ids, "year"], list(gases), "gas", "amount_t")
        .replace(gases, subset=["gas"])
        .where(F.col("amount_t").isNotNull())
        .withColumn("amount_t", F.col("amount_t") * F.lit(TONNES_PER_UNIT))
    )
