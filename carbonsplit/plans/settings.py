"""Parameters of a whole run, with the published defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Years, thresholds and choices; every value can be replaced."""

    cutoff: int = 2022
    next_year: int = 2023
    check_year: int = 2030
    panel_start: int = 1990
    pathway_start: int = 2020
    first_boundary: int = 2000
    second_boundary: int = 2020
    temperature: float = 2.0
    # warming level by scenario, as "scenario=level"; the others take ``temperature``
    scenario_levels: tuple[str, ...] = ()
    min_population: float = 100
    profile_years: float = 53
    micro_codes: tuple[str, ...] = ()
    ratio_lo: float = 0.95
    ratio_hi: float = 1.05
    pct_limit: float = 300.0
    pledge_category: str = "Current"
    tight_scenario: str = "15"
    wide_scenario: str = "20"
    sheet_ids: tuple[str, ...] = ("model", "scenario_id", "region", "variable", "unit")
    sheet_region: str = "World"
    display_countries: tuple[str, ...] = ()
    dropped_codes: tuple[str, ...] = ()
    missing_gas: float | None = None
    # "pledge" or "observed": the second point of entities with a single target
    anchor: str = "pledge"
    rollup_to_sovereigns: bool = False
    strict_ambition: bool = False

    def levels(self) -> dict[str, float]:
        pairs = (text.rsplit("=", 1) for text in self.scenario_levels)
        return {scenario: float(level) for scenario, level in pairs}
