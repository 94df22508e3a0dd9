"""Data-quality rules over the extracted tables: one row (table, url, rule) for each violation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses that pages use, and those that call for an end date.
STATUSES = ["current show", "ended", "on hiatus", "canceled", "cancelled/ended"]
OVER = ["ended", "canceled", "cancelled/ended"]


def missing(*names: str) -> Column:
    return reduce(Column.__or__, [F.coalesce(F.col(n).cast("string"), F.lit("")) == "" for n in names])


def not_a_number(name: str) -> Column:
    return ~F.rlike(F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit("^[0-9]+$"))


def among(name: str, values: list[str]) -> Column:
    return F.coalesce(F.lower(name).isin(values), F.lit(False))


def show_rules() -> dict[str, Column]:
    return {
        "missing keywords": missing("keywords"), "missing title": missing("title"), "missing or invalid start date": missing("date_start", "date_start_iso"),
        "missing or invalid end date": missing("date_end", "date_end_iso") & among("status", OVER), "missing runtime": missing("runtime_minutes"), "missing status": missing("status"),
        "unrecognised status": ~missing("status") & ~among("status", STATUSES), "missing network": missing("network"), "missing country": missing("country"),
        "missing episode count": missing("episode_count"), "invalid episode count": not_a_number("episode_count"), "missing genres": missing("genres"),
        "missing season count": missing("season_count"), "invalid season count": not_a_number("season_count"),
    }


CHILD_RULES = {
    "seasons": lambda: {"invalid season number": not_a_number("season_number"), "invalid episode count": not_a_number("episode_count")},
    "episodes": lambda: {
        "invalid season number": not_a_number("season_number"), "invalid number in season": not_a_number("episode_number_in_season"), "invalid overall number": not_a_number("episode_number_overall"),
        "missing title": missing("episode_title"), "missing or invalid airdate": missing("airdate", "airdate_iso"), "missing url": missing("episode_url"),
    },
    "credits": lambda: {"missing actor": missing("actor_name"), "missing role": missing("role")},
}


def broken(rows: DataFrame, table: str, url: str, rules: dict[str, Column]) -> DataFrame:
    """table, url, rule of each rule that a row breaks."""
    names = F.filter(F.array(*[F.when(p, F.lit(name)) for name, p in rules.items()]), lambda x: x.isNotNull())
    return rows.select(F.lit(table).alias("table"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.explode(names).alias("rule"))


def unmatched(rows: DataFrame, url: str, others: DataFrame, other: str, table: str, rule: str) -> DataFrame:
    keys = others.select(F.coalesce(F.col(other), F.lit("")).alias("url")).distinct()
    return rows.select(F.coalesce(F.col(url), F.lit("")).alias("url")).join(keys, "url", "left_anti").select(F.lit(table).alias("table"), "url", F.lit(rule).alias("rule"))


def validate(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Violations of shows, seasons, episodes and credits; a missing table ends the checks before those that need it."""
    shows = tables.get("shows")
    if shows is None:
        raise ValueError("there is no table of shows to validate")
    found = [broken(shows, "shows", "url", show_rules())]
    for name, rules in CHILD_RULES.items():
        rows = tables.get(name)
        if rows is None:
            break
        found += [broken(rows, name, "show_url", rules()), unmatched(rows, "show_url", shows, "url", name, "unknown show")]
    else:
        distinct = shows.select("url").distinct()
        found += [unmatched(distinct, "url", tables[name], "show_url", "shows", f"without {name}") for name in CHILD_RULES]
    return reduce(DataFrame.unionByName, found)
