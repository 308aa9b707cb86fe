"""Checks of the configuration.

Each returns rows (rule, message, value), one per offending value and none where the rule
holds, so a rule that very many entries break stays distributed. All rules run and the
failures are reported together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.operators.matching import missing_refs, subscriptions
from fleetgauge.operators.progress import union_types

SEPARATOR = "\n"


class SettingsError(Exception):
    """The configuration breaks at least one rule."""


# Fields every record of a list has to have, by file: (list, fields).
REQUIRED = {
    "general": [
        ("tooling_environment",
         ["name", "account_id", "region", "metrics_collection_cron_expression"]),
        ("monitored_environments", ["name", "account_id", "region"]),
        ("delivery_methods", ["name", "delivery_method_type"]),
    ],
    "monitoring_groups": [("monitoring_groups", ["group_name"])],
    "recipients": [("recipients", ["recipient", "delivery_method", "subscriptions"])],
}


def _result(df: DataFrame, rule: str, values, what: str) -> DataFrame:
    """One row per value left over."""
    found = df.select(F.lit(rule).alias("rule"), F.lit(what).alias("message"), values.alias("value"))
    return found.filter(F.col("value").isNotNull()).distinct()


def duplicates(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    keys = [columns] if isinstance(columns, str) else columns
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_unique(df: DataFrame, columns: str | list[str], rule: str, what: str) -> DataFrame:
    """No two rows share the key."""
    keys = [columns] if isinstance(columns, str) else columns
    return _result(duplicates(df, keys), rule, F.concat_ws(", ", *keys), what)


def check_refs(
    df: DataFrame, column: str, reference: DataFrame, ref_column: str, rule: str, what: str
) -> DataFrame:
    """Every value of a column exists in the reference list."""
    return _result(missing_refs(df, column, reference, ref_column), rule, F.col(column), what)


def _missing_fields(raw: DataFrame, file: str) -> DataFrame:
    """Names of required lists and fields a parsed file lacks."""
    parts = []
    for name, fields in REQUIRED[file]:
        there = F.coalesce(F.max(F.col(name).isNotNull()), F.lit(False))
        parts.append(raw.agg(F.when(~there, name).alias("missing")))
        as_list = F.array(name) if name == "tooling_environment" else F.col(name)
        one = raw.filter(F.col(name).isNotNull()).select(F.explode(as_list).alias("r"))
        for field in fields:
            parts.append(one.select(F.when(F.col(f"r.{field}").isNull(), f"{name}.{field}").alias("missing")))
    if file == "recipients":
        subs = raw.select(F.explode("recipients").alias("r")).select(F.explode("r.subscriptions").alias("s"))
        for field in ("monitoring_group", "alerts", "digest"):
            parts.append(
                subs.select(F.when(F.col(f"s.{field}").isNull(), f"subscriptions.{field}").alias("missing"))
            )
    if file == "monitoring_groups":
        groups = raw.select(F.explode("monitoring_groups").alias("g"))
        for kind in C.RESOURCE_TYPES:
            entries = groups.select(F.explode(F.col(f"g.{kind}")).alias("e"))
            for field in ("name", "monitored_environment_name"):
                parts.append(
                    entries.select(F.when(F.col(f"e.{field}").isNull(), f"{kind}.{field}").alias("missing"))
                )
    return union_types(parts).filter(F.col("missing").isNotNull()).distinct()


def check_schema(raw: DataFrame, file: str) -> DataFrame:
    """Required fields are there. A value of the wrong type was read as missing."""
    return _result(
        _missing_fields(raw, file), f"schema of {file}", F.col("missing"),
        f"{file}: required fields are missing",
    )


def check_settings(settings) -> DataFrame:
    """All rules over loaded settings, one row per rule and offending value."""
    envs, monitored = settings.environments, settings.monitored
    subs = subscriptions(settings.recipients)
    return union_types(
        [
            *[check_schema(settings.raw[f], f) for f in REQUIRED],
            check_unique(
                envs, "name", "environment names",
                "general: an environment name is used twice",
            ),
            check_unique(
                envs, ["account_id", "region"], "environment accounts",
                "general: an account and region belong to two environments",
            ),
            check_unique(
                settings.groups, "group_name", "group names",
                "monitoring_groups: a group name is used twice",
            ),
            check_refs(
                monitored, "monitored_environment", envs, "name", "monitored environments",
                "monitoring_groups: an entry names an unknown environment",
            ),
            check_refs(
                subs, "monitoring_group", settings.groups, "group_name", "subscribed groups",
                "recipients: a subscription names an unknown group",
            ),
            check_refs(
                settings.recipients, "delivery_method", settings.delivery_methods, "name",
                "delivery methods", "recipients: an unknown delivery method",
            ),
        ]
    )


def summary(violations: DataFrame) -> DataFrame:
    """One row per broken rule: how many values break it, and the first of them."""
    return violations.groupBy("rule", "message").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("first_value")
    )


def validate(settings) -> None:
    """Raise one error naming every broken rule.

    The driver reads one row per broken rule; `check_settings` has all the values.
    """
    broken = summary(check_settings(settings)).orderBy("rule").collect()
    if broken:
        raise SettingsError(SEPARATOR.join(_told(r) for r in broken))


def _told(row) -> str:
    more = f" and {row['n'] - 1} more" if row["n"] > 1 else ""
    return f"{row['message']}: {row['first_value']}{more}"
