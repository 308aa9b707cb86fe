"""Configuration files as small tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from fleetgauge import constants as C
from fleetgauge import schemas


@dataclass
class Settings:
    """What the three configuration files say, one table per kind of thing."""

    environments: DataFrame
    delivery_methods: DataFrame
    groups: DataFrame
    monitored: DataFrame
    recipients: DataFrame
    tooling: DataFrame
    raw: dict[str, DataFrame] = field(default_factory=dict)


def _substitute(col, dtype: T.DataType, mapping: dict[str, str]):
    """Replace in every string leaf of a column, whatever its nesting."""
    if isinstance(dtype, T.StringType):
        for old, new in mapping.items():
            col = F.replace(col, F.lit(old), F.lit(new))
        return col
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _substitute(x, dtype.elementType, mapping))
    if isinstance(dtype, T.StructType):
        parts = [_substitute(col[f.name], f.dataType, mapping).alias(f.name) for f in dtype]
        return F.when(col.isNotNull(), F.struct(*parts))
    return col


def apply_replacements(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Replace placeholders in all string values, one after the other in the given order.

    A later placeholder may thus stand in an earlier one's value. Names of fields stay.
    """
    if not mapping:
        return df
    return df.select(
        *[_substitute(F.col(f.name), f.dataType, mapping).alias(f.name) for f in df.schema]
    )


def with_defaults(monitored: DataFrame) -> DataFrame:
    """SLA and minimum number of runs are 0 unless given."""
    return monitored.withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("sla_seconds", "minimum_number_of_runs")}
    )


def _read(spark: SparkSession, path: str, name: str, ddl: str, lines: bool) -> DataFrame:
    """The documents of one file, parsed; a document that is not JSON is an error.

    A value of the wrong type reads as missing, which the checks then find.
    """
    texts = spark.read.text(f"{path.rstrip('/')}/{name}.json", wholetext=not lines)
    broken = F.raise_error(F.lit(f"Error parsing JSON data in {name}.json"))
    parsed = F.from_json("value", ddl, {"mode": "PERMISSIVE"})
    return texts.select(
        F.when(F.try_parse_json("value").isNull(), broken).otherwise(parsed).alias("j")
    ).select("j.*")


def _replacements(spark: SparkSession, path: str) -> dict[str, str]:
    """The optional replacements file, a flat object; its order matters."""
    try:
        rows = spark.read.text(f"{path.rstrip('/')}/replacements.json", wholetext=True).take(1)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return json.loads(rows[0][0]) if rows else {}


def _entries(groups: DataFrame) -> DataFrame:
    """One row per group, section and entry, in file order."""
    sections = F.array(
        *[
            F.struct(F.lit(kind).alias("resource_type"), F.col(f"g.{kind}").alias("entries"))
            for kind in C.RESOURCE_TYPES
        ]
    )
    return (
        groups.select(F.posexplode("monitoring_groups").alias("g_pos", "g"))
        .select("g_pos", F.col("g.group_name").alias("group_name"), F.posexplode(sections).alias("s_pos", "s"))
        .select("g_pos", "s_pos", "group_name", "s.resource_type", F.posexplode("s.entries").alias("e_pos", "e"))
        .select(
            "group_name", "resource_type", F.col("e.name").alias("name"),
            F.col("e.monitored_environment_name").alias("monitored_environment"),
            F.col("e.sla_seconds").alias("sla_seconds"),
            F.col("e.minimum_number_of_runs").alias("minimum_number_of_runs"),
            (F.col("g_pos").cast("bigint") * 10**9 + F.col("s_pos") * 10**8 + F.col("e_pos")).alias("entry_order"),
        )
    )


def load_settings(spark: SparkSession, path: str, lines: bool = False) -> Settings:
    """Read general, monitoring_groups and recipients (needed) and replacements (optional).

    Each is one JSON document. A generated configuration too large for that can come as
    folders of lines instead (`lines`): every line is a document with some of the records, a
    monitoring group always whole.
    """
    mapping = _replacements(spark, path)
    files = {
        "general": schemas.GENERAL_DDL,
        "monitoring_groups": schemas.GROUPS_DDL,
        "recipients": schemas.RECIPIENTS_DDL,
    }
    raw = {n: apply_replacements(_read(spark, path, n, ddl, lines), mapping) for n, ddl in files.items()}
    general, groups = raw["general"], raw["monitoring_groups"]
    tooling = general.filter(F.col("tooling_environment").isNotNull()).select("tooling_environment.*").withColumns(
        {
            "digest_report_period_hours": F.coalesce(
                "digest_report_period_hours", F.lit(C.DIGEST_PERIOD_HOURS)
            ),
            "digest_cron_expression": F.coalesce("digest_cron_expression", F.lit(C.DIGEST_CRON)),
        }
    )
    return Settings(
        environments=general.select(F.inline("monitored_environments")),
        delivery_methods=general.select(F.inline("delivery_methods")),
        groups=groups.select(F.explode("monitoring_groups.group_name").alias("group_name")),
        monitored=with_defaults(_entries(groups)),
        recipients=raw["recipients"].select(F.inline("recipients")),
        tooling=tooling,
        raw=raw,
    )


def monitored_resources(settings: Settings) -> DataFrame:
    """Configured entries, flat: group, type, name, environment, SLA, minimum runs."""
    return settings.monitored
