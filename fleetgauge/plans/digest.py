"""From metrics to one report per audience (J4)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.functions import text as X
from fleetgauge.functions.timefn import digest_window, moment
from fleetgauge.operators import health as H
from fleetgauge.operators.digest_runs import digest_runs
from fleetgauge.operators.matching import (
    expand_wildcards, group_recipients, with_account,
)
from fleetgauge.operators.ordinals import numbered
from fleetgauge.operators.progress import union_types
from fleetgauge.session import bounded_broadcast, settle
from fleetgauge.sources.settings import Settings

HEADING, SUMMARY, CATALOG_SUMMARY, DETAIL = 0, 1, 2, 3
#: Lines of a report that one message holds; a longer report is several messages.
LINES = 500
#: Where a line stands: in the report, in its table, at its resource.
ORDER = ["section", "block_group", "block_order", "row_order", "line_section", "line_text"]

def all_runs(metrics_by_type: dict[str, DataFrame], start: datetime, end: datetime) -> DataFrame:
    """Runs of all types with runs, in one table."""
    return union_types(
        [
            digest_runs(df, kind, start, end)
            for kind, df in metrics_by_type.items()
            if kind != C.GLUE_CATALOGS
        ]
    )


def order_digest(df: DataFrame) -> DataFrame:
    """By group name; inside a group in the order of types."""
    return df.orderBy("group_name", X.type_ordinal(F.col("resource_type")))


def _texts(*cols) -> Column:
    return F.array(*[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])


def _rows(df: DataFrame, section: int, values: Column, order: Column) -> DataFrame:
    """Table rows of a section: one line each, first of its resource."""
    return df.select(
        F.lit(section).alias("section"), "group_name", "resource_type", order.alias("row_order"),
        F.lit(0).alias("line_section"), F.lit("").alias("line_text"), F.lit("row").alias("kind"),
        values.alias("values"), F.col("status").alias("style"),
    )


def _summary_order() -> Column:
    return F.concat_ws("\u0000", "group_name", X.type_ordinal(F.col("resource_type")).cast("string"))


def _resource_order() -> Column:
    return F.concat_ws("\u0000", "resource_name", "monitored_environment")


def generic_tables(summary: DataFrame, health: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of the summary table and of the resource tables of types with runs.

    A resource's comments follow its row, one line each (`health.comment_lines`).
    """
    summary_rows = _rows(
        summary, SUMMARY,
        _texts("group_name", "service_name", "total_executions", "total_success",
               "total_failures", "total_warnings"),
        _summary_order(),
    )
    resource_rows = _rows(health, DETAIL, _texts("resource_name", "success", "errors", "warnings"), _resource_order())
    comment_rows = lines.select(
        F.lit(DETAIL).alias("section"), "group_name", "resource_type", _resource_order().alias("row_order"),
        F.col("section").alias("line_section"), F.col("line").alias("line_text"), F.lit("comment").alias("kind"),
        _texts("line").alias("values"), F.lit(None).cast("string").alias("style"),
    )
    return summary_rows.unionByName(resource_rows).unionByName(comment_rows)


def catalog_tables(summary: DataFrame, health: DataFrame) -> DataFrame:
    """Rows of the summary table and of the resource tables of catalogs; three comments at most stand in the row."""
    added = ["tables_added", "partitions_added", "indexes_added"]
    counts = ["tables_count", "partitions_count", "indexes_count"]
    summary_rows = _rows(
        summary, CATALOG_SUMMARY,
        _texts("group_name", "service_name", *[f"total_{c}" for c in added + counts]),
        _summary_order(),
    )
    resource_rows = _rows(health, DETAIL, _texts("resource_name", *added, *counts, "comments"), _resource_order())
    return summary_rows.unionByName(resource_rows)


def audience_id(delivery_method: Column, groups: Column) -> Column:
    """A stable message group for an audience."""
    key = F.concat_ws("\u0000", delivery_method, F.array_join(groups, "\u0001"))
    return F.concat(F.lit("digest_group_"), F.substring(F.md5(key), 1, 16))


def _header() -> Column:
    catalogs = F.col("resource_type") == C.GLUE_CATALOGS
    lists = lambda names: F.array(*[F.lit(n) for n in names])
    return (
        F.when(F.col("section") == SUMMARY, lists(C.SUMMARY_HEADER))
        .when(F.col("section") == CATALOG_SUMMARY, lists(C.CATALOG_SUMMARY_HEADER))
        .when(catalogs, lists(C.CATALOG_RESOURCE_HEADER))
        .otherwise(lists(C.RESOURCE_HEADER))
    )


def report_lines(rows: DataFrame, audiences: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """The lines of every audience's report: (audience, ordinal, kind, values, style), in order by `ordinal`.

    A report has the heading, the period, the summary tables that have rows, then a heading and
    a table per group and type. Kinds are `text`, `header` (of a table), `row` and `comment`. No value
    and no task holds a report: the lines are ranged over (audience, place) and numbered by prefix sums.
    Headings come from the rows as well, so these are worked out once.
    """
    rows = settle(rows, "rows")
    pairs = audiences.select("audience", F.explode(F.array_distinct("monitoring_groups")).alias("group_name")).distinct()
    detail = F.col("section") == DETAIL
    placed = rows.join(bounded_broadcast(pairs), "group_name").withColumns(
        {
            "block_group": F.when(detail, F.col("group_name")).otherwise(""),
            "block_order": F.when(detail, X.type_ordinal(F.col("resource_type"))).otherwise(0).cast("bigint"),
        }
    )
    columns = ["audience", *ORDER, "kind", "values", "style"]

    def line(df: DataFrame, kind: str, before: int, values: Column, style: Column) -> DataFrame:
        """Lines that stand before the rows of their block."""
        return df.select(
            "audience", "section", "block_group", "block_order", F.lit("").alias("row_order"),
            F.lit(before).alias("line_section"), F.lit("").alias("line_text"), F.lit(kind).alias("kind"),
            values.alias("values"), style.cast("string").alias("style"),
        )

    none = F.lit(None)
    tables = placed.select("audience", "section", "block_group", "block_order", F.when(detail, F.col("resource_type")).alias("resource_type")).distinct()
    headings = line(
        tables.filter(detail), "text", -2, F.array(F.concat("block_group", F.lit(": "), X.display_name(F.col("resource_type")))), F.lit("header")
    )
    headers = line(tables, "header", -1, _header(), none)
    reported = tables.select("audience").distinct().select(
        "audience", F.lit(HEADING).alias("section"), F.lit("").alias("block_group"), F.lit(0).cast("bigint").alias("block_order")
    )
    opening = line(reported, "text", -2, F.array(F.lit("Digest Summary")), F.lit("header")).unionByName(
        line(reported, "text", -1, F.array(X.period_text(moment(start), moment(end))), F.lit("h11"))
    )
    everything = placed.select(*columns)
    for more in (headings, headers, opening):
        everything = everything.unionByName(more.select(*columns))
    # Equal lines of a block go by what they say.
    return numbered(everything, ["audience"], [*ORDER, "values", "style"]).select("audience", "ordinal", "kind", "values", "style")


def with_audience(audiences: DataFrame) -> DataFrame:
    return audiences.withColumn("audience", audience_id(F.col("delivery_method"), F.col("monitoring_groups")))


def reports(lines: DataFrame, audiences: DataFrame, end: datetime) -> DataFrame:
    """Messages per audience with data: its lines in pieces of bounded size, each for every delivery.

    `piece` numbers the pieces of a report, `part` the deliveries to its audience, both from 0.
    """
    pieces = lines.withColumn("piece", F.floor((F.col("ordinal") - 1) / LINES).cast("bigint")).groupBy("audience", "piece").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "kind", "values", "style"))).alias("message_body")
    )
    who = audiences.select("audience", "delivery_method", "delivery_method_type", "part", "recipients")
    return pieces.join(bounded_broadcast(who), "audience").select(
        F.col("audience").alias("message_group_id"), "piece", "part", "delivery_method",
        "delivery_method_type", "recipients", X.digest_subject(moment(end)).alias("message_subject"),
        "message_body",
    )


def digest(
    metrics_by_type: dict[str, DataFrame],
    config: DataFrame,
    recipients: DataFrame,
    methods: DataFrame,
    start: datetime,
    end: datetime,
    match_env: bool = True,
) -> DataFrame:
    """Reports of a period. `config` holds expanded entries with account and region.

    Health has one row per configured resource and is used by every table of the report, so
    it is worked out once.
    """
    with_runs = config.filter(F.col("resource_type") != C.GLUE_CATALOGS)
    runs = all_runs(metrics_by_type, start, end)
    health = settle(H.resource_health(runs, with_runs, match_env), "health")
    lines = H.comment_lines(health, H.run_comments(runs, with_runs, match_env))
    rows = generic_tables(H.group_summary(health), health, lines)
    if C.GLUE_CATALOGS in metrics_by_type:
        deltas = digest_runs(metrics_by_type[C.GLUE_CATALOGS], C.GLUE_CATALOGS, start, end)
        catalogs = settle(H.catalog_health(deltas, config, match_env), "catalog-health")
        rows = rows.unionByName(catalog_tables(H.catalog_summary(catalogs), catalogs))
    # Settled: lines and deliveries both meet them, and their size is then known.
    audiences = settle(with_audience(group_recipients(recipients, methods)), "audiences")
    return reports(report_lines(rows, audiences, start, end), audiences, end)


def run_digest(
    spark: SparkSession, base: str, settings: Settings, inventory: DataFrame, now: datetime,
    storage: str = "parquet",
) -> DataFrame:
    """The whole job over stored tables and loaded settings."""
    from fleetgauge.sources.tables import metrics

    hours = settings.tooling.first()["digest_report_period_hours"]
    start, end = digest_window(now, hours)
    entries = expand_wildcards(settings.monitored, inventory)
    config = settle(with_account(entries, settings.environments), "config")
    tables = {kind: metrics(spark, base, kind, storage) for kind in C.RESOURCE_TYPES}
    return digest(tables, config, settings.recipients, settings.delivery_methods, start, end)
