"""Outcome rules of raw runs: success and failure flags, counts and error texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.functions.text import truncate


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("bigint")


def is_final(resource_type: str, state: Column) -> Column:
    """Whether a state is one a run ends in."""
    good, bad = C.RUN_STATES[resource_type]
    return state.isin(good + bad)


def with_outcome(df: DataFrame, resource_type: str, state: str = "state") -> DataFrame:
    """Add `succeeded` and `failed` from the state column."""
    good, bad = C.RUN_STATES[resource_type]
    return df.withColumns(
        {"succeeded": flag(F.col(state).isin(good)), "failed": flag(F.col(state).isin(bad))}
    )


def workflow_success(status: Column, total: Column, succeeded: Column) -> Column:
    """A workflow run counts as good only when every action did."""
    good, _ = C.RUN_STATES[C.GLUE_WORKFLOWS]
    return F.coalesce(status.isin(good) & (total == succeeded), F.lit(False))


# --- data quality ---------------------------------------------------------------------


def dq_failed(rules: Column) -> Column:
    return F.exists(rules, lambda r: r["Result"].isin(C.RULE_FAILURE))


def dq_succeeded(rules: Column) -> Column:
    """All rules pass; no rules at all also counts."""
    return F.forall(rules, lambda r: r["Result"].isin(C.RULE_SUCCESS))


def rule_count(rules: Column, results: list[str] | None = None) -> Column:
    """Number of rules, of the given results if any are named."""
    kept = F.filter(rules, lambda r: r["Result"].isin(results)) if results else rules
    return F.size(kept).cast("bigint")


def dq_error(rules: Column) -> Column:
    """`name: message` of every rule with a message; NULL when there is none."""
    said = F.filter(rules, lambda r: F.length(r["EvaluationMessage"]) > 0)
    text = F.array_join(
        F.transform(said, lambda r: F.concat(r["Name"], F.lit(": "), r["EvaluationMessage"])), "; "
    )
    return F.when(F.size(said) > 0, truncate(text, C.ERROR_CHARS))


def context_type(glue_table: Column) -> Column:
    """Catalog when a source table is attached, else job."""
    return F.when(glue_table.isNotNull(), C.CONTEXT_CATALOG).otherwise(C.CONTEXT_JOB)


# --- resource use ---------------------------------------------------------------------


def job_dpu_seconds(given: Column, seconds: Column, capacity: Column) -> Column:
    """The reported figure when there is one, else run time times capacity."""
    return F.round(F.when(F.coalesce(given, F.lit(0.0)) != 0, given).otherwise(seconds * capacity), 3)


def crawl_dpu_seconds(hours: Column) -> Column:
    return F.round(hours * 3600, 3)


def gb_seconds(memory_mb: Column, billed_ms: Column) -> Column:
    return (memory_mb / 1024) * (billed_ms / 1000)


# Measures on a function's REPORT line.
REPORT_FIELDS = {
    "duration_ms": r"Duration: ([0-9.]+) ms",
    "billed_duration_ms": r"Billed Duration: (\d+) ms",
    "memory_size_mb": r"Memory Size: (\d+) MB",
    "max_memory_used_mb": r"Max Memory Used: (\d+) MB",
}


def parse_report(report: Column) -> dict[str, Column]:
    """The four measures of a REPORT line, 0.0 when absent."""
    return {
        name: F.coalesce(F.regexp_extract(report, pattern, 1).try_cast("double"), F.lit(0.0))
        for name, pattern in REPORT_FIELDS.items()
    }


_CRAWL_COUNTS = {
    f"{plural}_{done}": (entity, operation)
    for plural, entity in (("tables", "TABLE"), ("partitions", "PARTITION"))
    for done, operation in (("added", "ADD"), ("updated", "UPDATE"), ("deleted", "DELETE"))
}


def parse_crawl_summary(summary: Column) -> Column:
    """Counts of tables and partitions added, updated, deleted, as one struct.

    The summary is JSON whose leaves are JSON texts again. Keys compare without case, and
    equal keys add up. Anything unreadable counts 0. Select the struct before its fields, so
    that the text is parsed once.
    """
    outer = F.from_json(summary, "map<string,map<string,string>>")
    zero = F.struct(*[F.lit(0).cast("bigint").alias(n) for n in _CRAWL_COUNTS])

    def add_operation(entity: Column, counts: Column, operation: Column) -> Column:
        n = F.coalesce(
            F.get_json_object(operation["value"], "$.Count").try_cast("bigint"), F.lit(0)
        )
        done = F.upper(operation["key"])
        return F.struct(
            *[
                F.when((entity == e) & (done == o), counts[name] + n).otherwise(counts[name]).alias(name)
                for name, (e, o) in _CRAWL_COUNTS.items()
            ]
        )

    def add_entity(counts: Column, entry: Column) -> Column:
        return F.aggregate(
            F.map_entries(entry["value"]),
            counts,
            lambda acc, operation: add_operation(F.upper(entry["key"]), acc, operation),
        )

    entries = F.filter(F.map_entries(outer), lambda e: e["value"].isNotNull())
    return F.coalesce(F.aggregate(entries, zero, add_entity), zero)


# --- error texts ----------------------------------------------------------------------


def clean_lambda_error(message: Column, request_id: Column) -> Column:
    """The text after `[ERROR]<tab>time<tab>request id<tab>`; other messages unchanged."""
    pattern = F.concat(
        F.lit("^\\[ERROR\\]\\t\\S+\\t\\Q"), F.coalesce(request_id, F.lit("None")),
        F.lit("\\E\\t([^\\n]*)\\n?\\z"),
    )
    found = F.rlike(message, pattern)
    rest = F.call_function("regexp_extract", message, pattern, F.lit(1))
    return F.when(found, strip(rest)).otherwise(message)


def strip(col: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def lambda_error(messages: Column, request_id: Column) -> Column:
    """All error lines of one invocation, cleaned, joined by `<br/>` and cut."""
    cleaned = F.transform(messages, lambda m: clean_lambda_error(m, request_id))
    return F.when(
        F.size(messages) > 0, truncate(F.array_join(cleaned, "<br/>"), C.ERROR_CHARS)
    )


def emr_error(details: Column) -> Column:
    """State details without the stock sentence; NULL when there are none."""
    text = strip(F.replace(details, F.lit(C.BATCH_STOCK_SENTENCE), F.lit("")))
    return F.when(F.length(details) > 0, truncate(text, C.BATCH_ERROR_CHARS))


def sfn_error(error: Column, cause: Column) -> Column:
    """`error cause`; the cause stays the JSON or plain text it arrived as."""
    return F.concat(F.coalesce(error, F.lit("")), F.lit(" "), F.coalesce(cause, F.lit("")))


def workflow_error(nodes: Column) -> Column:
    """Errors of a run graph's nodes, in node order, as one text; NULL for none.

    Every message is cut on its own and named after the node's type. Several are counted
    and cut again as a whole. A graph is one record's array, so this stays a column.
    """

    def messages(node: Column) -> Column:
        found = F.concat(
            F.array(node["Job"]["ErrorMessage"]),
            F.coalesce(node["JobDetails"]["JobRuns"]["ErrorMessage"], F.array().cast("array<string>")),
            F.coalesce(
                node["CrawlerDetails"]["Crawls"]["ErrorMessage"], F.array().cast("array<string>")
            ),
        )
        return F.transform(
            F.filter(found, lambda m: F.length(m) > 0),
            lambda m: F.concat(
                F.coalesce(node["Type"], F.lit("None")), F.lit(" Error: "),
                truncate(m, C.NODE_ERROR_CHARS),
            ),
        )

    errors = F.flatten(F.transform(nodes, messages))
    n = F.size(errors)
    joined = F.array_join(errors, "; ")
    several = F.concat(
        F.lit("Total Errors: "), n.cast("string"), F.lit(". "), truncate(joined, C.ERROR_CHARS)
    )
    return F.when(n > 1, several).when(n == 1, joined)
