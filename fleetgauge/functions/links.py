"""Console links of resource runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgauge import constants as C

# Characters the log viewer wants double-encoded, in this order.
FRAGMENT_CODES = [("$", "$2524"), ("[", "$255B"), ("]", "$255D"), ("/", "$252F")]


def encode_fragment(col: Column) -> Column:
    """A log group or stream name as the log viewer's address wants it."""
    for plain, code in FRAGMENT_CODES:
        col = F.replace(col, F.lit(plain), F.lit(code))
    return col


def _text(value) -> Column:
    """A piece of an address: a missing value is left blank, never NULL."""
    return F.coalesce(value, F.lit("")) if value is not None else F.lit("")


def run_url(
    resource_type: Column,
    region: Column,
    name: Column,
    account: Column | None = None,
    run_id: Column | None = None,
    context_type: Column | None = None,
    table_name: Column | None = None,
    db_name: Column | None = None,
    catalog_id: Column | None = None,
    job_name: Column | None = None,
    log_stream: Column | None = None,
    type_of_change: Column | None = None,
) -> Column:
    """Link to one run (or resource) in the console, by resource type."""
    region, name, account, run_id = _text(region), _text(name), _text(account), _text(run_id)
    table_name, db_name, job_name = _text(table_name), _text(db_name), _text(job_name)
    catalog = F.coalesce(catalog_id, account) if catalog_id is not None else account
    context_type, type_of_change = _text(context_type), _text(type_of_change)
    base = F.concat(F.lit("https://"), region, F.lit(".console.aws.amazon.com"))

    def at(path: str, *rest) -> Column:
        parts = [p if isinstance(p, Column) else F.lit(p) for p in rest]
        return F.concat(base, F.lit(path), region, *parts)

    on_table = at(
        "/glue/home?region=", "#/v2/data-catalog/tables/evaluation-run-details/", table_name,
        "?database=", db_name, "&catalogId=", catalog, "&runid=", run_id,
    )
    in_job = at("/gluestudio/home?region=", "#/editor/job/", job_name, "/dataquality")
    table_view = at(
        "/glue/home?region=", "#/v2/data-catalog/tables/view/", table_name, "?database=", db_name
    )
    db_view = at("/glue/home?region=", "#/v2/data-catalog/databases/view/", db_name)
    log_group = encode_fragment(F.concat(F.lit("/aws/lambda/"), name))

    links = {
        C.GLUE_JOBS: at("/gluestudio/home?region=", "#/job/", name, "/run/", run_id),
        C.GLUE_WORKFLOWS: at(
            "/glue/home?region=", "#/v2/etl-configuration/workflows/run/", name, "?runId=", run_id
        ),
        C.GLUE_CRAWLERS: at("/glue/home?region=", "#/v2/data-catalog/crawlers/view/", name),
        C.GLUE_CATALOGS: F.when(type_of_change.contains("Table"), table_view).otherwise(db_view),
        C.GLUE_DATA_QUALITY: F.when(context_type == C.CONTEXT_CATALOG, on_table).otherwise(in_job),
        C.LAMBDA_FUNCTIONS: at(
            "/cloudwatch/home?region=", "#logsV2:log-groups/log-group/", log_group,
            "/log-events/", encode_fragment(_text(log_stream)),
        ),
        C.STEP_FUNCTIONS: at(
            "/states/home?region=", "#/v2/executions/details/arn:aws:states:", region, ":",
            account, ":execution:", name, ":", run_id,
        ),
        C.EMR_SERVERLESS: at("/emr?region=", "#/serverless"),
    }
    out = F.lit(None).cast("string")
    for kind in reversed(C.RESOURCE_TYPES):
        out = F.when(resource_type == kind, links[kind]).otherwise(out)
    return out
