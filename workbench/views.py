"""Input shapes derived from the test tables, in Spark.

`sql_views.py` says the same in SQL. Run records, logs and events come from `events`;
configuration comes from `supplier`, `part`, `customer` and `orders`, so it grows too.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.operators import normalise as N
from fleetgauge.session import settle

START, END = datetime(2024, 1, 8, tzinfo=timezone.utc), datetime(2024, 1, 22, tzinfo=timezone.utc)
NOW = datetime(2024, 1, 22, 12, tzinfo=timezone.utc)

# What names of each type begin with, in the order of types.
STEMS = ["job", "wf", "crawler", "db", "rules", "fn", "sm", "app"]

c = F.col


# --- expressions over `ev` --------------------------------------------------------------

ENV = "'env-' || (user_id % 3)"
FAILED = "(event_type = 'error')"
RUNNING = "(event_type = 'view')"
AT_MS = "timestamp_millis(unix_millis(ts))"
# The time `value` seconds after `ts`.
LATER = "timestamp_micros(unix_micros(ts) + CAST(round(value * 1000000) AS BIGINT))"
LONG_ERROR = "'k=' || k || ' ' || repeat('x', CAST(k + 20 AS INT))"
ACCOUNT = "CASE WHEN user_id % 5 = 4 THEN '999999999999' ELSE lpad(CAST(user_id % 3 AS STRING), 12, '0') END"
REGION = "'region-' || (user_id % 3)"


def name_of(stem: str) -> str:
    return f"('{stem}-' || (user_id div 2))"


def by_outcome(bad: list[str], open_: str, good: str) -> str:
    """One of the bad states by k, the open state or the good one."""
    cases = " ".join(f"WHEN {FAILED} AND k % {len(bad)} = {i} THEN '{b}'" for i, b in enumerate(bad))
    return f"CASE {cases} WHEN {RUNNING} THEN '{open_}' ELSE '{good}' END"


def over_all_cores(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores, spread evenly; a larger one as it is.

    The test tables are single small files, which one core would read and then work on alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def struct_of(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields.items()) + ")"


class Views:
    """The derived tables for one scale folder. Everything is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir
        self._config: DataFrame | None = None

        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def ev(self) -> DataFrame:
        return over_all_cores(self.table("events")).selectExpr(
            "event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id", "event_type", "value",
            "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
        )

    # --- raw run records --------------------------------------------------------------

    def _raw(self, **columns: str) -> DataFrame:
        return self.ev.selectExpr(f"{ENV} AS monitored_environment", *[f"{e} AS {n}" for n, e in columns.items()])

    @cached_property
    def raw_jobs(self) -> DataFrame:
        return self._raw(
            Id="'jr_' || event_id", Attempt="0", JobName=name_of("job"), StartedOn="ts", LastModifiedOn="ts",
            CompletedOn="ts",
            JobRunState=by_outcome(["FAILED", "ERROR", "TIMEOUT", "STOPPED"], "RUNNING", "SUCCEEDED"),
            ErrorMessage=f"CASE WHEN {FAILED} THEN {LONG_ERROR} END", PredecessorRuns="CAST(array() AS ARRAY<STRING>)",
            AllocatedCapacity="2", ExecutionTime="CAST(floor(value) AS INT)", Timeout="60",
            MaxCapacity="CAST(k % 3 + 2 AS DOUBLE)", LogGroupName="'g'", GlueVersion="'4.0'",
            DPUSeconds="CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 0D ELSE value * 3 END",
        )

    @cached_property
    def raw_workflows(self) -> DataFrame:
        def node(kind: str, job: str = "CAST(NULL AS STRING)", runs: str = "", crawls: str = "") -> str:
            one = lambda fields, texts: (
                f"transform(CAST(array({texts}) AS ARRAY<STRING>), m -> named_struct({fields}, 'ErrorMessage', m))"
            )
            id_, state = "'Id', 'r'", "'State', 'FAILED'"
            return f"""named_struct('Type', '{kind}', 'Name', 'n', 'Job', named_struct('Name', 'j', 'ErrorMessage', {job}),
                'JobDetails', named_struct('JobRuns', {one(id_, runs)}),
                'CrawlerDetails', named_struct('Crawls', {one(state, crawls)}))"""

        one = f"array({node('JOB', job='repeat(chr(101), CAST(k AS INT))')})"
        many = f"array({node('JOB', runs=chr(39) + 'x' + chr(39))}, {node('TRIGGER')}, " + node(
            "CRAWLER", crawls="'c=' || k, ''") + ")"
        return self._raw(
            Name=name_of("wf"), WorkflowRunId="'wr_' || event_id", WorkflowRunProperties="map('p', '1')",
            StartedOn="ts", CompletedOn=LATER,
            Status=by_outcome(["STOPPED", "ERROR", "FAILURE"], "RUNNING", "COMPLETED"),
            ErrorMessage=f"CASE WHEN {FAILED} AND k % 2 = 0 THEN 'wf k=' || k END",
            Statistics="""named_struct('TotalActions', INT(k % 5 + 1), 'TimeoutActions', INT(k % 2),
                'FailedActions', INT(k % 7 = 0), 'StoppedActions', INT(k % 3),
                'SucceededActions', INT(k % 5 + 1 - INT(k % 7 = 0)), 'RunningActions', 0, 'ErroredActions', INT(k % 4),
                'WaitingActions', 0)""",
            Graph=f"named_struct('Nodes', CASE k % 3 WHEN 1 THEN {one} WHEN 2 THEN {many} ELSE slice({one}, 1, 0) END)",
        )

    @cached_property
    def raw_crawlers(self) -> DataFrame:
        # JSON whose leaves are JSON texts; q stands for an escaped quote.
        added = """replace('{"TABLE":{"ADD":"{qCountq: ' || k || '}","delete":"{qCountq: 2}"}}', 'q', chr(92) || '"')"""
        moved = """replace('{"table":{"UPDATE":"{qCountq: ' || k || '}"},"PARTITION":{"ADD":"{qCountq: 5}","DELETE":"oops"}}',
            'q', chr(92) || '"')"""
        return self._raw(
            CrawlerName=name_of("crawler"), CrawlId="'cr_' || event_id",
            State=by_outcome(["FAILED", "STOPPED"], "RUNNING", "COMPLETED"), StartTime="ts", EndTime=LATER,
            ErrorMessage=f"CASE WHEN {FAILED} THEN 'crawl k=' || k END", DPUHour="CASE WHEN k % 10 <> 9 THEN k / 1000D END",
            Summary=f"CASE k % 4 WHEN 0 THEN '{{}}' WHEN 1 THEN 'bad json{{' WHEN 2 THEN {added} ELSE {moved} END",
        )

    @cached_property
    def raw_dq(self) -> DataFrame:
        rule = lambda i, result: f"""named_struct('Name', 'r{i}', 'Description', 'd', 'Result', {result},
            'EvaluatedMetrics', map('m', 1D),
            'EvaluationMessage', CASE WHEN {result} <> 'PASS' THEN 'bad value ' || repeat('9', CAST(k AS INT)) END)"""
        first = f"(CASE WHEN {FAILED} THEN 'FAIL' ELSE 'PASS' END)"
        second = "(CASE WHEN k % 5 = 0 THEN 'ERROR' ELSE 'PASS' END)"
        return self._raw(
            ResultId="'dq_' || event_id", Score="k / 100D", RulesetName=name_of("rules"), EvaluationContext="'ctx'",
            RulesetEvaluationRunId="'rr_' || event_id", StartedOn="ts", CompletedOn=LATER,
            JobName=name_of("job"), JobRunId="'jr_' || event_id",
            RuleResults=f"slice(array({rule(1, first)}, {rule(2, second)}, {rule(3, repr('PASS'))}), 1, CAST(k % 4 AS INT))",
            DataSource="""named_struct('GlueTable', CASE WHEN k % 2 = 0 THEN
                named_struct('DatabaseName', 'db-' || (user_id div 2), 'TableName', 'tbl-' || k) END)""",
        )

    @cached_property
    def raw_sfn(self) -> DataFrame:
        return self._raw(
            executionArn="'arn:x:' || event_id",
            stateMachineArn=f"'arn:aws:states:r:1:stateMachine:' || {name_of('sm')}", name="'ex_' || event_id",
            status=by_outcome(["FAILED", "ABORTED", "TIMED_OUT"], "RUNNING", "SUCCEEDED"), startDate="ts", stopDate=LATER,
            error="CASE WHEN k % 2 = 0 THEN 'Err' END", cause="""'{"k":' || k || '}'""",
        )

    @cached_property
    def machines(self) -> DataFrame:
        """State machines by address, one per supplier."""
        return self.table("supplier").selectExpr(
            "'arn:aws:states:r:1:stateMachine:sm-' || s_suppkey AS stateMachineArn", "'sm-' || s_suppkey AS name"
        )

    @cached_property
    def raw_emr(self) -> DataFrame:
        use = lambda f: f"""named_struct('vCPUHour', CASE WHEN k % 10 <> 0 THEN value * {f} END,
            'memoryGBHour', value * 4 * {f}, 'storageGBHour', CAST(k AS DOUBLE))"""
        return self._raw(
            applicationId="'app' || (user_id div 2)", jobRunId="'er_' || event_id", name="'n' || k", createdAt="ts",
            updatedAt="ts", state=by_outcome(["FAILED", "CANCELLED"], "RUNNING", "SUCCESS"),
            stateDetails=f"""CASE WHEN {FAILED} THEN '{C.BATCH_STOCK_SENTENCE}' || '  '
                || repeat('ab', CAST(k * 2 AS INT)) || ' ' END""",
            jobDriver="named_struct('sparkSubmit', named_struct('entryPoint', 's3://x/y.py'))",
            totalResourceUtilization=use("1D"), totalExecutionDurationSeconds="CAST(floor(value) AS INT)",
            billedResourceUtilization=use("0.5D"),
        )

    @cached_property
    def apps(self) -> DataFrame:
        """Batch applications, one per supplier."""
        return self.table("supplier").selectExpr("'app' || s_suppkey AS id", "'app-' || s_suppkey AS name")

    @cached_property
    def listing(self) -> dict[str, DataFrame]:
        """A catalog listing: databases from nations, tables from parts, parts of them from
        order lines."""
        place = lambda key: [
            f"'env-' || ({key} % 20 % 3) AS monitored_environment", f"'db-' || ({key} % 20) AS DatabaseName"]
        part, line = self.table("part"), self.table("lineitem")
        return {
            "databases": self.table("nation").selectExpr(
                "'env-' || (n_nationkey % 3) AS monitored_environment", "'db-' || n_nationkey AS DatabaseName",
                "'123' AS AccountId"),
            "tables": part.filter("p_partkey % 9 <> 0").selectExpr(
                *place("p_partkey"), "'t' || p_partkey AS Name", "p_brand AS CatalogId",
                "CAST(NULL AS TIMESTAMP) AS CreateTime", "CAST(NULL AS TIMESTAMP) AS UpdateTime"),
            "partitions": line.selectExpr(
                *place("l_partkey"), "'t' || l_partkey AS TableName", "CAST(l_linenumber AS STRING) AS Partition"),
            "indexes": line.filter("l_linenumber = 1").selectExpr(
                *place("l_partkey"), "'t' || l_partkey AS TableName", "l_returnflag AS IndexName"),
        }

    # --- function log -----------------------------------------------------------------

    @cached_property
    def function_log(self) -> DataFrame:
        """Every event as the lines one invocation writes; a third of the errors name no
        request, and a `view` never gets its REPORT."""
        at = lambda n: f"timestamp_millis(unix_millis(ts) + {n})"
        rid = "'req-' || (event_id div 3)"
        line = lambda n, message, request: f"named_struct('ts', {at(n)}, 'message', {message}, 'request_id', {request})"
        none, tab, nl = "CAST(NULL AS STRING)", "chr(9)", "chr(10)"
        by_id = line(1, f"'[ERROR]' || {tab} || '2024Z' || {tab} || {rid} || {tab} || ' bad k=' || k || ' ' || {nl}", rid)
        by_stream = line(1, "'[ERROR] boom k=' || k", none)
        report = f"""'REPORT RequestId: ' || {rid} || {tab} || 'Duration: ' || value || ' ms' || {tab} || 'Billed Duration: '
            || ceil(value) || ' ms' || {tab} || 'Memory Size: ' || (k % 4 * 128 + 128) || ' MB' || {tab}
            || 'Max Memory Used: ' || k || ' MB' || {tab} || {nl}"""
        lines = ", ".join([
            line(0, f"'START RequestId: ' || {rid} || {nl}", rid),
            f"CASE WHEN {FAILED} AND k % 2 = 0 THEN {by_stream} WHEN {FAILED} THEN {by_id} END",
            f"CASE WHEN {FAILED} AND k % 5 = 0 THEN " + line(2, "'[ERROR] again ' || repeat('z', CAST(k AS INT))", none) + " END",
            line(2, f"'INFO ' || {rid}", rid),
            f"CASE WHEN NOT {RUNNING} THEN " + line(2, f"'END RequestId: ' || {rid} || {nl}", rid) + " END",
            f"CASE WHEN NOT {RUNNING} THEN " + line(3, report, rid) + " END",
        ])
        return self.ev.selectExpr(
            "'fn-' || (event_id div 3 % 8) AS function_name", "'ls-' || (event_id div 3 % 16) AS log_stream",
            f"explode(array_compact(array({lines}))) AS l",
        ).selectExpr(
            "'env-0' AS monitored_environment", "function_name", "l.ts", "log_stream", "l.message", "l.request_id"
        )

    # --- metrics tables ---------------------------------------------------------------

    @cached_property
    def m_lambda(self) -> DataFrame:
        memory = "CAST(k % 4 * 128 + 128 AS DOUBLE)"
        return self.ev.selectExpr(
            "'env-' || (event_id div 3 % 3) AS monitored_environment", "'fn-' || (event_id div 3 % 8) AS resource_name",
            f"{AT_MS} AS time", "'req-' || (event_id div 3) AS lambda_function_request_id",
            "'ls-' || (event_id div 2 % 16) AS log_stream", "1L AS invocation",
            f"BIGINT(NOT {FAILED}) AS succeeded", f"BIGINT({FAILED}) AS failed",
            f"CASE WHEN {FAILED} THEN 'FAILED' ELSE 'SUCCEEDED' END AS status", "value AS duration_ms",
            "CAST(ceil(value) AS DOUBLE) AS billed_duration_ms", f"{memory} AS memory_size_mb",
            f"{memory} / 1024 * (ceil(value) / 1000) AS GB_seconds", "CAST(k AS DOUBLE) AS max_memory_used_mb",
            f"CASE WHEN {FAILED} THEN {LONG_ERROR} END AS error_message",
        )

    @cached_property
    def m_catalogs(self) -> DataFrame:
        return self.ev.selectExpr(
            f"{ENV} AS monitored_environment", f"{name_of('db')} AS resource_name", f"{AT_MS} AS time",
            "'123' AS catalog_id", "CAST(floor(value) AS BIGINT) AS tables_count", "k AS partitions_count",
            "event_id % 7 AS indexes_count",
        )

    def metrics(self, kind: str) -> DataFrame:
        if kind == C.GLUE_CATALOGS:
            return self.m_catalogs
        if kind == C.LAMBDA_FUNCTIONS:
            return self.m_lambda
        return N.normalise(kind, self.flat(kind))

    def flat(self, kind: str) -> DataFrame:
        """Flat raw records of a type with runs, named where a look-up is needed."""
        from fleetgauge.operators.matching import with_app_name, with_machine_arn

        if kind == C.STEP_FUNCTIONS:
            return with_machine_arn(self.raw_sfn, self.machines)
        if kind == C.EMR_SERVERLESS:
            return with_app_name(self.raw_emr, self.apps)
        return {
            C.GLUE_JOBS: lambda: self.raw_jobs, C.GLUE_WORKFLOWS: lambda: self.raw_workflows,
            C.GLUE_CRAWLERS: lambda: self.raw_crawlers, C.GLUE_DATA_QUALITY: lambda: self.raw_dq,
        }[kind]()

    def all_metrics(self) -> dict[str, DataFrame]:
        return {kind: self.metrics(kind) for kind in C.RESOURCE_TYPES}

    # --- configuration ----------------------------------------------------------------

    @cached_property
    def environments(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "'env-' || s_suppkey AS name", "lpad(CAST(s_suppkey AS STRING), 12, '0') AS account_id",
            "'region-' || (s_suppkey % 4) AS region",
        )

    @cached_property
    def monitored(self) -> DataFrame:
        pick = lambda values: f"element_at(array({', '.join(repr(x) for x in values)}), INT(p_partkey div 5 % 8 + 1))"
        near = "(p_partkey * 3 div 80)"
        return self.table("part").selectExpr(
            "'group-' || (p_partkey div 40) AS group_name", f"{pick(C.RESOURCE_TYPES)} AS resource_type",
            f"""{pick(STEMS)} || '-' || CASE p_partkey % 5 WHEN 0 THEN {near} || '' WHEN 1 THEN {near} || '*'
                WHEN 2 THEN {near} || '?' WHEN 3 THEN {near} || '[0-4]' ELSE 'missing' || (p_partkey % 3) END AS name""",
            "'env-' || (p_partkey % 3) AS monitored_environment", "INT(p_partkey % 3 * 20) AS sla_seconds",
            "INT(p_partkey % 4 * 10) AS minimum_number_of_runs", "BIGINT(p_partkey) AS entry_order",
        )

    @cached_property
    def inventory(self) -> DataFrame:
        """Names that exist per type and environment."""
        kinds = ", ".join(
            f"named_struct('resource_type', '{t}', 'name', {name_of(s)})" for t, s in zip(C.RESOURCE_TYPES, STEMS)
        )
        users = self.ev.select("user_id").distinct()
        return (
            users.selectExpr(f"{ENV} AS monitored_environment", f"inline(array({kinds}))")
            .filter("name <> 'job-11'").select("resource_type", "monitored_environment", "name").distinct()
        )

    @cached_property
    def subscriptions(self) -> DataFrame:
        """Groups a customer's orders subscribe to."""
        return self.table("orders").groupBy(
            c("o_custkey").alias("c_custkey"), F.expr("'group-' || (o_orderkey div 290)").alias("monitoring_group")
        ).agg(
            F.expr("bool_or(o_orderstatus = 'F')").alias("alerts"), F.expr("bool_or(o_orderkey % 100 = 0)").alias("digest")
        )

    @cached_property
    def recipients(self) -> DataFrame:
        """A customer's subscriptions, at most one per order."""
        lists = self.subscriptions.groupBy("c_custkey").agg(
            F.expr("sort_array(collect_list(struct(monitoring_group, alerts, digest)))").alias("subscriptions")
        )
        empty = "CAST(array() AS ARRAY<STRUCT<monitoring_group: STRING, alerts: BOOLEAN, digest: BOOLEAN>>)"
        return self.table("customer").join(lists, "c_custkey", "left").selectExpr(
            "c_name AS recipient", "c_mktsegment AS delivery_method", f"coalesce(subscriptions, {empty}) AS subscriptions"
        )

    @cached_property
    def delivery_methods(self) -> DataFrame:
        return self.table("customer").selectExpr("c_mktsegment AS name").distinct().filter("name <> 'MACHINERY'").selectExpr(
            "name", "CASE WHEN name = 'BUILDING' THEN 'AWS_SNS' ELSE 'AWS_SES' END AS delivery_method_type"
        )

    def config(self, resolved: bool = True) -> DataFrame:
        """Entries for digests: expanded (or as written), with account and region."""
        from fleetgauge.operators.matching import expand_wildcards, with_account

        if not resolved:
            return with_account(self.monitored, self.environments)
        if self._config is None:
            entries = expand_wildcards(self.monitored, self.inventory)
            self._config = settle(with_account(entries, self.environments), "config")
        return self._config

    # --- events -----------------------------------------------------------------------

    @cached_property
    def event_json(self) -> DataFrame:
        """One JSON envelope per event; its kind goes by the id's last digit."""
        s = "(event_id % 10)"
        pick = lambda values: f"element_at(array({', '.join(repr(x) for x in values)}), INT({s} + 1))"
        state = by_outcome(["FAILED", "ERROR", "TIMEOUT", "STOPPED"], "RUNNING", "SUCCEEDED")
        three = lambda bad, open_, good: f"CASE WHEN {FAILED} THEN '{bad}' WHEN {RUNNING} THEN '{open_}' ELSE '{good}' END"
        on = lambda n, e: f"CASE WHEN {s} = {n} THEN {e} END"
        even, odd = "CASE WHEN k % 2 = 0 THEN {} END", "CASE WHEN k % 2 = 1 THEN {} END"
        detail = {
            "jobName": on(0, name_of("job")),
            "jobRunId": f"CASE WHEN {s} = 0 THEN 'jr_' || event_id WHEN {s} = 8 AND k % 4 <> 0 THEN 'er_' || event_id END",
            "state": f"""CASE {s} WHEN 0 THEN {state} WHEN 1 THEN 'COMPLETED' WHEN 2 THEN {three('Failed', 'Started', 'Succeeded')}
                WHEN 4 THEN CASE WHEN {FAILED} THEN 'FAILURE' END WHEN 5 THEN {three('FAILED', 'RUNNING', 'SUCCEEDED')}
                WHEN 7 THEN {three('FAILED', 'RUNNING', 'SUCCEEDED')} WHEN 8 THEN {three('CANCELLED', 'RUNNING', 'SUCCESS')} END""",
            "status": on(6, three("ABORTED", "RUNNING", "SUCCEEDED")),
            "message": f"CASE WHEN {s} = 0 OR ({s} = 2 AND k % 3 = 0) THEN 'm' || k WHEN {s} = 7 THEN 'f' || k END",
            "errorMessage": f"CASE WHEN {s} = 2 AND {FAILED} AND k % 2 = 0 THEN 'e' || k END",
            "crawlerName": on(2, name_of("crawler")), "workflowName": on(1, name_of("wf")),
            "workflowRunId": on(1, "'wr_' || event_id"), "event_result": on(1, three("FAILURE", "INFO", "SUCCESS")),
            "origin_account": f"CASE WHEN {s} IN (1, 7) THEN {ACCOUNT} END",
            "origin_region": f"CASE WHEN {s} IN (1, 7) THEN {REGION} END",
            "databaseName": f"CASE WHEN {s} IN (3, 4) THEN {name_of('db')} END",
            "typeOfChange": f"CASE {s} WHEN 3 THEN 'CreateDatabase' WHEN 4 THEN 'UpdateTable' END",
            "changedTables": on(4, "array('tbl-' || k)"),
            "rulesetNames": f"CASE WHEN {s} = 5 AND k % 10 <> 0 THEN array({name_of('rules')}) END",
            "context": on(5, f"""named_struct(
                'contextType', CASE WHEN k % 25 = 1 THEN 'OTHER' WHEN k % 2 = 0 THEN 'GLUE_DATA_CATALOG' ELSE 'GLUE_JOB' END,
                'catalogId', {even.format("'123'")}, 'databaseName', {even.format(name_of('db'))},
                'tableName', {even.format("'tbl-' || k")}, 'jobName', {odd.format(name_of('job'))},
                'jobId', {odd.format("'jr_' || event_id")}, 'runId', {even.format("'rr_' || event_id")})"""),
            "stateMachineArn": on(6, f"'arn:aws:states:r:1:stateMachine:' || {name_of('sm')}"),
            "name": on(6, "'ex_' || event_id"), "startDate": on(6, "unix_millis(ts)"),
            "stopDate": f"CASE WHEN {s} = 6 AND NOT {RUNNING} THEN unix_millis(ts) + 1000 END",
            "lambdaName": on(7, "'fn-' || (user_id % 8)"), "request_id": on(7, "'req-' || event_id"),
            "log_stream": on(7, "'2024/01/[$LATEST]' || k"),
            "applicationId": f"CASE WHEN {s} = 8 AND k % 10 <> 0 THEN 'app' || (user_id div 2) END",
        }
        envelope = {
            "version": "'0'", "id": "'id' || event_id", "detail-type": pick(DETAIL_TYPES), "source": pick(SOURCES),
            "account": ACCOUNT, "time": """date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")""", "region": REGION,
            "detail": struct_of(detail),
        }
        return self.ev.selectExpr("event_id", f"to_json({struct_of(envelope)}) AS value")

    def events(self) -> DataFrame:
        from fleetgauge.sources.events import known_sources, parse_envelope

        return known_sources(parse_envelope(self.event_json))

    @cached_property
    def alert_config(self):
        from fleetgauge.plans.alerting import AlertConfig

        return AlertConfig(
            self.environments, self.monitored, self.recipients, self.delivery_methods, apps=self.apps
        )

    @cached_property
    def alert_rows(self) -> DataFrame:
        """An alert log, one row per event."""
        kinds = ", ".join(repr(t) for t in C.RESOURCE_TYPES)
        return self.ev.selectExpr(
            "ts AS event_time", f"{ENV} AS monitored_environment", f"{name_of('job')} AS resource_name",
            f"element_at(array({kinds}), INT(event_id % 8 + 1)) AS resource_type",
            by_outcome(["FAILED", "ERROR", "TIMEOUT", "STOPPED"], "RUNNING", "SUCCEEDED") + " AS event_status",
            f"CASE WHEN {FAILED} THEN 'FAILURE' WHEN {RUNNING} THEN 'INFO' ELSE 'SUCCESS' END AS event_result",
            "'u' || event_id AS execution_info_url", "'e' || event_id AS event",
        )


SOURCES = [
    "aws.glue", "fleetgauge.glue_workflow", "aws.glue", "aws.glue", "aws.glue",
    "aws.glue-dataquality", "aws.states", "fleetgauge.lambda", "aws.emr-serverless", "aws.glue",
]
DETAIL_TYPES = [
    "Glue Job State Change", "Glue Workflow State Change", "Glue Crawler State Change",
    "Glue Data Catalog Database State Change", "Glue Data Catalog Table State Change",
    "Data Quality Evaluation Results Available", "Step Functions Execution Status Change",
    "Lambda Function Execution State Change", "EMR Serverless Job Run State Change", "Something Else",
]
