"""Queries of configuration: files, matching, recipients, checks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge import schemas
from fleetgauge.functions import globs, text
from fleetgauge.operators import checks as K
from fleetgauge.operators import matching as M
from fleetgauge.operators.progress import union_types
from fleetgauge.session import scratch_path
from fleetgauge.sources import settings as ST
from workbench.registry import add, in_emitted_order, joined
from workbench.views import Views

_ENTRY = "group_name, resource_type, name, monitored_environment, sla_seconds, minimum_number_of_runs"


def _files(v: Views) -> str:
    """Write the derived configuration as folders of documents, one per record.

    Environment names carry a placeholder, and every third entry leaves its figures out.
    """
    path = scratch_path(v.spark, "settings")
    holed = lambda col: F.replace(col, F.lit("env-"), F.lit("<<stage>>-"))
    doc = lambda df, name, *fields: df.select(F.to_json(F.struct(F.array(F.struct(*fields)).alias(name))).alias("value"))
    # The tooling environment lies in the region of the last supplier's account.
    tool = v.table("supplier").agg(F.max("s_suppkey").alias("n")).select(F.to_json(F.struct(F.struct(
        F.lit("tool").alias("name"), F.col("n").cast("string").alias("account_id"),
        F.concat(F.lit("<<where>>-"), F.col("n") % 4).alias("region"),
        F.lit("cron").alias("metrics_collection_cron_expression")).alias("tooling_environment"))).alias("value"))
    general = tool.unionAll(
        doc(v.environments, "monitored_environments", holed(F.col("name")).alias("name"), "account_id", "region")
    ).unionAll(doc(v.delivery_methods, "delivery_methods", "name", "delivery_method_type"))
    plain = F.col("entry_order") % 3 == 0
    entry = F.struct(
        "entry_order", "name", holed(F.col("monitored_environment")).alias("monitored_environment_name"),
        F.when(~plain, F.col("sla_seconds")).alias("sla_seconds"),
        F.when(~plain, F.col("minimum_number_of_runs")).alias("minimum_number_of_runs"),
    )
    # A group of the derived configuration has 40 entries.
    sections = v.monitored.groupBy("group_name").agg(
        *[
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("resource_type") == t, entry))),
                lambda e: F.struct(*[e[n].alias(n) for n in (
                    "name", "monitored_environment_name", "sla_seconds", "minimum_number_of_runs")]),
            ).alias(t)
            for t in C.RESOURCE_TYPES
        ]
    )
    files = {
        "general": general, "monitoring_groups": doc(sections, "monitoring_groups", "group_name", *C.RESOURCE_TYPES),
        "recipients": doc(v.recipients, "recipients", "recipient", "delivery_method", "subscriptions"),
        "replacements": v.spark.range(1).select(
            F.lit(json.dumps({"<<stage>>": "<<short>>v", "<<short>>": "en", "<<where>>": "eu"})).alias("value")),
    }
    for name, df in files.items():
        df.write.text(f"{path}/{name}.json")
    return path


def _loaded(v: Views) -> ST.Settings:
    return ST.load_settings(v.spark, _files(v), lines=True)


_DEFAULTED = """SELECT group_name, resource_type, name, monitored_environment,
    CASE WHEN entry_order % 3 = 0 THEN 0 ELSE sla_seconds END AS sla_seconds,
    CASE WHEN entry_order % 3 = 0 THEN 0 ELSE minimum_number_of_runs END AS minimum_number_of_runs FROM monitored"""
add(
    "src1_src3_src4_monitored_resources",
    lambda v: ST.monitored_resources(_loaded(v)).drop("entry_order"),
    _DEFAULTED,
)
add("src1_environments", lambda v: _loaded(v).environments.select("name", "account_id", "region"),
    "SELECT * FROM environments")
add(
    "src1_recipients",
    lambda v: M.subscriptions(_loaded(v).recipients),
    "SELECT * FROM subs",
)
add(
    "src3_tooling_defaults",
    lambda v: _loaded(v).tooling.select(
        "region", "digest_report_period_hours", "digest_cron_expression"),
    "SELECT 'eu-' || (max(s_suppkey) % 4) AS region, 24 AS digest_report_period_hours, 'cron(0 8 * * ? *)' AS digest_cron_expression FROM supplier",
)
add(
    "src2_apply_replacements",
    lambda v: ST.apply_replacements(
        v.ev.select("event_id", F.struct(F.concat(F.lit("<<a>>-"), F.col("event_type")).alias("s"),
                                         F.array(F.lit("<<b>>"), F.col("event_type")).alias("l")).alias("x")),
        {"<<a>>": "<<b>>!", "<<b>>": "B", "click": "tap"},
    ).select("event_id", F.col("x.s").alias("s"), F.array_join("x.l", ",").alias("l")),
    """SELECT event_id, 'B!-' || replace(event_type, 'click', 'tap') AS s, 'B,' || replace(event_type, 'click', 'tap') AS l FROM ev""",
)

# --- matching -----------------------------------------------------------------------------

add(
    "jn1_match_groups",
    lambda v: M.match_groups(v.inventory.withColumnRenamed("name", "resource_name"), v.monitored),
    """SELECT DISTINCT i.resource_type, i.name AS resource_name, m.group_name FROM inventory i JOIN monitored m
        ON i.resource_type = m.resource_type AND i.name GLOB m.name""",
)
add(
    "jn1_match_groups_by_environment",
    lambda v: M.match_groups(v.inventory.withColumnRenamed("name", "resource_name"), v.monitored, match_env=True),
    """SELECT DISTINCT i.resource_type, i.monitored_environment, i.name AS resource_name, m.group_name FROM inventory i
        JOIN monitored m ON i.resource_type = m.resource_type AND i.monitored_environment = m.monitored_environment
        AND i.name GLOB m.name""",
)
add(
    "str2_glob_to_regex",
    lambda v: v.table("part").select("p_partkey", "p_name", "p_type").withColumns({
        str(i): F.rlike(F.col("p_name"), globs.glob_to_regex(F.lit(p)))
        for i, p in enumerate(["*ring", "?ed*", "[a-m]*", "[!a-m]*g?t", "small ri*"])
    }).select("p_partkey", *[F.col(f"`{i}`").alias(f"m{i}") for i in range(5)]),
    """SELECT p_partkey, p_name GLOB '*ring' AS m0, p_name GLOB '?ed*' AS m1, p_name GLOB '[a-m]*' AS m2,
        p_name GLOB '[!a-m]*g?t' AS m3, p_name GLOB 'small ri*' AS m4 FROM part""",
)
add("jn2_expand_wildcards", lambda v: M.expand_wildcards(v.monitored, v.inventory), "SELECT * FROM expanded")
add(
    "jn5_flt13_with_account",
    lambda v: M.with_account(
        v.monitored.withColumn("monitored_environment", F.when(F.col("entry_order") % 11 != 0, F.col("monitored_environment"))),
        v.environments),
    """SELECT m.*, v.account_id, v.region AS region_name FROM monitored m JOIN environments v
        ON m.monitored_environment = v.name WHERE entry_order % 11 <> 0""",
)
add(
    "jn4_with_environment",
    lambda v: M.with_environment(
        v.table("supplier").select("s_suppkey", F.lpad(F.col("s_suppkey").cast("string"), 12, "0").alias("a"),
                                   F.concat(F.lit("region-"), F.col("s_suppkey") % 3).alias("r")),
        v.environments, F.col("a"), F.col("r")).select("s_suppkey", "monitored_environment"),
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = s_suppkey % 4 THEN 'env-' || s_suppkey END AS monitored_environment FROM supplier""",
)
for _kind, _flag in (("alert", "alerts"), ("digest", "digest")):
    add(
        f"jn6_recipients_for_{_kind}",
        lambda v, k=_kind: M.recipients_for(
            v.monitored.select("group_name", "resource_type").distinct(), v.recipients, k),
        f"""SELECT DISTINCT m.resource_type, recipient, delivery_method FROM monitored m JOIN subs
            ON m.group_name = subs.monitoring_group WHERE {_flag}""",
    )
    add(
        f"agg27_recipient_groups_{_kind}",
        lambda v, k=_kind: joined(M.recipient_groups(v.recipients, k), "monitoring_groups"),
        f"""SELECT c_name AS recipient, c_mktsegment AS delivery_method,
            coalesce(string_agg(monitoring_group, ',' ORDER BY monitoring_group) FILTER ({_flag}), '') AS monitoring_groups
            FROM customer LEFT JOIN subs ON c_name = recipient GROUP BY ALL""",
    )
add(
    "jn7_delivery_method", lambda v: M.with_delivery_method(v.recipients, v.delivery_methods).select(
        "recipient", "delivery_method", "delivery_method_type"),
    """SELECT c_name AS recipient, c_mktsegment AS delivery_method, delivery_method_type FROM customer
        LEFT JOIN methods ON c_mktsegment = name""",
)
add(
    "agg25_delivery_options",
    lambda v: joined(M.delivery_options(
        M.match_groups(v.inventory.withColumnRenamed("name", "resource_name"), v.monitored), v.recipients,
        v.delivery_methods), "recipients"),
    """WITH g AS (SELECT DISTINCT i.resource_type, i.name AS resource_name, m.group_name FROM inventory i JOIN monitored m
          ON i.resource_type = m.resource_type AND i.name GLOB m.name)
       SELECT resource_type, resource_name, delivery_method, delivery_method_type, part, recipients FROM (
         SELECT resource_type, resource_name, delivery_method, part, string_agg(recipient, ',' ORDER BY recipient) AS recipients FROM (
           SELECT *, (row_number() OVER (PARTITION BY resource_type, resource_name, delivery_method ORDER BY recipient) - 1) // 50 AS part FROM (
             SELECT DISTINCT resource_type, resource_name, delivery_method, recipient FROM g JOIN subs ON g.group_name = monitoring_group WHERE alerts))
         GROUP BY ALL) LEFT JOIN methods ON delivery_method = name""",
)
add(
    "agg26_group_recipients",
    lambda v: joined(M.group_recipients(v.recipients, v.delivery_methods), "recipients", "monitoring_groups"),
    """SELECT delivery_method, array_to_string(monitoring_groups, ',') AS monitoring_groups, part,
        string_agg(recipient, ',' ORDER BY recipient) AS recipients, any_value(delivery_method_type) AS delivery_method_type FROM (
          SELECT *, (row_number() OVER (PARTITION BY delivery_method, monitoring_groups ORDER BY recipient) - 1) // 50 AS part FROM recipient_groups)
        LEFT JOIN methods ON delivery_method = name GROUP BY delivery_method, monitoring_groups, part""",
)
add(
    "jn10_digest_audience",
    lambda v: joined(M.digest_audience(
        v.monitored.filter("sla_seconds > 0 and entry_order % 5 < 3"), M.group_recipients(v.recipients, v.delivery_methods)),
        "monitoring_groups").distinct(),
    """SELECT DISTINCT delivery_method, array_to_string(monitoring_groups, ',') AS monitoring_groups, g AS group_name FROM (
        SELECT delivery_method, monitoring_groups, unnest(monitoring_groups) AS g FROM recipient_groups)
        WHERE g IN (SELECT group_name FROM monitored WHERE sla_seconds > 0 AND entry_order % 5 < 3)""",
)
add("set3_accounts", lambda v: M.accounts(v.environments), "SELECT DISTINCT account_id FROM environments")
add("set3_account_regions", lambda v: M.account_regions(v.environments), "SELECT DISTINCT account_id, region FROM environments")
add("set4_groups_with_type", lambda v: M.groups_with_type(v.monitored, C.GLUE_CRAWLERS),
    "SELECT DISTINCT group_name FROM monitored WHERE resource_type = 'glue_crawlers'")
add("srt3_by_environment",
    lambda v: in_emitted_order(M.by_environment(v.monitored), [], ["monitored_environment", "name"]),
    "SELECT *, true AS in_order FROM monitored")
add("jn15_missing_refs", lambda v: M.missing_refs(v.recipients, "delivery_method", v.delivery_methods, "name"),
    "SELECT DISTINCT c_mktsegment AS delivery_method FROM customer WHERE c_mktsegment = 'MACHINERY'")
add(
    "str1_truncate", lambda v: v.table("documents").select("doc_id", text.truncate(F.col("text"), 100).alias("t")),
    "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS t FROM documents",
)
add(
    "str3_name_from_arn", lambda v: v.raw_sfn.select(
        F.col("name").alias("id"), text.name_from_arn(F.col("stateMachineArn")).alias("machine"),
        text.name_from_arn(F.col("executionArn")).alias("missing")),
    "SELECT 'ex_' || event_id AS id, 'sm-' || (user_id // 2) AS machine, NULL::VARCHAR AS missing FROM ev",
)
add(
    "str12_display_names",
    lambda v: v.monitored.select("resource_type", text.display_name(F.col("resource_type")).alias("shown"),
                                 text.type_ordinal(F.col("resource_type")).alias("n")).distinct(),
    f"""SELECT * FROM (VALUES {', '.join(f"('{t}', '{n}', {i + 1})" for i, (t, n) in enumerate(C.DISPLAY_NAMES.items()))})
        t(resource_type, shown, n) WHERE resource_type IN (SELECT resource_type FROM monitored)""",
)

# --- checks -------------------------------------------------------------------------------


def _check_sql(rule: str, what: str, values: str) -> str:
    return f"SELECT DISTINCT '{rule}' AS rule, '{what}' AS message, v AS value FROM ({values})"


def _holed(v: Views, file: str) -> DataFrame:
    """A parsed file in which every third group, environment or recipient lacks fields."""
    raw = _loaded(v).raw[file]
    lacks = lambda name, r: F.try_element_at(F.regexp_extract_all(r[name], F.lit("[0-9]+"), 0), F.lit(-1)).cast("int") % 3 == 0
    hole = lambda r, test, field: r.withField(field, F.when(~F.coalesce(test, F.lit(False)), r[field]))
    if file == "general":
        return raw.withColumn("monitored_environments", F.transform(
            "monitored_environments", lambda r: hole(r, lacks("name", r), "region")))
    if file == "recipients":
        return raw.withColumn("recipients", F.transform(
            "recipients", lambda r: hole(r, lacks("recipient", r), "delivery_method")))
    return raw.withColumn("monitoring_groups", F.transform(
        "monitoring_groups", lambda g: g.withField(C.GLUE_JOBS, F.when(lacks("group_name", g), F.transform(
            g[C.GLUE_JOBS], lambda e: e.withField("name", F.lit(None).cast("string")))).otherwise(g[C.GLUE_JOBS]))))


add("val1_check_schema",
    lambda v: union_types([K.check_schema(_holed(v, f), f) for f in K.REQUIRED]),
    """SELECT 'schema of ' || f AS rule, f || ': required fields are missing' AS message, v AS value FROM (
        SELECT DISTINCT 'general' AS f, 'monitored_environments.region' AS v FROM supplier WHERE s_suppkey % 3 = 0
        UNION ALL SELECT DISTINCT 'recipients', 'recipients.delivery_method' FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT DISTINCT 'monitoring_groups', 'glue_jobs.name' FROM monitored
          WHERE resource_type = 'glue_jobs' AND replace(group_name, 'group-', '')::INT % 3 = 0)""")
add("val2_unique_environment_names", lambda v: (K.check_unique(v.environments, "name", "r", "w")),
    _check_sql("r", "w", "SELECT name AS v FROM environments GROUP BY name HAVING count(*) > 1"))
add("val3_unique_account_regions",
    lambda v: (K.check_unique(
        v.table("supplier").select((F.col("s_suppkey") % 50).cast("string").alias("account_id"),
                                   F.col("s_nationkey").cast("string").alias("region")), ["account_id", "region"], "r", "w")),
    _check_sql("r", "w", """SELECT (s_suppkey % 50) || ', ' || s_nationkey AS v FROM supplier GROUP BY s_suppkey % 50, s_nationkey
        HAVING count(*) > 1"""))
add("val4_unique_groups", lambda v: (K.check_unique(v.monitored, "group_name", "r", "w")),
    _check_sql("r", "w", "SELECT group_name AS v FROM monitored GROUP BY 1 HAVING count(*) > 1"))
add("val5_environments_exist",
    lambda v: (K.check_refs(v.monitored.withColumn("monitored_environment", F.concat(F.lit("env-"), F.col("entry_order") % 150)),
                                 "monitored_environment", v.environments, "name", "r", "w")),
    _check_sql("r", "w", """SELECT 'env-' || (entry_order % 150) AS v FROM monitored
        WHERE 'env-' || (entry_order % 150) NOT IN (SELECT name FROM environments)"""))
add("val6_groups_exist",
    lambda v: (K.check_refs(M.subscriptions(v.recipients), "monitoring_group", v.monitored, "group_name", "r", "w")),
    _check_sql("r", "w", "SELECT monitoring_group AS v FROM subs WHERE monitoring_group NOT IN (SELECT group_name FROM monitored)"))
add("val7_methods_exist",
    lambda v: (K.check_refs(v.recipients, "delivery_method", v.delivery_methods, "name", "r", "w")),
    _check_sql("r", "w", "SELECT c_mktsegment AS v FROM customer WHERE c_mktsegment = 'MACHINERY'"))
add("val_all_rules",
    lambda v: K.check_settings(_loaded(v)),
    """SELECT DISTINCT 'subscribed groups' AS rule, 'recipients: a subscription names an unknown group' AS message,
        monitoring_group AS value FROM subs WHERE monitoring_group NOT IN (SELECT group_name FROM monitored)
       UNION ALL SELECT DISTINCT 'delivery methods', 'recipients: an unknown delivery method', c_mktsegment FROM customer
        WHERE c_mktsegment = 'MACHINERY'""")
