"""Joins between resources, monitoring groups, environments and recipients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.functions.globs import (
    GRAM_LENGTHS, glob_to_regex, grams, has_glob, literal_pieces, marked, no_grams, pattern_grams,
)
from fleetgauge.operators.ordinals import pieces
from fleetgauge.session import bounded_broadcast, is_small, never_sent, settle


def glob_candidates(names: DataFrame, patterns: DataFrame, name: str, pattern: str, on: list[str]) -> DataFrame:
    """Pairs of a name and a pattern that may match it, each once, with `_open` where a test has to tell.

    Exact entries meet the whole name, patterns without a literal character (a bare `*`) every
    name of their `on` columns. All others meet through an index of grams: the grams of all names are
    counted, and each pattern looks up the rarest of its own, wherever in the pattern it stands.
    Only gram lengths that occur in patterns are counted and looked up.
    All joins are ordinary equality joins, so neither side has to fit anywhere: names and their grams are never
    sent, patterns only where they are counted to be few. Both sides are read several times: callers settle what is
    dear to work out.
    """
    if not on:
        whole = [df.withColumn("_all", F.lit(True)) for df in (names, patterns)]
        return glob_candidates(*whole, name, pattern, ["_all"]).drop("_all")
    text = F.col(pattern)
    globbed = patterns.filter(has_glob(text)).withColumn("_open", F.lit(True))
    plain = patterns.filter(~has_glob(text)).withColumns({"_open": F.lit(False), name: text})
    exact = never_sent(names).join(bounded_broadcast(plain), [*on, name])
    free = F.size(literal_pieces(text)) == 0
    bare = never_sent(names).join(bounded_broadcast(globbed.filter(free)), on)
    wanted = globbed.filter(~free).select(*on, pattern).distinct()
    wanted = wanted.select(*on, pattern, F.explode(pattern_grams(text)).alias("_gram"))
    lengths = wanted.agg(F.collect_set(F.length("_gram")).alias("n")).scalar()
    per_length = F.array(
        *[F.when(F.array_contains(lengths, n), grams(marked(F.col(name)), F.lit(n))).otherwise(no_grams()) for n in GRAM_LENGTHS]
    )
    posted = F.explode(F.flatten(per_length)).alias("_gram")
    seen = names.select(*on, posted)
    # Only what some pattern asks for is counted, where that is a few grams.
    asked = wanted.select(*on, "_gram").distinct()
    if is_small(asked):
        seen = seen.join(F.broadcast(asked), [*on, "_gram"], "left_semi")
    counts = seen.groupBy(*on, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    # A gram that no name has rules its pattern out: it counts 0 and is the rarest.
    rarest = wanted.join(never_sent(counts), [*on, "_gram"], "left").groupBy(*on, pattern).agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_r")
    )
    looked_up = settle(never_sent(globbed).join(rarest.select(*on, pattern, F.col("_r.gram").alias("_gram")), [*on, pattern]), "looked-up")
    indexed = never_sent(names.select("*", posted)).join(bounded_broadcast(looked_up), [*on, "_gram"]).drop("_gram")
    return exact.unionByName(bare).unionByName(indexed)


def glob_join(names: DataFrame, patterns: DataFrame, name: str, pattern: str, on: list[str]) -> DataFrame:
    """Pairs of a name and a pattern that matches it, within equal `on` columns.

    The expression test runs on the candidates of the index alone.
    """
    pairs = glob_candidates(names, patterns, name, pattern, on)
    matching = ~F.col("_open") | F.rlike(F.col(name), glob_to_regex(F.col(pattern)))
    return pairs.filter(matching).drop("_open")


def match_groups(resources: DataFrame, monitored: DataFrame, match_env: bool = False) -> DataFrame:
    """Monitoring groups of each resource: distinct (type, name, group).

    Resources are made distinct first and settled, so a fact table costs one pass and one partial
    aggregate. With `match_env` the environments have to agree too.
    """
    on = ["resource_type", *(["monitored_environment"] if match_env else [])]
    names = settle(resources.select(*on, "resource_name").distinct(), "names")
    patterns = monitored.select(
        *on, "group_name", F.col("name").alias("pattern")
    ).filter(F.length("pattern") > 0).distinct()
    return glob_join(names, patterns, "resource_name", "pattern", on).select(
        *on, "resource_name", "group_name"
    ).distinct()


def in_scope(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Events of resources that are in at least one group (`match_groups`)."""
    keys = [c for c in matches.columns if c != "group_name"]
    return events.join(bounded_broadcast(matches.select(*keys).distinct()), keys, "left_semi")


def expand_wildcards(monitored: DataFrame, inventory: DataFrame) -> DataFrame:
    """Patterns replaced by the names that exist in the entry's environment.

    Exact names stay only if they exist, data-quality names stay regardless. A section
    (group and type) with nothing left keeps its entries as written, marked unresolved. A
    name two entries of a section give is taken once, from the later entry.
    """
    on = ["resource_type", "monitored_environment"]
    section = ["group_name", "resource_type"]
    carried = ["sla_seconds", "minimum_number_of_runs", "entry_order"]
    existing = settle(inventory.select(*on, F.col("name").alias("found")).distinct(), "existing")
    entries = monitored.withColumnRenamed("name", "pattern")
    out = [*section, "monitored_environment", "name", *carried]

    found = glob_join(existing, entries, "found", "pattern", on).withColumnRenamed("found", "name")
    kept = found.select(*out).unionByName(
        entries.filter(
            (F.col("resource_type") == C.GLUE_DATA_QUALITY) & ~has_glob(F.col("pattern"))
        ).withColumnRenamed("pattern", "name").select(*out)
    )
    kept = settle(kept, "kept")
    resolved = last_entry_wins(kept).withColumn("resolved", F.lit(True))
    unresolved = last_entry_wins(
        monitored.select(*out).join(bounded_broadcast(kept.select(*section).distinct()), section, "left_anti")
    ).withColumn("resolved", F.lit(False))
    return resolved.unionByName(unresolved)


def last_entry_wins(entries: DataFrame) -> DataFrame:
    """One entry per (group, type, environment, name): the one written last."""
    keys = ["group_name", "resource_type", "monitored_environment", "name"]
    rest = [c for c in entries.columns if c not in keys]
    return entries.groupBy(*keys).agg(
        F.max(F.struct("entry_order", *[c for c in rest if c != "entry_order"])).alias("e")
    ).select(*keys, *[F.col(f"e.{c}").alias(c) for c in rest])


def with_environment(
    events: DataFrame, environments: DataFrame, account: Column, region: Column
) -> DataFrame:
    """Name of the environment an account and region stand for; NULL when none does."""
    envs = environments.select(
        F.col("account_id").alias("_account"), F.col("region").alias("_region"),
        F.col("name").alias("monitored_environment"),
    )
    return events.join(
        bounded_broadcast(envs),
        (account == F.col("_account")) & (region == F.col("_region")),
        "left",
    ).drop("_account", "_region")


def with_account(resources: DataFrame, environments: DataFrame) -> DataFrame:
    """Account and region of each entry's environment; entries without one drop out."""
    envs = environments.select(
        F.col("name").alias("monitored_environment"), "account_id",
        F.col("region").alias("region_name"),
    )
    return resources.filter(F.col("monitored_environment").isNotNull()).join(
        bounded_broadcast(envs), "monitored_environment"
    )


# --- recipients -----------------------------------------------------------------------

_FLAG = {"alert": "alerts", "digest": "digest"}


def subscriptions(recipients: DataFrame) -> DataFrame:
    """One row per recipient and subscription."""
    return recipients.select(
        "recipient", "delivery_method", F.explode("subscriptions").alias("s")
    ).select("recipient", "delivery_method", "s.*")


def recipients_for(groups: DataFrame, recipients: DataFrame, kind: str) -> DataFrame:
    """Distinct (group columns, recipient, delivery method) subscribed for a kind of notice."""
    wanted = subscriptions(recipients).filter(F.col(_FLAG[kind])).select(
        F.col("monitoring_group").alias("group_name"), "recipient", "delivery_method"
    )
    keys = [c for c in groups.columns if c != "group_name"]
    return groups.join(wanted, "group_name").select(
        *keys, "recipient", "delivery_method"
    ).distinct()


def with_delivery_method(df: DataFrame, methods: DataFrame) -> DataFrame:
    """Attach the delivery method's type; NULL when the name is unknown."""
    known = methods.select(
        F.col("name").alias("delivery_method"), "delivery_method_type"
    )
    return df.join(bounded_broadcast(known), "delivery_method", "left")


#: Recipients that one delivery names at most; more are told by further deliveries.
RECIPIENTS = 50


def in_deliveries(rows: DataFrame, group: list[str], methods: DataFrame) -> DataFrame:
    """Recipients of each group in deliveries of bounded size, numbered by `part` from 0, in order of name."""
    numbered = pieces(rows.select(*group, "recipient"), group, ["recipient"], RECIPIENTS)
    lists = numbered.groupBy(*group, F.col("piece").alias("part")).agg(F.sort_array(F.collect_list("recipient")).alias("recipients"))
    return with_delivery_method(lists, methods)


#: Recipients up to which a resource's lists are put together as values; those of more are numbered as rows.
LISTED = 10_000


def delivery_options(matches: DataFrame, recipients: DataFrame, methods: DataFrame, tasks: int | None = None) -> DataFrame:
    """Recipients per resource and delivery method, for alerts, in deliveries of bounded size.

    Worked out once per resource, however many events there are. Recipients of a group are listed
    once, and a resource's deliveries are cut from the lists of its groups, so that what moves is a
    few lists a resource. Where these hold more than `LISTED` recipients, the rows are numbered instead.
    With `tasks` they come dealt by resource over so many, and who joins them by resource moves none again.
    """
    keys = [c for c in matches.columns if c != "group_name"]
    matches = settle(matches, "matches")
    wanted = settle(recipients_for(matches.select("group_name").distinct().withColumn("_in", F.col("group_name")), recipients, "alert"), "wanted")
    wanted = wanted.withColumnRenamed("_in", "group_name")
    sizes = wanted.groupBy("group_name").agg(F.count(F.lit(1)).alias("_n"))
    totals = matches.join(sizes, "group_name").groupBy(*keys).agg(F.sum("_n").alias("_n"))
    many = settle(totals.filter(F.col("_n") > LISTED).select(*keys), "many")
    if many.isEmpty():
        return with_delivery_method(_listed_deliveries(matches, wanted, keys, tasks), methods)
    # No list is made of a group too large for one.
    bounded = sizes.filter(F.col("_n") <= LISTED).select("group_name")
    listed = _listed_deliveries(
        matches.join(many, keys, "left_anti"), wanted.join(bounded, "group_name", "left_semi"), keys
    )
    rows = in_deliveries(recipients_for(matches.join(many, keys, "left_semi"), recipients, "alert"), [*keys, "delivery_method"], methods)
    found = with_delivery_method(listed, methods).unionByName(rows)
    return found.repartition(tasks, *keys) if tasks else found


def _listed_deliveries(matches: DataFrame, wanted: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Deliveries (keys, delivery_method, part, recipients) cut from the lists of each resource's groups.

    A missing name takes the first place, as in the order of rows, and is not listed.
    """
    lists = wanted.groupBy("group_name", "delivery_method").agg(
        F.collect_list("recipient").alias("_names"), F.max(F.col("recipient").isNull()).alias("_none")
    )
    joined = matches.join(lists, "group_name")
    whole = (joined.repartition(tasks, *keys) if tasks else joined).groupBy(*keys, "delivery_method").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("_names")))).alias("_names"), F.max("_none").alias("_none")
    )
    places = F.size("_names") + F.col("_none").cast("int")
    cuts = F.sequence(F.lit(0), F.floor((places - 1) / RECIPIENTS).cast("int"))
    first = lambda i: i * RECIPIENTS + 1 - F.col("_none").cast("int")
    one = lambda i: F.slice("_names", F.greatest(first(i), F.lit(1)), F.lit(RECIPIENTS) - F.greatest(1 - first(i), F.lit(0)))
    return whole.select(*keys, "delivery_method", F.posexplode(F.transform(cuts, one)).alias("part", "recipients")).withColumn(
        "part", F.col("part").cast("bigint"))


def recipient_groups(recipients: DataFrame, kind: str) -> DataFrame:
    """Each recipient with the groups it wants for a kind of notice (maybe none)."""
    flag = _FLAG[kind]
    wanted = F.transform(
        F.filter("subscriptions", lambda s: F.coalesce(s[flag], F.lit(False))),
        lambda s: s["monitoring_group"],
    )
    return recipients.select("recipient", "delivery_method", wanted.alias("monitoring_groups"))


def group_recipients(recipients: DataFrame, methods: DataFrame) -> DataFrame:
    """Recipients who share delivery method and group set, as one digest audience, in deliveries of bounded size."""
    wanted = recipient_groups(recipients, "digest").withColumn(
        "monitoring_groups", F.sort_array("monitoring_groups")
    )
    return in_deliveries(wanted, ["delivery_method", "monitoring_groups"], methods)


def digest_audience(groups_with_data: DataFrame, audiences: DataFrame) -> DataFrame:
    """(audience, monitoring group) pairs that have something to report."""
    flat = audiences.select(
        "delivery_method", "monitoring_groups",
        F.explode(F.array_distinct("monitoring_groups")).alias("group_name"),
    )
    return flat.join(groups_with_data.select("group_name").distinct(), "group_name", "left_semi")


# --- look-ups -------------------------------------------------------------------------


def with_app_name(runs: DataFrame, apps: DataFrame) -> DataFrame:
    """Application name as `resource_name`, by application id."""
    named = apps.select(F.col("id").alias("applicationId"), F.col("name").alias("resource_name"))
    return runs.join(bounded_broadcast(named), "applicationId")


def with_machine_arn(runs: DataFrame, machines: DataFrame) -> DataFrame:
    """State machine name as `resource_name`, by its address."""
    named = machines.select("stateMachineArn", F.col("name").alias("resource_name"))
    return runs.join(bounded_broadcast(named), "stateMachineArn")


def missing_refs(df: DataFrame, column: str, reference: DataFrame, ref_column: str) -> DataFrame:
    """Distinct values of a column that the reference list does not have."""
    known = reference.select(F.col(ref_column).alias(column))
    return df.select(column).distinct().join(known, column, "left_anti")


def accounts(environments: DataFrame) -> DataFrame:
    return environments.select("account_id").distinct()


def account_regions(environments: DataFrame) -> DataFrame:
    return environments.select("account_id", "region").distinct()


def groups_with_type(monitored: DataFrame, resource_type: str) -> DataFrame:
    """Groups with a section of the given type."""
    return monitored.filter(F.col("resource_type") == resource_type).select("group_name").distinct()


def by_environment(df: DataFrame) -> DataFrame:
    """Rows laid out so that an environment's entries sit together.

    Ranges over (environment, name) rather than a hash of the environment: a large
    environment then spreads over several tasks.
    """
    keys = ["monitored_environment", "name" if "name" in df.columns else "resource_name"]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)
