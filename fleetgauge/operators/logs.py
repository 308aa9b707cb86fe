"""Function logs to invocations.

A log stream is a sequence of START, `[ERROR]`, END and REPORT lines. START opens the
invocation of its request id, REPORT closes and emits it, and error lines without an id
belong to whatever the stream opened last. Retries reuse the id, so every START begins a
new attempt.

All of that is "the last marker before this line", which a window over a whole stream would
answer one task per stream. One stream may hold a large part of the log, so windows here
cover one time slice of a stream, and what a slice needs from earlier ones comes from a
summary with one row per slice. A busy stream is then spread over many tasks, and the rows
that cross slices number slices, not lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge import constants as C
from fleetgauge.functions.outcome import lambda_error
from fleetgauge.functions.timefn import to_ms
from fleetgauge.session import never_sent

START, ERROR, END, REPORT = 1, 2, 3, 4
OWNER = ["monitored_environment", "function_name", "log_stream"]
SLICE_MINUTES = 10

# Joined by "<br/>", 22 texts are longer than the 100 characters kept whatever they say, so
# the cut result never depends on a later one.
ERRORS_THAT_SHOW = C.ERROR_CHARS // len("<br/>") + 2


def relevant_lines(log: DataFrame) -> DataFrame:
    """Lines that mark something, without runtime-initialisation notices."""
    m = F.col("message")
    marked = (
        m.contains(C.LOG_START) | m.contains(C.LOG_ERROR) | m.contains(C.LOG_END)
        | m.contains(C.LOG_REPORT)
    )
    return log.filter(marked & ~m.contains(C.LOG_IGNORED))


def line_kind(message: Column) -> Column:
    """Kind of a line; the first marker in this order wins. NULL for none."""
    return (
        F.when(message.contains(C.LOG_START), START)
        .when(message.contains(C.LOG_ERROR), ERROR)
        .when(message.contains(C.LOG_END), END)
        .when(message.contains(C.LOG_REPORT), REPORT)
    )


def order_log(log: DataFrame) -> DataFrame:
    """Lines by stream, then time; equal times in the order a run writes them."""
    return log.orderBy(*OWNER, "ts", line_kind(F.col("message")), "message")


_NO_NAME = "\x00"
# Kind of a START that is open but no longer its stream's active one (see `still_open`).
DORMANT = 0


def _lines(log: DataFrame, slice_minutes: int) -> DataFrame:
    """Marking lines, all lines of a slice of a stream in one task.

    Every window and sum over a slice works on this one layout.
    """
    kind = line_kind(F.col("message"))
    if "revives" in log.columns:
        kind = F.when((kind == START) & ~F.col("revives"), DORMANT).otherwise(kind)
    return relevant_lines(log).filter(F.length("log_stream") > 0).select(
        # Never null, so that every branch of the plan reads and deals out the same lines, once.
        *[F.coalesce(c, F.lit(_NO_NAME)).alias(c) for c in OWNER],
        F.coalesce("request_id", F.lit("")).alias("rid"),
        to_ms(F.col("ts")).alias("ts"),
        kind.alias("kind"),
        "message",
        F.floor(F.unix_seconds("ts") / (60 * slice_minutes)).alias("slice"),
    ).repartition(*OWNER, "slice")


_ORDER = ["ts", "kind", "message"]
SLICE = [*OWNER, "slice"]


def _position() -> Column:
    return F.struct(*_ORDER)


def _starts() -> Column:
    return F.col("kind").isin(START, DORMANT)


def _orphan() -> Column:
    """Error lines that name no request."""
    return (F.col("kind") == ERROR) & (F.col("rid") == "")


def _upto(keys: list[str], last: int):
    return Window.partitionBy(*keys).orderBy(*_ORDER).rowsBetween(
        Window.unboundedPreceding, last
    )


def _earlier_slices(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)


def _with_attempt(lines: DataFrame) -> DataFrame:
    """Attempt number of every line that names its request, dropping lines with no open one.

    A line other than START counts only while the id's latest START or REPORT is a START.
    A slice's summary of an id is how many attempts it starts and its last START or REPORT; what
    the summaries of earlier slices add up to comes with the slice, as a map by id.
    """
    key, within = [*OWNER, "rid"], [*SLICE, "rid"]
    mark = F.when(_starts(), START).when(F.col("kind") == REPORT, REPORT)
    summary = lines.groupBy(*within).agg(
        F.count_if(_starts()).alias("starts"), F.max_by(mark, F.when(mark.isNotNull(), _position())).alias("mark")
    )
    # Ids that live in one slice drop out.
    carried = (
        summary.select(
            *within,
            F.sum("starts").over(_earlier_slices(key)).alias("starts_before"),
            F.last("mark", ignorenulls=True).over(_earlier_slices(key)).alias("mark_before"),
        )
        .filter(F.col("mark_before").isNotNull())
        .groupBy(*SLICE)
        .agg(F.map_from_entries(F.collect_list(F.struct("rid", F.struct("starts_before", "mark_before")))).alias("ids"))
    )
    upto = _upto(within, Window.currentRow)
    seen = lines.withColumns(
        {
            "starts_here": F.count_if(_starts()).over(upto),
            "mark_here": F.last(mark, ignorenulls=True).over(_upto(within, -1)),
            "_errors": F.count_if(F.col("kind") == ERROR).over(upto),
        }
    ).withColumn("_errors_at_start", F.max(F.when(_starts(), F.col("_errors"))).over(upto))
    placed = seen.join(never_sent(carried), SLICE, "left").withColumn("before", F.try_element_at("ids", F.col("rid")))
    latest = F.coalesce("mark_here", "before.mark_before")
    return placed.filter(_orphan() | _starts() | (latest == START)).select(
        *SLICE, "rid",
        (F.coalesce("before.starts_before", F.lit(0)) + F.col("starts_here")).alias("attempt"),
        "ts", "kind", "message",
        (F.col("_errors") - F.coalesce("_errors_at_start", F.lit(0))).alias("nth_error"),
    )


def _adopt_orphans(placed: DataFrame) -> DataFrame:
    """Give error lines without an id to the invocation their stream has open.

    A slice's summary is the state its last START or REPORT leaves the stream in.
    """
    opened = F.struct("rid", "attempt", F.lit(True).alias("open"))
    closed = F.struct(F.lit("").alias("rid"), F.lit(0).cast("bigint").alias("attempt"), F.lit(False).alias("open"))
    marked = placed.withColumn("state", F.when(F.col("kind") == START, opened).when(F.col("kind") == REPORT, closed))
    summary = marked.groupBy(*SLICE).agg(F.max_by("state", F.when(F.col("state").isNotNull(), _position())).alias("state"))
    carried = summary.select(*SLICE, F.last("state", ignorenulls=True).over(_earlier_slices(OWNER)).alias("before")).filter(
        F.col("before").isNotNull()
    )
    upto = _upto(SLICE, Window.currentRow)
    orphans = F.count_if(_orphan()).over(upto)
    seen = marked.withColumns({"here": F.last("state", ignorenulls=True).over(upto), "_orphans": orphans}).withColumn(
        "_orphans_at_start", F.max(F.when(F.col("kind") == START, F.col("_orphans"))).over(upto)
    )
    owned = seen.join(never_sent(carried), SLICE, "left").withColumn("owner", F.coalesce("here", "before"))
    adopted = lambda mine, theirs: F.when(_orphan(), theirs).otherwise(mine)
    return owned.filter(~_orphan() | F.col("owner.open")).select(
        *[F.nullif(F.col(c), F.lit(_NO_NAME)).alias(c) for c in OWNER],
        adopted(F.col("rid"), F.col("owner.rid")).alias("rid"),
        adopted(F.col("attempt"), F.col("owner.attempt")).alias("attempt"),
        "ts", F.greatest("kind", F.lit(START)).alias("kind"), "message", (F.col("kind") != DORMANT).alias("revives"), "slice",
        adopted(F.col("nth_error"), F.col("_orphans") - F.coalesce("_orphans_at_start", F.lit(0))).alias("nth_error"),
    )


def with_active_request(log: DataFrame, slice_minutes: int = SLICE_MINUTES) -> DataFrame:
    """Every counting line with the request id and attempt it belongs to.

    The log is read and dealt out once, by slices of streams; every step after that stays in
    this layout, and only summaries, one row per slice and id or per slice, move.
    """
    return _adopt_orphans(_with_attempt(_lines(log, slice_minutes)))


def _attempts(lines: DataFrame) -> DataFrame:
    """One row per attempt, closed or not."""
    kind = F.col("kind")
    shown = (kind == ERROR) & (F.col("nth_error") <= ERRORS_THAT_SHOW)
    return lines.groupBy(*OWNER, "rid", "attempt").agg(
        F.min(F.when(kind == START, F.col("ts"))).alias("started_on"),
        F.max(F.when(kind == END, F.col("ts"))).alias("completed_on"),
        F.max(F.when(kind == REPORT, F.col("message"))).alias("report"),
        F.count_if(kind == ERROR).alias("error_count"),
        F.collect_list(F.when(shown, F.struct("ts", "message"))).alias("shown"),
    )


def _invocations(attempts: DataFrame) -> DataFrame:
    request_id = F.nullif("rid", F.lit(""))
    first = F.slice(F.sort_array("shown"), 1, ERRORS_THAT_SHOW)["message"]
    return attempts.filter(F.col("report").isNotNull()).select(
        *OWNER,
        request_id.alias("request_id"),
        "attempt",
        F.when(F.col("error_count") > 0, "FAILED")
        .when(F.col("completed_on").isNotNull(), "SUCCEEDED")
        .otherwise("RUNNING")
        .alias("status"),
        "started_on",
        "completed_on",
        "report",
        "error_count",
        lambda_error(first, request_id).alias("error_message"),
    )


def sessionise(log: DataFrame, slice_minutes: int = SLICE_MINUTES) -> DataFrame:
    """Closed invocations of a log, one row per START that reached its REPORT."""
    return _invocations(_attempts(with_active_request(log, slice_minutes)))


def still_open(lines: DataFrame) -> DataFrame:
    """Log lines of attempts that may still get their REPORT, in the log's own shape.

    Running the next piece of the log together with these gives what one run over both
    would. `revives` is false for a START that is open but no longer its stream's active one.
    """
    key = [*OWNER, "rid"]
    state = lines.groupBy(*key, "attempt").agg(F.max("kind").alias("top"))
    latest = state.groupBy(*key).agg(F.max(F.struct("attempt", "top")).alias("l")).select(
        *key, F.col("l.attempt").alias("attempt"), F.col("l.top").alias("top")
    )
    pending = latest.filter(F.col("top") != REPORT).select(*key, "attempt")
    active = (
        lines.filter((F.col("kind") == REPORT) | ((F.col("kind") == START) & F.col("revives")))
        .groupBy(*OWNER)
        .agg(F.max_by(F.struct("rid", "attempt", "kind"), _position()).alias("a"))
        .select(*OWNER, F.col("a.rid").alias("rid"), F.col("a.attempt").alias("attempt"),
                (F.col("a.kind") == START).alias("active"))
    )
    kept = lines.join(pending, [*key, "attempt"], "left_semi")
    return kept.join(active, [*key, "attempt"], "left").select(
        *OWNER, F.nullif("rid", F.lit("")).alias("request_id"), "ts", "message",
        F.coalesce("active", F.lit(False)).alias("revives"),
    )
