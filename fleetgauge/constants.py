"""Names, states and texts that results have to carry."""

# --- resource types, in report order -------------------------------------------------
GLUE_JOBS = "glue_jobs"
GLUE_WORKFLOWS = "glue_workflows"
GLUE_CRAWLERS = "glue_crawlers"
GLUE_CATALOGS = "glue_catalogs"
GLUE_DATA_QUALITY = "glue_data_quality"
LAMBDA_FUNCTIONS = "lambda_functions"
STEP_FUNCTIONS = "step_functions"
EMR_SERVERLESS = "emr_serverless"

RESOURCE_TYPES = [
    GLUE_JOBS,
    GLUE_WORKFLOWS,
    GLUE_CRAWLERS,
    GLUE_CATALOGS,
    GLUE_DATA_QUALITY,
    LAMBDA_FUNCTIONS,
    STEP_FUNCTIONS,
    EMR_SERVERLESS,
]

DISPLAY_NAMES = {
    GLUE_JOBS: "Glue Jobs",
    GLUE_WORKFLOWS: "Glue Workflows",
    GLUE_CRAWLERS: "Glue Crawlers",
    GLUE_CATALOGS: "Glue Data Catalogs",
    GLUE_DATA_QUALITY: "Glue Data Quality",
    LAMBDA_FUNCTIONS: "Lambda Functions",
    STEP_FUNCTIONS: "Step Functions",
    EMR_SERVERLESS: "EMR Serverless",
}

# --- states of raw run records: (success states, failure states) ----------------------
RUN_STATES = {
    GLUE_JOBS: (["SUCCEEDED"], ["FAILED", "ERROR", "TIMEOUT", "STOPPED"]),
    GLUE_WORKFLOWS: (["COMPLETED"], ["STOPPED", "ERROR", "FAILURE"]),
    GLUE_CRAWLERS: (["COMPLETED"], ["FAILED", "STOPPED"]),
    LAMBDA_FUNCTIONS: (["SUCCEEDED"], ["FAILED"]),
    STEP_FUNCTIONS: (["SUCCEEDED"], ["FAILED", "ABORTED", "TIMED_OUT"]),
    EMR_SERVERLESS: (["SUCCESS"], ["FAILED", "CANCELLED"]),
}

# --- states of state-change events: (success states, failure states) ------------------
EVENT_STATES = {
    GLUE_JOBS: (["SUCCEEDED"], ["FAILED", "ERROR", "TIMEOUT", "STOPPED"]),
    GLUE_CRAWLERS: (["Succeeded"], ["Failed"]),
    GLUE_DATA_QUALITY: (["SUCCEEDED"], ["FAILED", "TIMEOUT", "STOPPED"]),
    LAMBDA_FUNCTIONS: (["SUCCEEDED"], ["FAILED"]),
    STEP_FUNCTIONS: (["SUCCEEDED"], ["FAILED", "ABORTED", "TIMED_OUT"]),
    EMR_SERVERLESS: (["SUCCESS"], ["FAILED", "CANCELLED"]),
}
WORKFLOW_EVENT_FAILURES = ["STOPPED", "ERROR", "FAILURE"]
CATALOG_EVENT_SUCCESS = "SUCCESS"

# --- data quality ---------------------------------------------------------------------
RULE_SUCCESS = ["PASS"]
RULE_FAILURE = ["FAIL", "ERROR"]
CONTEXT_CATALOG = "GLUE_DATA_CATALOG"
CONTEXT_JOB = "GLUE_JOB"

# --- event results and digest statuses ------------------------------------------------
INFO, SUCCESS, FAILURE = "INFO", "SUCCESS", "FAILURE"
OK, WARNING, ERROR, NO_STATUS = "ok", "warning", "error", "no_status"

# --- function log line markers --------------------------------------------------------
LOG_START = "START"
LOG_ERROR = "[ERROR]"
LOG_END = "END"
LOG_REPORT = "REPORT RequestId:"
LOG_IGNORED = "INIT_START"

# --- error text lengths ---------------------------------------------------------------
NODE_ERROR_CHARS = 50
ERROR_CHARS = 100
BATCH_ERROR_CHARS = 200
BATCH_STOCK_SENTENCE = (
    "Job failed, please check complete logs in configured logging destination."
)

# --- digest defaults and report headers -----------------------------------------------
DIGEST_PERIOD_HOURS = 24
DIGEST_CRON = "cron(0 8 * * ? *)"
RETENTION_DAYS = 365
WRITABLE_HOURS = 24
GROUP_ID_CHARS = 128

SUMMARY_HEADER = [
    "Monitoring Group", "Service", "Executions", "Success", "Failures", "Warnings",
]
RESOURCE_HEADER = ["Resource Name", "Success", "Errors", "Warnings", "Comments"]
CATALOG_SUMMARY_HEADER = [
    "Monitoring Group", "Service", "Tables Added", "Partitions Added", "Indexes Added",
    "Total Tables", "Total Partitions", "Total Indexes",
]
CATALOG_RESOURCE_HEADER = [
    "Resource Name", "Tables Added", "Partitions Added", "Indexes Added", "Tables",
    "Partitions", "Indexes", "Comments",
]

# --- where events come from -----------------------------------------------------------
# Events the platform sends itself: source, detail-type, resource type.
PLATFORM_EVENTS = [
    ("aws.glue", "Glue Job State Change", GLUE_JOBS),
    ("aws.glue", "Glue Data Catalog Database State Change", GLUE_CATALOGS),
    ("aws.glue", "Glue Data Catalog Table State Change", GLUE_CATALOGS),
    ("aws.glue", "Glue Crawler State Change", GLUE_CRAWLERS),
    ("aws.glue-dataquality", "Data Quality Evaluation Results Available", GLUE_DATA_QUALITY),
    ("aws.states", "Step Functions Execution Status Change", STEP_FUNCTIONS),
    ("aws.emr-serverless", "EMR Serverless Job Run State Change", EMR_SERVERLESS),
]
# Events derived from collected runs: source suffix, detail-type, resource type. The
# publishing prefix is a setting; it has to be the same in publisher and consumer.
DERIVED_EVENTS = [
    ("glue_workflow", "Glue Workflow State Change", GLUE_WORKFLOWS),
    ("lambda", "Lambda Function Execution State Change", LAMBDA_FUNCTIONS),
]
DEFAULT_EVENT_PREFIX = "fleetgauge"

# --- measures a series may show, per type ---------------------------------------------
SERIES_MEASURES = {
    GLUE_JOBS: ["execution", "dpu_seconds", "execution_time_sec", "failed", "succeeded"],
    GLUE_WORKFLOWS: [
        "execution", "actions_failed", "actions_stopped", "actions_timeouted",
        "actions_total", "actions_succeeded", "actions_errored", "execution_time_sec",
        "failed", "succeeded",
    ],
    GLUE_CRAWLERS: [
        "execution", "failed", "succeeded", "duration_sec", "dpu_seconds", "tables_added",
        "tables_updated", "tables_deleted", "partitions_added", "partitions_updated",
        "partitions_deleted",
    ],
    GLUE_CATALOGS: ["tables_count", "partitions_count", "indexes_count"],
    GLUE_DATA_QUALITY: [
        "execution", "score", "succeeded", "failed", "rules_succeeded", "rules_failed",
        "total_rules", "execution_time_sec",
    ],
    LAMBDA_FUNCTIONS: [
        "execution", "succeeded", "failed", "retry_attempts", "duration_ms",
        "max_memory_used_mb", "billed_duration_ms", "memory_size_mb", "GB_seconds",
    ],
    STEP_FUNCTIONS: ["execution", "duration_sec", "failed", "succeeded"],
    EMR_SERVERLESS: [
        "execution", "succeeded", "failed", "execution_time_sec", "total_vCPU_hour",
        "total_memory_GB_hour", "total_storage_GB_hour", "billed_vCPU_hour",
        "billed_memory_GB_hour", "billed_storage_GB_hour",
    ],
}

# --- per-type column of the run id and of the duration --------------------------------
RUN_ID = {
    GLUE_JOBS: "job_run_id",
    GLUE_WORKFLOWS: "workflow_run_id",
    GLUE_CRAWLERS: "crawl_id",
    GLUE_CATALOGS: "catalog_id",
    GLUE_DATA_QUALITY: "dq_result_id",
    LAMBDA_FUNCTIONS: "lambda_function_request_id",
    STEP_FUNCTIONS: "step_function_run_id",
    EMR_SERVERLESS: "job_run_id",
}
DURATION = {
    GLUE_JOBS: "execution_time_sec",
    GLUE_WORKFLOWS: "execution_time_sec",
    GLUE_CRAWLERS: "duration_sec",
    GLUE_DATA_QUALITY: "execution_time_sec",
    STEP_FUNCTIONS: "duration_sec",
    EMR_SERVERLESS: "execution_time_sec",
}
