"""Column names and fixed texts shared by the operators."""

# The report columns, in declared order.
REQUIRED_COLUMNS = (
    "CampaignName",
    "JobNumber",
    "OurRef",
    "PropertyName",
    "LocationText",
    "SpecificationText",
    "StartDate",
)

# Cell texts that count as missing when they fill the whole, untrimmed cell.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# File suffixes that hold a report.
REPORT_SUFFIXES = (".tsv", ".csv", ".xls", ".xlsx")

# Statuses, reasons and messages written into the result tables.
SKIP_EXISTS = "skip_exists"
WOULD_CREATE = "would_create"
CREATED = "created"
ERROR_PARENT_CREATE = "error_parent_create"
PARENT_SKIP_EXISTS = "parent_skip_exists"
ERROR_PARENT_NOT_CREATED = "error_parent_not_created"
ERROR_SUBTASK_CREATE = "error_subtask_create"

REASON_EXISTS = "Found existing task containing job number in dedupe projects"
REASON_NEW = "No existing task found in dedupe projects"
REASON_CREATED = "Created parent task"

MESSAGE_DRY_RUN = "Dry run"
MESSAGE_SKIPPED = "Skipped because parent already exists"
MESSAGE_NO_PARENT = "Parent not created successfully"
MESSAGE_CREATED = "Created subtask"

UNMATCHED_ITEM = "Trafficking rows"

KIND_SOURCE = "source"
KIND_CONTROL = "control"

# Keys of a parent item; every operator carries the report it came from.
PARENT_KEY = ("report_id", "campaign_name", "job_number")
CHILD_KEY = (*PARENT_KEY, "our_ref")

PARENT_COLUMNS = (
    "task_name",
    "campaign_name",
    "job_number",
    "parent_due_on",
    "status",
    "reason",
    "parent_task_gid",
)
PARENT_COLUMNS_INTERACTIVE = (
    "task_name",
    "campaign_name",
    "job_number",
    "status",
    "reason",
    "target_project_gid",
)
CHILD_COLUMNS = (
    "parent_task_name",
    "parent_job_number",
    "parent_status",
    "our_ref",
    "subtask_name",
    "subtask_due_on",
    "start_date_raw",
    "subtask_kind",
    "subtask_status",
    "subtask_gid",
    "message",
)
CHILD_COLUMNS_INTERACTIVE = (
    "parent_task_name",
    "parent_job_number",
    "parent_status",
    "our_ref",
    "subtask_name",
    "subtask_due_on",
    "start_date_raw",
    "subtask_status",
)
UNMATCHED_COLUMNS = ("item", "reason")
