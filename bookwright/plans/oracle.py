"""Independent SQL for every registered query, over the same tables."""

from __future__ import annotations

from bookwright import schema as S
from bookwright.plans.fixtures import MISSING_TEXTS, PRESENT_TEXTS

PIVOT_YEAR = 2026
MAX_MESSAGES = 20
OVERSIZE = 150
PREVIEW_ROWS = 30

_WS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_NA = ", ".join("'" + t + "'" for t in MISSING_TEXTS)


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _campaign(x: str) -> str:
    return f"regexp_replace(regexp_replace({_strip(x)}, ',{_WS}*$', ''), '{_WS}+', ' ', 'g')"


def _job(x: str) -> str:
    return rf"regexp_replace({_strip(x)}, '^([0-9]*)\.0$', '\1')"


def _fill(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} IN ({_NA}) THEN '' ELSE {x} END"


def _iso(d: str) -> str:
    return f"coalesce(strftime({d}, '%Y-%m-%d'), '')"


def _minus_weekdays(d: str, n: int) -> str:
    """The n-th weekday before a date, found by listing the days before it."""
    if n == 0:
        return d
    days = f"[CAST({d} AS DATE) - CAST(i AS INT) FOR i IN range(1, {2 * n + 6})]"
    return f"([x FOR x IN {days} IF isodow(x) < 6])[{n}]"


_RAW = """
raw AS (
  SELECT 'r' || (o_custkey // 150) AS report_id,
    CASE WHEN l_orderkey % 17 = 0 THEN '' WHEN l_orderkey % 29 = 0 THEN 'NA'
         WHEN l_orderkey % 2 = 1 THEN '  ' || c_mktsegment || '   ' || o_orderpriority || ', '
         ELSE '  ' || c_mktsegment || '   ' || o_orderpriority END AS "CampaignName",
    CASE WHEN l_orderkey % 19 = 0 THEN '' WHEN l_orderkey % 2 = 0 THEN l_orderkey || '.0'
         ELSE CAST(l_orderkey AS VARCHAR) END AS "JobNumber",
    CASE WHEN l_partkey % 23 = 0 THEN ' ' ELSE CAST(l_linenumber AS VARCHAR) END AS "OurRef",
    s_name AS "PropertyName", n_name AS "LocationText", p_name AS "SpecificationText",
    CASE l_suppkey % 4 WHEN 0 THEN 'TBC' WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d')
         ELSE strftime(l_shipdate, '%d/%m/%Y') END AS "StartDate",
    l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey
)"""
_RAW_COLUMNS = 'report_id, "CampaignName", "JobNumber", "OurRef", "PropertyName", "LocationText", "SpecificationText", "StartDate"'
_ROW_ORDER = "l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice"

_BOOKINGS = f"""{_RAW},
b AS (
  SELECT report_id, {_campaign(_fill('"CampaignName"'))} AS campaign_name,
    {_job(_fill('"JobNumber"'))} AS job_number, {_strip(_fill('"OurRef"'))} AS our_ref,
    {_strip(_fill('"PropertyName"'))} AS property_name, {_strip(_fill('"LocationText"'))} AS location_text,
    {_strip(_fill('"SpecificationText"'))} AS specification_text,
    {_strip(_fill('"StartDate"'))} AS start_date_raw, {_ROW_ORDER}
  FROM raw
)"""

_PARENTS = f"""{_BOOKINGS},
parents AS (
  SELECT report_id, campaign_name, job_number, campaign_name || ' (' || job_number || ')' AS task_name
  FROM b WHERE campaign_name <> '' AND job_number <> '' GROUP BY ALL
)"""

_K = "report_id, campaign_name, job_number"


def _booking_date(interactive: bool) -> str:
    iso = "try_strptime(start_date_raw, '%Y-%m-%d')"
    if interactive:
        iso = "coalesce(try_strptime(start_date_raw, '%Y-%d-%m'), try_strptime(start_date_raw, '%Y-%m-%d'))"
    return f"CAST(coalesce({iso}, try_strptime(start_date_raw, '%d/%m/%Y')) AS DATE)"


def _source(interactive: bool = False) -> str:
    return f"""{_PARENTS},
source AS (
  SELECT {_K}, our_ref,
    {_strip("'(' || our_ref || ') ' || property_name || ' - ' || location_text || ': ' || specification_text")} AS subtask_name,
    start_date_raw, {_booking_date(interactive)} AS due, 'source' AS subtask_kind
  FROM (
    SELECT *, row_number() OVER (PARTITION BY {_K}, our_ref ORDER BY {_ROW_ORDER}) AS rn
    FROM b WHERE campaign_name <> '' AND job_number <> '' AND our_ref <> ''
  ) WHERE rn = 1
)"""


_CHILDREN = f"""{_source()},
earliest AS (SELECT {_K}, min(due) AS earliest FROM source GROUP BY {_K} HAVING min(due) IS NOT NULL),
control AS (
  SELECT {_K}, '' AS our_ref, 'chase creative' AS subtask_name, strftime(earliest, '%Y-%m-%d') AS start_date_raw,
    {_minus_weekdays('earliest', 4)} AS due, 'control' AS subtask_kind FROM earliest
  UNION ALL
  SELECT {_K}, '', 'Check live status', strftime(earliest, '%Y-%m-%d'), earliest + 2, 'control' FROM earliest
),
children AS (SELECT * FROM source UNION ALL SELECT * FROM control)"""

_TASKS = f"""
tasks AS (
  SELECT CAST(100 + o_custkey % 3 AS VARCHAR) AS project_gid,
    CASE WHEN o_orderkey % 35 = 0 THEN '' ELSE 'Done (' || (o_orderkey * 7) || ') v' || o_custkey END AS name
  FROM orders
)"""

# Jobs are digits here, so the runs of digits in the names hold every match; all their pieces
# are listed once and compared as whole texts.
_PIECES = f"""{_TASKS},
runs AS (SELECT DISTINCT project_gid, unnest(regexp_extract_all(name, '[0-9]+')) AS run FROM tasks),
starts AS (SELECT project_gid, run, unnest(range(1, length(run) + 1)) AS i FROM runs),
pieces AS (
  SELECT DISTINCT project_gid, substr(run, i, n) AS piece
  FROM (SELECT project_gid, run, i, unnest(range(1, length(run) - i + 2)) AS n FROM starts)
)"""
_EXISTING_ANYWHERE = f"""{_PIECES},
existing AS (
  SELECT DISTINCT p.job_number FROM (SELECT DISTINCT job_number FROM parents) p JOIN pieces ON piece = p.job_number
)"""
_EXISTING = f"""{_PIECES},
searched AS (
  SELECT DISTINCT 'r' || n AS report_id, unnest(CASE n % 4 WHEN 0 THEN ['100', '101'] WHEN 1 THEN ['101']
    WHEN 2 THEN ['102'] ELSE ['100', '101', '102'] END) AS project_gid
  FROM (SELECT DISTINCT c_custkey // 150 AS n FROM customer)
),
existing AS (
  SELECT DISTINCT p.report_id, p.job_number FROM (SELECT DISTINCT report_id, job_number FROM parents) p
    JOIN searched USING (report_id) JOIN pieces ON piece = p.job_number AND pieces.project_gid = searched.project_gid
)"""

_PARENT_RESULTS = f"""{_CHILDREN},{_EXISTING},
parent_rows AS (
  SELECT p.report_id, p.task_name, p.campaign_name, p.job_number,
    {_iso(_minus_weekdays('e.earliest', 4))} AS parent_due_on,
    CASE WHEN x.job_number IS NULL THEN '{S.WOULD_CREATE}' ELSE '{S.SKIP_EXISTS}' END AS status,
    CASE WHEN x.job_number IS NULL THEN '{S.REASON_NEW}' ELSE '{S.REASON_EXISTS}' END AS reason,
    '' AS parent_task_gid
  FROM parents p LEFT JOIN existing x ON x.job_number = p.job_number AND x.report_id = p.report_id
    LEFT JOIN earliest e ON e.report_id = p.report_id AND e.campaign_name = p.campaign_name AND e.job_number = p.job_number
)"""

_CHILD_BASE = f"""
    c.report_id, c.campaign_name, p.task_name AS parent_task_name, c.job_number AS parent_job_number,
    p.status AS parent_status, c.our_ref, c.subtask_name, {_iso('c.due')} AS subtask_due_on, c.start_date_raw,
    c.subtask_kind"""
_CHILD_JOIN = (
    "p.report_id = c.report_id AND p.campaign_name = c.campaign_name AND p.job_number = c.job_number"
)

_CHILD_RESULTS = f"""{_PARENT_RESULTS},
child_rows AS (
  SELECT {_CHILD_BASE},
    CASE WHEN p.status = '{S.SKIP_EXISTS}' THEN '{S.PARENT_SKIP_EXISTS}' ELSE '{S.WOULD_CREATE}' END AS subtask_status,
    '' AS subtask_gid, '{S.MESSAGE_DRY_RUN}' AS message
  FROM children c JOIN parent_rows p ON {_CHILD_JOIN}
)"""

_UNMATCHED = f"""
unmatched AS (
  SELECT report_id, '{S.UNMATCHED_ITEM}' AS item, n || ' rows missing ' || what AS reason FROM (
    SELECT report_id, 'CampaignName' AS what, count(*) AS n FROM b WHERE campaign_name = '' GROUP BY report_id
    UNION ALL
    SELECT report_id, 'JobNumber', count(*) FROM b WHERE campaign_name <> '' AND job_number = '' GROUP BY report_id
  )
)"""

_SUMMARY = f"""{_CHILD_RESULTS},{_UNMATCHED},
summary AS (
  SELECT r.report_id, r.n AS rows_parsed, p.n AS parent_candidates, p.w AS parent_would_create,
    p.s AS parent_skipped, CAST(0 AS BIGINT) AS parent_created, CAST(0 AS BIGINT) AS parent_errors,
    c.n AS subtask_rows, c.w AS subtask_would_create, CAST(0 AS BIGINT) AS subtask_created,
    CAST(0 AS BIGINT) AS subtask_errors, coalesce(u.n, 0) AS unmatched_items
  FROM (SELECT report_id, count(*) AS n FROM b GROUP BY report_id) r
  LEFT JOIN (SELECT report_id, count(*) AS n, count(*) FILTER (status = '{S.WOULD_CREATE}') AS w,
               count(*) FILTER (status = '{S.SKIP_EXISTS}') AS s FROM parent_rows GROUP BY report_id) p USING (report_id)
  LEFT JOIN (SELECT report_id, count(*) AS n, count(*) FILTER (subtask_status = '{S.WOULD_CREATE}') AS w
             FROM child_rows GROUP BY report_id) c USING (report_id)
  LEFT JOIN (SELECT report_id, count(*) AS n FROM unmatched GROUP BY report_id) u USING (report_id)
)"""

_MESSAGES = """
messages AS (
  SELECT 'u' || user_id AS inbox_id, event_id AS message_id, epoch_us(ts) // 1000 AS ms,
    'Booking Report - ' || event_type AS subject, event_type, value, ts
  FROM events
)"""
_SELECTED = f"""{_MESSAGES},
selected AS (
  SELECT * FROM messages
  WHERE message_id % 11 <> 0 AND message_id % 13 <> 0 AND event_type <> 'error' AND NOT value < 1
)"""
_NEWEST = f"""{_SELECTED},
newest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY inbox_id ORDER BY ms DESC, message_id) AS msg_rank FROM selected
  ) WHERE msg_rank <= {MAX_MESSAGES}
)"""
_LEAVES = """
nodes AS (
  SELECT event_id AS e, event_id * 10 AS part_id, CAST(NULL AS BIGINT) AS parent_id, 0 AS pos, '' AS filename, '' AS att_id FROM events
  UNION ALL SELECT event_id, event_id * 10 + 1, event_id * 10, 0, 'body.txt', '' FROM events
  UNION ALL SELECT event_id, event_id * 10 + 2, event_id * 10, 1, '', '' FROM events
  UNION ALL SELECT event_id, event_id * 10 + 3, event_id * 10 + 2, 0,
    CASE event_id % 5 WHEN 0 THEN 'a.tsv' WHEN 1 THEN 'a.PDF' ELSE 'a.csv' END, 'x' || event_id FROM events
  UNION ALL SELECT event_id, event_id * 10 + 4, event_id * 10 + 2, 1,
    CASE event_id % 3 WHEN 0 THEN 'B.XLSX' WHEN 1 THEN 'b.png' ELSE ' b.TSV ' END,
    CASE WHEN event_id % 7 = 0 THEN '' ELSE 'y' || event_id END FROM events
),
walk AS (
  SELECT e, part_id, filename, att_id, CAST([] AS INTEGER[]) AS path FROM nodes WHERE parent_id IS NULL
  UNION ALL
  SELECT n.e, n.part_id, n.filename, n.att_id, list_append(w.path, n.pos)
  FROM walk w JOIN nodes n ON n.e = w.e AND n.parent_id = w.part_id
),
leaves AS (
  SELECT w.* FROM walk w WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.e = w.e AND n.parent_id = w.part_id)
)"""
_USABLE = r"att_id <> '' AND regexp_matches(lower(trim(filename)), '\.(tsv|csv|xls|xlsx)$')"


def _received(ms: str) -> str:
    seconds = f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S')"
    fraction = f"CASE WHEN ({ms}) % 1000 = 0 THEN '' ELSE '.' || lpad(CAST(({ms}) % 1000 AS VARCHAR), 3, '0') || '000' END"
    return f"{seconds} || {fraction} || '+00:00'"


_ACK = f"""
ack AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS job_number, o_orderkey % 7 = 0 AS failed,
    CASE o_orderkey % 3 WHEN 0 THEN '{{"errors":[{{"message":"quota"}}]}}' WHEN 1 THEN '{{"errors":[]}}'
      ELSE '<html>bad gateway</html>' END AS body,
    CASE o_orderkey % 3 WHEN 0 THEN 'API error 429: quota' WHEN 1 THEN 'API error 429: {{"errors":[]}}'
      ELSE 'API error 429: <html>bad gateway</html>' END AS error,
    CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'g' || o_orderkey END AS gid
  FROM orders
)"""

_OUTCOMES = f"""{_PARENT_RESULTS},{_ACK},
outcome AS (
  SELECT p.report_id, p.task_name, p.campaign_name, p.job_number, p.parent_due_on,
    CASE WHEN p.status <> '{S.WOULD_CREATE}' OR a.job_number IS NULL THEN p.status
      WHEN a.failed THEN '{S.ERROR_PARENT_CREATE}' ELSE '{S.CREATED}' END AS status,
    CASE WHEN p.status <> '{S.WOULD_CREATE}' OR a.job_number IS NULL THEN p.reason
      WHEN a.failed THEN a.error ELSE '{S.REASON_CREATED}' END AS reason,
    CASE WHEN p.status = '{S.WOULD_CREATE}' AND NOT a.failed THEN a.gid ELSE '' END AS parent_task_gid
  FROM parent_rows p LEFT JOIN ack a ON a.job_number = p.job_number AND CAST(a.job_number AS BIGINT) % 13 <> 0
)"""

_CHILD_INTENTS = f"""{_OUTCOMES},
intents AS (
  SELECT c.{_K.replace(', ', ', c.')}, c.our_ref, c.subtask_name, p.parent_task_gid,
    '{{"name":' || to_json(c.subtask_name) || CASE WHEN c.due IS NULL THEN '' ELSE
      ',"due_on":"' || strftime(c.due, '%Y-%m-%d') || '"' END || '}}' AS payload
  FROM children c JOIN outcome p ON {_CHILD_JOIN}
  WHERE p.status = '{S.CREATED}' AND p.parent_task_gid <> ''
)"""

_FEEDS = """
feeds AS (
  SELECT DISTINCT 'r' || (c_custkey // 150) AS report_id, CAST(600 + c_custkey // 150 AS VARCHAR) AS project_gid,
    CASE WHEN c_custkey // 150 % 2 = 0 THEN '7' || (c_custkey // 150) ELSE '' END AS assignee
  FROM customer
)"""

_CONFIG = """
cfg AS (
  SELECT 'f' || c_custkey AS report_id,
    CASE c_custkey % 4 WHEN 0 THEN '100, ,101' WHEN 1 THEN '' WHEN 2 THEN '100,abc' ELSE ' 102 ' END AS ids,
    CASE c_custkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'YES' WHEN 2 THEN 'off' WHEN 3 THEN ' 1 ' ELSE 'True' END AS flag,
    CASE c_custkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN '-5' ELSE '40' END AS num,
    CASE WHEN c_custkey % 6 = 5 THEN '' ELSE CAST(900 + c_custkey % 3 AS VARCHAR) END AS target
  FROM customer
)"""
_IDS = "[trim(x) FOR x IN string_split(ids, ',') IF trim(x) <> '']"

_HEADERS = ", ".join(
    f"CASE WHEN o_orderkey % {i + 3} <> 0 "
    + (f"AND o_orderkey % 2 = 0 THEN NULL ELSE '{c}' END" if c == "OurRef" else f"THEN NULL ELSE '{c}' END")
    for i, c in enumerate(S.REQUIRED_COLUMNS)
)

_LABELS = f"""
labels_in AS (
  SELECT CAST(c_custkey AS VARCHAR) AS label_id,
    ' Label ' || (c_custkey % 97) || CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END AS name
  FROM customer
),
wanted AS (
  SELECT CASE WHEN o_custkey % 2 = 0 THEN 'LABEL ' ELSE 'label ' END || (o_custkey % 131) AS name FROM orders
)"""

_SHAPES = (
    "%Y-%m-%d", "%d/%m/%Y", "%-d/%-m/%y", "%m/%d/%Y", "%d-%b-%y", "%-d %B %Y", "%b %-d, %Y", "%Y/%m/%d",
    "%Y%m%d", "%b %Y", "%d.%m.%Y %H:%M", "%Y-%m-%dT%H:%M:%SZ",
)


def _due_on(interactive: bool) -> str:
    """What each shape means, worked out from the date itself rather than from its text.

    Day-first reading swaps day and month of a numeric date whose day is at most twelve, where
    the text has the month first; ship dates lie within fifty years of the pivot.
    """
    swapped = "CASE WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END"
    meaning = {i: "d" for i in range(len(_SHAPES))}
    for i in (3, 7, 11):
        meaning[i] = swapped
    meaning[9] = "make_date(year(d), month(d), 1)"
    if interactive:
        meaning[0] = swapped
    n = len(_SHAPES)
    raw = " ".join(f"WHEN {i} THEN strftime(d, '{shape}')" for i, shape in enumerate(_SHAPES))
    due = " ".join(f"WHEN {i} THEN {m}" for i, m in meaning.items())
    return f"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE k {raw} END AS raw, strftime(CASE k {due} END, '%Y-%m-%d') AS due_on
FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS d, (l_partkey + l_linenumber) % {n} AS k FROM lineitem)"""


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


_CHILD_COLUMNS = ", ".join(("report_id", "campaign_name", *S.CHILD_COLUMNS))
_DATED = f"SELECT {_K}, our_ref, subtask_name, start_date_raw, subtask_kind, {_iso('due')} AS subtask_due_on FROM "

_SUMMARY_TEXT = r"""
SELECT s.report_id,
  'Daily Trafficking Dry Run Summary' || chr(10) || chr(10)
  || 'Source email subject: ' || coalesce(m.subject, '') || chr(10)
  || 'Source email message id: ' || coalesce(CAST(m.message_id AS VARCHAR), '') || chr(10)
  || 'Source email received (UTC): ' || coalesce(m.received_at, '') || chr(10)
  || 'Source attachment: ' || coalesce('m' || m.message_id || '.tsv', '') || chr(10)
  || 'Mode: DRY_RUN' || chr(10)
  || 'Rows parsed: ' || rows_parsed || chr(10)
  || 'Parent candidates: ' || parent_candidates || chr(10)
  || 'Parent would create: ' || parent_would_create || chr(10)
  || 'Parent skipped existing: ' || parent_skipped || chr(10)
  || 'Parent created: ' || parent_created || chr(10)
  || 'Parent creation errors: ' || parent_errors || chr(10)
  || 'Subtask rows: ' || subtask_rows || chr(10)
  || 'Subtask would create: ' || subtask_would_create || chr(10)
  || 'Subtask created: ' || subtask_created || chr(10)
  || 'Subtask errors: ' || subtask_errors || chr(10)
  || 'Unmatched items: ' || unmatched_items || chr(10)
  || 'Dedupe projects checked: 100, 101, 102' || chr(10) AS text
FROM summary s LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY received_at DESC, message_id) AS rn FROM (
    SELECT 'r' || (CAST(substr(inbox_id, 2) AS BIGINT) // 150) AS report_id, subject, message_id, {received} AS received_at FROM messages
  )
) m ON m.report_id = s.report_id AND m.rn = 1"""


def all_oracles() -> dict[str, str]:
    raw = _with(_RAW, f"SELECT {_RAW_COLUMNS} FROM raw")
    filled = ", ".join(f'{_fill(chr(34) + c + chr(34))} AS "{c}"' for c in S.REQUIRED_COLUMNS if c not in ("OurRef", "PropertyName"))
    texts = "[" + ", ".join(f"'{t}'" for t in (*MISSING_TEXTS, *PRESENT_TEXTS)) + "]"
    place = f"(l_partkey + l_linenumber) % {len(MISSING_TEXTS) + len(PRESENT_TEXTS)} + 1"
    filled += f""", CASE WHEN {place} <= {len(MISSING_TEXTS)} THEN '' ELSE {texts}[{place}] END AS "PropertyName\""""
    marked = _RAW_COLUMNS.replace(
        '"PropertyName"',
        '"PropertyName" || CASE WHEN report_id < \'r4\' THEN chr(8364) ELSE chr(129) END || \'é\' AS "PropertyName"',
    )
    received = f"""CASE message_id % 10 WHEN 0 THEN '' WHEN 1 THEN ''
      WHEN 2 THEN {_received("ms // 1000 * 1000")} ELSE {_received("ms")} END"""
    existing = _with(f"{_PARENTS},{_EXISTING_ANYWHERE}", "SELECT job_number FROM existing")
    orders_back = {n: f"strftime({_minus_weekdays('d', n)}, '%Y-%m-%d') AS minus_{n}" for n in (0, 1, 4, 5, 11)}
    skipped = f"CASE WHEN p.status = '{S.SKIP_EXISTS}' THEN"
    ready = f"p.status = '{S.CREATED}' AND p.parent_task_gid <> ''"
    answered = f"""{_CHILD_INTENTS},
answers AS (
  SELECT *, n % 5 = 0 AS failed, CASE WHEN n % 7 = 0 THEN '' ELSE 'c' || our_ref END AS gid
  FROM (SELECT *, length(payload) + length(job_number) AS n FROM intents) WHERE n % 11 <> 0
)"""
    final = f"""SELECT {_CHILD_BASE},
  {skipped} '{S.PARENT_SKIP_EXISTS}' WHEN NOT ({ready}) THEN '{S.ERROR_PARENT_NOT_CREATED}'
    WHEN a.failed THEN '{S.ERROR_SUBTASK_CREATE}' WHEN a.failed IS NOT NULL THEN '{S.CREATED}' ELSE '{S.WOULD_CREATE}' END AS subtask_status,
  CASE WHEN {ready} AND NOT a.failed THEN a.gid ELSE '' END AS subtask_gid,
  {skipped} '{S.MESSAGE_SKIPPED}' WHEN NOT ({ready}) THEN '{S.MESSAGE_NO_PARENT}'
    WHEN a.failed THEN 'API error 500: down' WHEN a.failed IS NOT NULL THEN '{S.MESSAGE_CREATED}' ELSE '' END AS message
FROM children c JOIN outcome p ON {_CHILD_JOIN}
  LEFT JOIN answers a ON a.report_id = c.report_id AND a.campaign_name = c.campaign_name AND a.job_number = c.job_number
    AND a.our_ref = c.our_ref AND a.subtask_name = c.subtask_name"""
    return {
        "read_reports_tsv": raw,
        "read_reports_csv": raw,
        "skip_top_rows": raw,
        "clean_header": raw,
        "encoding_fallback": _with(_RAW, f"SELECT {marked} FROM raw"),
        "fill_missing": _with(
            _RAW, f"SELECT report_id, {filled}, CASE \"OurRef\" WHEN ' ' THEN '' ELSE \"OurRef\" END AS \"OurRef\" FROM raw"
        ),
        "missing_columns": f"""
SELECT report_id, array_to_string(missing, ', ') AS missing FROM (
  SELECT 'h' || o_orderkey AS report_id, [x FOR x IN [{_HEADERS}] IF x IS NOT NULL] AS missing FROM orders
) WHERE len(missing) > 0""",
        "rejected_reports": _with(
            _BOOKINGS,
            """SELECT 'h' || n AS report_id,
  CASE n % 7 WHEN 1 THEN 'missing_columns' WHEN 2 THEN 'no_rows' WHEN 3 THEN 'single_column' WHEN 4 THEN 'duplicate_columns'
    WHEN 5 THEN 'text_after_quote' WHEN 6 THEN 'row_longer_than_header'
    ELSE CASE WHEN c > 250 THEN 'too_many_candidates' ELSE 'ok' END END AS status,
  CASE WHEN n % 7 = 0 THEN lines ELSE 0 END AS data_lines, CASE WHEN n % 7 = 0 THEN c ELSE 0 END AS candidates,
  CASE WHEN n % 7 = 1 THEN 'OurRef, PropertyName, LocationText, SpecificationText, StartDate' ELSE '' END AS missing
FROM (
  SELECT o_custkey // 30 AS n, count(*) AS lines,
    count(DISTINCT CASE WHEN campaign_name <> '' AND job_number <> '' THEN campaign_name || '|' || job_number END) AS c
  FROM b JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
)""",
        ),
        "oversize_reports": _with(
            _PARENTS,
            f"SELECT report_id, count(*) AS candidates FROM parents GROUP BY report_id HAVING count(*) > {OVERSIZE}",
        ),
        "preview_topk": _with(
            _RAW,
            f"""SELECT row_no, {_RAW_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY {_ROW_ORDER}) AS row_no FROM raw
) WHERE row_no <= {PREVIEW_ROWS}""",
        ),
        "task_names_from_pages": _with(_TASKS, "SELECT project_gid, name FROM tasks WHERE name <> ''"),
        "candidate_messages": _with(_SELECTED, "SELECT inbox_id, message_id FROM selected"),
        "latest_n_messages": _with(_NEWEST, "SELECT inbox_id, message_id, msg_rank FROM newest"),
        "flatten_parts": "WITH RECURSIVE"
        + _LEAVES
        + " SELECT e AS message_id, part_id, array_to_string(path, '/') AS path FROM leaves",
        "attachment_filter": "WITH RECURSIVE"
        + _LEAVES
        + f" SELECT e AS message_id, part_id, trim(filename) AS filename FROM nodes WHERE {_USABLE}",
        "latest_attachment": "WITH RECURSIVE"
        + f"""{_LEAVES},{_NEWEST},
hits AS (
  SELECT n.*, trim(l.filename) AS filename, l.att_id,
    row_number() OVER (PARTITION BY n.inbox_id ORDER BY n.msg_rank, l.path DESC) AS rn
  FROM newest n JOIN leaves l ON l.e = n.message_id WHERE {_USABLE}
)
SELECT i.inbox_id,
  CASE WHEN h.inbox_id IS NOT NULL THEN 'found' WHEN i.inbox_id IN (SELECT inbox_id FROM selected)
    THEN 'no_supported_attachment' ELSE 'no_messages' END AS status,
  h.message_id, h.filename, h.att_id, h.subject, {_received("h.ms")} AS received_at
FROM (SELECT DISTINCT inbox_id FROM messages) i LEFT JOIN hits h ON h.inbox_id = i.inbox_id AND h.rn = 1""",
        "page_chain_status": """SELECT 'p' || g AS project_gid,
  CASE WHEN g % 4 = 3 THEN 'no_first_page' WHEN g % 4 = 1 AND n >= 5 THEN 'missing_page'
    WHEN g % 4 = 2 THEN CASE WHEN n = 1 THEN 'missing_page' ELSE 'cycle' END ELSE 'complete' END AS status,
  n - CASE WHEN g % 4 = 3 OR (g % 4 = 1 AND n >= 5) THEN 1 ELSE 0 END AS pages,
  CASE WHEN g % 4 = 3 THEN 0 WHEN g % 4 = 1 AND n >= 5 THEN 4 ELSE n END AS reached,
  CASE WHEN g % 4 = 1 AND n >= 5 THEN 'o5' WHEN g % 4 = 2 AND n = 1 THEN 'o2' ELSE '' END AS missing,
  CASE WHEN g % 4 = 3 THEN 0 WHEN g % 4 = 1 AND n >= 5 THEN 4 ELSE n END AS names
FROM (SELECT o_custkey // 100 AS g, count(*) AS n FROM orders GROUP BY ALL) WHERE NOT (g % 4 = 3 AND n = 1)""",
        "result_files": _with(
            f"{_CHILD_RESULTS},{_UNMATCHED}",
            f"""SELECT report_id, 'parent_task_results' AS "table", count(*) AS rows,
    CAST(sum(length(concat({', '.join(S.PARENT_COLUMNS)}))) AS BIGINT) AS characters FROM parent_rows GROUP BY report_id
UNION ALL
SELECT report_id, 'subtask_results', count(*), CAST(sum(length(concat({', '.join(S.CHILD_COLUMNS)}))) AS BIGINT) FROM child_rows GROUP BY report_id
UNION ALL
SELECT report_id, 'unmatched_items', count(u.item), CAST(coalesce(sum(length(concat(u.item, u.reason))), 0) AS BIGINT)
FROM (SELECT DISTINCT report_id FROM parent_rows) LEFT JOIN
  (SELECT * FROM unmatched WHERE CAST(substr(report_id, 2) AS BIGINT) % 4 <> 0) u USING (report_id) GROUP BY report_id""",
        ),
        "attachment_rows": _with(
            _MESSAGES,
            f"""SELECT inbox AS report_id, unnest(CASE WHEN e % 3 = 2 THEN ['Camp, "new"', 'Camp, "new"'] ELSE ['Camp'] END) AS "CampaignName",
  CAST(e AS VARCHAR) AS "JobNumber", '1' AS "OurRef", inbox AS "PropertyName",
  CASE WHEN e % 3 = 2 THEN 'L' ELSE '€ 5' END AS "LocationText",
  CASE WHEN e % 3 = 2 THEN 'two' || chr(10) || 'lines' ELSE 'S' END AS "SpecificationText", '2025-01-02' AS "StartDate"
FROM (
  SELECT inbox, e, row_number() OVER (PARTITION BY inbox ORDER BY n) AS first FROM (
    SELECT inbox_id, message_id AS e, row_number() OVER (PARTITION BY inbox_id ORDER BY ms DESC, message_id) AS n
    FROM messages WHERE message_id % 11 <> 0 AND message_id % 13 <> 0 AND event_type <> 'error'
  ) AS newest, (VALUES ('', 1), ('v ', 2)) AS copies(mark, k), LATERAL (SELECT mark || inbox_id AS inbox)
  WHERE n <= {MAX_MESSAGES} AND e % 5 <> 0
) WHERE first = 1""",
        ),
        "header_lookup": _with(_MESSAGES, "SELECT message_id, subject, '' AS reply_to FROM messages"),
        "received_at_iso": _with(_MESSAGES, f"SELECT message_id, {received} AS received_at FROM messages"),
        "payload_decode": "SELECT doc_id, text AS content FROM documents",
        "normalize_campaign": _with(
            _RAW, f'SELECT report_id, "CampaignName", {_campaign(chr(34) + "CampaignName" + chr(34))} AS campaign_name FROM raw'
        ),
        "normalize_job": _with(
            _RAW, f'SELECT report_id, "JobNumber", {_job(chr(34) + "JobNumber" + chr(34))} AS job_number FROM raw'
        ),
        "due_on_daily": _due_on(interactive=False),
        "due_on_interactive": _due_on(interactive=True),
        "subtract_weekdays": f"SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS day, {', '.join(orders_back.values())} "
        "FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)",
        "split_list": _with(_CONFIG, f"SELECT report_id, coalesce(array_to_string({_IDS}, '|'), '') AS ids FROM cfg"),
        "as_flag": _with(
            _CONFIG,
            """SELECT report_id, CASE WHEN trim(flag) = '' THEN true ELSE lower(trim(flag)) IN ('1', 'true', 'yes', 'y', 'on') END AS flag_on,
  lower(trim(flag)) IN ('1', 'true', 'yes', 'y', 'on') AS flag_off FROM cfg""",
        ),
        "invalid_ids": _with(
            _CONFIG,
            f"""SELECT report_id, coalesce(array_to_string([y FOR y IN {_IDS} IF NOT regexp_full_match(y, '[0-9]+')], ', '), '') AS invalid
FROM cfg""",
        ),
        "as_positive_int": _with(
            _CONFIG,
            "SELECT report_id, coalesce(greatest(1, TRY_CAST(num AS BIGINT)), 30) AS value FROM "
            "(SELECT report_id, CASE WHEN TRY_CAST(num AS BIGINT) IS NULL THEN '30' ELSE num END AS num FROM cfg)",
        ),
        "row_class": _with(
            _BOOKINGS,
            """SELECT report_id, CASE WHEN campaign_name = '' THEN 'missing_campaign' WHEN job_number = '' THEN 'missing_job' ELSE 'ok' END
  AS row_class, count(*) AS n FROM b GROUP BY 1, 2""",
        ),
        "parent_candidates": _with(_PARENTS, f"SELECT {_K}, task_name FROM parents ORDER BY ALL"),
        "unmatched_items": _with(f"{_BOOKINGS},{_UNMATCHED}", "SELECT report_id, item, reason FROM unmatched"),
        "source_children": _with(_source(), _DATED + "source"),
        "earliest_due": _with(_CHILDREN, f"SELECT {_K}, strftime(earliest, '%Y-%m-%d') AS earliest FROM earliest"),
        "control_children": _with(_CHILDREN, _DATED + "control"),
        "all_children": _with(_CHILDREN, _DATED + "children"),
        "parent_due": _with(_PARENT_RESULTS, f"SELECT {_K}, parent_due_on FROM parent_rows"),
        "jobs_to_check": _with(_PARENTS, "SELECT DISTINCT job_number FROM parents ORDER BY 1"),
        "existing_jobs": existing,
        "existing_jobs_kgram": existing,
        "existing_jobs_by_project": _with(f"{_PARENTS},{_EXISTING}", "SELECT report_id, job_number FROM existing"),
        "new_jobs": _with(
            f"{_PARENTS},{_EXISTING_ANYWHERE}",
            "SELECT DISTINCT job_number FROM parents WHERE job_number NOT IN (SELECT job_number FROM existing)",
        ),
        "parent_results": _with(_PARENT_RESULTS, "SELECT * FROM parent_rows"),
        "parent_results_interactive": _with(
            _PARENT_RESULTS,
            "SELECT report_id, task_name, campaign_name, job_number, status, reason, '600' AS target_project_gid FROM parent_rows",
        ),
        "child_results": _with(_CHILD_RESULTS, f"SELECT {_CHILD_COLUMNS} FROM child_rows"),
        "child_results_interactive": _with(
            f"{_source(interactive=True)},{_EXISTING}",
            f"""SELECT c.report_id, c.campaign_name, c.campaign_name || ' (' || c.job_number || ')' AS parent_task_name,
  c.job_number AS parent_job_number, CASE WHEN x.job_number IS NULL THEN '{S.WOULD_CREATE}' ELSE '{S.SKIP_EXISTS}' END AS parent_status,
  our_ref, subtask_name, {_iso('due')} AS subtask_due_on, start_date_raw,
  CASE WHEN x.job_number IS NULL THEN '{S.WOULD_CREATE}' ELSE '{S.PARENT_SKIP_EXISTS}' END AS subtask_status
FROM source c LEFT JOIN existing x ON x.job_number = c.job_number AND x.report_id = c.report_id""",
        ),
        "dedupe_projects": _with(
            _CONFIG,
            f"""SELECT report_id, CAST(i AS INTEGER) AS position, ids[i + 1] AS project_gid FROM (
  SELECT report_id, ids, unnest(range(len(ids))) AS i FROM (
    SELECT report_id, CASE WHEN len({_IDS}) > 0 THEN {_IDS} WHEN target <> '' THEN [target] ELSE [] END AS ids FROM cfg
  )
)""",
        ),
        "run_summary": _with(_SUMMARY, "SELECT * FROM summary"),
        "status_counts": _with(
            _CHILD_RESULTS,
            """SELECT report_id, 'parent' AS level, status, count(*) AS n FROM parent_rows GROUP BY ALL
UNION ALL SELECT report_id, 'child', subtask_status, count(*) FROM child_rows GROUP BY ALL""",
        ),
        "summary_text": _with(f"{_SUMMARY},{_MESSAGES}", _SUMMARY_TEXT.replace("{received}", _received("ms"))),
        "parent_intents": _with(
            f"{_PARENT_RESULTS},{_FEEDS}",
            f"""SELECT {_K}, '{{"workspace":"500","name":' || to_json(task_name) || ',"projects":["' || project_gid || '"]'
  || CASE WHEN assignee = '' THEN '' ELSE ',"assignee":"' || assignee || '"' END
  || CASE WHEN parent_due_on = '' THEN '' ELSE ',"due_on":"' || parent_due_on || '"' END || '}}' AS payload
FROM parent_rows JOIN feeds USING (report_id) WHERE status = '{S.WOULD_CREATE}'""",
        ),
        "parent_outcomes": _with(_OUTCOMES, "SELECT * FROM outcome"),
        "child_intents": _with(_CHILD_INTENTS, "SELECT * FROM intents"),
        "child_outcomes": _with(answered, final),
        "summary_text_live": _with(
            f"""{answered},
final AS ({final}),{_UNMATCHED},{_MESSAGES},
summary AS (
  SELECT r.report_id, r.n AS rows_parsed, p.n AS parent_candidates, p.w AS parent_would_create, p.s AS parent_skipped,
    p.c AS parent_created, p.e AS parent_errors, c.n AS subtask_rows, c.w AS subtask_would_create, c.c AS subtask_created,
    c.e AS subtask_errors, coalesce(u.n, 0) AS unmatched_items
  FROM (SELECT report_id, count(*) AS n FROM b GROUP BY report_id) r
  LEFT JOIN (SELECT report_id, count(*) AS n, count(*) FILTER (status = '{S.WOULD_CREATE}') AS w,
      count(*) FILTER (status = '{S.SKIP_EXISTS}') AS s, count(*) FILTER (status = '{S.CREATED}') AS c,
      count(*) FILTER (status = '{S.ERROR_PARENT_CREATE}') AS e FROM outcome GROUP BY report_id) p USING (report_id)
  LEFT JOIN (SELECT report_id, count(*) AS n, count(*) FILTER (subtask_status = '{S.WOULD_CREATE}') AS w,
      count(*) FILTER (subtask_status = '{S.CREATED}') AS c,
      count(*) FILTER (subtask_status IN ('{S.ERROR_PARENT_NOT_CREATED}', '{S.ERROR_SUBTASK_CREATE}')) AS e
    FROM final GROUP BY report_id) c USING (report_id)
  LEFT JOIN (SELECT report_id, count(*) AS n FROM unmatched GROUP BY report_id) u USING (report_id)
)""",
            _SUMMARY_TEXT.replace("{received}", _received("ms")).replace("Dry Run", "Live Create").replace("DRY_RUN", "LIVE_CREATE"),
        ),
        "ack_error_text": _with(_ACK, "SELECT job_number, error FROM ack WHERE failed"),
        "ack_unwrap": _with(
            _ACK, """SELECT job_number, '{"gid":"' || gid || '"}' AS data FROM ack WHERE NOT failed"""
        ),
        "write_results_csv": _with(
            _CHILD_RESULTS, f"SELECT report_id, {', '.join(S.CHILD_COLUMNS)} FROM child_rows"
        ),
        "write_intents_json": "",
        "unprocessed_reports": "SELECT 'h' || o_orderkey AS report_id FROM orders WHERE o_orderstatus <> 'F'",
        "label_upsert": _with(
            _LABELS,
            """SELECT label_id, name FROM labels_in UNION ALL
SELECT NULL, min(name) FROM wanted WHERE lower(name) NOT IN (SELECT lower(trim(name)) FROM labels_in) GROUP BY lower(name)""",
        ),
        "incremental_outcomes": _with(
            _CHILDREN,
            """SELECT campaign_name, lpad(job_number, 8, '0') AS job_number, n AS reports,
  CASE WHEN known THEN n ELSE n - 1 END AS skipped,
  CAST(NOT known AND answered AND k % 7 <> 0 AS BIGINT) AS created,
  CAST(NOT known AND answered AND k % 7 = 0 AS BIGINT) AS failed,
  CAST(NOT known AND NOT answered AS BIGINT) AS waiting,
  CASE WHEN NOT known AND answered AND k % 7 <> 0 AND k % 11 <> 0 THEN coalesce(c, 0) ELSE 0 END AS child_intents
FROM (
  SELECT *, CAST(job_number AS BIGINT) AS k, k % 14 = 0 AS known, k % 13 <> 0 AS answered,
    CAST(k % 5 <> 0 AS BIGINT) + CAST(k % 5 <> 0 AND k % 4 = 0 AS BIGINT) + CAST(k % 3 = 0 AS BIGINT) AS n
  FROM parents LEFT JOIN (SELECT campaign_name, job_number, count(*) AS c FROM children GROUP BY ALL) USING (campaign_name, job_number)
) WHERE n > 0""",
        ),
        "label_resolve": _with(
            _LABELS,
            """SELECT w.name, (SELECT min(label_id) FROM labels_in l WHERE lower(trim(l.name)) = lower(w.name)) AS label_id
FROM (SELECT DISTINCT name FROM wanted) w""",
        ),
    }


def oracles() -> dict[str, str]:
    found = all_oracles()
    found["write_intents_json"] = found["parent_intents"]
    return found
