"""The registered queries in DuckDB SQL, over the same tables.

Written apart from the Spark code: same meaning, other means. The test tables
become tickets through the named queries below, which follow the recipes of
``tickettide.adapters``. Column names, labels, the states that count as finished
and the wording of messages are fixed values.
"""

from __future__ import annotations

from tickettide.schema import DOMAINS

INCIDENT = """
incident AS (
    SELECT date_diff('day', DATE '1990-01-01', day) AS run_id, day AS snapshot_date,
           CAST(day AS TIMESTAMP) + INTERVAL 6 HOUR AS pulled_at,
           CAST(o_orderkey AS VARCHAR) AS sys_id,
           'INC' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS number,
           CASE WHEN o_orderkey % 43 <> 0 THEN CAST(o_orderdate AS VARCHAR) END AS opened_at,
           CASE WHEN o_orderkey % 53 <> 0 THEN CAST(o_orderdate AS VARCHAR) END AS sys_created_on,
           CAST(o_orderdate + to_days(k) AS VARCHAR) AS sys_updated_on,
           CASE WHEN o_orderkey % 31 = 0 THEN ''
                WHEN o_orderstatus = 'F' AND h // 2 <= 24 * k
                THEN CAST(o_orderdate + to_hours(h // 2) AS VARCHAR) END AS resolved_at,
           CASE WHEN o_orderstatus <> 'O' AND h <= 24 * k
                THEN CAST(o_orderdate + to_hours(h) AS VARCHAR)
                WHEN o_orderkey % 7 = 0 THEN '' END AS closed_at,
           CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE o_orderstatus END AS state,
           CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE o_orderpriority[1] END AS priority,
           CAST(1 + o_orderkey % 3 AS VARCHAR) AS severity,
           CAST(1 + o_custkey % 3 AS VARCHAR) AS impact,
           CAST(1 + (o_orderkey + o_custkey) % 3 AS VARCHAR) AS urgency,
           CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN ''
                ELSE c_mktsegment END AS category,
           o_orderpriority AS subcategory,
           'group ' || c_nationkey AS assignment_group,
           'agent ' || (o_custkey % 100) AS assigned_to,
           c_name AS caller_id,
           o_orderpriority || ' order of ' || c_name AS short_description
    FROM (SELECT o.*, c.*, k, CAST(o.o_orderdate AS DATE) + k AS day,
                 CAST((o_orderkey * 7919 + o_custkey) % 240 AS INTEGER) AS h
          FROM orders o LEFT JOIN customer c ON o_custkey = c_custkey
          CROSS JOIN (VALUES (0), (1), (7)) seen(k))
)"""

REQUEST_RUNS = """
request_runs AS (
    SELECT date_diff('day', DATE '1990-01-01', day) * 2 + l_suppkey % 2 AS run_id,
           day AS snapshot_date,
           CAST(day AS TIMESTAMP) + to_hours(CAST(6 + 6 * (l_suppkey % 2) AS INTEGER)) AS pulled_at,
           l_orderkey || '-' || l_linenumber AS sys_id,
           'RITM' || lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS number,
           CAST(l_orderkey AS VARCHAR) AS request,
           CAST(l_shipdate AS VARCHAR) AS opened_at,
           CAST(o_orderdate AS VARCHAR) AS sys_created_on,
           CAST(l_shipdate AS VARCHAR) AS sys_updated_on,
           CASE WHEN l_linestatus = 'F'
                THEN CAST(l_shipdate + to_days(CAST(l_partkey % 30 AS INTEGER)) AS VARCHAR)
           END AS closed_at,
           CASE WHEN l_suppkey % 41 = 0 THEN '' ELSE l_returnflag END AS state,
           CAST(1 + l_partkey % 4 AS VARCHAR) AS priority,
           CASE WHEN l_partkey % 31 = 0 THEN NULL WHEN l_partkey % 37 = 0 THEN ''
                ELSE p_type END AS cat_item,
           p_name || ' ' || CAST(l_quantity AS BIGINT) || ' '
               || CAST(round(l_extendedprice * 100) AS BIGINT) AS short_description,
           'group ' || (l_suppkey % 10) AS assignment_group,
           'agent ' || l_suppkey AS assigned_to,
           'customer ' || o_custkey AS requested_for
    FROM (SELECT l.*, o.*, p.*, CAST(o_orderdate AS DATE) AS day FROM lineitem l
          LEFT JOIN orders o ON l_orderkey = o_orderkey
          LEFT JOIN part p ON l_partkey = p_partkey)
)"""

CHANGE = """
change AS (
    SELECT date_diff('day', DATE '1990-01-01', day) AS run_id, day AS snapshot_date,
           CAST(day AS TIMESTAMP) + INTERVAL 6 HOUR AS pulled_at,
           CAST(event_id AS VARCHAR) AS sys_id,
           'CHG' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS number,
           moment AS opened_at, moment AS sys_created_on, moment AS sys_updated_on,
           moment AS start_date,
           strftime(ts + to_hours(CAST(user_id % 48 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS end_date,
           ['New', 'Scheduled', 'Closed', 'COMPLETE', 'Cancelled', 'canceled', '', NULL]
               [event_id % 8 + 1] AS state,
           CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN ''
                ELSE event_type END AS type,
           CAST(1 + user_id % 4 AS VARCHAR) AS risk,
           CAST(1 + event_id % 5 AS VARCHAR) AS priority,
           event_type AS category,
           'group ' || (user_id % 10) AS assignment_group,
           'agent ' || user_id AS assigned_to,
           props AS short_description
    FROM (SELECT *, CAST(ts AS DATE) AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment FROM events)
)"""

PROBLEM = """
problem AS (
    SELECT date_diff('day', DATE '1990-01-01', day) AS run_id, day AS snapshot_date,
           CAST(day AS TIMESTAMP) + INTERVAL 6 HOUR AS pulled_at,
           CAST(doc_id AS VARCHAR) AS sys_id,
           'PRB' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS number,
           day || ' 00:00:00' AS opened_at, day || ' 00:00:00' AS sys_created_on,
           CAST(CAST(day AS TIMESTAMP) + to_hours(CAST(n_chars % 24 AS INTEGER)) AS VARCHAR)
               AS sys_updated_on,
           CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN ''
                ELSE '2024-02-01 00:00:00' END AS closed_at,
           lang AS state,
           CAST(1 + doc_id % 5 AS VARCHAR) AS priority,
           CASE WHEN doc_id % 4 = 0 THEN 'true' ELSE 'false' END AS known_error,
           CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '' ELSE source END AS category,
           lang AS assignment_group,
           'agent ' || (doc_id % 20) AS assigned_to,
           text AS short_description
    FROM (SELECT *, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS day FROM documents)
)"""

CHANGE_LOG = """
change_log AS (
    SELECT CAST(user_id AS VARCHAR) AS sys_id,
           'EVT' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS number,
           '2024-01-01 00:00:00' AS opened_at, CAST(NULL AS VARCHAR) AS sys_created_on,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS sys_updated_on,
           CAST(NULL AS VARCHAR) AS resolved_at,
           CASE event_type WHEN 'purchase' THEN strftime(ts, '%Y-%m-%d') WHEN 'error' THEN '' END
               AS closed_at,
           event_type AS state, CAST(1 + event_id % 5 AS VARCHAR) AS priority,
           CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS VARCHAR) AS impact,
           CAST(NULL AS VARCHAR) AS urgency,
           CASE WHEN event_id % 9 <> 0 THEN 'group ' || (user_id % 7) END AS category,
           CAST(NULL AS VARCHAR) AS subcategory, CAST(NULL AS VARCHAR) AS assignment_group,
           CAST(NULL AS VARCHAR) AS assigned_to, CAST(NULL AS VARCHAR) AS caller_id,
           props AS short_description, ts
    FROM events
)"""

RUN_LOG = """
run_log AS (
    SELECT row_number() OVER (ORDER BY snapshot_date) AS id, snapshot_date,
           CAST(snapshot_date AS TIMESTAMP) + INTERVAL 6 HOUR AS pulled_at,
           CAST(30 AS BIGINT) AS since_days, incident_count, request_item_count,
           change_request_count, problem_count, 'success' AS status,
           'Pulled from ' || n || ' events' AS notes
    FROM (SELECT CAST(ts AS DATE) AS snapshot_date, count(*) AS n,
                 count(*) FILTER (event_type = 'error') AS incident_count,
                 count(*) FILTER (event_type = 'click') AS request_item_count,
                 count(*) FILTER (event_type = 'purchase') AS change_request_count,
                 count(*) FILTER (event_type = 'view') AS problem_count
          FROM events GROUP BY ALL)
)"""

MESSAGES = """
messages AS (
    SELECT ['Inbox', 'Reports', 'Archive'][conv_id % 3 + 1] AS folder,
           text AS subject, role AS sender,
           CASE WHEN (conv_id + turn) % 19 <> 0 THEN TIMESTAMP '2024-03-01'
                - to_hours(CAST((conv_id * 37 + turn) % 1440 AS INTEGER)) END AS received,
           CASE WHEN (conv_id + turn) % 23 <> 0 THEN list_filter(
                [[NULL, 'report.xlsx', 'Old.XLS', 'note.pdf', 'data.csv'][conv_id % 5 + 1],
                 CASE WHEN turn % 4 = 3 THEN 'sheet ' || conv_id || '.xlsx' END],
                lambda f: f IS NOT NULL) END AS attachments
    FROM conversations
),
staged AS (
    SELECT *, CASE WHEN received IS NULL THEN 1
                   WHEN received < TIMESTAMP '2024-03-01' - INTERVAL 30 DAY THEN 2
                   WHEN attachments IS NULL THEN 3
                   WHEN len(attachments) = 0 THEN 4
                   WHEN subject NOT ILIKE '%the %' THEN 5
                   ELSE 6 END AS stage
    FROM messages
),
files AS (
    SELECT unnest(attachments) AS filename, strftime(received, '%Y-%m-%d') AS received_at,
           sender AS target_table, hour(received) AS rows_loaded, received
    FROM messages WHERE received IS NOT NULL
),
logged AS (
    SELECT filename, received_at, 'loaded' AS target_table, count(*) AS rows_loaded,
           '2024-03-01 00:00:00' AS logged_at
    FROM files WHERE day(received) % 2 = 1 GROUP BY filename, received_at
)"""

STAMP = "run_id, snapshot_date, pulled_at"


def _fields(name: str) -> str:
    return ", ".join(DOMAINS[name].fields)


def _newest(name: str) -> str:
    """ORDER BY terms of the winning write."""
    lead = ["run_id", "sys_updated_on"]
    rest = [f for f in DOMAINS[name].fields if f not in (*lead, "sys_id")]
    return ", ".join(f"{c} DESC NULLS LAST" for c in lead + rest)


def _upserted(name: str, rows: str) -> str:
    return (
        f"SELECT {STAMP}, {_fields(name)} FROM {rows} QUALIFY row_number() OVER "
        f"(PARTITION BY snapshot_date, sys_id ORDER BY {_newest(name)}) = 1"
    )


REQUEST = f"{REQUEST_RUNS}, request AS ({_upserted('request_item', 'request_runs')})"


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _reviewed(name: str, rows: str, condition: str) -> str:
    """A later run of the same day for some tickets, which then wins."""
    both = (
        f"SELECT {STAMP}, {_fields(name)} FROM {rows} UNION ALL BY NAME "
        f"SELECT run_id + 1000000 AS run_id, snapshot_date, pulled_at + INTERVAL 6 HOUR AS pulled_at, "
        f"{_fields(name)} REPLACE_STATE FROM {rows} WHERE {condition}"
    ).replace(f"{_fields(name)} REPLACE_STATE", ", ".join(
        "'Reviewed' AS state" if f == "state" else f for f in DOMAINS[name].fields
    ))
    return f"runs AS ({both}) {_upserted(name, 'runs')}"


def _pulled(name: str, rows: str, as_of: str, since_days: int = 30) -> str:
    return f"""
    SELECT CAST(1 AS BIGINT) AS run_id, DATE '{as_of[:10]}' AS snapshot_date,
           TIMESTAMP '{as_of}' AS pulled_at, {_fields(name)}
    FROM {rows} WHERE sys_updated_on >= CAST(DATE '{as_of[:10]}' - {since_days} AS VARCHAR)"""


OPEN = "COALESCE(closed_at, '') = ''"
CATEGORY = "CASE WHEN category > '' THEN category ELSE 'Uncategorised' END"
STATE = "CASE WHEN state > '' THEN state ELSE 'Unknown' END"
ITEM = "CASE WHEN cat_item > '' THEN cat_item ELSE 'Unspecified Item' END"
PRIORITY = "CASE WHEN priority > '' THEN priority ELSE 'Unknown' END"
FINISHED = "lower(COALESCE(state, '')) IN ('closed', 'complete', 'completed', 'cancelled', 'canceled')"
ALLOWED = "COALESCE(MAP {'1': 4, '2': 8, '3': 24, '4': 72}[priority], 120)"
SECONDS = """date_diff('second', TRY_CAST(COALESCE(opened_at, sys_created_on) AS TIMESTAMP),
                       TRY_CAST(COALESCE(resolved_at, closed_at, sys_updated_on) AS TIMESTAMP))"""
STRICT_SECONDS = """date_diff('second', TRY_CAST(COALESCE(opened_at, sys_created_on) AS TIMESTAMP),
                       TRY_CAST(COALESCE(NULLIF(resolved_at, ''), NULLIF(closed_at, '')) AS TIMESTAMP))"""


def _tally(condition: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {condition}) AS {name}"


def _ratio(numerator: str, denominator: str, scale: int) -> str:
    """A quotient rounded half away from zero, in whole numbers."""
    return (
        f"CAST(sign({numerator}) * ((abs({numerator}) * {2 * scale} + ({denominator}))"
        f" // (2 * ({denominator}))) AS DOUBLE) / {scale}"
    )


def _timed(seconds: str = SECONDS, strict: bool = False) -> str:
    finished = (
        "COALESCE(NULLIF(resolved_at, ''), NULLIF(closed_at, ''))" if strict
        else "COALESCE(resolved_at, closed_at, sys_updated_on)"
    )
    return f"""timed AS (
        SELECT snapshot_date, {PRIORITY} AS priority, {seconds} AS seconds FROM incident
        WHERE COALESCE(opened_at, sys_created_on) IS NOT NULL AND {finished} IS NOT NULL
    )"""


def _sla(allowed: str = ALLOWED) -> str:
    mean = _ratio("sum(seconds)", "3600 * count(seconds)", 100)
    return f"""
        SELECT snapshot_date, priority, count(*) AS resolved_count,
               CASE WHEN count(seconds) > 0 THEN {mean} END AS avg_resolution_hours,
               {_tally(f"seconds > 3600 * {allowed}", "breached_count")}
        FROM timed GROUP BY snapshot_date, priority"""


def _latest(columns: str, rows: str, as_of: str) -> str:
    age = f"date_diff('second', TRY_CAST(COALESCE(opened_at, sys_created_on) AS TIMESTAMP), TIMESTAMP '{as_of}')"
    return f"""
        SELECT {columns}, snapshot_date AS last_snapshot_date, pulled_at AS last_pulled_at,
               {_ratio(age, "86400", 10)} AS age_days, CAST({OPEN} AS INTEGER) AS is_open
        FROM {rows} QUALIFY row_number() OVER
             (PARTITION BY sys_id ORDER BY snapshot_date DESC, pulled_at DESC) = 1"""


def _share(period: str) -> str:
    return f"""
        SELECT period_start, request_type, request_count, period_total,
               {_ratio("request_count", "period_total", 10000)} AS share
        FROM (SELECT CAST(date_trunc('{period}', snapshot_date) AS DATE) AS period_start,
                     {ITEM} AS request_type, count(*) AS request_count,
                     CAST(sum(count(*)) OVER (PARTITION BY date_trunc('{period}', snapshot_date))
                          AS BIGINT) AS period_total
              FROM request GROUP BY date_trunc('{period}', snapshot_date), {ITEM})"""


ORDERS_AS_OF = "2001-08-05 09:30:00"
EVENTS_AS_OF = "2024-01-31 09:30:00"
INCIDENT_LATEST = (
    "sys_id, number, state, priority, category, subcategory, assignment_group, assigned_to, "
    "opened_at, sys_updated_on, closed_at"
)
REQUEST_LATEST = (
    "sys_id, number, request, state, priority, cat_item, assignment_group, assigned_to, "
    "opened_at, sys_updated_on, closed_at"
)
PAGE = """
    SELECT sys_id, number, sys_updated_on, priority, type FROM change
    WHERE priority >= '3' AND type = 'error' ORDER BY sys_updated_on, sys_id LIMIT 100 OFFSET 50"""
BACKFILL = f"""
    days AS (SELECT CAST(d AS DATE) AS day FROM generate_series(
                 TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) s(d)),
    seen AS (
        SELECT day, change_log.* FROM days JOIN change_log ON sys_updated_on < CAST(day + 1 AS VARCHAR)
        QUALIFY row_number() OVER (PARTITION BY day, sys_id
                                   ORDER BY sys_updated_on DESC, number DESC) = 1
    ),
    pulls AS (
        SELECT date_diff('day', DATE '2024-01-01', day) + 1 AS run_id, day AS snapshot_date,
               day + TIME '23:59:59' AS pulled_at, {_fields('incident')}
        FROM seen WHERE sys_updated_on >= CAST(day - 7 AS VARCHAR)
    )"""
FILE_NAMES = r"""
file_names AS (
    SELECT CAST(p_partkey AS BIGINT) AS id,
           CASE p_partkey % 4 WHEN 0 THEN p_name || ' (' || p_brand || ').XLSX'
                WHEN 1 THEN 'in\' || p_type || '.' || p_size || '.xls'
                WHEN 2 THEN '.' || p_name ELSE '((' || p_size || '))..csv' END AS filename
    FROM part
    UNION ALL SELECT -1 - page_id, url FROM pages
),
split AS (
    SELECT id, ltrim(regexp_extract(filename, '([^/\\]*)[/\\]*$', 1), '.') AS base FROM file_names
)"""
ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _profile(table: str) -> str:
    return f"""
        SELECT '{table}' AS name, 'table' AS type,
               (SELECT string_agg(column_name, ', ' ORDER BY column_index) FROM duckdb_columns()
                WHERE table_name = '{table}') AS columns,
               (SELECT count(*) FROM {table}) AS row_count"""


def _counts(rows: str, name: str) -> str:
    return f"SELECT run_id, snapshot_date, pulled_at, '{name}' AS domain FROM {rows}"


NOTE = """'Pulled ' || incident_count || ' incidents and ' || request_item_count
    || ' request items; ' || change_request_count || ' change requests; '
    || problem_count || ' problems'"""
RUNS = f"""
    counted AS (
        SELECT run_id AS id, snapshot_date, pulled_at, CAST(30 AS BIGINT) AS since_days,
               {_tally("domain = 'incident'", "incident_count")},
               {_tally("domain = 'request_item'", "request_item_count")},
               {_tally("domain = 'change_request'", "change_request_count")},
               {_tally("domain = 'problem'", "problem_count")}
        FROM ({_counts("incident", "incident")} UNION ALL {_counts("request_runs", "request_item")}
              UNION ALL {_counts("change", "change_request")}
              UNION ALL {_counts("problem", "problem")})
        GROUP BY ALL
    )"""
WITHIN = "TRY_CAST(sys_updated_on AS TIMESTAMP) >= DATE '2024-01-31' - 11000"
ONE_RUN = f"""
    one_run AS (
        SELECT CAST(1 AS BIGINT) AS id, DATE '2024-01-31' AS snapshot_date,
               TIMESTAMP '{EVENTS_AS_OF}' AS pulled_at, CAST(11000 AS BIGINT) AS since_days,
               (SELECT count(*) FROM incident WHERE {WITHIN}) AS incident_count,
               (SELECT count(*) FROM request WHERE {WITHIN}) AS request_item_count,
               (SELECT count(*) FROM change WHERE {WITHIN}) AS change_request_count,
               (SELECT count(*) FROM problem WHERE {WITHIN}) AS problem_count
    )"""


def _statements() -> dict[str, str]:
    sql = {}
    inc, req, chg, prb = _with(INCIDENT), _with(REQUEST), _with(CHANGE), _with(PROBLEM)
    msg = _with(MESSAGES)

    # pulling
    sql["table_query"] = f"{chg} {PAGE}"
    sql["table_query_page"] = f"""{chg} SELECT count(*) AS count, 50 + count(*) AS next_offset,
        count(*) = 100 AS has_more FROM ({PAGE})"""
    sql["capped_fetch"] = f"""{inc} SELECT {STAMP}, {_fields('incident')} FROM incident
        ORDER BY sys_updated_on NULLS FIRST, sys_id LIMIT 5000"""
    sql["capped_fetch_newest"] = f"""{inc} SELECT {STAMP}, {_fields('incident')} FROM incident
        ORDER BY sys_updated_on DESC NULLS LAST, sys_id LIMIT 5000"""
    sql["pull_incident"] = inc + _pulled("incident", "incident", ORDERS_AS_OF)
    sql["pull_request_item"] = req + _pulled("request_item", "request", ORDERS_AS_OF)
    sql["pull_change_request"] = chg + _pulled("change_request", "change", EVENTS_AS_OF)
    sql["pull_problem"] = prb + _pulled("problem", "problem", EVENTS_AS_OF)
    sql["snapshot_backfill"] = f"{_with(CHANGE_LOG, BACKFILL)} SELECT * FROM pulls"
    sql["snapshot_backfill_capped"] = f"""{_with(CHANGE_LOG, BACKFILL)}
        SELECT snapshot_date, sys_id, sys_updated_on, state FROM pulls QUALIFY row_number() OVER
            (PARTITION BY snapshot_date ORDER BY sys_updated_on NULLS FIRST, sys_id) <= 100"""
    wide = """wide_log AS (SELECT * REPLACE (CAST(CAST(substr(number, 4) AS BIGINT) % 7000 AS VARCHAR) AS sys_id) FROM change_log)"""
    sql["snapshot_backfill_large_cap"] = f"""{_with(CHANGE_LOG, wide, BACKFILL.replace("change_log", "wide_log"))}
        SELECT snapshot_date, sys_id, sys_updated_on, state FROM pulls QUALIFY row_number() OVER
            (PARTITION BY snapshot_date ORDER BY sys_updated_on NULLS FIRST, sys_id) <= 1500"""
    sql["capped_fetch_bulk_update"] = f"""{inc} SELECT sys_id, number, '2001-01-01 00:00:00' AS sys_updated_on, state
        FROM incident WHERE snapshot_date = CAST(opened_at AS DATE) ORDER BY sys_id LIMIT 4000"""
    sql["received_records"] = """
        SELECT CAST(event_id AS VARCHAR) AS sys_id, event_type AS state, CAST(to_json({
            'sys_id': CAST(event_id AS VARCHAR), 'sys_updated_on': '2024-01-31 00:00:00',
            'state': {'display_value': upper(event_type), 'value': event_type}, 'extra': user_id}) AS VARCHAR) AS raw_payload
        FROM events"""
    sql["payload_explode"] = """
        SELECT CAST(event_id AS VARCHAR) AS sys_id, printf('INC%07d', event_id) AS number,
               event_type AS state, CASE WHEN user_id % 5 <> 0 THEN props END AS short_description,
               CAST(NULL AS VARCHAR) AS category FROM events"""

    # storing
    sql["upsert_incident"] = f"""{inc}, {_reviewed("incident", "incident", "priority IN ('1', '2')")}"""
    sql["upsert_request_item"] = f"{req} SELECT * FROM request"
    sql["upsert_change_request"] = f"""{chg}, {_reviewed("change_request", "change", "risk = '2'")}"""
    sql["upsert_problem"] = f"""{prb}, {_reviewed("problem", "problem", "known_error = 'true'")}"""
    sql["store_current"] = sql["upsert_change_request"]
    every = _with(INCIDENT, REQUEST, CHANGE, PROBLEM)
    sql["run_log"] = f"{every}, {RUNS} SELECT *, 'success' AS status, {NOTE} AS notes FROM counted"
    sql["sync_job"] = f"{every}, {ONE_RUN} SELECT *, 'success' AS status, {NOTE} AS notes FROM one_run"
    sql["sync_job_report"] = f"""{every}, {ONE_RUN} SELECT 'Sync succeeded: snapshot_date='
        || snapshot_date || ' incidents=' || incident_count || ' requests=' || request_item_count
        || ' changes=' || change_request_count || ' problems=' || problem_count AS report FROM one_run"""
    sql["append_aligned"] = """
        SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
        UNION ALL SELECT c_custkey, c_name, NULL, NULL FROM customer"""
    sql["append_load"] = sql["append_aligned"]
    sql["replace_load"] = "SELECT * FROM part"
    known = "EXISTS (SELECT 1 FROM logged l WHERE l.filename = f.filename AND l.received_at = f.received_at)"
    sql["already_ingested"] = f"{msg} SELECT f.* EXCLUDE (received) FROM files f WHERE {known}"
    sql["not_yet_ingested"] = f"{msg} SELECT f.* EXCLUDE (received) FROM files f WHERE NOT {known}"
    sql["record_ingest"] = f"""{msg} SELECT * FROM logged UNION ALL BY NAME
        SELECT filename, received_at, first.target_table, first.rows_loaded,
               '2024-03-01 00:00:00' AS logged_at
        FROM (SELECT filename, received_at, min(struct_pack(target_table, rows_loaded)) AS first
              FROM files f WHERE NOT {known} GROUP BY filename, received_at)"""
    sql["evolve_union"] = f"""{_with(RUN_LOG)} SELECT * FROM run_log UNION ALL BY NAME
        SELECT * REPLACE (CAST(0 AS BIGINT) AS change_request_count, CAST(0 AS BIGINT) AS problem_count,
                          CAST(NULL AS VARCHAR) AS notes) FROM run_log"""
    sql["raw_payload"] = f"""{prb} SELECT sys_id, snapshot_date,
        CAST(to_json(struct_pack({', '.join(f'{f} := {f}' for f in DOMAINS['problem'].fields)}))
             AS VARCHAR) AS raw_payload FROM problem"""

    # column functions
    sql["label_blanks"] = f"""{inc} SELECT snapshot_date, sys_id, {CATEGORY} AS category,
        {STATE} AS state, {PRIORITY} AS priority FROM incident"""
    sql["open_flag"] = f"""{inc} SELECT snapshot_date, sys_id, CAST({OPEN} AS INTEGER) AS is_open
        FROM incident"""
    age = f"""date_diff('second', TRY_CAST(COALESCE(opened_at, sys_created_on) AS TIMESTAMP),
                        TIMESTAMP '{ORDERS_AS_OF}')"""
    sql["age_days"] = f"""{inc} SELECT snapshot_date, sys_id, {_ratio(age, '86400', 10)} AS age_days
        FROM incident"""
    sql["resolution_hours"] = f"""{inc} SELECT snapshot_date, sys_id,
        {_ratio(SECONDS, '3600', 100)} AS resolution_hours,
        {_ratio(STRICT_SECONDS, '3600', 100)} AS strict_hours FROM incident"""
    sql["sla_limit"] = f"""{inc} SELECT snapshot_date, sys_id, {ALLOWED} AS limit_hours,
        CAST(COALESCE({SECONDS} > 3600 * {ALLOWED}, FALSE) AS INTEGER) AS breached FROM incident"""
    sql["terminal_state"] = f"""{chg} SELECT sys_id, state, CAST({FINISHED} AS INTEGER) AS is_terminal
        FROM change"""
    sql["clean_columns"] = """SELECT p_partkey AS part_key, p_name AS name, p_brand AS brand,
        p_type AS part_type, p_size AS size, p_retailprice AS "retail_price_$" FROM part"""
    sql["table_names"] = rf"""{_with(FILE_NAMES)} SELECT id, CASE WHEN name = '' THEN 'data' ELSE name END
        AS table_name FROM (SELECT id, trim(regexp_replace(lower(regexp_replace(base, '\.[^.]+$', '')),
                                   '[^a-z0-9]+', '_', 'g'), '_') AS name FROM split)"""
    sql["file_ext"] = rf"""{_with(FILE_NAMES)}
        SELECT id, lower(regexp_extract(base, '(\.[^.]+)$', 1)) AS extension FROM split"""
    sql["lenient_date"] = """SELECT o_orderkey,
        CASE WHEN o_orderkey % 8 IN (4, 5, 7) THEN CAST(o_orderdate AS DATE) END AS day,
        CASE o_orderkey % 8 WHEN 4 THEN CAST(o_orderdate AS DATE) + TIME '10:20:30'
             WHEN 5 THEN o_orderdate WHEN 7 THEN date_trunc('day', o_orderdate) END AS moment
        FROM orders"""
    sql["flatten_display"] = """SELECT event_id,
        [event_type, event_type, CAST(user_id AS VARCHAR), props][event_id % 4 + 1] AS state,
        [event_type, upper(event_type), NULL, props][event_id % 4 + 1] AS display_state
        FROM events"""

    # trends and reports
    trend = f"count(*) AS ticket_count, {_tally(OPEN, 'open_count')}, {_tally(f'NOT {OPEN}', 'closed_count')}"
    sql["incident_trends_daily"] = f"""{inc} SELECT snapshot_date, {CATEGORY} AS category,
        {STATE} AS state, ticket_count, open_count, closed_count
        FROM (SELECT snapshot_date, category, state, {trend} FROM incident
              GROUP BY snapshot_date, category, state)"""
    sql["incident_trends_merged"] = f"""{inc} SELECT snapshot_date, {CATEGORY} AS category,
        {STATE} AS state, {trend} FROM incident GROUP BY ALL"""
    sql["request_type_trends_daily"] = f"""{req} SELECT snapshot_date, request_type, {STATE} AS state,
        request_count, open_count, closed_count
        FROM (SELECT snapshot_date, {ITEM} AS request_type, state, count(*) AS request_count,
                     {_tally(OPEN, 'open_count')}, {_tally(f'NOT {OPEN}', 'closed_count')}
              FROM request GROUP BY ALL)"""
    sql["change_request_trends_daily"] = f"""{chg} SELECT snapshot_date, change_type, {STATE} AS state,
        change_count, open_count
        FROM (SELECT snapshot_date, CASE WHEN type > '' THEN type ELSE 'Unspecified Type' END AS change_type,
                     state, count(*) AS change_count, {_tally(f'NOT {FINISHED}', 'open_count')}
              FROM change GROUP BY ALL)"""
    sql["problem_trends_daily"] = f"""{prb} SELECT snapshot_date, {CATEGORY} AS category,
        {STATE} AS state, problem_count, open_count
        FROM (SELECT snapshot_date, category, state, count(*) AS problem_count,
                     {_tally(OPEN, 'open_count')}
              FROM problem GROUP BY snapshot_date, category, state)"""
    later = _reviewed("change_request", "change", "risk = '2' AND snapshot_date > DATE '2024-01-20'")
    sql["maintained_change_trends"] = f"""SELECT snapshot_date, change_type, {STATE} AS state, change_count, open_count
        FROM (SELECT snapshot_date, CASE WHEN type > '' THEN type ELSE 'Unspecified Type' END AS change_type,
                     state, count(*) AS change_count, {_tally(f'NOT {FINISHED}', 'open_count')}
              FROM ({chg}, {later}) GROUP BY ALL)"""
    sql["store_latest"] = f"""{chg}, seen AS (SELECT * FROM change UNION ALL BY NAME
            SELECT * REPLACE (run_id + 1000000 AS run_id, snapshot_date + 1 AS snapshot_date, pulled_at + INTERVAL 6 HOUR AS pulled_at,
                              'Reviewed' AS state) FROM change WHERE risk = '2')
        SELECT {STAMP}, {_fields('change_request')} FROM seen
        QUALIFY row_number() OVER (PARTITION BY sys_id ORDER BY snapshot_date DESC, run_id DESC) = 1"""
    sql["incident_daily_totals"] = f"""{inc} SELECT snapshot_date, count(*) AS total_incidents,
        {_tally(OPEN, 'open_incidents')} FROM incident GROUP BY ALL"""
    sql["incident_open_backlog"] = f"""{inc} SELECT snapshot_date, {CATEGORY} AS category,
        {_tally(OPEN, 'open_incidents')} FROM incident GROUP BY ALL"""
    sql["state_mix_daily"] = f"""{inc} SELECT snapshot_date, {STATE} AS state,
        count(*) AS ticket_count FROM incident GROUP BY ALL"""
    sql["request_daily_totals"] = f"""{req} SELECT snapshot_date, count(*) AS total_requests,
        {_tally(OPEN, 'open_requests')} FROM request GROUP BY ALL"""
    sql["request_type_daily"] = f"""{req} SELECT snapshot_date, {ITEM} AS request_type,
        count(*) AS total_requests FROM request GROUP BY ALL"""
    sql["change_daily_totals"] = f"""{chg} SELECT snapshot_date, count(*) AS total_changes,
        {_tally(f'NOT {FINISHED}', 'open_changes')} FROM change GROUP BY ALL"""
    sql["problem_daily_totals"] = f"""{prb} SELECT snapshot_date, count(*) AS total_problems,
        {_tally(OPEN, 'open_problems')} FROM problem GROUP BY ALL"""
    sql["incident_sla_daily"] = f"{inc}, {_timed()} {_sla()}"
    sql["incident_sla_strict"] = f"{inc}, {_timed(STRICT_SECONDS, strict=True)} {_sla()}"
    sql["sla_by_table"] = f"""{inc}, {_timed()}
        {_sla("CASE WHEN priority IN (SELECT o_orderpriority[1] FROM orders) "
              "THEN 12 * CAST(priority AS INTEGER) ELSE 120 END")}"""
    sql["sla_daily_totals"] = f"""{inc}, {_timed()} SELECT snapshot_date, count(*) AS resolved_count,
        {_tally(f"seconds > 3600 * {ALLOWED}", "breached_count")} FROM timed GROUP BY ALL"""
    sql["sla_by_priority"] = f"""{inc}, {_timed()} SELECT snapshot_date, priority,
        count(*) AS resolved, {_tally(f"seconds > 3600 * {ALLOWED}", "breached")}
        FROM timed GROUP BY ALL"""
    sql["request_share_weekly"] = req + _share("week")
    sql["request_share_monthly"] = req + _share("month")
    sql["incident_latest"] = inc + _latest(INCIDENT_LATEST, "incident", ORDERS_AS_OF)
    sql["request_item_latest"] = req + _latest(REQUEST_LATEST, "request", ORDERS_AS_OF)
    sql["preview"] = f"SELECT * FROM ({sql['incident_latest']}) ORDER BY sys_id LIMIT 100"
    sql["top_categories"] = f"""{inc} SELECT {CATEGORY} AS category, count(*) AS tickets
        FROM incident GROUP BY ALL ORDER BY tickets DESC, category LIMIT 15"""
    sql["top_request_types"] = f"""{req} SELECT {ITEM} AS request_type, count(*) AS requests
        FROM request GROUP BY ALL ORDER BY requests DESC, request_type LIMIT 15"""
    sql["run_summary"] = f"{_with(RUN_LOG)} SELECT * FROM run_log ORDER BY id DESC LIMIT 200"
    sql["catalog_profile"] = " UNION ALL ".join(
        f"SELECT 'listed_' || name AS name, 'view' AS type, columns, row_count FROM ({_profile(table)})"
        for table in ("region", "nation", "part"))
    sql["store_retry"] = f"""{_with(CHANGE)} SELECT CAST(1 AS BIGINT) AS run_id, DATE '2024-02-01' AS snapshot_date,
        TIMESTAMP '2024-02-01 09:30:00' AS pulled_at, sys_id, 'change_request' AS domain
        FROM change WHERE risk = '2' GROUP BY sys_id"""
    sql["fail_if_exists"] = "SELECT * FROM supplier"
    sql["object_profile"] = " UNION ALL ".join(_profile(table) for table in ALL_TABLES)

    # mails and files
    sql["folder_messages"] = f"""{msg} SELECT folder, sender, subject, received FROM messages
        WHERE folder ILIKE 'reports'"""
    for prefix, folder in (("", "Inbox"), ("folder_", "Reports")):
        sql[f"{prefix}attachment_scan"] = f"""{msg} SELECT * FROM (
            SELECT subject, sender, strftime(received, '%Y-%m-%d %H:%M:%S') AS received,
                   unnest(attachments) AS filename FROM staged WHERE stage = 6 AND folder = '{folder}')
            WHERE regexp_matches(lower(filename), '\\.xlsx?$')"""
        sql[f"{prefix}scan_diagnostics"] = f"""{msg}, attached AS (
            SELECT regexp_matches(lower(filename), '\\.xlsx?$') AS wanted
            FROM (SELECT unnest(attachments) AS filename FROM staged WHERE stage = 6 AND folder = '{folder}'))
            SELECT '{folder}' AS folder_name, '2024-01-31 00:00' AS date_from, '2024-03-01 00:00' AS date_to,
                   count(*) AS total_items, {_tally('stage = 1', 'skipped_non_mail')},
                   {_tally('stage = 2', 'skipped_too_old')}, {_tally('stage > 2', 'in_date_range')},
                   {_tally('stage = 4', 'skipped_no_attachment')},
                   {_tally('stage = 5', 'skipped_subject_filter')},
                   (SELECT count(*) FROM attached WHERE NOT wanted) AS skipped_non_excel,
                   (SELECT count(*) FROM attached WHERE wanted) AS excel_attachments_found,
                   {_tally('stage IN (1, 3)', 'error_count')}
            FROM staged WHERE folder = '{folder}'"""
        sql[f"{prefix}scan_errors"] = f"""{msg} SELECT subject, sender, CASE stage
            WHEN 1 THEN '[non-mail item] no received time'
            ELSE '[' || strftime(received, '%Y-%m-%d %H:%M:%S') || '] attachments could not be read' END
            AS error FROM staged WHERE stage IN (1, 3) AND folder = '{folder}'"""
    whole = "bool_and(TRY_CAST({0} AS BIGINT) IS NOT NULL AND CAST({0} AS VARCHAR) NOT LIKE '%.%')"
    number = "bool_and(TRY_CAST({0} AS DOUBLE) IS NOT NULL)"
    sql["workbook_types"] = " UNION ALL ".join(
        f"""SELECT '{name}' AS name, CASE WHEN {whole.format(column)} THEN 'bigint'
            WHEN {number.format(column)} THEN 'double' ELSE 'string' END AS type FROM customer"""
        for name, column in (("cust_key", "c_custkey"), ("name", "c_name"),
                             ("balance", "c_acctbal"), ("segment", "c_mktsegment")))
    sql["workbook_load"] = """
        SELECT 'customers-' || c_custkey // 200 || '.xlsx' AS path, c_custkey AS cust_key,
               c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer"""

    sql["workbook_files"] = sql["workbook_load"]
    sql["ingest_chain"] = """
        SELECT 'row' AS kind, CAST(c_custkey AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS n FROM customer
        UNION ALL SELECT 'file', 'customers-' || c_custkey // 200 || '.xlsx', count(*) FROM customer GROUP BY ALL
        UNION ALL SELECT 'failed', 'broken.xlsx', NULL"""

    # streams
    sql["stream_sync"] = f"""{_with(CHANGE_LOG)} SELECT CAST(1 + CAST(sys_id AS BIGINT) % 2 AS BIGINT) AS run_id,
        DATE '2024-01-31' AS snapshot_date, TIMESTAMP '{EVENTS_AS_OF}' AS pulled_at,
        {_fields('incident')} FROM change_log QUALIFY row_number() OVER
            (PARTITION BY sys_id ORDER BY sys_updated_on DESC, number DESC) = 1"""
    sql["stream_ingest_once"] = f"{msg} SELECT DISTINCT filename, received_at FROM files"
    sql["stream_hourly_trend"] = f"""{_with(CHANGE_LOG)} SELECT date_trunc('hour', ts) AS hour_start,
        {CATEGORY} AS category, {STATE} AS state, count(*) AS ticket_count,
        {_tally(OPEN, 'open_count')}, {_tally(f'NOT {OPEN}', 'closed_count')}
        FROM change_log GROUP BY ALL"""
    sql["stream_hourly_compacted"] = sql["stream_hourly_trend"]
    landed = " UNION ALL ".join(
        f"SELECT '{domain}' AS domain, sys_id, CAST(CASE WHEN right(sys_id, 1) IN ('1', '3', '5', '7', '9') THEN 2 ELSE 1 END AS BIGINT) AS run_id FROM {table}"
        for domain, table in (("incident", "incident"), ("request_item", "request"), ("change_request", "change"), ("problem", "problem")))
    per_run = ", ".join(f"count(*) FILTER (domain = '{domain}') AS {domain}_count" for domain in DOMAINS)
    sql["stream_sync_domains"] = f"""{every}, landed AS ({landed}), counted AS (
            SELECT run_id AS id, DATE '2024-01-31' AS snapshot_date, TIMESTAMP '{EVENTS_AS_OF}' AS pulled_at,
                   CAST(30 AS BIGINT) AS since_days, {per_run} FROM landed GROUP BY run_id)
        SELECT *, 'success' AS status, {NOTE} AS notes FROM counted"""
    sql["stream_sync_domains_stored"] = f"""{every}, landed AS ({landed})
        SELECT run_id, DATE '2024-01-31' AS snapshot_date, domain, count(DISTINCT sys_id) AS tickets, max(sys_id) AS last_ticket
        FROM landed GROUP BY run_id, domain"""
    return sql


STATEMENTS = _statements()
