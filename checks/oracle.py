"""The same queries as plain SQL over the given tables, for an independent engine.

Written from the rules, not from the Spark code: schedules are expanded week by
week, ranks are row numbers over sorted draws, deviations come from whole sums.
"""

from __future__ import annotations

from checks.queries import ITERATIONS

AS_OF = "TIMESTAMP '2001-08-01 00:00:00'"

# name -> (views it needs, body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, *needs: str, body: str) -> None:
    VIEWS[name] = (needs, body)


def sql(body: str, *needs: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    return f"WITH {parts}\n{body}"


view("v_projects", body="""
SELECT n_name AS project_key, r_name AS epic_key, n_name AS name, r_name AS project_type,
       CASE WHEN n_nationkey % 4 <> 0 THEN CAST(4 + n_nationkey % 8 AS DOUBLE) END AS capacity,
       n_nationkey AS config_order
FROM nation JOIN region ON n_regionkey = r_regionkey""")

view("v_all_projects", "v_projects", body="""
SELECT project_key, name, epic_key, capacity FROM v_projects
UNION ALL SELECT r_name, r_name, NULL, NULL FROM region""")

view("v_trans", body="""
SELECT l_orderkey AS issue_key, o_orderdate + CAST(l_quantity AS INT) * INTERVAL '1' HOUR AS ts,
       l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_suppkey % 10 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS author,
       CASE WHEN l_linenumber = 1 THEN '' ELSE 'To Do' END AS from_status,
       CASE l_linestatus || l_returnflag WHEN 'ON' THEN 'In Progress' WHEN 'OA' THEN 'In Development'
            WHEN 'OR' THEN 'To Do' WHEN 'FA' THEN 'Done' WHEN 'FN' THEN 'Awaiting Dev Deployment'
            WHEN 'FR' THEN 'Done' END AS to_status
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")

view("v_first", "v_trans", body="""
SELECT issue_key,
       min(ts) FILTER (WHERE to_status IN ('In Progress', 'In Development')) AS in_progress_ts,
       min(ts) FILTER (WHERE to_status IN ('Done', 'Awaiting Dev Deployment')) AS done_ts
FROM v_trans WHERE to_status <> 'To Do' GROUP BY issue_key""")

view("v_closed", "v_trans", body="""
SELECT issue_key, coalesce(author, '') AS closed_by FROM (
  SELECT issue_key, author,
         row_number() OVER (PARTITION BY issue_key ORDER BY ts, l_linenumber, l_partkey, l_suppkey) AS rn
  FROM v_trans WHERE to_status = 'Done') WHERE rn = 1""")

view("v_issues", body="""
SELECT o_orderkey AS issue_key, n_name AS project_key,
       CASE WHEN o_orderkey % 2 = 0 THEN r_name END AS epic_key, r_name AS parent_key,
       'Order ' || CAST(o_orderkey AS VARCHAR) AS summary,
       CASE WHEN o_orderstatus = 'F' THEN 'Done' WHEN o_orderstatus = 'P' THEN 'In Development'
            WHEN o_orderpriority = '5-LOW' THEN 'Canceled' ELSE 'To Do' END AS raw_status,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'kind:component' WHEN 'BUILDING' THEN 'kind:fix'
            WHEN 'FURNITURE' THEN 'kind:migration' WHEN 'MACHINERY' THEN 'kind:integration' END AS kind_label,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'size:S' WHEN '2-HIGH' THEN 'size:M'
            WHEN '3-MEDIUM' THEN 'size:L' WHEN '5-LOW' THEN 'size:XL' END AS size_label,
       c_name AS assignee, o_orderdate AS created,
       o_orderdate + CAST(o_orderkey % 50 AS INT) * INTERVAL '1' DAY AS updated,
       CASE WHEN o_orderkey % 5 = 0 THEN CAST(floor(o_totalprice / 10) AS BIGINT) ELSE 0 END AS time_spent_s,
       CASE WHEN o_orderkey % 11 = 0 THEN CAST(o_orderkey % 24 AS DOUBLE) END AS override_hours,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 8 AS DOUBLE) END AS story_points
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey""")


def item_view(name: str, source: str, first: str) -> None:
    view(name, source, first, body=f"""
SELECT project_key, issue_key AS item_id,
       CASE kind_label WHEN 'kind:component' THEN 'Component' WHEN 'kind:fix' THEN 'Fix'
            WHEN 'kind:migration' THEN 'Migration' WHEN 'kind:integration' THEN 'Integration'
            ELSE 'Unknown' END AS item_type,
       summary AS description, coalesce(substr(size_label, 6), 'M') AS size,
       CASE WHEN raw_status = 'In Development' THEN 'In Progress' ELSE raw_status END AS status,
       created, in_progress_ts, done_ts,
       CASE WHEN chosen = 0 AND time_spent_s > 0 THEN time_spent_s / 3600.0 ELSE chosen END AS cycle_hours,
       assignee, issue_key AS tracker_key, raw_status, story_points
FROM (SELECT i.*, f.in_progress_ts, f.done_ts,
             CASE WHEN override_hours > 0 THEN override_hours
                  ELSE coalesce((epoch_us(f.done_ts) - epoch_us(f.in_progress_ts)) / 3600000000.0, 0.0) END AS chosen
      FROM {source} i LEFT JOIN {first} f USING (issue_key))""")


item_view("v_items", "v_issues", "v_first")

# Samples: completed items with a positive cycle time, in whole milliseconds.
MEASURES = f"""
count(*) AS items, count(*) FILTER (WHERE status <> 'Canceled') AS total,
count(*) FILTER (WHERE status = 'Done') AS done,
count(*) FILTER (WHERE status = 'In Progress') AS in_progress,
count(*) FILTER (WHERE status NOT IN ('Done', 'Canceled', 'In Progress')) AS to_do,
count(*) FILTER (WHERE status = 'Canceled') AS canceled,
count(*) FILTER (WHERE status = 'Done' AND cycle_hours > 0) AS n,
coalesce(sum(ms) FILTER (WHERE status = 'Done' AND cycle_hours > 0), 0) AS sx,
coalesce(sum(ms * ms) FILTER (WHERE status = 'Done' AND cycle_hours > 0), 0) AS sxx,
coalesce(sum(ms) FILTER (WHERE cycle_hours > 0), 0) AS cost,
count(*) FILTER (WHERE done_ts > {AS_OF} - INTERVAL '14' DAY) AS recent_done,
min(created) AS started"""

view("v_ms", "v_items", body="""
SELECT *, CAST(floor(cycle_hours * 3600000.0 + 0.5) AS HUGEINT) AS ms FROM v_items""")

view("v_facts", "v_ms", body=f"""
SELECT *, CASE WHEN n > 0 THEN CAST(sx AS DOUBLE) / (n * 3600000.0) ELSE 0.0 END AS avg_cycle_hours,
       CASE WHEN total > 0 THEN done / total * 100 ELSE 0.0 END AS progress_pct,
       in_progress + to_do AS remaining, recent_done / 14.0 AS throughput_per_day
FROM (SELECT project_key, {MEASURES} FROM v_ms GROUP BY project_key)""")

view("v_sizes", "v_ms", body=f"""
SELECT project_key, size, n,
       CASE WHEN n > 0 THEN CAST(sx AS DOUBLE) / (n * 3600000.0) END AS mean,
       CASE WHEN n > 1 THEN sqrt(CAST(n * sxx - sx * sx AS DOUBLE) / (CAST(n AS DOUBLE) * (n - 1))) / 3600000.0
            WHEN n = 1 THEN 0.0 END AS stddev,
       in_progress + to_do AS remaining
FROM (SELECT project_key, size, {MEASURES} FROM v_ms GROUP BY project_key, size)""")

view("v_dist", "v_sizes", body="""
SELECT project_key, size, remaining, n > 0 AS is_observed,
       CASE WHEN n > 0 THEN mean WHEN size = 'S' THEN 1.5 WHEN size = 'M' THEN 4.0 WHEN size = 'L' THEN 8.0
            WHEN size = 'XL' THEN 16.0 ELSE 4.0 END AS mean,
       CASE WHEN n > 0 THEN stddev WHEN size = 'S' THEN 0.5 WHEN size = 'M' THEN 1.5 WHEN size = 'L' THEN 2.5
            WHEN size = 'XL' THEN 5.0 ELSE 2.0 END AS stddev
FROM v_sizes""")


def scramble(source: str, keep: str) -> str:
    """Three queries that scramble the 32-bit words a and b of ``source``."""
    out = f"SELECT {keep}, xor(a, a >> 16) AS a, xor(b, b >> 16) AS b FROM {source}"
    out = f"SELECT {keep}, (a * 569420461) & 4294967295 AS a, (b * 569420461) & 4294967295 AS b FROM ({out})"
    out = f"SELECT {keep}, xor(a, a >> 15) AS a, xor(b, b >> 15) AS b FROM ({out})"
    out = f"SELECT {keep}, (a * 695872825) & 4294967295 AS a, (b * 695872825) & 4294967295 AS b FROM ({out})"
    return f"SELECT {keep}, xor(a, a >> 15) AS a, xor(b, b >> 15) AS b FROM ({out})"


_lane = "project_key, remaining, mean, stddev, iteration"


def draw_views(tag: str, iterations: int) -> None:
    """Sums of drawn work per project and iteration, pair by pair of items."""
    view(f"v_lane{tag}", "v_dist", body=f"""
SELECT project_key, remaining, mean, stddev, iteration,
       (a + iteration * 2654435761) & 4294967295 AS a, (b + iteration * 2654435761) & 4294967295 AS b
FROM (SELECT *, CAST('0x' || substr(md5('42|' || project_key || '|' || size), 1, 8) AS BIGINT) AS a,
                CAST('0x' || substr(md5('42|' || project_key || '|' || size), 9, 8) AS BIGINT) AS b
      FROM v_dist WHERE remaining > 0), range(0, {iterations}) AS t(iteration)""")
    view(f"v_lane2{tag}", f"v_lane{tag}", body=scramble(f"v_lane{tag}", _lane))
    # Pairs of items by chunks of 20000 pairs.
    view(f"v_pair{tag}", f"v_lane2{tag}", body=f"""
SELECT {_lane}, p, (a + (p // 20000) * 2246822519) & 4294967295 AS a,
       (b + (p // 20000) * 2246822519) & 4294967295 AS b
FROM v_lane2{tag}, unnest(range(0, (remaining + 1) // 2)) AS t(p)""")
    view(f"v_pair2{tag}", f"v_pair{tag}", body=scramble(f"v_pair{tag}", _lane + ", p"))
    view(f"v_pair3{tag}", f"v_pair2{tag}", body=f"""
SELECT {_lane}, p, (a + (p % 20000) * 3266489917) & 4294967295 AS a,
       (b + (p % 20000) * 668265263) & 4294967295 AS b FROM v_pair2{tag}""")
    view(f"v_pair4{tag}", f"v_pair3{tag}", body=scramble(f"v_pair3{tag}", _lane + ", p"))
    view(f"v_totals{tag}", f"v_pair4{tag}", body=f"""
SELECT project_key, iteration,
       CAST(sum(CAST(floor(greatest(0.5, mean + stddev * (r * cos(t))) * 3600000.0 + 0.5) AS BIGINT)
         + CASE WHEN 2 * p + 1 < remaining
                THEN CAST(floor(greatest(0.5, mean + stddev * (r * sin(t))) * 3600000.0 + 0.5) AS BIGINT)
                ELSE 0 END) AS BIGINT) AS total_ms
FROM (SELECT *, sqrt(-2.0 * ln((a + 0.5) / 4294967296.0)) AS r,
             6.283185307179586 * ((b + 0.5) / 4294967296.0) AS t FROM v_pair4{tag})
GROUP BY project_key, iteration""")


def quantile_view(name: str, tag: str, iterations: int, compat: bool = False) -> None:
    rank = f"CAST(ceil({iterations} * pct / 100.0) AS BIGINT)"
    if compat:
        rank = f"least({rank} + 1, {iterations})"
    view(name, f"v_totals{tag}", "v_projects", body=f"""
SELECT c.project_key, c.pct, coalesce(total_ms / (3600000.0 * c.capacity), 0.0) AS days
FROM (SELECT project_key, coalesce(capacity, 8.0) AS capacity, pct,
             {rank} AS rank FROM v_projects, (VALUES (50), (70), (85), (95)) AS l(pct)) c
LEFT JOIN (SELECT project_key, total_ms,
                  row_number() OVER (PARTITION BY project_key ORDER BY total_ms, iteration) AS rank
           FROM v_totals{tag}) t ON t.project_key = c.project_key AND t.rank = c.rank""")


draw_views("", ITERATIONS)
quantile_view("v_quant", "", ITERATIONS)
quantile_view("v_quant_compat", "", ITERATIONS, compat=True)

view("v_wide", "v_quant", body="""
SELECT project_key, max(days) FILTER (WHERE pct = 50) AS p50, max(days) FILTER (WHERE pct = 70) AS p70,
       max(days) FILTER (WHERE pct = 85) AS p85, max(days) FILTER (WHERE pct = 95) AS p95
FROM v_quant GROUP BY project_key""")

view("v_plans", "v_facts", "v_projects", body="""
SELECT *, CASE WHEN avg_cycle_hours > 0 THEN greatest(CAST(floor(total * avg_cycle_hours / capacity / 5) AS BIGINT), 1)
               ELSE 12 END AS weeks
FROM (SELECT f.*, coalesce(p.capacity, 8.0) AS capacity FROM v_facts f JOIN v_projects p USING (project_key))""")

view("v_schedule", "v_plans", body="""
SELECT project_key, total, done, weeks, week, CAST((total * week) // weeks AS BIGINT) AS pv
FROM v_plans, unnest(range(1, weeks + 1)) AS t(week)""")


def eva_view(name: str, after_end: str) -> None:
    view(name, "v_plans", "v_schedule", body=f"""
SELECT project_key, weeks AS planned_weeks, week, pv, ev, ac, sv, cv, spi, cpi,
       CASE WHEN sv > 0 THEN 'ahead' WHEN sv < 0 THEN 'behind' ELSE 'on' END AS sv_band,
       CASE WHEN spi >= 1 THEN 'kept' WHEN spi >= 0.9 THEN 'slipping'
            WHEN spi >= 0.8 THEN 'late'
            ELSE 'far-off' END AS spi_band,
       CASE WHEN spi = 0 THEN 0 ELSE CAST(trunc(weeks / spi) AS BIGINT) END AS completion_week
FROM (SELECT *, ev - pv AS sv, ev - ac AS cv, CASE WHEN pv > 0 THEN ev / pv ELSE 0.0 END AS spi,
             CASE WHEN ac > 0 THEN ev / ac ELSE 0.0 END AS cpi
      FROM (SELECT p.project_key, p.weeks, p.week, coalesce(s.pv, {after_end}) AS pv, p.done AS ev,
                   CAST(p.cost AS DOUBLE) / 3600000.0 AS ac
            FROM (SELECT *, (epoch_us({AS_OF}) - epoch_us(started)) // 604800000000 + 1 AS week FROM v_plans) p
            LEFT JOIN v_schedule s ON s.project_key = p.project_key AND s.week = p.week))""")


eva_view("v_eva", "p.total")
eva_view("v_eva_zero", "0")

view("v_missing", "v_items", "v_closed", body="""
SELECT i.project_key, i.item_id AS issue_key, i.description AS summary, i.story_points,
       coalesce(nullif(c.closed_by, ''), '(unknown)') AS closed_by
FROM v_items i LEFT JOIN v_closed c ON c.issue_key = i.item_id
WHERE i.raw_status = 'Done' AND i.cycle_hours = 0""")

view("v_refitems", body="""
SELECT l_suppkey AS project_id, l_returnflag AS item_type, l_linestatus AS size,
       CAST(floor(l_quantity * 3600000.0 + 0.5) AS HUGEINT) AS ms FROM lineitem""")
view("v_refprojects", body="""
SELECT s_suppkey AS project_id, r_name AS type FROM supplier
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

POPULATION = "sqrt(CAST({n} * sum(ms * ms) - sum(ms) * sum(ms) AS DOUBLE) / (CAST({n} AS DOUBLE) * {n})) / 3600000.0"

view("v_history", body="""
SELECT project_key, ts, total, completed, total - completed AS remaining, top / 10000 AS avg_cycle,
       completed / 7.0 AS throughput, price / 100000.0 AS p70, price / 100000.0 * 1.25 AS p85,
       price / 100000.0 * 1.5 AS p95
FROM (SELECT n_name AS project_key, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, count(*) AS total,
             count(*) FILTER (WHERE o_orderstatus = 'F') AS completed,
             CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS price, max(o_totalprice) AS top
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)""")
view("v_kept", "v_history", body="""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY ts DESC) AS rn FROM v_history)
WHERE rn <= 100""")


def recent_view(name: str, days: int) -> None:
    view(name, "v_history", body=f"""
SELECT *, CASE WHEN total > 0 THEN completed / total * 100 ELSE 0.0 END AS progress_pct,
       row_number() OVER (PARTITION BY project_key ORDER BY ts) AS first_rn,
       row_number() OVER (PARTITION BY project_key ORDER BY ts DESC) AS last_rn,
       count(*) OVER (PARTITION BY project_key) AS entries
FROM v_history WHERE ts > {AS_OF} - INTERVAL '{days}' DAY""")


recent_view("v_recent", 30)
recent_view("v_last_week", 7)
view("v_drift", "v_last_week", body="""
SELECT a.project_key, b.p85 - a.p85 AS p85_drift FROM v_last_week a JOIN v_last_week b USING (project_key)
WHERE a.first_rn = 1 AND b.last_rn = 1 AND a.entries >= 2""")

view("v_tasks", body="""
SELECT p_partkey AS key, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 9 END AS tracker_key, p_name AS summary,
       CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS type,
       CASE p_partkey % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'M' WHEN 2 THEN 'L' ELSE 'XL' END AS size,
       CASE p_partkey % 10 WHEN 0 THEN 'todo' WHEN 1 THEN 'To Do' WHEN 2 THEN ' to_do ' WHEN 3 THEN ''
            WHEN 4 THEN 'in_progress' WHEN 5 THEN 'In Progress' WHEN 6 THEN 'done' WHEN 7 THEN 'completed'
            WHEN 8 THEN 'blocked' ELSE 'Custom' END AS status,
       CASE WHEN p_partkey % 10 <= 3 THEN 'To Do' WHEN p_partkey % 10 <= 5 THEN 'In Progress'
            WHEN p_partkey % 10 <= 7 THEN 'Done' WHEN p_partkey % 10 = 8 THEN 'Blocked' ELSE 'Custom' END AS norm,
       CASE WHEN p_partkey % 97 <> 0 THEN make_timestamp(2001, 1, 1 + p_partkey % 28, 0, 0, 0.0) END AS created,
       CASE WHEN p_partkey % 4 <> 0 THEN make_timestamp(2001, 2, 1 + (p_partkey + 3) % 28, 0, 0, 0.0) END AS in_progress_ts,
       CASE WHEN p_partkey % 5 <> 0 THEN make_timestamp(2001, 3, 1 + (p_partkey + 11) % 28, 0, 0, 0.0) END AS done_ts,
       p_size, p_brand
FROM part""")
view("v_task_items", "v_tasks", body="""
SELECT key AS item_id, type AS item_type, summary AS description, size, norm AS status, created, in_progress_ts, done_ts,
       p_brand AS assignee, tracker_key, coalesce((epoch_us(done_ts) - epoch_us(in_progress_ts)) / 3600000000.0, 0.0) AS cycle_hours FROM v_tasks""")

view("v_changes", body="""
SELECT user_id AS issue_key, 'PROJECT_' || CAST(user_id % 25 AS VARCHAR) AS project_key, ts, event_id,
       CASE event_type WHEN 'signup' THEN 'To Do' WHEN 'view' THEN 'In Progress' WHEN 'click' THEN 'In Development'
            WHEN 'purchase' THEN 'Done' WHEN 'error' THEN 'Canceled' END AS to_status FROM events""")

ITEM_COLUMNS = (
    "project_key, item_id, item_type, description, size, status, created, in_progress_ts, done_ts, "
    "cycle_hours, assignee, tracker_key"
)
STORED_COLUMNS = ITEM_COLUMNS.replace("item_id,", "CAST(item_id AS VARCHAR) AS item_id,").replace(
    "tracker_key", "CAST(tracker_key AS VARCHAR) AS tracker_key")
HISTORY_COLUMNS = "project_key, ts, total, completed, remaining, avg_cycle, throughput, p70, p85, p95"
HEALTH = """CASE WHEN progress_pct >= 90 THEN 'ahead' WHEN progress_pct >= 50 AND p85 <= 60 THEN 'on-track'
WHEN progress_pct < 25 OR p85 > 90 THEN 'behind' ELSE 'at-risk' END"""
AS_DAY = f"CAST({AS_OF} AS DATE)"


def day(column: str) -> str:
    return f"{AS_DAY} + CAST(trunc({column}) AS INT)"


view("v_compare", "v_facts", "v_wide", "v_drift", body=f"""
SELECT project_key, project_key AS name, total, done, remaining, progress_pct, avg_cycle_hours,
       throughput_per_day, p70, p85, p95, CASE WHEN n > 0 THEN {day("p85")} END AS target_date_85,
       {HEALTH} AS health, p85_drift
FROM (SELECT f.*, CASE WHEN n > 0 THEN w.p70 ELSE 0.0 END AS p70, CASE WHEN n > 0 THEN w.p85 ELSE 0.0 END AS p85,
             CASE WHEN n > 0 THEN w.p95 ELSE 0.0 END AS p95, coalesce(p85_drift, 0.0) AS p85_drift
      FROM v_facts f JOIN v_wide w USING (project_key) LEFT JOIN v_drift USING (project_key))""")

view("v_dashboard", "v_facts", "v_projects", body=f"""
SELECT p.project_key, p.name, total, done, in_progress, to_do, progress_pct, avg_cycle_hours,
       CASE WHEN ok THEN {day("to_do * per_item * 1.3")} END AS target_70,
       CASE WHEN ok THEN {day("to_do * per_item * 1.8")} END AS target_95
FROM v_projects p JOIN (
  SELECT f.*, done > 0 AND to_do > 0 AND avg_cycle_hours > 0 AS ok,
         avg_cycle_hours / coalesce(capacity, 8.0) AS per_item
  FROM v_facts f JOIN v_projects USING (project_key)) f USING (project_key)""")

view("v_run", "v_facts", "v_quant", body=f"""
SELECT project_key, project_key AS name, total, done AS completed, remaining, avg_cycle_hours, throughput_per_day,
       pct, days, {day("days")} AS target_date
FROM v_facts JOIN v_quant USING (project_key) WHERE n > 0""")

ORACLE: dict[str, str] = {
    "items_scan": sql(f"SELECT {STORED_COLUMNS} FROM v_items", "v_items"),
    "item_files": sql(f"""
SELECT {STORED_COLUMNS}, FALSE AS asked FROM v_items
UNION ALL SELECT {STORED_COLUMNS}, TRUE FROM v_items WHERE project_key IN ('NATION_3', 'NATION_11', 'NATION_7')""", "v_items"),
    "items_replaced": sql(f"""
SELECT {STORED_COLUMNS} FROM v_items
WHERE right(project_key, 1) NOT IN ('0', '2', '4', '6', '8') OR (status = 'Done' AND size = 'M')""", "v_items"),
    "projects_with_data": sql("SELECT DISTINCT project_key FROM v_items", "v_items"),
    "issues_scan": sql("""
SELECT project_key, project_key || '-' || CAST(issue_key AS VARCHAR) AS issue_key, epic_key, parent_key, summary, raw_status,
       'Story' AS issue_type, concat_ws(',', kind_label, 'team', size_label) AS labels, assignee, created, updated,
       time_spent_s, override_hours, story_points FROM v_issues""", "v_issues"),
    "issue_rejects": sql("""
SELECT 'page' AS level, NULL AS issue_key, 'not JSON' AS reason, '{"issues":[{"key":"BROKEN-' || CAST(r_regionkey AS VARCHAR) AS record FROM region
UNION ALL SELECT 'issue', NULL, 'no key', '{"summary":"no key ' || CAST(r_regionkey AS VARCHAR) || '"}' FROM region
UNION ALL SELECT DISTINCT 'change', project_key || '-' || CAST(issue_key AS VARCHAR), 'time not readable', 'yesterday Done'
FROM v_issues JOIN v_trans USING (issue_key) WHERE issue_key % 13 = 0""", "v_issues", "v_trans"),
    "links_flat": sql("""
SELECT project_key || '-' || CAST(issue_key AS VARCHAR) AS issue_key, 'L' || CAST(issue_key AS VARCHAR) AS link_id,
       'Blocks' AS link_type, CASE WHEN issue_key % 3 = 2 THEN 'blocks' ELSE 'is blocked by' END AS verb,
       project_key || '-' || CAST(issue_key + issue_key % 3 AS VARCHAR) AS target_key,
       'Open ' || CAST((issue_key + issue_key % 3) % 4 AS VARCHAR) AS target_status,
       'Order ' || CAST(issue_key + issue_key % 3 AS VARCHAR) AS target_summary
FROM v_issues WHERE issue_key % 3 <> 0""", "v_issues"),
    "attachments_flat": sql("""
SELECT project_key || '-' || CAST(issue_key AS VARCHAR) AS issue_key, CAST(issue_key AS VARCHAR) AS attachment_id,
       'plan.pdf' AS filename, issue_key * 10 AS size, strftime(created, '%Y-%m-%d') AS created_day,
       assignee AS author FROM v_issues WHERE issue_key % 10 = 0""", "v_issues"),
    "pages_to_items": sql("""
SELECT * REPLACE (project_key || '-' || CAST(item_id AS VARCHAR) AS item_id, project_key || '-' || CAST(tracker_key AS VARCHAR) AS tracker_key)
FROM (SELECT """ + ITEM_COLUMNS + """ FROM v_items)""", "v_items"),
    "refclass_append": sql(f"""
SELECT project_type AS type, count(DISTINCT project_key) AS project_count, count(ms) AS item_count,
       CAST(sum(ms) AS DOUBLE) / (count(ms) * 3600000.0) AS avg_hours,
       {POPULATION.format(n="count(ms)")} AS stddev
FROM v_projects LEFT JOIN (SELECT * FROM v_ms WHERE status = 'Done' AND cycle_hours > 0) i USING (project_key)
GROUP BY project_type""", "v_projects", "v_ms"),
    "history_scan": sql(f"SELECT {HISTORY_COLUMNS} FROM v_kept", "v_kept"),
    "history_retained": sql(f"SELECT {HISTORY_COLUMNS} FROM v_kept", "v_kept"),
    "history_cleared": sql(f"""
SELECT {HISTORY_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY ts DESC) AS rn FROM v_history
  WHERE project_key <> (SELECT n_name FROM nation WHERE n_nationkey = 3) OR ts > {AS_OF}) WHERE rn <= 100""", "v_history"),
    "history_compacted": sql(f"SELECT {HISTORY_COLUMNS} FROM v_kept", "v_kept"),
    "json_sink": sql("SELECT * FROM v_dashboard", "v_dashboard"),
    "sync_summary": sql("""
SELECT project_key, 'project' AS level, count(*) AS item_count FROM v_items GROUP BY project_key
UNION ALL SELECT NULL, 'all', count(*) FROM v_items""", "v_items"),
    "items_from_issues": sql(f"SELECT {ITEM_COLUMNS} FROM v_items", "v_items"),
    "status_normalized": sql("""
SELECT to_status AS raw, CASE WHEN to_status = 'Awaiting Dev Deployment' THEN 'Done'
       WHEN to_status = 'In Development' THEN 'In Progress' ELSE to_status END AS status, count(*) AS n
FROM v_trans GROUP BY 1, 2""", "v_trans"),
    "task_status_normalized": sql("SELECT key, norm AS status FROM v_tasks", "v_tasks"),
    "type_from_labels": sql("SELECT item_id AS issue_key, item_type FROM v_items", "v_items"),
    "size_from_labels": sql("SELECT item_id AS issue_key, size FROM v_items", "v_items"),
    "size_from_prefix": sql("SELECT key, CAST(p_size AS VARCHAR) AS size FROM v_tasks", "v_tasks"),
    "synced_task_items": sql("""
SELECT key AS item_id, type AS item_type, summary AS description, CAST(p_size AS VARCHAR) AS size, status, tracker_key
FROM v_tasks""", "v_tasks"),
    "ts_parsed": """
SELECT o_orderkey AS issue_key, CASE o_orderkey % 5
  WHEN 0 THEN o_orderdate + INTERVAL '13 hours 24 minutes 6 seconds 77 milliseconds'
  WHEN 1 THEN o_orderdate + INTERVAL '5 hours 24 minutes 6 seconds 77 milliseconds'
  WHEN 2 THEN o_orderdate + INTERVAL '5 hours 24 minutes 6 seconds'
  WHEN 3 THEN o_orderdate + INTERVAL '3 hours 24 minutes 6 seconds 77 milliseconds' END AS ts FROM orders""",
    "cycle_time": sql("SELECT item_id, cycle_hours FROM v_items", "v_items"),
    "items_from_tasks": sql("SELECT * FROM v_task_items WHERE item_id % 97 <> 0", "v_task_items"),
    "items_from_tasks_strict": sql("SELECT * FROM v_task_items", "v_task_items"),
    "task_rejects": """
SELECT p_partkey AS key, 'created_at: not a date: 2001-13-45' AS reject_reason FROM part WHERE p_partkey % 97 = 0""",
    "story_points": """
SELECT event_id AS issue_key, CASE WHEN event_id % 4 = 3 THEN CAST(event_id % 13 AS DOUBLE) ELSE 0.0 END AS points
FROM events""",
    "issue_filter": sql("""
SELECT issue_key, raw_status, created FROM v_issues
WHERE project_key = 'NATION_7' AND coalesce(epic_key, parent_key) = 'ASIA'
  AND (kind_label = 'kind:fix' OR size_label = 'size:S')""", "v_issues"),
    "issue_search": sql("""
SELECT issue_key, raw_status, summary, (SELECT count(*) FROM v_issues WHERE raw_status = 'In Development') AS total_matches
FROM v_issues WHERE raw_status = 'In Development' ORDER BY created, issue_key LIMIT 20""", "v_issues"),
    "epic_resolved": """
SELECT p_partkey AS key, CASE WHEN p_partkey % 3 <> 0 THEN upper(substr(p_type, 1, 3)) || '-' || CAST(p_size AS VARCHAR)
       WHEN p_partkey % 2 = 0 THEN 'CFG-7' END AS epic FROM part""",
    "refclass_from_items": sql("""
SELECT project_key, item_type, size, cycle_hours FROM v_items WHERE status = 'Done' AND cycle_hours > 0""", "v_items"),
    "eligibility": sql("""
SELECT project_key, n IS NOT NULL AND n > 0 AS eligible,
       CASE WHEN n IS NULL THEN 'no data' WHEN n = 0 THEN 'no cycle time data' END AS reason
FROM v_all_projects LEFT JOIN v_facts USING (project_key)""", "v_all_projects", "v_facts"),
    "project_resolve": sql("""
SELECT c_custkey AS request_id,
       CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN r_name ELSE 'nowhere' END AS request,
       CASE c_custkey % 3 WHEN 0 THEN n_name
            WHEN 1 THEN (SELECT arg_min(project_key, config_order) FROM v_projects WHERE epic_key = r_name) END AS resolved_project
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""", "v_projects"),
    "instance_route": """
SELECT CASE o_orderkey % 4 WHEN 0 THEN 'R' || n || 'X-' || k WHEN 1 THEN 'r' || n || 'y-' || k
            WHEN 2 THEN '-' || k ELSE 'nodash' || k END AS issue_key,
       CASE WHEN o_orderkey % 4 <= 1 THEN coalesce(r_name, 'AFRICA') ELSE 'AFRICA' END AS instance
FROM (SELECT *, CAST(o_orderkey % 7 AS VARCHAR) AS n, CAST(o_orderkey AS VARCHAR) AS k FROM orders)
LEFT JOIN region ON r_regionkey = o_orderkey % 7""",
    "size_distribution_effective": sql("SELECT * FROM v_dist", "v_dist"),
    "size_distribution_backed": sql(f"""
SELECT * FROM (WITH own AS (
  SELECT project_key, item_type, size, n, CASE WHEN n > 0 THEN CAST(sx AS DOUBLE) / (n * 3600000.0) END AS mean,
         CASE WHEN n > 1 THEN sqrt(CAST(n * sxx - sx * sx AS DOUBLE) / (CAST(n AS DOUBLE) * (n - 1))) / 3600000.0
              WHEN n = 1 THEN 0.0 END AS stddev, in_progress + to_do AS remaining
  FROM (SELECT project_key, item_type, size, {MEASURES} FROM v_ms GROUP BY project_key, item_type, size)
), done AS (
  SELECT project_type AS type, item_type, size, ms FROM v_ms JOIN v_projects USING (project_key)
  WHERE status = 'Done' AND cycle_hours > 0 AND project_type NOT IN ('ASIA', 'EUROPE') AND size <> 'XL' AND (item_type <> 'Fix' OR size = 'S')
), c3 AS (
  SELECT type, item_type, size, CAST(sum(ms) AS DOUBLE) / (count(*) * 3600000.0) AS mean, {POPULATION.format(n="count(*)")} AS stddev FROM done GROUP BY ALL
), c2 AS (
  SELECT type, size, CAST(sum(ms) AS DOUBLE) / (count(*) * 3600000.0) AS mean, {POPULATION.format(n="count(*)")} AS stddev FROM done GROUP BY ALL
), c1 AS (
  SELECT type, CAST(sum(ms) AS DOUBLE) / (count(*) * 3600000.0) AS mean, {POPULATION.format(n="count(*)")} AS stddev FROM done GROUP BY ALL
)
SELECT project_key, o.item_type, o.size, remaining,
       CASE WHEN n > 0 THEN 'observed' WHEN c3.mean IS NOT NULL THEN 'class' WHEN c2.mean IS NOT NULL THEN 'class-size'
            WHEN c1.mean IS NOT NULL THEN 'class-type' ELSE 'default' END AS source,
       coalesce(CASE WHEN n > 0 THEN o.mean END, c3.mean, c2.mean, c1.mean,
                CASE o.size WHEN 'S' THEN 1.5 WHEN 'M' THEN 4.0 WHEN 'L' THEN 8.0 WHEN 'XL' THEN 16.0 ELSE 4.0 END) AS mean,
       coalesce(CASE WHEN n > 0 THEN o.stddev END, c3.stddev, c2.stddev, c1.stddev,
                CASE o.size WHEN 'S' THEN 0.5 WHEN 'M' THEN 1.5 WHEN 'L' THEN 2.5 WHEN 'XL' THEN 5.0 ELSE 2.0 END) AS stddev
FROM own o JOIN v_projects p USING (project_key) LEFT JOIN c3 ON c3.type = project_type AND c3.item_type = o.item_type AND c3.size = o.size
LEFT JOIN c2 ON c2.type = project_type AND c2.size = o.size LEFT JOIN c1 ON c1.type = project_type)""", "v_ms", "v_projects"),
    "bulk_transition_plan": sql("""
SELECT issue_key, raw_status AS from_status, 'Done' AS requested,
       CASE WHEN raw_status <> 'Canceled' THEN '21' END AS transition_id,
       CASE WHEN raw_status <> 'Canceled' THEN 'accepted' ELSE 'rejected' END AS outcome FROM v_issues""", "v_issues"),
    "status_counts": sql("""
SELECT project_key, total, done, in_progress, to_do, progress_pct, n AS cycle_n, avg_cycle_hours FROM v_facts""", "v_facts"),
    "flow_counts": sql("SELECT project_key, to_do, in_progress, done, canceled FROM v_facts", "v_facts"),
    "status_breakdown": sql("""
SELECT 'FILE_' || CAST(key % 20 AS VARCHAR) AS project_key, count(*) FILTER (WHERE norm = 'Done') AS done,
       count(*) FILTER (WHERE norm = 'In Progress') AS in_progress, count(*) FILTER (WHERE norm = 'To Do') AS to_do,
       count(*) FILTER (WHERE norm = 'Blocked') AS blocked, count(*) FILTER (WHERE norm = 'Custom') AS other
FROM v_tasks GROUP BY 1""", "v_tasks"),
    "size_stats": sql("SELECT project_key, size, n, mean AS avg_hours FROM v_sizes WHERE n > 0", "v_sizes"),
    "type_stats": sql("""
SELECT project_key, item_type, count(*) AS total, count(*) FILTER (WHERE status = 'Done') AS done,
       count(*) FILTER (WHERE status <> 'Done') AS remaining
FROM v_items WHERE status <> 'Canceled' GROUP BY 1, 2""", "v_items"),
    "avg_cycle": sql("SELECT project_key, avg_cycle_hours FROM v_facts", "v_facts"),
    "size_distribution": sql("SELECT project_key, size, n, mean, stddev, remaining FROM v_sizes", "v_sizes"),
    "refclass_distribution": sql(f"""
SELECT type, item_type, size, count(*) AS n, CAST(sum(ms) AS DOUBLE) / (count(*) * 3600000.0) AS mean,
       {POPULATION.format(n="count(*)")} AS stddev
FROM v_refitems JOIN v_refprojects USING (project_id) GROUP BY type, item_type, size""",
        "v_refitems", "v_refprojects"),
    "refclass_summary": sql(f"""
SELECT type, count(DISTINCT p.project_id) AS project_count, count(ms) AS item_count,
       coalesce(CAST(sum(ms) AS DOUBLE) / nullif(count(ms) * 3600000.0, 0), 0.0) AS avg_hours,
       coalesce({POPULATION.format(n="nullif(count(ms), 0)")}, 0.0) AS stddev
FROM v_refprojects p LEFT JOIN v_refitems i ON i.project_id = p.project_id GROUP BY type""",
        "v_refitems", "v_refprojects"),
    "first_transitions": sql("SELECT * FROM v_first", "v_first"),
    "throughput": sql("SELECT project_key, recent_done, throughput_per_day FROM v_facts", "v_facts"),
    "completion_quantiles": sql("SELECT * FROM v_quant", "v_quant"),
    "completion_quantiles_compat": sql("SELECT * FROM v_quant_compat", "v_quant_compat"),
    "percentile_map": sql("SELECT * FROM v_quant", "v_quant"),
    "missing_times": sql("SELECT * FROM v_missing", "v_missing"),
    "missing_times_totals": sql("""
SELECT project_key, 'project' AS level, count(*) AS missing FROM v_missing GROUP BY project_key
UNION ALL SELECT NULL, 'all', count(*) FROM v_missing""", "v_missing"),
    "time_backfill_plan": sql("""
SELECT project_key, issue_key, closed_by, coalesce(story_points, 0.0) AS story_points,
       CASE WHEN story_points > 0 THEN story_points * 4.0 ELSE 8.0 END AS hours,
       CAST(trunc(CASE WHEN story_points > 0 THEN story_points * 4.0 ELSE 8.0 END * 3600) AS BIGINT) AS seconds
FROM v_missing""", "v_missing"),
    "field_profile": """
SELECT field, coalesce(r_name || CASE WHEN r_regionkey = 2 THEN ' Story Points' ELSE '' END, '') AS name, kind, n,
       coalesce(r_regionkey = 2, FALSE) AS maybe_points
FROM (SELECT 1 AS k, 'customfield_10001' AS field, 'object' AS kind, count(*) AS n FROM events
      UNION ALL SELECT 2, 'customfield_10002', CASE event_id % 4 WHEN 0 THEN 'string' WHEN 2 THEN 'array' ELSE 'number' END, count(*)
                FROM events WHERE event_id % 4 <> 1 GROUP BY 3
      UNION ALL SELECT 4, 'customfield_10004', 'number', count(*) FROM events)
LEFT JOIN region ON r_regionkey = k""",
    "closed_by": sql("SELECT * FROM v_closed", "v_closed"),
    "worklog_totals": """
SELECT user_id AS issue_key, CAST(sum(CAST(floor(value * 60) AS BIGINT)) AS BIGINT) AS total_seconds, count(*) AS entries
FROM events GROUP BY user_id""",
    "planned_schedule": sql("SELECT project_key, week, pv FROM v_schedule", "v_schedule"),
    "eva_metrics": sql("SELECT * FROM v_eva", "v_eva"),
    "eva_metrics_zero_after_end": sql("SELECT * FROM v_eva_zero", "v_eva_zero"),
    "earned_schedule": sql("""
SELECT project_key, weeks AS planned_weeks, done AS ev,
       CASE WHEN week IS NULL THEN CAST(weeks AS DOUBLE) WHEN week = 1 THEN 1.0
            ELSE week - 1 + (done - prev) / (pv - prev) END AS earned_schedule
FROM (SELECT p.project_key, p.weeks, p.done, s.week, s.pv, s.prev,
             row_number() OVER (PARTITION BY p.project_key ORDER BY s.week) AS rn
      FROM v_plans p LEFT JOIN (
        SELECT *, lag(pv, 1, 0) OVER (PARTITION BY project_key ORDER BY week) AS prev FROM v_schedule) s
      ON s.project_key = p.project_key AND s.pv >= p.done) WHERE rn = 1""", "v_plans", "v_schedule"),
    "dashboard": sql("SELECT * FROM v_dashboard", "v_dashboard"),
    "burndown": sql(f"""
SELECT project_key, coalesce(min(done_ts) FILTER (WHERE status = 'Done') - INTERVAL '1' DAY, {AS_OF}) AS ts,
       0 AS completed, count(*) FILTER (WHERE status <> 'Canceled') AS remaining
FROM v_items GROUP BY project_key
UNION ALL
SELECT project_key, done_ts, rn, total - rn
FROM (SELECT project_key, done_ts, row_number() OVER (PARTITION BY project_key ORDER BY done_ts, item_id) AS rn
      FROM v_items WHERE status = 'Done' AND done_ts IS NOT NULL)
JOIN (SELECT project_key, total FROM v_facts) USING (project_key)""", "v_items", "v_facts"),
    "history_window": sql("""
SELECT project_key, ts, total, completed, remaining, avg_cycle, throughput, progress_pct, p70, p95 FROM v_recent""", "v_recent"),
    "history_trend": sql("""
SELECT *, CASE WHEN progress_change > 5 AND p70_change < -5 THEN 'improving'
               WHEN progress_change < -5 OR p70_change > 10 THEN 'declining' ELSE 'stable' END AS direction
FROM (SELECT a.project_key, a.entries, b.progress_pct - a.progress_pct AS progress_change,
             CASE WHEN a.throughput > 0 THEN (b.throughput - a.throughput) / a.throughput * 100 ELSE 0.0 END AS throughput_change,
             CASE WHEN a.p70 > 0 THEN (b.p70 - a.p70) / a.p70 * 100 ELSE 0.0 END AS p70_change
      FROM v_recent a JOIN v_recent b USING (project_key)
      WHERE a.first_rn = 1 AND b.last_rn = 1 AND a.entries >= 2)""", "v_recent"),
    "p85_drift": sql("SELECT * FROM v_drift", "v_drift"),
    "history_latest": sql(f"""
SELECT {HISTORY_COLUMNS} FROM v_history h WHERE ts = (SELECT max(ts) FROM v_history g WHERE g.project_key = h.project_key)""", "v_history"),
    "recent_comments": """
SELECT issue_key, seq, author, body, total_comments FROM (
  SELECT conv_id AS issue_key, turn AS seq, coalesce(nullif(role, ''), 'Unknown') AS author, text AS body,
         count(*) OVER (PARTITION BY conv_id) AS total_comments,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 2""",
    "all_comments": """
SELECT conv_id AS issue_key, turn AS seq, coalesce(nullif(role, ''), 'Unknown') AS author, text AS body,
       count(*) OVER (PARTITION BY conv_id) AS total_comments FROM conversations""",
    "recent_items": sql("""
SELECT * FROM (SELECT project_key, issue_key, raw_status, summary, updated,
                      CAST(row_number() OVER (PARTITION BY project_key ORDER BY updated DESC, issue_key) AS INTEGER) AS rank FROM v_issues)
WHERE rank <= 5""", "v_issues"),
    "timeline": sql(f"""
SELECT project_key, pct, days, {day("days")} AS target_date FROM v_quant
UNION ALL SELECT DISTINCT project_key, 0, 0.0, {AS_DAY} FROM v_quant""", "v_quant"),
    "projects_all": sql("SELECT * FROM v_all_projects", "v_all_projects"),
    "changelog_flat": sql("""
SELECT issue_key, ts, l_linenumber AS line, l_partkey AS part, coalesce(author, 'Unknown') AS author, 'status' AS field,
       CASE WHEN from_status = '' THEN '(none)' ELSE from_status END AS from_status, to_status FROM v_trans""", "v_trans"),
    "bulk_label_plan": sql("""
SELECT issue_key, concat_ws(',', kind_label, 'team', size_label) AS labels_before,
       concat_ws(',', nullif(kind_label, 'kind:fix'), 'team', nullif(size_label, 'size:S'), 'reviewed') AS labels_after
FROM v_issues WHERE raw_status = 'Done'""", "v_issues"),
    "task_reconcile": sql("""
SELECT key, tracker_key, CASE WHEN tracker_key IS NULL THEN 'create' WHEN raw_status IS NULL THEN 'skip' ELSE 'update' END AS action,
       CASE WHEN tracker_key IS NULL THEN 'To Do' ELSE coalesce(raw_status, status) END AS new_status,
       CASE WHEN tracker_key IS NULL THEN status <> 'To Do' WHEN raw_status IS NULL THEN FALSE ELSE raw_status <> status END AS status_changed,
       CASE WHEN tracker_key IS NULL AND type = '' THEN 'Story' ELSE type END AS issue_type
FROM v_tasks LEFT JOIN (SELECT issue_key AS tracker_key, raw_status FROM v_issues) USING (tracker_key)""", "v_tasks", "v_issues"),
    "task_reconcile_counts": sql("""
SELECT CASE WHEN tracker_key IS NULL THEN 'create' WHEN o_orderkey IS NULL THEN 'skip' ELSE 'update' END AS action, count(*) AS n
FROM v_tasks LEFT JOIN orders ON o_orderkey = tracker_key GROUP BY 1""", "v_tasks"),
    "dependency_edges_new": sql("""
SELECT DISTINCT dep.tracker_key AS blocker, task.tracker_key AS blocked
FROM v_tasks task JOIN v_tasks dep ON dep.key = task.key - 1 OR dep.key = task.key - 7
WHERE task.tracker_key IS NOT NULL AND dep.tracker_key IS NOT NULL
  AND NOT (task.key % 2 = 0 AND dep.key = task.key - 1)""", "v_tasks"),
    "stream_first_transitions": sql("""
SELECT issue_key, min(ts) FILTER (WHERE to_status IN ('In Progress', 'In Development')) AS in_progress_ts,
       min(ts) FILTER (WHERE to_status = 'Done') AS done_ts
FROM v_changes WHERE to_status NOT IN ('To Do', 'Canceled') GROUP BY issue_key""", "v_changes"),
    "stream_project_status": sql("""
SELECT project_key, total, done, in_progress, to_do, CASE WHEN total > 0 THEN done / total * 100 ELSE 0.0 END AS progress_pct,
       cycle_n, CASE WHEN cycle_n > 0 THEN CAST(sx AS DOUBLE) / (cycle_n * 3600000.0) ELSE 0.0 END AS avg_cycle_hours
FROM (SELECT project_key, count(*) FILTER (WHERE s <> 'Canceled') AS total, count(*) FILTER (WHERE s = 'Done') AS done,
             count(*) FILTER (WHERE s IN ('In Progress', 'In Development')) AS in_progress,
             count(*) FILTER (WHERE s = 'To Do') AS to_do, count(*) FILTER (WHERE s = 'Done' AND h > 0) AS cycle_n,
             sum(CAST(floor(h * 3600000.0 + 0.5) AS BIGINT)) FILTER (WHERE s = 'Done' AND h > 0) AS sx
      FROM (SELECT project_key, issue_key, s, coalesce((epoch_us(d) - epoch_us(w)) / 3600000000.0, 0.0) AS h
            FROM (SELECT project_key, issue_key, arg_max(to_status, (ts, event_id)) AS s,
                         min(ts) FILTER (WHERE to_status IN ('In Progress', 'In Development')) AS w,
                         min(ts) FILTER (WHERE to_status = 'Done') AS d FROM v_changes GROUP BY 1, 2))
      GROUP BY project_key)""", "v_changes"),
    "portfolio_run": sql("SELECT * FROM v_run", "v_run"),
    "portfolio_history": sql(f"""
SELECT f.project_key, {AS_OF} AS ts, total, done AS completed, remaining, avg_cycle_hours AS avg_cycle,
       throughput_per_day AS throughput, p70, p85, p95
FROM v_facts f JOIN v_wide USING (project_key)""", "v_facts", "v_wide"),
    "project_compare": sql("SELECT * FROM v_compare", "v_compare"),
    "compare_summary": sql("""
SELECT (SELECT project_key FROM v_compare WHERE p85 > 0 ORDER BY p85, project_key LIMIT 1) AS fastest_project,
       (SELECT project_key FROM v_compare ORDER BY progress_pct DESC, project_key LIMIT 1) AS most_complete,
       (SELECT project_key FROM v_compare WHERE health IN ('behind', 'at-risk') ORDER BY p85 DESC, project_key LIMIT 1) AS highest_risk,
       CAST(sum(remaining) AS BIGINT) AS total_remaining,
       CAST(sum(CAST(round(progress_pct * 1000000) AS HUGEINT)) AS DOUBLE) / count(*) / 1000000 AS average_progress
FROM v_compare""", "v_compare"),
    "project_status": sql(f"""
SELECT project_key, project_key AS name, total, done, in_progress, to_do, progress_pct, avg_cycle_hours,
       CASE WHEN n > 0 AND remaining > 0 THEN p85 END AS p85,
       CASE WHEN n > 0 AND remaining > 0 THEN {day("p85")} END AS target_date_85,
       CASE WHEN remaining = 0 OR progress_pct >= 75 THEN 'good' WHEN progress_pct >= 25 THEN 'warning' ELSE 'critical' END AS health
FROM v_facts JOIN v_wide USING (project_key)""", "v_facts", "v_wide"),
    "projects_list": sql("""
SELECT project_key, name, epic_key, capacity, coalesce(total, 0) AS total, coalesce(done, 0) AS done,
       coalesce(remaining, 0) AS remaining, coalesce(progress_pct, 0.0) AS progress_pct
FROM v_all_projects LEFT JOIN v_facts USING (project_key)""", "v_all_projects", "v_facts"),
    "report_full": sql("""
SELECT project_key, 'overview' AS section, '' AS label, metric, value, CAST(NULL AS VARCHAR) AS text FROM (
  SELECT project_key, unnest(['total', 'done', 'in_progress', 'to_do', 'remaining', 'progress_pct', 'cycle_n', 'avg_cycle_hours']) AS metric,
         unnest([CAST(total AS DOUBLE), done, in_progress, to_do, remaining, progress_pct, n, avg_cycle_hours]) AS value FROM v_facts)
UNION ALL SELECT project_key, 'eva', '', unnest(['week', 'pv', 'ev', 'sv', 'spi', 'completion_week']),
                 unnest([CAST(week AS DOUBLE), pv, ev, sv, spi, completion_week]), NULL FROM v_eva
UNION ALL SELECT project_key, 'eva', '', unnest(['sv_band', 'spi_band']), NULL, unnest([sv_band, spi_band]) FROM v_eva
UNION ALL SELECT project_key, 'completion', CAST(pct AS VARCHAR), 'days', days, NULL FROM v_run
UNION ALL SELECT project_key, 'completion', CAST(pct AS VARCHAR), 'target_date', NULL, CAST(target_date AS VARCHAR) FROM v_run
UNION ALL SELECT project_key, 'sizes', size, unnest(['n', 'avg_hours']), unnest([CAST(n AS DOUBLE), mean]), NULL FROM v_sizes WHERE n > 0
UNION ALL SELECT project_key, 'types', item_type, unnest(['total', 'done', 'remaining']),
                 unnest([CAST(count(*) AS DOUBLE), count(*) FILTER (WHERE status = 'Done'), count(*) FILTER (WHERE status <> 'Done')]), NULL
          FROM v_items WHERE status <> 'Canceled' GROUP BY project_key, item_type""", "v_facts", "v_eva", "v_run", "v_sizes", "v_items"),
}
