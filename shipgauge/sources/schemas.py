"""Explicit schemas of everything that is read or written."""

from __future__ import annotations

ITEM = (
    "project_key STRING, item_id STRING, item_type STRING, description STRING, size STRING, "
    "status STRING, created TIMESTAMP, in_progress_ts TIMESTAMP, done_ts TIMESTAMP, "
    "cycle_hours DOUBLE, assignee STRING, tracker_key STRING"
)

# Fixed value: field names of a per-project item file.
ITEM_FILE = (
    "ID STRING, Type STRING, Description STRING, Size STRING, Status STRING, Created STRING, "
    "InProgress STRING, Done STRING, CycleTime DOUBLE, Assignee STRING, JiraKey STRING"
)

REF_PROJECTS = (
    "project_id BIGINT, name STRING, type STRING, completed_at DATE, team_size INT"
)
REF_ITEMS = "project_id BIGINT, item_type STRING, size STRING, cycle_hours DOUBLE"

HISTORY = (
    "project_key STRING, ts TIMESTAMP, total BIGINT, completed BIGINT, remaining BIGINT, "
    "avg_cycle DOUBLE, throughput DOUBLE, percentiles MAP<INT, DOUBLE>"
)

_USER = "STRUCT<displayName: STRING, emailAddress: STRING>"
_LINKED = "STRUCT<key: STRING, fields: STRUCT<summary: STRING, status: STRUCT<name: STRING>>>"

CHANGELOG = (
    f"STRUCT<histories: ARRAY<STRUCT<created: STRING, author: {_USER}, "
    "items: ARRAY<STRUCT<field: STRING, fieldtype: STRING, `from`: STRING, fromString: STRING, "
    "`to`: STRING, toString: STRING>>>>>"
)
# ``fields`` is a VARIANT: it holds both the known fields, which are taken out of it as one struct, and any custom one.
KNOWN_FIELDS = (
    "STRUCT<summary: STRING, status: STRUCT<name: STRING>, issuetype: STRUCT<name: STRING>, labels: ARRAY<STRING>, "
    "assignee: STRUCT<displayName: STRING>, parent: STRUCT<key: STRING>, created: STRING, updated: STRING, timespent: BIGINT>"
)
PAGE = (
    f"issues ARRAY<STRUCT<key: STRING, fields: VARIANT, changelog: {CHANGELOG}>>, "
    "total BIGINT, nextPageToken STRING, isLast BOOLEAN"
)
REJECTS = "STRUCT<level: STRING, issue_key: STRING, reason: STRING, record: STRING>"

LINKS = (
    "ARRAY<STRUCT<id: STRING, type: STRUCT<name: STRING, inward: STRING, outward: STRING>, "
    f"inwardIssue: {_LINKED}, outwardIssue: {_LINKED}>>"
)
ATTACHMENTS = (
    f"ARRAY<STRUCT<id: STRING, filename: STRING, mimeType: STRING, size: BIGINT, "
    f"created: STRING, author: {_USER}, content: STRING>>"
)
