"""The fixture derivation rules as DuckDB SQL, for the independent oracle.

Each entry is the body of a CTE over the pre-registered source views; the
oracle of a query prepends the CTEs it needs (in dependency order).
"""

from __future__ import annotations

from slotwise.sources.fixtures import DIALOGUES, DIRTY

_DIALOGUE_ARMS = " ".join(f"WHEN {i} THEN {list(d)!r}" for i, d in enumerate(DIALOGUES))

FIXTURE_SQL = {
    "doctors": """
SELECT s_suppkey + 1 AS id,
  CONCAT('Dr. ', CAST(s_suppkey - CASE WHEN s_suppkey % 4 = 3 THEN 1 ELSE 0 END AS VARCHAR)) AS name,
  CASE s_suppkey % 6 WHEN 0 THEN 'General OPD' WHEN 1 THEN 'Orthopedics' WHEN 2 THEN 'Gynecology'
    WHEN 3 THEN 'Cardiology' WHEN 4 THEN 'Pediatrics' ELSE 'ENT' END AS department,
  CASE s_suppkey % 5 WHEN 0 THEN 'Mon,Tue,Wed,Thu,Fri' WHEN 1 THEN 'Mon,Wed,Fri'
    WHEN 2 THEN 'Tue,Thu,Sat' WHEN 3 THEN 'Sun' ELSE ' Mon, Thu,xx,sat' END AS available_days,
  CAST(CASE s_suppkey % 4 WHEN 0 THEN 15 WHEN 1 THEN 20 WHEN 2 THEN 30 ELSE 25 END AS INTEGER) AS slot_duration_mins,
  CASE s_suppkey % 3 WHEN 0 THEN '09:00' ELSE '10:00' END AS start_time,
  CASE s_suppkey % 7 WHEN 0 THEN '12:00' WHEN 1 THEN '09:30' ELSE '13:00' END AS end_time
FROM supplier""",
    "patients": """
SELECT c_custkey + 1 AS id,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_name END AS name,
  'whatsapp:+91' || CAST(9000000000 + c_custkey AS VARCHAR) AS phone,
  CAST(DATE '2025-01-01' + CAST(c_custkey % 150 AS INTEGER) AS TIMESTAMP) AS created_at
FROM customer""",
    "appointments_base": """
SELECT o_orderkey + 1 AS id,
  'whatsapp:+91' || CAST(9000000000 + o_custkey AS VARCHAR) AS patient_phone,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE 'Patient ' || CAST(o_custkey AS VARCHAR) END AS patient_name,
  1 + (o_orderkey * 31 + o_custkey) % (SELECT COUNT(*) + 1 FROM supplier) AS doctor_id,
  DATE '2025-06-01' + CAST((o_orderkey * 7 + o_custkey) % 60 AS INTEGER) AS appointment_date,
  CASE o_orderkey % 8 WHEN 0 THEN '09:00' WHEN 1 THEN '09:15' WHEN 2 THEN '09:30' WHEN 3 THEN '10:00'
    WHEN 4 THEN '10:20' WHEN 5 THEN '10:30' WHEN 6 THEN '11:00' ELSE '11:30' END AS slot_time,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderstatus = 'O' THEN 'booked'
    WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'cancelled' END AS status
FROM orders""",
    "appointments": """
SELECT id, patient_phone, patient_name, doctor_id, appointment_date, slot_time,
  CAST(ROW_NUMBER() OVER (PARTITION BY doctor_id, appointment_date ORDER BY id) AS BIGINT) AS token_number,
  status
FROM appointments_base""",
    "doctor_leaves": """
SELECT MIN(o_orderkey) + 1 AS id, doctor_id, leave_date,
  CASE WHEN month(MIN(o_orderdate)) <= 6 THEN 'conference' ELSE 'personal' END AS reason
FROM (SELECT o_orderkey, o_orderdate,
        1 + o_orderkey % (SELECT COUNT(*) FROM supplier) AS doctor_id,
        DATE '2025-06-01' + CAST(o_custkey % 60 AS INTEGER) AS leave_date
      FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') x
GROUP BY doctor_id, leave_date""",
    "messages": f"""
SELECT conv_id * 1000 + turn AS id,
  (CASE WHEN (conv_id + turn) % 3 = 0 THEN '+91' ELSE 'whatsapp:+91' END)
    || CAST(9000000000 + conv_id AS VARCHAR) AS from_number,
  text AS body,
  TIMESTAMP '2025-06-01 00:00:00' + INTERVAL '1' MINUTE * CAST(conv_id * 60 AS INTEGER)
    + INTERVAL '1' SECOND * CAST(turn AS INTEGER) AS ts
FROM conversations WHERE role = 'user'
UNION ALL
SELECT conv_id * 1000 + 500 + k AS id,
  (CASE WHEN (conv_id + k) % 3 = 0 THEN '+91' ELSE 'whatsapp:+91' END)
    || CAST(9000000000 + conv_id AS VARCHAR) AS from_number,
  body,
  TIMESTAMP '2025-06-01 00:00:00' + INTERVAL '1' MINUTE * CAST(conv_id * 60 + 30 AS INTEGER)
    + INTERVAL '1' SECOND * CAST(k AS INTEGER) AS ts
FROM (SELECT conv_id, unnest(range(len(script))) AS k, unnest(script) AS body
      FROM (SELECT conv_id, CASE conv_id % {len(DIALOGUES)} {_DIALOGUE_ARMS} END AS script
            FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user') c0) c1) c2""",
    "session_updates": """
SELECT 'whatsapp:+91' || CAST(9000000000 + user_id AS VARCHAR) AS phone,
  CASE event_type WHEN 'view' THEN 'choose_dept' WHEN 'click' THEN 'choose_doctor'
    WHEN 'signup' THEN 'choose_date' WHEN 'purchase' THEN 'confirm_name' ELSE 'start' END AS step,
  props AS temp_data, ts AS updated_at, event_id AS seq
FROM events""",
    "admin_cancel_ids": """
SELECT o_orderkey + 1 AS id FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "admin_complete_ids": """
SELECT o_orderkey + 1 AS id FROM orders WHERE o_orderpriority = '2-HIGH'""",
    "leave_requests": """
SELECT o_orderkey + 1 AS request_id,
  1 + o_custkey % (SELECT COUNT(*) FROM supplier) AS doctor_id,
  CASE WHEN o_orderkey % 97 = 0 THEN '2025-02-30'
    ELSE strftime(DATE '2025-06-01' + CAST(o_orderkey % 60 AS INTEGER), '%Y-%m-%d') END AS leave_date,
  'Leave ' || o_orderstatus AS reason
FROM orders WHERE o_orderpriority = '5-LOW'""",
    "ledger": """
SELECT * FROM appointments WHERE id * 2 <= (SELECT COUNT(*) FROM orders)""",
    "requests": """
SELECT * FROM appointments WHERE id * 2 > (SELECT COUNT(*) FROM orders)""",
}

for _table, _changed in DIRTY.items():
    _columns = ", ".join(f"{sql} AS {name}" for name, sql in _changed.items())
    FIXTURE_SQL[f"dirty_{_table}"] = f"\nSELECT * REPLACE ({_columns}) FROM {_table}"

DEPENDS = {
    **{f"dirty_{t}": [t] for t in DIRTY},
    "appointments": ["appointments_base"],
    "ledger": ["appointments"],
    "requests": ["appointments"],
}

ORDER = [
    "doctors", "patients", "appointments_base", "appointments", "doctor_leaves",
    "messages", "session_updates", "admin_cancel_ids", "admin_complete_ids", "leave_requests",
    "ledger", "requests", *[f"dirty_{t}" for t in DIRTY],
]


def with_fixtures(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs of the named fixtures (and their inputs)."""
    needed: set[str] = set()

    def add(n: str) -> None:
        if n in needed:
            return
        needed.add(n)
        for dep in DEPENDS.get(n, []):
            add(dep)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in ORDER if n in needed]
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        # the query's own CTEs follow the fixtures
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def sql_render(template: str, **exprs: str) -> str:
    """A message template as a DuckDB string expression: literal parts are
    quoted, ``{field}`` parts are the given SQL expressions."""
    import re

    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append("'" + template[pos : m.start()].replace("'", "''") + "'")
        parts.append(f"CAST({exprs[m.group(1)]} AS VARCHAR)")
        pos = m.end()
    if pos < len(template):
        parts.append("'" + template[pos:].replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"
