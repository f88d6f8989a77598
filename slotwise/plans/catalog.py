"""Every query key of the operator inventory, wired to fixtures and oracles.

Each builder takes ``(spark, sf_dir)``, derives the scheduling tables from the
supplied parquet files and returns the operator's DataFrame over the whole
tables.  The oracle next to it is independent DuckDB SQL computing the same
rows; keys without an SQL form register no oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions import templates as T
from slotwise.functions.payload import dump_payload, parse_payload
from slotwise.operators import analytics, arbitration, availability, ledger, lookups, messaging, quality, reports
from slotwise.plans.numbering import positions
from slotwise.plans.oracle_fixtures import sql_render
from slotwise.plans.registry import register
from slotwise.sources.fixtures import AS_OF, FIRST_MESSAGE_TS, dirty, tables
from slotwise.sources.seed import seed_doctors
from slotwise.streaming import dialogue, ingest

# Fixed parameters of the registered queries.
DAY_SHEET_DAYS = ("2025-07-01", "2025-07-02")
SEARCH_DEPARTMENT = "Cardiology"
SEARCH_STATUS = "booked"
PATIENT_SEARCH = "0000012"
ADMIN_PHONE = "+919999999999"
DELETED_LEAVE_REASON = "conference"

A, D, P, L, M, S = "appointments", "doctors", "patients", "doctor_leaves", "messages", "session_updates"

# ------------------------------------------------------------------ shared oracle fragments


def _minutes(c: str) -> str:
    return f"(TRY_CAST(split_part({c}, ':', 1) AS INTEGER) * 60 + TRY_CAST(split_part({c}, ':', 2) AS INTEGER))"


def _hhmm(m: str) -> str:
    return f"(lpad(CAST({m} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({m} % 60 AS VARCHAR), 2, '0'))"


def _day_label(d: str) -> str:
    return f"strftime({d}, '%a, %d %b')"


def _none(x: str) -> str:
    return f"COALESCE(CAST({x} AS VARCHAR), 'None')"


def _phone_key(x: str) -> str:
    return f"replace({x}, 'whatsapp:', '')"


def _address(x: str) -> str:
    return f"('whatsapp:' || {_phone_key(x)})"


GRID_CTE = f"""
grid AS (
  SELECT doctor_id, m, CAST((m - s) // dur + 1 AS INTEGER) AS slot_no, {_hhmm('m')} AS slot_time
  FROM (SELECT id AS doctor_id, s, dur,
          unnest(CASE WHEN s < e AND dur > 0 THEN range(s, e, dur) ELSE []::BIGINT[] END) AS m
        FROM (SELECT id, {_minutes('start_time')} AS s, {_minutes('end_time')} AS e,
                slot_duration_mins AS dur FROM doctors) g0) g1)"""

DATES_CTE = """
dates AS (
  SELECT doctor_id, CAST(date_no AS INTEGER) AS date_no, available_date FROM (
    SELECT d.id AS doctor_id, DATE '2025-07-01' + CAST(t.i AS INTEGER) AS available_date,
      ROW_NUMBER() OVER (PARTITION BY d.id ORDER BY t.i) AS date_no
    FROM doctors d, range(1, 21) t(i)
    WHERE list_contains(list_transform(string_split(d.available_days, ','), lambda x: trim(x)),
                        strftime(DATE '2025-07-01' + CAST(t.i AS INTEGER), '%a'))
      AND NOT EXISTS (SELECT 1 FROM doctor_leaves l
                      WHERE l.doctor_id = d.id AND l.leave_date = DATE '2025-07-01' + CAST(t.i AS INTEGER))
  ) x WHERE date_no <= 5)"""

LATEST_SESSION_CTE = """
latest AS (
  SELECT replace(phone, 'whatsapp:', '') AS phone, step, temp_data, updated_at FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY replace(phone, 'whatsapp:', '') ORDER BY updated_at DESC, seq DESC) AS rn
    FROM session_updates) s WHERE rn = 1)"""

BOOK_CTE = """
flagged AS (
  SELECT r.id, r.patient_phone, r.patient_name, r.doctor_id, r.appointment_date, r.slot_time,
    CASE WHEN NOT EXISTS (SELECT 1 FROM doctors d WHERE d.id = r.doctor_id) THEN 'unknown_doctor'
         WHEN EXISTS (SELECT 1 FROM doctor_leaves l
                      WHERE l.doctor_id = r.doctor_id AND l.leave_date = r.appointment_date) THEN 'on_leave'
         WHEN EXISTS (SELECT 1 FROM ledger g WHERE g.status = 'booked' AND g.doctor_id = r.doctor_id
                      AND g.appointment_date = r.appointment_date AND g.slot_time = r.slot_time) THEN 'slot_taken'
    END AS stage
  FROM requests r),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY doctor_id, appointment_date, slot_time, stage IS NULL ORDER BY id) AS slot_rank
  FROM flagged),
decided AS (
  SELECT id, patient_phone, patient_name, doctor_id, appointment_date, slot_time,
    COALESCE(stage, CASE WHEN slot_rank = 1 THEN 'accepted' ELSE 'slot_taken' END) AS outcome
  FROM ranked),
acc AS (
  SELECT id, ROW_NUMBER() OVER (PARTITION BY doctor_id, appointment_date ORDER BY id) AS acc_rank
  FROM decided WHERE outcome = 'accepted'),
prior AS (SELECT doctor_id, appointment_date, COUNT(*) AS n FROM ledger GROUP BY doctor_id, appointment_date),
outcomes AS (
  SELECT x.id, x.patient_phone, x.patient_name, x.doctor_id, x.appointment_date, x.slot_time, x.outcome,
    CAST(CASE WHEN x.outcome = 'accepted' THEN COALESCE(p.n, 0) + a.acc_rank END AS BIGINT) AS token_number
  FROM decided x LEFT JOIN acc a ON a.id = x.id
  LEFT JOIN prior p ON p.doctor_id = x.doctor_id AND p.appointment_date = x.appointment_date)"""

VALID_MESSAGES_CTE = """
valid AS (
  SELECT id, replace(from_number, 'whatsapp:', '') AS phone, ts, lower(trim(body)) AS text FROM messages
  WHERE length(from_number) > 0 AND length(trim(body)) > 0)"""

CANCEL_CTE = f"""
req AS (
  SELECT phone, id AS request_id, ts,
    ROW_NUMBER() OVER (PARTITION BY {_phone_key('phone')} ORDER BY ts, id) AS k
  FROM valid WHERE text IN ('cancel', 'cancel appointment')),
bk AS (
  SELECT a.id AS appointment_id, {_phone_key('a.patient_phone')} AS pk, d.name AS doctor_name,
    a.appointment_date, a.slot_time,
    ROW_NUMBER() OVER (PARTITION BY {_phone_key('a.patient_phone')}
                       ORDER BY a.appointment_date, a.slot_time, a.id) AS k
  FROM appointments a JOIN doctors d ON a.doctor_id = d.id WHERE a.status = 'booked'),
cancels AS (
  SELECT r.request_id, r.phone, CAST(r.k AS BIGINT) AS k,
    CASE WHEN b.appointment_id IS NOT NULL THEN 'cancelled' ELSE 'not_found' END AS outcome,
    b.appointment_id, b.doctor_name, b.appointment_date, b.slot_time
  FROM req r LEFT JOIN bk b ON b.pk = {_phone_key('r.phone')} AND b.k = r.k)"""

NEXT_CTE = """
nxt AS (
  SELECT * FROM (
    SELECT a.*, d.name AS doctor_name, d.department,
      ROW_NUMBER() OVER (PARTITION BY replace(a.patient_phone, 'whatsapp:', '')
                         ORDER BY a.appointment_date, a.slot_time, a.id) AS rn
    FROM appointments a JOIN doctors d ON a.doctor_id = d.id WHERE a.status = 'booked') n WHERE rn = 1)"""

HITS_CTE = """
hits AS (
  SELECT a.id AS appointment_id, a.patient_phone, a.doctor_id, d.name AS doctor_name, a.appointment_date,
    a.slot_time, 'cancelled' AS status
  FROM appointments a JOIN doctors d ON a.doctor_id = d.id
  WHERE a.status = 'booked' AND EXISTS (
    SELECT 1 FROM doctor_leaves l WHERE l.doctor_id = a.doctor_id AND l.leave_date = a.appointment_date))"""

ADMIN_CANCEL_CTE = """
admin_hits AS (
  SELECT a.id AS appointment_id, a.patient_phone, d.name AS doctor_name, a.appointment_date, a.slot_time
  FROM appointments a JOIN doctors d ON a.doctor_id = d.id
  WHERE a.id IN (SELECT id FROM admin_cancel_ids))"""

REMINDER_CTE = """
tmrw AS (
  SELECT a.*, d.name AS doctor_name, d.department FROM appointments a JOIN doctors d ON a.doctor_id = d.id
  WHERE a.appointment_date = DATE '2025-07-02' AND a.status = 'booked')"""

REMINDER_BODY = sql_render(
    T.REMINDER,
    patient="COALESCE(NULLIF(patient_name, ''), 'Patient')",
    doctor_name=_none("doctor_name"),
    department=_none("department"),
    slot_time=_none("slot_time"),
    token_number=_none("token_number"),
)
ADMIN_NOTICE_BODY = sql_render(
    T.ADMIN_CANCEL_NOTICE, doctor_name=_none("doctor_name"), day=_day_label("appointment_date"),
    slot_time=_none("slot_time"),
)
LEAVE_NOTICE_BODY = sql_render(
    T.LEAVE_NOTICE, doctor_name=_none("doctor_name"), day=_day_label("appointment_date"),
    slot_time=_none("slot_time"),
)


# ================================================================== analytics (A-1 .. A-8, S-8)


@register(
    "counts_by_department",
    """
SELECT d.department, COUNT(*) AS count
FROM appointments a JOIN doctors d ON a.doctor_id = d.id
WHERE a.status <> 'cancelled'
GROUP BY d.department""",
    (A, D),
)
def q_counts_by_department(spark, sf_dir):
    t = tables(spark, sf_dir)
    return analytics.counts_by_department(t.appointments, t.doctors)


@register(
    "counts_by_doctor",
    """
SELECT d.name, COUNT(*) AS count
FROM appointments a JOIN doctors d ON a.doctor_id = d.id
WHERE a.status <> 'cancelled'
GROUP BY d.name""",
    (A, D),
)
def q_counts_by_doctor(spark, sf_dir):
    t = tables(spark, sf_dir)
    return analytics.counts_by_doctor(t.appointments, t.doctors)


@register(
    "counts_by_doctor_id",
    """
SELECT d.id AS doctor_id, d.name, d.department, COUNT(*) AS count
FROM appointments a JOIN doctors d ON a.doctor_id = d.id
WHERE a.status <> 'cancelled'
GROUP BY d.id, d.name, d.department""",
    (A, D),
)
def q_counts_by_doctor_id(spark, sf_dir):
    t = tables(spark, sf_dir)
    return analytics.counts_by_doctor_id(t.appointments, t.doctors)


@register(
    "daily_counts",
    """
SELECT appointment_date, COUNT(*) AS count FROM appointments
WHERE appointment_date >= DATE '2025-06-01' AND appointment_date <= DATE '2025-07-01'
  AND status <> 'cancelled'
GROUP BY appointment_date""",
    (A,),
)
def q_daily_counts(spark, sf_dir):
    return analytics.daily_counts(tables(spark, sf_dir).appointments, AS_OF)


@register(
    "month_total",
    """
SELECT COUNT(*) AS month_total FROM appointments
WHERE strftime(appointment_date, '%Y-%m') = '2025-07' AND status <> 'cancelled'""",
    (A,),
)
def q_month_total(spark, sf_dir):
    return analytics.month_total(tables(spark, sf_dir).appointments, AS_OF)


@register(
    "busiest_day",
    """
SELECT appointment_date, COUNT(*) AS count FROM appointments WHERE status <> 'cancelled'
GROUP BY appointment_date ORDER BY count DESC, appointment_date LIMIT 1""",
    (A,),
)
def q_busiest_day(spark, sf_dir):
    return analytics.busiest_day(tables(spark, sf_dir).appointments)


@register(
    "busiest_doctor",
    """
SELECT d.name, COUNT(*) AS count FROM appointments a JOIN doctors d ON a.doctor_id = d.id
WHERE a.status <> 'cancelled' GROUP BY d.name ORDER BY count DESC, d.name LIMIT 1""",
    (A, D),
)
def q_busiest_doctor(spark, sf_dir):
    t = tables(spark, sf_dir)
    return analytics.busiest_doctor(t.appointments, t.doctors)


@register(
    "top_department",
    """
SELECT COALESCE((
  SELECT d.department FROM appointments a JOIN doctors d ON a.doctor_id = d.id
  WHERE a.status <> 'cancelled' GROUP BY d.department ORDER BY COUNT(*) DESC, d.department LIMIT 1
), '—') AS department""",
    (A, D),
)
def q_top_department(spark, sf_dir):
    t = tables(spark, sf_dir)
    return analytics.top_department(t.appointments, t.doctors)


@register(
    "dashboard_stats",
    """
SELECT
  (SELECT COUNT(*) FROM appointments WHERE appointment_date = DATE '2025-07-01' AND status = 'booked') AS today,
  (SELECT COUNT(*) FROM appointments WHERE appointment_date = DATE '2025-07-02' AND status = 'booked') AS tomorrow,
  (SELECT COUNT(*) FROM patients) AS patients,
  (SELECT COUNT(*) FROM doctors) AS doctors""",
    (A, P, D),
)
def q_dashboard_stats(spark, sf_dir):
    t = tables(spark, sf_dir)
    return analytics.dashboard_stats(t.appointments, t.patients, t.doctors, AS_OF)


@register(
    "chart_series",
    """
WITH act AS (SELECT a.*, d.name, d.department FROM appointments a LEFT JOIN doctors d ON a.doctor_id = d.id
             WHERE a.status <> 'cancelled')
SELECT 'daily' AS series, CAST(appointment_date AS VARCHAR) AS label, COUNT(*) AS count,
  to_json({'appointment_date': appointment_date, 'count': COUNT(*)}) AS json
FROM act WHERE appointment_date BETWEEN DATE '2025-06-01' AND DATE '2025-07-01' GROUP BY appointment_date
UNION ALL
SELECT 'by_dept', department, COUNT(*), to_json({'department': department, 'count': COUNT(*)})
FROM act WHERE department IS NOT NULL GROUP BY department
UNION ALL
SELECT 'by_doctor', name, COUNT(*), to_json({'name': name, 'count': COUNT(*)})
FROM act WHERE name IS NOT NULL GROUP BY name""",
    (A, D),
)
def q_chart_series(spark, sf_dir):
    t = tables(spark, sf_dir)
    return analytics.chart_series(t.appointments, t.doctors, AS_OF)


# ================================================================== reports (R-1 .. R-5)


@register(
    "day_sheet",
    """
SELECT a.appointment_date, a.id, a.token_number, a.patient_name, a.patient_phone,
  d.name AS doctor_name, d.department, a.slot_time, a.status
FROM appointments a JOIN doctors d ON a.doctor_id = d.id
WHERE a.appointment_date IN (DATE '2025-07-01', DATE '2025-07-02')""",
    (A, D),
)
def q_day_sheet(spark, sf_dir):
    t = tables(spark, sf_dir)
    return reports.day_sheet(t.appointments, t.doctors, DAY_SHEET_DAYS)


_LISTING_SQL = """
SELECT a.id, a.token_number, a.patient_name, a.patient_phone, d.name AS doctor_name, d.department,
  d.id AS doctor_id, a.appointment_date, a.slot_time, a.status
FROM appointments a JOIN doctors d ON a.doctor_id = d.id"""


@register(
    "appointments_search",
    _LISTING_SQL + f"\nWHERE d.department = '{SEARCH_DEPARTMENT}' AND a.status = '{SEARCH_STATUS}'",
    (A, D),
)
def q_appointments_search(spark, sf_dir):
    t = tables(spark, sf_dir)
    return reports.appointments_listing(
        t.appointments, t.doctors, date="", doctor_id=None, department=SEARCH_DEPARTMENT, status=SEARCH_STATUS
    )


@register(
    "csv_export",
    f"""
SELECT token_number AS "Token", patient_name AS "Patient Name", patient_phone AS "Phone",
  doctor_name AS "Doctor", department AS "Department", appointment_date AS "Date",
  slot_time AS "Time", status AS "Status"
FROM ({_LISTING_SQL}) l""",
    (A, D),
)
def q_csv_export(spark, sf_dir):
    t = tables(spark, sf_dir)
    return reports.csv_rows(reports.appointments_listing(t.appointments, t.doctors))


@register(
    "listing_counts",
    f"""
SELECT (SELECT COUNT(*) FROM ({_LISTING_SQL}) l) AS appointments_listed,
  (SELECT COUNT(*) FROM patients) AS patients_listed""",
    (A, D, P),
)
def q_listing_counts(spark, sf_dir):
    t = tables(spark, sf_dir)
    return reports.listing_counts(reports.appointments_listing(t.appointments, t.doctors, sort=False), t.patients)


@register(
    "doctors_with_leaves",
    """
SELECT d.id, d.name, d.department, d.available_days, d.slot_duration_mins, d.start_time, d.end_time,
  COUNT(l.id) AS n_leaves,
  COALESCE(to_json(list({'id': l.id, 'leave_date': l.leave_date, 'reason': l.reason} ORDER BY l.leave_date)
                   FILTER (WHERE l.id IS NOT NULL)), '[]') AS leaves_json
FROM doctors d LEFT JOIN doctor_leaves l ON l.doctor_id = d.id
GROUP BY d.id, d.name, d.department, d.available_days, d.slot_duration_mins, d.start_time, d.end_time""",
    (D, L),
)
def q_doctors_with_leaves(spark, sf_dir):
    t = tables(spark, sf_dir)
    nested = reports.doctors_with_leaves(t.doctors, t.doctor_leaves)
    return nested.select(
        *[c for c in nested.columns if c != "leaves"],
        F.size("leaves").cast("bigint").alias("n_leaves"),
        F.to_json("leaves", {"ignoreNullFields": "false"}).alias("leaves_json"),
    )


@register(
    "doctor_leave_rows",
    """
SELECT d.id AS doctor_id, d.name, d.department, l.id AS leave_id, l.leave_date, l.reason
FROM doctors d LEFT JOIN doctor_leaves l ON l.doctor_id = d.id""",
    (D, L),
)
def q_doctor_leave_rows(spark, sf_dir):
    t = tables(spark, sf_dir)
    return reports.doctor_leave_rows(t.doctors, t.doctor_leaves)


_SUMMARY_SQL = """
SELECT p.id, p.name, p.phone, p.created_at, COUNT(a.id) AS total_appts, MAX(a.appointment_date) AS last_appt
FROM patients p LEFT JOIN appointments a ON p.phone = a.patient_phone
{where}
GROUP BY p.id, p.name, p.phone, p.created_at"""

_ASCII_FOLD = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register("patients_summary", _SUMMARY_SQL.format(where=""), (P, A))
def q_patients_summary(spark, sf_dir):
    t = tables(spark, sf_dir)
    return reports.patients_summary(t.patients, t.appointments)


@register(
    "patients_search",
    _SUMMARY_SQL.format(
        where=f"WHERE {_ASCII_FOLD.format(x='p.name')} LIKE '%{PATIENT_SEARCH.lower()}%' "
        f"OR {_ASCII_FOLD.format(x='p.phone')} LIKE '%{PATIENT_SEARCH.lower()}%'"
    ),
    (P, A),
)
def q_patients_search(spark, sf_dir):
    t = tables(spark, sf_dir)
    return reports.patients_summary(t.patients, t.appointments, search=PATIENT_SEARCH)


@register(
    "patients_table",
    f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY created_at DESC, id) AS BIGINT) AS row_no, id,
  COALESCE(NULLIF(name, ''), '—') AS name, phone, total_appts,
  COALESCE(CAST(last_appt AS VARCHAR), '—') AS last_appt,
  COALESCE(strftime(created_at, '%Y-%m-%d'), '—') AS registered
FROM ({_SUMMARY_SQL.format(where="")}) s""",
    (P, A),
)
def q_patients_table(spark, sf_dir):
    t = tables(spark, sf_dir)
    return reports.patients_table(reports.patients_summary(t.patients, t.appointments))


# ================================================================== lookups (S-2, S-3, F-1, A-10, P-3, S-4)


@register(
    "doctor_lookup",
    """
SELECT k.doctor_id, d.name, d.department, d.available_days, d.slot_duration_mins, d.start_time, d.end_time
FROM (SELECT DISTINCT doctor_id FROM appointments) k LEFT JOIN doctors d ON d.id = k.doctor_id""",
    (A, D),
)
def q_doctor_lookup(spark, sf_dir):
    t = tables(spark, sf_dir)
    return lookups.doctor_lookup(t.appointments, t.doctors)


@register(
    "session_lookup",
    "WITH " + LATEST_SESSION_CTE.strip() + """
SELECT m.phone, COALESCE(l.step, 'start') AS step, COALESCE(l.temp_data, '{}') AS temp_data
FROM (SELECT DISTINCT replace(from_number, 'whatsapp:', '') AS phone FROM messages) m LEFT JOIN latest l ON l.phone = m.phone""",
    (M, S),
)
def q_session_lookup(spark, sf_dir):
    t = tables(spark, sf_dir)
    phones = t.messages.select(F.col("from_number").alias("phone"))
    return lookups.session_lookup(phones, ledger.session_latest(t.session_updates))


@register(
    "doctors_by_department",
    """
SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY department ORDER BY id) AS BIGINT) AS menu_no FROM doctors""",
    (D,),
)
def q_doctors_by_department(spark, sf_dir):
    return lookups.doctors_by_department(tables(spark, sf_dir).doctors)


@register(
    "departments",
    """
SELECT department, CAST(ROW_NUMBER() OVER (ORDER BY department) AS BIGINT) AS menu_no
FROM (SELECT DISTINCT department FROM doctors) d""",
    (D,),
)
def q_departments(spark, sf_dir):
    return lookups.departments(tables(spark, sf_dir).doctors)


@register("doctor_options", "SELECT id, name, department FROM doctors", (D,))
def q_doctor_options(spark, sf_dir):
    return lookups.doctor_options(tables(spark, sf_dir).doctors)


@register(
    "seed_doctors",
    """
SELECT id, name, department, available_days, slot_duration_mins, start_time, end_time FROM doctors
UNION ALL
SELECT * FROM (VALUES
  (1, 'Dr. Ramesh Kumar', 'General OPD', 'Mon,Tue,Wed,Thu,Fri', 15, '09:00', '13:00'),
  (2, 'Dr. Priya Sharma', 'General OPD', 'Mon,Wed,Fri', 15, '10:00', '14:00'),
  (3, 'Dr. Anil Verma', 'Orthopedics', 'Tue,Thu,Sat', 20, '09:00', '12:00'),
  (4, 'Dr. Sunita Rao', 'Gynecology', 'Mon,Tue,Wed,Thu', 20, '10:00', '13:00'),
  (5, 'Dr. Kiran Mehta', 'Cardiology', 'Mon,Wed,Fri', 30, '09:00', '12:00'),
  (6, 'Dr. Deepak Singh', 'Pediatrics', 'Mon,Tue,Wed,Thu,Fri', 15, '09:00', '13:00')
) v(id, name, department, available_days, slot_duration_mins, start_time, end_time)
WHERE NOT EXISTS (SELECT 1 FROM doctors)""",
    (D,),
)
def q_seed_doctors(spark, sf_dir):
    return seed_doctors(tables(spark, sf_dir).doctors)


# ================================================================== availability (G-1 .. G-5, F-2, L-14)


@register("slot_grid", "WITH " + GRID_CTE.strip() + "\nSELECT doctor_id, slot_no, slot_time FROM grid", (D,))
def q_slot_grid(spark, sf_dir):
    return availability.slot_grid(tables(spark, sf_dir).doctors)


@register("available_dates", "WITH " + DATES_CTE.strip() + "\nSELECT doctor_id, date_no, available_date FROM dates", (D, L))
def q_available_dates(spark, sf_dir):
    t = tables(spark, sf_dir)
    return availability.available_dates(t.doctors, t.doctor_leaves, AS_OF)


@register(
    "booked_slots",
    """
SELECT DISTINCT doctor_id, appointment_date, slot_time FROM appointments WHERE status = 'booked'""",
    (A,),
)
def q_booked_slots(spark, sf_dir):
    sets = availability.booked_slot_sets(tables(spark, sf_dir).appointments)
    return sets.select("doctor_id", "appointment_date", F.explode("_booked").alias("slot_time"))


@register(
    "available_slots",
    "WITH " + GRID_CTE.strip() + """,
req AS (SELECT DISTINCT doctor_id, appointment_date FROM appointments),
free AS (
  SELECT r.doctor_id, r.appointment_date, g.m, g.slot_time FROM req r JOIN grid g ON g.doctor_id = r.doctor_id
  WHERE NOT EXISTS (SELECT 1 FROM appointments a WHERE a.doctor_id = r.doctor_id
    AND a.appointment_date = r.appointment_date AND a.slot_time = g.slot_time AND a.status = 'booked'))
SELECT doctor_id, appointment_date,
  CAST(ROW_NUMBER() OVER (PARTITION BY doctor_id, appointment_date ORDER BY m) AS INTEGER) AS slot_no, slot_time
FROM free""",
    (A, D),
)
def q_available_slots(spark, sf_dir):
    t = tables(spark, sf_dir)
    return availability.available_slots(t.doctors, t.appointments, t.appointments)


@register(
    "availability_calendar",
    "WITH " + GRID_CTE.strip() + "," + DATES_CTE + """,
free AS (
  SELECT d.department, d.id AS doctor_id, d.name AS doctor_name, x.date_no, x.available_date AS appointment_date,
    g.m, g.slot_time
  FROM dates x JOIN doctors d ON d.id = x.doctor_id JOIN grid g ON g.doctor_id = x.doctor_id
  WHERE NOT EXISTS (SELECT 1 FROM appointments a WHERE a.doctor_id = x.doctor_id
    AND a.appointment_date = x.available_date AND a.slot_time = g.slot_time AND a.status = 'booked'))
SELECT department, doctor_id, doctor_name, date_no, appointment_date,
  CAST(ROW_NUMBER() OVER (PARTITION BY doctor_id, appointment_date ORDER BY m) AS INTEGER) AS slot_no, slot_time
FROM free""",
    (A, D, L),
)
def q_availability_calendar(spark, sf_dir):
    t = tables(spark, sf_dir)
    return availability.availability_calendar(t.doctors, t.doctor_leaves, t.appointments, AS_OF)


@register(
    "menu_text",
    "WITH " + DATES_CTE.strip() + f"""
SELECT d.id AS doctor_id,
  COALESCE(string_agg(CAST(x.date_no AS VARCHAR) || '. ' || {_day_label('x.available_date')}, chr(10)
                      ORDER BY x.date_no), '') AS menu_text
FROM doctors d LEFT JOIN dates x ON x.doctor_id = d.id GROUP BY d.id""",
    (D, L),
)
def q_menu_text(spark, sf_dir):
    t = tables(spark, sf_dir)
    return availability.date_menu_text(t.doctors, t.doctor_leaves, AS_OF)


@register(
    "display_dates",
    f"SELECT DISTINCT appointment_date, {_day_label('appointment_date')} AS label FROM appointments",
    (A,),
)
def q_display_dates(spark, sf_dir):
    return availability.display_dates(tables(spark, sf_dir).appointments)


# ================================================================== ledger (W-1, W-2, A-11, D-1 .. D-10)


@register(
    "token_numbers",
    """
SELECT id, doctor_id, appointment_date,
  CAST(ROW_NUMBER() OVER (PARTITION BY doctor_id, appointment_date ORDER BY id) AS BIGINT) AS token_number
FROM appointments_base""",
    ("appointments_base",),
)
def q_token_numbers(spark, sf_dir):
    return ledger.token_numbers(tables(spark, sf_dir).appointments.drop("token_number"))


@register(
    "day_load",
    """
SELECT doctor_id, appointment_date, COUNT(*) AS count FROM appointments_base GROUP BY doctor_id, appointment_date""",
    ("appointments_base",),
)
def q_day_load(spark, sf_dir):
    return ledger.day_load(tables(spark, sf_dir).appointments)


@register(
    "next_appointment",
    "WITH " + NEXT_CTE.strip() + """
SELECT id, patient_phone, patient_name, doctor_id, appointment_date, slot_time, token_number, status,
  doctor_name, department FROM nxt""",
    (A, D),
)
def q_next_appointment(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ledger.next_appointment(t.appointments, t.doctors)


def _outcomes(t):
    led, req = t.ledger_split()
    return ledger.book_requests(led, req, t.doctors, t.doctor_leaves)


@register(
    "book_requests",
    "WITH " + BOOK_CTE.strip() + "\nSELECT * FROM outcomes",
    ("ledger", "requests", D, L),
)
def q_book_requests(spark, sf_dir):
    return _outcomes(tables(spark, sf_dir))


@register(
    "booking_conflicts",
    """
SELECT r.* FROM requests r WHERE EXISTS (
  SELECT 1 FROM ledger g WHERE g.status = 'booked' AND g.doctor_id = r.doctor_id
    AND g.appointment_date = r.appointment_date AND g.slot_time = r.slot_time)""",
    ("ledger", "requests"),
)
def q_booking_conflicts(spark, sf_dir):
    led, req = tables(spark, sf_dir).ledger_split()
    return ledger.booking_conflicts(led, req)


@register(
    "leave_conflicts",
    """
SELECT r.* FROM appointments r WHERE EXISTS (
  SELECT 1 FROM doctor_leaves l WHERE l.doctor_id = r.doctor_id AND l.leave_date = r.appointment_date)""",
    (A, L),
)
def q_leave_conflicts(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ledger.leave_conflicts(t.appointments, t.doctor_leaves)


@register(
    "ledger_after_booking",
    "WITH " + BOOK_CTE.strip() + """
SELECT id, patient_phone, patient_name, doctor_id, appointment_date, slot_time, token_number, status FROM ledger
UNION ALL
SELECT id, patient_phone, patient_name, doctor_id, appointment_date, slot_time, token_number, 'booked'
FROM outcomes WHERE outcome = 'accepted'""",
    ("ledger", "requests", D, L),
)
def q_ledger_after_booking(spark, sf_dir):
    t = tables(spark, sf_dir)
    led, req = t.ledger_split()
    return ledger.apply_bookings(led, ledger.book_requests(led, req, t.doctors, t.doctor_leaves))


@register(
    "patient_upsert",
    "WITH " + BOOK_CTE.strip() + f""",
inc AS (
  SELECT {_phone_key('patient_phone')} AS k, patient_phone, patient_name, id,
    ROW_NUMBER() OVER (PARTITION BY {_phone_key('patient_phone')} ORDER BY id DESC) AS rn_last,
    MIN(id) OVER (PARTITION BY {_phone_key('patient_phone')}) AS first_id
  FROM outcomes WHERE outcome = 'accepted'),
last AS (SELECT * FROM inc WHERE rn_last = 1),
pk AS (SELECT *, {_phone_key('phone')} AS k FROM patients)
SELECT p.id, CASE WHEN l.k IS NOT NULL THEN l.patient_name ELSE p.name END AS name, p.phone, p.created_at
FROM pk p LEFT JOIN last l ON l.k = p.k
UNION ALL
SELECT (SELECT COALESCE(MAX(id), 0) FROM patients) + ROW_NUMBER() OVER (ORDER BY l.first_id) AS id,
  l.patient_name AS name, l.patient_phone AS phone, CAST(DATE '2025-07-01' AS TIMESTAMP) AS created_at
FROM last l WHERE NOT EXISTS (SELECT 1 FROM pk p WHERE p.k = l.k)""",
    ("ledger", "requests", D, L, P),
)
def q_patient_upsert(spark, sf_dir):
    t = tables(spark, sf_dir)
    accepted = _outcomes(t).where(F.col("outcome") == ledger.ACCEPTED)
    return ledger.patient_upsert(t.patients, accepted, AS_OF)


@register("session_latest", "WITH " + LATEST_SESSION_CTE.strip() + "\nSELECT * FROM latest", (S,))
def q_session_latest(spark, sf_dir):
    return ledger.session_latest(tables(spark, sf_dir).session_updates)


@register(
    "session_reset",
    "WITH " + VALID_MESSAGES_CTE.strip() + """,
allw AS (
  SELECT replace(phone, 'whatsapp:', '') AS phone, step, temp_data, updated_at, seq FROM session_updates
  UNION ALL
  SELECT phone, 'start', '{}', ts, id FROM valid WHERE text IN ('cancel', 'cancel appointment'))
SELECT phone, step, temp_data, updated_at FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY phone ORDER BY updated_at DESC, seq DESC) AS rn FROM allw) s
WHERE rn = 1""",
    (S, M),
)
def q_session_reset(spark, sf_dir):
    t = tables(spark, sf_dir)
    cancels = ingest.tagged_messages(t.messages).where(F.col("intent") == "cancel")
    resets = cancels.select("phone", F.col("ts").alias("updated_at"), F.col("id").alias("seq"))
    return ledger.session_reset(t.session_updates, resets)


def _cancel_requests(t):
    tagged = ingest.tagged_messages(t.messages).where(F.col("intent") == "cancel")
    return tagged.select("phone", F.col("id").alias("request_id"), "ts")


@register(
    "cancel_earliest",
    "WITH " + VALID_MESSAGES_CTE.strip() + "," + CANCEL_CTE + "\nSELECT * FROM cancels",
    (M, A, D),
)
def q_cancel_earliest(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ledger.cancel_earliest(t.appointments, t.doctors, _cancel_requests(t))


_STATUS_SET_SQL = """
SELECT id, patient_phone, patient_name, doctor_id, appointment_date, slot_time, token_number,
  CASE WHEN id IN (SELECT id FROM {ids}) THEN '{status}' ELSE status END AS status
FROM appointments"""


@register("cancel_by_id", _STATUS_SET_SQL.format(ids="admin_cancel_ids", status="cancelled"), (A, "admin_cancel_ids"))
def q_cancel_by_id(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ledger.cancel_by_id(t.appointments, t.admin_cancel_ids)


@register(
    "complete_by_id", _STATUS_SET_SQL.format(ids="admin_complete_ids", status="completed"), (A, "admin_complete_ids")
)
def q_complete_by_id(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ledger.complete_by_id(t.appointments, t.admin_complete_ids)


_LEAVE_INSERT_CTE = """
parsed AS (SELECT *, TRY_CAST(leave_date AS DATE) AS d FROM leave_requests),
firsts AS (
  SELECT doctor_id, d AS leave_date, request_id, reason,
    ROW_NUMBER() OVER (PARTITION BY doctor_id, d ORDER BY request_id) AS rn
  FROM parsed WHERE d IS NOT NULL),
fresh AS (
  SELECT * FROM firsts f WHERE rn = 1 AND NOT EXISTS (
    SELECT 1 FROM doctor_leaves l WHERE l.doctor_id = f.doctor_id AND l.leave_date = f.leave_date))"""


@register(
    "leave_insert",
    "WITH " + _LEAVE_INSERT_CTE.strip() + """
SELECT id, doctor_id, leave_date, reason FROM doctor_leaves
UNION ALL
SELECT (SELECT MAX(id) FROM doctor_leaves) + ROW_NUMBER() OVER (ORDER BY request_id) AS id,
  doctor_id, leave_date, reason FROM fresh""",
    (L, "leave_requests"),
)
def q_leave_insert(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ledger.leave_insert(t.doctor_leaves, t.leave_requests)


@register(
    "leave_errors",
    """
SELECT request_id, doctor_id, leave_date, 'invalid_date' AS error FROM leave_requests
WHERE TRY_CAST(leave_date AS DATE) IS NULL""",
    ("leave_requests",),
)
def q_leave_errors(spark, sf_dir):
    return ledger.leave_errors(tables(spark, sf_dir).leave_requests)


MARKED_CTE = """
marked AS (
  SELECT a.id AS appointment_id, a.patient_phone, d.name AS doctor_name, a.appointment_date, a.slot_time
  FROM appointments a JOIN doctors d ON a.doctor_id = d.id
  WHERE a.status = 'booked' AND EXISTS (
    SELECT 1 FROM leave_requests r
    WHERE r.doctor_id = a.doctor_id AND TRY_CAST(r.leave_date AS DATE) = a.appointment_date))"""


@register(
    "mark_leave",
    "WITH " + MARKED_CTE.strip() + f"""
SELECT appointment_id, {_address('patient_phone')} AS to_address, {LEAVE_NOTICE_BODY} AS body FROM marked""",
    (A, D, "leave_requests"),
)
def q_mark_leave(spark, sf_dir):
    t = tables(spark, sf_dir)
    marked = ledger.mark_leave(t.appointments, t.doctors, t.doctor_leaves, t.leave_requests)
    return messaging.leave_notices(marked.cancelled)


@register(
    "ledger_after_mark_leave",
    "WITH " + MARKED_CTE.strip() + """
SELECT id, patient_phone, patient_name, doctor_id, appointment_date, slot_time, token_number,
  CASE WHEN id IN (SELECT appointment_id FROM marked) THEN 'cancelled' ELSE status END AS status
FROM appointments""",
    (A, D, "leave_requests"),
)
def q_ledger_after_mark_leave(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ledger.mark_leave(t.appointments, t.doctors, t.doctor_leaves, t.leave_requests).ledger


@register("leave_cascade", "WITH " + HITS_CTE.strip() + "\nSELECT * FROM hits", (A, D, L))
def q_leave_cascade(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ledger.leave_cascade(t.appointments, t.doctors, t.doctor_leaves)


@register(
    "leave_delete",
    f"""
SELECT id, doctor_id, leave_date, reason FROM doctor_leaves
WHERE id NOT IN (SELECT id FROM doctor_leaves WHERE reason = '{DELETED_LEAVE_REASON}')""",
    (L,),
)
def q_leave_delete(spark, sf_dir):
    t = tables(spark, sf_dir)
    ids = t.doctor_leaves.where(F.col("reason") == DELETED_LEAVE_REASON).select("id")
    return ledger.leave_delete(t.doctor_leaves, ids)


# ================================================================== messaging (P-6 .. P-10, A-12, S-9, R-7)


@register(
    "reminders",
    "WITH " + REMINDER_CTE.strip() + f"""
SELECT id AS appointment_id, {_address('patient_phone')} AS to_address, {REMINDER_BODY} AS body FROM tmrw""",
    (A, D),
)
def q_reminders(spark, sf_dir):
    t = tables(spark, sf_dir)
    return messaging.reminders(t.appointments, t.doctors, AS_OF)


@register(
    "reminder_summary",
    "WITH " + REMINDER_CTE.strip() + f"""
SELECT CAST(0 AS BIGINT) AS line_no, '{'whatsapp:' + ADMIN_PHONE}' AS to_address,
  {sql_render(T.SUMMARY_HEADER, day="'2025-07-02'", count="(SELECT COUNT(*) FROM tmrw)")} AS text
UNION ALL
SELECT CAST(ROW_NUMBER() OVER (ORDER BY id) AS BIGINT), '{'whatsapp:' + ADMIN_PHONE}',
  {sql_render(T.SUMMARY_LINE, patient_name=_none('patient_name'), doctor_name=_none('doctor_name'),
              slot_time=_none('slot_time'))}
FROM tmrw""",
    (A, D),
)
def q_reminder_summary(spark, sf_dir):
    t = tables(spark, sf_dir)
    return messaging.reminder_summary(t.appointments, t.doctors, AS_OF, ADMIN_PHONE)


@register(
    "cancel_notices",
    "WITH " + ADMIN_CANCEL_CTE.strip() + f"""
SELECT appointment_id, {_address('patient_phone')} AS to_address, {ADMIN_NOTICE_BODY} AS body FROM admin_hits""",
    (A, D, "admin_cancel_ids"),
)
def q_cancel_notices(spark, sf_dir):
    t = tables(spark, sf_dir)
    return messaging.cancel_notices(t.appointments, t.doctors, t.admin_cancel_ids)


@register(
    "leave_notices",
    "WITH " + HITS_CTE.strip() + f"""
SELECT appointment_id, {_address('patient_phone')} AS to_address, {LEAVE_NOTICE_BODY} AS body FROM hits""",
    (A, D, L),
)
def q_leave_notices(spark, sf_dir):
    t = tables(spark, sf_dir)
    return messaging.leave_notices(ledger.leave_cascade(t.appointments, t.doctors, t.doctor_leaves))


_CONFIRM_BODY = f"""CASE outcome
  WHEN 'accepted' THEN {sql_render(T.BOOKING_CONFIRMED, name=_none('patient_name'), department=_none('department'),
                                    doctor_name=_none('doctor_name'), day=_day_label('appointment_date'),
                                    slot_time=_none('slot_time'), token_number=_none('token_number'))}
  WHEN 'slot_taken' THEN {sql_render(T.SLOT_TAKEN_REPLY)}
  WHEN 'on_leave' THEN {sql_render(T.ON_LEAVE_REPLY, doctor_name=_none('doctor_name'), day=_day_label('appointment_date'))}
END"""


@register(
    "booking_confirmations",
    "WITH " + BOOK_CTE.strip() + f"""
SELECT o.id AS request_id, {_address('o.patient_phone')} AS to_address, o.outcome, {_CONFIRM_BODY} AS body
FROM (SELECT x.*, d.name AS doctor_name, d.department FROM outcomes x JOIN doctors d ON d.id = x.doctor_id) o""",
    ("ledger", "requests", D, L),
)
def q_booking_confirmations(spark, sf_dir):
    t = tables(spark, sf_dir)
    return messaging.booking_confirmations(_outcomes(t), t.doctors)


@register(
    "cancel_replies",
    "WITH " + VALID_MESSAGES_CTE.strip() + "," + CANCEL_CTE + f"""
SELECT request_id, {_address('phone')} AS to_address,
  CASE WHEN outcome = 'cancelled' THEN {sql_render(T.CANCEL_DONE_REPLY, doctor_name=_none('doctor_name'),
                                                   day=_day_label('appointment_date'), slot_time=_none('slot_time'))}
       ELSE {sql_render(T.CANCEL_NONE_REPLY)} END AS body
FROM cancels""",
    (M, A, D),
)
def q_cancel_replies(spark, sf_dir):
    t = tables(spark, sf_dir)
    return messaging.cancel_replies(ledger.cancel_earliest(t.appointments, t.doctors, _cancel_requests(t)))


@register(
    "status_cards",
    "WITH " + VALID_MESSAGES_CTE.strip() + "," + NEXT_CTE + f"""
SELECT v.id AS request_id, {_address('v.phone')} AS to_address,
  CASE WHEN n.id IS NOT NULL THEN {sql_render(T.STATUS_CARD, department=_none('n.department'),
                                              doctor_name=_none('n.doctor_name'), day=_day_label('n.appointment_date'),
                                              slot_time=_none('n.slot_time'), token_number=_none('n.token_number'))}
       ELSE {sql_render(T.STATUS_NONE_REPLY)} END AS body
FROM valid v LEFT JOIN nxt n ON {_phone_key('n.patient_phone')} = {_phone_key('v.phone')}
WHERE v.text IN ('status', 'my appointment', 'appointment')""",
    (M, A, D),
)
def q_status_cards(spark, sf_dir):
    t = tables(spark, sf_dir)
    req = ingest.tagged_messages(t.messages).where(F.col("intent") == "status").select(
        F.col("id").alias("request_id"), "phone"
    )
    return messaging.status_cards(req, t.appointments, t.doctors)


@register(
    "outbox",
    "WITH " + REMINDER_CTE.strip() + "," + ADMIN_CANCEL_CTE + "," + HITS_CTE + f"""
SELECT 'reminder' AS kind, id AS ref_id, {_address('patient_phone')} AS to_address, {REMINDER_BODY} AS body,
  DATE '2025-07-01' AS as_of FROM tmrw
UNION ALL
SELECT 'cancel_notice', appointment_id, {_address('patient_phone')}, {ADMIN_NOTICE_BODY}, DATE '2025-07-01'
FROM admin_hits
UNION ALL
SELECT 'leave_notice', appointment_id, {_address('patient_phone')}, {LEAVE_NOTICE_BODY}, DATE '2025-07-01'
FROM hits""",
    (A, D, L, "admin_cancel_ids"),
)
def q_outbox(spark, sf_dir):
    t = tables(spark, sf_dir)
    notices = {
        "reminder": messaging.reminders(t.appointments, t.doctors, AS_OF),
        "cancel_notice": messaging.cancel_notices(t.appointments, t.doctors, t.admin_cancel_ids),
        "leave_notice": messaging.leave_notices(ledger.leave_cascade(t.appointments, t.doctors, t.doctor_leaves)),
    }
    return messaging.outbox(notices, AS_OF)


# ================================================================== quality (F-10, J-9)


@register(
    "dangling_appointments",
    "SELECT a.* FROM appointments a WHERE NOT EXISTS (SELECT 1 FROM doctors d WHERE d.id = a.doctor_id)",
    (A, D),
)
def q_dangling_appointments(spark, sf_dir):
    t = tables(spark, sf_dir)
    return quality.dangling_appointments(t.appointments, t.doctors)


@register(
    "constraint_violations",
    """
SELECT 'appointments' AS table_name, 'check_status' AS rule, CAST(id AS VARCHAR) AS row_key FROM dirty_appointments
  WHERE status IS NOT NULL AND status NOT IN ('booked', 'cancelled', 'completed')
UNION ALL SELECT 'appointments', 'not_null', CAST(id AS VARCHAR) FROM dirty_appointments
  WHERE patient_phone IS NULL OR doctor_id IS NULL OR appointment_date IS NULL OR slot_time IS NULL
UNION ALL SELECT 'appointments', 'fk_doctor', CAST(id AS VARCHAR) FROM dirty_appointments a
  WHERE doctor_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dirty_doctors d WHERE d.id = a.doctor_id)
UNION ALL SELECT 'appointments', 'unique_id', CAST(id AS VARCHAR) FROM dirty_appointments
  GROUP BY id HAVING COUNT(*) > 1
UNION ALL SELECT 'patients', 'not_null', CAST(id AS VARCHAR) FROM dirty_patients WHERE phone IS NULL
UNION ALL SELECT 'patients', 'unique_phone', phone FROM dirty_patients WHERE phone IS NOT NULL
  GROUP BY phone HAVING COUNT(*) > 1
UNION ALL SELECT 'patients', 'unique_id', CAST(id AS VARCHAR) FROM dirty_patients GROUP BY id HAVING COUNT(*) > 1
UNION ALL SELECT 'doctors', 'not_null', CAST(id AS VARCHAR) FROM dirty_doctors
  WHERE name IS NULL OR department IS NULL OR available_days IS NULL
UNION ALL SELECT 'doctors', 'unique_id', CAST(id AS VARCHAR) FROM dirty_doctors GROUP BY id HAVING COUNT(*) > 1
UNION ALL SELECT 'doctor_leaves', 'not_null', CAST(id AS VARCHAR) FROM dirty_doctor_leaves
  WHERE doctor_id IS NULL OR leave_date IS NULL
UNION ALL SELECT 'doctor_leaves', 'unique_doctor_day', CAST(doctor_id AS VARCHAR) || '|' || CAST(leave_date AS VARCHAR)
  FROM dirty_doctor_leaves WHERE doctor_id IS NOT NULL AND leave_date IS NOT NULL
  GROUP BY doctor_id, leave_date HAVING COUNT(*) > 1
UNION ALL SELECT 'doctor_leaves', 'fk_doctor', CAST(id AS VARCHAR) FROM dirty_doctor_leaves l
  WHERE doctor_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dirty_doctors d WHERE d.id = l.doctor_id)
UNION ALL SELECT 'doctor_leaves', 'unique_id', CAST(id AS VARCHAR) FROM dirty_doctor_leaves
  GROUP BY id HAVING COUNT(*) > 1
UNION ALL SELECT 'sessions', 'unique_phone', phone FROM session_updates GROUP BY phone HAVING COUNT(*) > 1""",
    ("dirty_appointments", "dirty_doctors", "dirty_patients", "dirty_doctor_leaves", S),
)
def q_constraint_violations(spark, sf_dir):
    t = tables(spark, sf_dir)
    return quality.constraint_violations(
        dirty(t.patients, P), dirty(t.doctors, D), dirty(t.appointments, A), dirty(t.doctor_leaves, L), t.session_updates
    )


# ================================================================== messages and state (T-1, T-2, L-3, L-18, L-21)


@register(
    "message_log",
    """
SELECT id, replace(from_number, 'whatsapp:', '') AS phone, 'incoming' AS event, trim(body) AS details,
  ts AS created_at
FROM messages WHERE length(from_number) > 0 AND length(trim(body)) > 0""",
    (M,),
)
def q_message_log(spark, sf_dir):
    return ingest.message_log(tables(spark, sf_dir).messages)


@register(
    "intent_classification",
    "WITH " + VALID_MESSAGES_CTE.strip() + """
SELECT id, phone, ts, text,
  CASE WHEN text IN ('cancel', 'cancel appointment') THEN 'cancel'
       WHEN text IN ('status', 'my appointment', 'appointment') THEN 'status'
       WHEN text IN ('hi', 'hello', 'hey', 'book', 'start', 'menu', '0', 'home') THEN 'greet'
       ELSE 'other' END AS intent
FROM valid""",
    (M,),
)
def q_intent_classification(spark, sf_dir):
    return ingest.tagged_messages(tables(spark, sf_dir).messages)


@register(
    "menu_selection",
    "WITH " + VALID_MESSAGES_CTE.strip() + """,
depts AS (SELECT department, CAST(ROW_NUMBER() OVER (ORDER BY department) AS INTEGER) AS menu_no
          FROM (SELECT DISTINCT department FROM doctors) d),
picks AS (SELECT id, text,
  CASE WHEN regexp_full_match(text, '[+-]?[0-9]+') THEN TRY_CAST(text AS INTEGER) END AS choice FROM valid)
SELECT p.id, p.text, p.choice, d.department FROM picks p LEFT JOIN depts d ON d.menu_no = p.choice""",
    (M, D),
)
def q_menu_selection(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ingest.menu_selection(t.messages, lookups.departments(t.doctors))


@register(
    "name_titlecase",
    # Python's str.title: a character is title-cased when the one before it is
    # not a cased letter, lower-cased otherwise.  Fixed value: the titlecase
    # of 'ß' is 'Ss' (DuckDB's upper() would give 'ẞ').
    r"""
WITH v AS (SELECT id, string_split(lower(trim(body)), '') AS ch FROM messages
           WHERE length(from_number) > 0 AND length(trim(body)) > 0),
t AS (SELECT id, array_to_string(list_transform(ch, lambda x, i:
        CASE WHEN i > 1 AND regexp_matches(ch[i - 1], '[\p{Lu}\p{Ll}\p{Lt}]') THEN x
             WHEN x = 'ß' THEN 'Ss' ELSE upper(x) END), '') AS name FROM v)
SELECT id, name FROM t WHERE length(name) >= 2""",
    (M,),
)
def q_name_titlecase(spark, sf_dir):
    return ingest.name_titlecase(tables(spark, sf_dir).messages)


@register(
    "session_payload",
    "WITH " + DATES_CTE.strip() + """,
menu AS (
  SELECT d.*, COALESCE(list(CAST(x.available_date AS VARCHAR) ORDER BY x.date_no)
                       FILTER (WHERE x.available_date IS NOT NULL), []) AS dates
  FROM doctors d LEFT JOIN dates x ON x.doctor_id = d.id
  GROUP BY d.id, d.name, d.department, d.available_days, d.slot_duration_mins, d.start_time, d.end_time)
SELECT id AS doctor_id, 'choose_date' AS step,
  to_json({'dept': department, 'doctor': {'id': id, 'name': name, 'department': department,
           'available_days': available_days, 'slot_duration_mins': slot_duration_mins,
           'start_time': start_time, 'end_time': end_time}, 'dates': dates}) AS temp_data,
  department AS dept, name AS doctor_name, CAST(len(dates) AS INTEGER) AS n_dates
FROM menu""",
    (D, L),
)
def q_session_payload(spark, sf_dir):
    t = tables(spark, sf_dir)
    menu = availability.with_date_menu(t.doctors, t.doctor_leaves, AS_OF)
    doctor = F.struct(*[F.col(c) for c in ["id", "name", "department", "available_days", "slot_duration_mins",
                                            "start_time", "end_time"]])
    payload = F.struct(
        F.col("department").alias("dept"), doctor.alias("doctor"),
        F.transform("dates", lambda d: d.cast("string")).alias("dates"),
    )
    written = menu.select(F.col("id").alias("doctor_id"), dump_payload(payload).alias("temp_data"))
    parsed = written.withColumn("_p", parse_payload("temp_data"))
    return parsed.select(
        "doctor_id", F.lit("choose_date").alias("step"), "temp_data",
        F.col("_p.dept").alias("dept"), F.col("_p.doctor.name").alias("doctor_name"),
        F.size("_p.dates").alias("n_dates"),
    )


# One message after the other, phone by phone.
WALK_CTE = VALID_MESSAGES_CTE + "," + GRID_CTE + "," + DATES_CTE + r""",
depts AS (SELECT department, ROW_NUMBER() OVER (ORDER BY department) AS k FROM (SELECT DISTINCT department FROM doctors) d),
offered AS (
  SELECT x.doctor_id, x.date_no AS k, CAST(x.available_date AS VARCHAR) AS day, g.slot_no, g.slot_time
  FROM dates x LEFT JOIN grid g ON g.doctor_id = x.doctor_id AND NOT EXISTS (
    SELECT 1 FROM appointments a WHERE a.status = 'booked' AND a.doctor_id = x.doctor_id
      AND a.appointment_date = x.available_date AND a.slot_time = g.slot_time)),
docs AS (
  SELECT department, id AS doctor_id, ROW_NUMBER() OVER (PARTITION BY department ORDER BY id) AS k,
    EXISTS (SELECT 1 FROM dates x WHERE x.doctor_id = d.id) AS open
  FROM doctors d WHERE department IS NOT NULL),
days AS (SELECT doctor_id, k, day, COUNT(slot_time) > 0 AS open FROM offered GROUP BY doctor_id, k, day),
free AS (
  SELECT doctor_id, day, slot_time, ROW_NUMBER() OVER (PARTITION BY doctor_id, day ORDER BY slot_no) AS k
  FROM offered WHERE slot_time IS NOT NULL),
letters AS (SELECT id, string_split(text, '') AS ch FROM valid),
names AS (
  SELECT id, array_to_string(list_transform(ch, lambda x, i:
    CASE WHEN i > 1 AND regexp_matches(ch[i - 1], '[\p{Lu}\p{Ll}\p{Lt}]') THEN x
         WHEN x = 'ß' THEN 'Ss' ELSE upper(x) END), '') AS name
  FROM letters),
said AS (
  SELECT v.id, v.phone, v.ts, n.name, ROW_NUMBER() OVER (PARTITION BY v.phone ORDER BY v.ts, v.id) AS p,
    CASE WHEN text IN ('cancel', 'cancel appointment') THEN 'cancel'
         WHEN text IN ('status', 'my appointment', 'appointment') THEN 'status'
         WHEN text IN ('hi', 'hello', 'hey', 'book', 'start', 'menu', '0', 'home') THEN 'greet'
         ELSE 'other' END AS intent,
    CASE WHEN regexp_full_match(text, '[+-]?[0-9]+') THEN TRY_CAST(ltrim(text, '+') AS INTEGER) END AS k
  FROM valid v JOIN names n USING (id)),
walk AS (
  SELECT DISTINCT phone, CAST(0 AS BIGINT) AS p, CAST(NULL AS BIGINT) AS id, CAST('' AS VARCHAR) AS from_step, CAST('start' AS VARCHAR) AS step,
    CAST(NULL AS VARCHAR) AS dept, CAST(NULL AS BIGINT) AS doctor_id, CAST(NULL AS VARCHAR) AS day,
    CAST(NULL AS VARCHAR) AS slot, CAST(NULL AS VARCHAR) AS reply, CAST(NULL AS VARCHAR) AS booking
  FROM said
  UNION ALL
  SELECT m.phone, m.p, m.id, w.step,
    CASE r.reply WHEN 'cancel' THEN 'start' WHEN 'departments' THEN 'choose_dept' WHEN 'doctors' THEN 'choose_doctor'
      WHEN 'dates' THEN 'choose_date' WHEN 'slots' THEN 'choose_slot' WHEN 'book' THEN 'start' WHEN 'on_leave' THEN 'start'
      WHEN 'ask_name' THEN 'confirm_name' ELSE w.step END,
    CASE WHEN r.reply IN ('cancel', 'departments', 'book', 'on_leave') THEN NULL ELSE COALESCE(w.dept, e.department) END,
    CASE WHEN r.reply IN ('cancel', 'departments', 'book', 'on_leave') THEN NULL ELSE COALESCE(w.doctor_id, CASE WHEN r.reply = 'dates' THEN o.doctor_id END) END,
    CASE WHEN r.reply IN ('cancel', 'departments', 'book', 'on_leave') THEN NULL ELSE COALESCE(w.day, CASE WHEN r.reply = 'slots' THEN d.day END) END,
    CASE WHEN r.reply IN ('cancel', 'departments', 'book', 'on_leave') THEN NULL ELSE COALESCE(w.slot, f.slot_time) END,
    r.reply, CASE WHEN r.reply = 'book' THEN CAST(w.doctor_id AS VARCHAR) || '|' || w.day || '|' || w.slot END
  FROM walk w JOIN said m ON m.phone = w.phone AND m.p = w.p + 1
  LEFT JOIN depts e ON w.step = 'choose_dept' AND m.intent = 'other' AND e.k = m.k
  LEFT JOIN docs o ON w.step = 'choose_doctor' AND m.intent = 'other' AND o.department = w.dept AND o.k = m.k
  LEFT JOIN days d ON w.step = 'choose_date' AND m.intent = 'other' AND d.doctor_id = w.doctor_id AND d.k = m.k
  LEFT JOIN free f ON w.step = 'choose_slot' AND m.intent = 'other' AND f.doctor_id = w.doctor_id AND f.day = w.day AND f.k = m.k
  LEFT JOIN (SELECT DISTINCT doctor_id, CAST(leave_date AS VARCHAR) AS day FROM doctor_leaves) l
    ON w.step = 'confirm_name' AND l.doctor_id = w.doctor_id AND l.day = w.day
  CROSS JOIN LATERAL (SELECT CASE
    WHEN m.intent IN ('cancel', 'status') THEN m.intent
    WHEN m.intent = 'greet' OR w.step = 'start' THEN 'departments'
    WHEN w.step = 'choose_dept' THEN CASE WHEN e.k IS NOT NULL THEN 'doctors' ELSE 'reprompt' END
    WHEN w.step = 'choose_doctor' THEN CASE WHEN o.open THEN 'dates' WHEN o.k IS NOT NULL THEN 'no_dates' ELSE 'reprompt' END
    WHEN w.step = 'choose_date' THEN CASE WHEN d.open THEN 'slots' WHEN d.k IS NOT NULL THEN 'no_slots' ELSE 'reprompt' END
    WHEN w.step = 'choose_slot' THEN CASE WHEN f.k IS NOT NULL THEN 'ask_name' ELSE 'reprompt' END
    WHEN length(m.name) < 2 THEN 'ask_name' WHEN l.day IS NOT NULL THEN 'on_leave' ELSE 'book' END AS reply) r)"""
_RECURSIVE = "WITH RECURSIVE " + WALK_CTE.strip()


def _dialogue(t):
    menus = dialogue.menu_tables(t.doctors, t.doctor_leaves, t.appointments, AS_OF)
    return dialogue.dialogue_steps(ingest.tagged_messages(t.messages), menus)


@register(
    "conversation_steps",
    _RECURSIVE + """
SELECT w.phone, w.id AS msg_id, s.ts, s.intent, w.from_step, w.step AS to_step,
  CASE WHEN w.reply IN ('cancel', 'status', 'book') THEN w.reply END AS command,
  CAST(split_part(w.booking, '|', 1) AS BIGINT) AS doctor_id, split_part(w.booking, '|', 2) AS date,
  split_part(w.booking, '|', 3) AS slot, CASE WHEN w.reply = 'book' THEN s.name END AS name, w.reply AS reply_kind,
  w.dept AS at_dept, w.doctor_id AS at_doctor_id, w.day AS at_date, w.slot AS at_slot
FROM walk w JOIN said s ON s.id = w.id""",
    (M, D, L, A),
)
def q_conversation_steps(spark, sf_dir):
    return _dialogue(tables(spark, sf_dir))


@register(
    "sessions_after",
    _RECURSIVE + """
SELECT w.phone, w.step, w.dept, w.doctor_id, w.day AS date, w.slot, s.ts AS updated_at
FROM walk w JOIN said s ON s.id = w.id
QUALIFY ROW_NUMBER() OVER (PARTITION BY w.phone ORDER BY w.p DESC) = 1""",
    (M, D, L, A),
)
def q_sessions_after(spark, sf_dir):
    return dialogue.sessions_after(_dialogue(tables(spark, sf_dir)))


def _commands(t):
    """Bookings of the second half of the appointments, between the cancel and status words of the messages."""
    said = ingest.tagged_messages(t.messages).where(F.col("intent").isin("cancel", "status"))
    asked = said.selectExpr("id AS msg_id", "phone", "ts", "intent AS command", "CAST(NULL AS BIGINT) AS doctor_id",
                            "CAST(NULL AS STRING) AS date", "CAST(NULL AS STRING) AS slot", "CAST(NULL AS STRING) AS name")
    ledger, requests = t.ledger_split()
    books = requests.selectExpr(
        "-id AS msg_id", "patient_phone AS phone", f"TIMESTAMP_NTZ'{FIRST_MESSAGE_TS}' + make_dt_interval(0, CAST(id % 100 AS INT), 0, 0) AS ts",
        "'book' AS command", "doctor_id", "CAST(appointment_date AS STRING) AS date", "slot_time AS slot", "patient_name AS name",
    )
    return ledger, books.unionByName(asked)


# What one command after the other gives has no SQL form: the state is the whole ledger.
@register("command_outcomes")
def q_command_outcomes(spark, sf_dir):
    t = tables(spark, sf_dir)
    ledger, commands = _commands(t)
    return arbitration.arbitrate(ledger, commands, t.doctors, t.doctor_leaves).outcomes


@register("command_replies")
def q_command_replies(spark, sf_dir):
    t = tables(spark, sf_dir)
    ledger, commands = _commands(t)
    settled = arbitration.arbitrate(ledger, commands, t.doctors, t.doctor_leaves)
    return arbitration.replies(settled.outcomes, t.doctors)


# ================================================================== orders (O-1 .. O-5, O-10): the place of each row


def _order_query(name: str, column: str, order: str, rows: str, fixtures: tuple, build) -> None:
    """Register ``order_<name>``: where each row of an ordered result stands."""
    sql = f"SELECT {column}, ROW_NUMBER() OVER (ORDER BY {order}) AS position FROM ({rows}) o"

    @register(f"order_{name}", sql, fixtures)
    def q(spark, sf_dir):
        return positions(build(tables(spark, sf_dir)), column)


_order_query(
    "day_sheet", "id", "appointment_date, token_number, id",
    "SELECT a.* FROM appointments a JOIN doctors d ON a.doctor_id = d.id "
    "WHERE a.appointment_date IN (DATE '2025-07-01', DATE '2025-07-02')",
    (A, D), lambda t: reports.day_sheet(t.appointments, t.doctors, DAY_SHEET_DAYS),
)
_order_query(
    "csv_export", "id", "appointment_date DESC, token_number, id", _LISTING_SQL,
    (A, D), lambda t: reports.appointments_listing(t.appointments, t.doctors),
)
_order_query(
    "doctors_with_leaves", "id", "department, name, id", "SELECT * FROM doctors",
    (D,), lambda t: reports.doctors_with_leaves(t.doctors, t.doctor_leaves),
)
_order_query(
    "doctor_options", "id", "name, id", "SELECT * FROM doctors", (D,), lambda t: lookups.doctor_options(t.doctors)
)
_order_query(
    "patients_summary", "id", "created_at DESC, id", "SELECT * FROM patients",
    (P, A), lambda t: reports.patients_summary(t.patients, t.appointments),
)
_ACTIVE = "FROM appointments a JOIN doctors d ON a.doctor_id = d.id WHERE a.status <> 'cancelled'"
_order_query(
    "counts_by_department", "department", "n DESC, department", f"SELECT department, COUNT(*) AS n {_ACTIVE} GROUP BY department",
    (A, D), lambda t: analytics.counts_by_department(t.appointments, t.doctors),
)
_order_query(
    "counts_by_doctor", "name", "n DESC, name", f"SELECT d.name, COUNT(*) AS n {_ACTIVE} GROUP BY d.name",
    (A, D), lambda t: analytics.counts_by_doctor(t.appointments, t.doctors),
)
_order_query(
    "daily_counts", "appointment_date", "appointment_date",
    "SELECT DISTINCT appointment_date FROM appointments WHERE status <> 'cancelled' "
    "AND appointment_date BETWEEN DATE '2025-07-01' - 31 AND DATE '2025-07-01'",
    (A,), lambda t: analytics.daily_counts(t.appointments, AS_OF),
)
_order_query(
    "departments", "department", "department", "SELECT DISTINCT department FROM doctors",
    (D,), lambda t: lookups.departments(t.doctors),
)
