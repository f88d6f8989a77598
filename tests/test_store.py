"""Stored layout: date-partitioned appointments prune at the scan."""

import datetime as dt
import os
import re
import uuid

from slotwise.operators import messaging, reports
from slotwise.session import scratch_path
from slotwise.sources.fixtures import tables
from slotwise.sources.store import StoredTables, store_tables
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_prune_and_agree(spark):
    t = tables(spark, SF_SMALL)
    root = scratch_path(spark, "store-test", uuid.uuid4().hex)
    store_tables(t, root)
    s = StoredTables(spark, root)
    assert os.path.isdir(os.path.join(root, "appointments", "appointment_date=2025-07-01"))
    days = [dt.date(2025, 7, 1), dt.date(2025, 7, 2)]
    stored = reports.day_sheet(s.appointments, s.doctors, days)
    plan = _plan(stored)
    assert re.search(r"PartitionFilters: \[[^\]]*appointment_date[^\]]*2025-07-01", plan)
    derived = reports.day_sheet(t.appointments, t.doctors, days)
    assert stored.exceptAll(derived).count() == 0 and derived.exceptAll(stored).count() == 0
    rem = messaging.reminders(s.appointments, s.doctors, dt.date(2025, 7, 1))
    assert re.search(r"PartitionFilters: \[[^\]]*appointment_date[^\]]*2025-07-02", _plan(rem))
