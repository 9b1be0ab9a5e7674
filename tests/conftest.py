"""Shared fixtures: one local session and the source system's seed rows,
typed with our schemas."""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wardlake import schemas  # noqa: E402
from wardlake.sources.snapshot import Tables  # noqa: E402

AS_OF = "2025-06-01"
OBS_TIME = dt.datetime(2025, 5, 25, 12, 0, 0)  # seed observations carry no time: one fixed instant


def D(x):
    return decimal.Decimal(str(x))


def ts(s):
    return dt.datetime.fromisoformat(s)


def day(s):
    return dt.date.fromisoformat(s)


# The seed rows of the source database, retyped in row order.
SERVICES = [(1, "Cardiology", None), (2, "Neurology", None), (3, "Pediatrics", None), (4, "Orthopedics", None)]
ROOMS = [(1, 1, 101, 1, False), (2, 1, 101, 2, False), (3, 1, 101, 3, False), (4, 1, 102, 4, False),
         (5, 2, 201, 1, False), (6, 3, 301, 1, True), (7, 4, 401, 1, True), (8, 2, 202, 1, False),
         (9, 2, 202, 2, True), (10, 3, 302, 1, False), (11, 1, 103, 1, True)]
STAFF = [(1, None, "Alice Martin", "admin@hospital.com", "admin"),
         (2, 2, "Bob Nurse", "bob.n@hospital.com", "nurse"),
         (3, 3, "Claire Nurse", "claire.n@hospital.com", "nurse")]
PATIENTS = [
    (1, "John Doe", "054845678", day("1979-01-15"), "homme", "123 Main St, Cityville", "0612345678", "AB+"),
    (2, "Jane Smith", "069874268", day("1994-07-22"), "homme", "456 Elm St, Townsville", "0623456789", "A+"),
    (3, "Tom Hanks", "023659874", day("1964-03-10"), "homme", "789 Oak St, Villagetown", "0634567890", "B+"),
    (4, "Laura Palmer", "071234567", day("2007-02-05"), "famme", "1 Lynch Street, Twin Peaks", "0645678901", "O-"),
    (5, "Dale Cooper", "089876543", day("1989-11-12"), "homme", "1 Federal Plaza, Philadelphia", "0656789012", "A-"),
    (6, "Audrey Horne", "091112233", day("2006-08-30"), "famme", "Great Northern Hotel, Twin Peaks", "0667890123",
     "B-"),
    (7, "Harry S. Truman", "102223344", day("1979-06-25"), "homme", "Sheriff Station, Twin Peaks", "0678901234",
     "O+"),
]
STAYS = [(1, 1, 1, ts("2025-05-01 08:00:00"), None),
         (2, 2, 2, ts("2025-05-05 14:30:00"), ts("2025-05-10 11:00:00")),
         (3, 3, 3, ts("2025-05-07 10:00:00"), None),
         (4, 4, 8, ts("2025-05-15 10:00:00"), None),
         (5, 5, 10, ts("2025-05-16 11:30:00"), None),
         (6, 6, 2, ts("2025-05-20 09:00:00"), None),
         (7, 7, 5, ts("2025-05-21 14:00:00"), None),
         (8, 2, 4, ts("2025-05-22 16:00:00"), None)]
PRESCRIPTIONS = [(1, 1, "Amlodipine", 5, 1, "Take one tablet daily in the morning."),
                 (2, 2, "Paracetamol", 500, 3, "After meals, for 5 days."),
                 (3, 3, "Metoprolol", 50, 2, "Twice a day, monitor blood pressure."),
                 (4, 4, "Lorazepam", 1, 3, "As needed for anxiety"),
                 (5, 5, "Coffee", 1, 24, "Damn fine cup!"),
                 (6, 6, "Lipstick", 1, 1, "Apply as needed for confidence."),
                 (7, 7, "Doughnuts", 2, 3, "With coffee, especially in the morning."),
                 (8, 8, "Aspirin", 325, 1, "For headache after previous stay.")]
OBSERVATIONS = [
    (1, 1, 2, "Stable", "120/80", D("36.70"), 72, 98, D("5.6"), D("70.50"), D("1.75"),
     "Patient is stable. No signs of distress."),
    (2, 2, 3, "Fatigue", "110/70", D("37.20"), 76, 97, D("5.2"), D("65.20"), D("1.65"),
     "Patient reports mild fatigue, under observation."),
    (3, 3, 2, "Critical", "90/60", D("38.40"), 100, 90, D("7.1"), D("80.00"), D("1.80"),
     "High fever and low oxygen level. Immediate attention needed."),
    (4, 4, 2, "Agitated", "130/85", D("37.00"), 90, 97, D("5.0"), D("55.00"), D("1.68"),
     "Patient experiencing distress."),
    (5, 5, 3, "Good", "120/80", D("36.50"), 70, 99, D("4.5"), D("75.00"), D("1.82"),
     "Enjoying the coffee. Reports seeing a giant."),
    (6, 6, 2, "Sassy", "115/75", D("36.80"), 80, 98, D("5.1"), D("58.00"), D("1.70"), "Asking for her father."),
    (7, 7, 3, "Calm", "125/80", D("36.60"), 75, 99, D("4.8"), D("80.00"), D("1.85"),
     "Wants to know who shot Laura Palmer."),
    (8, 8, 2, "Recovering", "120/80", D("37.00"), 70, 98, D("5.3"), D("66.00"), D("1.65"),
     "Feeling better this time around."),
]


@pytest.fixture(scope="session")
def spark():
    from wardlake.session import get_session
    s = get_session("local[4]", 4, app_name="wardlake-tests", extra={"spark.driver.memory": "6g"})
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wardlake-test-ckpt-", dir="/tmp"))
    yield s


@pytest.fixture(scope="session")
def seed(spark) -> Tables:
    mk = spark.createDataFrame
    obs = [r + (OBS_TIME,) for r in OBSERVATIONS]
    return Tables(
        service=mk(SERVICES, schemas.SERVICE), room=mk(ROOMS, schemas.ROOM), staff=mk(STAFF, schemas.STAFF),
        patient=mk(PATIENTS, schemas.PATIENT), stay=mk(STAYS, schemas.STAY),
        prescription=mk(PRESCRIPTIONS, schemas.PRESCRIPTION), observation=mk(obs, schemas.OBSERVATION))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
