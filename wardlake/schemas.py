"""Explicit schemas of the seven inpatient tables and of the change requests.

Ids are 64-bit: at cluster scale stays and observations pass 2^31 rows.
Timestamps are wall-clock values (``timestamp_ntz``), as the source system
stores them; cast to ``timestamp`` only where a watermark needs it.
"""

from __future__ import annotations

from pyspark.sql import types as T

L, I, S = T.LongType(), T.IntegerType(), T.StringType()
TS, D, B = T.TimestampNTZType(), T.DateType(), T.BooleanType()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


SERVICE = T.StructType([
    _f("id_service", L, False), _f("name", S, False), _f("created_at", TS),
])

ROOM = T.StructType([  # one row is one bed
    _f("id_room", L, False), _f("id_service", L, False), _f("room_no", I, False),
    _f("bed_no", I), _f("available", B),
])

STAFF = T.StructType([  # the password column is never loaded
    _f("id_staff", L, False), _f("id_service", L), _f("full_name", S, False),
    _f("email", S, False), _f("role", S, False),
])

PATIENT = T.StructType([
    _f("id_patient", L, False), _f("full_name", S, False), _f("nin", S, False),
    _f("birth_date", D, False), _f("sex", S, False), _f("address", S, False),
    _f("phone", S), _f("blood_group", S, False),
])

STAY = T.StructType([
    _f("id_stay", L, False), _f("id_patient", L, False), _f("id_room", L),
    _f("date_in", TS), _f("date_out", TS),
])

PRESCRIPTION = T.StructType([
    _f("id_prescription", L, False), _f("id_stay", L, False), _f("drug", S, False),
    _f("dose", I, False), _f("frequency", I, False), _f("instructions", S),
])

OBSERVATION = T.StructType([
    _f("id_obs", L, False), _f("id_stay", L, False), _f("id_nurse", L, False),
    _f("state", S, False), _f("blood_pressure", S, False),
    _f("temperature", T.DecimalType(5, 2), False), _f("heart_rate", I, False),
    _f("spo2", I, False), _f("glucose", T.DecimalType(3, 1), False),
    _f("weight", T.DecimalType(5, 2), False), _f("height", T.DecimalType(4, 2), False),
    _f("remark", S, False), _f("observed_at", TS),
])

TABLE_SCHEMAS = {
    "service": SERVICE, "room": ROOM, "staff": STAFF, "patient": PATIENT,
    "stay": STAY, "prescription": PRESCRIPTION, "observation": OBSERVATION,
}

# Fixed values of the source system's column domains.
SEX_VALUES = ("homme", "famme")
ROLE_VALUES = ("admin", "nurse")

# Text length limits of the source DDL (characters).
TEXT_LIMITS = {
    "service": {"name": 50},
    "staff": {"full_name": 30, "email": 50},
    "patient": {"full_name": 30, "nin": 15, "address": 100, "phone": 15, "blood_group": 3},
    "prescription": {"drug": 30, "instructions": 100},
    "observation": {"state": 30, "blood_pressure": 20},
}

# ---------------------------------------------------------------- requests
# Every request carries ``request_id`` (unique) and ``requested_at``; inside
# one batch requests are applied in (requested_at, request_id) order.
_REQ = [_f("request_id", L, False), _f("requested_at", TS)]

ADMIT_NEW_REQ = T.StructType(_REQ + [
    _f("full_name", S), _f("nin", S), _f("birth_date", S), _f("sex", S), _f("address", S),
    _f("phone", S), _f("blood_group", S), _f("id_room", S), _f("admission_date", S),
])

UPDATE_PATIENT_REQ = T.StructType(_REQ + [_f("id_patient", S)] + ADMIT_NEW_REQ.fields[2:])

ADMIT_EXISTING_REQ = T.StructType(_REQ + [
    _f("id_patient", S), _f("id_room", S), _f("date_in", S),
])

TRANSFER_REQ = T.StructType(_REQ + [_f("id_stay", S), _f("id_room", S), _f("id_staff", S)])

STATUS_REQ = T.StructType(_REQ + [
    _f("id_stay", S), _f("action", S), _f("id_room", S), _f("date_out", S),
])

DISCHARGE_PATIENT_REQ = T.StructType(_REQ + [_f("id_patient", S), _f("date_out", S)])

AVAILABILITY_REQ = T.StructType(_REQ + [_f("id_room", S), _f("available", S)])

OBSERVATION_REQ = T.StructType(_REQ + [
    _f("id_obs", S), _f("id_stay", S), _f("id_nurse", S), _f("state", S), _f("blood_pressure", S),
    _f("temperature", S), _f("heart_rate", S), _f("spo2", S), _f("glucose", S), _f("weight", S),
    _f("height", S), _f("remark", S), _f("observed_at", S),
])

PRESCRIPTION_REQ = T.StructType(_REQ + [
    _f("action", S), _f("id_prescription", S), _f("id_stay", S), _f("drug", S), _f("dose", S),
    _f("frequency", S), _f("instructions", S),
])

STAFF_REQ = T.StructType(_REQ + [
    _f("id_service", S), _f("full_name", S), _f("email", S), _f("role", S),
])
