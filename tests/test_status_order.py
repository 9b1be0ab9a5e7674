"""The status route equals applying its requests one by one, in any mixture."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import rows

from wardlake import schemas
from wardlake.operators import changes, status
from wardlake.operators.ordered import last_before

BATCH = "2025-06-01 00:00:00"
T0 = dt.datetime(2025, 6, 1, 8)


def one_by_one(stays, beds, reqs, lenient):
    """The contract applied request after request; ``stays``: id -> [bed, in, out], ``beds``: id -> free."""
    why = {}
    for rid, _, sid, action, room, end in sorted(reqs, key=lambda r: (r[1] is not None, r[1] or T0, r[0])):
        s, bed = stays.get(int(sid)), int(room) if room and room.isdigit() and int(room) > 0 else None
        end = dt.datetime.fromisoformat(end) if end else dt.datetime.fromisoformat(BATCH)
        if action == "discharge":
            why[rid] = ("missing: id_room" if room is None else "unknown stay" if s is None
                        else "not active" if not lenient and s[2] is not None
                        else "end before entry" if not lenient and end < s[1] else None)
            if why[rid] is None:
                freed = bed if lenient else s[0]
                if freed in beds:
                    beds[freed] = True
                s[0], s[2] = None, end
        else:
            why[rid] = ("invalid: id_room" if bed is None else "unknown bed" if bed not in beds else "bed not free" if not beds[bed]
                        else "unknown stay" if s is None else "already active" if not lenient and s[2] is None else None)
            if why[rid] is None:
                s[0], s[2], beds[bed] = bed, None, False
    return {k: v for k, v in why.items() if v}


def _tables(spark, seed, stays, beds):
    stay = spark.createDataFrame([(i, 1, b, a, o) for i, (b, a, o) in stays.items()], "id_stay long, id_patient long, id_room long, "
                                 "date_in timestamp_ntz, date_out timestamp_ntz")
    room = spark.createDataFrame([(i, 1, 1, 1, f) for i, f in beds.items()],
                                 "id_room long, id_service long, room_no int, bed_no int, available boolean")
    return seed.replace(stay=stay, room=room)


def _check(spark, seed, stays, beds, reqs, lenient):
    res = changes.apply_status(_tables(spark, seed, stays, beds), spark.createDataFrame(reqs, schemas.STATUS_REQ), BATCH, lenient)
    why = one_by_one(stays, beds, reqs, lenient)
    assert dict(rows(res.rejects, "request_id", "reason")) == why
    assert {r.request_id for r in res.accepted.collect()} == {r[0] for r in reqs} - set(why)
    assert {r.id_stay: (r.id_room, r.date_out) for r in res.tables.stay.collect()} == {i: (s[0], s[2]) for i, s in stays.items()}
    assert {r.id_room: r.available for r in res.tables.room.collect()} == beds
    return why


def _ward(rng, w, reqs):
    """A ward of its own: a few stays and beds, some inconsistent, and a random mixture of requests."""
    stays, beds = {}, {10 * w + b: rng.random() < 0.6 for b in range(1, 4)}
    for s in range(1, 5):
        active = rng.random() < 0.5
        bed = 10 * w + rng.randrange(1, 4) if rng.random() < 0.8 else None
        stays[10 * w + s] = [bed, T0 - dt.timedelta(days=1), None if active else T0]
        if active and bed and rng.random() < 0.8:
            beds[bed] = False
    for _ in range(rng.randrange(2, 16)):
        at = T0 + dt.timedelta(minutes=rng.randrange(30)) if rng.random() < 0.95 else None
        end = rng.choice([None, "2025-06-02 10:00:00", "2025-06-03 11:30:00", "2025-01-01 00:00:00"])
        reqs.append((len(reqs), at, str(10 * w + rng.randrange(1, 6)), rng.choice(["discharge", "reactivate", "reactivate"]),
                     rng.choice([str(10 * w + rng.randrange(1, 5)), "0", None]) if rng.random() < 0.2 else str(10 * w + rng.randrange(1, 4)), end))
    return stays, beds


@pytest.fixture(scope="module", autouse=True)
def _few_in_turn():
    """More than one round even on small batches."""
    before = status.IN_TURN
    status.apply_status.__defaults__ = (False, 90)
    yield
    status.apply_status.__defaults__ = (False, before)


@pytest.mark.parametrize("lenient", [False, True])
def test_sixty_random_wards_equal_one_by_one(spark, seed, lenient):
    rng, stays, beds, reqs = random.Random(31 + lenient), {}, {}, []
    for w in range(60):
        s, b = _ward(rng, w, reqs)
        stays |= s
        beds |= b
    why = _check(spark, seed, stays, beds, reqs, lenient)
    assert len(why) > 50 and (lenient or {"already active", "bed not free", "not active"} <= set(why.values()))


def test_reactivation_before_the_discharge_is_refused(spark, seed):
    stays, beds = {1: [10, T0, None]}, {10: False, 11: True}
    reqs = [(1, T0, "1", "reactivate", "11", None), (2, T0 + dt.timedelta(hours=1), "1", "discharge", "0", "2025-06-01 09:00:00")]
    assert _check(spark, seed, stays, beds, reqs, False) == {1: "already active"}
    assert stays[1] == [None, T0, dt.datetime(2025, 6, 1, 9)] and beds == {10: True, 11: True}


def test_hot_bed_and_hot_stay(spark, seed):
    """A bed that changes hands again and again, and a stay that a third of the requests name."""
    rng = random.Random(5)
    stays = {i: [None, T0 - dt.timedelta(days=9), T0 - dt.timedelta(days=1)] for i in range(1, 40)}
    beds, reqs = {1: True, 2: True}, []
    for k in range(400):
        sid = 1 if k % 3 == 0 else rng.randrange(2, 40)
        action = "discharge" if rng.random() < 0.5 else "reactivate"
        reqs.append((k, T0 + dt.timedelta(minutes=k), str(sid), action, "1" if sid > 1 or k % 2 else "2", None))
    _check(spark, seed, stays, beds, reqs, False)


def test_last_before_over_pieces(spark):
    n = 20_000
    df = spark.range(0, n, 1, 9).selectExpr("if(id % 3 = 0, 7, id % 50 + 100) k", "(id * 7919) % 20000 at", "id",
                                            "if(id % 11 = 0, id, null) v")
    got = {r.id: r.b for r in last_before(df, "k", ["at"], "v", "b").collect()}
    last = {}
    for r in sorted(df.collect(), key=lambda r: r["at"]):
        assert got[r.id] == last.get(r.k)
        if r.v is not None:
            last[r.k] = r.v
