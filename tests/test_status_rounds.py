"""The status route decides in few rounds what does not overlap."""

from __future__ import annotations

import datetime as dt

from conftest import rows
from test_status_order import BATCH, T0, _tables, one_by_one

from wardlake import schemas
from wardlake.operators import status
from wardlake.operators.ordered import last_before


def test_rounds_do_not_follow_the_number_of_requests(spark, seed, monkeypatch):
    """A stay that is opened (twice asked) and ended forty times, beside a bed that nobody frees."""
    stays = {1: [None, T0 - dt.timedelta(days=9), T0], 2: [None, T0 - dt.timedelta(days=9), T0]}
    beds, reqs = {1: True, 2: False}, []
    for k in range(160):
        action, sid, bed = [("reactivate", "1", "1"), ("reactivate", "1", "1"), ("reactivate", "2", "2"), ("discharge", "1", "1")][k % 4]
        reqs.append((k, T0 + dt.timedelta(minutes=k), sid, action, bed, None))
    looks = []
    monkeypatch.setattr(status, "last_before", lambda *a, **k: looks.append(1) or last_before(*a, **k))
    res = status.apply_status(_tables(spark, seed, stays, beds), spark.createDataFrame(reqs, schemas.STATUS_REQ), BATCH, in_turn=5)
    assert dict(rows(res.rejects, "request_id", "reason")) == one_by_one(stays, beds, reqs, False)
    assert len(looks) <= 6


def test_greatest_of_the_earlier_rows_over_pieces(spark):
    df = spark.range(0, 5000, 1, 9).selectExpr("if(id % 3 = 0, 7, id % 50 + 100) k", "(id * 7919) % 5000 at", "id",
                                               "if(id % 11 = 0, id, null) v", "if(id % 5 = 0, (id * 31) % 977, null) w")
    got = {r.id: (r.b, r.top) for r in last_before(df, "k", ["at"], "v", "b", {"top": "w"}).collect()}
    last, top = {}, {}
    for r in sorted(df.collect(), key=lambda r: r["at"]):
        assert got[r.id] == (last.get(r.k), top.get(r.k))
        if r.v is not None:
            last[r.k] = r.v
        if r.w is not None:
            top[r.k] = max(r.w, top.get(r.k, r.w))
