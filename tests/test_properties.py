"""Property tests (few examples: each runs Spark jobs).

* A batch of requests without conflicts gives the same tables as applying
  the requests one at a time.
* The streaming newest observation equals the batch one whatever the
  arrival order.
"""

from __future__ import annotations

import datetime as dt
import random
import tempfile

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wardlake import schemas
from wardlake.operators import changes, reads
from wardlake.streaming import observations as stream

BATCH = "2025-06-01 00:00:00"
T0 = dt.datetime(2025, 6, 1, 8)
ACTIVE_STAYS = [1, 3, 4, 5, 6, 7, 8]        # stay ids with a bed and no end
FREE_BEDS = [6, 7, 9, 11]


def _state(t):
    return (rows(t.stay, "id_stay", "id_room", "date_out"), rows(t.room, "id_room", "available"))


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(ACTIVE_STAYS), min_size=2, max_size=3, unique=True))
def test_discharge_batch_equals_sequential(spark, seed, stays):
    reqs = [(i, T0 + dt.timedelta(minutes=i), str(s), "discharge", "0", None) for i, s in enumerate(stays)]
    batch = changes.apply_status(seed, spark.createDataFrame(reqs, schemas.STATUS_REQ), BATCH).tables
    seq = seed
    for r in reqs:
        seq = changes.apply_status(seq, spark.createDataFrame([r], schemas.STATUS_REQ), BATCH).tables
        seq = seq.checkpoint(("stay", "room"))  # one snapshot version per step
    assert _state(batch) == _state(seq)


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.permutations(FREE_BEDS))
def test_reactivation_batch_equals_sequential(spark, seed, beds):
    # stay 2 is the only ended stay; give it one free bed, and move other stays to the rest
    reqs = [(0, T0, "2", "reactivate", str(beds[0]), None)]
    batch = changes.apply_status(seed, spark.createDataFrame(reqs, schemas.STATUS_REQ), BATCH).tables
    seq = changes.apply_status(seed, spark.createDataFrame(reqs[:1], schemas.STATUS_REQ), BATCH).tables
    assert _state(batch) == _state(seq)
    moves = [(i + 1, T0, str(s), str(b), "2" if b == 9 else "3" if b == 6 else "1")
             for i, (s, b) in enumerate(zip([1, 4], beds[1:3]))]
    one = changes.transfer(batch, spark.createDataFrame(moves, schemas.TRANSFER_REQ), lenient=True).tables
    step = batch
    for m in moves:
        step = changes.transfer(step, spark.createDataFrame([m], schemas.TRANSFER_REQ), lenient=True).tables
        step = step.checkpoint(("stay", "room"))
    assert _state(one) == _state(step)


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.permutations([0, 1, 2]))
def test_stream_equals_batch_any_order(spark, seed, order):
    from pyspark.sql import functions as F
    obs = seed.observation
    parts = [obs.withColumn("observed_at", F.col("observed_at") + F.expr(f"INTERVAL {k} HOUR"))
                .withColumn("id_obs", F.col("id_obs") + 100 * k) for k in range(3)]
    folder = tempfile.mkdtemp(prefix="wardlake-prop-in-", dir="/tmp")
    for pos, k in enumerate(order):
        parts[k].write.parquet(f"{folder}/f{pos}")
    out = tempfile.mkdtemp(prefix="wardlake-prop-out-", dir="/tmp") + "/newest"
    q = stream.start_newest_observation(spark, spark.readStream.schema(obs.schema)
                                        .option("maxFilesPerTrigger", 1).parquet(f"{folder}/*"), out, f"{out}-state")
    q.awaitTermination()
    got = rows(stream.read_newest_observation(spark, out), "id_stay", "id_obs")
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert got == rows(reads.newest_observation(seed.replace(observation=union)), "id_stay", "id_obs")


def test_prescription_edits_in_order(spark, seed):
    """Forty random sequences of edits, each on prescriptions of its own, in one batch, against a
    model that applies the requests one by one."""
    rng = random.Random(12)
    schema = ("request_id bigint, requested_at timestamp_ntz, action string, id_prescription string, id_stay string, "
              "drug string, dose string, frequency string, instructions string")
    reqs, presc = [], []
    for e in range(40):
        presc += [(10 * e + p, 1, f"old{e}.{p}", 1, 1, None) for p in (1, 2, 3)]
        for _ in range(rng.randrange(1, 9)):
            i = len(reqs)
            reqs.append((i, T0 + dt.timedelta(minutes=rng.randrange(3)), rng.choice(["update", "update", "delete"]),
                         str(10 * e + rng.randrange(1, 5)), None, f"d{i}", "1", "1", None))
    t = seed.replace(prescription=spark.createDataFrame(presc, schemas.PRESCRIPTION))
    res = changes.prescription_changes(t, spark.createDataFrame(reqs, schema))
    drug, why, last = {p[0]: p[2] for p in presc}, {}, {}
    for i, _, action, p, _, name, *_ in sorted(reqs, key=lambda r: (r[1], r[0])):
        p = int(p)
        if p not in drug:
            why[i] = "unknown prescription"
            continue
        if p in last:
            why[last[p]] = "superseded"
        last[p] = i
        if action == "delete":
            del drug[p]
        else:
            drug[p] = name
    assert dict(rows(res.rejects, "request_id", "reason")) == why
    assert {r.request_id for r in res.accepted.collect()} == {r[0] for r in reqs} - set(why)
    assert {r.id_prescription: r.drug for r in res.tables.prescription.collect()} == drug
