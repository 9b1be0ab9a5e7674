"""M5/M6: the status route (discharge, reactivate) in request order.

A batch gives exactly what its requests give one by one in (requested_at,
request_id) order, without visiting them one by one:

* Discharges cut a stay's requests into *epochs*.  Whatever happened before,
  the stay has ended after a discharge that is well-formed and not before the
  entry; so within an epoch at most one reactivation succeeds, and its
  occupancy of a bed ends, if ever, with the discharge that closes the epoch.
  Both are known before any outcome is.
* What remains is which reactivations succeed: the bed must be free, that is
  the last event on the bed (a start or end of an occupancy, a discharge of a
  stay that held the bed in the snapshot) must not be a start; and no earlier
  one of the epoch may have succeeded.  A round decides them all at once with
  three values: an event of an undecided reactivation reads as unknown.  Only
  requests that hang on each other through beds stay undecided; of these the
  earliest ``in_turn`` (a bound, not a sample: the others follow in the next
  round) are decided in their order by one task, from the last certain event
  on each bed, once a round decides fewer than that or all that is left fits.
  Refusals leave the table at once.
* An unknown event need not make the bed's state unknown.  A bed that the
  snapshot holds taken stays so until a first certain free; on any other bed,
  once every occupancy that may have begun has ended, the last event was an
  end or a free, whichever of them came about.  So requests hang on each
  other only while their occupancies could overlap, and the number of rounds
  follows the longest such chain, not the number of requests.

Looking back along a stay or a bed is ``ordered.last_before``, so a stay or a
bed that a third of the requests name is no single task's work.
"""

from __future__ import annotations

import datetime as dt
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as X
from ..session import checkpoint_dir
from ..sources.snapshot import Tables
from . import changes as C
from .latest import latest_per_key
from .ordered import last_before

ORDER = C.ORDER
IN_TURN = 100_000  # requests that one task decides in a round
UNKNOWN, FREED, TAKEN = 0, 1, 2  # of events that share their order, the certain one comes last


def _requests(t: Tables, requests: DataFrame, batch_ts: str) -> DataFrame:
    """The requests with the snapshot's state of their stay and bed."""
    r = requests.select(*ORDER, "action", X.to_long("id_stay").alias("id_stay"), F.col("id_room").alias("_bed_text"),
                        F.when(X.positive_int("id_room"), X.to_long("id_room")).alias("bed"),
                        X.parse_timestamp("date_out", batch_ts).alias("new_out"))
    hot = C.hot_values(r, ["bed", "id_stay"])
    r = C._with_bed(r, t, hot["bed"])
    cur = C._named(t.stay, "id_stay", r, "id_stay").select(
        "id_stay", F.col("id_room").alias("_held"), F.col("date_out").alias("_out"),
        F.col("date_in").alias("_in"), F.lit(True).alias("_stay"))
    r = C.join_split(r, cur, "id_stay", "left", hot=hot["id_stay"]).withColumn("_stay", F.coalesce(F.col("_stay"), F.lit(False)))
    return r.withColumn("o", F.struct(*ORDER)).withColumn("_was_active", F.col("_stay") & F.col("_out").isNull())


def _free_before(events: DataFrame) -> DataFrame:
    """Rows with a request: is the bed free (TRUE/FALSE, NULL unknown) when
    it comes?  ``events``: id_room, o, v, e, request_id, bed_free, until."""
    marked = events.withColumn("_frees", F.when(F.col("e") == FREED, True))
    seen = (last_before(marked, "id_room", ["o", "v"], "e", "_seen", {"_opened": "_frees", "_until": "until"})
            .filter(F.col("request_id").isNotNull()))
    opened = F.coalesce("bed_free", F.lit(False)) | F.coalesce("_opened", F.lit(False))
    over = ~F.col("_until.never") & (F.col("_until.end") < F.col("o"))
    return seen.withColumn("_free", F.when(F.col("_seen").isNull(), F.col("bed_free"))
                           .when(F.col("_seen") != UNKNOWN, F.col("_seen") == FREED)
                           .when(~opened, False).when(over, True))


def _events(taking: DataFrame, frees: DataFrame) -> DataFrame:
    """Starts and ends of the occupancies (``ok`` TRUE certain, NULL unknown)
    and the certain frees, one row each.  ``until``: the end of a start's occupancy."""
    sure = F.coalesce("ok", F.lit(False))
    cols = ["id_room", "o", "v", "e", "request_id", "bed_free", "until"]
    until = F.struct(F.col("end").isNull().alias("never"), F.col("end").alias("end"))
    starts = taking.withColumn("e", F.when(sure, TAKEN).otherwise(UNKNOWN)).withColumn("v", F.col("e")).withColumn("until", until)
    ends = taking.filter(F.col("end").isNotNull()).select(
        "id_room", F.col("end").alias("o"), F.when(sure, FREED).otherwise(UNKNOWN).alias("e"))
    others = ends.unionByName(frees.select("id_room", "o", F.lit(FREED).alias("e"))).distinct()
    return starts.select(*cols).unionByName(others.select(
        "id_room", "o", F.col("e").alias("v"), "e", F.lit(None).cast("bigint").alias("request_id"),
        F.lit(None).cast("boolean").alias("bed_free")), allowMissingColumns=True)


def _asked(backs: DataFrame) -> DataFrame:
    """Reactivations that only look at their bed."""
    return backs.select("id_room", "o", F.lit(UNKNOWN).alias("v"), F.lit(None).cast("int").alias("e"), "request_id", "bed_free")


def _one_by_one(batches):
    """Decide reactivations in order.  Each brings the last certain event on
    its bed; here only those accepted on the way are kept in mind."""
    def key(o):
        return o and (o["requested_at"] is not None, o["requested_at"] or dt.datetime.min, o["request_id"])

    epochs, last, ends = set(), {}, {}  # per bed: the newest event known, and the ends to come
    rows = [r for b in batches for r in b.to_pylist()]
    out = []
    for r in sorted(rows, key=lambda r: key(r["o"])):
        bed, o, epoch = r["id_room"], key(r["o"]), (r["id_stay"], key(r["epoch"]))
        newest = max(last.get(bed, (None, None)), (key(r["at"]), r["e"]), key=lambda x: x[0] or (False,))
        while ends.get(bed) and ends[bed][0] < o:
            newest = max(newest, (heapq.heappop(ends[bed]), FREED), key=lambda x: x[0] or (False,))
        last[bed] = newest
        ok = not r["taken"] and epoch not in epochs and (newest[1] == FREED if newest[0] else r["bed_free"])
        if ok:
            epochs.add(epoch)
            last[bed] = (o, TAKEN)
            if r["end"]:
                heapq.heappush(ends.setdefault(bed, []), key(r["end"]))
        out.append({"request_id": r["request_id"], "_ok": bool(ok)})
    if out:
        yield pa.RecordBatch.from_pylist(out, pa.schema([("request_id", pa.int64()), ("_ok", pa.bool_())]))


def _decide(cand: DataFrame, frees: DataFrame, in_turn: int) -> DataFrame:
    """The reactivations that succeed, of those whose stay may be inactive."""
    cand = cand.withColumn("ok", F.lit(None).cast("boolean")).checkpoint(eager=True)
    open_ = F.col("ok").isNull()
    left = cand.count()
    while left:
        free = _free_before(_events(cand, frees)).select("request_id", "_free")
        first = cand.groupBy("id_stay", "epoch").agg(F.min(F.when(F.col("ok"), F.col("o"))).alias("_done"), F.min(F.when(open_, F.col("o"))).alias("_next"))
        first = first.select(F.col("id_stay").alias("_s"), F.col("epoch").alias("_e"), "_done", "_next")
        both = cand.join(free, on="request_id").join(first, (F.col("id_stay") == F.col("_s")) & F.col("epoch").eqNullSafe(F.col("_e")))
        lost = F.coalesce(~F.col("_free"), F.lit(False)) | F.coalesce(F.col("_done") < F.col("o"), F.lit(False))
        won = F.coalesce(F.col("_free"), F.lit(False)) & (F.col("o") == F.col("_next"))
        cand = (both.withColumn("ok", F.when(F.col("ok"), True).when(lost, False).when(won, True))
                    .filter(F.coalesce("ok", F.lit(True))).select(*cand.columns).checkpoint(eager=True))
        before, left = left, cand.filter(open_).count()
        if not left or left > in_turn and before - left >= in_turn:
            continue
        # the earliest undecided ones hang on nothing but each other and certain events
        certain = _events(cand, frees).withColumn("e", F.when(F.col("v") != UNKNOWN, F.struct(F.col("o").alias("at"), F.col("v").alias("e"))))
        seen = last_before(certain, "id_room", ["o", "v"], "e", "_seen").filter((F.col("v") == UNKNOWN) & F.col("request_id").isNotNull())
        done = cand.filter("ok").select(F.col("id_stay").alias("_s"), F.col("epoch").alias("_e"), F.lit(True).alias("taken"))
        early = (seen.select("request_id", "_seen.at", "_seen.e").join(cand.filter(open_).drop("ok"), on="request_id")
                     .join(done, (F.col("id_stay") == F.col("_s")) & F.col("epoch").eqNullSafe(F.col("_e")), "left")
                     .orderBy("o").limit(in_turn).coalesce(1))
        told = early.mapInArrow(_one_by_one, "request_id bigint, _ok boolean")
        cand = (cand.join(told, on="request_id", how="left").withColumn("ok", F.coalesce("ok", "_ok"))
                    .filter(F.coalesce("ok", F.lit(True))).select(*cand.columns).checkpoint(eager=True))
        left = cand.filter(open_).count()
    return cand


def apply_status(t: Tables, requests: DataFrame, batch_ts: str, lenient: bool = False, in_turn: int = IN_TURN) -> C.ChangeResult:
    """``action`` = discharge or reactivate, applied in request order.

    A discharge ends an active stay (end time default ``batch_ts``, not before
    the entry) and frees its bed; a reactivation re-opens an ended stay in a
    free bed.  ``lenient`` (the source system's behaviour): a discharge
    also takes ended stays and any end, and frees the bed it names; a
    reactivation also takes active stays."""
    checkpoint_dir(t.stay.sparkSession)
    act = F.col("action")
    known = act.isin("discharge", "reactivate")
    bad = requests.filter(act.isNull() | ~known).select("request_id", F.lit("invalid: action").alias("reason"))
    r = _requests(t, requests.filter(known), batch_ts)
    early = F.lit(not lenient) & F.coalesce(F.col("new_out") < F.col("_in"), F.lit(False))
    out, back = act == "discharge", act == "reactivate"
    r = r.withColumn("_form", C._reason(
        (X.is_empty("id_stay"), "invalid: id_stay"),
        (out & F.col("_bed_text").isNull(), "missing: id_room"),
        (back & F.col("bed").isNull(), "invalid: id_room"),
        (back & ~F.col("bed_exists"), "unknown bed"),
        (out & ~F.col("_stay"), "unknown stay")))
    rejects = bad.unionByName(r.filter(F.col("_form").isNotNull()).select("request_id", F.col("_form").alias("reason")))
    r = r.filter(F.col("_form").isNull())
    cuts = F.when(out & ~early, F.col("o"))
    r = last_before(r.withColumn("_cut", cuts), "id_stay", ORDER, "_cut", "epoch")
    first_active = F.col("epoch").isNull() & F.col("_was_active")

    ends = (r.filter(F.col("_cut").isNotNull()).select(F.col("id_stay").alias("_s"), F.col("epoch").alias("_e"), F.col("o").alias("end")))
    backs = r.filter(back).withColumnsRenamed({"bed": "id_room"})
    if lenient:
        # a discharge frees the bed it names, a reactivation leaves its bed taken, whatever was before
        frees = r.filter(out & F.col("bed").isNotNull()).select(F.col("bed").alias("id_room"), "o")
        taking = backs.filter("_stay").withColumn("ok", F.lit(True)).withColumn("end", F.lit(None).cast(ends.schema["end"].dataType))
        free = _free_before(_events(taking, frees).unionByName(_asked(backs.filter("not _stay")), allowMissingColumns=True)).select("request_id", "_free")
    else:
        held = first_active & F.col("_held").isNotNull()
        frees = r.filter(F.col("_cut").isNotNull() & held).select(F.col("_held").alias("id_room"), "o")
        cand = (backs.filter(~first_active & F.col("_stay"))
                     .join(ends, (F.col("id_stay") == F.col("_s")) & F.col("epoch").eqNullSafe(F.col("_e")), "left")
                     .select("request_id", "o", "id_stay", "epoch", "id_room", "bed_free", "end"))
        won = _decide(cand, frees, in_turn)
        # the state of the bed as each reactivation met it, for the refusals' reasons
        refused = backs.join(won.select("request_id"), on="request_id", how="left_anti")
        free = _free_before(_events(won, frees).unionByName(_asked(refused), allowMissingColumns=True)).select("request_id", "_free")
        free = free.join(won.select("request_id", F.lit(True).alias("_won")), on="request_id", how="left")

    checked = backs.join(free, on="request_id", how="left").withColumn("reason", C._reason(
        (~F.coalesce("_free", F.lit(False)), "bed not free"),
        (~F.col("_stay"), "unknown stay"),
        (F.lit(False) if lenient else F.col("_won").isNull(), "already active")))
    opened = checked.filter(F.col("reason").isNull()).select(*ORDER, "o", "id_stay", "id_room", "epoch")
    rejects = rejects.unionByName(checked.filter(F.col("reason").isNotNull()).select("request_id", "reason"))

    outs = r.filter(out)
    if lenient:
        done = outs.withColumn("reason", F.lit(None).cast("string")).withColumn("freed", F.col("bed"))
    else:
        occupied = opened.select(F.col("id_stay").alias("_s"), F.col("epoch").alias("_e"), F.col("o").alias("_from"), F.col("id_room").alias("_in_bed"))
        done = outs.join(occupied, (F.col("id_stay") == F.col("_s")) & F.col("epoch").eqNullSafe(F.col("_e")) & (F.col("_from") < F.col("o")), "left")
        done = done.withColumn("reason", C._reason(
            (~first_active & F.col("_from").isNull(), "not active"), (early, "end before entry")))
        done = done.withColumn("freed", F.when(first_active, F.col("_held")).otherwise(F.col("_in_bed")))
    rejects = rejects.unionByName(done.filter(F.col("reason").isNotNull()).select("request_id", "reason"))
    closed = done.filter(F.col("reason").isNull())

    # of several accepted requests for a stay or a bed the last one is what stands
    steps = opened.select(*ORDER, "id_stay", "id_room", F.lit(None).cast("timestamp_ntz").alias("date_out")).unionByName(
        closed.select(*ORDER, "id_stay", F.lit(None).cast("bigint").alias("id_room"), F.col("new_out").alias("date_out")))
    stays = C._merge(t.stay, latest_per_key(steps, ["id_stay"], ORDER, ["id_room", "date_out"]), "id_stay", ["id_room", "date_out"])
    flags = opened.select(*ORDER, "id_room", F.lit(False).alias("available")).unionByName(
        closed.filter(F.col("freed").isNotNull()).select(*ORDER, F.col("freed").alias("id_room"), F.lit(True).alias("available")))
    rooms = C._merge(t.room, latest_per_key(flags, ["id_room"], ORDER, ["available"]), "id_room", ["available"])
    return C.ChangeResult(t.replace(stay=stays, room=rooms), steps.select("request_id", "id_stay"), rejects)
