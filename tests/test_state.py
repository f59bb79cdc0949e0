"""State in streams: replays with a restart between equal the batch operators."""

import datetime

from pyspark.sql import functions as F

from lexgrove.operators import monitor
from lexgrove.streaming import state


def test_unit_events_equal_the_batch_diff_across_a_restart(spark, tmp_path):
    base = spark.range(40).select(F.concat(F.lit("u"), "id").alias("unit_id"), "id")
    load = lambda keep, change, off: base.where(keep).select("unit_id", F.when(F.expr(change), "new").otherwise("old").alias("text_hash"), (~F.expr(off)).alias("in_force"))
    loads = [load("id % 5 <> 0", "false", "id % 7 = 0"), load("id % 4 <> 0", "id % 3 = 0", "id % 7 in (0, 1)"), load("id % 9 <> 0", "id % 3 = 1", "id % 11 = 0")]
    folder, target, checkpoint = (f"{tmp_path}/{n}" for n in ("loads", "events", "checkpoint"))
    want = set()
    for n, now in enumerate(loads, 1):
        before = loads[n - 2] if n > 1 else None
        state.load_rows(before, now, n).write.mode("append").parquet(folder)
        if before is not None:
            want |= {(n, r["kind"], r["unit_id"]) for r in monitor.unit_changes(before, now).collect()}
        if n != 2:  # the second and third load are read by one stream, begun again from the checkpoint
            state.unit_events(spark, folder, target, checkpoint)
    rows = [tuple(r) for r in spark.read.schema(state.EVENTS).parquet(target).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and {k for _, k, _ in want} == set(monitor.UNIT_KINDS)


def test_notifications_move_on_and_expire(spark, tmp_path):
    at = lambda day, hour=0: datetime.datetime(2025, 1, 1, hour) + datetime.timedelta(days=day)
    folder, target, checkpoint = (f"{tmp_path}/{n}" for n in ("marks", "states", "checkpoint"))
    write = lambda rows: spark.createDataFrame(rows, state.MARKS).coalesce(1).write.mode("append").parquet(folder)
    write([(1, 1, "open", at(0)), (1, 2, "open", at(0)), (2, 1, "open", at(1))])
    state.notification_states(spark, folder, target, checkpoint, 30)
    write([(1, 2, "applied", at(3)), (1, 2, "seen", at(4)), (2, 1, "seen", at(5))])
    state.notification_states(spark, folder, target, checkpoint, 30)
    write([(9, 9, "open", at(60))])
    state.notification_states(spark, folder, target, checkpoint, 30)
    write([(9, 9, "seen", at(61))])
    state.notification_states(spark, folder, target, checkpoint, 30)
    got = {(r["workspace_id"], r["event_id"], r["status"]) for r in spark.read.schema(state.STATES).parquet(target).collect()}
    assert got == {(1, 1, "open"), (1, 2, "open"), (2, 1, "open"), (1, 2, "applied"), (2, 1, "seen"), (9, 9, "open"), (9, 9, "seen"), (1, 1, "expired")}
