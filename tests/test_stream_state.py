"""Keyed stream state against batches, over restarts."""

import datetime
import json
import random

from pyspark.sql import functions as F

from graphloom.sources import ledger
from graphloom.streaming import asks
from graphloom.streaming.ledger_stream import LedgerFold, ledger_stream

T0 = datetime.datetime(2026, 1, 1)


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(stream, folder):
    asks.run_available(stream.sparkSession, stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").format("parquet"), f"{folder}/rows")


def test_counts_survive_restarts(spark, tmp_path):
    rnd = random.Random(1)
    kind, source, out = "key string, id long, at timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    at, rows = T0, []
    for k in range(60):
        at += datetime.timedelta(hours=rnd.choice([1, 3, 20, 30]))
        rows.append((rnd.choice("abc"), k, at))
    rows += [("tie", 100, T0), ("tie", 101, T0), ("tie", 102, T0 + datetime.timedelta(hours=24)), ("tie", 103, T0 + datetime.timedelta(hours=47, minutes=59))]
    rows.sort(key=lambda r: r[2])
    for part in (rows[:30], rows[30:45], rows[45:]):
        feed(spark, source, part, kind)
        run(asks.ask_counts_stream(spark.readStream.schema(kind).parquet(source)), out)  # a new query each time, from the checkpoint
    found = sorted((r.key, r.id, r.calls) for r in spark.read.parquet(f"{out}/rows").collect())
    assert found == sorted((r.key, r.id, r.calls) for r in asks.ask_counts(spark.createDataFrame(rows, kind)).collect())
    assert [c for k, _, c in found if k == "tie"] == [1, 2, 1, 2]


def test_a_note_is_given_once(spark, tmp_path):
    kind, source, out = "folder string, id long, at timestamp, text string", str(tmp_path / "in"), str(tmp_path / "out")
    after = lambda m: T0 + datetime.timedelta(minutes=m)
    parts = [
        [("a", 1, after(0), "first"), ("b", 2, after(0), "old"), ("c", 3, after(0), "x"), ("c", 4, after(1), "y")],
        [("a", 5, after(59), None), ("a", 6, after(59), None), ("b", 7, after(61), None), ("c", 8, after(60), None)],
        [("a", 9, after(70), None), ("b", 10, after(62), None), ("c", 11, after(62), "z"), ("c", 12, after(63), None), ("d", 13, after(5), None)],
    ]
    for part in parts:
        feed(spark, source, part, kind)
        run(asks.one_time_notes(spark.readStream.schema(kind).parquet(source)), out)
    assert sorted((r.folder, r.text) for r in spark.read.parquet(f"{out}/rows").collect()) == [("a", "first"), ("c", "y"), ("c", "z")]


def test_ledger_stream_equals_the_batch_after_every_batch(spark, tmp_path):
    rnd, folder, fold = random.Random(5), tmp_path / "ledger", LedgerFold(spark, str(tmp_path / "fold"))
    (folder / "month=2026-01").mkdir(parents=True)
    at = T0
    for step in range(4):
        lines = []
        for _ in range(rnd.randrange(4, 9)):
            at += datetime.timedelta(minutes=1)
            lines.append(json.dumps({"id": f"n{rnd.randrange(14)}", "type": "T", "reason": rnd.choice("xy"), "successor": rnd.choice([None, *(f"n{k}" for k in range(16))]), "deleted_at": at.strftime("%Y-%m-%dT%H:%M:%SZ")}))
        if step == 1:
            lines += [json.dumps({"id": x, "type": "T", "reason": "ring", "successor": y, "deleted_at": at.strftime("%Y-%m-%dT%H:%M:%SZ")}) for x, y in (("r1", "r2"), ("r2", "r1"), ("r3", "r1"))] + ["no line"]
        if step == 3:
            lines += [json.dumps({"id": "r2", "type": "T", "reason": "out", "successor": "n1", "deleted_at": at.strftime("%Y-%m-%dT%H:%M:%SZ")})]
        (folder / "month=2026-01" / f"part-{step}.json").write_text("\n".join(lines) + "\n")
        query = ledger_stream(spark, str(folder)).writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).foreachBatch(fold).start()
        assert query.awaitTermination(180)
        good, _ = ledger.read(spark, str(folder))
        want = {r.id: r.final for r in ledger.final_successors(good).collect()}
        current, finals = fold.read()
        assert {r.id: r.final for r in finals.collect()} == want
        assert {(r.id, r.successor) for r in current.collect()} == {(r.id, r.successor) for r in ledger.current(good).select("id", "successor").collect()}
    before = fold._at()
    fold(current.limit(1).select(*[f.split()[0] for f in ledger.ENTRY.split(", ")]), 0)  # an old batch again
    assert fold._at() == before and current.filter(F.col("id") == "r1").count() == 1
