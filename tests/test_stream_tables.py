"""Tables that streams write: crashes and restarts leave each row once."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import sessions as Z
from tessera.streaming import tables as ST

from .test_streams import in_order

DAY = datetime(2024, 1, 1, tzinfo=UTC)
TURN = "harness string, session_id string, position int, text string"


def go(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(300)
    return q


def appended(spark, path):
    df = spark.createDataFrame([], TURN)
    return sorted((r.session_id, r.position) for r in ST.Appends(spark, path, ("harness", "session_id", "position")).read(df.schema).collect())


BATCHES = [[("h", s, p, f"{s}{p}") for s in "abc" for p in range(start, start + 4)] for start in (0, 2, 6)]
ALL = sorted((s, p) for s in "abc" for p in range(10))


@pytest.mark.parametrize("crash", ["after intent", "after rows", "after filters"])
def test_a_crash_leaves_each_row_once(spark, tmp_path, monkeypatch, crash):
    stream = in_order(spark, BATCHES, TURN, tmp_path, "in")
    writer = lambda: ST.dedup_append(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    calls = []

    def failing(real):
        def run(*args):
            calls.append(1)
            if len(calls) == 2:
                raise RuntimeError("crash")
            return real(*args)

        return run

    with monkeypatch.context() as m:
        if crash == "after intent":
            real = ST.Log.write
            m.setattr(ST.Log, "write", lambda self, name, value: (real(self, name, value), self.path.endswith("intents") and failing(lambda: None)())[0])
        elif crash == "after rows":
            m.setattr(ST.Appends, "read_batch", failing(ST.Appends.read_batch))
        else:
            m.setattr(ST.Appends, "confirm", failing(ST.Appends.confirm))
        with pytest.raises(Exception, match="crash"):
            go(writer())
    assert len(appended(spark, f"{tmp_path}/out")) == 12  # the first batch only
    go(writer())
    assert appended(spark, f"{tmp_path}/out") == ALL
    go(ST.dedup_append(stream, f"{tmp_path}/out", f"{tmp_path}/lost"))  # reads all again
    assert appended(spark, f"{tmp_path}/out") == ALL


def test_only_batches_that_may_hold_a_key_are_read(spark, tmp_path):
    log = ST.Appends(spark, f"{tmp_path}/t", ("session_id", "position"))
    make = lambda s, low, high: spark.createDataFrame([(s, p) for p in range(low, high)], "session_id string, position int")
    for i in range(6):
        assert log.append(make(f"s{i}", 0, 50), f"b{i}") == 50
    assert log.candidates(log.hashed(make("s3", 10, 12))) == [(log.hashed(make("s3", 0, 1)).first().block, "b3")]
    assert log.candidates(log.hashed(make("s3", 900, 905))) == []
    assert log.append(make("s3", 40, 60), "b9") == 10 and log.append(make("s3", 40, 60), "b9") == 10
    twice = spark.createDataFrame([("n", 1), ("n", 1), (None, 1), (None, 1)], "session_id string, position int")
    assert log.append(twice, "c0") == 2 and log.append(twice, "c1") == 0
    assert log.read(twice.schema).count() == 312


def test_late_rows_are_set_aside_and_counted(spark, tmp_path):
    at = lambda m: DAY + timedelta(minutes=m)
    batches = [[(1, at(0)), (2, at(30))], [(3, at(21)), (4, at(19)), (5, None)], [(6, at(60)), (7, at(10))], [(8, at(49)), (9, at(51))]]
    stream = in_order(spark, batches, "id int, ts timestamp", tmp_path, "in")
    seen, crash = {}, [True]

    def on_time(df, batch_id):
        if batch_id == 2 and crash:
            crash.clear()
            raise RuntimeError("crash")
        seen[batch_id] = sorted(r.id for r in df.collect())

    writer = lambda: ST.split_late(stream, f"{tmp_path}/side", f"{tmp_path}/check", on_time)
    with pytest.raises(Exception, match="crash"):
        go(writer())
    go(writer())
    assert seen == {0: [1, 2], 1: [3, 5], 2: [6], 3: [9]}
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/side/late").collect()) == [4, 7, 8]
    assert [(r.rows, r.late) for r in ST.late_counts(spark, f"{tmp_path}/side").orderBy("batch").collect()] == [(2, 0), (3, 1), (2, 1), (2, 1)]
    # the same as on a table, batch after batch
    newest, late = None, []
    for rows in batches:
        df = spark.createDataFrame(rows, "id int, ts timestamp")
        if newest:
            late += [r.id for r in ST.late_rows(df, F.lit(newest - timedelta(minutes=10)))[1].collect()]
        newest = max(t for _, t in rows if t) if not newest else max(newest, *(t for _, t in rows if t))
    assert sorted(late) == [4, 7, 8]


def test_turns_become_records_once(spark, tmp_path, monkeypatch):
    at = lambda m: DAY + timedelta(minutes=m)
    talk = lambda s, low, high, m: [(s, p, "user" if p % 2 == 0 else "assistant", f"{s}{p}", at(m), 10) for p in range(low, high)]
    batches = [talk("a", 0, 3, 0) + talk("b", 0, 2, 0), talk("a", 3, 6, 5) + talk("b", 1, 2, 5), talk("c", 0, 1, 3000), talk("a", 4, 7, 3001)]
    schema = "session_id string, pos long, role string, text string, ts timestamp, tokens long"
    stream = in_order(spark, batches, schema, tmp_path, "in")
    writer = lambda: ST.stream_ingest(stream, f"{tmp_path}/t", f"{tmp_path}/check", tokens=50, messages=4, idle_seconds=3600)
    real, calls = ST.Log.write, []

    def failing(self, name, value):
        calls.append(name)
        if len(calls) == 2:
            raise RuntimeError("crash")
        real(self, name, value)

    with monkeypatch.context() as m:
        m.setattr(ST.Log, "write", failing)
        with pytest.raises(Exception, match="crash"):
            go(writer())
    go(writer())
    tables = ST.Ingest(spark, f"{tmp_path}/t")
    got = {r.id: (r.messages, r.tokens, r.content) for r in tables.records().collect()}
    # a: 6 messages by the second batch, packed by turns into 4 and 2; b: idle by the third
    assert got == {
        "a#0": (4, 40, "user: a0\nassistant: a1\nuser: a2\nassistant: a3"), "a#4": (2, 20, "user: a4\nassistant: a5"), "b#0": (2, 20, "user: b0\nassistant: b1"),
    }
    assert sorted((r.session_id, r.pos) for r in tables.pending().collect()) == [("a", 6), ("c", 0)]
    batch = Z.extraction_batches(Z.turns(spark.createDataFrame([("a", p, "user" if p % 2 == 0 else "assistant", False, 10) for p in range(6)], "conv_id string, pos long, role string, is_tool boolean, tokens long")), 50, 4)
    assert sorted((r.pos, r.batch) for r in batch.collect()) == [(0, 0), (2, 0), (4, 1)]


def test_append_joins_all_blocks_at_once(spark, tmp_path, monkeypatch):
    """Old rows of all batches and blocks that may have a key meet new ones in one join, not one for each."""
    rows = lambda a, b: spark.range(a, b).select((F.col("id") % 40).alias("s"), "id")
    log, calls = ST.Appends(spark, f"{tmp_path}/once", ("s", "id")), []
    assert (log.append(rows(0, 200), "a"), log.append(rows(100, 300), "b")) == (200, 100)
    kind = type(rows(0, 1))
    join = kind.join
    monkeypatch.setattr(kind, "join", lambda self, *a: calls.append(a) or join(self, *a))
    assert log.append(rows(50, 400), "c") == 100 and len(calls) == 1
    assert sorted(r.id for r in log.read(rows(0, 1).schema).collect()) == [*range(400)]
