"""Trailing windows in keyed state over many batches, expiry, late rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from driftwatch.session import work_folder
from driftwatch.streaming import live, stateful

START = dt.datetime(2026, 3, 1)
SCHEMA = "elder_id string, ts timestamp, duration_sec double, emotion string, speech_rate double, pitch_mean double"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def arrive(spark, *batches):
    """A stream whose batches are the given rows, each ``(person, seconds)`` with a value that depends on them."""
    folder = work_folder(spark, "arrivals")
    for rows in batches:
        data = [(p, at(s), 1.0 + s % 7, "sad" if s % 3 == 0 else "neutral", 3.0 + s % 5, 180.0 + s % 11) for p, s in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def brute(batches, hours, late=3600):
    """Expected rows (person, second, hours) -> (count, seconds heard), by scanning all rows for every row.

    A batch loses the rows behind the watermark that the batch before it had.
    """
    seen, mark, want, last, drops = [], None, {}, {}, [None, None]
    for rows in batches:
        rows = sorted((p, s) for p, s in rows if drops[-2] is None or s >= drops[-2])
        seen += rows
        for p, s in rows:
            for h in hours:
                near = [x for q, x in seen if q == p and s - h * 3600 <= x <= s]
                want[p, float(s), float(h)] = (len(near), sum(1.0 + x % 7 for x in near))
                if p in last and s - last[p] > h * 3600:
                    want[p, last[p] + h * 3600 + .001, float(h)] = (0, 0.0)
            last[p] = max(s, last.get(p, s))
        mark = max([s for _, s in seen]) - late if seen else None
        drops.append(mark)
    for p, s in last.items():
        for h in hours:
            if s + h * 3600 + .001 <= mark:
                want[p, s + h * 3600 + .001, float(h)] = (0, 0.0)
    return want


def result(df):
    return {(r["elder_id"], (r["ts"] - START).total_seconds(), r["hours"]): (r["n_utterances"], round(r["total_duration"], 6)) for r in df.collect()}


def test_horizons_over_batches_equal_brute_force(spark):
    rnd = random.Random(5)
    batches = []
    for b in range(6):
        low = b * 9 * 3600
        rows = [(rnd.choice("aaab"), low + rnd.randrange(9 * 3600)) for _ in range(40)]
        rows += [("a", low - 600), ("a", low - 600), ("c", low // 2)] if b else []        # out of order; c is too late from some batch on
        batches.append(rows)
    stream = arrive(spark, *batches)
    got = result(live.run_available(stateful.trailing_horizons(stream, (24, 4, 1), digits=False), "t"))
    assert got == brute(batches, (24, 4, 1))
    assert any(n == 0 for n, _ in got.values())


def test_sliding_windows_over_batches_equal_the_table_and_keep_a_value_a_person(spark):
    rnd = random.Random(6)
    batches = []
    for b in range(6):
        low = b * 9 * 3600
        rows = [(rnd.choice("aaab"), low + rnd.randrange(9 * 3600)) for _ in range(40)]
        batches.append(rows + [("a", low - 600), ("a", low - 600)] * (b > 0) + [("c", 0)] * (b == 0))
    batches.append([("b", 60 * 3600)])      # the watermark ends at a window's end
    stream, folder = arrive(spark, *batches), work_folder(spark, "sliding")
    q = (live.sliding_features(stream, digits=False).writeStream.format("parquet").option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.createDataFrame([(p, at(s), 1.0 + s % 7, "sad" if s % 3 == 0 else "neutral", 3.0 + s % 5, 180.0 + s % 11)
                                  for b in batches for p, s in b], SCHEMA)
    want = live.sliding_features(rows, digits=False).filter(F.col("window_end") <= F.lit(at(59 * 3600)))
    six = [F.round(F.col(c) + 3e-8, 6).alias(c) if t == "double" else F.col(c) for c, t in want.dtypes]
    got, want = (sorted(map(tuple, df.select(*six).collect())) for df in (spark.read.parquet(f"{folder}/out"), want))
    assert got == want and max(r[2] for r in got) == at(59 * 3600)
    # Each person has a value and a timer with its index; panes that are still open have a row.
    assert sum(op.numRowsTotal for op in q.lastProgress.stateOperators) <= 3 * 3 + 1


def test_silence_is_told_once_and_the_state_goes(spark):
    batches = [[("a", 0)], [("b", 3 * 3600)], [("b", 7 * 3600)], [("a", 30 * 3600), ("b", 30 * 3600)], [("b", 60 * 3600)]]
    got = result(live.run_available(stateful.trailing_horizons(arrive(spark, *batches), (4, 1), digits=False), "t"))
    assert got == brute(batches, (4, 1))
    assert sorted(s for p, s, h in got if p == "a" and h == 1 and got[p, s, h][0] == 0) == [3600.001, 31 * 3600 + .001]


def test_a_session_without_the_state_store_is_told(spark):
    spark.conf.set(stateful.PROVIDER, "x")
    try:
        with pytest.raises(RuntimeError, match="RocksDB"):
            stateful.trailing_horizons(arrive(spark, [("a", 0)]))
        with stateful.rocksdb_store(spark):
            stateful.trailing_horizons(arrive(spark, [("a", 0)]))
        assert spark.conf.get(stateful.PROVIDER) == "x"
    finally:
        spark.conf.set(stateful.PROVIDER, stateful.ROCKSDB)
    with pytest.raises(ValueError):
        stateful.TrailingBuckets((900,))


def test_late_rows_are_kept_and_counted(spark):
    batches = [[("a", 0), ("b", 9 * 3600)], [("a", 60), ("b", 8 * 3600), ("a", 10 * 3600)], [("b", 8 * 3600 + 1), ("a", 9 * 3600)], [("a", 1)]]
    out, counter = work_folder(spark, "split"), live.LateCounter()
    q = live.split_late(arrive(spark, *batches), out, f"{out}/state", availableNow=True)
    q.awaitTermination()
    pick = lambda name: sorted((r["elder_id"], (r["ts"] - START).total_seconds()) for r in spark.read.parquet(f"{out}/{name}").collect())
    assert pick("late") == [("a", 1), ("a", 60), ("b", 8 * 3600 + 1)]
    assert len(pick("on_time")) + 3 == sum(map(len, batches))
    spark.streams.addListener(counter)
    try:
        sums = arrive(spark, *batches).withWatermark("ts", "1 hour").groupBy(F.window("ts", "10 minutes"), "elder_id").count()
        query = (sums.writeStream.format("noop").queryName("windows").outputMode("append")
                 .option("checkpointLocation", work_folder(spark, "c")).trigger(availableNow=True).start())
        query.awaitTermination()
        for _ in range(50):
            if counter.dropped["windows"]:
                break
            spark._jvm.Thread.sleep(100)
        assert counter.dropped["windows"] == live.late_rows(query) == 1
    finally:
        spark.streams.removeListener(counter)


def test_repeated_batches_of_the_split_change_nothing(spark):
    out = work_folder(spark, "split")
    stream = arrive(spark, [("a", 0), ("b", 9 * 3600)], [("a", 60)])
    for n in range(2):                                       # a second checkpoint begins again with batch 0
        live.split_late(stream, out, f"{out}/state{n}", availableNow=True).awaitTermination()
    assert spark.read.parquet(f"{out}/on_time").count() == 2 and spark.read.parquet(f"{out}/late").count() == 1


class Counted:
    """State of one person in memory; every call is counted."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, set()

    def _call(self, out=None):
        self.calls += 1
        return out

    def getValueState(self, *_):
        return self

    getMapState = getValueState
    get = lambda self: self._call(self.value)
    exists = lambda self: self._call(self.value is not None)
    update = lambda self, x: self._call(setattr(self, "value", x))
    getValue = lambda self, k: self._call(self.map.get(k))
    containsKey = lambda self, k: self._call(k in self.map)
    updateValue = lambda self, k, x: self._call(self.map.update({k: x}))
    removeKey = lambda self, k: self._call(self.map.pop(k, None))
    clear = lambda self: self._call(self.map.clear())
    registerTimer = lambda self, t: self._call(self.timers.add(t))
    deleteTimer = lambda self, t: self._call(self.timers.discard(t))
    listTimers = lambda self: self._call(iter(list(self.timers)))
    getCurrentWatermarkInMs = lambda self: 0


def run_state(few, batches, hours=(24, 4, 1)):
    state, held, out, calls = stateful.TrailingBuckets(tuple(h * 3600 for h in hours), few=few), Counted(), {}, []
    state.init(held)
    for seconds in batches:
        held.calls = 0
        rows = [("a", None, s * 1_000_000, 1.0, float(s % 7), 0.0, 0.0, 0.0, 0.0, 0.0) for s in seconds]
        out |= {(r[1], r[2]): (r[3], round(r[4], 6)) for r in state.handleInputRows(("a",), iter(rows), held)}
        calls.append(held.calls)
    return out, calls, held


def test_a_batch_of_few_instants_reads_and_writes_one_value():
    rnd = random.Random(3)
    batches = [sorted(rnd.randrange(b * 40_000, (b + 1) * 40_000) for _ in range(12)) for b in range(5)]
    out, calls, held = run_state(128, batches)
    assert max(calls) <= 4 and len(held.timers) == 1      # read, old timer, new timer, write
    seen = [s for b in batches for s in b]
    for t in seen:
        for h in (24, 4, 1):
            near = [s for s in seen if t - h * 3600 <= s <= t]
            assert out[t * 1_000_000, float(h)] == (len(near), sum(s % 7 for s in near))
    cut, _, kept = run_state(3, batches)                   # the same from buckets, from the second batch or so on
    assert cut == out and kept.map and not held.map


def test_a_person_goes_from_few_instants_to_buckets():
    batches = [[100, 5_000], [9_000, 9_100, 20_000, 30_000], [31_000]]
    assert run_state(4, batches)[0] == run_state(128, batches)[0] == run_state(0, batches)[0]
