"""State of the stream operators: calls a micro-batch, steps far ahead, marks and timers."""

import random

import pandas as pd
import pytest

from lumenact.operators import discover
from lumenact.plans import q_streams
from lumenact.streaming import guardrail as gr
from lumenact.streaming import run

STEPS = "sample_id long, label int, layer int, step int, is_last boolean, fired array<int>"


class Handle:
    """States in memory that count their calls; no value holds rows or sets."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def getMapState(self, name, keys, values):
        handle, kept = self, {}

        class Map:
            def getValue(self, key):
                handle.calls += 1
                return kept.get(key)

            def updateValue(self, key, value):
                handle.calls += 1
                kept[key] = value

            def removeKey(self, key):
                handle.calls += 1
                kept.pop(key, None)

            def keys(self):
                return iter(list(kept))

        Map.kept = kept
        return Map()

    def listTimers(self):
        return iter(list(self.timers))

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Clock:
    now = 0

    def getCurrentProcessingTimeInMs(self):
        return self.now


def _frame(rows, packs=1):
    frame = pd.DataFrame(rows, columns=["sample_id", "label", "layer", "step", "is_last", "fired"])
    return frame.assign(pack=frame["sample_id"] % packs)


def test_a_pack_is_read_and_written_once_a_micro_batch():
    handle, tracker = Handle(), gr.FirstFireTracker()
    tracker.init(handle)
    rows = [(s, 0, 0, t, t == 3, [t, s]) for s in range(100, 200) for t in range(4)]
    random.Random(5).shuffle(rows)
    got = []
    for start in range(0, 400, 100):
        handle.calls = 0
        frames = list(tracker.handleInputRows((0,), iter([_frame(rows[start:start + 100], packs=5)]), None))
        assert handle.calls <= 2 * 5 and len(frames) <= 1
        got += [tuple(r) for f in frames for r in f.itertuples(index=False)]
    want = {(s, 0, 0, f, t) for s in range(100, 200) for t in range(4) for f in (t, s) if f == t or t == 0}
    assert len(got) == len(want) and set(got) == want
    handle.calls = 0
    assert list(tracker.handleInputRows((0,), iter([_frame(rows, packs=5)]), None)) == [] and handle.calls == 5


@pytest.mark.parametrize("near", [1, 32])
def test_steps_far_ahead_wait_as_rows_of_their_own(spark, tmp_path, near):
    rng = random.Random(6)
    rows = [(s, 0, s % 2, t, t == 39, sorted(rng.sample(range(9), 2))) for s in range(6) for t in range(40)]
    late = [(s, 0, s % 2, 45, False, [8]) for s in range(6)]  # beyond the last step: never a step's turn
    sent = rows[::-1] + late + rows[::3]
    rng.shuffle(sent)
    for i in range(0, len(sent), 70):
        spark.createDataFrame(sent[i:i + 70], STEPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    tracker = gr.FirstFireTracker()
    tracker.near = near
    first = discover.first_fire(spark.createDataFrame(rows, STEPS))
    got = run.drain_append(gr._run(stream, tracker, gr.FIRED_SCHEMA, 2)).select(first.columns)
    assert sorted(got.collect()) == sorted(first.collect())


def test_nothing_far_ahead_is_left_of_a_closed_sequence():
    handle, tracker = Handle(), gr.FirstFireTracker()
    tracker.near = 1
    tracker.init(handle)
    ahead = [(s, 0, 0, t, False, [t]) for s in (1, 2) for t in (3, 5, 6)]
    assert list(tracker.handleInputRows((0,), iter([_frame(ahead)]), None)) == []
    assert set(tracker.far.kept) == {(s, 0, t) for s in (1, 2) for t in (5, 6)}
    end = [(1, 0, 0, t, t == 4, [t]) for t in (0, 1, 2, 4)]
    out = pd.concat(tracker.handleInputRows((0,), iter([_frame(end)]), None))
    assert sorted(out["first_step"]) == [0, 1, 2, 3, 4] and set(tracker.far.kept) == {(2, 0, 5), (2, 0, 6)}


def test_timers_close_a_silent_sequence_and_drop_its_mark():
    handle, clock = Handle(), Clock()
    guard = gr.Guardrail({gr.BIAS: [0.0, 0.1], 1: [2.0, 0.0]}, [0, 1], 0.99, 2, 6, idle_ms=1000)
    guard.init(handle)
    steps = _frame([(7, 1, 0, 0, False, [1]), (7, 1, 0, 2, False, [1])])
    assert list(guard.handleInputRows((7,), iter([steps]), clock)) == [] and handle.timers == [1000]
    clock.now = 1200
    out = pd.concat(guard.handleExpiredTimer((7,), clock, None))
    assert out.values.tolist()[0][:4] == [7, 1, 6, 0] and handle.timers == [1200 + gr.MARK_TIMES * 1000]
    assert list(guard.handleInputRows((7,), iter([steps]), clock)) == []
    clock.now = handle.timers[0]
    assert list(guard.handleExpiredTimer((7,), clock, None)) == [] and not guard.packs.kept


def test_many_batches_are_written_by_all_cores(spark, tmp_path):
    rows = [(s, 0, 0, t, t == 7, [t]) for s in range(200) for t in range(8)]
    stream = q_streams._steps_in_batches(spark, spark.createDataFrame(rows, STEPS))
    sizes = []
    stream.writeStream.foreachBatch(lambda df, _: sizes.append(df.count())).option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert len(sizes) == q_streams.BATCHES + q_streams.AGAIN and sum(sizes) == 2 * len(rows)
    assert max(sizes[:q_streams.BATCHES]) < len(rows) / 2
