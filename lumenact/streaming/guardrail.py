"""Stateful operators over steps that arrive as a stream.

Steps of one sample may come late or out of order. A step that is ahead waits
in the state until the ones before it have come, so every decision is made on
a complete prefix and equals the batch result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.linear import BIAS, DIGITS, TIE

FIRED_SCHEMA = "sample_id long, layer int, label int, feature_id int, first_step int"
_STEP = "label int, is_last boolean, fired array<int>"
MARK_TIMES = 10
# Groups, and packs over all of them.
BUCKETS, PACKS = 1 << 10, 1 << 14
_ALONE = 0
DECISION_SCHEMA = "sample_id long, label int, tokens int, pred int, confidence double, early boolean"


class _InOrder(StatefulProcessor):
    """Hands the steps of one sequence to `advance` in order; `keys_schema` names the columns that tell sequences apart.

    Rows of one step that arrive together, or while the step still waits, are
    one step: what fired is united. A step sent again after its turn is
    ignored, and so is everything after the last step: a closed sequence keeps
    a mark, so a file read twice changes nothing.

    A group holds packs of sequences. A pack is one value, read once and written
    once a micro-batch that has steps for it: each sequence's progress, its mark
    and the lowest `near` steps that wait. Steps further ahead are rows of their
    own, which are touched when their turn comes.

    With `idle_ms` a group is one sequence. If it hears nothing for that long
    it is closed by a timer, which calls `expire`; its mark then lasts
    `MARK_TIMES` as long. Without it marks stay.
    """

    keys_schema = "sample_id long"
    progress_schema = "next_step int"
    idle_ms: int | None = None
    near = 32

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keys = [column.split()[0] for column in self.keys_schema.split(", ")]
        held = (f"{self.keys_schema}, {self.progress_schema}, closed boolean, "
                f"waiting array<struct<step int, {_STEP}>>, n_far int")
        self.packs = handle.getMapState("packs", "pack int", f"held array<struct<{held}>>")
        self.far = handle.getMapState("far", f"{self.keys_schema}, step int", _STEP)

    def start(self) -> list:
        """A fresh state: the next step, then whatever the processor keeps."""
        return [0]

    def load(self, stored: tuple) -> list:
        return list(stored)

    def store(self, state: list) -> tuple:
        return tuple(state)

    def advance(self, state: list, key, step: int, label: int, fired: set, is_last: bool) -> list[tuple]:
        """Rows that a step brings about; `state` changes in place."""
        raise NotImplementedError(type(self).__name__)

    def expire(self, state: list, key) -> list[tuple]:
        """Rows for a sequence that is closed without its last step."""
        return []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived: dict[int, dict[tuple, dict[int, list]]] = {}
        for frame in rows:
            for pack, own, step, label, fired, is_last in zip(
                    frame["pack"].tolist(), zip(*(frame[k].tolist() for k in self.keys), strict=True), frame["step"].tolist(),
                    frame["label"].tolist(), frame["fired"], frame["is_last"].tolist(), strict=True):
                known = arrived.setdefault(pack, {}).setdefault(own, {}).setdefault(step, [label, False, set()])
                known[1] |= is_last
                known[2].update(np.asarray(fired).tolist())
        out: list[tuple] = []
        while arrived:
            pack, sequences = arrived.popitem()
            held = self._held(pack)
            open_ones = [own for own in sequences if own not in held or not held[own][-3]]
            for own in open_ones:
                made, held[own] = self._arrive(own, held.get(own), sequences[own], timerValues)
                out.extend(made)
            if open_ones:
                self._hold(pack, held)
        if out:
            yield self.frame(out)

    def _arrive(self, own: tuple, kept: tuple | None, arrived: dict[int, list], timerValues) -> tuple[list[tuple], tuple]:
        """Rows that the steps of one open sequence bring about, with those that have waited, and what is kept of it."""
        state, steps, n_far = self._open(kept)
        closed = False
        for step, value in arrived.items():
            if step >= state[0]:
                steps[step] = self._united(value, steps.get(step))
        out: list[tuple] = []
        while not closed:
            step = state[0]
            ready = steps.pop(step, None)
            if n_far and (far := self.far.getValue((*own, step))) is not None:
                ready = self._united(far, ready)
                self.far.removeKey((*own, step))
                n_far -= 1
            if ready is None:
                break
            state[0] = step + 1
            out.extend(self.advance(state, own, step, int(ready[0]), ready[2], bool(ready[1])))
            closed = bool(ready[1])
        if closed:
            return out, self._close(own, n_far, timerValues)
        order = sorted(steps)
        for step in order[self.near:]:
            value = steps[step]
            if n_far and (far := self.far.getValue((*own, step))) is not None:
                value = self._united(value, far)
            else:
                n_far += 1
            self.far.updateValue((*own, step), self._plain(value))
        waiting = [(step, *self._plain(steps[step])) for step in order[:self.near]]
        if self.idle_ms is not None:
            self._wake(timerValues, self.idle_ms)
        return out, (*self.store(state), False, waiting, n_far)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        own = tuple(key)
        kept = self._held(_ALONE).get(own)
        if kept is not None and kept[-3]:
            self.packs.removeKey((_ALONE,))
            return
        state, _, n_far = self._open(kept)
        out = self.expire(state, own)
        self._hold(_ALONE, {own: self._close(own, n_far, timerValues)})
        if out:
            yield self.frame(out)

    def _held(self, pack: int) -> dict[tuple, tuple]:
        """What is kept of each sequence of a pack: progress, mark, steps that wait, number of steps further ahead."""
        stored, n = self.packs.getValue((pack,)), len(self.keys)
        # Plain tuples, as a state value holds no rows.
        return {tuple(h[:n]): (*h[n:-2], h[-2] and [tuple(w) for w in h[-2]], h[-1]) for h in stored[0]} if stored else {}

    def _hold(self, pack: int, held: dict[tuple, tuple]) -> None:
        self.packs.updateValue((pack,), ([(*own, *kept) for own, kept in held.items()],))

    def _open(self, kept: tuple | None) -> tuple[list, dict[int, list], int]:
        """(state, steps that wait, number of steps further ahead) of an open sequence."""
        if kept is None:
            return self.start(), {}, 0
        *progress, _, waiting, n_far = kept
        return self.load(tuple(progress)), {w[0]: self._united(w[1:]) for w in waiting}, n_far

    @staticmethod
    def _united(one, other=None) -> list:
        if other is None:
            return [one[0], one[1], set(one[2])]
        return [one[0], one[1] or other[1], set(one[2]) | set(other[2])]

    @staticmethod
    def _plain(value: list) -> tuple:
        return int(value[0]), bool(value[1]), sorted(value[2])

    def _wake(self, timerValues, after_ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + after_ms)

    def _close(self, own: tuple, n_far: int, timerValues) -> tuple:
        """The mark of a closed sequence."""
        if n_far:  # steps beyond the last one, or of a sequence that fell silent
            for key in [k for k in map(tuple, self.far.keys()) if k[:-1] == own]:
                self.far.removeKey(key)
        if self.idle_ms is not None:
            self._wake(timerValues, MARK_TIMES * self.idle_ms)
        return (*(None for _ in self.progress_schema.split(", ")), True, None, 0)

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError(type(self).__name__)

    def close(self) -> None:
        pass


class FirstFireTracker(_InOrder):
    """Emits each feature of a (sample, layer) once, at the step it first fires."""

    keys_schema = "sample_id long, layer int"
    progress_schema = "next_step int, seen array<int>"

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def start(self) -> list:
        return [0, set()]

    def load(self, stored):
        return [stored[0], set(stored[1])]

    def store(self, state):
        return state[0], sorted(state[1])

    def advance(self, state, key, step, label, fired, is_last):
        fresh = sorted(fired - state[1])
        state[1] |= fired
        return [(int(key[0]), int(key[1]), label, f, step) for f in fresh]

    def frame(self, rows):
        return pd.DataFrame(rows, columns=["sample_id", "layer", "label", "feature_id", "first_step"])


class Guardrail(_InOrder):
    """Decides once per sample: early when sure enough, else at its end.

    A sample that falls silent gets the decision of its end: `max_steps` and
    what its steps so far say.
    """

    progress_schema = "next_step int, label int, seen array<int>, scores array<double>, decided boolean"

    def __init__(
        self, weights: dict, classes: Sequence[int], target: float, min_steps: int, max_steps: int,
        idle_ms: int | None = None,
    ):
        self.idle_ms = idle_ms
        self.weights = {f: np.asarray(w) for f, w in weights.items()}
        self.classes = list(classes)
        self.target = target
        self.min_steps = min_steps
        self.max_steps = max_steps

    def start(self) -> list:
        return [0, None, set(), self.weights[BIAS].astype(float), False]

    def load(self, stored):
        return [stored[0], stored[1], set(stored[2]), np.asarray(stored[3], dtype=float), stored[4]]

    def store(self, state):
        return state[0], state[1], sorted(state[2]), state[3].tolist(), state[4]

    def _judge(self, scores: np.ndarray) -> tuple[int, float]:
        powers = np.exp(scores - scores.max())
        best = int(np.argmax(scores >= scores.max() - TIE))
        return self.classes[best], round(float(powers.max() / powers.sum()), DIGITS)

    def advance(self, state, key, step, label, fired, is_last):
        state[1] = label
        if state[4]:
            return []
        fresh = [f for f in fired if f in self.weights and f not in state[2]]
        state[2].update(fresh)
        for f in sorted(fresh):
            state[3] = state[3] + self.weights[f]
        pred, confidence = self._judge(state[3])
        t = step + 1
        sure = confidence >= self.target
        # After its last step a sample keeps its score, so a short one may
        # still be decided at min_steps.
        if sure and (t >= self.min_steps or (is_last and self.min_steps <= self.max_steps)):
            tokens, early = max(t, self.min_steps), max(t, self.min_steps) < self.max_steps
        elif is_last:
            tokens, early = self.max_steps, False
        else:
            return []
        state[2], state[3], state[4] = set(), np.zeros(0), True
        return [(int(key[0]), label, tokens, pred, confidence, early)]

    def expire(self, state, key):
        if state[4]:
            return []
        pred, confidence = self._judge(state[3])
        return [(int(key[0]), state[1], self.max_steps, pred, confidence, False)]

    def frame(self, rows):
        return pd.DataFrame(rows, columns=["sample_id", "label", "tokens", "pred", "confidence", "early"])


def _run(steps: DataFrame, processor: _InOrder, schema: str, packs: int) -> DataFrame:
    """The processor over sequences in `packs` packs by a hash, dealt over BUCKETS groups.

    What a call of the state costs is shared by the sequences of a pack. A pack
    is written whole, so where a micro-batch has steps of few of very many
    sequences, more packs are better. Timers belong to groups, so with
    `idle_ms` each sequence is a group.
    """
    types = [column.split() for column in processor.keys_schema.split(", ")]
    names = [name for name, _ in types]
    rows = steps.select(*(F.col(name).cast(kind).alias(name) for name, kind in types), "label", "step", "is_last", "fired")
    if processor.idle_ms is None:
        rows = rows.withColumn("pack", F.pmod(F.xxhash64(*names), F.lit(packs)).cast("int"))
        rows, names = rows.withColumn("bucket", F.col("pack") % BUCKETS), ["bucket"]
    else:
        rows = rows.withColumn("pack", F.lit(_ALONE))
    # Timers need the clock, and with it a stream that goes on: run to the end
    # of its input, such a stream would keep making batches.
    return rows.groupBy(*names).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append",
        timeMode="None" if processor.idle_ms is None else "ProcessingTime")


def track_first_fire(steps: DataFrame, idle_ms: int | None = None, packs: int = PACKS) -> DataFrame:
    """Stream of (sample_id, layer, label, step, is_last, fired) to first firings."""
    return _run(steps, FirstFireTracker(idle_ms), FIRED_SCHEMA, packs)


def guard(
    steps: DataFrame, weights: dict, classes: Sequence[int], target: float, min_steps: int, max_steps: int,
    idle_ms: int | None = None, packs: int = PACKS,
) -> DataFrame:
    """Stream of steps of one layer to one decision per sample.

    `weights` maps feature ids (and BIAS) to their weights per class: the
    chosen features of a fitted linear model.
    """
    return _run(steps, Guardrail(weights, classes, target, min_steps, max_steps, idle_ms), DECISION_SCHEMA, packs)


def collect_weights(weights: DataFrame, k: int) -> dict[int, list[float]]:
    """A weight table as a dictionary: the k chosen features and the bias."""
    rows = weights.limit(k + 2).collect()
    if len(rows) > k + 1:
        raise ValueError(f"expected the weights of at most {k} features")
    return {int(r["feature_id"]): list(r["w"]) for r in rows}
