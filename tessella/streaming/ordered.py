"""Keyed state in event-time order: rows wait in state until the watermark has passed them, then fold like their batch forms."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.operators.learners import ABILITY_STEP, FIRST_MASTERY, MASTERY_STEP, OFFSETS, WEAK


def _millis(micros: int) -> int:
    """The first whole millisecond that is not before."""
    return -(-micros // 1000)


class InOrder(StatefulProcessor):
    """Gives a key's rows to fold in the order of (at, id), each once, when no earlier row can come any more.

    Input rows have the columns `waiting` names, at in microseconds, and tick: a row with tick only moves the clock. Rows
    above the watermark are kept in list state, and a timer is set for the first of them. Spark leaves out rows that come
    when the watermark has already reached them, so an order that was used stays right.

    Each call of the state costs far more than a row: waiting rows are stored as one element a key and batch.
    """

    waiting: list[str]  # columns of a waiting row, at and id first
    out: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("waiting", "least long, rows binary")
        self.start(handle)

    def start(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def fold(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        """Result rows of input rows, which come in order."""
        raise NotImplementedError

    def expire(self, mark: int) -> None:
        """Forget what the watermark has made useless."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = [r[:-1] for frame in rows for r in zip(*[frame[c].tolist() for c in [*self.waiting, "tick"]]) if not r[-1]]
        yield from self._release(key, fresh, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        yield from self._release(key, [], mark)
        self.expire(mark)

    def _release(self, key: tuple, fresh: list[tuple], mark: int) -> Iterator[pd.DataFrame]:
        held = [(least, bytes(packed)) for least, packed in self.rows.get()]
        ready, rest, kept = [r for r in fresh if r[0] <= mark], [r for r in fresh if r[0] > mark], []
        for least, packed in held:
            if least > mark:
                kept.append((least, packed))
                continue
            for r in pickle.loads(packed):
                (ready if r[0] <= mark else rest).append(r)
        new = [(min(r[0] for r in rest), pickle.dumps(rest))] if rest else []
        if len(kept) == len(held):
            if new:
                self.rows.appendList(new)
        elif kept or new:
            self.rows.put(kept + new)
        else:
            self.rows.clear()
        if (new or len(kept) < len(held)) and kept + new:
            self.handle.registerTimer(_millis(min(least for least, _ in kept + new)))
        if ready:
            ready.sort(key=lambda r: r[:2])
            yield pd.DataFrame(self.fold(key, ready), columns=self.out)

    def close(self) -> None:
        pass


class LearnerState(InOrder):
    """Ability and mastery by topic in one value state; one result row an attempt."""

    waiting = ["at", "id", "topic", "difficulty", "correct"]
    out = ["user_id", "event_id", "at", "ability", "mastery", "next_topic"]

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "ability double, topics array<string>, mastery array<double>")

    def fold(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        ability, *topics = self.known.get() or (0.0, [], [])
        known = dict(zip(*topics))
        out = []
        for at, event, topic, difficulty, correct in rows:
            seen, topic = float(bool(correct)), topic or ""
            expected = 1 / (1 + math.exp(-(ability - OFFSETS.get(str(difficulty).upper(), 0.0))))
            ability = max(-3.0, min(3.0, ability + ABILITY_STEP * (seen - expected)))
            now = known.get(topic, FIRST_MASTERY)
            known[topic] = max(0.0, min(1.0, now + MASTERY_STEP * (seen - now)))
            weak = min(((m, t) for t, m in known.items() if m < WEAK), default=None)
            out.append((key[0], event, at, ability, known[topic], weak[1] if weak else None))
        self.known.update((ability, list(known), list(known.values())))
        return out


class CacheState(InOrder):
    """The time of the key's last write, until a timer of the time to live has run out; one result row a request."""

    waiting = ["at", "id"]
    out = ["key", "request_id", "at", "hit"]

    def __init__(self, ttl_micros: int):
        self.ttl = ttl_micros

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.written = handle.getValueState("written", "at long")

    def fold(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        (written,) = self.written.get() or (None,)
        before, out = written, []
        for at, request in rows:
            hit = written is not None and at - written < self.ttl
            written = written if hit else at
            out.append((key[0], request, at, hit))
        if written != before:
            self.written.update((written,))
            self.handle.registerTimer(_millis(written + self.ttl))
        return out

    def expire(self, mark: int) -> None:
        if (written := self.written.get()) and written[0] + self.ttl <= mark:
            self.written.clear()
