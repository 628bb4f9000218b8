"""Live alignment with keyed state and timers: a word leaves once, with its owner, when the watermark passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.intervals import floor_div
from ..functions.text import UNKNOWN

#: Words wait for the end of their slice of a recording's time.  A key holds so many slices: a long recording is many keys, and a
#: key is worth the calls to the state store that it costs.
SLICE_MS, SLICES = 10_000, 60
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# State rows are blocks: all words, or turns, that came together.  ``close_ms`` is the end of the slice (of a turn: its last) on the clock.
_WORD = {"seg_id": "bigint", "word_idx": "int", "mid2": "bigint", "close_ms": "bigint"}
_TURN = {"t_start": "bigint", "t_end": "bigint", "turn_id": "bigint", "speaker": "string", "close_ms": "bigint"}
OUT = "episode_id {episode}, seg_id bigint, word_idx int, speaker string, turn_id bigint"


def _block(rows: pd.DataFrame, names: dict[str, str]) -> tuple:
    return tuple([None if v is None or v != v else v if kind == "string" else int(v) for v in rows[n].tolist()] for n, kind in names.items())


def _rows(state, names: dict[str, str]) -> list[tuple]:
    return [row for block in state.get() for row in zip(*block)] if state.exists() else []


def _columns(rows: list[tuple], count: int) -> list[list]:
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(count)]


class FirstOwner(StatefulProcessor):
    """State of a stretch of slices: the words of open ones, and the turns that reach into them; one timer, for the next slice to end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = lambda names: ", ".join(f"{n} array<{kind}>" for n, kind in names.items())
        self.words = handle.getListState("words", schema(_WORD))
        self.turns = handle.getListState("turns", schema(_TURN))
        self.next = handle.getValueState("next", "close_ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            is_word = batch["is_word"].to_numpy(bool)
            for state, part, names in ((self.words, batch[is_word], _WORD), (self.turns, batch[~is_word], _TURN)):
                if len(part):
                    state.appendValue(_block(part, names))
            low = int(batch["close_ms"].min())
            first = low if first is None else min(first, low)
        if first is not None:
            self._wake(first)
        return iter(())

    def _wake(self, at: int) -> None:
        """A timer for ``at``, in place of a later one."""
        set_for = self.next.get()[0] if self.next.exists() else None
        if set_for is None or at < set_for:
            if set_for is not None:
                self.handle.deleteTimer(set_for)
            self.handle.registerTimer(at)
            self.next.update((at,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All slices that the watermark has passed end now.
        ended = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        words, turns = _rows(self.words, _WORD), _rows(self.turns, _TURN)
        open_words, open_turns = [w for w in words if w[3] > ended], [t for t in turns if t[4] > ended]
        for state, left, count in ((self.words, open_words, len(_WORD)), (self.turns, open_turns, len(_TURN))):
            state.put([tuple(_columns(left, count))]) if left else state.clear()
        self.next.clear()
        if open_words or open_turns:
            self._wake(min(r[-1] for r in (*open_words, *open_turns)))
        done = [w for w in words if w[3] <= ended]
        if not done:
            return
        # The first of all turns that hold a word is the smallest (start, end, id).
        turns.sort(key=lambda t: (t[0], t[1], t[2] is not None, t[2] or 0))
        done.sort(key=lambda w: w[2])
        mid2 = np.array([w[2] for w in done], np.int64)
        owner = np.full(len(done), -1)
        for k, t in enumerate(turns):
            low, high = np.searchsorted(mid2, (2 * t[0], 2 * t[1]))
            held = owner[low:high]
            held[held < 0] = k
        seg, word, _, _ = _columns(done, len(_WORD))
        frame = pd.DataFrame({"episode_id": pd.Series([key[0]] * len(done), dtype=object), "seg_id": pd.array(seg, "Int64"), "word_idx": pd.array(word, "Int32")})
        frame["speaker"] = [(turns[k][3] or UNKNOWN) if k >= 0 else UNKNOWN for k in owner]
        frame["turn_id"] = pd.array([turns[k][2] if k >= 0 else None for k in owner], "Int64")
        yield frame

    def close(self) -> None:
        pass


def stream_align(words: DataFrame, turns: DataFrame, lateness: str = "10 minutes", clock: str = "started_at", slice_ms: int = SLICE_MS) -> DataFrame:
    """Words with the speaker of the first turn (start, end, id) that holds their midpoint; append mode.

    Event time is a word's midpoint and a turn's start on the recording's clock, so ``lateness`` is how long a row may
    take to arrive, and no longest turn has to be known: a turn that may still own a word is not late as long as the
    word waits.  A word leaves once, at the latest ``slice_ms`` after the watermark passed it, with its owner
    or ``Unknown``; turns are held until the slice of their end closes.  State and timers live in the RocksDB
    state store, which the session is set to.
    """
    words.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    end = F.greatest(F.col("end_ms"), F.col("start_ms"))
    mid2 = (F.col("start_ms") + end).cast("bigint")
    started = lambda ms: F.timestamp_micros(F.unix_micros(F.col(clock).cast("timestamp")) + ms * 1000)
    none = lambda kind: F.lit(None).cast(kind)
    close = lambda at: F.unix_millis(F.col(clock).cast("timestamp")) + (at + 1) * slice_ms
    at_word = floor_div(mid2, 2 * slice_ms)

    def shaped(df: DataFrame, is_word: bool, ts: Column, at: dict[str, Column], columns: dict[str, Column]) -> DataFrame:
        kinds = {"seg_id": "bigint", "word_idx": "int", "mid2": "bigint", "t_start": "bigint", "t_end": "bigint", "turn_id": "bigint", "speaker": "string"}
        picked = df.select("episode_id", clock, ts.alias("ts"), *(c.alias(n) for n, c in at.items()), *(columns[n].cast(k).alias(n) if n in columns else none(k).alias(n) for n, k in kinds.items()))
        return picked.select("episode_id", "stretch", "ts", F.lit(is_word).alias("is_word"), close(F.col("slice")).alias("close_ms"), *kinds)

    said = shaped(words, True, started(floor_div(mid2, 2)), {"slice": at_word, "stretch": floor_div(at_word, SLICES)}, {"seg_id": F.col("seg_id"), "word_idx": F.col("word_idx"), "mid2": mid2})
    last = F.greatest(F.col("end_ms") - 1, F.col("start_ms"))
    # A turn stays in each stretch until its last slice there ends.
    stretches = F.explode(F.sequence(floor_div(F.col("start_ms"), SLICES * slice_ms), floor_div(last, SLICES * slice_ms)))
    reaches = turns.where(F.col("end_ms") > F.col("start_ms")).withColumn("stretch", stretches)
    until = F.least(floor_div(last, slice_ms), (F.col("stretch") + 1) * SLICES - 1)
    held = shaped(
        reaches, False, started(F.col("start_ms")), {"slice": until, "stretch": F.col("stretch")},
        {"t_start": F.col("start_ms"), "t_end": F.col("end_ms"), "turn_id": F.col("turn_id"), "speaker": F.col("speaker")},
    )
    both = said.unionByName(held).withWatermark("ts", lateness)
    kind = words.schema["episode_id"].dataType.simpleString()
    return both.groupBy("episode_id", "stretch").transformWithStateInPandas(
        FirstOwner(), OUT.format(episode=kind), outputMode="Append", timeMode="EventTime"
    )
