"""Keyed state of the streaming jobs. Times are microseconds, so no time zone is involved."""

from __future__ import annotations

import sys
from heapq import merge

from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTCOME = ("unit_id bigint, event_id bigint, at bigint, signal_id bigint, signal string, "
           "payload string, initial_state_id bigint, final_state_id bigint, outcome string")
ALERT = "unit_id bigint, state_id bigint, entered bigint, due bigint"


#: Most rows of a stored run; what the watermark cuts in two is written again up to this size.
RUN_ROWS = 4096
NO_ID = -2**63  # stands for NULL in the order of rows


def in_time(row):
    return row[0], NO_ID if row[1] is None else row[1]


class TimeRuns:
    """Rows (at, id, ...) of one key that wait for the watermark, as sorted runs.

    What a micro-batch brings is a new run, so nothing is read or written again when rows come. A
    run is read when the watermark passes its first row, and only what lies behind is put back.
    The number and first time of every run are kept together, in one value.
    """

    def __init__(self, handle, schema):
        self.index = handle.getValueState("index", "runs array<struct<id:bigint,first:bigint>>, next bigint")
        self.rows = handle.getMapState("runs", "id bigint", f"rows array<struct<{schema}>>")

    def _load(self):
        known, following = self.index.get() or ((), 0)
        return [tuple(run) for run in known], following

    def add(self, rows):
        """The least time of all rows that wait, or None."""
        known, number = self._load()
        rows = sorted(rows, key=in_time)
        for start in range(0, len(rows), RUN_ROWS):
            part = rows[start:start + RUN_ROWS]
            self.rows.updateValue((number,), (part,))
            known.append((number, part[0][0]))
            number += 1
        if rows:
            self.index.update((known, number))
        return min((first for _, first in known), default=None)

    def take(self, before):
        """(rows earlier than ``before`` in order, least time of the others or None)."""
        known, number = self._load()
        passed = [run for run, first in known if first < before]
        if not passed:
            return [], min((first for _, first in known), default=None)
        left, taken = [run for run in known if run[1] >= before], []
        for run in passed:
            rows = [tuple(row) for row in self.rows.getValue((run,))[0]]
            cut = next((n for n, row in enumerate(rows) if row[0] >= before), len(rows))
            taken.append(rows[:cut])
            if cut < len(rows):
                self.rows.updateValue((run,), (rows[cut:],))
                left.append((run, rows[cut][0]))
            else:
                self.rows.removeKey((run,))
        if left:
            self.index.update((left, number))
        else:
            self.index.clear()
        return list(merge(*taken, key=in_time)), min((first for _, first in left), default=None)


class OneTimer:
    """At most one event-time timer of a key, as early as anything needs it."""

    def __init__(self, handle):
        self.handle = handle
        self.at = handle.getValueState("timer", "at bigint")

    def need(self, wanted, fired=False):
        """A timer at the least of the times (milliseconds); None asks for nothing."""
        now = None if fired else (self.at.get() or (None,))[0]
        wanted = min((t for t in wanted if t is not None), default=None)
        if wanted is None or now is not None and now <= wanted:
            if fired:
                self.at.clear()
            return
        if now is not None:
            self.handle.deleteTimer(now)
        self.handle.registerTimer(wanted)
        self.at.update((wanted,))


def passing(at):
    """The first watermark, in milliseconds, that is behind a time."""
    return None if at is None else at // 1000 + 1


class Moves:
    """The state machine of one unit: what a signal leads to."""

    def __init__(self, moves, state, last):
        self.moves, self.state, self.last = moves, state, last

    def apply(self, row):
        at, event_id, signal_id, signal, payload = row
        if self.last is not None and (at, event_id) <= self.last:  # a repeated row is late
            return outcome(row, None, None, "late")
        self.last, before = (at, event_id), self.state
        reached = self.moves.get(before, {}).get(signal_id)
        if reached is not None:
            self.state = reached
        return outcome(row, before, reached, "rejected" if reached is None else "accepted")


def outcome(row, before, after, what):
    at, event_id, signal_id, signal, payload = row
    return Row(event_id=event_id, at=at, signal_id=signal_id, signal=signal, payload=payload,
               initial_state_id=before, final_state_id=after, outcome=what)


class OrderedSignalProcessor(StatefulProcessor):
    """Current state of a unit, moved by its signals in (time, id) order across micro-batches.

    Signals wait until the watermark has passed them, so that rows out of order within the
    delay are applied in order. Rows behind the watermark are handed out as ``late``.
    """

    def __init__(self, moves, initial):
        self.moves = moves
        self.initial = initial

    def init(self, handle):
        self.current = handle.getValueState("current", "state bigint, at bigint, event_id bigint")
        self.waiting = TimeRuns(handle, "at:bigint,event_id:bigint,signal_id:bigint,signal:string,payload:string")
        self.timer = OneTimer(handle)

    def handleInitialState(self, key, initialState, timerValues):
        self.current.update((initialState.state, initialState.at, -1))

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [(r.at, r.event_id, r.signal_id, r.signal, r.payload) for r in rows]
        for row in rows:
            if row[0] is None or row[0] < passed:
                yield Row(unit_id=key[0], **outcome(row, None, None, "late").asDict())
        first = self.waiting.add([row for row in rows if row[0] is not None and row[0] >= passed])
        self.timer.need([passing(first)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        ready, first = self.waiting.take(timerValues.getCurrentWatermarkInMs() * 1000)
        state, last = self.initial, None
        if self.current.exists():
            state, *last = self.current.get()
            last = tuple(last)
        unit = Moves(self.moves, state, last)
        for row in ready:
            yield Row(unit_id=key[0], **unit.apply(row).asDict())
        if ready:
            self.current.update((unit.state, *unit.last))
        self.timer.need([passing(first)], fired=True)

    def close(self):
        pass


class SignalProcessor(StatefulProcessor):
    """Current state of a unit, moved by its signals in (time, id) order.

    Within a micro-batch the unit's rows are sorted. A row older than one already handled is
    handed out as ``late`` and changes nothing. The source's limit per trigger
    (``maxFilesPerTrigger``, ``maxBytesPerTrigger``) bounds what a unit can bring at once.
    Without such a limit, or for a backlog, use :func:`replay_batches`.
    """

    def __init__(self, moves, initial):
        self.moves = moves
        self.initial = initial

    def init(self, handle):
        self.current = handle.getValueState(
            "current", "state bigint, at bigint, event_id bigint")

    def handleInitialState(self, key, initialState, timerValues):
        self.current.update((initialState.state, initialState.at, -1))

    def handleInputRows(self, key, rows, timerValues):
        state, last = self.initial, None
        if self.current.exists():
            state, *last = self.current.get()
            last = tuple(last)
        unit = Moves(self.moves, state, last)
        for row in sorted(rows, key=lambda r: (r.at, r.event_id)):
            yield Row(unit_id=key[0], **unit.apply(
                (row.at, row.event_id, row.signal_id, row.signal, row.payload)).asDict())
        self.current.update((unit.state, *unit.last))

    def close(self):
        pass


class WaitProcessor(StatefulProcessor):
    """One alert per stay that outlasts the allowed time, however the rows fall into micro-batches.

    Rows wait in time order until the watermark has passed them. Then the border moves over them:
    a watched row is an alert if the next row is too far away, and of the rows behind the border
    only the last is kept, whose stay may go on. A unit has one timer, for whichever comes first of
    the end of that stay's allowed time and the next row to be passed. So every row is stored
    and read once or twice. Rows behind the watermark are ignored.
    """

    def __init__(self, watched, micros):
        self.watched = watched
        self.micros = micros

    def init(self, handle):
        self.stay = handle.getValueState("stay", "at bigint, state bigint")
        self.waiting = TimeRuns(handle, "at:bigint,log_id:bigint,state:bigint")
        self.timer = OneTimer(handle)

    def decided(self, stay):
        """The first millisecond behind the allowed time; an end on time is no alert."""
        return None if stay is None else passing(stay[0] + self.micros)

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        first = self.waiting.add([(row.at, row.log_id, row.final_state_id) for row in rows
                                  if row.at is not None and row.at >= passed])
        self.timer.need([passing(first)])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        ready, first = self.waiting.take(now * 1000)
        held = self.stay.get()
        open_ = None if held is None else tuple(held)  # watched, not yet an alert
        for at, _, state in ready:
            if open_ is not None and at - open_[0] > self.micros:
                yield self._alert(key, open_)
            open_ = (at, state) if state in self.watched else None
        if open_ is not None and self.decided(open_) <= now:
            yield self._alert(key, open_)
            open_ = None
        if open_ is not None:
            self.stay.update(open_)
        elif held is not None:
            self.stay.clear()
        self.timer.need([passing(first), self.decided(open_)], fired=True)

    def _alert(self, key, stay):
        return Row(unit_id=key[0], state_id=stay[1], entered=stay[0], due=stay[0] + self.micros)

    def close(self):
        pass
