"""Task-side work of the state machine: state functions, composed by doubling.

A signal is a function from state to state, a row of a small array. The functions of all rows of an
Arrow batch are composed at once: in round k a row stands for 2^k neighbouring rows. The first row
of a unit leads to one state from wherever it is looked at, so nothing crosses the border of a
unit. Only the last state goes over to the next batch, so no group is ever held in memory.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Send these functions by value, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

START = 0  # kind of a row that carries a start state
SIGNAL = 1  # kind of a row that carries a signal
MISSING = -2**63  # stands for NULL; no signal and no state has this id
CELLS = 4_000_000  # most cells of the functions that are composed at once

OUTCOME_SCHEMA = ("unit_id bigint, event_id bigint, ts timestamp, signal_id bigint, "
                  "signal string, payload string, initial_state_id bigint, "
                  "final_state_id bigint")


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.fill_null(MISSING).to_numpy(zero_copy_only=False) if column.null_count \
        else column.to_numpy(zero_copy_only=False)


def _ids(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == MISSING)


def _group_starts(batch: pa.RecordBatch, last):
    """Which rows begin a new (unit, piece), and the group the batch ends in."""
    unit, piece = _numbers(batch, "unit_id"), _numbers(batch, "piece")
    fresh = np.ones(len(unit), bool)
    fresh[1:] = (unit[1:] != unit[:-1]) | (piece[1:] != piece[:-1])
    if len(unit):
        fresh[0] = (unit[0], piece[0]) != last
        last = (unit[-1], piece[-1])
    return fresh, last


def _slices(batches, width: int):
    rows = max(1, CELLS // width)
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class Machine:
    """The transitions as an array: a row for each signal, and one more for all that move nothing.

    States are numbered 0 to ``width - 1``. The column ``width`` stands for any other state, and as a
    value it says that such a state stays; other states are numbered behind it (``Codes``).
    """

    def __init__(self, moves: dict[int, dict[int, int]], states: list[int]):
        self.states = np.array(sorted({*states, *moves, *(t for m in moves.values() for t in m.values())}),
                               np.int64)
        self.signals = np.array(sorted({s for m in moves.values() for s in m}), np.int64)
        self.width = len(self.states)
        self.step = np.tile(np.arange(self.width + 1), (len(self.signals) + 1, 1))
        self.moves = np.zeros(self.step.shape, bool)
        for state, led in moves.items():
            for signal, target in led.items():
                at = np.searchsorted(self.signals, signal), np.searchsorted(self.states, state)
                self.step[at], self.moves[at] = np.searchsorted(self.states, target), True

    def signal_rows(self, signals: np.ndarray) -> np.ndarray:
        """The row of ``step`` for each signal."""
        return _positions(self.signals, signals, len(self.signals))

    def accepted(self, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.moves[rows, np.minimum(codes, self.width)]


def _positions(ordered: np.ndarray, values: np.ndarray, other: int) -> np.ndarray:
    """Where the values stand in ``ordered``; ``other`` for those that don't."""
    if not len(ordered):
        return np.full(len(values), other)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[at] == values, at, other)


class Codes:
    """Numbers for state ids: those of the machine, then further ids of a batch."""

    def __init__(self, machine: Machine, ids: np.ndarray):
        extra = np.unique(ids[_positions(machine.states, ids, -1) < 0])
        self.machine, self.extra = machine, extra
        self.ids = np.concatenate([machine.states, [MISSING], extra])

    def of(self, ids: np.ndarray) -> np.ndarray:
        known = _positions(self.machine.states, ids, -1)
        return np.where(known < 0, self.machine.width + 1 + np.searchsorted(self.extra, ids), known)


def _composed(later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """later after earlier, row by row."""
    n, columns = later.shape
    other = columns - 1
    led = later.ravel()[np.arange(0, n * columns, columns)[:, None] + np.minimum(earlier, other)]
    return np.where((earlier > other) & (led == other), earlier, led)


def _applied(functions: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return _composed(functions, codes[:, None])[:, 0]


def running(functions: np.ndarray, start: int) -> np.ndarray:
    """The state before every row, ``start`` before the first.

    Upwards, neighbours are composed, so that a row of round k stands for 2^k rows; downwards, the state
    before each such row gives those before its two halves. That is about two compositions a row.
    """
    levels = [functions]
    while len(levels[-1]) > 1:
        low = levels[-1]
        even = len(low) // 2 * 2
        levels.append(np.concatenate([_composed(low[1:even:2], low[0:even:2]), low[even:]]))
    before = np.array([start])
    for low in reversed(levels[:-1]):
        half = np.empty(len(low), np.int64)
        half[0::2] = before
        half[1::2] = _applied(low[0:len(low) // 2 * 2:2], before[:len(low) // 2])
        before = half
    return before


def summed(functions: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """One function per run of rows that begins at a ``fresh`` row: all its rows, one after the other."""
    runs = np.cumsum(fresh)
    while len(runs) and (runs[1:] == runs[:-1]).any():
        first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
        place = np.arange(len(runs)) - np.repeat(first, np.diff(np.append(first, len(runs))))
        kept = np.flatnonzero(place % 2 == 0)
        paired = kept[(kept + 1 < len(runs))]
        paired = paired[runs[paired + 1] == runs[paired]]
        functions = functions.copy()
        functions[paired] = _composed(functions[paired + 1], functions[paired])
        functions, runs = functions[kept], runs[kept]
    return functions


def replayer(moves: dict[int, dict[int, int]], initial: int):
    """Give every signal the state before it and, if the move exists, after it."""
    def run(batches):
        machine = Machine(moves, [initial])
        last, state = None, initial
        for batch in _slices(batches, machine.width):
            fresh, last = _group_starts(batch, last)
            starts = _numbers(batch, "kind") == START
            given = _numbers(batch, "state")
            codes = Codes(machine, np.concatenate([[state, initial], given[starts]]))
            (carried, first), given = codes.of(np.array([state, initial])), np.where(starts, given, initial)
            rows = machine.signal_rows(_numbers(batch, "signal_id"))
            functions = machine.step[rows]
            # what the first row of a unit starts from is known, and so is a start state
            fixed = fresh | starts
            led = np.where(starts, codes.of(given), _applied(functions, np.full(len(rows), first)))
            functions[fixed] = led[fixed, None]
            before = np.where(fresh, first, running(functions, carried))
            after = _applied(functions, before)
            reached = np.where(machine.accepted(rows, before), codes.ids[after], MISSING)
            out = pa.RecordBatch.from_arrays(
                [batch.column(name) for name in
                 ("unit_id", "event_id", "ts", "signal_id", "signal", "payload")]
                + [_ids(codes.ids[before]), _ids(reached)],
                ["unit_id", "event_id", "ts", "signal_id", "signal", "payload",
                 "initial_state_id", "final_state_id"])
            state = int(codes.ids[after[-1]])
            yield out.filter(pa.array(~starts)) if starts.any() else out

    return run


def composer(moves: dict[int, dict[int, int]], states: list[int]):
    """Sum a piece up as the state it leads to from each state of ``states``."""
    def run(batches):
        machine = Machine(moves, states)
        asked = _positions(machine.states, np.array(states, np.int64), 0)
        last, open_ = None, None
        for batch in _slices(batches, machine.width):
            before = last
            fresh, last = _group_starts(batch, last)
            functions = machine.step[machine.signal_rows(_numbers(batch, "signal_id"))]
            unit, piece = _numbers(batch, "unit_id")[fresh], _numbers(batch, "piece")[fresh]
            if open_ is not None:  # what the last batch ended with comes first
                functions = np.concatenate([open_[None], functions])
                fresh = np.concatenate([[True], fresh])
                unit, piece = np.append(before[0], unit), np.append(before[1], piece)
            leads = summed(functions, fresh)
            yield _summaries(machine, unit[:-1], piece[:-1], leads[:-1, asked])
            open_ = leads[-1]
        if open_ is not None:
            yield _summaries(machine, [last[0]], [last[1]], open_[None, asked])

    return run


def _summaries(machine: Machine, units, pieces, leads: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(len(leads) + 1, dtype=np.int32) * leads.shape[1]
    return pa.RecordBatch.from_arrays(
        [_ids(np.array(units, np.int64)), pa.array(pieces, pa.int64()),
         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(machine.states[leads.ravel()]))],
        ["unit_id", "piece", "leads"])


def chainer(states: list[int], initial: int):
    """Start state of each piece from the unit's start state and the pieces before it."""
    def run(batches):
        machine = Machine({}, states)
        order = _positions(np.array(states, np.int64)[np.argsort(states)], machine.states, 0)
        order = np.argsort(states)[order]
        last, state = None, initial
        for batch in _slices(batches, machine.width):
            unit = _numbers(batch, "unit_id")
            fresh = np.concatenate([[unit[0] != last], unit[1:] != unit[:-1]])
            last = unit[-1]
            leads, given = batch.column("leads"), _numbers(batch, "state")
            starts = np.asarray(leads.is_null())
            codes = Codes(machine, np.concatenate([[state, initial], given[starts]]))
            (carried, first), given = codes.of(np.array([state, initial])), np.where(starts, given, initial)
            functions = np.full((len(unit), machine.width + 1), machine.width)
            led = leads.filter(pa.array(~starts)).flatten().to_numpy().reshape(-1, len(states))[:, order]
            functions[~starts, :machine.width] = np.searchsorted(machine.states, led)
            fixed = fresh | starts
            led_first = np.where(starts, codes.of(given), _applied(functions, np.full(len(unit), first)))
            functions[fixed] = led_first[fixed, None]
            before = np.where(fresh, first, running(functions, carried))
            state = int(codes.ids[_applied(functions[-1:], before[-1:])[0]])
            before, kept = before[~starts], pa.array(~starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("unit_id").filter(kept), batch.column("piece").filter(kept),
                 _ids(codes.ids[before])], ["unit_id", "piece", "state"])

    return run
