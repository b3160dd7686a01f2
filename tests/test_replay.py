"""The composed state functions against a plain walk over the rows."""

import random

import pyarrow as pa
import pytest
from statetrail.plans import replay

UNITS = [None, 1, 2, 5, 9]
SIGNAL_TYPES = {"unit_id": pa.int64(), "piece": pa.int32(), "kind": pa.int32(), "event_id": pa.int64(),
                "signal_id": pa.int64(), "signal": pa.string(), "payload": pa.string(),
                "state": pa.int64(), "ts": pa.timestamp("us")}
LINK_TYPES = {"unit_id": pa.int64(), "piece": pa.int32(), "state": pa.int64(), "leads": pa.list_(pa.int64())}


def batches(rows, types, size):
    return [pa.record_batch([pa.array([r.get(c) for r in rows[i:i + size]], t) for c, t in types.items()],
                            names=list(types)) for i in range(0, len(rows), size)]


def rows_of(out):
    return [row for batch in out for row in batch.to_pylist()]


def machine(rng):
    states = rng.sample(range(1, 12), rng.randint(1, 8))
    return states, {s: {g: rng.choice(states) for g in rng.sample(range(1, 7), rng.randint(0, 6))}
                    for s in rng.sample(states, rng.randint(0, len(states)))}


def signals(rng, states):
    for unit in UNITS:
        for piece in ([-1] if rng.random() < .5 else range(3)):
            if rng.random() < .5:
                yield {"unit_id": unit, "piece": piece, "kind": replay.START,
                       "state": rng.choice([*states, 99, 98, None])}
            for n in range(rng.choice([0, 1, 5, 40])):
                yield {"unit_id": unit, "piece": piece, "kind": replay.SIGNAL, "event_id": n,
                       "signal_id": rng.choice([*range(1, 7), None, 77])}


@pytest.mark.parametrize("seed", range(40))
@pytest.mark.parametrize("size", [1, 3, 1000])
def test_replayer_and_composer(seed, size):
    rng = random.Random(seed)
    states, moves = machine(rng)
    initial, rows = rng.choice(states), list(signals(rng, states))
    expected, group, state = [], (), None
    for row in rows:
        if (row["unit_id"], row["piece"]) != group:
            group, state = (row["unit_id"], row["piece"]), initial
        if row["kind"] == replay.START:
            state = row["state"]
            continue
        reached = moves.get(state, {}).get(row["signal_id"])
        expected.append((row["event_id"], state, reached))
        state = state if reached is None else reached
    found = rows_of(replay.replayer(moves, initial)(iter(batches(rows, SIGNAL_TYPES, size))))
    assert [(r["event_id"], r["initial_state_id"], r["final_state_id"]) for r in found] == expected

    asked = [r for r in rows if r["kind"] == replay.SIGNAL]
    sums = {}
    for row in asked:
        key = row["unit_id"], row["piece"]
        sums[key] = [moves.get(s, {}).get(row["signal_id"], s) for s in sums.get(key, states)]
    found = rows_of(replay.composer(moves, states)(iter(batches(asked, SIGNAL_TYPES, size))))
    assert [((r["unit_id"], r["piece"]), r["leads"]) for r in found] == list(sums.items())


@pytest.mark.parametrize("seed", range(40))
@pytest.mark.parametrize("size", [1, 3, 1000])
def test_chainer(seed, size):
    rng = random.Random(seed)
    states, _ = machine(rng)
    initial, rows, expected = rng.choice(states), [], []
    for unit in UNITS:
        state = initial
        if rng.random() < .5:
            state = rng.choice([*states, 99, None])
            rows.append({"unit_id": unit, "piece": -1, "state": state})
        for piece in range(rng.choice([0, 1, 4])):
            leads = [rng.choice(states) for _ in states]
            rows.append({"unit_id": unit, "piece": piece, "leads": leads})
            expected.append((unit, piece, state))
            state = dict(zip(states, leads)).get(state, state)
    found = rows_of(replay.chainer(states, initial)(iter(batches(rows, LINK_TYPES, size))))
    assert [tuple(r.values()) for r in found] == expected


def test_many_states_are_worked_on_in_slices(monkeypatch):
    monkeypatch.setattr(replay, "CELLS", 50)
    moves = {s: {1: s + 1} for s in range(20)}
    rows = [{"unit_id": 1, "piece": -1, "kind": replay.SIGNAL, "event_id": n, "signal_id": 1} for n in range(25)]
    found = rows_of(replay.replayer(moves, 0)(iter(batches(rows, SIGNAL_TYPES, 25))))
    assert [r["final_state_id"] for r in found] == [*range(1, 21), *[None] * 5]
