"""A key's rows in order and in pieces, however many a micro-batch has."""

import random
from functools import partial

import pandas as pd
import pytest
from test_finality import folded, random_chain

from watchtide.streaming import state
from watchtide.streaming.ordered import in_order


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 5_000])
def test_pieces_in_order(n):
    r = random.Random(n)
    rows = [(r.randrange(max(n // 9, 1)), i, r.choice([None, f"x{i}"])) for i in range(n)]
    r.shuffle(rows)
    read, frames = [], (pd.DataFrame(rows[i : i + 30], columns=["now", "event_id", "x"]) for i in range(0, n, 30))
    for piece in in_order(frames, ["now", "event_id"], run=100, held=7):
        assert len(piece) <= max(100 + 30, 7 * (n // 100 + 1))
        read += piece.astype(object).where(piece.notna(), None).itertuples(index=False, name=None)
    assert read == sorted(rows, key=lambda x: x[:2])


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Map(dict):
    def iterator(self):
        return iter(list(self.items()))

    def removeKey(self, k):  # noqa: N802  Spark's names
        del self[k]

    def updateValue(self, k, v):  # noqa: N802
        self[k] = v


class Handle:
    def getValueState(self, *_):  # noqa: N802
        return Value()

    def getMapState(self, *_):  # noqa: N802
        return Map()


def test_a_chain_needs_no_memory_for_its_history(monkeypatch):
    """All of a chain in one micro-batch, its rows in any order: the fold's updates come piece by piece, and state is written once."""
    monkeypatch.setattr(state, "in_order", partial(in_order, run=200, held=10), raising=False)
    r = random.Random(5)
    rows = random_chain(r, "a", 4_000, 0, 0.05)
    names = ["event_id", "block_number", "block_hash", "event_key", "depth"]
    # the event's own depth where it asks for one, else the chain's
    table = pd.DataFrame([(e, b, h, k, max(1, d or 1) if q else 2) for _, e, b, h, k, q, d in rows], columns=names).sample(frac=1, random_state=1)
    processor = state.FinalityProcessor("", names, ["event_id"], ["chain", "event_id", "event_key", "status", "orphaned_from"], False)
    processor.init(Handle())
    got, largest = [], 0
    for half in (table[table["event_id"] < 2_000], table[table["event_id"] >= 2_000]):
        for out in processor.handleInputRows(("a",), (half.iloc[i : i + 50] for i in range(0, len(half), 50)), None):
            largest = max(largest, len(out))
            got += [(c, e, k, s, None if pd.isna(o) else int(o)) for c, e, k, s, o in out.itertuples(index=False)]
    assert sorted(map(str, got)) == folded(rows, {"a": 2}) and largest < len(got) / 10
