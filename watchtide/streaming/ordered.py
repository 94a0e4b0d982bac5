"""A key's rows in order, in pieces of bounded size."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pandas as pd

#: Rows that are put in order at once, and rows of each such run that are held while runs are merged.
RUN, HELD = 250_000, 8_192


def in_order(frames: Iterable[pd.DataFrame], order: list[str], run: int = RUN, held: int = HELD) -> Iterator[pd.DataFrame]:
    """The frames' rows by ``order`` (columns without nulls), in frames one after the other.

    Up to ``run`` rows are sorted as they are. If there are more, sorted runs of that many wait in a temporary file of this
    task, which is gone when it is closed, and are merged with ``held`` rows of each in memory."""
    with tempfile.TemporaryFile() as file:
        waiting, n, starts = [], 0, []
        for x in frames:
            waiting.append(x)
            n += len(x)
            if n >= run:
                starts.append(_write(file, pd.concat(waiting).sort_values(order), held))
                waiting, n = [], 0
        last = pd.concat(waiting).sort_values(order) if n else None
        if not starts:
            yield from () if last is None else (last,)
            return
        if n:
            starts.append(_write(file, last, held))
        del waiting, last
        yield from _merged([_read(file, s) for s in starts], order)


def _write(file: BinaryIO, rows: pd.DataFrame, held: int) -> int:
    start = file.tell()
    for i in range(0, len(rows), held):
        pickle.dump(rows.iloc[i : i + held], file, pickle.HIGHEST_PROTOCOL)
    pickle.dump(None, file)
    return start


def _read(file: BinaryIO, at: int) -> Iterator[pd.DataFrame]:
    while True:
        file.seek(at)
        rows = pickle.load(file)
        if rows is None:
            return
        at = file.tell()
        yield rows


def _merged(runs: list[Iterator[pd.DataFrame]], order: list[str]) -> Iterator[pd.DataFrame]:
    """Each time, of what is held of every run, the rows up to the first end of a run's held rows."""
    heads = [(next(r), r) for r in runs]
    while heads:
        end = min(tuple(h[c].iloc[-1] for c in order) for h, _ in heads)
        ready, rest = [], []
        for h, r in heads:
            up_to = True  # by the last column of the order first
            for c, v in zip(reversed(order), reversed(end), strict=True):
                up_to = (h[c] < v) | ((h[c] == v) & up_to)
            n = int(up_to.sum())
            ready.append(h.iloc[:n])
            h = h.iloc[n:] if n < len(h) else next(r, None)
            if h is not None:
                rest.append((h, r))
        heads = rest
        yield pd.concat(ready).sort_values(order)
