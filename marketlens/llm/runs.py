"""Groups of consecutive rows with equal keys, read from sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def grouped(batches, keys: list[str]) -> Iterator[pa.Table]:
    """One table per run of equal keys; rows must come sorted by ``keys`` (all not null)."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t.column(k).to_numpy() for k in keys]
        change = np.zeros(len(t) - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(t)]
        if last is not None and tuple(c[0] for c in cols) != last:
            yield pa.concat_tables(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(t.slice(a, b - a))
            if b < len(t):
                yield pa.concat_tables(held)
                held = []
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.concat_tables(held)


class Forest:
    """Union-find over 0..n-1 for one task's group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def tie(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
