"""Coordinates as numpy tiles inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

TILE = 1 << 21  # numbers in a dense tile (16 MB of doubles)


def whole_groups(batches, keys: list[str]) -> Iterator:
    """Arrow tables that end where the ``keys`` change, of batches sorted by them. One batch
    and the last group, which may go on, are held at most."""
    import numpy as np
    import pyarrow as pa

    rest: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        changed = np.zeros(batch.num_rows, bool)
        for k in keys:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            changed[1:] |= column[1:] != column[:-1]
            changed[0] |= bool(rest) and rest[-1].column(k)[-1].as_py() != column[0]
        cuts = np.flatnonzero(changed)
        if not len(cuts):
            rest.append(table)
            continue
        cut = int(cuts[-1])
        whole = [*rest, table.slice(0, cut)] if cut else rest
        if whole:
            yield pa.concat_tables(whole).combine_chunks()
        rest = [table.slice(cut)]
    if rest:
        yield pa.concat_tables(rest).combine_chunks()


def dense_tiles(batches, group: str, row: str, at: str, value: str, width, cells: int = TILE) -> Iterator[tuple]:
    """(group, rows, tile): dense tiles of many rows of one group, from coordinates sorted by
    group and row; ``width`` gives a group's number of columns, or is a column's name."""
    import numpy as np

    for table in whole_groups(batches, [group, row]):
        g, r, place, v = (table.column(c).to_numpy() for c in (group, row, at, value))
        starts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])]))
        ends = np.append(starts[1:], len(g))
        widths = table.column(width).to_numpy() if isinstance(width, str) else None
        i = 0
        while i < len(starts):
            own = g[starts[i]]
            n = int(widths[starts[i]]) if widths is not None else int(width)
            j = i + 1
            while j < len(starts) and g[starts[j]] == own and j - i < max(1, cells // max(n, 1)):
                j += 1
            low, high = starts[i], ends[j - 1]
            tile = np.zeros((j - i, n))
            tile[np.repeat(np.arange(j - i), ends[i:j] - starts[i:j]), place[low:high]] = v[low:high]
            yield int(own), r[starts[i:j]], tile
            i = j


def of_rows(fn, tile, vectorized: bool):
    """One number for each row of a tile: by one call for all, or a call a row."""
    import numpy as np

    out = np.asarray(fn(tile), float) if vectorized else np.array([float(fn(v)) for v in tile])
    if out.shape != (len(tile),):
        raise ValueError("a vectorized function gives one number for each row of the tile")
    return out
