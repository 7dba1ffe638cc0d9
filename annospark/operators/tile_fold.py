"""Greedy suppression of the boxes of one tile of a large image, in a task."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa

from annospark.functions.geometry import CONTAINED_FROM

DROPPED, KEPT, OPEN = range(3)
CORNERS = ("x1", "y1", "x2", "y2", "area")


def _floats(table: pa.Table, name: str, missing: float) -> np.ndarray:
    found = table.column(name).to_numpy().astype(float)
    return np.where(np.isnan(found), missing, found)


def _turns(ranks, places, at_rank, at_place) -> np.ndarray:
    """How many boxes of the tile come before a position; a missing position comes after all."""
    mine = list(zip(ranks, places))
    return np.array([bisect_left(mine, (r, p)) for r, p in zip(at_rank, at_place)], np.int64)


def fold(table: pa.Table, over: float, use_containment: bool) -> pa.Table:
    """``table`` in processing order with ``fate``: dropped, kept (accepted in its turn, though it may have been evicted since), or open.

    A box has its turn with all earlier boxes of the tile decided, except where something outside may matter: ``unsure`` says
    that an undecided box elsewhere may block it, ``threat`` is the position of the first undecided box elsewhere that may evict it,
    ``dead`` that of the first accepted one that does. A box that is blocked for sure is dropped whatever else is open.
    """
    order = np.lexsort((table.column("box_ord").to_numpy(), _floats(table, "rank", np.inf)))
    table = table.take(pa.array(order))
    ranks, places = _floats(table, "rank", np.inf), table.column("box_ord").to_numpy()
    x1, y1, x2, y2, area = (table.column(c).to_numpy() for c in CORNERS)
    until = lambda name: _turns(ranks, places, _floats(table, f"{name}_rank", np.inf), _floats(table, f"{name}_ord", np.inf))
    dead, threat = until("dead"), until("threat")
    unsure = table.column("unsure").to_numpy(zero_copy_only=False)
    fate = np.zeros(len(order), np.int8)
    with np.errstate(all="ignore"):
        for c in range(len(order)):
            k = np.flatnonzero(fate[:c])
            across = np.minimum(x2[k], x2[c]) - np.maximum(x1[k], x1[c])
            down = np.minimum(y2[k], y2[c]) - np.maximum(y1[k], y1[c])
            both = np.maximum(across, 0.0) * np.maximum(down, 0.0)
            meets = both > 0
            k, both = k[meets], both[meets]
            blocks = both / (area[k] + area[c] - both) > over
            if use_containment:
                blocks |= (area[c] <= area[k]) & (both / area[c] >= CONTAINED_FROM)
            alive = (fate[k] == KEPT) & (dead[k] > c)
            if (blocks & alive & (threat[k] > c)).any():
                continue
            open_ = unsure[c] or (blocks & (alive | (fate[k] == OPEN))).any()
            fate[c] = OPEN if open_ else KEPT
            if use_containment:
                gone = k[(fate[k] == KEPT) & (area[k] < area[c]) & (both / area[k] >= CONTAINED_FROM)]
                ends = threat if open_ else dead
                ends[gone] = np.minimum(ends[gone], c + 1)
    return table.append_column("fate", pa.array(fate, pa.int32()))
