"""Clip windows of rows in order, and which of them overlap removal keeps, many at a time.

Windows outnumber their rows by far, so they are made, scored and dropped inside the task that holds the rows;
only kept ones leave.  ``v`` holds the columns of the rows as arrays.
"""

from __future__ import annotations

import numpy as np

_NOWHERE = -(10**15)  # a range that shares no time with any other


def spans(v, starts, ends, crossings, bit, at, min_ms: int, max_ms: int):
    """(i, j, hook bits) of the windows from ``starts``, window length by window length, all starts at once.

    A start goes on until a row ends too late or begins too late, or to ``ends`` of its row.  ``crossings`` counts the hooks that cross into
    a row; ``bit`` and ``at`` hold them, row after row.
    """
    first = np.cumsum(crossings) - crossings
    i = starts
    latest, bits, j = v["end_ms"][i], np.zeros(len(i), np.int64), i
    while len(i):
        latest, bits = np.maximum(latest, v["end_ms"][j]), bits | v["hook_bits"][j]
        for k in range(crossings[j].max()):
            some = np.flatnonzero(crossings[j] > k)
            spot = first[j[some]] + k
            bits[some] |= np.where(at[spot] >= v["l0"][i[some]], bit[spot], 0)
        go = latest <= v["start_ms"][i] + max_ms
        i, j, latest, bits = i[go], j[go], latest[go], bits[go]
        hit = v["end_ms"][j] - v["start_ms"][i] >= min_ms
        if hit.any():
            yield i[hit], j[hit], bits[hit]
        j = j + 1
        go = j < ends[i]
        go[go] = v["start_ms"][j[go]] <= v["start_ms"][i[go]] + max_ms
        i, j, latest, bits = i[go], j[go], latest[go], bits[go]


def figures(v, i, j, hooks, target_ms: int) -> dict[str, np.ndarray]:
    """All that is told of windows but the media: counts by subtraction and the score, one formula, rounded to two decimals."""
    out = {
        "block": v["block"][i], "i": v["pos"][i], "j": v["pos"][j], "from_ms": v["start_ms"][i], "to_ms": v["end_ms"][j], "chars": v["chars"][j] - v["c0"][i],
        "questions": v["questions"][j] - v["q0"][i], "puncts": v["puncts"][j] - v["u0"][i], "pauses": v["pauses"][j] - v["pauses"][i],
        "hooks": hooks.astype(np.int32), "endings": v["endings"][j], "complete": v["complete"][j],
    }
    duration = np.maximum(0.1, (out["to_ms"] - out["from_ms"]) / 1000.0)
    target = target_ms / 1000.0
    density = np.minimum(26.0, out["chars"] / np.maximum(duration, 1.0) * 7.0)
    closeness = np.maximum(0.0, 22.0 - np.abs(duration - target) / max(target, 1.0) * 22.0)
    score = (
        20.0
        + out["hooks"] * 4.0
        + out["endings"] * 3.0
        + np.where(out["questions"] > 0, 8.0, 0.0)
        + np.minimum(8.0, out["puncts"] * 1.4)
        + np.minimum(6.0, out["pauses"] * 1.5)
        + density
        + closeness
        + np.where(out["complete"], 10.0, 3.0)
    )
    return out | {"score": np.floor(score * 100 + 0.5) / 100.0, "start_ms": centiseconds(out["from_ms"]) * 10, "end_ms": centiseconds(out["to_ms"]) * 10}


def centiseconds(ms: np.ndarray) -> np.ndarray:
    """As ``times.centiseconds``."""
    t = np.maximum(ms, 0)
    low, whole = t % 10, t // 10
    return whole + ((low > 5) | ((low == 5) & (whole % 2 == 1)))


def clash(s1, e1, s2, e2):
    """Shared time over the shorter duration (at least 1 s) above 0.65, in whole milliseconds."""
    shared = np.minimum(e1, e2) - np.maximum(s1, s2)
    return (shared > 0) & (shared * 100 > np.maximum(1000, np.minimum(e1 - s1, e2 - s2)) * 65)


def settle(start, end, score, cell, may) -> tuple[np.ndarray, np.ndarray]:
    """(windows kept, windows whose fate is open) of greedy overlap removal by score, ties in order.

    Windows are in order of (start, end) row.  ``cell`` numbers stretches of time from 1 on; windows of cells that are no neighbours never
    clash.  The best window of its own and both neighbour cells has no better rival left, so it is kept and removes what clashes with it, in all places
    at once.  Windows are kept only where they ``may``; the others stay open unless they are removed.
    """
    kept, left = [], np.arange(len(start))
    cells = int(cell[-1]) + 2 if len(cell) else 0
    while len(left):
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        best = np.maximum.reduceat(score, first)
        spot = np.flatnonzero(score == np.repeat(best, np.diff(np.append(first, len(score)))))
        spot = spot[np.append(True, cell[spot[1:]] != cell[spot[:-1]])]
        here = cell[spot]
        top = np.full(cells, -np.inf)
        top[here] = best
        # Cells follow the order of windows: of equal scores, the one in the cell before is first.
        won = spot[(best > top[here - 1]) & (best >= top[here + 1]) & may[spot]]
        if not len(won):
            break
        kept.append(left[won])
        ws, we = np.full(cells, _NOWHERE), np.full(cells, _NOWHERE)
        ws[cell[won]], we[cell[won]] = start[won], end[won]
        stay = np.ones(len(left), bool)
        stay[won] = False
        for d in (-1, 0, 1):
            stay &= ~clash(start, end, ws[cell + d], we[cell + d])
        left, start, end, score, cell, may = (x[stay] for x in (left, start, end, score, cell, may))
    return np.sort(np.concatenate(kept)) if kept else left[:0], left
