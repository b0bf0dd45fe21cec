"""Suffix arrays of many short segments: Larsson-Sadakane refinement and Kasai prefixes in numpy."""

from __future__ import annotations

import numpy as np


def _first_ranks(data: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Group numbers of the live positions by their first eight bytes; a group's number is its place in the order."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    keys = np.lib.stride_tricks.sliding_window_view(padded, 8)[live].copy().view(">u8").ravel().astype(np.uint64)
    order = np.argsort(keys)
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    rank = np.zeros(len(data), dtype=np.int64)
    rank[live[order]] = np.repeat(starts, np.diff(np.append(starts, len(live))))
    return rank


def _refine(rank: np.ndarray, live: np.ndarray, ahead: int) -> np.ndarray:
    """Ranks of the live positions by (own rank, rank ``ahead``). Only groups that are not yet single are sorted."""
    out = rank.copy()
    own = rank[live]
    order = np.argsort(own)
    ordered = own[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    single = new & np.append(new[1:], True)
    open_ = live[order[~single]]
    if not len(open_):
        return out
    key = (rank[open_] << 32) | rank[open_ + ahead]
    order = np.argsort(key)
    open_, key = open_[order], key[order]
    group = key >> 32
    place = np.arange(len(key))
    group_start = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), place, 0))
    key_start = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), place, 0))
    out[open_] = group + key_start - group_start
    return out


def window_order(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with ``width`` bytes before their segment's end, sorted by those bytes, and their common prefixes.

    ``ends`` are the ends of the segments in ``data``. Ranks by 8 bytes are
    doubled while they fit into ``width``; a last step overlaps to reach it
    exactly, so no comparison runs past a segment. The second result is the
    number of bytes, ``width`` at most, that each position shares with the one
    before it in the order.
    """
    starts = np.concatenate([[0], ends[:-1]])
    left = np.repeat(ends, ends - starts) - np.arange(len(data))
    live = np.flatnonzero(left >= width)
    if not len(live):
        return live, np.zeros(0, dtype=np.int64)
    depth = 8
    rank = _first_ranks(data, np.flatnonzero(left >= 8))
    while depth < width:
        ahead = min(depth, width - depth)
        depth += ahead
        rank = _refine(rank, np.flatnonzero(left >= depth), ahead)
    order = live[np.argsort(rank[live])]
    return order, _common_prefixes(data, starts, ends, order, width)


def _common_prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Kasai's walk, in all segments at once: from one position to the next a prefix loses one byte at most.

    That needs the neighbour's next position in the order, and before this one's
    next; otherwise (its segment ends, or ``width`` equal bytes left their order
    open) the comparison starts anew.
    """
    place = np.full(len(data), -1, dtype=np.int64)
    place[order] = np.arange(len(order))
    shared = np.zeros(len(order), dtype=np.int64)
    count = ends - starts - width + 1
    lanes = np.flatnonzero(count > 0)
    h = np.zeros(len(lanes), dtype=np.int64)
    carries = np.zeros(len(lanes), dtype=bool)
    step = 0
    while len(lanes):
        at = starts[lanes] + step
        where = place[at]
        before = order[np.maximum(where - 1, 0)]
        h = np.where((where > 0) & carries, np.maximum(h - 1, 0), 0)
        going = np.flatnonzero((where > 0) & (h < width))
        while len(going):
            same = data[at[going] + h[going]] == data[before[going] + h[going]]
            going = going[same]
            h[going] += 1
            going = going[h[going] < width]
        shared[where] = h
        step += 1
        stay = count[lanes] > step
        other = place[np.minimum(before[stay] + 1, len(data) - 1)]
        lanes, h = lanes[stay], h[stay]
        carries = (other >= 0) & (other < place[starts[lanes] + step])
    return shared
