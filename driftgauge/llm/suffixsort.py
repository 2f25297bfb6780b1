"""Suffix arrays by linear grouping, for many small collections of strings at once.

A suffix group holds the suffixes that share a Lyndon prefix. First phase: every collection's groups are processed in descending order; for each
member the previous smaller suffix is followed by pointers over what is already done, and those suffixes, whose Lyndon prefix has just grown by the
group's, move up inside their own group, by how many members they gained. Second phase: groups are emitted in ascending order; inside a group, order is that of the
suffixes that follow the Lyndon prefix, which are smaller and already ranked. Nothing is renamed and nothing recurses.

The collections are independent, so one step takes the current group of every collection together, in numpy.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def suffix_arrays(symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """symbols: strings one after the other, a -1 before each string and one at the end; owner: the collection of each cell, not descending.

    Returns the cells of all strings in suffix order, collection by collection. Equal suffixes of a collection come in any order.
    """
    n = len(symbols)
    cells = np.flatnonzero(symbols >= 0)
    order = cells[np.lexsort((symbols[cells], owner[cells]))]
    m = len(order)
    if not m:
        return order
    first = np.empty(m, bool)
    first[0] = True
    first[1:] = (symbols[order[1:]] != symbols[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    starts = np.flatnonzero(first)
    size = np.zeros(m + 1, np.int64)
    size[starts] = np.diff(np.append(starts, m))
    label = np.full(n, -1, np.int64)  # a cell's group is named by its first place
    label[order] = np.repeat(starts, size[starts])
    place = np.zeros(n, np.int64)
    place[order] = np.arange(m)
    back, length, moved = np.full(n, -1, np.int64), np.ones(n, np.int64), np.zeros(n, bool)

    owners = owner[order]
    low = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
    bottom, top = low.copy(), np.append(low[1:], m)
    while len(top):
        head = label[order[top - 1]]
        members = order[_ranges(head, top - head)]
        own = label[members]
        at = members - 1
        back[members] = at
        pending = np.flatnonzero(label[at] >= own)
        while len(pending):
            cell = members[pending]
            nxt = back[back[cell]]
            back[cell] = nxt
            pending = pending[label[nxt] >= own[pending]]
        parent = back[members]
        inside = label[parent] >= 0
        if inside.any():
            parent, grown = parent[inside], length[members[inside]]
            # gains of each parent
            by = np.argsort(parent, kind="stable")
            parent, grown = parent[by], grown[by]
            cut = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
            parent, gain = parent[cut], np.diff(np.append(cut, len(grown)))
            length[parent] += np.add.reduceat(grown, cut)
            group = label[parent]
            by = np.lexsort((gain, group))
            parent, gain, group = parent[by], gain[by], group[by]
            cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            count = np.diff(np.append(cut, len(group)))
            name = group[cut]
            tail = name + size[name] - count
            slots = _ranges(tail, count)
            # members that stay but stand in the tail swap with those that move
            moved[parent] = True
            there = order[slots]
            stay = there[~moved[there]]
            free = place[parent]
            free = free[free < np.repeat(tail, count)]
            order[free] = stay
            place[stay] = free
            moved[parent] = False
            order[slots] = parent
            place[parent] = slots
            size[name] -= count
            cut = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (gain[1:] != gain[:-1])))
            count = np.diff(np.append(cut, len(group)))
            label[parent] = np.repeat(slots[cut], count)
            size[slots[cut]] = count
        alive = head > bottom
        top, bottom = head[alive], bottom[alive]

    follower = np.arange(n) + length
    rank = np.full(n, -2, np.int64)
    rank[symbols < 0] = -1
    out = np.empty(m, np.int64)
    bottom, end = low, np.append(low[1:], m)
    while len(bottom):
        width = size[bottom]
        members = order[_ranges(bottom, width)]
        group = np.repeat(np.arange(len(bottom)), width)
        fill = bottom.copy()
        while len(members):
            key = rank[follower[members]]
            ready = key != -2
            now, g, key = members[ready], group[ready], key[ready]
            by = np.lexsort((key, g))
            now, g = now[by], g[by]
            count = np.bincount(g, minlength=len(fill))
            to = _ranges(fill, count)
            out[to] = now
            rank[now] = to
            fill += count
            members, group = members[~ready], group[~ready]
        bottom = bottom + width
        alive = bottom < end
        bottom, end = bottom[alive], end[alive]
    return out
