"""Suffix arrays by grouping, of many short strings side by side.

The construction is linear and names nothing anew.  Its first phase sorts the suffixes of a string by their longest
Lyndon prefixes.  At first a group holds the suffixes of one first letter.  Groups are processed in descending order:
each member points to the nearest suffix before it that stands in a lower group (its previous smaller suffix), and the
suffixes that are pointed to leave their group for new ones right behind it, the higher the more pointers they got.  The
second phase emits the order within the groups: the entries of the array are read from the first on; the suffix before
an entry takes the next free place of its group, and so do, one after another, its previous smaller suffixes, until one
has its place already.

Here one step serves all strings of a batch at once, as numpy arrays: a step of the first phase processes the highest
open group of every string, a step of the second takes one suffix of every string.  So a batch needs as many steps as
its longest string, and work in proportion to all its letters.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def _layout(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters, first and last place of each string: a root before each and an end behind, both below all letters."""
    sizes = np.array([len(s) + 2 for s in strings], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    text = np.full(int(sizes.sum()), 1, dtype=np.int64)
    text[starts] = 0
    if len(strings):
        text[_ranges(starts + 1, sizes - 2)] = np.concatenate(strings).astype(np.int64) + 2
    return text, starts, ends


def lyndon_groups(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first phase: for each suffix the first slot of its group, and its previous smaller suffix."""
    n = len(text)
    string = np.repeat(np.arange(len(starts)), ends - starts)
    at_slot = np.lexsort((text, string))  # by string, then first letter
    slot_of = np.empty(n, dtype=np.int64)
    slot_of[at_slot] = np.arange(n)
    letters = text[at_slot]
    new = np.ones(n, dtype=bool)
    new[1:] = (letters[1:] != letters[:-1]) | (string[at_slot][1:] != string[at_slot][:-1])
    firsts = np.flatnonzero(new)
    size = np.zeros(n, dtype=np.int64)  # of the group that begins at a slot
    size[firsts] = np.diff(np.append(firsts, n))
    group = np.empty(n, dtype=np.int64)
    group[at_slot] = np.repeat(firsts, size[firsts])
    before = np.arange(n) - 1
    root = np.zeros(n, dtype=bool)
    root[starts] = True
    mark = np.zeros(n, dtype=bool)
    upto, live = ends.copy(), np.flatnonzero(ends - starts > 2)
    while len(live):
        low = group[at_slot[upto[live] - 1]]
        members = at_slot[_ranges(low, upto[live] - low)]
        upto[live] = low
        own, to = group[members], before[members]
        while True:
            high = np.flatnonzero(group[to] >= own)
            if not len(high):
                break
            to[high] = before[to[high]]
            before[members[high]] = to[high]
        to = np.sort(to[~root[to]])
        if len(to):
            first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            pointed, pointers = to[first], np.diff(np.append(first, len(to)))
            of = group[pointed]
            order = np.lexsort((pointers, of))
            pointed, pointers, of = pointed[order], pointers[order], of[order]
            cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            counts, left = np.diff(np.append(cuts, len(of))), of[cuts]
            tail = _ranges(left + size[left] - counts, counts)
            # Members in the tail that stay change places with leaving ones outside it; both lists run by group.
            slots = slot_of[pointed]
            mark[tail] = True
            vacant = np.sort(slots[~mark[slots]])
            mark[tail] = False
            mark[slots] = True
            staying = tail[~mark[tail]]
            mark[slots] = False
            moved = at_slot[staying]
            at_slot[vacant], slot_of[moved] = moved, vacant
            at_slot[tail], slot_of[pointed] = pointed, tail
            size[left] -= counts
            apart = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (pointers[1:] != pointers[:-1])))
            counts = np.diff(np.append(apart, len(of)))
            size[tail[apart]] = counts
            group[pointed] = np.repeat(tail[apart], counts)
        live = live[upto[live] > starts[live] + 2]
    return group, before


def emit(group: np.ndarray, before: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The second phase: the suffix of each slot in full order; a string's slots are its places."""
    n = len(group)
    out = np.full(n, -1, dtype=np.int64)
    out[starts], out[starts + 1] = starts, ends - 1
    done = np.zeros(n, dtype=bool)
    done[starts], done[ends - 1] = True, True
    free = np.arange(n)  # the next free slot of the group that begins here
    live = np.flatnonzero(ends - starts > 2)
    last, at = ends[live], starts[live] + 1
    suffix = out[at] - 1
    while len(live):
        stop = done[suffix]
        going, stopped = np.flatnonzero(~stop), np.flatnonzero(stop)
        these = suffix[going]
        places = free[group[these]]
        out[places] = these
        free[group[these]] = places + 1
        done[these] = True
        suffix[going] = before[these]
        if len(stopped):
            at[stopped] += 1
            over = at[stopped] == last[stopped]
            if over.any():
                keep = np.ones(len(live), dtype=bool)
                keep[stopped[over]] = False
                stopped = stopped[~over]
                suffix[stopped] = out[at[stopped]] - 1
                live, last, at, suffix = live[keep], last[keep], at[keep], suffix[keep]
            else:
                suffix[stopped] = out[at[stopped]] - 1
    return out


def suffix_arrays(strings: list[np.ndarray]) -> list[np.ndarray]:
    """The suffix array of each string of bytes; a suffix stands before its own continuations."""
    text, starts, ends = _layout(strings)
    if not len(text):
        return []
    order = emit(*lyndon_groups(text, starts, ends), starts, ends)
    return [order[s + 2 : e] - s - 1 for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
