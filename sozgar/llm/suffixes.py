"""Suffix array by grouping, in linear time and without renaming.

Suffixes are grouped by their longest Lyndon prefix. Phase 1 starts from groups of equal first symbols
and visits groups from the greatest down: each suffix of a group points to the nearest earlier suffix of
a smaller group (its previous-smaller pointer), and the targets leave their own groups for new ones
right above, by how many suffixes of the group point to them. Phase 2 emits the order: from each
suffix placed, the suffix before it and those on its chain of pointers take the next free places of
their groups.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray | bytes) -> np.ndarray:
    """Starts of all suffixes in order. A suffix that is a prefix of another comes first."""
    raw = np.frombuffer(symbols, np.uint8) if isinstance(symbols, (bytes, bytearray)) else np.asarray(symbols)
    n = len(raw) + 1  # with an end symbol below all others
    codes = np.zeros(n, np.int64)
    if n > 1:
        codes[:-1] = raw.astype(np.int64) - int(raw.min()) + 1
    # A group is named by the place where it begins; its members may be listed with some that have left.
    order = np.argsort(codes, kind="stable")
    heads = np.flatnonzero(np.diff(codes[order], prepend=-1))
    named = np.empty(n, np.int64)
    named[order] = np.repeat(heads, np.diff(heads, append=n))
    group = named.tolist()
    listed, bounds = order.tolist(), [*heads.tolist(), n]
    members: dict[int, list[int]] = {a: listed[a:b] for a, b in zip(bounds, bounds[1:], strict=False)}
    end_of = dict(zip(bounds, bounds[1:], strict=False))
    head_of = dict(zip(bounds[1:], bounds, strict=False))
    previous = [-1] * n
    end = n
    while end:
        head = head_of[end]
        own = members.pop(head)
        if len(own) != end - head:
            own = [s for s in own if group[s] == head]
        if len(own) > 1:
            own.sort()
        pointed: dict[int, int] = {}
        for s in own:
            p = s - 1
            while p >= 0 and group[p] >= head:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if len(pointed) == 1:
            leaving = (tuple(pointed),)
        else:
            by: dict[tuple[int, int], list[int]] = {}
            for p, k in pointed.items():
                by.setdefault((k, group[p]), []).append(p)
            leaving = [by[key] for key in sorted(by, reverse=True)] if len(by) > 1 else by.values()
        for some in leaving:
            was = group[some[0]]
            top = end_of[was]
            new = top - len(some)
            if new == was:  # the whole group: nothing to part
                continue
            for p in some:
                group[p] = new
            members[new] = list(some)
            end_of[was], head_of[new], end_of[new], head_of[top] = new, was, top, new
        end = head
    placed = [-1] * n
    free = list(range(n))
    done = bytearray(n)
    placed[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        j = placed[i] - 1
        while j >= 0 and not done[j]:
            name = group[j]
            at = free[name]
            free[name] = at + 1
            placed[at] = j
            done[j] = 1
            j = previous[j]
    return np.array(placed[1:], np.int64)
