"""Suffix sorting by Lyndon groups without recursive renaming.

The visited groups are kept sorted by place, which costs a logarithm over linear time in the worst case.

Phase 1 begins with a group of suffixes for each symbol and visits the groups in descending order.
For each suffix of the visited group, its previous smaller pointer is the nearest suffix before it
that is in a lower group. Suffixes that are pointed to are longer Lyndon prefixes followed by the
group's own: they leave their group for new ones just above it, one for each number of pointers.
At the end a group holds the suffixes with one Lyndon prefix, and the groups are in order.

Phase 2 emits the order: a suffix's Lyndon prefix ends where its next smaller suffix begins, so going
through the suffixes in ascending order, each places those whose next smaller suffix it is at
the front of what is left of their groups.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np


def lyndon_groups(s: Sequence[int]) -> tuple[list[list[int]], list[int]]:
    """Groups of suffixes in ascending order, each with the length of its Lyndon prefix."""
    n = len(s)
    by_symbol = defaultdict(list)
    for i, x in enumerate(s):
        by_symbol[x].append(i)
    symbols = sorted(by_symbol)
    place = {x: g for g, x in enumerate(symbols)}
    members: list[list[int]] = [by_symbol[x] for x in symbols]
    length = [1] * len(symbols)
    above = [*range(1, len(symbols)), -1]
    below = list(range(-1, len(symbols) - 1))
    group = [place[x] for x in s]
    seen = [False] * n
    smaller = [-1] * n
    now = len(symbols) - 1
    ordered: list[int] = []
    while now >= 0:
        here = members[now]
        if here:
            here = [i for i in here if group[i] == now]
            here.sort()
            members[now] = here
        if here:
            ordered.append(now)
            for i in here:
                seen[i] = True
            pointed: dict[int, int] = {}
            for i in here:
                j = i - 1
                while j >= 0 and seen[j]:
                    j = smaller[j]
                smaller[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            new: dict[tuple[int, int], list[int]] = {}
            for j, times in pointed.items():
                new.setdefault((times, group[j]), []).append(j)
            grown = length[now]
            for times, old in sorted(new, reverse=True) if len(new) > 1 else new:
                g = len(members)
                moved = new[times, old]
                members.append(moved)
                length.append(length[old] + times * grown)
                up = above[old]
                above.append(up)
                below.append(old)
                above[old] = g
                if up >= 0:
                    below[up] = g
                for j in moved:
                    group[j] = g
        now = below[now]
    ordered.reverse()
    return [members[g] for g in ordered], [length[g] for g in ordered]


def suffix_array(s: Sequence[int]) -> np.ndarray:
    """Starts of the suffixes of s in ascending order. The last symbol of s must be its only smallest one."""
    n = len(s)
    groups, lengths = lyndon_groups(s)
    rank = [0] * n
    front = []
    at = 0
    followers: list[list[int]] = [[] for _ in range(n + 1)]
    for g, (members, size) in enumerate(zip(groups, lengths, strict=True)):
        front.append(at)
        at += len(members)
        for i in members:
            rank[i] = g
            followers[min(i + size, n)].append(i)
    out = [-1] * n
    if n:
        out[0] = n - 1
        front[rank[n - 1]] += 1
    for k in range(n):
        for i in followers[out[k]]:
            g = rank[i]
            out[front[g]] = i
            front[g] += 1
    return np.array(out, np.int64)
