"""Suffix array by linear grouping (after Baier, "Linear-time suffix sorting", 2016).

Phase 1 visits groups of suffixes from the greatest down. A suffix's previous-smaller
pointer leads to the nearest suffix before it in a lower group; the suffixes that are
pointed to leave their group for new ones just above it, by how often they were
pointed to. Afterwards suffixes share a group exactly if they share their Lyndon
prefix. Phase 2 emits the order within groups from left to right along the same
pointers. No names are assigned anew and nothing is sorted recursively.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(s: Sequence[int]) -> list[int]:
    """Starts of the suffixes of s in ascending order; a suffix sorts before those it is a prefix of."""
    n = len(s)
    if n == 0:
        return []
    first: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        first.setdefault(c, []).append(i)
    # Groups form a list linked from low to high; group 0 is the empty suffix's.
    members: list[list[int]] = [[]]
    lower, higher = [-1], [-1]
    of = [0] * n
    for c in sorted(first):
        g = len(members)
        members.append(first[c])
        lower.append(g - 1)
        higher.append(-1)
        higher[g - 1] = g
        for i in first[c]:
            of[i] = g
    prev = [-1] * n
    done = bytearray(n)  # the suffix's group has been visited, or is being visited
    g = len(members) - 1
    while g > 0:
        own = [i for i in members[g] if of[i] == g]
        members[g] = own
        for i in own:
            done[i] = 1
        times: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            by_times: dict[int, dict[int, list[int]]] = {}
            for j, k in times.items():
                by_times.setdefault(k, {}).setdefault(of[j], []).append(j)
            for k in sorted(by_times, reverse=True):
                for old, moved in by_times[k].items():
                    new = len(members)
                    moved.sort()
                    members.append(moved)
                    up = higher[old]
                    lower.append(old)
                    higher.append(up)
                    higher[old] = new
                    if up >= 0:
                        lower[up] = new
                    for j in moved:
                        of[j] = new
        g = lower[g]
    # Phase 2: each group's next free place.
    place = [0] * len(members)
    at, g = 0, higher[0]
    while g >= 0:
        place[g] = at
        at += sum(1 for i in members[g] if of[i] == g)
        g = higher[g]
    out = [-1] * n
    put = bytearray(n)
    i = -1
    while i < n:
        j = (n if i < 0 else out[i]) - 1
        while j >= 0 and not put[j]:
            g = of[j]
            out[place[g]] = j
            place[g] += 1
            put[j] = 1
            j = prev[j]
        i += 1
    return out
