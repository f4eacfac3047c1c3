"""Linear grouping construction of a suffix array."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Start positions of the suffixes of `symbols` (non-negative integers) in order; a shorter prefix comes first.

    First phase: suffixes stand in groups, at first by their first symbol, and the groups are taken in
    descending order. For each member its previous smaller suffix is the nearest one to the left in a lower
    group; the suffixes so pointed to are moved, the most often pointed to last, into new groups directly
    above their old ones. In the end a group holds the suffixes with one Lyndon prefix. Second phase: going
    up the order, the suffix to the left of each placed one, and what its pointers lead to, take the next
    free places of their groups. Nothing is renamed or sorted again.
    """
    count = len(symbols)
    if not count:
        return []
    letters, first = np.unique(symbols, return_inverse=True)
    by_letter = np.argsort(first, kind="stable")
    ends = np.cumsum(np.bincount(first, minlength=len(letters))).tolist()
    # position 0 is a stand-in below everything; suffix i of the text is i + 1 here
    group = [0, *(first + 1).tolist()]
    members: list[list[int]] = [[0]]
    start = 0
    for end in ends:
        members.append((by_letter[start:end] + 1).tolist())
        start = end
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    previous = [0] * (count + 1)
    done = bytearray(count + 1)
    current = len(members) - 1
    while current > 0:
        own = members[current] = [i for i in members[current] if group[i] == current]
        pointed: list[int] = []
        times: list[int] = []
        last = -1
        for i in own:
            j = i - 1
            while done[j]:
                j = previous[j]
            previous[i] = j
            done[i] = 1
            if j == last:
                times[-1] += 1
            elif j:
                pointed.append(j)
                times.append(1)
                last = j
        if pointed:
            most = max(times)
            for level in range(most, 0, -1) if most < 9 else sorted(set(times), reverse=True):
                fresh: dict[int, int] = {}
                for j in pointed if most == 1 else [j for j, n in zip(pointed, times, strict=True) if n == level]:
                    old = group[j]
                    new = fresh.get(old)
                    if new is None:
                        new = fresh[old] = len(members)
                        members.append([j])
                        up = above[old]
                        below.append(old)
                        above.append(up)
                        above[old] = new
                        below[up] = new  # the highest group is never split, so there is one above
                    else:
                        members[new].append(j)
                    group[j] = new
        current = below[current]
    at = [0] * len(members)
    place, g = 0, above[0]
    while g >= 0:
        at[g] = place
        place += len(members[g])
        g = above[g]
    order = [0] * count
    placed = bytearray(count + 1)
    placed[0] = 1
    j = count
    for k in range(-1, count):
        if k >= 0:
            j = order[k] - 1
        while not placed[j]:
            placed[j] = 1
            g = group[j]
            order[at[g]] = j
            at[g] += 1
            j = previous[j]
    return [i - 1 for i in order]
