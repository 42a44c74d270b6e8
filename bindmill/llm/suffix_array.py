"""Suffix arrays by linear grouping: groups of Lyndon prefixes, built from the largest to the smallest, then emitted.

First part: suffixes start in groups by their first letter. Groups are taken in descending order. Every suffix of the
taken group points to the nearest earlier suffix of a smaller group; a suffix that k members point to continues its
prefix with the group's prefix k times, so the suffixes that are pointed to equally often leave their group for a new
one just above it, those with more behind those with fewer. In the end the suffixes of a group share their Lyndon
prefix. Second part: suffixes are written in ascending order; each written suffix brings the one before it, and along
its pointers all that are still unwritten, to the next free place of their groups. No level of renaming is needed.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` (numbers above 0) in ascending order."""
    text = [*text, 0]  # an end that is smaller than every letter
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group = [0] * n, [0] * n  # a suffix's place in ``order``; its group, named by the group's first place
    last = None
    for k, s in enumerate(order):
        place[s] = k
        if text[s] != last:
            first, last = k, text[s]
        group[s] = first
    size = [0] * n  # by a group's first place
    for g in group:
        size[g] += 1
    smaller = [-1] * n  # nearest earlier suffix of a smaller group
    end = n - 1
    while end > 0:
        start = group[order[end]]
        members = order[start:end + 1]
        end = start - 1
        if len(members) > 1:
            members.sort()
        pointed: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:  # taken before, or an earlier member: both have their pointers
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if not pointed:
            continue
        most = max(pointed.values())
        if most == 1:
            _split(list(pointed), order, place, group, size)
        else:
            by_count: dict[int, list[int]] = {}
            for p, k in pointed.items():
                by_count.setdefault(k, []).append(p)
            for k in sorted(by_count, reverse=True):
                _split(by_count[k], order, place, group, size)
    out, free = [0] * n, list(range(n))
    written = [False] * n
    out[0], written[n - 1] = n - 1, True
    for k in range(n):
        s = out[k] - 1
        while s >= 0 and not written[s]:
            written[s] = True
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            s = smaller[s]
    return out[1:]


def _split(leaving: list[int], order: list[int], place: list[int], group: list[int], size: list[int]) -> None:
    """Moves suffixes to the end of their groups, where those of one group form a new one."""
    ends: dict[int, int] = {}
    for s in leaving:
        g = group[s]
        to = ends.get(g)
        if to is None:
            to = g + size[g]
        to -= 1
        ends[g] = to
        other, at = order[to], place[s]
        order[to], order[at] = s, other
        place[s], place[other] = to, at
    for s in leaving:
        group[s] = ends[group[s]]
    for g, first in ends.items():
        if first != g:
            size[first] = g + size[g] - first
            size[g] = first - g
