"""Suffix arrays by linear grouping construction.

Suffixes are first grouped by their Lyndon prefix. Groups start as the equal first
symbols and are processed in descending order. For each suffix of a group its
*previous smaller* suffix is the nearest one to the left that lies in a lower group;
that one's Lyndon prefix is continued by this group's, so it moves behind the rest of
its own group, the further the more members of this group follow it. When all groups
are processed they are the Lyndon prefixes in order. Second, the order within each
group is emitted: going through the array in ascending order, the suffixes whose Lyndon
prefix ends where the current one begins (its left neighbour and the chain of
previous-smaller pointers from there) take the next places of their groups. No names
are assigned anew and nothing recurses.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of all suffixes in ascending order; a suffix that is a
    prefix of another comes first."""
    n = len(text)
    if n == 0:
        return []
    order = sorted(range(n), key=text.__getitem__)
    place, group, end = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for i, s in enumerate(order):
        if text[s] != text[order[start]]:
            end[start], start = i, i
        place[s], group[s] = i, start
    end[start] = n

    # phase 1: groups of equal Lyndon prefixes
    unset = -2
    prev = [unset] * n
    done = n
    while done > 0:
        low = group[order[done - 1]]
        if low == done - 1:
            # a group of one: its previous smaller suffix moves behind the rest of its group
            s = order[low]
            p = prev[s]
            if p == unset:
                p = s - 1
                while p >= 0 and group[p] >= low:
                    p = prev[p]
                prev[s] = p
            done = low
            if p >= 0:
                g = group[p]
                e = end[g] - 1
                if e != g:
                    other, at = order[e], place[p]
                    order[at], order[e] = other, p
                    place[other], place[p] = at, e
                    group[p], end[g], end[e] = e, e, e + 1
            continue
        follows: dict[int, int] = {}
        most = 1
        for s in order[low:done]:
            p = prev[s]
            if p == unset:
                p = s - 1
                chain = [s]
                while p >= 0 and group[p] >= low:
                    q = prev[p]
                    if q == unset:
                        chain.append(p)
                        p -= 1
                    else:
                        p = q
                for q in chain:
                    prev[q] = p
            if p >= 0:
                if p in follows:
                    c = follows[p] = follows[p] + 1
                    if c > most:
                        most = c
                else:
                    follows[p] = 1
        done = low
        if most == 1:
            classes = [follows]
        else:
            by_count: dict[int, list[int]] = {}
            for p, c in follows.items():
                by_count.setdefault(c, []).append(p)
            classes = [by_count[c] for c in sorted(by_count, reverse=True)]
        # each class moves behind the rest of its groups and becomes groups of its own
        for members in classes:
            ends: dict[int, int] = {}
            for p in members:
                g = group[p]
                e = end[g]
                if g not in ends:
                    ends[g] = e
                e -= 1
                end[g] = e
                at = place[p]
                if at != e:
                    other = order[e]
                    order[at], order[e] = other, p
                    place[other], place[p] = at, e
            for p in members:
                group[p] = end[group[p]]
            for g, e in ends.items():
                first = end[g]
                end[first] = e
                if first != g:
                    end[g] = first

    # phase 2: the order within each group
    out = [-1] * n
    free = list(range(n))          # next place of the group that starts here
    placed = bytearray(n)
    s = n
    for i in range(-1, n):
        if i >= 0:
            s = out[i]
        s -= 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = prev[s]
    return out


def common_prefixes(text: Sequence[int], order: list[int]) -> list[int]:
    """Length of the common prefix of each suffix with the one before it in order."""
    n = len(order)
    before = [-1] * n
    for a, b in zip(order, order[1:]):
        before[b] = a
    by_start, h = [0] * n, 0
    for s in range(n):
        p = before[s]
        if p < 0:
            h = 0
            continue
        top = n - max(s, p)
        while h < top and text[s + h] == text[p + h]:
            h += 1
        by_start[s] = h
        if h:
            h -= 1
    return [by_start[s] for s in order]
