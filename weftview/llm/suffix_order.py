"""Suffix order by linear grouping: Lyndon-prefix groups and previous-smaller pointers."""

from __future__ import annotations


def suffix_order(s: str) -> list[int]:
    """The suffixes of `s` in ascending order of their code points, a shorter one before those it
    begins.

    Suffixes start in groups by first symbol.  Groups are taken in descending order; for each
    member the pointer to the nearest earlier suffix of a lower group is found over the pointers
    known so far.  A suffix that is pointed at has the group's word appended to its own Lyndon
    prefix, so that it leaves its group for a new one just above it, one for each number of
    members that point at it.  When all groups are done, each holds the suffixes of one Lyndon
    prefix.  The order is then emitted from the lowest suffix on: each suffix put in place puts
    the one before it, and what that points at, at the next free place of their groups.  No
    string is renamed and nothing recurses; moves and pointers are linear in the length."""
    n = len(s)
    if not n:
        return []
    alphabet = sorted(set(s))
    members: list[list[int]] = [[] for _ in alphabet]
    number = {c: i for i, c in enumerate(alphabet)}
    group = [number[c] for c in s]
    for i, g in enumerate(group):
        members[g].append(i)
    above: list[int] = [*range(1, len(alphabet)), -1]
    below: list[int] = list(range(-1, len(alphabet) - 1))
    done = bytearray(n)
    prev = [-1] * n
    g = len(alphabet) - 1
    while g >= 0:
        rows = members[g] = [i for i in members[g] if group[i] == g]  # without those that have left
        for i in rows:
            done[i] = 1
        pointed: dict[int, int] = {}
        for i in rows:
            p = i - 1
            while p >= 0 and done[p]:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            moves: dict[tuple[int, int], list[int]] = {}
            if len(pointed) == 1:
                for p, k in pointed.items():
                    moves[k, group[p]] = [p]
                order = list(moves)
            else:
                for p in sorted(pointed):
                    moves.setdefault((pointed[p], group[p]), []).append(p)
                order = sorted(moves, reverse=True)  # more repeats stand higher: their group goes in first
            for key in order:
                host, part = key[1], moves[key]
                new = len(members)
                members.append(part)
                up = above[host]
                above.append(up)
                below.append(host)
                above[host] = new
                below[up] = new  # up is a group: only groups that are done have none above
                for p in part:
                    group[p] = new
        g = below[g]

    # where each group starts, ascending
    start = [0] * len(members)
    g, at = 0, 0
    while g >= 0:
        start[g] = at
        at += len(members[g])
        g = above[g]
    out = [0] * n
    placed = bytearray(n)

    i = n - 1
    while i >= 0:
        out[start[group[i]]] = i
        start[group[i]] += 1
        placed[i] = 1
        i = prev[i]
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[start[g]] = i
            start[g] += 1
            placed[i] = 1
            i = prev[i]
    return out
