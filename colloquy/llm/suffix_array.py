"""Suffix array by linear grouping.

Phase 1 groups the suffixes by their longest Lyndon prefix, in the order of these prefixes: suffixes start grouped by
their first symbol, groups are taken from the highest down, and each taken group splits the groups of its members'
previous smaller suffixes by how many members point to them. Phase 2 walks the array from the smallest suffix up and
emits the order inside every group: a suffix is placed when the one that follows its Lyndon prefix is.
Nothing is renamed and sorted again.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in order; symbols are integers of at least 0, an end below all is implied."""
    n = len(text) + 1
    start: dict[int, int] = {}
    count: dict[int, int] = {}
    for c in text:
        count[c] = count.get(c, 0) + 1
    at = 1
    for c in sorted(count):
        start[c] = at
        at += count[c]
    order = [0] * n  # suffixes, groups side by side
    order[0] = n - 1
    fill = dict(start)
    group = [0] * n  # first place of a suffix's group, which names and ranks the group
    where = [0] * n
    for i, c in enumerate(text):
        p = fill[c]
        fill[c] = p + 1
        order[p], where[i], group[i] = i, p, start[c]
    size = [0] * (n + 1)
    size[0] = 1
    for c, k in count.items():
        size[start[c]] = k
    prev = [-1] * n

    end = n
    while end > 0:
        low = group[order[end - 1]]
        if end - low == 1:
            i = order[low]
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = prev[j]
            prev[i] = j
            if j >= 0:  # one suffix leaves its group upwards
                g = group[j]
                k = size[g] - 1
                if k:
                    last = g + k
                    p, other = where[j], order[last]
                    order[p], where[other] = other, p
                    order[last], where[j] = j, last
                    size[g], size[last], group[j] = k, 1, last
        else:
            pointed: dict[int, int] = {}
            for i in sorted(order[low:end]):
                j = i - 1
                while j >= 0 and group[j] >= low:
                    j = prev[j]
                prev[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            by_count: dict[int, list[int]] = {}
            for j, k in pointed.items():
                by_count.setdefault(k, []).append(j)
            for k in sorted(by_count, reverse=True):
                touched = []
                for j in by_count[k]:
                    g = group[j]
                    last = g + size[g] - 1
                    p, other = where[j], order[last]
                    order[p], where[other] = other, p
                    order[last], where[j] = j, last
                    size[g] -= 1
                    touched.append((j, g))
                for j, g in touched:
                    group[j] = g + size[g]
                for j, g in touched:
                    size[group[j]] = 0
                for j, _ in touched:
                    size[group[j]] += 1
        end = low

    place = list(range(n + 1))  # next free place of each group
    placed = [False] * n
    placed[n - 1] = True
    for p in range(n):
        j = order[p] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            q = place[g]
            place[g] = q + 1
            order[q] = j
            placed[j] = True
            j = prev[j]
    return order[1:]


def neighbour_lengths(text: list[int], order: list[int]) -> list[int]:
    """Longest common prefix of each suffix in ``order`` with the one before it; 0 for the first."""
    n = len(text)
    rank = [0] * n
    for p, i in enumerate(order):
        rank[i] = p
    shared, k = [0] * n, 0
    for i in range(n):
        p = rank[i]
        if not p:
            k = 0
            continue
        j = order[p - 1]
        most = n - max(i, j)
        while k < most and text[i + k] == text[j + k]:
            k += 1
        shared[p] = k
        if k:
            k -= 1
    return shared
