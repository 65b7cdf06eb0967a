"""Suffix arrays of many short texts at once: Lyndon-prefix groups in descending order, then each group's order, in NumPy."""

from __future__ import annotations

import numpy as np

from ._words import ragged


def _starts(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def lyndon_groups(text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, smaller) of each place: group is where the suffixes with the place's Lyndon prefix begin in the suffix array, and smaller the nearest
    place before it in a lower group (-1: none). text holds several texts, one after the other; first: their starts, with the end.

    Groups begin as those of equal letters and are processed from the highest down, one of every text in a step. The nearest lower places before
    a group's members are the suffixes whose Lyndon prefixes go on with the group's: they leave their groups for new ones right above them, those
    followed by more repetitions of it higher. Groups processed before are final.
    """
    n = len(text)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(owner * (int(text.max(initial=0)) + 1) + text, kind="stable")
    letters = text[order].astype(np.int64) + owner[order] * (int(text.max(initial=0)) + 1)
    begin = _starts(letters)
    size = np.zeros(n, np.int64)
    size[begin] = np.diff(np.append(begin, n))
    group, place = np.empty(n, np.int64), np.empty(n, np.int64)
    group[order] = np.repeat(begin, size[begin])
    place[order] = np.arange(n)
    del owner, letters
    smaller = np.full(n, -1, np.int64)
    moving = np.zeros(n, bool)
    low, high = first[:-1].copy(), first[1:] - 1
    live = np.flatnonzero(high >= low)
    low, high = low[live], high[live]
    while len(high):
        at = group[order[high]]
        count = high - at + 1
        members = order[ragged(at, count)]
        of, base = np.repeat(at, count), np.repeat(low, count)
        p = members - 1
        p[p < base] = -1
        todo = np.flatnonzero(p >= 0)
        todo = todo[group[p[todo]] > of[todo]]
        while len(todo):
            p[todo] = smaller[p[todo]]
            todo = todo[p[todo] >= 0]
            todo = todo[group[p[todo]] > of[todo]]
        smaller[members] = p
        todo = np.flatnonzero(p >= 0)
        todo = todo[group[p[todo]] == of[todo]]
        while len(todo):  # repetitions of one Lyndon word: all point to what stands before the first
            p[todo] = smaller[p[todo]]
            smaller[members[todo]] = p[todo]
            todo = todo[p[todo] >= 0]
            todo = todo[group[p[todo]] == of[todo]]
        heads = np.sort(p[p >= 0])
        if len(heads):
            run = _starts(heads)
            times = np.diff(np.append(run, len(heads)))
            heads = heads[run]
            from_group = group[heads]
            by = np.lexsort((times, from_group))
            heads, times, from_group = heads[by], times[by], from_group[by]
            run = _starts(from_group)
            moved = np.diff(np.append(run, len(heads)))
            zone = from_group[run] + size[from_group[run]] - moved  # the places at the groups' ends that the movers get
            target = ragged(zone, moved)
            now = place[heads]
            moving[heads] = True
            there = order[target]
            out = there[~moving[there]]
            moving[heads] = False
            vacated = now[now < np.repeat(zone, moved)]
            order[vacated], place[out] = out, vacated
            order[target], place[heads] = heads, target
            size[from_group[run]] -= moved
            new = np.flatnonzero(np.concatenate([[True], (from_group[1:] != from_group[:-1]) | (times[1:] != times[:-1])]))
            many = np.diff(np.append(new, len(heads)))
            size[target[new]] = many
            group[heads] = np.repeat(target[new], many)
        high = at - 1
        more = high >= low
        low, high = low[more], high[more]
    return group, smaller


def suffix_arrays(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places of each text in the order of its suffixes, one text after the other. Every text's last letter must be its smallest one.

    The last place's suffix is the smallest. From the smallest up, each suffix places those whose next smaller suffix it is: the place before it, and
    along the nearest lower places from there until one is placed already; each takes the next free place of its group.
    """
    group, smaller = lyndon_groups(text, first)
    n = len(text)
    free = np.arange(n)
    result = np.full(n, -1, np.int64)
    low, end = first[:-1], first[1:]
    live = np.flatnonzero(end > low)
    low, end = low[live], end[live]
    last = end - 1
    result[low] = last
    free[group[last]] += 1
    placed = np.zeros(n + 1, bool)
    placed[-1] = True  # of -1, where nothing stands before
    placed[last] = True
    step = 0
    while len(low):
        j = result[low + step] - 1
        j = j[j >= low]
        j = j[~placed[j]]
        while len(j):
            slot = group[j]
            to = free[slot]
            result[to] = j
            free[slot] = to + 1
            placed[j] = True
            j = smaller[j]
            j = j[~placed[j]]
        step += 1
        more = end - low > step
        if not more.all():
            low, end = low[more], end[more]
    return result


def repeats(strings: list[bytes], weights: np.ndarray, problems: np.ndarray, window: int) -> list[np.ndarray]:
    """Of each string, the starts of the windows of `window` bytes that occur twice or more in its problem; a string counts as often as its weight.
    problems: how many of the strings, in turn, belong together.

    Strings are joined by a letter below all bytes, and suffixes of one problem that share a window stand side by side in its suffix array.
    """
    if not strings:
        return []
    lengths = np.array([len(s) for s in strings], np.int64)
    raw = np.frombuffer(b"\0".join(strings) + b"\0" * (window + 1), np.uint8)
    text = raw[: int(lengths.sum()) + len(strings)].astype(np.int16) + 1
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    text[starts[1:] - 1] = 0
    first = starts[np.concatenate([[0], np.cumsum(problems)])]
    order = suffix_arrays(text, first)
    string = np.repeat(np.arange(len(strings)), lengths + 1)
    whole = order[order + window <= starts[1:][string[order]] - 1]
    problem = np.repeat(np.arange(len(problems)), problems)[string[whole]] if len(whole) else whole
    same = np.flatnonzero(problem[1:] == problem[:-1])
    rows = np.lib.stride_tricks.sliding_window_view(raw, window)
    equal = np.zeros(max(0, len(whole) - 1), bool)
    for at in range(0, len(same), 4096):
        k = same[at : at + 4096]
        for edge in (window - 1, window // 2, window // 4):
            k = k[raw[whole[k] + edge] == raw[whole[k + 1] + edge]]
        equal[k] = (rows[whole[k]] == rows[whole[k + 1]]).all(1)
    again = weights[string[whole]] > 1
    again[:-1] |= equal
    again[1:] |= equal
    hit = np.sort(whole[again])
    cut = np.searchsorted(hit, starts)
    return [hit[cut[i] : cut[i + 1]] - starts[i] for i in range(len(strings))]
