"""Best fit by counts of sizes alone, in plain Python: what the supersteps in Spark are held against."""

from __future__ import annotations

from collections import Counter

from rosterline.llm.packing import BANDS, SMALL

#: What happens to gaps of one size with successive ranks: they take `many` pieces of `length` each, the first of that rank.
GAP_RUN = ("free", "first", "count", "length", "rank", "many", "new_free", "new_first")


def successor_sweep(left: dict[int, int], used: Counter, gaps: Counter, lengths: list[int], capacity: int) -> tuple[list[tuple], Counter]:
    """(GAP_RUN rows that cover all gaps, the new gaps by size) of one superstep; left and used are brought up to date.

    left: pieces by length; used: pieces that have their place, which are the first of their class; lengths: those of the band, longest first.
    """
    sizes, at, stack = sorted(gaps, reverse=True), 0, []
    taken, after, runs = Counter(), Counter(), []

    def run(size: int, count: int, length: int, many: int) -> None:
        free = size - many * length
        runs.append((size, taken[size], count, length, used[length], many, free, after[free]))
        taken[size] += count
        after[free] += count
        if length:
            used[length] += count * many
            left[length] -= count * many

    for length in lengths:
        while at < len(sizes) and sizes[at] >= length:
            stack.append(sizes[at])
            at += 1
        while left[length] and stack:
            size = stack[-1]
            many = size // length if length <= capacity * SMALL else 1
            room = gaps[size] - taken[size]
            if whole := min(room, left[length] // many):
                run(size, whole, length, many)
                room -= whole
            if room and left[length] and left[length] < many:
                run(size, 1, length, left[length])
                room -= 1
            if not room:
                stack.pop()
    for size in sizes:
        if room := gaps[size] - taken[size]:
            run(size, room, 0, 0)
    return runs, after


def opened(left: dict[int, int], used: Counter, gaps: Counter, lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, sequences, free, first rank as gaps): new sequences for the longest pieces of a band, enough for all of it."""
    need, rows = -(-sum(left[n] for n in lengths) // (capacity // lengths[0])), []
    for length in lengths:
        if count := min(need, left[length]):
            rows.append((length, used[length], count, capacity - length, gaps[capacity - length]))
            gaps[capacity - length] += count
            used[length] += count
            left[length] -= count
            need -= count
    return rows


def sequences_of(lengths: list[int], capacity: int) -> int:
    """How many sequences the supersteps open."""
    left, used, gaps, sequences = dict(Counter(lengths)), Counter(), Counter(), 0
    for high, low in zip((1, *BANDS), BANDS, strict=False):
        while own := sorted((n for n, c in left.items() if c and low * capacity < n <= high * capacity), reverse=True):
            _, gaps = successor_sweep(left, used, gaps, own, capacity)
            if (own := [n for n in own if left[n]]) and max(gaps, default=0) < own[-1]:
                sequences += sum(r[2] for r in opened(left, used, gaps, own, capacity))
    return sequences
