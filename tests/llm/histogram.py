"""Best-fit decreasing over the number of pieces of each length: what the packing rounds are held against."""

import bisect
from collections import defaultdict


def best_fit_rounds(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Matches as (length, first rank, end rank, first sequence, offset), and the number of sequences.

    Piece ``r`` of a length, first <= r < end, goes to sequence ``first sequence +
    r - first`` at ``offset``. Lengths come in falling order, each round takes the
    smallest gap that is large enough: best-fit decreasing, a length at a time.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: ranges of sequences
    sizes: list[int] = []  # gaps that exist, sorted
    matches, opened = [], 0

    def add(gap: int, first: int, end: int) -> None:
        if gap:
            if not gaps[gap]:
                bisect.insort(sizes, gap)
            gaps[gap].append((first, end))

    for length in sorted((s for s, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                # As many sequences as these pieces fill; each takes one now, more in later rounds.
                n = -(-left // (capacity // length))
                add(capacity, opened, opened + n)
                opened += n
                continue
            gap = sizes[at]
            first, end = gaps[gap].pop()
            if not gaps[gap]:
                sizes.pop(at)
            n = min(left, end - first)
            matches.append((length, rank, rank + n, first, capacity - gap))
            add(gap, first + n, end) if first + n < end else None
            add(gap - length, first, first + n)
            rank, left = rank + n, left - n
    return matches, opened
