"""What detectors find, and questions about spans."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from typing import NamedTuple


class Hit(NamedTuple):
    type: str
    start: int
    end: int
    detector: str
    confidence: float


def disjoint(hits: Iterable[Hit]) -> list[Hit]:
    """Greedy choice of disjoint hits: higher confidence, then longer, then earlier, then the order given; back in text order."""
    starts: list[int] = []
    kept: list[Hit] = []
    for h in sorted(hits, key=lambda h: (-h.confidence, h.start - h.end, h.start)):
        i = bisect_left(starts, h.start)
        if i and kept[i - 1].end > h.start or i < len(kept) and kept[i].start < h.end:
            continue
        starts.insert(i, h.start)
        kept.insert(i, h)
    return kept


class Cover:
    """Spans to ask about: does a given span touch one, or lie inside one?"""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts, self.reach = [], []
        far = 0
        for start, end in sorted(spans):
            far = max(far, end)
            self.starts.append(start)
            self.reach.append(far)

    def touches(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.reach[i - 1] > start

    def holds(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start)
        return i > 0 and self.reach[i - 1] >= end
