"""A decoder's picture buffer: which pictures are held, and in what order they come out."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Held:
    sequence: int
    poc: int
    reference: bool = True
    waiting: bool = True


@dataclass
class PictureBuffer:
    """Pictures come out by sequence and count once too many wait or the buffer is full."""

    max_reorder: int
    max_size: int
    sequence: int = 0
    held: list[Held] = field(default_factory=list)
    begun: bool = False

    def add(self, poc: int, keeps: set[int], resets: bool, shown: bool = True) -> list[tuple[int, int]]:
        """Takes the next picture in decoding order; keeps: POCs of its sequence it still needs.  What comes out, as (sequence, poc)."""
        if resets:
            self.sequence += self.begun
            keeps = set()
        self.begun = True
        for p in self.held:
            p.reference = p.reference and p.sequence == self.sequence and p.poc in keeps
        self.held = [p for p in self.held if p.reference or p.waiting]
        self.held.append(Held(self.sequence, poc, waiting=shown))
        out = []
        while (n := sum(p.waiting for p in self.held)) > self.max_reorder or n and len(self.held) >= self.max_size:
            out.append(self._next())
        return out

    def _next(self) -> tuple[int, int]:
        first = min((p for p in self.held if p.waiting), key=lambda p: (p.sequence, p.poc))
        first.waiting = False
        return first.sequence, first.poc

    def flush(self) -> list[tuple[int, int]]:
        return [self._next() for _ in range(sum(p.waiting for p in self.held))]
