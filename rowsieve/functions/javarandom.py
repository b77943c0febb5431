"""The linear congruential generator of java.util.Random, whose draws the hash family and the sample are defined by."""

from __future__ import annotations

#: Multiplier, increment and modulus.
MULTIPLIER, INCREMENT, MASK = 0x5DEECE66D, 0xB, (1 << 48) - 1


class JavaRandom:
    def __init__(self, seed: int):
        self.state = (seed ^ MULTIPLIER) & MASK

    def _bits(self, n: int) -> int:
        self.state = (self.state * MULTIPLIER + INCREMENT) & MASK
        value = self.state >> (48 - n)
        return value - (1 << n) if n == 32 and value >= 1 << 31 else value

    def next_int(self, bound: int | None = None) -> int:
        """A signed 32-bit number, or one from 0 to bound - 1."""
        if bound is None:
            return self._bits(32)
        if bound & (bound - 1) == 0:
            return (bound * self._bits(31)) >> 31
        while True:
            drawn = self._bits(31)
            value = drawn % bound
            if drawn - value + bound - 1 < 1 << 31:  # else the last, partial stretch of numbers
                return value
