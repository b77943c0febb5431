"""Pair scorers behind HTTP."""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass

from rowsieve.errors import ScorerUnavailableError


@dataclass(frozen=True)
class HttpPairScorer:
    """Posts pairs as a JSON list of {"left", "right"} and reads a list of scores. Pickles, so workers can call it."""

    url: str
    timeout: float = 10.0

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]:
        body = json.dumps([{"left": a, "right": b} for a, b in pairs]).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return [float(x) for x in json.load(answer)]
        except (OSError, ValueError, TypeError) as e:
            raise ScorerUnavailableError(f"{self.url}: {e}") from e
