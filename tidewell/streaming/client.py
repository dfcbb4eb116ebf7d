"""How a client sends at least once: the same payload again until it is taken."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import islice
from typing import TypeVar

T = TypeVar("T")


def pauses(first: float = 0.2, most: float = 3.0) -> Iterator[float]:
    """Seconds to wait between tries: twice as long each time, up to a bound."""
    n = 0
    while True:
        yield min(most, first * 2**n)
        n = min(n + 1, 60)


def send(payload: T, post: Callable[[T], bool], *, tries: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Posts a payload until post is true, and returns how many tries failed; errors count as failures.

    With a number of tries, the last failure is raised as a TimeoutError. Receivers dedupe by event id, so sending again is safe.
    """
    for failed, pause in enumerate(pauses() if tries is None else islice(pauses(), tries)):
        try:
            if post(payload):
                return failed
        except OSError:
            pass
        sleep(pause)
    raise TimeoutError(f"not taken in {tries} tries")
