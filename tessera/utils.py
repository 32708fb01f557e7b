"""Small helpers."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator


class Timer:
    """Context manager that adds up the seconds spent in it."""

    def __init__(self):
        self.seconds = 0.0

    def __enter__(self) -> Timer:
        self._began = time.perf_counter()
        return self

    def __exit__(self, *exc) -> None:
        self.seconds += time.perf_counter() - self._began


def flatten(items: Iterable) -> Iterator:
    """The leaves of nested lists and tuples, in order."""
    for item in items:
        if isinstance(item, list | tuple):
            yield from flatten(item)
        else:
            yield item
