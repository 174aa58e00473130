"""Repeating a call that failed for a passing reason."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from ..errors import StoreError


@dataclass(frozen=True)
class Retry:
    """attempts in all; waits grow from `first` seconds by `factor`, up to `most`. Only retryable errors are tried again."""

    attempts: int = 1
    first: float = 0.0
    factor: float = 2.0
    most: float = 5.0
    sleep: Callable[[float], Any] = time.sleep

    @classmethod
    def none(cls, **o) -> Retry:
        return cls(**o)

    @classmethod
    def fast(cls, **o) -> Retry:
        return cls(3, 0.01, 2.0, 0.1, **o)

    @classmethod
    def standard(cls, **o) -> Retry:
        return cls(5, 0.1, 2.0, 5.0, **o)

    def run(self, f: Callable[[], Any]) -> Any:
        for i in range(self.attempts):
            try:
                return f()
            except StoreError as e:
                if not e.retryable or i + 1 >= self.attempts:
                    raise
                self.sleep(min(self.most, self.first * self.factor**i))
        raise AssertionError("no attempt")
