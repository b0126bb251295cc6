"""State of the driver between requests: results with a time to live, and the registry of runs."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field


class ResultCache:
    """Answers by application and question; an answer is good for ``ttl`` seconds, and a blank question has none."""

    def __init__(self, ttl: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock = ttl, clock
        self._rows: dict[tuple[int | None, str], tuple[float, object]] = {}

    @staticmethod
    def key(question: str, application: int | None = None) -> tuple[int | None, str]:
        return application, hashlib.sha256(" ".join(question.lower().split()).encode()).hexdigest()

    def get(self, question: str, application: int | None = None) -> object | None:
        at, value = self._rows.get(self.key(question, application), (None, None))
        if at is None or self.clock() - at >= self.ttl:
            self._rows.pop(self.key(question, application), None)
            return None
        return value

    def put(self, question: str, value: object, application: int | None = None) -> None:
        if question.strip():
            self._rows[self.key(question, application)] = (self.clock(), value)

    def forget(self, application: int | None = None) -> int:
        """Drop an application's answers, or all without one; the number dropped."""
        gone = [k for k in self._rows if application is None or k[0] == application]
        for k in gone:
            del self._rows[k]
        return len(gone)


@dataclass
class Run:
    id: int
    application: int
    strategy: str
    state: str = "RUNNING"
    processed: int = 0
    written: int = 0
    errors: list[str] = field(default_factory=list)


class RunRegistry:
    """Runs by number; counts go up while a run is running, and an ended run stays as it is."""

    def __init__(self):
        self._runs: dict[int, Run] = {}

    def create(self, application: int, strategy: str) -> Run:
        run = Run(len(self._runs) + 1, application, strategy)
        self._runs[run.id] = run
        return run

    def _running(self, number: int) -> Run:
        run = self._runs[number]
        if run.state != "RUNNING":
            raise ValueError(f"run {number} has ended")
        return run

    def progress(self, number: int, processed: int = 0, written: int = 0) -> None:
        run = self._running(number)
        run.processed += processed
        run.written += written

    def complete(self, number: int) -> None:
        self._running(number).state = "SUCCESS"

    def fail(self, number: int, error: str) -> None:
        run = self._running(number)
        run.state = "FAILED"
        run.errors.append(error)

    def get(self, number: int) -> Run | None:
        return self._runs.get(number)

    def newest(self, application: int) -> Run | None:
        return max((r for r in self._runs.values() if r.application == application), key=lambda r: r.id, default=None)
