"""Measures of the engine itself: counters, gauges and timers, as text and as samples of its own storage."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from .sources import exposition
from .storage import Storage

QUANTILES = (0.5, 0.95, 0.99)
Key = tuple[str, tuple[tuple[str, str], ...]]


def _line(name: str, labels: tuple[tuple[str, str], ...], value: float) -> str:
    quoted = ",".join(f'{k}="{v}"' for k, v in labels)
    return f"{name}{{{quoted}}} {value!r}" if quoted else f"{name} {value!r}"


@dataclass
class Monitor:
    """A registry on the driver; a timer keeps its last ``kept`` durations for its quantiles."""

    kept: int = 1000
    counters: dict[Key, float] = field(default_factory=dict)
    gauges: dict[Key, float] = field(default_factory=dict)
    timers: dict[Key, deque] = field(default_factory=dict)

    def _key(self, name: str, labels: dict[str, str]) -> Key:
        return name, tuple(sorted(labels.items()))

    def count(self, name: str, n: float = 1, **labels: str) -> None:
        key = self._key(name, labels)
        self.counters[key] = self.counters.get(key, 0.0) + n

    def gauge(self, name: str, value: float, **labels: str) -> None:
        self.gauges[self._key(name, labels)] = float(value)

    @contextmanager
    def timed(self, name: str, **labels: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            took = time.perf_counter() - began
            self.timers.setdefault(self._key(name, labels), deque(maxlen=self.kept)).append(took)
            self.count(f"{name}_seconds_count", **labels)
            self.count(f"{name}_seconds_sum", took, **labels)

    def lines(self) -> list[str]:
        """The text format, in order of names."""
        out = [_line(n, labels, v) for (n, labels), v in [*self.counters.items(), *self.gauges.items()]]
        for (name, labels), durations in self.timers.items():
            ordered = sorted(durations)
            out += [_line(f"{name}_seconds", (*labels, ("quantile", str(q))), ordered[min(len(ordered) - 1, int(q * len(ordered)))]) for q in QUANTILES]
        return sorted(out)

    def scrape(self, storage: Storage, now: int, batch: int, job: str = "tidegrid", instance: str = "driver") -> None:
        """Store the current values as samples with ``job`` and ``instance``."""
        spark = storage.spark
        lines = spark.createDataFrame([(i, x) for i, x in enumerate(self.lines())], "seq long, value string")
        parsed = exposition.parse(lines, now, {"job": job, "instance": instance}).filter("error is null")
        storage.append(parsed.select("labels", "t", "v", "seq"), batch)
