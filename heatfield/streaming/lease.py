"""One writer at a time: a lease with an expiry, and a number that grows with each owner and fences off the ones before.

Claim n is a file of that number, created only if there is none, so of two claimants one succeeds. Each beat is a file of its
own that moves the expiry. A claim is open to others once its last beat has expired or its owner has released it; an owner
that finds a greater number has lost the lease, however late it looks.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from heatfield.sources import files

#: Seconds that a beat holds, and between beats.
HOLD, BEAT = 120, 20
#: Steps of one owner.
STEPS = 1_000_000


class OwnershipError(RuntimeError):
    """Another owner has the lease."""


class Lease:
    def __init__(self, spark: SparkSession, root: str, hold: float = HOLD, now: Callable[[], float] = time.time):
        self.spark, self.folder, self.hold, self.now = spark, f"{root}/lease", hold, now
        self.number, self.beats, self.steps = 0, 0, 0
        self.lost, self._end, self._thread = threading.Event(), threading.Event(), None

    def _last(self) -> tuple[int, dict]:
        """The greatest claim's number and its latest beat: owner, expires."""
        found = [n.split("-") for n in files.names(self.spark, self.folder)]
        if not found:
            return 0, {}
        number = max(n for n, _ in found)
        return int(number), json.loads(files.read(self.spark, f"{self.folder}/{number}-{max(k for n, k in found if n == number)}"))

    def _write(self, number: int, beat: int, owner: str, expires: float) -> bool:
        return files.create(self.spark, f"{self.folder}/{number:012d}-{beat:09d}", json.dumps({"owner": owner, "expires": expires}))

    def claim(self, owner: str) -> int:
        """Takes the lease; an OwnershipError if somebody has it. Returns its number."""
        last, beat = self._last()
        if last and beat["expires"] > self.now():
            raise OwnershipError(f"{beat['owner']} is running")
        if not self._write(last + 1, 0, owner, self.now() + self.hold):
            raise OwnershipError("somebody else was faster")
        self.number, self.owner, self.beats, self.steps = last + 1, owner, 0, 0
        self.lost.clear()
        for name in files.names(self.spark, self.folder):
            if int(name.split("-")[0]) < last:
                files.delete(self.spark, f"{self.folder}/{name}")
        return self.number

    def check(self) -> None:
        """An OwnershipError unless the lease is held."""
        last, beat = self._last()
        if self.lost.is_set() or not self.number or last != self.number or beat["expires"] <= self.now():
            self.lost.set()
            raise OwnershipError("the lease was lost")

    def beat(self) -> None:
        self.check()
        self.beats += 1
        if not self._write(self.number, self.beats, self.owner, self.now() + self.hold):
            raise OwnershipError("the lease was lost")
        if self.beats > 1:
            files.delete(self.spark, f"{self.folder}/{self.number:012d}-{self.beats - 1:09d}")

    def keep(self, every: float = BEAT) -> None:
        """Beats in the background until release."""

        def run() -> None:
            while not self._end.wait(every):
                try:
                    self.beat()
                except Exception:
                    self.lost.set()
                    return

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def step(self) -> int:
        """A number above all that this and earlier owners have had."""
        self.steps += 1
        return self.number * STEPS + self.steps

    def release(self) -> None:
        """Gives the lease up, if it is still held."""
        self._end.set()
        if self._thread:
            self._thread.join()
        if self.number and not self.lost.is_set() and self._last()[0] == self.number:
            self._write(self.number, self.beats + 1, self.owner, 0)
        self.number = 0
