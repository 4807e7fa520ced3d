"""Call budgets: minutes a provider needs (L4), allowances per time (L3) and the retry schedule (L2) as plain functions."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETRY_STATUS = {408, 409, 429}  # and all from 500 on


def provider_minutes(calls: DataFrame, providers: DataFrame) -> DataFrame:
    """(provider, calls, tokens, minutes) for sending all ``calls`` (tokens) to each provider (provider, rpm, tpm): the larger of both limits' times. One row of totals meets a hand-made table."""
    total = calls.agg(F.count("*").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    minutes = F.greatest(F.col("calls") / F.col("rpm"), F.col("tokens") / F.col("tpm"))
    return providers.crossJoin(F.broadcast(total)).select("provider", "calls", F.col("tokens").cast("long").alias("tokens"), F.round(minutes, 6).alias("minutes"))


def retry_delay(attempt: int, status: int, retry_after: float | None = None) -> float | None:
    """Seconds before the next attempt, or None where the error is final. Attempts count from 0."""
    if status not in RETRY_STATUS and status < 500:
        return None
    return retry_after if retry_after is not None else float(2**attempt)


def refilled(level: float, since: float, now: float, size: float, seconds: float) -> float:
    """What an allowance of ``size`` per ``seconds`` holds at ``now``, if it held ``level`` at ``since``; a level below 0 is owed."""
    return min(size, level + max(0.0, now - since) * size / seconds)


class Quota:
    """Several allowances that every attempt draws on at once, retries too: calls and tokens per minute, and attempts per day. Calls from several threads queue up."""

    def __init__(self, limits: dict[str, float], seconds: float = 60.0, per_day: int | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        wrong = [name for name, size in limits.items() if size <= 0]
        if wrong:
            raise ValueError(f"limits that nothing can pass: {', '.join(wrong)}")
        self.limits, self.seconds, self.clock, self.sleep = dict(limits), seconds, clock, sleep
        self.left = per_day
        self.held = {name: (float(size), clock()) for name, size in limits.items()}
        self.lock = threading.Lock()

    def holds(self, name: str) -> float:
        return refilled(*self.held[name], self.clock(), self.limits[name], self.seconds)

    def delay(self, amounts: dict[str, float]) -> float:
        """Seconds until all amounts are there; more than a whole allowance is waited for as one."""
        return max([0.0, *((min(x, self.limits[n]) - self.holds(n)) * self.seconds / self.limits[n] for n, x in amounts.items())])

    def charge(self, amounts: dict[str, float]) -> None:
        for name, x in amounts.items():
            self.held[name] = (self.holds(name) - min(x, self.limits[name]), self.clock())

    def enter(self, **amounts: float) -> float:
        """Wait for the amounts, take them, and return the seconds waited."""
        with self.lock:
            if self.left == 0:
                raise RuntimeError("no attempts left today")
            self.left = None if self.left is None else self.left - 1
            wait = self.delay(amounts)
            if wait:
                self.sleep(wait)
            self.charge(amounts)
        return wait

    def correct(self, name: str, guessed: float, used: float) -> None:
        """Charge what was used beyond the guess; what was guessed too much is not given back."""
        with self.lock:
            self.charge({name: max(0.0, used - guessed)})
