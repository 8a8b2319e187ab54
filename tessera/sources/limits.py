"""Politeness of live connectors: token bucket, backoff, rate-limit waits, cancellation."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Mapping

TRANSIENT = {429, *range(500, 600)}


class TokenBucket:
    """``capacity`` tokens, refilled at ``rate`` a second."""

    def __init__(self, capacity: float = 60, rate: float = 60 / 3600, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.capacity, self.rate, self.clock, self.sleep = capacity, rate, clock, sleep
        self.tokens, self.at = float(capacity), clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens, self.at = min(self.capacity, self.tokens + (now - self.at) * self.rate), now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rate)
            self.tokens, self.at = 1.0, self.clock()
        self.tokens -= 1


def backoff(attempt: int, base: float = 0.3, most: float = 8.0, rand: Callable[[], float] = random.random) -> float:
    """Seconds before the next attempt: half of the exponential delay for sure, the other half at random."""
    full = min(most, base * 2 ** (attempt - 1))
    return full / 2 + rand() * full / 2


def reset_wait(headers: Mapping[str, str], now: float) -> float:
    """Seconds until a rate limit is lifted."""
    if headers.get("x-ratelimit-reset", "").isdigit():
        return max(0.0, float(headers["x-ratelimit-reset"]) - now)
    if headers.get("retry-after", "").isdigit():
        return float(headers["retry-after"])
    return 60.0


def retry(call: Callable[[], tuple[int, object]], attempts: int = 4, wait: Callable[[int], float] = backoff, sleep: Callable[[float], None] = time.sleep):
    """The result of ``call`` (status, value); transient statuses and network errors are tried again."""
    for n in range(1, attempts + 1):
        try:
            status, value = call()
        except OSError:
            if n == attempts:
                raise
        else:
            if status not in TRANSIENT or n == attempts:
                return status, value
        sleep(wait(n))


class Cancelled(RuntimeError):
    """The caller has asked to stop."""


def polite(
    call: Callable[[], tuple[int, Mapping[str, str], object]],
    bucket: TokenBucket | None = None,
    stopped: Callable[[], bool] = lambda: False,
    sleep: Callable[[float], None] = time.sleep,
    now: Callable[[], float] = time.time,
    attempts: int = 4,
    wait: Callable[[int], float] = backoff,
):
    """(status, headers, value) of ``call`` within the bucket's rate.

    Transient failures are tried again; a refusal because the limit is used up (403 with no requests remaining) waits
    once for its reset and is tried once more. Cancellation is looked for before each request.
    """

    def one() -> tuple[int, object]:
        if stopped():
            raise Cancelled("stopped before a request")
        if bucket:
            bucket.take()
        status, headers, value = call()
        return status, (headers, value)

    for waited in (False, True):
        status, (headers, value) = retry(one, attempts, wait, sleep)
        if waited or status != 403 or headers.get("x-ratelimit-remaining") != "0":
            break
        sleep(reset_wait(headers, now()))
    return status, headers, value
