"""Calls to a scorer that may fail: retries, back-off, bisecting, and a breaker."""

from __future__ import annotations

import queue
import random
import threading
import time
from collections.abc import Callable, Sequence

#: Calls that may hang at the same time in a task. While all do, further calls fail at once.
THREADS = 2
#: Single texts that must all fail before an endpoint counts as down.
PROBES = 3


class Workers:
    """A few threads for calls with a time limit. A call that hangs keeps its thread until it returns."""

    def __init__(self, call: Callable[[list[str]], Sequence], threads: int = THREADS):
        self.call, self.threads = call, threads
        self.asked: queue.SimpleQueue = queue.SimpleQueue()
        self.started = self.busy = 0
        self.lock = threading.Lock()

    def _work(self) -> None:
        while (job := self.asked.get()) is not None:
            texts, answer = job
            try:
                answer.put(list(self.call(texts)))
            except Exception:
                answer.put(None)
            with self.lock:
                self.busy -= 1

    def ask(self, texts: list[str], limit: float) -> list | None:
        """The scores, or None if the call failed, took longer than `limit` or found no free thread."""
        with self.lock:
            if self.busy >= self.threads:
                return None
            self.busy += 1
            if self.busy > self.started:
                threading.Thread(target=self._work, daemon=True).start()
                self.started += 1
        answer: queue.SimpleQueue = queue.SimpleQueue()
        self.asked.put((texts, answer))
        try:
            return answer.get(timeout=limit)
        except queue.Empty:
            return None

    def close(self) -> None:
        """End the threads; one that hangs ends when its call returns."""
        for _ in range(self.started):
            self.asked.put(None)


class Caller:
    """Scores texts with a task's scorer; the score of a text that can't be scored is None.

    A batch that fails is tried again after a growing pause, then halved until the
    failing texts stand alone: k of them in a batch of n cost about 2 k log2(n / k)
    calls more. After `breaker` failures without a success the endpoint may be down:
    PROBES single texts are tried, after a pause that doubles up to `longest`. If
    all of them fail, the batch is given up, and the next begins with such a trial.
    """

    def __init__(self, call, max_retries: int, timeout: float, pause: float, longest: float, breaker: int, sleep=time.sleep):
        self.workers = Workers(call)
        self.retries, self.timeout, self.pause, self.longest, self.breaker, self.sleep = max_retries, timeout, pause, longest, breaker, sleep
        self.failures = self.rests = 0

    def _once(self, texts: list[str]) -> list | None:
        scores = self.workers.ask(texts, self.timeout)
        good = scores is not None and len(scores) == len(texts)
        self.failures = 0 if good else self.failures + 1
        return scores if good else None

    def _rest(self, n: int) -> None:
        """Half to all of a pause that doubles with `n`, so that tasks don't come back at the same moment."""
        self.sleep(min(self.longest, self.pause * 2**n) * random.uniform(0.5, 1))

    @property
    def down(self) -> bool:
        return self.failures >= self.breaker

    def _again(self, texts: list[str]) -> list | None:
        """A call and its retries."""
        for n in range(1 + self.retries):
            if n:
                self._rest(n - 1)
            if (scores := self._once(texts)) is not None:
                return scores
            if self.down:
                break
        return None

    def score(self, texts: list[str]) -> list:
        if self.down and not self._back(texts):
            return [None] * len(texts)
        scores = self._again(texts)
        return scores if scores is not None else self._halved(texts)

    def _back(self, texts: list[str]) -> bool:
        """Whether the endpoint answers again, for one of some single texts: each alone may be at fault itself."""
        self._rest(self.rests)
        self.rests += 1
        if any(self._once([texts[len(texts) * n // PROBES]]) is not None for n in range(min(PROBES, len(texts)))):
            self.rests = 0
            return True
        return False

    def _halved(self, texts: list[str]) -> list:
        """Scores of texts that failed together. Both halves are called before either is halved again, so that a
        failing post is seen beside one that does not fail."""
        if len(texts) == 1 or self.down and not self._back(texts):
            return [None] * len(texts)
        middle = len(texts) // 2
        halves = [texts[:middle], texts[middle:]]
        found = [self._again(half) if len(half) == 1 else self._once(half) for half in halves]
        return sum((f if f is not None else self._halved(half) for f, half in zip(found, halves)), [])

    def close(self) -> None:
        self.workers.close()
