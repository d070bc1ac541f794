"""Counting fakes of scorers that fail."""

import math
import threading
import time

import pytest

from agoralens.operators.calls import PROBES, THREADS, Caller


class Fake:
    """Fails for batches with a bad text, or while it is down; counts calls."""

    def __init__(self, bad=(), down=False):
        self.bad, self.down, self.calls, self.texts = set(bad), down, 0, 0

    def __call__(self, texts):
        self.calls += 1
        self.texts += len(texts)
        if self.down or self.bad & set(texts):
            raise RuntimeError("no score")
        return [(1, 0.5)] * len(texts)


def caller(fake, pauses=None, **more):
    rules = {"max_retries": 3, "timeout": 5.0, "pause": 0.1, "longest": 2.0, "breaker": 12} | more
    return Caller(fake, **rules, sleep=(pauses if pauses is not None else []).append)


TEXTS = [f"t{k}" for k in range(64)]


@pytest.mark.parametrize("k", [0, 1, 2, 4, 8])
def test_bad_posts_cost_logarithms(k):
    bad = TEXTS[3 :: 64 // k][:k] if k else []
    fake = Fake(bad)
    scores = caller(fake, breaker=1000).score(TEXTS)
    assert [s is None for s in scores] == [t in bad for t in TEXTS]
    # 4 tries of the whole, 2 calls a level for each, 3 more tries of each alone
    assert fake.calls <= (4 + k * (2 * math.ceil(math.log2(64)) + 3) if k else 1)


@pytest.mark.parametrize("bad", [TEXTS[:1], TEXTS[-1:], TEXTS[:8], TEXTS[::4], TEXTS[1::2]])
def test_bad_posts_do_not_pass_for_an_outage(bad):
    fake = Fake(bad)
    c = caller(fake)
    assert [s is None for s in c.score(TEXTS)] == [t in bad for t in TEXTS]
    before = fake.calls
    assert None not in c.score([t for t in TEXTS if t not in bad]) and fake.calls <= before + 2


def test_endpoint_that_is_down_gets_few_calls():
    fake, pauses = Fake(down=True), []
    c = caller(fake, pauses)
    for _ in range(100):
        assert c.score(TEXTS) == [None] * 64
    assert fake.calls <= 12 + PROBES * (100 + 6)  # a batch halves six times at most
    assert max(pauses) <= 2.0 and len(pauses) >= 99
    fake.down = False
    assert None not in c.score(TEXTS)
    before = fake.calls
    assert None not in c.score(TEXTS) and fake.calls == before + 1


def test_good_posts_after_a_bad_batch_are_scored():
    """A batch of nothing but bad posts looks like an outage; nothing good is lost by that."""
    fake = Fake(TEXTS)
    c = caller(fake)
    assert c.score(TEXTS) == [None] * 64
    assert c.score(["t0", "fine", "good"]) == [None, (1, 0.5), (1, 0.5)]


def test_pauses_grow_and_differ():
    pauses = []
    caller(Fake(down=True), pauses, max_retries=5, longest=1.0).score(["a"])
    assert len(pauses) == 5
    assert all(0.5 * min(1, 0.1 * 2**n) <= p <= min(1, 0.1 * 2**n) for n, p in enumerate(pauses))


def test_hanging_calls_leave_no_thread():
    before = threading.active_count()
    free = threading.Event()

    def hang(texts):
        free.wait(20)
        return [(1, 0.5)] * len(texts)

    c = caller(hang, timeout=0.05)
    assert c.score(["a", "b", "c"]) == [None] * 3
    assert threading.active_count() <= before + THREADS
    c.close()
    free.set()
    for _ in range(100):
        if threading.active_count() == before:
            break
        time.sleep(0.02)
    assert threading.active_count() == before


def test_wrong_number_of_scores_is_a_failure():
    assert caller(lambda texts: [(1, 0.5)]).score(["a", "b"]) == [(1, 0.5), (1, 0.5)]
    assert caller(lambda texts: []).score(["a"]) == [None]
