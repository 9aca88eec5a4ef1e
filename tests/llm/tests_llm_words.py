"""Invented prose for the tests."""

import random

WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty knoll larch maple nadir ocean pearl quartz ridge stone tulip".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 400)) * (r.random() < 0.3) for _ in range(n))
