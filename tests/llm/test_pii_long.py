"""Long texts of cues are searched in time that is linear in their length, with the spans that a plain search of each cue gives."""

import random
import time

import pytest

from quarry.llm import pii

A = pii.automaton()


@pytest.mark.parametrize("unit", ["token=", "http://", "password:", "DE44 ", "DE4450010517", "secret='", "a@", "a@b.", "+1 ", "1.1.", "1 1-", "http://a@", "token=x1", "apikey= ", "https://1.2.3.4", "@", "http://x.,;", "token ", "token= \t"])
def test_a_megabyte_of_cues(unit):
    text = unit * (1_000_000 // len(unit))
    began = time.process_time()
    pii.search(text, A)
    assert time.process_time() - began < 4


class Plain(pii.Parser):
    """Each cue reads its own run."""

    def url(self, a, b):
        self.address = (0, 0)
        super().url(a, b)

    def secret(self, b):
        self.value = (0, -1, -1)
        super().secret(b)


def test_remembered_runs_change_nothing(monkeypatch):
    rng = random.Random(9)
    parts = ["token", "=", ":", "password", "http://", "https://", "ab1", "9", "x" * 9, "/", "@", ".", " ", "\n", ",", "1.2.3.4", "é", "'", "=a1b2c3d4e5f6g7h8", "secret"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(4_000)]
    got = [pii.search(t, A) for t in texts]
    monkeypatch.setattr(pii, "Parser", Plain)
    assert got == [pii.search(t, A) for t in texts]
    assert sum(bool(g["secret"]) for g in got) > 50 and sum(bool(g["url"]) for g in got) > 50
