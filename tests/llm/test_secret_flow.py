"""Added spans against a second reader: generated assignments whose values the generator itself follows."""

from __future__ import annotations

import random

import pytest

from tessella.llm.secrets import LEAST_SCORE, find_secrets, score

NAMES = ["db_pwd", "API_SECRET", "authToken", "colour", "path", "retry_count", "signing_key", "userName", "client_credential", "note", "K1", "part_b"]
LITERALS = ["Zx9!qwerty", "a1b2c3d4e5f6", "plain", "hello world 1", "", "short", "A" * 40, "p@ss.W0rd", "changeme", "x1y2", "Tr0ub4dor&3", "true"]


def written(r):
    """Lines of assignments, and the spans that a reader who follows every name must add."""
    text, known, want = "", {}, set()
    for _ in range(r.randrange(1, 25)):
        name = r.choice(NAMES)
        text += name + r.choice([" = ", " := "])
        spans, through = [], False
        for n in range(r.choice([1, 1, 1, 2, 3])):
            text += " + " if n else ""
            other = r.choice(sorted(known)) if known and r.random() < 0.4 else None
            if other is not None:
                spans, through = spans + known[other], True
                text += other
            else:
                literal = r.choice(LITERALS)
                spans.append((len(text) + 1, len(text) + 1 + len(literal)))
                text += f'"{literal}"'
        text += "\n"
        spans = [s for s in spans if s[1] > s[0]]
        if spans:
            known[name] = spans
        else:
            known.pop(name, None)
        value = "".join(text[a:b] for a, b in spans)
        if spans and score(name, value, True) >= LEAST_SCORE:
            want |= {("flow" if through else "named", a, b) for a, b in spans}
    return text, want


@pytest.mark.parametrize("seed", range(8))
def test_added_spans_are_those_of_the_second_reader(seed):
    r = random.Random(seed)
    for _ in range(250):
        text, want = written(r)
        assert {s for s in find_secrets(text) if s[0] in ("named", "flow")} == want, text
