import random
import re

import pytest

from planloom.llm import chat


def code(role):
    return {"system": 1, "user": 2, "assistant": 3}.get((role or "").strip().lower(), 0)


def plain(roles):
    """Costs and states of the cheapest path, kept one message after the other."""
    legal = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}

    def empty_turns(s, x):
        reached, n = {s}, 0
        while not any(x in legal[r] for r in reached):
            reached, n = {y for r in reached for y in legal[r]}, n + 1
            if n > 4:
                return None
        return n

    def cost_of(role, s, x):
        """Empty turns cost 3 each, a merge 1, a relabelled role 2, an unknown one 1, or 4 as system."""
        label = 0 if role == x else 2 if role else 4 if x == 1 else 1
        ways = ([3 * n] if (n := empty_turns(s, x)) is not None else []) + ([1] if s == x else [])
        return min(ways) + label if ways else None

    best = {0: (0, ())}
    for role in roles:
        new = {}
        for s, (cost, path) in best.items():
            for x in (1, 2, 3):
                if (own := cost_of(code(role), s, x)) is not None:
                    v = (cost + own, (*path, x))
                    new[x] = min(new.get(x, v), v)
        best = new
    return min((cost + (3 if s == 1 else 0), path) for s, (cost, path) in best.items())


@pytest.mark.parametrize("bits", [6, 10])
def test_repair_equals_plain_version(spark, monkeypatch, bits):
    monkeypatch.setattr(chat, "BLOCK_BITS", bits)
    random.seed(bits)
    roles = ["system", "user", "assistant", None, "tool", " User"]
    convs = {c: random.choices(roles, k=random.choice([1, 2, 3, 5, 9])) for c in range(25)} | {99: random.choices(roles, k=300)}
    rows = [(c, t, r, f"{c}-{t} <|end|>", 1) for c, own in convs.items() for t, r in enumerate(own)]
    out = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, state int").repartition(5)).collect()
    for c, own in convs.items():
        got = sorted((r for r in out if r.conv_id == c), key=lambda r: r.position)
        cost, path = plain(own)
        assert tuple(chat.ROLES.index(r.new_role) + 1 for r in got) == path
        text = "".join(r.fragment for r in got)
        turns, state = re.findall(r"<\|(system|user|assistant)\|>", text), 0
        for r in turns:
            assert chat.ROLES.index(r) + 1 in chat.LEGAL[state]
            state = chat.ROLES.index(r) + 1
        assert text.count("<|end|>") == len(turns) and state in chat.FINAL
        assert [r.first for r in got] == [True] + [False] * (len(got) - 1) and [r.last for r in got] == [False] * (len(got) - 1) + [True]


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.repair(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, None), (None, None, None, None), (1, 0, "system", ""), (2, 0, "user", "x" * 200_000), (2, 0, "user", "x" * 200_000), (3, 0, "user", "a"), (3, 1, "assistant", "b")]
    out = sorted(chat.repair(spark.createDataFrame(rows, schema)).collect(), key=lambda r: r.position)
    assert len(out) == 7
    assert [r.action for r in out if r.conv_id == 2] == ["keep", "merge"]
    assert "".join(r.fragment for r in out if r.conv_id == 3) == "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n"
    assert "".join(r.fragment for r in out if r.conv_id == 1) == "<|user|>\n\n<|end|>\n"  # cheaper than an empty user turn
    assert [r.new_role for r in out if r.conv_id is None] == ["user", "assistant"]


def test_an_unknown_opening_role_is_no_system_prompt(spark):
    rows = [(1, 0, "tool", "result"), (1, 1, "user", "ask"), (2, 0, None, "only"), (3, 0, "tool", "x"), (3, 1, "assistant", "y")]
    out = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    roles = {c: [r.new_role for r in sorted(out, key=lambda r: r.position) if r.conv_id == c] for c in (1, 2, 3)}
    assert roles == {1: ["user", "user"], 2: ["user"], 3: ["user", "assistant"]}
