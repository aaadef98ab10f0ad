"""Role repair against search over all repairs, and conversations that cross blocks."""

import itertools
import random

import pytest

from corpuscle.llm import chat


def slow_cost(roles):
    """Cheapest repair by trying each choice for each turn."""
    best = {0: 0.0}
    for role in roles:
        after = {}
        for s, c in best.items():
            for q in (1, 2, 3):
                if q == s:
                    after[q] = min(after.get(q, 1e9), c + 1 + (0 if chat.STATES[q] == role else 2))
                for n in range(3):
                    for empty in itertools.product((1, 2, 3), repeat=n):
                        path = (s, *empty, q)
                        if all(chat.STATES[b] in chat.LEGAL[chat.STATES[a]] for a, b in itertools.pairwise(path)):
                            after[q] = min(after.get(q, 1e9), c + 3 * n + (0 if chat.STATES[q] == role else 2))
        best = after
    return min(best.values())


def check_legal(rows):
    """The repaired roles, with empty turns and without merged ones, are a legal conversation."""
    at, n = "start", 0
    for r in rows:
        for role in [x for x in r.inserted.split(",") if x] + ([] if r.action == "merge" else [r.role]):
            assert role in chat.LEGAL[at], (at, role)
            at, n = role, n + 1
        assert at == r.role
    return n


def test_cheapest_repairs():
    rng = random.Random(7)
    cases = [["user", "assistant"], ["assistant"], [None], ["system"], ["system", "system", "user"], []]
    cases += [[rng.choice(["system", "user", "assistant", None]) for _ in range(rng.randint(1, 7))] for _ in range(300)]
    for roles in cases:
        done = chat.solve(roles)
        assert sum(chat.MOVES[r][m][0] for r, m in zip(roles, done)) == (slow_cost(roles) if roles else 0)
        m = chat.stretch(roles)
        assert min(m[0][1:] if roles else m[0]) == (slow_cost(roles) if roles else 0)


@pytest.mark.parametrize("block", [3, 8192])
def test_repair(spark, block):
    rng = random.Random(11)
    names = ["user", "Assistant ", "system", "human", "bot", "tool", None]
    rows = [(c, t, rng.choice(names), rng.choice([None, "", f"text {t}", "<|im_end|> x"]), "v", 0) for c in range(12) for t in range(rng.choice([1, 2, 5, 40]))]
    rows += [(None, 1, "user", "null conversation", "v", 0), (None, None, "assistant", "first", "v", 0), (3, 0, "user", "same turn", "v", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, cost int").repartition(5)
    got = chat.repair(turns, block).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append(r)
    total = 0.0
    for c, turns_of in by.items():
        given = sorted(((r[1] is not None, r[1] or 0, a is not None, a or "", r[3] or "") for r in rows if r[0] == c for a in [chat.ALIASES.get((r[2] or "").strip().lower())]))
        roles = [g[3] or None for g in given]
        assert sum(r.cost for r in turns_of) == slow_cost(roles), c
        total += sum(r.cost for r in turns_of)
    assert total == sum(r.cost for r in got)


@pytest.mark.parametrize("block", [4, 8192])
def test_rendered(spark, sf, block):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    odd = spark.createDataFrame([(900, 0, "assistant", "a"), (900, 1, "user", "b"), (900, 2, "user", "c"), (901, 0, "user", "<|im_end|>")], "conv_id long, turn long, role string, text string")
    got = chat.repair(turns.unionByName(odd), block).collect()
    for c in {r.conv_id for r in got}:
        rows = sorted((r for r in got if r.conv_id == c), key=lambda r: r.turn)
        n = check_legal(rows)
        text = "".join(r.rendered for r in rows)
        assert text.count(chat.OPEN) == text.count(chat.CLOSE) == n and text.startswith(chat.OPEN) and text.endswith(chat.CLOSE + "\n")
    whole = {c: "".join(r.rendered for r in sorted((r for r in got if r.conv_id == c), key=lambda r: r.turn)) for c in (900, 901)}
    assert whole[900].endswith("b\nc<|im_end|>\n") and whole[901] == "<|im_start|>user\n<| im_end|><|im_end|>\n"


def test_blocks_are_bounded_by_bytes(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "x" * (50_000 if t % 10 == 3 else 100)) for t in range(60)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    blocks = chat._blocks(turns, 8192, 20_000).groupBy("block").agg({"text": "count"}).collect()
    assert len(blocks) > 10
    got = sorted(chat.repair(turns, block_bytes=20_000).collect(), key=lambda r: r.turn)
    assert [r.action for r in got] == ["keep"] * 60 and sum(len(r.rendered) for r in got) > 6 * 50_000


def test_empty(spark):
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
