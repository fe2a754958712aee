"""Role repair against all repairs, whole and in fragments."""

import itertools
import random

import pytest

from pairwright.llm import chat

COSTS = chat.Costs()


def brute(roles):
    """Least cost over all targets and merges, by search over every choice for every turn."""
    best = chat.FAR
    for targets in itertools.product((1, 2, 3), repeat=len(roles)):
        for merges in itertools.product((False, True), repeat=len(roles)):
            cost, state, ok = 0, 0, True
            for role, to, merged in zip(roles, targets, merges):
                cost += 0 if role == to else COSTS.relabel
                if merged:
                    ok &= state == to
                    cost += COSTS.merge
                elif to == chat.SYSTEM:
                    ok &= state == chat.START
                elif to == chat.USER:
                    cost += COSTS.insert if state == chat.USER else 0
                else:
                    cost += COSTS.insert if state != chat.USER else 0
                state = to
            if ok:
                best = min(best, cost + {0: 0, 1: 2 * COSTS.insert, 2: COSTS.insert, 3: 0}[state])
    return best


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles)) and len(roles) % 2 == 0


def test_least_cost_over_all_repairs():
    for n in range(1, 5):
        for roles in itertools.product((0, 1, 2, 3), repeat=n):
            got = chat.render(list(roles), ["x"] * n, COSTS, chat.Template())
            assert got["cost"] == brute(roles), roles
            assert legal(got["roles"].split()), roles
            assert got["rendered"].count("x") == n
            assert got["rendered"].count("<|end|>") == got["n_out"]


@pytest.mark.parametrize("partitions", [1, 5])
def test_fragments_add_up_to_the_whole(spark, monkeypatch, partitions):
    monkeypatch.setattr(chat, "GROUP", 2)
    r = random.Random(4)
    rows, whole = [], {}
    for conv in range(30):
        n = {7: 121, 8: 20, 9: 21, 10: 40}.get(conv) or r.randint(1, 6)
        names = [r.choice(["system", "user", "assistant", "tool", None, " User "]) for _ in range(n)]
        texts = [r.choice(["hi", "", None, "long " * 20]) for _ in range(n)]
        rows += [(conv, t, name, text) for t, (name, text) in enumerate(zip(names, texts))]
        whole[conv] = (n, chat.render([chat._role(x) for x in names], texts, COSTS, chat.Template()))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for row in sorted(chat.format_chats(df, partitions=partitions, per=20).collect(), key=lambda x: (x["conv_id"], x["fragment"])):
        got.setdefault(row["conv_id"], []).append(row)
    for conv, (n, want) in whole.items():
        own = got[conv]
        assert [x["fragment"] for x in own] == list(range(-(-n // 20))) and [x["n_in"] for x in own] == [min(20, n - 20 * k) for k in range(-(-n // 20))]
        assert sum(x["cost"] for x in own) == want["cost"] and legal(" ".join(x["roles"] for x in own if x["roles"]).split())
        text = "".join(x["rendered"] for x in own)
        assert text.count("<|end|>") == sum(x["n_out"] for x in own) == text.count("<|user|>") + text.count("<|assistant|>") + text.count("<|system|>")
        if n <= 20:
            assert text == want["rendered"]


def test_chained_states_cost_what_the_whole_costs():
    r = random.Random(9)
    for _ in range(40):
        roles = [r.randrange(4) for _ in range(r.randint(2, 30))]
        cuts = sorted({0, *(r.randrange(len(roles)) for _ in range(4))})
        pieces = [roles[a:b] for a, b in zip(cuts, [*cuts[1:], len(roles)])]
        cells = [[c for s in range(4) for c in chat.forward(p, chat._only(s), COSTS)[0]] for p in pieces]
        ends = chat.chain(cells, COSTS)
        assert sum(chat.solve(p, COSTS, *e)[0] for p, e in zip(pieces, ends)) == chat.solve(roles, COSTS)[0]


def test_empty_null_and_extra_columns(spark):
    schema = "conv_id long, turn long, role string, text string, part string, fragment int"
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, None, "x", 1), (None, 1, "user", "a", "x", 1), (1, 0, "assistant", "b", None, None), (1, 0, "assistant", "b", None, None)]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["roles"] == "user assistant" and got[1]["n_relabelled"] == 1 and got[1]["cost"] == 2
    assert got[None]["n_in"] == 2
