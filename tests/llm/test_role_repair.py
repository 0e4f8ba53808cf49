from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from drillspark.llm import queries as q
from drillspark.llm import role_repair as rr

GIVEN = {"system": 0, "user": 1, "assistant": 2}


def plan(given):
    """Costs to go, then the first cheapest option turn by turn."""
    to_go = [[rr.INSERT_COST * len(rr.ending(s)) for s in range(4)]]
    for g in reversed(given):
        to_go.append([min(o.cost + to_go[-1][o.role] for o in rr.TABLE[s, g]) for s in range(4)])
    to_go.reverse()
    state, taken = rr.START, []
    for k, g in enumerate(given):
        taken.append(min(rr.TABLE[state, g], key=lambda o: o.cost + to_go[k + 1][o.role]))
        state = taken[-1].role
    return to_go[0][rr.START], taken


def legal(roles):
    state = rr.START
    for r in roles:
        if GIVEN[r] not in rr.NEXT[state]:
            return False
        state = GIVEN[r]
    return state in rr.ACCEPT


def key(r):
    return (r.turn is None, r.turn or 0, r.role is not None, r.role or "")


def expected(rows):
    given = [GIVEN.get((r.role or "").strip().lower(), rr.START) for r in rows]
    cost, taken = plan(given)
    out, text, roles = [], "", []
    for o in taken:
        roles += [rr.ROLES[i] for i in o.inserted]
        if o.action != rr.MERGE:
            roles.append(rr.ROLES[o.role])
        out.append((len(roles) - 1, rr.ROLES[o.role], o.action, [rr.ROLES[i] for i in o.inserted]))
    bodies = [""] * len(roles)
    for (at, _, action, _), r in zip(out, rows):
        bodies[at] += (rr.JOIN if action == rr.MERGE else "") + (r.text or "")
    roles += [rr.ROLES[i] for i in rr.ending(taken[-1].role)]
    bodies += [""] * (len(roles) - len(bodies))
    text = "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in zip(roles, bodies))
    assert legal(roles)
    return cost, out, text


def test_plan_is_the_cheapest_of_all_sequences():
    for n in (1, 2, 3):
        for given in itertools.product(range(4), repeat=n):
            cost, taken = rr.repair_one(list(given))
            got, mine = plan(list(given))
            assert (got, [o.cost for o in mine]) == (cost, [o.cost for o in taken])


def test_segments_multiply_to_the_whole():
    rng = random.Random(1)
    roles = bytes(rng.randrange(4) for _ in range(60))
    whole = rr.products([roles])[0]
    cut = rr.times(rr.times(rr.products([roles[:13]])[0], rr.products([roles[13:40]])[0]), rr.products([roles[40:]])[0])
    assert (whole == cut).all()
    cost, _ = plan(list(roles))
    assert (whole[rr.START] + rr.LAST).min() == cost


def check(out, n):
    by_conv = {}
    for r in out:
        by_conv.setdefault(r.conv_id, []).append(r)
    assert len(out) == n
    for rows in by_conv.values():
        rows.sort(key=lambda r: r.position)
        assert [key(r) for r in rows] == sorted(key(r) for r in rows)
        cost, want, text = expected(rows)
        assert [(r.out_turn, r.out_role, r.action, r.inserted) for r in rows] == want
        assert "".join(r.rendered for r in rows) == text
        assert round(sum(r.cost for r in rows) * 10) == cost
        assert all(r.appended == [] for r in rows[:-1])


def random_rows(rng, convs, most):
    roles = ["system", "user", "assistant", "user", "assistant", None, "tool", " User "]
    return [
        (c, t if rng.random() > 0.05 else None, rng.choice(roles), rng.choice([None, "", "hi", "several words\nof text"]))
        for c in range(convs)
        for t in range(rng.randrange(1, most))
    ]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_many_conversations(spark):
    rows = random_rows(random.Random(7), 60, 12) + [(None, 1, "user", "x"), (None, 2, "user", "y"), (3, 0, "user", "dup")] * 3
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cost", F.lit("mine"))
    check(rr.repair_roles(df).collect(), len(rows))


def test_long_conversation_over_many_segments_and_levels(spark, monkeypatch):
    monkeypatch.setattr(rr, "SEGMENT_BITS", 2)
    monkeypatch.setattr(rr, "FAN_BITS", 2)
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system", None]), f"t{t}") for t in range(700)] + random_rows(rng, 5, 30)
    rows = [(c + 10, *r) for c, *r in rows]
    check(rr.repair_roles(spark.createDataFrame(rows, SCHEMA), partitions=5).collect(), len(rows))


def test_identical_rows_and_empty_table(spark):
    rows = [(1, 0, "user", "same")] * 500
    out = rr.repair_roles(spark.createDataFrame(rows, SCHEMA), partitions=4).collect()
    check(out, 500)
    assert rr.repair_roles(spark.createDataFrame([], SCHEMA)).count() == 0


def test_legal_conversations_are_left_alone(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "u")]
    out = sorted(rr.repair_roles(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r.conv_id, r.turn))
    assert [r.action for r in out] == ["keep"] * 4 and out[3].appended == ["assistant"]
    assert "".join(r.rendered for r in out[:3]) == (
        "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    )


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    out = q.QUERIES["op5_role_repair"](spark, f"/root/testdata/{sf}").collect()
    assert len(out) == spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").count()
    assert np.isfinite([r.cost for r in out]).all()
