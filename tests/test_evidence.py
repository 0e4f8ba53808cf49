"""G1-G17 on small hand-made graphs (truth tables of the reference's own
tests re-built as DataFrames) and brute force on random forests."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from drillspark.operators import evidence as ev
from drillspark.operators.similarity import STOP_WORDS, dedup_keep_first, near_duplicate_pairs, statement_tokens

NODE_SCHEMA = "id string, investigation_id string, seq long, parent_id string, kind string, content_json string"
EDGE_SCHEMA = "id string, investigation_id string, source_id string, target_id string, relationship string, created_by string, status string"


def nodes(spark, rows):
    return spark.createDataFrame(
        [(i, inv, s, p, k, json.dumps(c or {})) for i, inv, s, p, k, c in rows], NODE_SCHEMA
    )


def edges(spark, rows):
    return spark.createDataFrame(
        [(f"x{n}", "inv", s, t, r, "engine", st) for n, (s, t, r, st) in enumerate(rows)], EDGE_SCHEMA
    )


def test_hypothesis_status_truth_table(spark):
    n = nodes(spark, [(f"h{i}", "inv", i, None, "hypothesis", {"statement": "s"}) for i in range(6)]
                 + [("r", "inv", 9, None, "table_result", {})])
    e = edges(spark, [
        ("r", "h0", "supports", "active"), ("r", "h0", "contradicts", "active"),  # weakened
        ("r", "h1", "contradicts", "active"),  # rejected
        ("r", "h2", "supports", "active"),  # supported
        ("r", "h3", "tests", "active"),  # unresolved
        ("r", "h4", "supports", "proposed"),  # proposed edges do not count -> proposed
    ])
    got = {r["id"]: r["status"] for r in ev.hypothesis_status(n, e).collect()}
    assert got == {"h0": "weakened", "h1": "rejected", "h2": "supported", "h3": "unresolved", "h4": "proposed", "h5": "proposed"}
    assert {r["id"] for r in ev.untested_hypotheses(n, e).collect()} == {"h0", "h1", "h2", "h4", "h5"}
    assert {r["id"] for r in ev.open_hypotheses(n, e).collect()} == {"h3", "h4", "h5"}


def test_shared_evidence_and_orphans(spark):
    # root conclusion with two sibling conclusions; one source supports both siblings
    n = nodes(spark, [
        ("q", "inv", 0, None, "user_question", {}), ("c0", "inv", 1, "q", "conclusion", {}),
        ("c1", "inv", 2, "c0", "conclusion", {}), ("c2", "inv", 3, "c0", "conclusion", {}),
        ("src", "inv", 4, None, "table_result", {}), ("line", "inv", 5, None, "table_result", {}),
    ])
    e = edges(spark, [
        ("src", "c1", "supports", "active"), ("src", "c2", "supports", "active"),
        ("line", "c0", "supports", "active"), ("line", "c1", "supports", "active"),  # one line: fine
    ])
    shared = ev.shared_evidence(n, e).collect()
    assert [(r["id"], r["conclusions"]) for r in shared] == [("src", 2)]
    e2 = edges(spark, [("line", "c0", "supports", "active")])
    assert {r["id"] for r in ev.orphan_conclusions(n, e2).collect()} == {"c1", "c2"}


def test_ancestors_and_descendants_brute_force(spark):
    rnd = random.Random(4)
    parent = {"n0": None}
    for i in range(1, 300):
        parent[f"n{i}"] = f"n{rnd.randrange(0, i)}" if rnd.random() > 0.05 else None
    parent["n300"] = "ghost"  # a parent id that names no node
    n = nodes(spark, [(k, "inv", int(k[1:]), p, "plan", {}) for k, p in parent.items()])

    def chain(v):
        out, d, cur = [(v, 0)], 0, v
        while cur in parent and parent[cur] is not None:
            cur, d = parent[cur], d + 1
            out.append((cur, d))
        return out

    expected = sorted((v, a, d) for v in parent for a, d in chain(v))
    got = sorted((r["node_id"], r["ancestor_id"], r["depth"]) for r in ev.ancestors(n).collect())
    assert got == expected
    below = sorted((r["id"], r["depth"]) for r in ev.descendants(n, "n3").collect())
    assert below == sorted((v, d) for v in parent for a, d in chain(v) if a == "n3")


def _visible(rows):
    """(question, branch shown on it) from the own branch and the interval."""
    out = {(r["question_id"], r["branch"]) for r in rows}
    for r in rows:
        if r["visible"]:
            assert r["visible_to"] - r["visible_from"] + 1 == r["visible"]
            out |= {(r["question_id"], b) for b in range(r["visible_from"], r["visible_to"] + 1)}
    return out


def test_turns_pairs_branches(spark):
    rows = [
        ("p", "inv", 0, None, "plan", {}),  # before the first question: no turn
        ("q1", "inv", 1, None, "user_question", {}), ("c1", "inv", 2, "q1", "conclusion", {}),
        ("q2", "inv", 3, "c1", "user_question", {}), ("c2", "inv", 4, "q2", "conclusion", {}),
        ("q3", "inv", 5, "c1", "user_question", {}),  # second child of c1 -> branch 1, no answer
        ("q4", "inv", 6, "c2", "user_question", {}), ("c4", "inv", 7, "q4", "conclusion", {}),
        ("z1", "other", 1, None, "user_question", {}),
    ]
    n = nodes(spark, rows)
    t = {r["id"]: r["turn_id"] for r in ev.turns(n).collect()}
    assert t["p"] is None and t["c2"] == "q2" and t["c4"] == "q4" and t["z1"] == "z1"
    pairs = {r["question_id"]: (r["conclusion_id"], r["own_turn"]) for r in ev.turn_pairs(n).collect()}
    assert pairs == {"q1": ("c1", True), "q2": ("c2", True), "q3": ("c4", False), "q4": ("c4", True)}
    last = ev.last_turns(ev.turn_pairs(n), 2).collect()
    assert sorted(r["question_id"] for r in last) == ["q3", "q4"]
    b = ev.branches(n).collect()
    label = {r["question_id"]: r["branch"] for r in b}
    assert label == {"q1": 0, "q2": 0, "q3": 1, "q4": 0, "z1": 0}
    vis = _visible(b)
    assert ("q1", 1) in vis and ("q2", 1) not in vis and ("q3", 1) in vis


def test_lint_rules(spark):
    rows = [
        ("q", "inv", 1, None, "user_question", {}),
        ("pl", "inv", 2, "q", "plan", {"steps": [{"id": "s0"}, {"id": "s1"}]}),
        ("err", "inv", 3, "q", "error", {"message": "x"}),
        ("c", "inv", 4, "q", "conclusion", {"summary": "Revenue fell because of fewer orders", "confidence": "high"}),
        ("q2", "inv", 5, None, "user_question", {}),
        ("t2", "inv", 6, "q2", "tool_result", {"tool": "t_test"}),
        ("tb", "inv", 7, "q2", "table_result", {"row_count": 1000}),
        ("c2", "inv", 8, "q2", "conclusion", {"summary": "Revenue fell because of fewer orders", "confidence": "low"}),
        ("q3", "inv", 9, None, "user_question", {}),
        ("t3", "inv", 10, "q3", "tool_result", {"tool": "describe"}),
        ("c3", "inv", 11, "q3", "conclusion", {"summary": "Sales écause nothing", "confidence": "medium"}),
    ]
    got = {(r["turn_id"], r["rule"]): r["status"] for r in ev.lint_turns(nodes(spark, rows)).collect()}
    assert got[("q", "groundedness")] == "warn" and got[("q", "step_errors")] == "warn"
    assert got[("q", "causal_claim")] == "warn" and got[("q", "confidence_calibration")] == "warn"
    assert got[("q2", "causal_claim")] == "ok" and got[("q2", "truncation")] == "warn"
    assert all(got[("q3", r)] == "ok" for r in ("groundedness", "step_errors", "causal_claim", "confidence_calibration", "truncation"))


def test_metric_drift_plan_edges_chain_prefix(spark):
    rows = [
        ("m1", "inv", 1, None, "metric", {"name": "aov", "sql": "SUM(x)/COUNT(*)"}),
        ("m2", "inv", 2, None, "metric", {"name": "aov", "sql": " SUM(x)/COUNT(*) "}),
        ("m3", "inv", 3, None, "metric", {"name": "aov", "sql": "AVG(x)"}),
        ("m4", "inv", 4, None, "metric", {"name": "n", "sql": "COUNT(*)"}),
        ("q", "inv", 5, None, "user_question", {}),
        ("s", "inv", 6, "q", "sql_query", {"sql": "select 1"}),
        ("r", "inv", 7, "s", "table_result", {"row_count": 3}),
        ("ch", "inv", 8, "q", "chart", {"source_node_id": "r"}),
    ]
    n = nodes(spark, rows)
    drift = ev.metric_drift(n).collect()
    assert {r["id"] for r in drift} == {"m1", "m2", "m3"} and {r["definitions"] for r in drift} == {2}
    chain = {(r["step_kind"], r["step_id"], r["result_id"]) for r in ev.evidence_chain(n).collect()}
    assert chain == {("sql", "s", "r"), ("chart", "ch", "r")}
    plans = spark.createDataFrame(
        [("inv", "p1", [("s1", []), ("s2", ["s1"]), ("s3", ["s1", "s2", "sX"])])],
        "investigation_id string, plan_id string, steps array<struct<id:string,depends_on:array<string>>>",
    )
    results = spark.createDataFrame(
        [("inv", "p1", "s1", "n1"), ("inv", "p1", "s2", "n2"), ("inv", "p1", "s3", "n3")],
        "investigation_id string, plan_id string, step_id string, node_id string",
    )
    pe = {(r["source_id"], r["target_id"]) for r in ev.plan_edges(plans, results).collect()}
    assert pe == {("n2", "n1"), ("n3", "n1"), ("n3", "n2")}
    assert {r["id"] for r in ev.by_prefix(n, "inv", "m").collect()} == {"m1", "m2", "m3", "m4"}
    assert {r["id"] for r in ev.children(n, ["q"]).collect()} == {"s", "ch"}


POSITIVE = [
    ("Revenue fell because fewer orders were placed", "fewer orders caused revenue to fall"),
    ("The nightly loader dropped late records", "late records were dropped by the nightly loader"),
]
NEGATIVE = [
    ("Revenue fell because fewer orders were placed", "prices rose in the western region"),
    ("the of and", "the of and"),  # only stop words: empty sets never match
    ("seasonal effects explain the dip", "a new competitor took market share"),
]


def _tokens_py(text):
    """The rule of ``statement_tokens``, character by character."""
    word, words = "", []
    for c in text.lower() + " ":
        if c in "abcdefghijklmnopqrstuvwxyz0123456789":
            word += c
        elif word:
            words.append(word)
            word = ""
    long_enough = (w for w in words if len(w) >= 3 and w not in STOP_WORDS)
    return {w.removesuffix("s") if len(w) >= 5 else w for w in long_enough}


def _similar(a, b, t=0.6):
    ta, tb = _tokens_py(a), _tokens_py(b)
    return bool(ta and tb) and len(ta & tb) / min(len(ta), len(tb)) >= t


def test_near_duplicate_pairs_hits_and_misses(spark):
    for pairs, want in ((POSITIVE, True), (NEGATIVE, False)):
        for a, b in pairs:
            assert _similar(a, b) == want
            left = spark.createDataFrame([(1, a)], "id long, text string")
            right = spark.createDataFrame([(2, b)], "id long, text string")
            got = near_duplicate_pairs(left, "id", "text", right, "id", "text").count()
            assert (got == 1) == want


def test_tokens_match_python(spark):
    texts = ["Matches and differs: the CASES were 3x higher!!", "Ünïcode wörds and ÉCOLES différents", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [set(r[0]) for r in df.select(statement_tokens("t")).collect()]
    assert got == [_tokens_py(t) for t in texts]


def test_dedup_keep_first_brute_force(spark):
    rnd = random.Random(2)
    vocab = [f"word{i}" for i in range(14)]
    texts = [" ".join(rnd.sample(vocab, rnd.randint(2, 6))) for _ in range(60)]
    texts += [texts[3], texts[3], "the of", texts[10]]  # exact copies, an empty statement
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    kept_py = []
    for t in texts:
        kept_py.append(not any(_similar(k, t) for k in [x for x, keep in zip(texts, kept_py) if keep]))
    got = {r["id"]: r["kept"] for r in dedup_keep_first(df, "id", "id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == kept_py
    # all pairs, self mode, against brute force
    pairs = {(r["id_a"], r["id_b"]) for r in near_duplicate_pairs(df, "id", "text").collect()}
    brute = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if _similar(texts[i], texts[j])}
    assert pairs == brute


def _keep_first(texts):
    kept = []
    for t in texts:
        kept.append(not any(_similar(k, t) for k in [x for x, keep in zip(texts, kept) if keep]))
    return kept


@pytest.mark.parametrize("first_prefix,local_edges", [(30, 3), (7, 500_000)])
def test_dedup_keep_first_in_small_steps(spark, first_prefix, local_edges):
    """Several prefixes, and pairs beyond what a task settles: roots, components and cuts."""
    rnd = random.Random(first_prefix)
    vocab = [f"word{i}" for i in range(16)]
    texts = [" ".join(rnd.sample(vocab, rnd.randint(3, 6))) for _ in range(40)]
    # a chain: each text is near the one before it only
    texts += [" ".join(f"link{k + j}" for j in range(3)) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = dedup_keep_first(df, "id", "id", "text", first_prefix=first_prefix, local_edges=local_edges)
    got = {r["id"]: r["kept"] for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == _keep_first(texts)


def test_a_long_chain_is_settled_in_few_tables(spark, monkeypatch):
    from drillspark.operators import similarity

    written = []
    monkeypatch.setattr(similarity, "checkpointed", lambda df, keep=similarity.checkpointed: written.append(1) or keep(df))
    n = 10_000
    df = spark.range(n).select("id", F.concat_ws(" ", *[F.concat(F.lit("link"), F.col("id") + j) for j in range(3)]).alias("text"))
    kept = {r["id"] for r in similarity.dedup_keep_first(df, "id", "id", "text").where("kept").collect()}
    assert kept == set(range(0, n, 2))
    assert len(written) <= 40


def test_a_crowd_of_alike_statements_never_yields_its_pairs(spark, monkeypatch):
    """Half of the rows are near each other: the first strikes them before their pairs are sought."""
    from drillspark.operators import similarity

    seen = []
    settle = similarity._settle
    monkeypatch.setattr(similarity, "_settle", lambda e, n: seen.append(e.count()) or settle(e, n))
    texts = [f"alpha beta gamma delta crowd{i}" for i in range(300)] + [f"one{i} two{i} three{i}" for i in range(300)]
    random.Random(5).shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = similarity.dedup_keep_first(df, "id", "id", "text", first_prefix=20)
    assert [r["kept"] for r in out.orderBy("id").collect()] == _keep_first(texts)
    assert sum(seen) < 20 * 20


def test_pairs_of_many_blocks_are_counted_in_tasks(spark, monkeypatch):
    """Shared tokens are never shuffled a pair; sets of every size in several blocks."""
    from drillspark.functions import overlaps
    from drillspark.operators import similarity

    monkeypatch.setattr(similarity, "BLOCK_TOKENS", 2_000)
    rnd = random.Random(4)
    vocab = [f"tok{chr(97 + i % 26)}{i}x" for i in range(120)]
    texts = [" ".join(rnd.sample(vocab[: rnd.choice((20, 120))], rnd.choice((1, 2, 5, 12, 20)))) for _ in range(80)]
    texts += [" ".join(rnd.sample(vocab, 60)) for _ in range(20)] + [" ".join(rnd.sample(vocab, 110)) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = [_tokens_py(t) for t in texts]
    near = {(i, j): len(sets[i] & sets[j]) for i in range(105) for j in range(i + 1, 105)}
    near = {k: v for k, v in near.items() if v / min(len(sets[k[0]]), len(sets[k[1]])) >= 0.6}
    monkeypatch.setattr(overlaps, "CELLS", 50)
    found = near_duplicate_pairs(df, "id", "text")
    assert "hashpartitioning(sid_a" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["id_a"], r["id_b"]): r["shared"] for r in found.collect()} == near
    kept = {r["id"]: r["kept"] for r in dedup_keep_first(df, "id", "id", "text", first_prefix=10).collect()}
    assert [kept[i] for i in range(len(texts))] == _keep_first(texts)


def test_disk_does_not_grow_with_the_blocks(spark, monkeypatch):
    """No copy of the sets a block, and what is read no more goes, tables and shuffle files."""
    import os

    import pyarrow.parquet as pq

    from drillspark.operators import similarity
    from drillspark.session import job_scratch

    def files(*folders):
        return {os.path.join(d, f) for top in folders for d, _, names in os.walk(top.removeprefix("file:")) for f in names}

    rnd = random.Random(6)
    vocab = [f"word{i}x" for i in range(3000)]
    texts = [" ".join(rnd.sample(vocab, 60)) for _ in range(1500)]
    texts += texts[:20] + [t + " more words" for t in texts[20:40]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    local = spark.sparkContext.getConf().get("spark.local.dir")
    monkeypatch.setattr(similarity, "SET_TOKENS", 0)
    write, most = similarity.checkpointed, {}
    for tokens in (1_000_000, 30_000):  # one block, and four
        monkeypatch.setattr(similarity, "BLOCK_TOKENS", tokens)
        with job_scratch(spark) as folder:
            before = files(local)

            def measured(frame):
                table = write(frame)
                used = sum(os.path.getsize(f) for f in files(local, folder) - before if os.path.exists(f))
                most[tokens] = max(most.get(tokens, 0), used)  # noqa: B023
                return table

            monkeypatch.setattr(similarity, "checkpointed", measured)
            kept = {r["id"] for r in similarity.dedup_keep_first(df, "id", "id", "text").where("kept").collect()}
            tables = [pq.read_schema(f) for f in files(folder) if f.endswith(".parquet")]
        assert kept == set(range(1500))
        assert tables and not any("list" in str(t.types) for t in tables)
    assert most[30_000] < 1.5 * most[1_000_000]


def test_components_of_chains_and_stars(spark):
    from drillspark.operators import similarity

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, j) for j in range(101, 120)] + [(130, 150), (140, 150)]
    df = spark.createDataFrame(edges, "early long, late long")
    got = {r["node"]: r["component"] for r in similarity._components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {j: 100 for j in range(100, 120)} | {130: 130, 140: 130, 150: 130}


def test_positional_filter_keeps_every_pair(spark):
    """Random sets of all sizes and thresholds, within one and between two tables."""
    rnd = random.Random(8)
    vocab = [f"tok{chr(97 + i)}x" for i in range(18)]
    texts = [" ".join(rnd.sample(vocab, rnd.randint(1, 16))) for _ in range(70)] + [vocab[0]] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    left, right = df.where("id < 25"), df.where("id >= 25")
    sets = [_tokens_py(t) for t in texts]
    for t in (0.3, 0.6, 1.0):
        near = {(i, j) for i in range(100) for j in range(i + 1, 100) if len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j])) >= t}
        got = near_duplicate_pairs(df, "id", "text", threshold=t).collect()
        assert sorted((r.id_a, r.id_b) for r in got) == sorted(near)
        assert all((r.size_a, r.size_b, r.shared) == (len(sets[r.id_a]), len(sets[r.id_b]), len(sets[r.id_a] & sets[r.id_b])) for r in got)
        both = near_duplicate_pairs(left, "id", "text", right, "id", "text", threshold=t).collect()
        assert sorted((r.id_a, r.id_b) for r in both) == sorted((i, j) for i, j in near if i < 25 <= j)


def test_branch_ids_follow_depth_first_order(spark):
    # c1 has children q2 (first) and q3 (opens a branch, seq 5); c2 under q2 has
    # children q6 (first) and q7 (opens a branch, seq 8). The walk finishes q2's
    # subtree before reaching q3, so q7 is branch 1 and q3 branch 2.
    rows = [
        ("q1", "inv", 1, None, "user_question", {}), ("c1", "inv", 2, "q1", "conclusion", {}),
        ("q2", "inv", 3, "c1", "user_question", {}), ("c2", "inv", 4, "q2", "conclusion", {}),
        ("q3", "inv", 5, "c1", "user_question", {}),
        ("q6", "inv", 6, "c2", "user_question", {}), ("c6", "inv", 7, "q6", "conclusion", {}),
        ("q7", "inv", 8, "c2", "user_question", {}),
    ]
    b = ev.branches(nodes(spark, rows)).collect()
    label = {r["question_id"]: r["branch"] for r in b}
    assert label == {"q1": 0, "q2": 0, "q3": 2, "q6": 0, "q7": 1}
    vis = _visible(b)
    assert {("q1", 1), ("q1", 2), ("q2", 1), ("q7", 1), ("q3", 2)} <= vis and ("q2", 2) not in vis


def _walks(parent):
    """Ancestors of every node with their least depth, by walking with a seen-set."""
    out = set()
    for n in parent:
        at, depth, seen = n, 0, set()
        while at is not None and at not in seen:
            out.add((n, at, depth))
            seen.add(at)
            at, depth = parent.get(at), depth + 1
    return out


CYCLIC = [
    {"a": "b", "b": "a", "c": "b", "d": "c", "e": None, "f": "e"},  # a cycle of two with a chain below
    {"s": "s", "t": "s", "u": "gone"},  # its own parent; a parent that is no node
    {f"n{i}": f"n{(i + 1) % 7}" for i in range(7)} | {"x": "n3", "y": "x", "z": "n5", "q": None, "r": "q", "p": "p"},
]


@pytest.mark.parametrize("parent", CYCLIC)
def test_ancestors_and_descendants_on_cycles(spark, parent):
    nodes = spark.createDataFrame(list(parent.items()), "id string, parent_id string")
    want = _walks(parent)
    got = [tuple(r) for r in ev.ancestors(nodes).select("node_id", "ancestor_id", "depth").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    lift = ev.lifting(nodes)
    for top in parent:
        below = [(r["id"], r["depth"]) for r in ev.descendants(nodes, top, lift).collect()]
        assert sorted(below) == sorted((n, d) for n, a, d in want if a == top)


def test_shared_evidence_counts_a_cycle_as_one_line(spark):
    parent = {"a": "b", "b": "a", "c": "b", "d": None}
    nodes = spark.createDataFrame([("i", n, p, "conclusion") for n, p in parent.items()], "investigation_id string, id string, parent_id string, kind string")
    rows = [("i", s, t, "supports", "active") for s, ts in {"one": "ab", "two": "ac", "far": "ad"}.items() for t in ts]
    edges = spark.createDataFrame(rows, "investigation_id string, source_id string, target_id string, relationship string, status string")
    assert [(r["id"], r["conclusions"]) for r in ev.shared_evidence(nodes, edges).collect()] == [("far", 2)]


def _branches_by_walk(turn_parent, seq):
    """Depth-first walk of the turn tree: labels and what is visible where."""
    kids = {}
    for q, p in turn_parent.items():
        kids.setdefault(p, []).append(q)
    for k in kids.values():
        k.sort(key=lambda q: (seq[q], q))
    label, vis, count = {}, set(), 0
    stack = [(q, 0, ()) for q in reversed(kids.get(None, []))]
    while stack:
        q, b, above = stack.pop()
        label[q] = b
        vis.add((q, b))
        if b:
            vis |= {(a, b) for a in above}
        below = kids.get(q, [])
        stack += [(c, None, (*above, q)) for c in reversed(below[1:])]
        if below:
            stack.append((below[0], b, (*above, q)))
        while stack and stack[-1][1] is None:
            c, _, path = stack.pop()
            count += 1
            stack.append((c, count, path))
            break
    return label, vis


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_branches_against_a_walk(spark, seed):
    rng = random.Random(seed)
    rows, parent, seq = [], {}, {}
    for i in range(60):
        q, c = f"q{i:03d}", f"c{i:03d}"
        back = None if i == 0 or rng.random() < 0.05 else max(0, i - 1 - int(rng.expovariate(0.6)))
        parent[q], seq[q] = (None if back is None else f"q{back:03d}"), 2 * i
        rows += [(q, "inv", 2 * i, None if back is None else f"c{back:03d}", "user_question", {}), (c, "inv", 2 * i + 1, q, "conclusion", {})]
    out = ev.branches(nodes(spark, rows)).collect()
    label, vis = _branches_by_walk(parent, seq)
    assert {r["question_id"]: r["branch"] for r in out} == label
    assert _visible(out) == vis


def _random_graph(seed):
    """Turns and conclusions of several investigations, some with cycles of turns, one
    with a link into another investigation."""
    rnd = random.Random(seed)
    rows, made = [], {}
    for inv, size in (("a", 60), ("b", 5), ("c", 30), ("d", 12), (None, 8)):
        seq, concl = 0, []
        for k in range(size):
            seq += 1
            up = rnd.choice(concl) if concl and rnd.random() < 0.9 else None
            q, c = f"{inv}q{k:02d}", f"{inv}c{k:02d}"
            rows.append([q, inv, seq, up, "user_question", {}])
            seq += 1
            rows.append([c, inv, seq, q, "conclusion", {}])
            concl.append(c)
        made[inv] = concl
    at = {r[0]: r for r in rows}
    at["cq00"][3] = at["cq03"][0].replace("q", "c")  # a turn that hangs off a later one
    at["dq00"][3] = made["b"][0]  # and one that hangs off another investigation
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("seed", [1])
def test_branches_walked_and_ranked_alike(spark, seed):
    n = nodes(spark, _random_graph(seed))
    want = sorted(map(tuple, ev.branches(n, local_nodes=0).collect()), key=str)
    assert len(want) == 115
    for local_nodes in (10, 100_000):
        assert sorted(map(tuple, ev.branches(n, local_nodes=local_nodes).collect()), key=str) == want


@pytest.mark.parametrize("seed", [2])
def test_shared_evidence_by_intervals_and_by_lifting(spark, seed):
    rows = _random_graph(seed)
    rnd = random.Random(seed + 10)
    concl = [r[0] for r in rows if r[4] == "conclusion"]
    links = [(f"s{k}", rnd.choice(concl), "supports", rnd.choice(["active", "active", "removed"])) for k in [*range(40), *range(40), *range(20)]]
    up = {r[0]: r[3] for r in rows}

    def line(x):
        out = []
        while x is not None and x not in out:
            out.append(x)
            x = up[x]
        return set(out)

    want = set()
    for s in {x[0] for x in links}:
        mine = {t for k, t, _, st in links if k == s and st == "active"}
        if any(a not in line(b) and b not in line(a) for a in mine for b in mine):
            want.add((s, len(mine)))
    n, e = nodes(spark, rows), edges(spark, links)
    assert want
    for local_nodes in (25, 100_000):
        got = ev.shared_evidence(n, e, local_nodes=local_nodes).collect()
        assert {(r["id"], r["conclusions"]) for r in got} == want and len(got) == len(want)


def test_walks_of_deep_chains_and_cycles():
    import pyarrow as pa

    from drillspark.functions.walks import intervals_of

    n = 50_000  # deeper than any recursion
    ids = [f"n{i:05d}" for i in range(n)] + ["x", "y", "z"]
    parents = [None, *ids[: n - 1]] + ["z", "x", "y"]
    table = pa.table({
        "investigation_id": ["chain"] * n + ["ring"] * 3, "id": ids, "parent_id": parents, "seq": range(n + 3), "_group": [0] * (n + 3),
    })
    out = intervals_of(table).to_pylist()
    assert (out[0]["pre"], out[0]["last"], out[n - 1]["depth"]) == (0, n - 1, n - 1)
    assert [r["looped"] for r in out[n - 1 :]] == [False, True, True, True]


@pytest.mark.parametrize("seed", [3])
def test_descendants_by_intervals_and_by_lifting(spark, seed):
    rows = _random_graph(seed)
    n = nodes(spark, rows)
    labels, far = ev.preorder(n, 40)
    up = {r[0]: r[3] for r in rows}
    assert far is not None and labels.count() + far.count() == len(rows)

    def depth_below(x, top):
        seen, d = set(), 0
        while x is not None and x not in seen:
            if x == top:
                return d
            seen.add(x)
            x, d = up[x], d + 1
        return None

    for top in ("aq00", "None" + "q02", "cq03", "dc01", "bq00"):
        want = {r[0]: depth_below(r[0], top) for r in rows if depth_below(r[0], top) is not None}
        got = {r["id"]: r["depth"] for r in ev.descendants(n, top, labels=labels).collect()}
        assert got == want, top


def test_lifting_leaves_out_nodes_without_children(spark, monkeypatch):
    """A chain of 30 below a cycle of two, and 2,000 nodes that hang from them: jumps are made of the few only."""
    parent = {0: 1, 1: 0, 2: 1} | {i: i - 1 for i in range(3, 32)} | {i: i % 32 for i in range(32, 2032)}
    nodes = spark.createDataFrame(list(parent.items()), "id long, parent_id long")
    written, keep = [], ev.checkpointed

    def counted(df):
        out = keep(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(ev, "checkpointed", counted)
    lift = ev.lifting(nodes)
    assert sum(written) < 8 * len(parent)

    def steps_up(i, top):
        for k in range(len(parent)):
            if i == top:
                return k
            i = parent[i]

    for top in (0, 1, 12, 40):
        want = {i: k for i in parent if (k := steps_up(i, top)) is not None}
        assert {r["id"]: r["depth"] for r in ev.descendants(nodes, top, lift).collect()} == want
    pairs = spark.createDataFrame([(i, k) for i in (5, 40, 2031) for k in (0, 1, 2, 3, 33, 90)], "i long, k long")
    tree = {r["id"]: r["parent_id"] for r in lift.tree.nodes.collect()}
    for r in ev.ancestor_at(pairs, lift, "i", "k", "up").collect():
        at = r["i"]
        for _ in range(r["k"]):
            at = tree.get(at)
        assert r["up"] == at, r
