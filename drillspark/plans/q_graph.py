"""Registered queries: evidence-graph analytics (G1-G17) and usage
accounting (U1), over graph tables derived from ``events`` and
``conversations`` (see ``graph_tables``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import dround
from ..operators import evidence as ev
from ..operators.similarity import STOP_WORDS, dedup_keep_first, near_duplicate_pairs
from ..operators.usage import usage_cost
from .catalog import register, table
from .graph_tables import EDGES_SQL, NODES_SQL, graph_edges, graph_nodes

_BASE = f"nodes AS {NODES_SQL}, edges AS {EDGES_SQL}"
_G1 = """t AS (SELECT id, investigation_id, seq, parent_id, kind, content_json,
  last_value(CASE WHEN kind = 'user_question' THEN id END IGNORE NULLS)
    OVER (PARTITION BY investigation_id ORDER BY seq, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn_id
  FROM nodes)"""
_PAIRS = """w AS (SELECT *, first_value(CASE WHEN kind = 'conclusion' THEN id END IGNORE NULLS)
    OVER (PARTITION BY investigation_id ORDER BY seq, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_c FROM t),
pairs AS (SELECT q.investigation_id, q.id AS question_id, q.seq AS question_seq, c.id AS conclusion_id,
                 c.seq AS conclusion_seq, c.turn_id = q.id AS own_turn
          FROM w q JOIN t c ON c.id = q.next_c WHERE q.kind = 'user_question'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY question_seq DESC, question_id DESC) AS recency
           FROM pairs)"""
_CLOSURE = """anc(node_id, ancestor_id, depth) AS (
  SELECT id, parent_id, 1 FROM nodes WHERE parent_id IS NOT NULL
  UNION ALL
  SELECT a.node_id, n.parent_id, a.depth + 1 FROM anc a JOIN nodes n ON n.id = a.ancestor_id WHERE n.parent_id IS NOT NULL),
closure AS (SELECT node_id, ancestor_id, CAST(depth AS BIGINT) AS depth FROM anc
            UNION ALL SELECT id, id, CAST(0 AS BIGINT) FROM nodes)"""

_NODE_COLS = ["id", "investigation_id", "seq", "parent_id", "kind"]


def _g(spark, sf):
    return graph_nodes(spark, sf), graph_edges(spark, sf)


@register("G1_turns", f"WITH {_BASE}, {_G1} SELECT id, investigation_id, seq, kind, turn_id FROM t")
def g1(spark, sf):
    n, _ = _g(spark, sf)
    return ev.turns(n).select("id", "investigation_id", "seq", "kind", "turn_id")


@register("G2_turn_pairs", f"WITH {_BASE}, {_G1}, {_PAIRS} SELECT * FROM pairs")
def g2(spark, sf):
    n, _ = _g(spark, sf)
    return ev.turn_pairs(n)


@register(
    "G3_last_turns",
    f"WITH {_BASE}, {_G1}, {_PAIRS} SELECT * FROM ranked WHERE recency <= 3",
)
def g3(spark, sf):
    n, _ = _g(spark, sf)
    return ev.last_turns(ev.turn_pairs(n), 3)


@register(
    "G3_uncovered_turns",
    f"""WITH {_BASE}, {_G1}, {_PAIRS},
s AS (SELECT investigation_id, arg_max(CAST(json_extract(content_json, '$.through_seq') AS BIGINT), (seq, id)) AS through_seq
      FROM nodes WHERE kind = 'summary' GROUP BY investigation_id)
SELECT r.investigation_id, question_id, question_seq, conclusion_id, conclusion_seq FROM ranked r
LEFT JOIN s ON s.investigation_id = r.investigation_id
WHERE recency > 3 AND conclusion_seq > coalesce(s.through_seq, 0)""",
)
def g3u(spark, sf):
    n, _ = _g(spark, sf)
    return ev.uncovered_turns(ev.turn_pairs(n), n, 3)


_SUMMARIES = """
SELECT 'late-' || coalesce(investigation_id, '') AS id, investigation_id, max(seq) + 1 AS seq, max(seq) // 2 AS through_seq
FROM nodes GROUP BY investigation_id
UNION ALL SELECT 'early-' || coalesce(investigation_id, ''), investigation_id, max(seq) // 4, max(seq) // 8
FROM nodes GROUP BY investigation_id"""


def _with_summaries(n):
    """Two summaries an investigation; the later one counts."""
    top = n.groupBy("investigation_id").agg(F.max("seq").alias("top"))
    out = n
    for name, seq, through in (
        ("late-", F.col("top") + 1, F.floor(F.col("top") / 2)),
        ("early-", F.floor(F.col("top") / 4), F.floor(F.col("top") / 8)),
    ):
        out = out.unionByName(
            top.select(
                F.concat(F.lit(name), F.coalesce("investigation_id", F.lit(""))).alias("id"),
                "investigation_id",
                seq.cast("long").alias("seq"),
                F.lit(None).cast("string").alias("parent_id"),
                F.lit("summary").alias("kind"),
                F.to_json(F.struct(through.cast("long").alias("through_seq"))).alias("content_json"),
            )
        )
    return out


@register(
    "G3_uncovered_after_summary",
    f"""WITH {_BASE}, {_G1}, {_PAIRS}, su AS ({_SUMMARIES}),
s AS (SELECT investigation_id, arg_max(through_seq, (seq, id)) AS through_seq FROM su GROUP BY investigation_id)
SELECT r.investigation_id, question_id, question_seq, conclusion_id, conclusion_seq FROM ranked r
LEFT JOIN s ON s.investigation_id = r.investigation_id
WHERE recency > 3 AND conclusion_seq > coalesce(s.through_seq, 0)""",
)
def g3s(spark, sf):
    n, _ = _g(spark, sf)
    return ev.uncovered_turns(ev.turn_pairs(n), _with_summaries(n), 3)


@register(
    "G3_recent_nodes",
    f"""WITH {_BASE} SELECT id, investigation_id, seq, parent_id, kind FROM (
  SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY seq DESC, id DESC) AS rk FROM nodes) WHERE rk <= 5""",
)
def g3r(spark, sf):
    n, _ = _g(spark, sf)
    return ev.recent_nodes(n, 5).select(*_NODE_COLS)


@register("G4_ancestors", f"WITH RECURSIVE {_BASE}, {_CLOSURE} SELECT * FROM closure")
def g4(spark, sf):
    n, _ = _g(spark, sf)
    return ev.ancestors(n)


@register("G5_descendants", f"WITH RECURSIVE {_BASE}, {_CLOSURE} SELECT node_id AS id, depth FROM closure WHERE ancestor_id = 'e1'")
def g5(spark, sf):
    n, _ = _g(spark, sf)
    return ev.descendants(n, "e1")


# an order that is its own parent, a cycle of two, a chain of 10,000 orders that
# hangs from the cycle, and the rest hanging from both
_CYCLIC = """CASE WHEN o_orderkey = 0 THEN 0 WHEN o_orderkey = 1 THEN 2 WHEN o_orderkey = 2 THEN 1
  WHEN o_orderkey = 3 THEN 1 WHEN o_orderkey <= 10002 THEN o_orderkey - 1
  WHEN o_orderkey % 2 = 0 THEN 0 ELSE 2 END"""
_CYCLIC_TOPS = (0, 1, 3, 700)


@register(
    "G5_descendants_with_cycles",
    f"""
WITH RECURSIVE n AS (SELECT o_orderkey AS id, {_CYCLIC} AS parent_id FROM orders),
walk(top, id) AS (
  SELECT id, id FROM n WHERE id IN {_CYCLIC_TOPS}
  UNION SELECT walk.top, n.id FROM walk JOIN n ON n.parent_id = walk.id)
SELECT top, id FROM walk""",
)
def g5c(spark, sf):
    n = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_CYCLIC).alias("parent_id"))
    lift = ev.lifting(n)
    out = None
    for top in _CYCLIC_TOPS:
        below = ev.descendants(n, top, lift).select(F.lit(top).cast("long").alias("top"), "id")
        out = below if out is None else out.unionByName(below)
    return out


@register(
    "G6_branches",
    f"""WITH RECURSIVE {_BASE}, {_G1},
lc AS (SELECT turn_id AS parent_turn, arg_max(id, (seq, id)) AS cid FROM t
       WHERE kind = 'conclusion' AND turn_id IS NOT NULL GROUP BY turn_id),
q AS (SELECT investigation_id, id AS question_id, seq, parent_id FROM nodes WHERE kind = 'user_question'),
tree AS (SELECT q.*, lc.parent_turn FROM q LEFT JOIN lc ON q.parent_id = lc.cid),
sib AS (SELECT question_id, row_number() OVER (PARTITION BY parent_turn ORDER BY seq, question_id) AS sib
        FROM tree WHERE parent_turn IS NOT NULL),
tree2 AS (SELECT tree.*, coalesce(sib.sib, 0) > 1 AS opens FROM tree LEFT JOIN sib USING (question_id)),
ta(node_id, ancestor_id, depth) AS (
  SELECT question_id, question_id, 0 FROM tree2
  UNION ALL
  SELECT a.node_id, t2.parent_turn, a.depth + 1 FROM ta a JOIN tree2 t2 ON t2.question_id = a.ancestor_id
  WHERE t2.parent_turn IS NOT NULL),
openers AS (SELECT question_id AS opener, seq AS oseq, investigation_id FROM tree2 WHERE opens),
paths AS (SELECT a.node_id AS opener, list(struct_pack(s := t.seq, i := t.question_id) ORDER BY a.depth DESC) AS p
          FROM ta a JOIN tree2 t ON t.question_id = a.ancestor_id WHERE a.node_id IN (SELECT opener FROM openers)
          GROUP BY a.node_id),
num AS (SELECT o.opener, row_number() OVER (PARTITION BY o.investigation_id ORDER BY paths.p, o.opener) AS branch_no
        FROM openers o JOIN paths USING (opener)),
near AS (SELECT a.node_id, arg_min(a.ancestor_id, a.depth) AS opener FROM ta a JOIN openers o ON o.opener = a.ancestor_id
         GROUP BY a.node_id),
lab AS (SELECT tree2.investigation_id, tree2.question_id, CAST(coalesce(num.branch_no, 0) AS BIGINT) AS branch
        FROM tree2 LEFT JOIN near ON near.node_id = tree2.question_id LEFT JOIN num ON num.opener = near.opener),
vis AS (SELECT question_id, branch AS visible_in FROM lab
        UNION SELECT a.ancestor_id, l.branch FROM ta a JOIN lab l ON l.question_id = a.node_id WHERE l.branch <> 0)
SELECT lab.investigation_id, lab.question_id, lab.branch,
       min(visible_in) FILTER (WHERE visible_in <> branch) AS visible_from,
       max(visible_in) FILTER (WHERE visible_in <> branch) AS visible_to,
       count(DISTINCT visible_in) FILTER (WHERE visible_in <> branch) AS visible
FROM lab JOIN vis USING (question_id) GROUP BY ALL""",
)
def g6(spark, sf):
    n, _ = _g(spark, sf)
    return ev.branches(n)


_STATUS = f"""WITH {_BASE},
inc AS (SELECT target_id AS id, count(*) FILTER (WHERE relationship = 'supports') AS supports,
               count(*) FILTER (WHERE relationship = 'contradicts') AS contradicts,
               count(*) FILTER (WHERE relationship = 'tests') AS tests
        FROM edges WHERE status = 'active' GROUP BY target_id),
st AS (SELECT n.investigation_id, n.id, coalesce(supports, 0) AS supports, coalesce(contradicts, 0) AS contradicts,
              coalesce(tests, 0) AS tests,
              CASE WHEN coalesce(supports, 0) > 0 AND coalesce(contradicts, 0) > 0 THEN 'weakened'
                   WHEN coalesce(contradicts, 0) > 0 THEN 'rejected' WHEN coalesce(supports, 0) > 0 THEN 'supported'
                   WHEN coalesce(tests, 0) > 0 THEN 'unresolved' ELSE 'proposed' END AS status
       FROM nodes n LEFT JOIN inc USING (id) WHERE n.kind = 'hypothesis')"""


@register("G7_hypothesis_status", _STATUS + " SELECT * FROM st")
def g7(spark, sf):
    return ev.hypothesis_status(*_g(spark, sf))


@register(
    "G8_orphan_conclusions",
    f"""WITH {_BASE} SELECT investigation_id, id, seq FROM nodes n WHERE kind = 'conclusion' AND NOT EXISTS (
  SELECT 1 FROM edges e WHERE e.status = 'active' AND e.relationship = 'supports' AND e.target_id = n.id)""",
)
def g8(spark, sf):
    return ev.orphan_conclusions(*_g(spark, sf))


@register(
    "G9_untested_hypotheses",
    f"""WITH {_BASE} SELECT investigation_id, id, seq FROM nodes n WHERE kind = 'hypothesis' AND NOT EXISTS (
  SELECT 1 FROM edges e WHERE e.status = 'active' AND e.relationship = 'tests' AND e.target_id = n.id)""",
)
def g9(spark, sf):
    return ev.untested_hypotheses(*_g(spark, sf))


@register("G9_open_hypotheses", _STATUS + " SELECT * FROM st WHERE status IN ('proposed', 'unresolved')")
def g9o(spark, sf):
    return ev.open_hypotheses(*_g(spark, sf))


@register(
    "G10_shared_evidence",
    f"""WITH RECURSIVE {_BASE}, {_CLOSURE},
sup AS (SELECT DISTINCT e.investigation_id, e.source_id, e.target_id FROM edges e
        JOIN nodes n ON n.id = e.target_id AND n.kind = 'conclusion'
        WHERE e.status = 'active' AND e.relationship = 'supports'),
cnt AS (SELECT source_id, count(*) AS conclusions FROM sup GROUP BY source_id),
div AS (SELECT DISTINCT a.investigation_id, a.source_id FROM sup a JOIN sup b
          ON a.source_id = b.source_id AND a.target_id < b.target_id
        WHERE NOT EXISTS (SELECT 1 FROM closure x WHERE x.node_id = a.target_id AND x.ancestor_id = b.target_id)
          AND NOT EXISTS (SELECT 1 FROM closure x WHERE x.node_id = b.target_id AND x.ancestor_id = a.target_id))
SELECT div.investigation_id, div.source_id AS id, cnt.conclusions FROM div JOIN cnt USING (source_id)""",
)
def g10(spark, sf):
    return ev.shared_evidence(*_g(spark, sf))


@register(
    "G11_metric_drift",
    f"""WITH {_BASE},
m AS (SELECT investigation_id, id, json_extract_string(content_json, '$.name') AS name,
             trim(json_extract_string(content_json, '$.sql')) AS sql FROM nodes WHERE kind = 'metric'),
d AS (SELECT investigation_id, name, count(DISTINCT sql) AS definitions FROM m GROUP BY ALL HAVING count(DISTINCT sql) > 1)
SELECT m.investigation_id, m.name, d.definitions, m.id, m.sql FROM m JOIN d USING (investigation_id, name)""",
)
def g11(spark, sf):
    n, _ = _g(spark, sf)
    return ev.metric_drift(n)


def _tokens_sql(src: str, id_col: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""(SELECT DISTINCT id, CASE WHEN length(w) > 4 AND suffix(w, 's') THEN left(w, length(w) - 1) ELSE w END AS tok
  FROM (SELECT {id_col} AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {src})
  WHERE length(w) > 2 AND w NOT IN ({stop}))"""


@register(
    "G12_near_duplicate_pairs",
    f"""WITH bt AS {_tokens_sql('benchmark', 'item_id')}, dt AS {_tokens_sql('documents', 'doc_id')},
bs AS (SELECT id, count(*) AS n FROM bt GROUP BY id), ds AS (SELECT id, count(*) AS n FROM dt GROUP BY id),
sh AS (SELECT bt.id AS id_a, dt.id AS id_b, count(*) AS shared FROM bt JOIN dt USING (tok) GROUP BY 1, 2)
SELECT sh.id_a, sh.id_b, sh.shared, bs.n AS size_a, ds.n AS size_b, sh.shared / least(bs.n, ds.n) AS overlap
FROM sh JOIN bs ON bs.id = sh.id_a JOIN ds ON ds.id = sh.id_b WHERE sh.shared / least(bs.n, ds.n) >= 0.6""",
)
def g12(spark, sf):
    return near_duplicate_pairs(
        table(spark, sf, "benchmark"), "item_id", "text", table(spark, sf, "documents"), "doc_id", "text", 0.6
    )


@register(
    "G12_dedup_documents",
    f"""WITH RECURSIVE tk AS MATERIALIZED {_tokens_sql('documents', 'doc_id')},
sizes AS (SELECT id, count(*) AS n FROM tk GROUP BY id),
near AS (SELECT a.id AS late, b.id AS early, count(*) AS shared FROM tk a JOIN tk b ON a.tok = b.tok AND b.id < a.id GROUP BY 1, 2),
before AS (SELECT late, list(early) AS early FROM near JOIN sizes a ON a.id = late JOIN sizes b ON b.id = early
           WHERE shared / least(a.n, b.n) >= 0.6 GROUP BY late),
line AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, early
                      FROM documents LEFT JOIN before ON late = doc_id),
walk(i, kept) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT line.i, CASE WHEN early IS NOT NULL AND list_has_any(kept, early) THEN kept ELSE list_append(kept, doc_id) END
  FROM walk JOIN line ON line.i = walk.i + 1)
SELECT doc_id, list_contains(w.kept, doc_id) AS kept
FROM documents, (SELECT kept FROM walk ORDER BY i DESC LIMIT 1) w""",
)
def g12d(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return dedup_keep_first(docs, "doc_id", "doc_id", "text", 0.6).select("doc_id", "kept")


def _plans(n):
    steps_t = "array<struct<id:string,depends_on:array<string>>>"
    plans = n.where(F.col("kind") == "plan").select(
        "investigation_id", F.col("id").alias("plan_id"), "seq", F.from_json(ev.content("steps"), steps_t).alias("steps")
    )
    ids = n.select(F.col("id").alias("node_id"))
    results = (
        plans.select("investigation_id", "plan_id", "seq", F.posexplode("steps").alias("pos", "s"))
        .select(
            "investigation_id", "plan_id", F.col("s.id").alias("step_id"),
            F.concat(F.lit("e"), (F.col("seq") * 2 + F.col("pos")).cast("string")).alias("node_id"),
        )
        .join(ids, "node_id", "left_semi")
    )
    return plans, results


@register(
    "G13_plan_edges",
    f"""WITH {_BASE},
p AS (SELECT investigation_id, id AS plan_id, seq,
             unnest(from_json(json_extract(content_json, '$.steps'), '[{{"id":"VARCHAR","depends_on":["VARCHAR"]}}]')) AS s
      FROM nodes WHERE kind = 'plan'),
steps AS (SELECT investigation_id, plan_id, seq, s.id AS step_id, s.depends_on AS deps FROM p),
res AS (SELECT investigation_id, plan_id, step_id, 'e' || (2 * seq + CAST(substr(step_id, 2) AS BIGINT)) AS node_id FROM steps
        WHERE 'e' || (2 * seq + CAST(substr(step_id, 2) AS BIGINT)) IN (SELECT id FROM nodes)),
st AS (SELECT investigation_id, plan_id, step_id, unnest(deps) AS dep FROM steps)
SELECT DISTINCT st.investigation_id, r1.node_id AS source_id, r2.node_id AS target_id, 'depends_on' AS relationship,
       'narrator' AS created_by
FROM st JOIN res r1 ON r1.plan_id = st.plan_id AND r1.step_id = st.step_id
JOIN res r2 ON r2.plan_id = st.plan_id AND r2.step_id = st.dep""",
)
def g13(spark, sf):
    n, _ = _g(spark, sf)
    plans, results = _plans(n)
    return ev.plan_edges(plans.drop("seq"), results)


def _lint_sql() -> str:
    tools = ", ".join(f"'{t}'" for t in ev.TEST_TOOLS)
    pattern = ev.CAUSAL_PATTERN.replace("'", "''")
    base = f"""WITH {_BASE}, {_G1}, tt AS (SELECT * FROM t WHERE turn_id IS NOT NULL),
per AS (SELECT investigation_id, turn_id,
   CAST(coalesce(sum(CASE WHEN kind = 'plan' THEN json_array_length(json_extract(content_json, '$.steps')) END), 0) AS BIGINT) AS planned,
   count(*) FILTER (WHERE kind IN ('table_result', 'tool_result')) AS evidence,
   count(*) FILTER (WHERE kind = 'error') AS errors,
   count(*) FILTER (WHERE kind = 'tool_result' AND json_extract_string(content_json, '$.tool') IN ({tools})) AS tests,
   count(*) FILTER (WHERE kind = 'table_result' AND CAST(json_extract(content_json, '$.row_count') AS BIGINT) >= {ev.ROW_CAP}) AS capped,
   arg_max(id, (seq, id)) FILTER (WHERE kind = 'conclusion') AS cid,
   arg_max(json_extract_string(content_json, '$.summary'), (seq, id)) FILTER (WHERE kind = 'conclusion') AS summary,
   arg_max(json_extract_string(content_json, '$.confidence'), (seq, id)) FILTER (WHERE kind = 'conclusion') AS confidence
 FROM tt GROUP BY investigation_id, turn_id),
c AS (SELECT * FROM per WHERE cid IS NOT NULL)"""
    sel = "SELECT investigation_id, turn_id, cid AS conclusion_id, planned, evidence, errors, "
    rules = [
        ("groundedness", "planned > 0 AND evidence = 0"),
        ("step_errors", "errors > 0"),
        ("causal_claim", f"regexp_matches(coalesce(summary, ''), '{pattern}') AND tests = 0"),
        ("confidence_calibration", "confidence = 'high' AND (evidence <= 1 OR errors > 0)"),
        ("truncation", "capped > 0"),
    ]
    parts = [f"{sel}'{r}' AS rule, CASE WHEN {cond} THEN 'warn' ELSE 'ok' END AS status FROM c" for r, cond in rules]
    return base + "\n" + "\nUNION ALL\n".join(parts)


@register("G14_lint_turns", _lint_sql())
def g14(spark, sf):
    n, _ = _g(spark, sf)
    return ev.lint_turns(n)


@register(
    "G15_evidence_chain",
    f"""WITH {_BASE}, {_G1}, tt AS (SELECT * FROM t WHERE turn_id IS NOT NULL),
tb AS (SELECT turn_id, parent_id, arg_max(id, (seq, id)) AS result_id FROM tt WHERE kind = 'table_result' GROUP BY ALL)
SELECT s.investigation_id, s.turn_id, 'sql' AS step_kind, s.id AS step_id, tb.result_id FROM tt s
  LEFT JOIN tb ON tb.parent_id = s.id AND tb.turn_id = s.turn_id WHERE s.kind = 'sql_query'
UNION ALL SELECT investigation_id, turn_id, 'tool', id, id FROM tt WHERE kind = 'tool_result'
UNION ALL SELECT investigation_id, turn_id, 'chart', id, json_extract_string(content_json, '$.source_node_id') FROM tt
  WHERE kind = 'chart'""",
)
def g15(spark, sf):
    n, _ = _g(spark, sf)
    return ev.evidence_chain(n)


@register(
    "G16_claim_evidence",
    f"""WITH {_BASE},
sup AS (SELECT s.target_id AS conclusion_id, s.source_id AS evidence_id, n.kind AS evidence_kind FROM edges s
        JOIN nodes n ON n.id = s.source_id WHERE s.status = 'active' AND s.relationship = 'supports')
SELECT c.investigation_id, c.id AS conclusion_id, sup.evidence_id, sup.evidence_kind FROM nodes c
LEFT JOIN sup ON sup.conclusion_id = c.id WHERE c.kind = 'conclusion'""",
)
def g16(spark, sf):
    return ev.claim_evidence(*_g(spark, sf))


@register(
    "G16_semantic_edges_in_scope",
    f"""WITH RECURSIVE {_BASE}, {_CLOSURE},
scope AS (SELECT node_id AS id FROM closure WHERE ancestor_id = 'e2')
SELECT investigation_id, id, source_id, target_id, relationship, status FROM edges
WHERE relationship IN ('contradicts', 'alternative_to', 'refines', 'supersedes')
  AND source_id IN (SELECT id FROM scope) AND target_id IN (SELECT id FROM scope)""",
)
def g16s(spark, sf):
    n, e = _g(spark, sf)
    scope = ev.descendants(n, "e2")
    return ev.semantic_edges(n, e, scope)


@register(
    "G17_by_prefix",
    f"WITH {_BASE} SELECT id, investigation_id, seq, parent_id, kind FROM nodes "
    "WHERE investigation_id = 'events' AND starts_with(id, 'e12')",
)
def g17(spark, sf):
    n, _ = _g(spark, sf)
    return ev.by_prefix(n, "events", "e12").select(*_NODE_COLS)


@register("G17_children", f"WITH {_BASE} SELECT id, investigation_id, seq, parent_id, kind FROM nodes WHERE parent_id = 'e3'")
def g17c(spark, sf):
    n, _ = _g(spark, sf)
    return ev.children(n, ["e3"]).select(*_NODE_COLS)


# The price table given to the usage queries ($ per 1M tokens).
PRICES = (("model-large", 5.0, 25.0), ("model-medium", 3.0, 15.0), ("model-small", 1.0, 5.0))
_MODELS = ("model-large", "model-medium", "model-small", "model-unpriced")


def _calls(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    n = F.length("text").cast("long")
    model = F.element_at(F.array(*[F.lit(m) for m in _MODELS]), (F.col("conv_id") % 4).cast("int") + 1)
    return c.select(
        model.alias("model"),
        F.floor(n * 3 / 4).cast("long").alias("input_tokens"),
        F.floor(n / 4).cast("long").alias("output_tokens"),
        F.floor(n * F.col("turn") / 10).cast("long").alias("cache_read_tokens"),
        F.when(F.col("turn") == 1, F.floor(n / 8)).otherwise(F.lit(0)).cast("long").alias("cache_write_tokens"),
    )


def _prices(spark):
    return spark.createDataFrame(list(PRICES), "model string, input_price double, output_price double")


_CALLS_SQL = f"""calls AS (SELECT [{', '.join("'" + m + "'" for m in _MODELS)}][conv_id % 4 + 1] AS model,
  CAST(floor(length(text) * 3 / 4) AS BIGINT) AS input_tokens, CAST(floor(length(text) / 4) AS BIGINT) AS output_tokens,
  CAST(floor(length(text) * turn / 10) AS BIGINT) AS cache_read_tokens,
  CAST(CASE WHEN turn = 1 THEN floor(length(text) / 8) ELSE 0 END AS BIGINT) AS cache_write_tokens
  FROM conversations WHERE role = 'assistant'),
prices AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {a}, {b})" for m, a, b in PRICES)}) v(model, input_price, output_price)),
per AS (SELECT model, count(*) AS calls, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens,
               sum(cache_read_tokens) AS cache_read_tokens, sum(cache_write_tokens) AS cache_write_tokens
        FROM calls GROUP BY model),
j AS (SELECT per.*, coalesce(p.input_price, 5.0) AS ip, coalesce(p.output_price, 25.0) AS op,
             (SELECT input_price FROM prices WHERE model = 'model-large') AS aip,
             (SELECT output_price FROM prices WHERE model = 'model-large') AS aop
      FROM per LEFT JOIN prices p USING (model)),
c AS (SELECT *, (CAST(input_tokens AS DOUBLE) * ip + CAST(cache_write_tokens AS DOUBLE) * ip * 1.25
                 + CAST(cache_read_tokens AS DOUBLE) * ip * 0.1 + CAST(output_tokens AS DOUBLE) * op) / 1000000.0 AS cost,
             ((CAST(input_tokens AS DOUBLE) + CAST(cache_read_tokens AS DOUBLE) + CAST(cache_write_tokens AS DOUBLE)) * ip
                 + CAST(output_tokens AS DOUBLE) * op) / 1000000.0 AS uncached_cost,
             (CAST(input_tokens AS DOUBLE) * aip + CAST(cache_write_tokens AS DOUBLE) * aip * 1.25
                 + CAST(cache_read_tokens AS DOUBLE) * aip * 0.1 + CAST(output_tokens AS DOUBLE) * aop) / 1000000.0 AS cost_as_model
      FROM j)"""


@register(
    "U1_usage_per_model",
    f"""WITH {_CALLS_SQL}
SELECT model, calls, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens,
       ROUND(cost, 6) AS cost, ROUND(uncached_cost, 6) AS uncached_cost, ROUND(uncached_cost - cost, 6) AS savings,
       ROUND(cost_as_model, 6) AS cost_as_model FROM c""",
)
def u1(spark, sf):
    per = usage_cost(_calls(spark, sf), _prices(spark), as_model="model-large").per_model
    return per.select(
        "model", "calls", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens",
        *[dround(c, 6).alias(c) for c in ("cost", "uncached_cost", "savings", "cost_as_model")],
    )


@register(
    "U1_usage_total",
    f"""WITH {_CALLS_SQL}
SELECT CAST(sum(calls) AS BIGINT) AS calls, ROUND(sum(cost), 6) AS cost, ROUND(sum(uncached_cost), 6) AS uncached_cost,
       ROUND(sum(uncached_cost) - sum(cost), 6) AS savings,
       ROUND(CASE WHEN sum(uncached_cost) > 0 THEN (sum(uncached_cost) - sum(cost)) / sum(uncached_cost) * 100 ELSE 0 END, 6)
         AS savings_pct,
       ROUND(sum(cost_as_model) - sum(cost), 6) AS routing_savings FROM c""",
)
def u1t(spark, sf):
    tot = usage_cost(_calls(spark, sf), _prices(spark), as_model="model-large").total
    return tot.select(
        "calls", *[dround(c, 6).alias(c) for c in ("cost", "uncached_cost", "savings", "savings_pct", "routing_savings")]
    )
