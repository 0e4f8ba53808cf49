"""Evidence-graph tables derived from the driver tables.

The driver data has no investigation graph, so the registered graph queries
derive one by fixed rules, with Spark, from two tables - its size grows with
them:

* ``events``: one node per event in investigation 'events', seq = event_id,
  parent = event_id div 2 (a binary tree; most nodes sit in this one
  investigation, which is exactly the hot-key case). The kind follows the
  event type and the ``k`` value in ``props``; every event also leaves one
  typed edge to its parent, and every other click a second supports edge to
  the node after its parent (evidence shared across branches).
* ``conversations``: investigation per conversation, seq = turn, user turns
  are questions, assistant turns conclusions, system turns plans; a thread
  whose parent is the previous turn, except some later questions that branch
  off the conclusion three turns back.

The same rules are written in SQL (``*_SQL`` below) for the DuckDB twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import table

# Payload texts of derived nodes (invented for the test graph).
CONCLUSION_TEXTS = (
    "revenue fell because fewer orders were placed",
    "orders rose in every region",
    "the decline was driven by one segment",
    "no material change between the periods",
    "higher prices explain the growth",
    "volume and rate moved together",
)
HYPOTHESIS_TEXTS = (
    "fewer orders drove the revenue decline",
    "the revenue decline was driven by fewer orders",
    "a price increase reduced demand",
    "seasonal effects explain the dip",
    "demand fell after the price increase",
    "one region accounts for the whole change",
    "the nightly loader dropped late records",
    "late records were dropped by the nightly loader",
)
TOOL_NAMES = (
    "describe", "outliers", "decompose_contribution", "volume_vs_rate", "fit_distribution", "t_test",
    "mann_whitney", "chi_square", "correlation", "correlation_matrix", "moving_average", "growth_rates",
    "trend", "linear_fit", "logistic_fit", "cohort_retention", "funnel", "rfm",
)
CONFIDENCE = ("low", "medium", "high")


def _pick(values, idx):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values)).cast("int") + 1)


def event_nodes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    t = F.col("event_type")
    kind = (
        F.when(t == "signup", "user_question")
        .when(t == "purchase", "conclusion")
        .when(t == "error", F.when(k < 50, "error").otherwise("sql_query"))
        .when(t == "click", F.when(k < 40, "tool_result").when(k < 80, "table_result").otherwise("chart"))
        .when(t == "view", F.when(k < 20, "plan").when(k < 40, "metric").otherwise("hypothesis"))
        .otherwise("interpretation")
    )
    parent = F.when(F.col("event_id") > 0, F.concat(F.lit("e"), (F.col("event_id") / 2).cast("long").cast("string")))
    step = lambda i: F.struct(
        F.lit(f"s{i}").alias("id"),
        (F.array(F.lit(f"s{i - 1}")) if i else F.array().cast("array<string>")).alias("depends_on"),
    )
    steps = F.slice(F.array(*[step(i) for i in range(3)]), 1, (k % 4).cast("int"))
    payload = (
        F.when(F.col("_kind") == "user_question",
               F.to_json(F.struct(F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("question"))))
        .when(F.col("_kind") == "conclusion",
              F.to_json(F.struct(_pick(CONCLUSION_TEXTS, k).alias("summary"), _pick(CONFIDENCE, k).alias("confidence"))))
        .when(F.col("_kind") == "tool_result", F.to_json(F.struct(_pick(TOOL_NAMES, k).alias("tool"))))
        .when(F.col("_kind") == "table_result", F.to_json(F.struct((F.col("value") * 10).cast("long").alias("row_count"))))
        .when(F.col("_kind") == "sql_query", F.to_json(F.struct(F.concat(F.lit("SELECT "), k.cast("string")).alias("sql"))))
        .when(F.col("_kind") == "plan", F.to_json(F.struct(steps.alias("steps"))))
        .when(F.col("_kind") == "metric",
              F.to_json(F.struct(
                  F.concat(F.lit("metric_"), (k % 5).cast("string")).alias("name"),
                  F.when(k % 10 == 7, F.lit("AVG(value)"))
                  .when(F.col("user_id") % 4 == 0, F.lit("SUM(value) "))
                  .otherwise(F.lit("SUM(value)")).alias("sql"),
              )))
        .when(F.col("_kind") == "hypothesis", F.to_json(F.struct(_pick(HYPOTHESIS_TEXTS, k).alias("statement"))))
        .when(F.col("_kind") == "chart", F.to_json(F.struct(parent.alias("source_node_id"))))
        .otherwise(F.to_json(F.struct(F.concat(F.lit("error "), k.cast("string")).alias("message"))))
    )
    return e.withColumn("_kind", kind).select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        F.lit("events").alias("investigation_id"),
        F.col("event_id").cast("long").alias("seq"),
        parent.alias("parent_id"),
        F.col("_kind").alias("kind"),
        payload.alias("content_json"),
    )


def conversation_nodes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    t = F.col("turn")
    branch = (F.col("role") == "user") & (t >= 3) & ((F.col("conv_id") + t) % 3 == 0)
    parent_turn = F.when(t == 0, F.lit(None)).when(branch, t - 3).otherwise(t - 1)
    kind = F.when(F.col("role") == "user", "user_question").when(F.col("role") == "assistant", "conclusion").otherwise("plan")
    payload = (
        F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("question"))))
        .when(F.col("role") == "assistant",
              F.to_json(F.struct(F.col("text").alias("summary"), _pick(CONFIDENCE, F.length("text")).alias("confidence"))))
        .otherwise(F.to_json(F.struct(F.array().cast("array<string>").alias("steps"))))
    )
    return c.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string")).alias("id"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("investigation_id"),
        t.cast("long").alias("seq"),
        F.when(parent_turn.isNotNull(),
               F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), parent_turn.cast("string"))).alias("parent_id"),
        kind.alias("kind"),
        payload.alias("content_json"),
    )


def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return event_nodes(spark, sf).unionByName(conversation_nodes(spark, sf))


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    t = F.col("event_type")
    rel = (
        F.when(t == "click", "supports").when(t == "error", "contradicts").when(t == "view", "tests")
        .when(t == "purchase", "depends_on").otherwise("refines")
    )
    status = F.when(F.col("value") >= 20, "active").otherwise("proposed")
    src = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    n = e.agg(F.max("event_id").alias("_maxid"))
    first = e.where(F.col("event_id") > 0).select(
        F.concat(F.lit("x"), F.col("event_id").cast("string"), F.lit("-1")).alias("id"),
        F.lit("events").alias("investigation_id"),
        src.alias("source_id"),
        F.concat(F.lit("e"), (F.col("event_id") / 2).cast("long").cast("string")).alias("target_id"),
        rel.alias("relationship"),
        F.when(rel.isin("supports", "tests", "depends_on", "derived_from"), "engine").otherwise("narrator").alias("created_by"),
        status.alias("status"),
    )
    second = (
        e.crossJoin(F.broadcast(n))
        .where((t == "click") & (k % 2 == 0) & (F.col("event_id") > 0)
               & ((F.col("event_id") / 2).cast("long") + 1 <= F.col("_maxid")))
        .select(
            F.concat(F.lit("x"), F.col("event_id").cast("string"), F.lit("-2")).alias("id"),
            F.lit("events").alias("investigation_id"),
            src.alias("source_id"),
            F.concat(F.lit("e"), ((F.col("event_id") / 2).cast("long") + 1).cast("string")).alias("target_id"),
            F.lit("supports").alias("relationship"),
            F.lit("engine").alias("created_by"),
            status.alias("status"),
        )
    )
    return first.unionByName(second)


# SQL twins of the rules above (DuckDB)
def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


EVENT_NODES_SQL = f"""
SELECT 'e' || event_id AS id, 'events' AS investigation_id, CAST(event_id AS BIGINT) AS seq,
       CASE WHEN event_id > 0 THEN 'e' || (event_id // 2) END AS parent_id, kind,
       CASE kind
         WHEN 'user_question' THEN json_object('question', 'event ' || event_id)::VARCHAR
         WHEN 'conclusion' THEN json_object('summary', {_sql_list(CONCLUSION_TEXTS)}[k % {len(CONCLUSION_TEXTS)} + 1],
                                            'confidence', {_sql_list(CONFIDENCE)}[k % 3 + 1])::VARCHAR
         WHEN 'tool_result' THEN json_object('tool', {_sql_list(TOOL_NAMES)}[k % {len(TOOL_NAMES)} + 1])::VARCHAR
         WHEN 'table_result' THEN json_object('row_count', CAST(trunc(value * 10) AS BIGINT))::VARCHAR
         WHEN 'sql_query' THEN json_object('sql', 'SELECT ' || k)::VARCHAR
         WHEN 'plan' THEN json_object('steps', CASE k % 4 WHEN 0 THEN []::JSON[]
             WHEN 1 THEN [json_object('id', 's0', 'depends_on', []::VARCHAR[])]
             WHEN 2 THEN [json_object('id', 's0', 'depends_on', []::VARCHAR[]), json_object('id', 's1', 'depends_on', ['s0'])]
             ELSE [json_object('id', 's0', 'depends_on', []::VARCHAR[]), json_object('id', 's1', 'depends_on', ['s0']),
                   json_object('id', 's2', 'depends_on', ['s1'])] END)::VARCHAR
         WHEN 'metric' THEN json_object('name', 'metric_' || (k % 5),
             'sql', CASE WHEN k % 10 = 7 THEN 'AVG(value)' WHEN user_id % 4 = 0 THEN 'SUM(value) ' ELSE 'SUM(value)' END)::VARCHAR
         WHEN 'hypothesis' THEN json_object('statement', {_sql_list(HYPOTHESIS_TEXTS)}[k % {len(HYPOTHESIS_TEXTS)} + 1])::VARCHAR
         WHEN 'chart' THEN json_object('source_node_id', CASE WHEN event_id > 0 THEN 'e' || (event_id // 2) END)::VARCHAR
         ELSE json_object('message', 'error ' || k)::VARCHAR END AS content_json
FROM (
  SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    CASE event_type WHEN 'signup' THEN 'user_question' WHEN 'purchase' THEN 'conclusion'
      WHEN 'error' THEN CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) < 50 THEN 'error' ELSE 'sql_query' END
      WHEN 'click' THEN CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) < 40 THEN 'tool_result'
                             WHEN CAST(json_extract(props, '$.k') AS BIGINT) < 80 THEN 'table_result' ELSE 'chart' END
      WHEN 'view' THEN CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) < 20 THEN 'plan'
                            WHEN CAST(json_extract(props, '$.k') AS BIGINT) < 40 THEN 'metric' ELSE 'hypothesis' END
      ELSE 'interpretation' END AS kind
  FROM events)
"""

CONVERSATION_NODES_SQL = f"""
SELECT 'c' || conv_id || '-' || turn AS id, 'conv-' || conv_id AS investigation_id, CAST(turn AS BIGINT) AS seq,
       CASE WHEN turn = 0 THEN NULL
            WHEN role = 'user' AND turn >= 3 AND (conv_id + turn) % 3 = 0 THEN 'c' || conv_id || '-' || (turn - 3)
            ELSE 'c' || conv_id || '-' || (turn - 1) END AS parent_id,
       CASE role WHEN 'user' THEN 'user_question' WHEN 'assistant' THEN 'conclusion' ELSE 'plan' END AS kind,
       CASE role WHEN 'user' THEN json_object('question', text)::VARCHAR
                 WHEN 'assistant' THEN json_object('summary', text, 'confidence', {_sql_list(CONFIDENCE)}[length(text) % 3 + 1])::VARCHAR
                 ELSE json_object('steps', []::VARCHAR[])::VARCHAR END AS content_json
FROM conversations
"""

NODES_SQL = f"({EVENT_NODES_SQL} UNION ALL {CONVERSATION_NODES_SQL})"

EDGES_SQL = """
(SELECT 'x' || event_id || '-1' AS id, 'events' AS investigation_id, 'e' || event_id AS source_id,
        'e' || (event_id // 2) AS target_id,
        CASE event_type WHEN 'click' THEN 'supports' WHEN 'error' THEN 'contradicts' WHEN 'view' THEN 'tests'
                        WHEN 'purchase' THEN 'depends_on' ELSE 'refines' END AS relationship,
        CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'engine' ELSE 'narrator' END AS created_by,
        CASE WHEN value >= 20 THEN 'active' ELSE 'proposed' END AS status
 FROM events WHERE event_id > 0
 UNION ALL
 SELECT 'x' || event_id || '-2', 'events', 'e' || event_id, 'e' || (event_id // 2 + 1), 'supports', 'engine',
        CASE WHEN value >= 20 THEN 'active' ELSE 'proposed' END
 FROM events WHERE event_type = 'click' AND CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 AND event_id > 0
   AND event_id // 2 + 1 <= (SELECT max(event_id) FROM events))
"""
