"""Evidence-graph analytics (G1-G11, G13-G17) over ``nodes`` and ``edges``
tables of any number of investigations.

nodes: id, investigation_id, seq, parent_id, kind, content_json (+ free columns)
edges: id, investigation_id, source_id, target_id, relationship, created_by, status

``parent_id`` forms the conversational tree, ``edges`` the typed DAG. Every
operator is a DataFrame job; nothing walks the graph on the driver. Orderings
inside an investigation use global range-partitioned running counts (one
investigation may hold most nodes), and transitive closures use pointer
doubling with reliable checkpoints between rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import partition_row_numbers, running_sums
from ..functions.walks import branches_of, intervals_of
from ..session import checkpointed, ensure_checkpoint_dir, join_back
from .relational import ordered_window

# Edge vocabulary and the lint rule inputs.
SEMANTIC_EDGES = ("contradicts", "alternative_to", "refines", "supersedes")
TEST_TOOLS = (
    "t_test", "mann_whitney", "chi_square", "correlation", "correlation_matrix", "linear_fit", "logistic_fit", "trend",
)
CAUSAL_WORDS = (
    r"caus(e|ed|es|ing)|because|due to|drove|driven by|led to|leads? to|"
    r"responsible for|explains?|thanks to|resulted? in|the reason"
)
# word boundaries spelled out with Unicode letter/digit classes, so every
# regex engine (Java here, RE2 in SQL twins) treats accented letters as word
# characters, like a Unicode-aware \b does
CAUSAL_PATTERN = r"(?i)(^|[^\pL\pN_])(" + CAUSAL_WORDS + r")($|[^\pL\pN_])"
ROW_CAP = 1000
VERBATIM_TURNS = 3

QUESTION, CONCLUSION, HYPOTHESIS, METRIC = "user_question", "conclusion", "hypothesis", "metric"


def content(field: str, cast: str | None = None) -> Column:
    """A field of the node payload (``content_json``)."""
    c = F.get_json_object(F.col("content_json"), f"$.{field}")
    return c.cast(cast) if cast else c


def _order() -> list[Column]:
    return [F.col("investigation_id").asc_nulls_first(), F.col("seq").asc(), F.col("id").asc()]


# --------------------------------------------------------------------------- G1
def turns(nodes: DataFrame) -> DataFrame:
    """Every node with ``turn_id``: the latest question at or before it in its
    investigation (null before the first question).

    The k-th question in global (investigation, seq) order owns exactly the
    nodes whose running question count is k, so the assignment is an
    equi-join on that count - no per-investigation window, no range join.
    Only the ordering keys go through the sort; the turn id is joined back
    to the full node rows by id.
    """
    keys = nodes.select("investigation_id", "seq", "id", (F.col("kind") == QUESTION).cast("long").alias("_isq"))
    counted = checkpointed(running_sums(keys, _order(), ["_isq"]))  # read twice below
    qs = counted.where(F.col("_isq") == 1).select(
        F.col("cum__isq").alias("_qk"), F.col("id").alias("_turn"), F.col("investigation_id").alias("_qinv")
    )
    tagged = counted.join(qs, F.col("cum__isq") == F.col("_qk"), "left").select(
        F.col("id").alias("_tid"),
        F.when(F.col("_qinv").eqNullSafe(F.col("investigation_id")), F.col("_turn")).alias("turn_id"),
    )
    return nodes.join(tagged, nodes["id"] == tagged["_tid"], "left").drop("_tid")


# --------------------------------------------------------------------------- G2
def turn_pairs(nodes: DataFrame) -> DataFrame:
    """Question -> the first conclusion with a larger seq in the same
    investigation (it may belong to a later question when this one has no
    answer: kept, with ``own_turn`` false). Unanswered last questions have
    no row. One running count of questions and conclusions in global order;
    the next conclusion is an equi-join on the conclusion count."""
    counted = checkpointed(  # read twice below
        running_sums(
            nodes.select(
                "investigation_id", "seq", "id", "kind",
                (F.col("kind") == QUESTION).cast("long").alias("_isq"),
                (F.col("kind") == CONCLUSION).cast("long").alias("_isc"),
            ),
            _order(),
            ["_isq", "_isc"],
        )
    )
    concl = counted.where(F.col("kind") == CONCLUSION).select(
        F.col("cum__isc").alias("_ck"),
        F.col("id").alias("conclusion_id"),
        F.col("seq").alias("conclusion_seq"),
        F.col("investigation_id").alias("_cinv"),
        F.col("cum__isq").alias("_cq"),
    )
    qs = counted.where(F.col("kind") == QUESTION).select(
        "investigation_id", F.col("id").alias("question_id"), F.col("seq").alias("question_seq"),
        (F.col("cum__isc") + 1).alias("_next"), F.col("cum__isq").alias("_qq"),
    )
    paired = qs.join(concl, F.col("_next") == F.col("_ck")).where(F.col("_cinv").eqNullSafe(F.col("investigation_id")))
    return paired.select(
        "investigation_id", "question_id", "question_seq", "conclusion_id", "conclusion_seq",
        (F.col("_qq") == F.col("_cq")).alias("own_turn"),
    )


# --------------------------------------------------------------------------- G3
def last_turns(pairs: DataFrame, k: int = VERBATIM_TURNS) -> DataFrame:
    """The k most recent question -> conclusion pairs per investigation (by
    question seq), with ``recency`` 1 = latest."""
    ranked = partition_row_numbers(
        pairs, ["investigation_id"], [F.col("question_seq").desc(), F.col("question_id").desc()], "recency"
    )
    return ranked.where(F.col("recency") <= k).drop("recency_count", "_grn")


def uncovered_turns(pairs: DataFrame, nodes: DataFrame, k: int = VERBATIM_TURNS) -> DataFrame:
    """Turns that have aged out of the last-k window and are not yet covered
    by the investigation's latest summary (conclusion seq > its through_seq)."""
    ranked = partition_row_numbers(
        pairs, ["investigation_id"], [F.col("question_seq").desc(), F.col("question_id").desc()], "recency"
    )
    summaries = (
        nodes.where(F.col("kind") == "summary")
        .groupBy(F.col("investigation_id").alias("_sinv"))
        .agg(F.max_by(content("through_seq", "long"), F.struct("seq", "id")).alias("through_seq"))
    )
    older = ranked.where(F.col("recency") > k)
    return (
        older.join(summaries, older["investigation_id"].eqNullSafe(summaries["_sinv"]), "left")
        .where(F.col("conclusion_seq") > F.coalesce(F.col("through_seq"), F.lit(0)))
        .select("investigation_id", "question_id", "question_seq", "conclusion_id", "conclusion_seq")
    )


def recent_nodes(nodes: DataFrame, k: int) -> DataFrame:
    """The last k nodes of each investigation by seq (ranked on the keys
    only, then joined back to the node rows)."""
    keys = nodes.select("investigation_id", "seq", "id")
    ranked = partition_row_numbers(keys, ["investigation_id"], [F.col("seq").desc(), F.col("id").desc()], "_recency")
    top = ranked.where(F.col("_recency") <= k).select(F.col("id").alias("_rid"))
    return nodes.join(top, nodes["id"] == top["_rid"], "left_semi")


# --------------------------------------------------------------------------- G4/G5
def _union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


class Forest(NamedTuple):
    nodes: DataFrame  # id, parent_id: every cycle is one node, its smallest member, without a parent
    members: DataFrame | None  # member, root, pos (steps up from root to member), length; None without cycles
    entries: DataFrame | None  # id (hangs below a cycle), entry (the cycle member that is its parent), root


def _doubled(jump: DataFrame) -> DataFrame:
    """From the 2^k-th ancestors (node_id, up) the 2^(k+1)-th."""
    far = jump.select(F.col("node_id").alias("up"), F.col("up").alias("_up2"))
    return jump.join(far, "up").select("node_id", F.col("_up2").alias("up")).transform(checkpointed)


def _pointed_at(jump: DataFrame) -> DataFrame:
    """The jumps of the nodes that a jump ends at."""
    return jump.join(jump.select(F.col("up").alias("node_id")).distinct(), "node_id", "left_semi")


def forest(nodes: DataFrame) -> Forest:
    """The parent links with every cycle folded into one node.

    Doubling the jumps of ever fewer nodes ends when the longest chain is
    passed. Jumps that survive more steps than there are links lie on or below
    a cycle, and point at cycle members: every member is pointed at, since a
    cycle's own jumps permute it; so each round goes on with the nodes that the
    last one's jumps end at, and never with those that have fewer levels below
    them. A cycle is named by its smallest member, and its members are numbered
    by their steps up from that one.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    links = nodes.select(F.col("id").alias("node_id"), F.col("parent_id").alias("up")).where(F.col("up").isNotNull())
    links = links.transform(checkpointed)
    plain = nodes.select("id", "parent_id")
    count, jump, span = links.count(), links, 1
    while span <= count:
        jump = _doubled(checkpointed(_pointed_at(jump)))
        span *= 2
        if jump.isEmpty():
            return Forest(plain, None, None)
    if not count:
        return Forest(plain, None, None)
    on_cycle = jump.select(F.col("up").alias("node_id")).distinct().transform(checkpointed)
    ring = links.join(on_cycle, "node_id").transform(checkpointed)
    size, span, around = on_cycle.count(), 1, ring
    low = ring.select("node_id", F.least("node_id", "up").alias("root")).transform(checkpointed)
    while span < size:
        ahead = low.select(F.col("node_id").alias("up"), F.col("root").alias("_r"))
        low = around.join(ahead, "up").select("node_id", "_r").join(low, "node_id")
        low = low.select("node_id", F.least("root", "_r").alias("root")).transform(checkpointed)
        around = _doubled(around)
        span *= 2
    # a cycle cut above its smallest member is a chain, in which depth counts steps up to it
    cut = ring.join(low, "node_id").select(
        F.col("node_id").alias("id"), F.when(F.col("node_id") != F.col("root"), F.col("up")).alias("parent_id")
    )
    depth = _lift(cut).depth
    placed = low.join(depth, "node_id").select(F.col("node_id").alias("member"), "root", "depth")
    lengths = placed.groupBy("root").agg((F.max("depth") + 1).alias("length"))
    members = (
        placed.join(lengths, "root")
        .select("member", "root", F.pmod(F.col("length") - F.col("depth"), F.col("length")).alias("pos"), "length")
        .transform(checkpointed)
    )
    own, up = members.select(F.col("member").alias("id")), members.select(F.col("member").alias("parent_id"), "root")
    outside = plain.join(own, "id", "left_anti").join(up, "parent_id", "left")
    folded = outside.select("id", F.coalesce("root", "parent_id").alias("parent_id")).unionByName(
        members.where(F.col("member") == F.col("root")).select(F.col("root").alias("id"), F.lit(None).cast(plain.schema["parent_id"].dataType).alias("parent_id"))
    )
    entries = outside.where(F.col("root").isNotNull()).select("id", F.col("parent_id").alias("entry"), "root")
    return Forest(folded.transform(checkpointed), members, entries.transform(checkpointed))


def _around(entry: Column, target: Column, length: Column) -> Column:
    """Steps up a cycle from one position to another."""
    return F.pmod(target - entry, length)


def _closure(nodes: DataFrame) -> DataFrame:
    """(node_id, ancestor_id, depth) of a forest, each node itself included.

    Pointer doubling: after round r every ancestor up to depth 2^r is known;
    the node 2^r levels up then contributes its own known ancestors, so each
    pair is produced exactly once and a chain of length L needs log2(L) rounds.
    Every round writes only its new pairs; earlier rounds are never rewritten.
    """
    first = (
        nodes.select(F.col("id").alias("node_id"), F.col("parent_id").alias("ancestor_id"))
        .where(F.col("ancestor_id").isNotNull())
        .withColumn("depth", F.lit(1).cast("long"))
        .transform(checkpointed)
    )
    frames = [first]
    jump = first.select("node_id", F.col("ancestor_id").alias("jump_id"))  # ancestor at exactly 2^r
    span = 1
    while not jump.isEmpty():
        known = _union_all(frames)
        fresh = (
            jump.join(
                known.select(F.col("node_id").alias("jump_id"), F.col("ancestor_id").alias("_a2"), F.col("depth").alias("_d2")),
                "jump_id",
            )
            .select("node_id", F.col("_a2").alias("ancestor_id"), (F.col("_d2") + F.lit(span)).alias("depth"))
            .transform(checkpointed)
        )
        frames.append(fresh)
        jump = fresh.where(F.col("depth") == 2 * span).select("node_id", F.col("ancestor_id").alias("jump_id"))
        span *= 2
    selves = nodes.select(F.col("id").alias("node_id"), F.col("id").alias("ancestor_id"), F.lit(0).cast("long").alias("depth"))
    return selves.unionByName(_union_all(frames))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(node_id, ancestor_id, depth) for every node and every node on its
    parent chain, itself included at depth 0, each ancestor once at its least
    depth: a chain that runs into a cycle ends when it has been round it. A
    parent id that names no node is still listed (the chain stops there).

    Each pair is a row, N x depth of them: for "is a an ancestor of b" or a
    node's k-th ancestor use ``lifting``.
    """
    tree = forest(nodes)
    if tree.members is None:
        return _closure(nodes)
    pairs = _closure(tree.nodes)
    m = tree.members
    roots = m.select(F.col("root").alias("ancestor_id")).distinct()
    outside = pairs.join(roots.select(F.col("ancestor_id").alias("node_id")), "node_id", "left_anti")
    below = outside.join(roots, "ancestor_id", "left_anti").select("node_id", "ancestor_id", "depth")
    # the node through which a chain enters its cycle, and at which member
    gates = tree.entries.join(m.select(F.col("member").alias("entry"), F.col("pos").alias("_at")), "entry")
    entered = below.join(gates.select(F.col("id").alias("ancestor_id"), "root", "_at"), "ancestor_id")
    ring = m.select("root", F.col("member").alias("ancestor_id"), "pos", "length")
    into = entered.drop("ancestor_id").join(ring, "root").select(
        "node_id", "ancestor_id", (F.col("depth") + 1 + _around(F.col("_at"), F.col("pos"), F.col("length"))).alias("depth")
    )
    start = m.select("root", F.col("member").alias("node_id"), F.col("pos").alias("_at"))
    within = start.join(ring, "root").select(
        "node_id", "ancestor_id", _around(F.col("_at"), F.col("pos"), F.col("length")).alias("depth")
    )
    return below.unionByName(into).unionByName(within)


class Lifting(NamedTuple):
    jumps: list  # jumps[k]: node_id (that has children), up = ancestor 2^k levels up
    links: DataFrame  # node_id, up = parent, of every node
    inner: DataFrame  # depth, of the nodes that have both a parent and children
    depth: DataFrame  # node_id, depth (length of the parent chain)
    tree: Forest | None = None  # what the tables describe, if cycles had to be folded


def _lift(nodes: DataFrame) -> Lifting:
    """Lifting tables of a forest (id, parent_id). Nodes without children, mostly the
    larger part, are a link away from their parents, and are left out of the jumps."""
    links = nodes.select(F.col("id").alias("node_id"), F.col("parent_id").alias("up")).where(F.col("up").isNotNull())
    links = links.transform(checkpointed)
    jumps = [checkpointed(_pointed_at(links))]
    while not (far := _doubled(jumps[-1])).isEmpty():
        jumps.append(far)
    cur = jumps[0].select("node_id", F.col("node_id").alias("_cur"), F.lit(0).cast("long").alias("depth"))
    for k in reversed(range(len(jumps))):
        step = jumps[k].select(F.col("node_id").alias("_cur"), F.col("up").alias("_nx"))
        cur = (
            cur.join(step, "_cur", "left")
            .select(
                "node_id",
                F.coalesce(F.col("_nx"), F.col("_cur")).alias("_cur"),
                (F.col("depth") + F.when(F.col("_nx").isNotNull(), F.lit(1 << k)).otherwise(F.lit(0))).alias("depth"),
            )
            .transform(checkpointed)
        )
    inner = cur.select("node_id", "depth")
    above = inner.select(F.col("node_id").alias("parent_id"), F.col("depth").alias("_d"))
    below = F.when(F.col("parent_id").isNull(), F.lit(0)).otherwise(F.coalesce("_d", F.lit(0)) + 1).cast("long")
    depth = nodes.select("id", "parent_id").join(above, "parent_id", "left").select(F.col("id").alias("node_id"), below.alias("depth"))
    return Lifting(jumps, links, inner, checkpointed(depth))


def lifting(nodes: DataFrame) -> Lifting:
    """Binary-lifting tables: the 2^k-th ancestor of every node with children for
    each k, and every node's parent and depth. O(N log depth) rows instead of the
    O(N depth) closure; answers "is a an ancestor of b" and "k-th ancestor" with log
    joins. Cycles of parent links are folded into one node each first."""
    tree = forest(nodes)
    return _lift(nodes) if tree.members is None else _lift(tree.nodes)._replace(tree=tree)


def _climbed(pairs: DataFrame, lift: Lifting, node_col: str, k_col: str, out: str) -> DataFrame:
    """``ancestor_at`` for nodes that have children, one join per bit of k."""
    cur = pairs.withColumn("_cur", F.col(node_col))
    for level, table in enumerate(lift.jumps):
        step = table.select(F.col("node_id").alias("_cur"), F.col("up").alias(f"_nx{level}"))
        bit = F.shiftright(F.col(k_col), level).bitwiseAND(F.lit(1)) == 1
        cur = cur.join(step, "_cur", "left").withColumn(
            "_cur", F.when(bit, F.col(f"_nx{level}")).otherwise(F.col("_cur"))
        ).drop(f"_nx{level}")
    too_far = F.shiftright(F.col(k_col), len(lift.jumps)) > 0
    return cur.withColumn(out, F.when(too_far, F.lit(None)).otherwise(F.col("_cur"))).drop("_cur")


def ancestor_at(pairs: DataFrame, lift: Lifting, node_col: str, k_col: str, out: str) -> DataFrame:
    """Add ``out`` = the ``k_col``-th ancestor of ``node_col`` (null when the
    chain is shorter): the parent, which has children, and from there a join per bit."""
    parent = lift.links.select(F.col("node_id").alias("_at"), F.col("up").alias("_up"))
    far = F.col(k_col) > 0
    first = pairs.withColumn("_at", F.col(node_col)).join(parent, "_at", "left")
    first = first.withColumn("_at", F.when(far, F.col("_up")).otherwise(F.col("_at"))).drop("_up")
    first = first.withColumn("_left", F.when(far, F.col(k_col) - 1).otherwise(F.lit(0)))
    return _climbed(first, lift, "_at", "_left", out).drop("_at", "_left")


LOCAL_NODES = 100_000  # of an investigation that one task numbers


def _dealt_by_size(rows: DataFrame, id_col: str, parent_col: str, local_nodes: int) -> tuple[DataFrame, DataFrame | None]:
    """The written ``rows`` (investigation_id, ``id_col``, ``parent_col``, ...) of
    investigations of at most ``local_nodes`` rows with all their links inside, with the
    column ``_group`` that deals them into groups for a task; and the rest (None: there is
    none)."""
    mine = rows.select("investigation_id", F.col(parent_col).alias("_up")).where("_up IS NOT NULL")
    theirs = rows.select(F.col(id_col).alias("_up"), F.col("investigation_id").alias("_of"))
    across = mine.join(theirs, "_up").where(~F.col("investigation_id").eqNullSafe(F.col("_of")))
    across = across.select(F.explode(F.array("investigation_id", "_of")).alias("_far"))
    sizes = rows.groupBy("investigation_id").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > local_nodes).select(F.col("investigation_id").alias("_far"))
    far = checkpointed(across.unionByName(large).distinct())
    groups = max(1, -(-rows.count() // max(1, local_nodes)))
    group = F.pmod(F.xxhash64("investigation_id"), F.lit(groups)).alias("_group")
    if far.isEmpty():
        return rows.select("*", group), None
    same = F.col("investigation_id").eqNullSafe(F.col("_far"))
    return rows.join(far, same, "left_anti").select("*", group), checkpointed(rows.join(far, same, "left_semi"))


def preorder(nodes: DataFrame, local_nodes: int = LOCAL_NODES) -> tuple[DataFrame, DataFrame | None]:
    """(node_id, _group, pre, last, depth) of the nodes of investigations that one task can
    walk, written, and the other nodes (None: there are none): those of larger
    investigations, of links between investigations, and of cycles."""
    plain = checkpointed(nodes.select("investigation_id", "id", F.lit(0).alias("seq"), "parent_id"))
    near, far = _dealt_by_size(plain, "id", "parent_id", local_nodes)
    kind = plain.schema["id"].dataType.simpleString()
    labels = near.groupBy("_group").applyInArrow(intervals_of, f"node_id {kind}, _group long, pre long, last long, depth long, looped boolean")
    labels = checkpointed(labels)
    looped = labels.where("looped").select(F.col("node_id").alias("id"))
    if not looped.isEmpty():
        turning = plain.join(looped, "id", "left_semi")
        far = turning if far is None else far.unionByName(turning)
    return labels.where("NOT looped").drop("looped"), far


def descendants(
    nodes_or_closure: DataFrame, node_id: str, lift: Lifting | None = None, labels: DataFrame | None = None, local_nodes: int = LOCAL_NODES
) -> DataFrame:
    """A node and everything beneath it, with the relative depth.

    From a closure frame (node_id, ancestor_id, depth): a filter. From a nodes frame:
    a range filter on preorder intervals (``labels``, as of ``preorder``, made where they
    are not given) if the node's investigation has them; else every node whose ancestor
    at (its depth - the node's depth) is the node, via binary lifting. Beneath a member
    of a cycle lies all that hangs from the cycle, and the cycle itself."""
    if "ancestor_id" in nodes_or_closure.columns:
        return nodes_or_closure.where(F.col("ancestor_id") == node_id).select(F.col("node_id").alias("id"), "depth")
    if lift is None:
        labels = preorder(nodes_or_closure, local_nodes)[0] if labels is None else labels
        at = labels.where(F.col("node_id") == node_id).first()
        if at is not None:
            beneath = labels.where((F.col("_group") == at["_group"]) & F.col("pre").between(at["pre"], at["last"]))
            return beneath.select(F.col("node_id").alias("id"), (F.col("depth") - at["depth"]).alias("depth"))
    lift = lift or lifting(nodes_or_closure)
    target = None if lift.tree is None else lift.tree.members.where(F.col("member") == node_id).first()
    top = node_id if target is None else target["root"]
    root = checkpointed(lift.depth.where(F.col("node_id") == top).select("node_id", F.col("depth").alias("_d0")))
    cand = lift.inner.crossJoin(F.broadcast(root.select("_d0"))).where(F.col("depth") > F.col("_d0")).select(
        "node_id", (F.col("depth") - F.col("_d0")).alias("rel")
    )
    # of those that have children; all others hang from them, or from the node itself
    hit = _climbed(cand, lift, "node_id", "rel", "_top").where(F.col("_top") == top).select("node_id", "rel")
    if target is None:
        itself = root.select("node_id", F.lit(0).cast("long").alias("rel"))
        above = checkpointed(hit.unionByName(itself)).withColumnRenamed("node_id", "up")
        hanging = lift.links.join(above, "up").select("node_id", (F.col("rel") + 1).alias("rel"))
        return hanging.unionByName(itself).select(F.col("node_id").alias("id"), F.col("rel").alias("depth"))
    # a cycle has no ancestors, so rel is the depth below it: the node before
    # the last step hangs from the member through which the chain enters
    gated = checkpointed(_climbed(hit.withColumn("_k", F.col("rel") - 1), lift, "node_id", "_k", "_gate").drop("_k"))
    direct = lift.tree.entries.where(F.col("root") == top)
    above = gated.join(direct.select(F.col("id").alias("_gate"), "entry"), "_gate")
    above = checkpointed(above.select(F.col("node_id").alias("up"), "rel", "entry"))
    deeper = lift.links.join(above, "up").select("node_id", (F.col("rel") + 1).alias("rel"), "entry")
    hung = direct.select(F.col("id").alias("node_id"), F.lit(1).cast("long").alias("rel"), "entry").unionByName(deeper)
    at = lift.tree.members.select(F.col("member").alias("entry"), "pos", "length")
    steps = _around(F.col("pos"), F.lit(target["pos"]), F.col("length"))
    hanging = hung.join(at, "entry").select(F.col("node_id").alias("id"), (F.col("rel") + steps).alias("depth"))
    ring = lift.tree.members.where(F.col("root") == top)
    return hanging.unionByName(ring.select(F.col("member").alias("id"), steps.alias("depth")))


# --------------------------------------------------------------------------- G6
def _chains(tree: DataFrame) -> DataFrame:
    """(id, chain, pos): the chain of first children a turn lies on, named by
    its first turn, and the steps from there. ``tree``: id, up (null for the
    first turn of a chain). Pointer jumping: log2(chain length) rounds."""
    at = checkpointed(
        tree.select("id", F.coalesce("up", "id").alias("chain"), F.col("up").isNotNull().cast("long").alias("pos"))
    )
    while True:
        far = at.select(F.col("id").alias("chain"), F.col("chain").alias("_c"), F.col("pos").alias("_p"))
        new = checkpointed(at.join(far, "chain").select("id", F.col("_c").alias("chain"), (F.col("pos") + F.col("_p")).alias("pos"), (F.col("_p") > 0).alias("_moved")))
        at = new.drop("_moved")
        if new.where("_moved").isEmpty():
            return at


def _weight_to_end(succ: DataFrame) -> DataFrame:
    """(e, total): the weights of every element of linked lists (e, nxt, w)
    and of all after it. Pointer jumping, one row an element and round."""
    at = checkpointed(succ.select("e", "nxt", F.col("w").cast("long").alias("total")))
    while not at.where(F.col("nxt").isNotNull()).isEmpty():
        far = at.select(F.col("e").alias("nxt"), F.col("nxt").alias("_n"), F.col("total").alias("_t"))
        at = checkpointed(
            at.join(far, "nxt", "left").select("e", F.col("_n").alias("nxt"), (F.col("total") + F.coalesce("_t", F.lit(0))).alias("total"))
        )
    return at.select("e", "total")


def branches(nodes: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """Branch labels of question turns and the branches visible on each.

    A turn's parent turn is the one whose conclusion its question hangs off;
    a turn's conclusion is its latest one. The main thread (0) follows first
    children; every further child of a conclusion (by seq) opens a branch,
    numbered per investigation 1, 2, ... in depth-first order of the turn
    tree (roots and children by seq). A turn shows its own branch and all that
    open beneath it, and these have consecutive numbers. One row a turn:
    investigation_id, question_id, branch, visible_from, visible_to (null if
    none opens beneath), visible (how many).

    Investigations of up to ``local_nodes`` turns are walked depth first, many of them
    in one task; larger ones are numbered by list ranking. A turn that hangs off another
    investigation is a root of its own; a cycle of parent turns is cut at its smallest
    member.
    """
    t = turns(nodes)
    last_concl = (
        t.where((F.col("kind") == CONCLUSION) & F.col("turn_id").isNotNull())
        .groupBy("turn_id")
        .agg(F.max_by("id", F.struct("seq", "id")).alias("parent_id"), F.first("investigation_id").alias("_of"))
        .select("parent_id", "_of", F.col("turn_id").alias("parent_turn"))
    )
    qs = nodes.where(F.col("kind") == QUESTION).select("investigation_id", F.col("id").alias("question_id"), "seq", "parent_id")
    tree = qs.join(last_concl, "parent_id", "left").drop("parent_id")
    tree = tree.withColumn("parent_turn", F.when(F.col("investigation_id").eqNullSafe(F.col("_of")), F.col("parent_turn"))).drop("_of")
    tree = checkpointed(tree)
    near, far = _dealt_by_size(tree, "question_id", "parent_turn", local_nodes)
    kinds = [f"{c} {tree.schema[c].dataType.simpleString()}" for c in ("investigation_id", "question_id")]
    walked = near.groupBy("_group").applyInArrow(branches_of, ", ".join([*kinds, "branch long, visible_from long, visible_to long, visible long"]))
    return walked if far is None else walked.unionByName(_branches_by_ranking(far))


def _branches_by_ranking(tree: DataFrame) -> DataFrame:
    """``branches`` of any number of turns (investigation_id, question_id, seq,
    parent_turn). They are folded into their chains of first children; an Euler tour of
    the chains, ranked as a linked list, numbers the branches and counts those in
    each subtree. Every step has rows in proportion to the turns."""
    folded = forest(tree.select(F.col("question_id").alias("id"), F.col("parent_turn").alias("parent_id")))
    if folded.members is not None:
        cut = folded.members.where("member = root").select(F.col("member").alias("question_id"), F.lit(True).alias("_cut"))
        tree = tree.join(cut, "question_id", "left").withColumn("parent_turn", F.when(F.col("_cut").isNull(), F.col("parent_turn"))).drop("_cut")
    # a question opens a branch unless it is the first child (by seq) of its
    # parent conclusion: one map-side-combined min_by per parent, no sibling sort
    firsts = (
        tree.where(F.col("parent_turn").isNotNull())
        .groupBy("parent_turn")
        .agg(F.min_by("question_id", F.struct("seq", "question_id")).alias("_first"))
    )
    tree = checkpointed(
        join_back(tree, firsts, "parent_turn", "left").withColumn(
            "opens", F.col("parent_turn").isNotNull() & (F.col("question_id") != F.col("_first"))
        )
    )
    placed = _chains(tree.select(F.col("question_id").alias("id"), F.when(~F.col("opens"), F.col("parent_turn")).alias("up")))

    # the chains as a tree: a branch hangs from the chain and position it forks off
    fork = placed.select(F.col("id").alias("parent_turn"), F.col("chain").alias("under"), F.col("pos").alias("fork_pos"))
    heads = tree.where(F.col("opens") | F.col("parent_turn").isNull())
    chains = heads.join(fork, "parent_turn", "left").select(
        "investigation_id", F.col("question_id").alias("chain"), "seq", "opens", "under", "fork_pos"
    )
    # depth-first order: what forks off deeper comes first. Ordered backwards, a
    # lag is the next sibling and the last row the first child
    backwards = [F.col("fork_pos").asc(), F.col("seq").desc(), F.col("chain").desc()]
    chains = checkpointed(ordered_window(chains, ["investigation_id", "under"], backwards, "chain", name="_rn"))
    child = chains.where(F.col("opens") & (F.col("_rn") == F.col("_rn_count"))).select(
        F.col("under").alias("chain"), F.col("chain").alias("_child")
    )
    enter = lambda c: F.concat(F.lit("<"), F.col(c))
    leave = lambda c: F.concat(F.lit(">"), F.col(c))
    down = chains.join(child, "chain", "left").select(
        enter("chain").alias("e"), F.coalesce(enter("_child"), leave("chain")).alias("nxt"), F.col("opens").cast("long").alias("w")
    )
    up = chains.select(leave("chain").alias("e"), F.coalesce(enter("lag1"), leave("under")).alias("nxt"), F.lit(0).cast("long").alias("w"))
    ahead = _weight_to_end(down.unionByName(up))
    since = lambda mark, name: ahead.select(F.col("e").alias("_e"), F.col("total").alias(name)).withColumn("chain", F.substring("_e", 2, 1 << 30)).where(F.col("_e").startswith(mark)).drop("_e")
    ranked = chains.join(since("<", "_in"), "chain").join(since(">", "_out"), "chain")
    totals = ranked.groupBy(F.col("investigation_id").alias("_inv")).agg(F.max("_in").alias("_all"))
    numbered = checkpointed(
        ranked.join(totals, F.col("investigation_id").eqNullSafe(F.col("_inv"))).select(
            "chain", "under", "fork_pos", "opens",
            F.when(F.col("opens"), F.col("_all") - F.col("_in") + 1).otherwise(0).alias("branch"),
            (F.col("_all") - F.col("_in") + 1 + F.col("opens").cast("long")).alias("_low"),  # of what opens beneath
            (F.col("_in") - F.col("_out")).alias("_size"),
        )
    )

    # branches beneath a turn: sizes of what forks off its chain here or deeper
    forks = numbered.where("opens").groupBy(F.col("under").alias("chain"), F.col("fork_pos").alias("pos")).agg(F.sum("_size").alias("_w"))
    rows = forks.select("chain", "pos", F.lit(0).alias("_kind"), "_w", F.lit(None).cast("string").alias("id")).unionByName(
        placed.select("chain", "pos", F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_w"), "id")
    )
    deepest = [F.col("chain").asc(), F.col("pos").desc(), F.col("_kind").asc(), F.col("id").asc()]
    summed = checkpointed(running_sums(rows, deepest, ["_w"]))
    begins = summed.groupBy("chain").agg(F.min(F.col("cum__w") - F.col("_w")).alias("_base"))
    beneath = (
        join_back(summed.where("_kind = 1"), begins, "chain")
        .join(numbered.select("chain", "branch", "_low"), "chain")
        .select(F.col("id").alias("question_id"), "branch", "_low", (F.col("cum__w") - F.col("_base")).alias("visible"))
    )
    some = F.col("visible") > 0
    return tree.select("investigation_id", "question_id").join(beneath, "question_id").select(
        "investigation_id",
        "question_id",
        F.col("branch").cast("long").alias("branch"),
        F.when(some, F.col("_low")).alias("visible_from"),
        F.when(some, F.col("_low") + F.col("visible") - 1).alias("visible_to"),
        "visible",
    )


# --------------------------------------------------------------------------- G7-G10
def _active(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("status") == "active")


def hypothesis_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Status of every hypothesis from its incoming *active* edges:
    supports and contradicts -> weakened; only contradicts -> rejected; only
    supports -> supported; neither -> unresolved if tested, else proposed."""
    inc = (
        _active(edges)
        .groupBy(F.col("target_id").alias("id"))
        .agg(
            F.count(F.when(F.col("relationship") == "supports", F.lit(1))).alias("supports"),
            F.count(F.when(F.col("relationship") == "contradicts", F.lit(1))).alias("contradicts"),
            F.count(F.when(F.col("relationship") == "tests", F.lit(1))).alias("tests"),
        )
    )
    hyp = nodes.where(F.col("kind") == HYPOTHESIS).select("id", "investigation_id")
    j = hyp.join(inc, "id", "left").fillna(0, ["supports", "contradicts", "tests"])
    s, c, t = F.col("supports") > 0, F.col("contradicts") > 0, F.col("tests") > 0
    status = (
        F.when(s & c, "weakened").when(c, "rejected").when(s, "supported").when(t, "unresolved").otherwise("proposed")
    )
    return j.select("investigation_id", "id", "supports", "contradicts", "tests", status.alias("status"))


def orphan_conclusions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Conclusions with no active supports edge into them."""
    sup = _active(edges).where(F.col("relationship") == "supports").select(F.col("target_id").alias("id"))
    return nodes.where(F.col("kind") == CONCLUSION).join(sup, "id", "left_anti").select("investigation_id", "id", "seq")


def untested_hypotheses(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Hypotheses with no active tests edge into them."""
    tested = _active(edges).where(F.col("relationship") == "tests").select(F.col("target_id").alias("id"))
    return nodes.where(F.col("kind") == HYPOTHESIS).join(tested, "id", "left_anti").select("investigation_id", "id", "seq")


def open_hypotheses(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Hypotheses whose derived status is still proposed or unresolved."""
    return hypothesis_status(nodes, edges).where(F.col("status").isin("proposed", "unresolved"))


def shared_evidence(nodes: DataFrame, edges: DataFrame, lift: Lifting | None = None, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """Evidence nodes that actively support two or more conclusions which are
    not on one ancestor line (divergent branches).

    No pairs are built: a source's conclusions lie on one line exactly when
    each is an ancestor-or-self of the deepest one. Investigations of up to
    ``local_nodes`` nodes get preorder intervals, so that is a range test on the row
    itself; elsewhere a conclusion is compared with the deepest one's ancestor (depth
    difference) levels up, by binary lifting.
    """
    concl = nodes.where(F.col("kind") == CONCLUSION).select(F.col("id").alias("target_id"))
    sup = _active(edges).where(F.col("relationship") == "supports").join(concl, "target_id")
    sup = checkpointed(sup.select("investigation_id", "source_id", "target_id").distinct())
    if lift is not None:
        return _off_line_by_lifting(sup, lift)
    labels, far = preorder(nodes, local_nodes)
    placed = checkpointed(sup.join(labels.withColumnRenamed("node_id", "target_id"), "target_id", "left"))
    # a source is judged by intervals if all its conclusions have one
    per = placed.groupBy("source_id").agg(
        F.countDistinct("target_id").alias("conclusions"),
        F.count_if(F.col("pre").isNull()).alias("_unlabelled"),
        F.max_by(F.struct("_group", "pre"), F.struct("depth", "target_id")).alias("_deep"),
    )
    both = join_back(placed, per.where("conclusions >= 2"), "source_id")
    on_line = F.expr("_group = _deep._group AND _deep.pre BETWEEN pre AND last")
    off = both.where(F.col("_unlabelled") == 0).where(~on_line)
    near = off.groupBy("investigation_id", F.col("source_id").alias("id")).agg(F.max("conclusions").alias("conclusions"))
    if far is None:
        return near
    rest = sup.join(both.where("_unlabelled > 0").select("source_id").distinct(), "source_id", "left_semi")
    return near.unionByName(_off_line_by_lifting(rest, lifting(nodes)))


def _off_line_by_lifting(sup: DataFrame, lift: Lifting) -> DataFrame:
    """``shared_evidence`` of (investigation_id, source_id, target_id) by lifting tables."""
    sup = sup.withColumn("conclusion_id", F.col("target_id"))
    if lift.tree is not None:  # the members of a cycle are one place on the line
        place = lift.tree.members.select(F.col("member").alias("target_id"), F.col("root").alias("_root"))
        sup = sup.join(place, "target_id", "left").withColumn("target_id", F.coalesce("_root", "target_id")).drop("_root")
    d = lift.depth.select(F.col("node_id").alias("target_id"), F.col("depth").alias("node_depth"))
    with_d = checkpointed(sup.join(d, "target_id", "left").fillna(0, ["node_depth"]))
    deepest = with_d.groupBy("source_id").agg(
        F.max_by(F.struct(F.col("target_id").alias("t"), F.col("node_depth").alias("dd")), F.struct("node_depth", "target_id")).alias("_deep"),
        F.countDistinct("conclusion_id").alias("targets"),
    )
    cand = join_back(with_d, deepest.where(F.col("targets") >= 2), "source_id").select(
        "investigation_id", "source_id", "target_id", "targets", F.col("_deep.t").alias("deep_id"),
        (F.col("_deep.dd") - F.col("node_depth")).alias("gap"),
    )
    looked = ancestor_at(cand, lift, "deep_id", "gap", "_anc")
    off_line = looked.where(F.col("_anc").isNull() | (F.col("_anc") != F.col("target_id")))
    return (
        off_line.groupBy("investigation_id", "source_id")
        .agg(F.max("targets").alias("conclusions"))
        .select("investigation_id", F.col("source_id").alias("id"), "conclusions")
    )


# --------------------------------------------------------------------------- G11
def metric_drift(nodes: DataFrame) -> DataFrame:
    """Metric names defined more than one way (distinct trimmed SQL) within
    an investigation, with every node id that defines them."""
    m = nodes.where(F.col("kind") == METRIC).select(
        "investigation_id", "id", content("name").alias("name"), F.trim(content("sql")).alias("sql")
    )
    drifted = (
        m.groupBy("investigation_id", "name")
        .agg(F.countDistinct("sql").alias("definitions"))
        .where(F.col("definitions") > 1)
    )
    return join_back(m, drifted, ["investigation_id", "name"]).select("investigation_id", "name", "definitions", "id", "sql")


# --------------------------------------------------------------------------- G13
def plan_edges(plans: DataFrame, results: DataFrame) -> DataFrame:
    """depends_on edges from planned step dependencies: for each step with a
    result node and each step it depends on that also has one, an edge from
    the step's result to the dependency's result (created by the narrator).

    plans: investigation_id, plan_id, steps array<struct<id, depends_on array<string>>>
    results: investigation_id, plan_id, step_id, node_id
    """
    steps = plans.select("investigation_id", "plan_id", F.explode("steps").alias("s")).select(
        "investigation_id", "plan_id", F.col("s.id").alias("step_id"), F.explode_outer("s.depends_on").alias("dep")
    ).where(F.col("dep").isNotNull())
    src = results.select("investigation_id", "plan_id", "step_id", F.col("node_id").alias("source_id"))
    dst = results.select(
        "investigation_id", "plan_id", F.col("step_id").alias("dep"), F.col("node_id").alias("target_id")
    )
    return (
        steps.join(src, ["investigation_id", "plan_id", "step_id"])
        .join(dst, ["investigation_id", "plan_id", "dep"])
        .select(
            "investigation_id", "source_id", "target_id",
            F.lit("depends_on").alias("relationship"), F.lit("narrator").alias("created_by"),
        )
        .distinct()
    )


# --------------------------------------------------------------------------- G14
def lint_turns(nodes: DataFrame) -> DataFrame:
    """Rule-based lint of every turn that has a conclusion; one row per
    (turn, check) with status ok/warn:
    groundedness - steps were planned but no table/tool result exists;
    step_errors - the turn has error nodes;
    causal_claim - causal wording without any statistical-test tool result;
    confidence_calibration - 'high' confidence on <= 1 result or with errors;
    truncation - a table result reached the row cap.
    A turn's conclusion is its latest one (by seq)."""
    # one parse of a payload; fields come as the text that stands there
    payload = F.from_json("content_json", "steps string, tool string, row_count string, summary string, confidence string")
    t = turns(nodes).where(F.col("turn_id").isNotNull()).withColumn("_p", payload)
    kind, field = F.col("kind"), lambda name: F.col(f"_p.{name}")
    per = t.groupBy("investigation_id", "turn_id").agg(
        F.coalesce(F.sum(F.when(kind == "plan", F.json_array_length(field("steps")))), F.lit(0)).alias("planned"),
        F.count(F.when(kind.isin("table_result", "tool_result"), F.lit(1))).alias("evidence"),
        F.count(F.when(kind == "error", F.lit(1))).alias("errors"),
        F.count(F.when((kind == "tool_result") & field("tool").isin(*TEST_TOOLS), F.lit(1))).alias("tests"),
        F.count(F.when((kind == "table_result") & (field("row_count").try_cast("long") >= ROW_CAP), F.lit(1))).alias("capped"),
        F.max_by(
            F.struct(F.col("id").alias("cid"), field("summary").alias("summary"), field("confidence").alias("confidence")),
            F.when(kind == CONCLUSION, F.struct("seq", "id")),
        ).alias("c"),
    ).where(F.col("c").isNotNull())
    causal = F.coalesce(F.col("c.summary"), F.lit("")).rlike(CAUSAL_PATTERN)
    checks = F.array(
        F.struct(F.lit("groundedness").alias("rule"),
                 F.when((F.col("planned") > 0) & (F.col("evidence") == 0), "warn").otherwise("ok").alias("status")),
        F.struct(F.lit("step_errors").alias("rule"),
                 F.when(F.col("errors") > 0, "warn").otherwise("ok").alias("status")),
        F.struct(F.lit("causal_claim").alias("rule"),
                 F.when(causal & (F.col("tests") == 0), "warn").otherwise("ok").alias("status")),
        F.struct(F.lit("confidence_calibration").alias("rule"),
                 F.when((F.col("c.confidence") == "high") & ((F.col("evidence") <= 1) | (F.col("errors") > 0)), "warn")
                 .otherwise("ok").alias("status")),
        F.struct(F.lit("truncation").alias("rule"),
                 F.when(F.col("capped") > 0, "warn").otherwise("ok").alias("status")),
    )
    return per.select(
        "investigation_id", "turn_id", F.col("c.cid").alias("conclusion_id"), "planned", "evidence", "errors",
        F.explode(checks).alias("k"),
    ).select("investigation_id", "turn_id", "conclusion_id", "planned", "evidence", "errors", "k.rule", "k.status")


# --------------------------------------------------------------------------- G15
def evidence_chain(nodes: DataFrame) -> DataFrame:
    """Per turn: each SQL step with the table it produced (the table whose
    parent is the query), each tool result, each chart. One row per link:
    investigation_id, turn_id, step_kind, step_id, result_id."""
    t = turns(nodes).where(F.col("turn_id").isNotNull())
    sql = t.where(F.col("kind") == "sql_query").select("investigation_id", "turn_id", F.col("id").alias("step_id"))
    # one table per query: the latest, as a lookup by parent keeps the last one
    tables = (
        t.where(F.col("kind") == "table_result")
        .groupBy(F.col("turn_id").alias("_tt"), F.col("parent_id").alias("step_id"))
        .agg(F.max_by("id", F.struct("seq", "id")).alias("result_id"))
    )
    sql_rows = (
        sql.join(tables, (sql["step_id"] == tables["step_id"]) & (sql["turn_id"] == tables["_tt"]), "left")
        .select("investigation_id", "turn_id", F.lit("sql").alias("step_kind"), sql["step_id"], "result_id")
    )
    tool_rows = t.where(F.col("kind") == "tool_result").select(
        "investigation_id", "turn_id", F.lit("tool").alias("step_kind"), F.col("id").alias("step_id"),
        F.col("id").alias("result_id"),
    )
    chart_rows = t.where(F.col("kind") == "chart").select(
        "investigation_id", "turn_id", F.lit("chart").alias("step_kind"), F.col("id").alias("step_id"),
        content("source_node_id").alias("result_id"),
    )
    return sql_rows.unionByName(tool_rows).unionByName(chart_rows)


# --------------------------------------------------------------------------- G16
def claim_evidence(nodes: DataFrame, edges: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Each conclusion with each node that actively supports it (long form:
    one row per link, so a heavily supported claim is never gathered into
    one list), both ends inside ``scope`` (a frame with an ``id`` column)
    when given. Conclusions without support get one row with null evidence."""
    n = nodes if scope is None else nodes.join(scope.select("id").distinct(), "id", "left_semi")
    concl = n.where(F.col("kind") == CONCLUSION).select("investigation_id", F.col("id").alias("conclusion_id"))
    ids = n.select(F.col("id").alias("evidence_id"), F.col("kind").alias("evidence_kind"))
    sup = _active(edges).where(F.col("relationship") == "supports").select(
        F.col("target_id").alias("conclusion_id"), F.col("source_id").alias("evidence_id")
    ).join(ids, "evidence_id")
    return concl.join(sup, "conclusion_id", "left").select("investigation_id", "conclusion_id", "evidence_id", "evidence_kind")


def semantic_edges(nodes: DataFrame, edges: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """alternative_to / contradicts / supersedes / refines edges whose both
    ends are in scope (all nodes when no scope is given)."""
    n = nodes if scope is None else nodes.join(scope.select("id").distinct(), "id", "left_semi")
    ids = n.select("id")
    e = edges.where(F.col("relationship").isin(*SEMANTIC_EDGES))
    return (
        e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
        .join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        .select("investigation_id", "id", "source_id", "target_id", "relationship", "status")
    )


# --------------------------------------------------------------------------- G17
def by_prefix(nodes: DataFrame, investigation_id: str, prefix: str) -> DataFrame:
    """Nodes of an investigation whose id starts with a typed prefix."""
    return nodes.where((F.col("investigation_id") == investigation_id) & F.col("id").startswith(prefix))


def children(nodes: DataFrame, parent_ids: Sequence[str] | DataFrame) -> DataFrame:
    """Direct children of the given node(s)."""
    if isinstance(parent_ids, DataFrame):
        return nodes.join(parent_ids.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return nodes.where(F.col("parent_id").isin(*list(parent_ids)))
