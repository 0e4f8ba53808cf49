"""Chat formatting by minimum-cost role repair.

A legal conversation is a path of an automaton over the role of the last turn:
an optional system turn, then user and assistant in turn, ending with the
assistant. Each given turn is kept, relabelled or merged into the turn before
it, and empty turns may be inserted before it or at the end; the repair is the
cheapest such path. Equal costs are settled turn by turn from the start: keep
before merge before relabel, fewer insertions first, then role order, so the
repair of a conversation is one definite sequence.

A turn acts on the four states as a min-plus matrix, and these multiply
associatively. A conversation is cut into segments of at most
``SEGMENT_TURNS`` turns; segments are combined ``2**FAN_BITS`` at a time, level
by level, so a conversation that holds a third of all rows is worked on by many
tasks and no group is unbounded: costs to the end travel down the levels, then
the states in which segments begin. Conversations of one segment skip that.

Rendering gives each turn's own piece of the text: concatenated in the order of
``position`` the pieces are the whole conversation. A piece that opens a turn
closes the one before it.

Defined cases: turns are ordered by turn number (null last), role, text hash; a
null conversation id is a conversation; a null or unknown role has no label to
keep and takes one at ``UNKNOWN_COST``; a null text is empty; repeated rows are
turns of their own. Result columns replace those of the same name.
"""

from __future__ import annotations

import itertools
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROLES = ("system", "user", "assistant")
START = 3  # a state besides the roles; as a given role: unknown
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
ACCEPT = (2,)
# costs in tenths
MERGE_COST, RELABEL_COST, UNKNOWN_COST, INSERT_COST = 6, 10, 5, 12
NEVER = 10**9
SEGMENT_BITS = 12
SEGMENT_TURNS = 1 << SEGMENT_BITS
FAN_BITS = 10
KEEP, MERGE, RELABEL = "keep", "merge", "relabel"
OPEN, CLOSE, JOIN = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"


@dataclass(frozen=True)
class Option:
    """What can be done with a turn: empty turns of roles ``inserted``, then
    the turn itself as ``role``; ``cost`` in all."""

    inserted: tuple[int, ...]
    action: str
    role: int
    cost: int


def insertions(state: int) -> dict[int, tuple[int, ...]]:
    """The shortest empty turns that lead from a state to each state."""
    found, edge = {state: ()}, [state]
    while edge:
        near = []
        for s in edge:
            for r in NEXT[s]:
                if r not in found:
                    found[r] = (*found[s], r)
                    near.append(r)
        edge = near
    return found


def options(state: int, given: int) -> list[Option]:
    """All ways to take a turn of role ``given`` in a state, in the order of
    preference among equal costs."""
    out = []
    for at, inserted in insertions(state).items():
        cost = INSERT_COST * len(inserted)
        for r in NEXT[at]:
            if r == given:
                out.append(Option(inserted, KEEP, r, cost))
            else:
                out.append(Option(inserted, RELABEL, r, cost + (UNKNOWN_COST if given == START else RELABEL_COST)))
        if at == state != START:  # into an inserted turn would cost more than to be that turn
            other = 0 if at == given else UNKNOWN_COST if given == START else RELABEL_COST
            out.append(Option((), MERGE, at, MERGE_COST + other))
    return sorted(out, key=lambda o: ((KEEP, MERGE, RELABEL).index(o.action), len(o.inserted), o.inserted, o.role))


def ending(state: int) -> tuple[int, ...]:
    """The empty turns that bring a conversation to its end."""
    ways = insertions(state)
    return min((ways[a] for a in ACCEPT if a in ways), key=lambda w: (len(w), w))


TABLE = {(s, g): options(s, g) for s in range(4) for g in range(4)}
MOST = max(map(len, TABLE.values()))
COST = np.full((4, 4, MOST), NEVER, np.int64)  # by state, given role, option
AFTER = np.zeros((4, 4, MOST), np.int64)
GROWS = np.zeros((4, 4, MOST), np.int64)  # turns that an option adds
STEP = np.full((4, 4, 4), NEVER, np.int64)  # by given role: state to state
for (_s, _g), _o in TABLE.items():
    for _k, _x in enumerate(_o):
        COST[_s, _g, _k], AFTER[_s, _g, _k] = _x.cost, _x.role
        GROWS[_s, _g, _k] = len(_x.inserted) + (_x.action != MERGE)
        STEP[_g, _s, _x.role] = min(STEP[_g, _s, _x.role], _x.cost)
LAST = np.array([INSERT_COST * len(ending(s)) for s in range(4)], np.int64)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus products of two stacks of 4 x 4 matrices."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), NEVER)


def _padded(roles: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Role numbers by segment and turn, and the segments' lengths."""
    sizes = np.array([len(r) for r in roles], np.int64)
    out = np.zeros((len(roles), max(1, sizes.max(initial=0))), np.int64)
    for i, r in enumerate(roles):
        out[i, : len(r)] = np.frombuffer(r, np.uint8)
    return out, sizes


def products(roles: list[bytes]) -> np.ndarray:
    """The matrix of each segment."""
    given, sizes = _padded(roles)
    out = np.full((len(roles), 4, 4), NEVER, np.int64)
    out[:, range(4), range(4)] = 0
    for k in range(given.shape[1]):
        on = np.flatnonzero(sizes > k)
        out[on] = times(out[on], STEP[given[on, k]])
    return out


def walk(roles: list[bytes], to_go: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For segments whose ends cost ``to_go`` (segment, state) more: by segment
    and entry state the exit state, the turns added, and the option of every
    turn (segment, turn, entry state)."""
    given, sizes = _padded(roles)
    n, width = given.shape
    costs = np.zeros((width + 1, n, 4), np.int64)
    costs[sizes, np.arange(n)] = to_go
    for k in range(width - 1, -1, -1):
        on = np.flatnonzero(sizes > k)
        ahead = costs[k + 1, on][:, None, :]
        costs[k, on] = np.minimum((STEP[given[on, k]] + ahead).min(axis=2), NEVER)
    state = np.tile(np.arange(4), (n, 1))
    grown, chosen = np.zeros((n, 4), np.int64), np.zeros((n, width, 4), np.int8)
    for k in range(width):
        on = np.flatnonzero(sizes > k)
        g, s = given[on, k][:, None], state[on]
        total = COST[s, g] + np.take_along_axis(costs[k + 1, on][:, None, :], AFTER[s, g].reshape(len(on), 1, -1), 2).reshape(len(on), 4, MOST)
        pick = total.argmin(axis=2)  # the first of equal totals
        chosen[on, k] = pick
        grown[on] += np.take_along_axis(GROWS[s, g], pick[..., None], 2)[..., 0]
        state[on] = np.take_along_axis(AFTER[s, g], pick[..., None], 2)[..., 0]
    return state, grown, chosen


def _ints(a: np.ndarray) -> pa.Array:
    """One list of longs a row."""
    flat = np.ascontiguousarray(a, np.int64).reshape(len(a), -1)
    return pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.int64()))


def _table(column, *shape: int) -> np.ndarray:
    return np.array(column.to_pylist(), np.int64).reshape(-1, *shape)


def _combined(level: DataFrame) -> DataFrame:
    """(conv, key, m): the products of groups of neighbouring keys, in order."""

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        total = None
        for m in _table(rows["m"], 4, 4):
            total = m if total is None else times(total, m)
        return pa.table({"conv": rows["conv"][:1], "key": rows["up"][:1], "m": _ints(total[None])})

    kind = level.schema["conv"].dataType.simpleString()
    up = level.withColumn("up", F.shiftright("key", FAN_BITS))
    return checkpointed(up.groupBy("conv", "up").applyInArrow(fold, f"conv {kind}, key long, m array<long>"))


def _costs_below(level: DataFrame, above: DataFrame) -> DataFrame:
    """(conv, key, to_go): from each group's cost to go, that of its members."""

    def spread(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "descending")])
        ahead, out = _table(rows["to_go"], 4)[0], []
        for m in _table(rows["m"], 4, 4):
            out.append(ahead)
            ahead = np.minimum((m + ahead[None, :]).min(axis=1), NEVER)
        return pa.table({"conv": rows["conv"], "key": rows["key"], "to_go": _ints(np.array(out))})

    kind = level.schema["conv"].dataType.simpleString()
    groups = above.select(F.col("conv").alias("c"), F.col("key").alias("up"), "to_go")
    up = level.withColumn("up", F.shiftright("key", FAN_BITS))
    joined = up.join(groups, F.col("conv").eqNullSafe(F.col("c")) & (up["up"] == groups["up"])).drop("c", groups["up"])
    return checkpointed(joined.groupBy("conv", "up").applyInArrow(spread, f"conv {kind}, key long, to_go array<long>"))


def _maps_combined(level: DataFrame) -> DataFrame:
    """(conv, key, exit, grown): exit states and added turns of whole groups."""

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        state, grown = np.arange(4), np.zeros(4, np.int64)
        for e, g in zip(_table(rows["exit"], 4), _table(rows["grown"], 4)):
            grown = grown + g[state]
            state = e[state]
        return pa.table({"conv": rows["conv"][:1], "key": rows["up"][:1], "exit": _ints(state[None]), "grown": _ints(grown[None])})

    kind = level.schema["conv"].dataType.simpleString()
    up = level.withColumn("up", F.shiftright("key", FAN_BITS))
    schema = f"conv {kind}, key long, exit array<long>, grown array<long>"
    return checkpointed(up.groupBy("conv", "up").applyInArrow(fold, schema))


def _entries_below(level: DataFrame, above: DataFrame) -> DataFrame:
    """(conv, key, entry, before): the entry state of each member and the turns
    there are before it, from those of its group."""

    def spread(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        state, count, entries, before = rows["entry"][0].as_py(), rows["before"][0].as_py(), [], []
        for e, g in zip(_table(rows["exit"], 4).tolist(), _table(rows["grown"], 4).tolist()):
            entries.append(state)
            before.append(count)
            count += g[state]
            state = e[state]
        return pa.table({"conv": rows["conv"], "key": rows["key"], "entry": pa.array(entries, pa.int64()), "before": pa.array(before, pa.int64())})

    kind = level.schema["conv"].dataType.simpleString()
    groups = above.select(F.col("conv").alias("c"), F.col("key").alias("up"), "entry", "before")
    up = level.withColumn("up", F.shiftright("key", FAN_BITS))
    joined = up.join(groups, F.col("conv").eqNullSafe(F.col("c")) & (up["up"] == groups["up"])).drop("c", groups["up"])
    schema = f"conv {kind}, key long, entry long, before long"
    return checkpointed(joined.groupBy("conv", "up").applyInArrow(spread, schema))


def _is_multi(level: DataFrame) -> bool:
    """Has any conversation more than one row?"""
    return level.groupBy("conv").count().where("count > 1").limit(1).count() > 0


def _with_costs(segments: DataFrame) -> DataFrame:
    """``segments`` (conv, key, roles, many) with ``to_go``: the cost from each
    state at their end to the end of the conversation."""
    last = F.array(*[F.lit(int(x)).cast("long") for x in LAST])
    single = segments.where("NOT many").withColumn("to_go", last)
    many = segments.where("many")

    def multiply(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("conv"), b.column("key"), _ints(products(b.column("roles").to_pylist()).reshape(-1, 16))], ["conv", "key", "m"]
            )

    kind = segments.schema["conv"].dataType.simpleString()
    levels = [checkpointed(many.select("conv", "key", "roles").mapInArrow(multiply, f"conv {kind}, key long, m array<long>"))]
    while _is_multi(levels[-1]):
        levels.append(_combined(levels[-1]))
    to_go = levels[-1].select("conv", "key", last.alias("to_go"))
    for level in levels[-2::-1]:
        to_go = _costs_below(level, to_go)
    found = to_go.select(F.col("conv").alias("c"), F.col("key").alias("k"), "to_go")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))
    return single.unionByName(many.join(found, same).drop("c", "k"))


def _with_entries(segments: DataFrame) -> DataFrame:
    """``segments`` (with ``to_go``) plus ``entry`` and ``before``."""
    first = [F.lit(START).cast("long").alias("entry"), F.lit(0).cast("long").alias("before")]
    single = segments.where("NOT many").select("*", *first)
    many = segments.where("many")

    def maps(batches):
        for b in batches:
            e, g, _ = walk(b.column("roles").to_pylist(), _table(b.column("to_go"), 4))
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("key"), _ints(e), _ints(g)], ["conv", "key", "exit", "grown"])

    kind = segments.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, key long, exit array<long>, grown array<long>"
    levels = [checkpointed(many.select("conv", "key", "roles", "to_go").mapInArrow(maps, schema))]
    while _is_multi(levels[-1]):
        levels.append(_maps_combined(levels[-1]))
    entries = levels[-1].select("conv", "key", *first)
    for level in levels[-2::-1]:
        entries = _entries_below(level, entries)
    found = entries.select(F.col("conv").alias("c"), F.col("key").alias("k"), "entry", "before")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))
    return single.unionByName(many.join(found, same).drop("c", "k"))


def _decide(segments: DataFrame) -> DataFrame:
    """One row a turn: position, out_turn, out_role, action, inserted, cost,
    and the state before it and (at the end) the empty turns after it."""

    def decide(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                roles = part.column("roles").to_pylist()
                _, _, chosen = walk(roles, _table(part.column("to_go"), 4))
                out = []
                for i, (first, state, count, is_last) in enumerate(
                    zip(*(part.column(c).to_pylist() for c in ("first", "entry", "before", "is_last")))
                ):
                    entry = state
                    for k, given in enumerate(roles[i]):
                        o = TABLE[state, given][chosen[i, k, entry]]
                        count += len(o.inserted) + (o.action != MERGE)
                        after = ending(o.role) if is_last and k == len(roles[i]) - 1 else ()
                        out.append((
                            first + k, count - 1, ROLES[o.role], o.action, [ROLES[r] for r in o.inserted],
                            [ROLES[r] for r in after], (o.cost + INSERT_COST * len(after)) / 10, state == START,
                        ))
                        state = o.role
                cols = list(zip(*out)) if out else [[] for _ in range(8)]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], NAMES)

    return segments.select("first", "roles", "to_go", "entry", "before", "is_last").mapInArrow(
        decide,
        "position long, out_turn long, out_role string, action string, inserted array<string>, appended array<string>, cost double, opening boolean",
    )


NAMES = ["position", "out_turn", "out_role", "action", "inserted", "appended", "cost", "opening"]


def repair_roles(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """``turns`` with ``position`` (order of the rows), ``out_turn`` (number of
    the turn in the repaired conversation, from 0), ``out_role``, ``action``,
    ``inserted`` and ``appended`` (roles of empty turns before the turn, and
    after the last), ``cost``, and ``rendered``, the row's piece of the text."""
    results = {"position", "out_turn", "out_role", "action", "inserted", "appended", "cost", "rendered"}
    kept = [c for c in turns.columns if c not in results]
    number = F.lit(START)
    for i, r in enumerate(ROLES):
        number = F.when(F.lower(F.trim(F.col(role_col))) == r, i).otherwise(number)
    # equal rows share their sort key up to here: a last key lets them be split
    order = [
        F.col(conv_col), F.col(turn_col).isNull(), F.col(turn_col), F.col(role_col),
        F.xxhash64(text_col), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)),
    ]
    keyed = turns.select(*kept, *[o.alias(f"__o{i}") for i, o in enumerate(order)])
    keys = [f"__o{i}" for i in range(len(order))]
    dealt = keyed.repartitionByRange(partitions, *keys) if partitions else keyed.repartitionByRange(*keys)
    rows = checkpointed(
        dealt.sortWithinPartitions(*keys).select(
            *kept, number.cast("int").alias("__given"), F.monotonically_increasing_id().alias("position")
        )
    )
    # rows of a conversation in one run of positions: consecutive, SEGMENT_TURNS at most
    segments = rows.groupBy(F.col(conv_col).alias("conv"), F.shiftright("position", SEGMENT_BITS).alias("key")).agg(
        F.min("position").alias("first"), F.sort_array(F.collect_list(F.struct("position", "__given"))).alias("given")
    )
    hexed = F.concat_ws("", F.transform("given", lambda g: F.concat(F.lit("0"), g["__given"].cast("string"))))
    segments = checkpointed(segments.select("conv", "key", "first", F.unhex(hexed).alias("roles")))
    spans = segments.groupBy(F.col("conv").alias("c")).agg(F.max("key").alias("top"), F.count(F.lit(1)).alias("parts"))
    segments = checkpointed(
        segments.join(spans, F.col("conv").eqNullSafe(F.col("c"))).select(
            "conv", "key", "first", "roles", (F.col("parts") > 1).alias("many"), (F.col("key") == F.col("top")).alias("is_last")
        )
    )
    decided = _decide(_with_entries(checkpointed(_with_costs(segments))))
    empty = lambda roles: F.concat_ws("", F.transform(roles, lambda r: F.concat(_opened(r), F.lit(CLOSE))))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    merged = F.col("action") == MERGE
    rendered = F.concat(
        F.when(F.col("opening") | merged, "").otherwise(CLOSE),
        F.when(merged, JOIN).otherwise(F.concat(empty("inserted"), _opened(F.col("out_role")))),
        text,
        F.when(F.col("is_end"), F.concat(F.lit(CLOSE), empty("appended"))).otherwise(""),
    )
    ends = segments.where("is_last").select((F.col("first") + F.length("roles") - 1).alias("__end"))
    joined = rows.join(decided, "position").join(ends, F.col("position") == F.col("__end"), "left")
    joined = joined.withColumn("is_end", F.col("__end").isNotNull())
    return joined.select(
        *kept, "position", "out_turn", "out_role", "action", "inserted", "appended", "cost", rendered.alias("rendered")
    )


def _opened(role):
    before, after = OPEN.split("{}")
    return F.concat(F.lit(before), role, F.lit(after))


def repair_one(given: list[int]) -> tuple[int, list[Option]]:
    """The repair of one short conversation, straight from the definition: the
    cheapest sequence of options, ties settled from the start."""
    best = None
    for picks in itertools.product(range(MOST), repeat=len(given)):
        state, cost, taken = START, 0, []
        for g, p in zip(given, picks):
            if p >= len(TABLE[state, g]):
                break
            taken.append(TABLE[state, g][p])
            cost += taken[-1].cost
            state = taken[-1].role
        else:
            cost += INSERT_COST * len(ending(state))
            if best is None or (cost, picks) < best[:2]:
                best = cost, picks, taken
    return best[0], best[2]
