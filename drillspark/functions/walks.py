"""Depth-first walks of whole investigations inside a task.

For groups of bounded size only: who calls them deals investigations out by size.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle

# executors get these functions with the job and need not import the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Walk:
    """Depth-first walks over the forests of a group of investigations."""

    def __init__(self, table: pa.Table, id_col: str, parent_col: str):
        self.ids, parents, seqs = (table[c].to_pylist() for c in (id_col, parent_col, "seq"))
        at = {x: i for i, x in enumerate(self.ids)}
        self.up = [at.get(p, -1) if p is not None else -1 for p in parents]
        self.in_cycle = self._cut_cycles()
        order = sorted(range(len(self.ids)), key=lambda i: (seqs[i] is not None, seqs[i] or 0, self.ids[i]))
        self.children: list[list[int]] = [[] for _ in self.ids]
        self.roots: dict[str | None, list[int]] = {}
        of = table["investigation_id"].to_pylist()
        for i in order:
            if self.up[i] >= 0:
                self.children[self.up[i]].append(i)
            else:
                self.roots.setdefault(of[i], []).append(i)

    def _cut_cycles(self) -> set[int]:
        """Cut every cycle above its smallest member; the members of all cycles."""
        seen, members = [0] * len(self.ids), set()
        for start in range(len(self.ids)):
            path, i = [], start
            while i >= 0 and not seen[i]:
                seen[i] = start + 1
                path.append(i)
                i = self.up[i]
            if i >= 0 and seen[i] == start + 1:
                ring = path[path.index(i) :]
                members.update(ring)
                self.up[min(ring, key=lambda k: self.ids[k])] = -1
        return members

    def steps(self, roots: list[int]):
        """(node, True) on the way in and (node, False) on the way out."""
        todo = [(r, True) for r in reversed(roots)]
        while todo:
            node, going_in = todo.pop()
            yield node, going_in
            if going_in:
                todo.append((node, False))
                todo += [(c, True) for c in reversed(self.children[node])]


def branches_of(table: pa.Table) -> pa.Table:
    """Branch numbers of whole investigations, as of ``evidence.branches``."""
    walk = Walk(table, "question_id", "parent_turn")
    n = len(walk.ids)
    branch, entered, visible = [0] * n, [0] * n, [0] * n
    for roots in walk.roots.values():
        opened = 0
        for i, going_in in walk.steps(roots):
            if not going_in:
                visible[i] = opened - entered[i]
                continue
            up = walk.up[i]
            if up >= 0 and walk.children[up][0] != i:
                opened += 1
                branch[i] = opened
            elif up >= 0:
                branch[i] = branch[up]
            entered[i] = opened
    some = [v > 0 for v in visible]
    return pa.table({
        "investigation_id": table["investigation_id"], "question_id": table["question_id"], "branch": pa.array(branch, pa.int64()),
        "visible_from": pa.array([e + 1 if s else None for e, s in zip(entered, some)], pa.int64()),
        "visible_to": pa.array([e + v if s else None for e, v, s in zip(entered, visible, some)], pa.int64()),
        "visible": pa.array(visible, pa.int64()),
    })


def intervals_of(table: pa.Table) -> pa.Table:
    """Preorder intervals of whole investigations: a node is an ancestor of, or the same
    as, another one if that one's ``pre`` lies in its ``pre`` to ``last``. ``depth`` counts
    the links above it; ``looped`` says that an investigation has a cycle."""
    walk = Walk(table, "id", "parent_id")
    n = len(walk.ids)
    pre, last, depth = [0] * n, [0] * n, [0] * n
    count = 0
    for roots in walk.roots.values():
        for i, going_in in walk.steps(roots):
            if going_in:
                pre[i], depth[i] = count, depth[walk.up[i]] + 1 if walk.up[i] >= 0 else 0
                count += 1
            else:
                last[i] = count - 1
    of = table["investigation_id"].to_pylist()
    loops = {of[i] for i in walk.in_cycle}
    made = {"pre": pre, "last": last, "depth": depth}
    out = {"node_id": table["id"], "_group": table["_group"]} | {k: pa.array(v, pa.int64()) for k, v in made.items()}
    return pa.table(out | {"looped": pa.array([x in loops for x in of], pa.bool_())})
