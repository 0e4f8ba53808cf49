from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from drillspark.session import build_session

    scratch = tempfile.mkdtemp(prefix="drillspark-tests-")
    # workers start in this folder, without the repository on their path: what
    # a task needs must travel with the job
    os.chdir(scratch)
    os.environ["PYTHONPATH"] = os.pathsep.join(
        p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT
    )
    s = build_session(
        "local[4]",
        shuffle_partitions=4,
        app_name="drillspark-tests",
        conf={"spark.checkpoint.dir": f"{scratch}/ckpt", "spark.local.dir": f"{scratch}/local"},
    )
    yield s
    s.stop()


@pytest.fixture()
def scratch_dir():
    return tempfile.mkdtemp(prefix="drillspark-t-")


def rows(df, *cols):
    """Collected rows as tuples (sorted), for comparisons."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
