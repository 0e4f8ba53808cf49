"""Workers have only what travels with a job."""

from __future__ import annotations


def test_workers_cannot_import_the_package(spark):
    """The premise of every other test here: the package is on the driver's path alone."""

    def found(batches):
        import importlib.util

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"found": [importlib.util.find_spec("drillspark") is not None]})

    assert [r.found for r in spark.range(1).mapInArrow(found, "found boolean").collect()] == [False]
