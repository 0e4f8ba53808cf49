from __future__ import annotations

import hashlib
import io
import os
import struct
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from drillspark.llm import queries as q
from drillspark.llm import warc

LONG = "<html>" + "seven more words of the same page " * 40 + "</html>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")


ROWS = [
    (1, "http://a.example/x y?%20", LONG, "mine"),
    (5, None, LONG, None),
    (3, "http://b.example/\r\nX: 1", LONG, None),
    (7, "http://c.example/é", "short", None),
    (8, "", "short", None),
    (9, "u", None, None),
    (10, "u", "", None),
    (11, "u", "é" * 600, None),
    (12, "u", "é" * 600, None),
    (13, "u", "x" * 3_000_000, None),
    (14, "u", "body with\r\n\r\nblank lines " * 50, None),
]


def expected(rows):
    out = {}
    for pid, url, html, _ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, _ in rows if (h or "") == (html or "")]
        owner = max(same) if len(data) >= 1000 and max(same) != pid else None
        out[pid] = (url, len(data), hashlib.sha1(data).hexdigest(), "revisit" if owner else "response", owner and str(owner))
    return out


@pytest.mark.parametrize("bundle_bytes", [2_000, 16 << 20])
def test_round_trip(spark, tmp_path, bundle_bytes):
    path = str(tmp_path / "w")
    warc.write_bundles(pages(spark, ROWS), path, frame_bytes=3000, bundle_bytes=bundle_bytes)
    got = {int(r.record_id): r for r in warc.read_bundles(spark, path).collect()}
    want = expected(ROWS)
    assert {i: (r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for i, r in got.items()} == want
    for pid, _, html, _ in ROWS:
        if want[pid][3] == "response":
            assert bytes(got[pid].payload) == (html or "").encode()
    index = {r.record_id: r for r in warc.read_index(spark, path).collect()}
    assert {k: (r.frame, r.frame_offset, r.record_bytes) for k, r in index.items()} == {
        r.record_id: (r.frame, r.frame_offset, r.record_bytes) for r in got.values()
    }


def test_files_are_valid_zstd_streams_with_independent_frames(spark, tmp_path):
    path = tmp_path / "w"
    warc.write_bundles(pages(spark, ROWS), str(path), frame_bytes=3000)
    for file in path.glob("part-*"):
        data = file.read_bytes()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        frames = warc.seek_table(data)
        parts = [zstandard.ZstdDecompressor().decompress(data[a : a + n]) for a, n, plain in frames if plain]
        assert b"".join(parts) == whole and whole.startswith(b"WARC/1.1\r\n")
        assert [len(p) for p in parts] == [plain for _, _, plain in frames if plain]
        # the footer: a skippable frame that ends in the seekable magic number
        (count,) = struct.unpack("<I", data[-9:-5])
        at = len(data) - 9 - 8 * count - 8
        assert struct.unpack("<II", data[at : at + 8]) == (0x184D2A5E, 9 + 8 * count)
        for record_id, *_ in warc.record_index(data):
            assert warc.read_one(data, record_id)[0]["record_id"] == record_id


def test_damage_is_noticed():
    bundle = warc.Bundle(100, 3)
    bundle.add("1", warc.record_bytes("1", "u", b"abc", hashlib.sha1(b"abd").hexdigest(), None))
    data = bundle.finish()
    with pytest.raises(ValueError, match="digest"):
        warc.read_one(data, "1")
    with pytest.raises(ValueError, match="seek table"):
        warc.seek_table(data[:-1])


def test_repeated_rows_null_ids_and_hot_payload(spark, tmp_path):
    rows = [(i, "u", LONG, None) for i in range(300)] + [(299, "u", LONG, None), (None, "u", LONG, None), (None, None, LONG + "!", None)]
    path = str(tmp_path / "w")
    warc.write_bundles(pages(spark, rows), path)
    got = warc.read_bundles(spark, path).collect()
    assert len(got) == len(rows)
    assert sorted(r.record_id for r in got if r.record_type == "response") == ["299", "299", "null"]
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {"299"}


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_bundles(pages(spark, ROWS).limit(0), path)
    assert warc.read_bundles(spark, path).count() == 0 and warc.read_index(spark, path).count() == 0


def test_query_keeps_null_page_id(spark, tmp_path):
    spark.createDataFrame([(None, None, None), (2, "u", "x")], "page_id long, url string, html string").write.parquet(
        str(Path(tmp_path) / "pages.parquet")
    )
    out = q.QUERIES["op3_warc_bundles"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type) for r in out) == [(0, 0, "response"), (2, 1, "response")]


def test_many_empty_pages_are_written_by_several_tasks(spark, tmp_path):
    """Headers count, too: 100,000 empty pages are more than one bundle. Columns with the
    names of the record's fields do not matter."""
    pages = spark.range(100_000).select(
        F.col("id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"),
        F.lit("x").alias("payload_digest"), F.lit(7).alias("refers_to"), F.lit(b"y").alias("payload"),
    )
    path = str(tmp_path / "w")
    warc.write_bundles(pages, path)
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) >= 3
    got = warc.read_bundles(spark, path, with_payload=False)
    assert got.count() == 100_000 and got.where("record_type = 'response' AND payload_bytes = 0 AND refers_to IS NULL").count() == 100_000
    empty = str(tmp_path / "e")
    warc.write_bundles(pages.limit(0), empty)
    assert warc.read_bundles(spark, empty).count() == 0
