"""Archives read back, frame by frame, against the pages that went in."""

import base64
import hashlib
import io
import os
from collections import defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from postlab.llm import warc
from tests.llm.fixture import CLASHING


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}?ü=\r\nX: y", text) for i, text in enumerate(
        [None, "", "a", "b", "a", "é" * 5000, "a", None, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "x" * 300000, "b" * 40])]
    rows += [(4, None, "a"), (None, "u", "a"), (None, "u", "only"), (10, "u", "b" * 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.repartition(3).select("*", *[F.lit(5).alias(c) for c in CLASHING])


def expected(rows, least=0):
    first = defaultdict(list)
    for page_id, html in rows:
        first[html or ""].append(page_id)
    found = []
    for page_id, html in rows:
        data = (html or "").encode()
        known = [i for i in first[html or ""] if i is not None]
        original = min(known) if known and len(data) >= least else page_id
        refers = original if original != page_id else None
        found.append((
            str(page_id), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
            "revisit" if refers is not None else "response", str(refers), None if refers is not None else data))
    return sorted(found, key=repr)


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, pages, least):
    folder, index = warc.write_archives(pages, revisit_bytes=least, frame_bytes=300, bundle_bytes=1000)
    rows = warc.read_records(folder, index).collect()
    got = sorted((
        (str(None if r.id is None else int(r.id)), r.payload_bytes, r.payload_digest, r.record_type,
         str(None if r.refers_to is None else int(r.refers_to)), None if r.payload is None else bytes(r.payload))
        for r in rows), key=repr)
    assert got == expected([(r.page_id, r.html) for r in pages.collect()], least)
    assert index.select("bundle").distinct().count() > 1


def test_part_of_an_index(spark, pages):
    folder, index = warc.write_archives(pages)
    rows = warc.read_records(folder, index.where("id IN ('5', '9')")).collect()
    assert sorted((r.id, r.payload_bytes) for r in rows) == [("5", 10000), ("9", 300000)]


def test_bundles_are_plain_zstandard_and_warc(spark, pages):
    folder, index = warc.write_archives(pages, frame_bytes=300)
    path = folder.removeprefix("file:")
    for name in (r.bundle for r in index.select("bundle").distinct().collect()):
        with open(os.path.join(path, name), "rb") as file:
            plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file.read()), read_across_frames=True).read()
        reader = warc.BundleReader(folder, name)
        assert b"".join(reader.frame(i) for i in range(len(reader.frames))) == plain
        at = {(r.frame, r.offset): r.length for r in index.where(F.col("bundle") == name).collect()}
        assert sum(at.values()) == len(plain) and plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n")
        assert max(frame for frame, _ in at) + 1 == len(reader.frames)


def test_damage_is_found():
    record = warc.build_record("1", "u", b"abc", False, None, "1970-01-01T00:00:00Z")
    assert warc.parse_record(record).payload == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"abc", b"abd"))


def test_empty_table(spark, pages):
    assert warc.read_records(*warc.write_archives(pages.limit(0))).collect() == []
