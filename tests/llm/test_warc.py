"""WARC: round trips, revisits, determinism."""

import base64
import glob
import hashlib

import pytest

from weftline.llm import warc
from weftline.llm.common import shared_dir

SCHEMA = "page_id long, url string, html string, digest string"


def brute(rows):
    heads = {}
    for i, _, html, _ in rows:
        if i is not None:
            heads[html or ""] = min(i, heads.get(html or "", i))
    out = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        head = heads.get(html or "")
        again = head is not None and i != head
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", head if again else None))
    return out


def rows_of(n):
    rows = [(k * 5 - 30, f"http://x/{k}\n", ["<p>é</p>", "", None, f"page {k}", "long " * 3000][k % 5], "clash") for k in range(n)]
    return [*rows, (None, None, "page 3", "c"), (5, "u", "same id", "c"), (5, "u", "same id", "c")] if n else []


@pytest.mark.parametrize("n", [0, 1, 80])
def test_against_brute_force(spark, n):
    rows = rows_of(n)
    folder = shared_dir(spark, "warc-test")
    manifest = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, file_bytes=2000)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_back(spark, folder, manifest).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    assert manifest.count() >= (5 if n > 1 else n)


def test_same_bytes_however_dealt(spark):
    rows = rows_of(60)
    found = []
    for parts in (1, 5):
        folder = shared_dir(spark, "warc-test")
        warc.write(spark.createDataFrame(rows[:: 1 if parts == 1 else -1], SCHEMA).repartition(parts), folder, file_bytes=3000)
        found.append({p.rsplit("/", 1)[1]: open(p, "rb").read() for p in glob.glob(f"{folder}/*.warc.gz")})
    assert found[0] == found[1] and len(found[0]) > 3


def test_small_payloads_are_not_revisited(spark):
    folder = shared_dir(spark, "warc-test")
    manifest = warc.write(spark.createDataFrame([(k, "u", "tiny", "d") for k in range(4)], SCHEMA), folder, min_revisit_bytes=100)
    assert {r.record_type for r in warc.read_back(spark, folder, manifest).collect()} == {"response"}
