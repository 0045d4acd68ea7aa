"""WARC archives: round trip, and what is left of damaged ones."""

from __future__ import annotations

import base64
import glob
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from adspark.llm import warc
from adspark.llm.queries import QUERIES, SQL
from tests.check_catalog import compare, duck

ROWS = [(1, "http://a/é\r\nx", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, ""), (4, "u", None), (None, "n", "only"), (5, "v", "only"), (5, "v", "only"), (6, "w", "WARC/1.1\r\n\r\n\x00" * 9)]


def expected(rows):
    newest = {}
    for page, _, html in rows:
        data = (html or "").encode()
        newest[data] = max(newest.get(data, -1), -1 if page is None else page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        full = page == newest[data]
        out.append((page, len(data), digest, "response" if full else "revisit", None if full else f"<urn:page:{newest[data]}>"))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc"))
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("size", F.lit("clash")).repartition(2)
    manifest = warc.write_archives(pages, f"file://{folder}", file_bytes=1500)
    return folder, manifest


def test_round_trip(spark, archives):
    _, manifest = archives
    got = warc.read_archives(manifest).collect()
    assert sorted([(warc.page_of(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == expected(ROWS)
    assert sum(r["records"] for r in manifest.collect()) == len(ROWS) and manifest.count() > 1
    payloads = {r["payload"].decode() for r in got if r["record_type"] == "response"}
    assert payloads == {h or "" for _, _, h in ROWS}


def test_members_are_plain_gzip(archives):
    folder, _ = archives
    for path in glob.glob(f"{folder}/*.warc.gz"):
        text = gzip.open(path).read()
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/none")).collect() == []


def members(n=8, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        payload = bytes(rng.choice(b"abc WARC/1.\x1f\x8b\x08") for _ in range(rng.randint(0, 4000)))
        out.append(warc.record_bytes(i, "u", payload, len(payload), warc._digest(payload), None, "1970-01-01T00:00:00Z"))
    return out


def salvaged(data):
    ids, gaps = [], []
    for x in warc.salvage(io.BytesIO(data), len(data)):
        if x[0] == "record":
            ids.append(warc.page_of(x[3]["warc-record-id"]))
        else:
            gaps.append(x[1:3])
    return ids, gaps


@pytest.mark.parametrize("packed", [True, False])
def test_damage(packed):
    raw = members()
    parts = [gzip.compress(m, mtime=0) for m in raw] if packed else raw
    starts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
    whole = b"".join(parts)
    assert salvaged(whole) == (list(range(8)), [])
    # a flipped byte costs its record only, and the gap is that record
    for victim in (0, 3, 7):
        at = starts[victim] + len(parts[victim]) // 2
        broken = whole[:at] + bytes([whole[at] ^ 0x55]) + whole[at + 1 :]
        ids, gaps = salvaged(broken)
        assert ids == [i for i in range(8) if i != victim]
        assert gaps == [(starts[victim], len(parts[victim]))]
    # bytes lost across a boundary cost both neighbours
    ids, gaps = salvaged(whole[: starts[2] - 5] + whole[starts[2] + 9 :])
    assert ids == [0, 3, 4, 5, 6, 7] and len(gaps) == 1
    # a cut end, and junk between members and at either end
    ids, gaps = salvaged(whole[: starts[7] + 20])
    assert ids == list(range(7)) and gaps == [(starts[7], 20)]
    junk = b"\x1f\x8b\x08junk WARC/1.x"
    ids, gaps = salvaged(junk + whole[: starts[4]] + junk * 3 + whole[starts[4] :] + junk)
    assert ids == list(range(8)) and [n for _, n in gaps] == [len(junk), 3 * len(junk), len(junk)]
    assert salvaged(b"") == ([], [])


def test_several_records_in_a_member():
    raw = members(3)
    assert salvaged(gzip.compress(b"".join(raw), mtime=0)) == ([0, 1, 2], [])


@pytest.mark.parametrize("level", [0, 6])
def test_damage_within_a_member(level):
    raw = members(6)
    starts = [sum(map(len, raw[:i])) for i in range(7)]
    content = b"".join(raw)
    pack = lambda data: gzip.compress(data, level, mtime=0)
    before, after = pack(raw[0].replace(b"page:0>", b"page:90>")), pack(raw[1].replace(b"page:1>", b"page:91>"))
    # a record that was damaged before it was packed costs itself only, whichever it is
    for victim in range(6):
        at = starts[victim] + len(raw[victim]) - 6
        broken = pack(content[:at] + bytes([content[at] ^ 0x55]) + content[at + 1 :])
        ids, gaps = salvaged(before + broken + after)
        assert ids == [90, *[i for i in range(6) if i != victim], 91] and gaps == [(len(before), len(broken))]
    # junk between records
    ids, gaps = salvaged(pack(content[: starts[3]] + b"junk" + content[starts[3] :]))
    assert ids == list(range(6)) and len(gaps) == 1
    # a cut end keeps what came before it, once, and the records of the members around
    whole = pack(content)
    for cut in (9, len(whole) // 2):
        ids, gaps = salvaged(before + whole[:-cut] + after)
        inner = [i for i in ids if i < 90]
        assert ids[0] == 90 and ids[-1] == 91 and inner == list(range(len(inner))) and len(inner) >= (1 if cut > 9 else 5)
        assert gaps and sum(n for _, n in gaps) <= len(whole)
    # a flipped byte in the middle: only records that hold are given, each once
    at = len(whole) // 2
    ids, _ = salvaged(before + whole[:at] + bytes([whole[at] ^ 0x55]) + whole[at + 1 :] + after)
    assert ids[0] == 90 and ids[-1] == 91 and len(set(ids)) == len(ids) >= 3


def test_gaps_are_rows(spark, tmp_path):
    parts = [gzip.compress(m, mtime=0) for m in members(3)]
    (tmp_path / "x.warc.gz").write_bytes(parts[0] + parts[1][:-9] + parts[2])
    rows = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz",)], "path string")).collect()
    gap = [r for r in rows if r["gap"]]
    assert len(rows) == 3 and [(r["offset"], r["length"]) for r in gap] == [(len(parts[0]), len(parts[1]) - 9)]


def test_twin(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(QUERIES["op3_warc"](spark, folder), duck(folder), SQL["op3_warc"]) is None
