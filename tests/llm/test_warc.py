"""WARC packages: round trips, packages by Python's zipfile, damage, and range reads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import random
import struct
import zipfile

import pytest

from glossator.llm import warc

PAGE = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(rows, least=0):
    """page_id, bytes, digest, type and refers_to of every row."""
    by, out = {}, []
    for i, url, html in rows:
        by.setdefault(html or "", []).append((i is not None, i or 0, url is not None, url or "", i))
    for payload, pages in by.items():
        pages.sort(key=lambda p: p[:4])
        for k, p in enumerate(reversed(pages)):
            n = len(payload.encode())
            single = k == 0 or n < least
            out.append((p[4], n, digest(payload), "response" if single else "revisit", None if single else pages[-1][4]))
    return sorted(out, key=repr)


ROWS = [
    (1, "https://www.Example.org:8080/a b?q=1", "<p>é</p>"), (2, None, "same"), (3, "http://x.org/\r\nSet: 1", "same"), (4, "", "same"),
    (5, "u", None), (6, "v", ""), (None, "w", "alone"), (None, None, "same"), (7, "http://[bad", "x" * 3_000_000 + "\r\n\r\nWARC/1.1\r\n"),
    (8, "r", "twice"), (8, "r", "twice"), (8, "s", "twice"), (9, "t", "three"), (9, "t", "three"), (-5, "minus", "m"), (1, "u", "other"),
]


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_every_page_comes_back(spark, least):
    df = spark.createDataFrame(ROWS, PAGE).repartition(3).selectExpr("*", "1 AS payload", "2 AS top", "'x' AS salt", "3 AS n")
    assert got(warc.warc_report(df, least=least)) == plain(ROWS, least)


def test_hot_payloads_and_empty_tables(spark):
    r = random.Random(1)
    rows = [(i, f"http://h/{i}", "hot" if i % 3 == 0 else f"p{r.randrange(60)}") for i in range(900)]
    assert got(warc.warc_report(spark.createDataFrame(rows, PAGE).repartition(5))) == plain(rows)
    assert got(warc.warc_report(spark.createDataFrame([], PAGE))) == []


def test_payloads_are_whole_and_revisits_resolved(spark):
    manifest = warc.write_packages(spark.createDataFrame(ROWS, PAGE))
    records = warc.read_packages(manifest)
    assert sorted(r.payload.decode() for r in records.where("record_type = 'response'").collect()) == sorted({h or "" for *_, h in ROWS})
    whole = warc.resolved(records).collect()
    assert sorted((str(r.page_id), bytes(r.payload).decode()) for r in whole) == sorted((str(i), h or "") for i, _, h in ROWS)
    assert len({r.record_id for r in whole}) == len(ROWS)


def test_packages_are_zip_files_with_stored_members(spark, monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE_RECORDS", 4)
    manifest = warc.write_packages(spark.createDataFrame(ROWS, PAGE).coalesce(1)).collect()
    assert len(manifest) >= 4 and sum(m.records for m in manifest) == len(ROWS)
    for m in manifest:
        with zipfile.ZipFile(m.path.removeprefix("file://")) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            raw = z.read(warc.ARCHIVE)
            assert gzip.decompress(raw).count(b"WARC-Record-ID") >= m.records
            told = json.loads(z.read(warc.CONTENTS))["resources"]
            assert [t["hash"] for t in told] == [f"sha256:{hashlib.sha256(z.read(t['path'])).hexdigest()}" for t in told]
            for line in z.read(warc.INDEX).decode().splitlines():
                entry = json.loads(line[line.index("{") :])
                part = raw[int(entry["offset"]) :][: int(entry["length"])]
                assert gzip.decompress(part).startswith(b"WARC/1.1\r\n") and entry["digest"].encode() in gzip.decompress(part)


def record(i, body=b"<p>hi</p>"):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    return warc.block(("response", f"<urn:uuid:{i}>", warc.DATE, "application/http;msgtype=response"), [("WARC-Target-URI", f"http://x/{i}")], http)


def foreign(path, mode="index", n=5, force=False, deflate=None, prefix=b"", comment=b""):
    """A package as other makers write them."""
    records = [record(i, b"b%d" % i * (i + 1)) for i in range(n)]
    plain_archive = mode == "plain"
    parts = records if plain_archive else [gzip.compress(r) for r in records]
    ends = [sum(map(len, parts[:i])) for i in range(n + 1)]
    name = "archive/one.warc" + ("" if plain_archive else ".gz")
    lines = "".join(f'x)/{i} 2000 {json.dumps({"url": f"http://x/{i}", "offset": ends[i], "length": len(parts[i]), "filename": name.split("/")[1]})}\n' for i in range(n))
    held = io.BytesIO()
    held.write(prefix)
    with zipfile.ZipFile(held, "a" if prefix else "w") as z:
        with z.open(zipfile.ZipInfo("empty"), "w"):
            pass
        with z.open(zipfile.ZipInfo(name), "w", force_zip64=force) as f:
            f.write(b"".join(parts))
        if mode == "index":
            z.writestr(zipfile.ZipInfo("indexes/a.cdxj"), lines, compress_type=deflate or zipfile.ZIP_STORED)
        elif mode == "gzipped":
            z.writestr("indexes/a.cdx.gz", gzip.compress(lines[:100].encode()) + gzip.compress(lines[100:].encode()))
        z.comment = comment
    path.write_bytes(held.getvalue())
    return [f"b{i}" * (i + 1) for i in range(n)]


@pytest.mark.parametrize(
    "kinds",
    [{}, {"force": True}, {"deflate": zipfile.ZIP_DEFLATED}, {"mode": "gzipped"}, {"mode": "none"}, {"mode": "plain"}, {"prefix": b"#!/bin/sh\n" * 9}, {"comment": b"PK\x05\x06 and more"}],
)
def test_packages_of_other_makers(tmp_path, kinds):
    expected = foreign(tmp_path / "a.wacz", **kinds)
    reader = warc.PackageReader(str(tmp_path / "a.wacz"))
    found = list(reader.records())
    assert [r["payload"].decode() for r in found] == expected
    assert [r["target_uri"] for r in found] == [f"http://x/{i}" for i in range(5)]


def test_zip64_directories(tmp_path):
    out = warc.PackageWriter(str(tmp_path / "a.wacz"), zip64=True)
    out.add(record(1), "http://x/1", "response", "A")
    out.close()
    raw = (tmp_path / "a.wacz").read_bytes()
    assert struct.pack("<I", warc.END64) in raw
    for prefix in (b"", b"before"):
        (tmp_path / "b.wacz").write_bytes(prefix + raw)
        assert [r["payload"] for r in warc.PackageReader(str(tmp_path / "b.wacz")).records()] == [b"<p>hi</p>"]
    with zipfile.ZipFile(tmp_path / "a.wacz") as z:
        assert z.testzip() is None
    many = tmp_path / "many.zip"
    with zipfile.ZipFile(many, "w") as z:  # more members than the old record can count
        for i in range(65_600):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"")
        z.writestr("archive/x.warc", record(3))
    reader = warc.PackageReader(str(many))
    assert len(reader.members) == 65_601 and [r["target_uri"] for r in reader.records()] == ["http://x/3"]


def test_only_the_ranges_asked_for_are_read(spark, tmp_path):
    r = random.Random(2)
    out = warc.PackageWriter(str(tmp_path / "a.wacz"))
    for i in range(50):
        body = "".join(r.choice("abcdefghij") for _ in range(200_000)).encode()
        out.add(record(i, body), f"http://x/{i}", "response", "A")
    out.close()
    reader = warc.PackageReader(str(tmp_path / "a.wacz"))
    found = list(reader.records([p for p in reader.places() if p.url == "http://x/7"]))
    assert found[0]["target_uri"] == "http://x/7" and reader.bytes_read < 0.1 * out.size()
    manifest = spark.createDataFrame([(str(tmp_path / "a.wacz"),)], "path string")
    assert sorted(x.target_uri for x in warc.lookup_records(manifest, ["http://x/9", "http://x/11", "no"]).collect()) == ["http://x/11", "http://x/9"]


def test_damage_is_found(spark, tmp_path):
    out = warc.PackageWriter(str(tmp_path / "a.wacz"))
    out.add(record(1), "http://x/1", "response", "A")
    out.close()
    raw = (tmp_path / "a.wacz").read_bytes()
    cases = {"cut": raw[:-30], "empty": b"", "text": b"no package at all", "record": raw.replace(raw[400:404], b"\0\0\0\0", 1), "local": b"XX" + raw[2:]}
    for name, data in cases.items():
        (tmp_path / f"{name}.wacz").write_bytes(data)
        manifest = spark.createDataFrame([(str(tmp_path / f"{name}.wacz"),), (str(tmp_path / "a.wacz"),)], "path string")
        rows = warc.read_packages(manifest, strict=False).collect()
        assert [bool(r.error) for r in rows if name in r.path] == [True], name
        assert [r.page_id is None and r.error is None for r in rows if r.path.endswith("/a.wacz")] == [True]
        with pytest.raises(Exception, match="Error"):
            warc.read_packages(manifest).collect()
    with zipfile.ZipFile(tmp_path / "packed.wacz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/x.warc.gz", gzip.compress(record(1)))
    rows = warc.read_packages(spark.createDataFrame([(str(tmp_path / "packed.wacz"),)], "path string"), strict=False).collect()
    assert "no ranges" in rows[0].error


def test_payload_damage_is_told_by_its_digest():
    raw = warc.page_record(warc.record_id(1, "X"), "http://x", warc.DATE, b"abc", 3, digest("abc"), None)
    assert warc.parsed(raw)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parsed(raw.replace(b"abc\r\n", b"abd\r\n"))


def test_a_task_that_runs_again_replaces_its_package(tmp_path):
    for attempt in "01":
        out = warc.PackageWriter(str(tmp_path / "a.wacz"), attempt)
        out.add(record(1), "http://x/1", "response", "A")
        out.close()
    assert [p.name for p in tmp_path.iterdir()] == ["a.wacz"]
