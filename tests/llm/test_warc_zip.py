"""WARC records in ZIP packages: round trips, directories, and odd pages."""

import hashlib
import io
import zipfile

import pytest

from corpuscle.llm import common, warc_zip

LONG = "<p>" + "same page " * 20 + "</p>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "http://a/", LONG), (3, "http://b/ x", LONG), (9, None, LONG), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", "é" * 50), (8, "ü", "é" * 50), (10, "u", "x" * 3_000_000), (3, "again", LONG), (None, "no id", LONG), (11, "u", "\r\n\r\nWARC/1.1\r\n\r\n")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("page_id", "page_id").selectExpr("*", "1 as digest", "'x' as payload", "0 as refers_to")


def expected(rows):
    first = {}
    for r in rows:
        data = (r.html or "").encode()
        if len(data) >= 100 and r.page_id is not None:
            first[data] = min(first.get(data, r.page_id), r.page_id)
    out = []
    for r in rows:
        data = (r.html or "").encode()
        to = first.get(data)
        to = None if to == r.page_id else to
        out.append((str(r.page_id), len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def shown(rows):
    return sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


def test_round_trip(spark, pages):
    assert shown(warc_zip.round_trip(spark, pages).collect()) == expected(pages.collect())


def test_round_trip_of_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    packages = warc_zip.write(pages, common.fresh_dir(spark, "warc"))
    got = warc_zip.read(packages).collect()
    assert shown(got) == expected(pages.collect())
    html = {r.page_id: r.html for r in pages.collect()}
    assert all(r.payload is None if r.record_type == "revisit" else r.payload.decode() == html[r.page_id] for r in got)


def test_ids_of_text(spark):
    names = ["none", "a:b", "<x> é", "10", "9", "", "a%3Ab", "new\nline", None]
    rows = [(n, f"u{k}", LONG if k % 2 else f"{LONG} {k}") for k, n in enumerate(names)] + [("10", "again", LONG)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    assert shown(warc_zip.round_trip(spark, pages).collect()) == expected(pages.collect())


@pytest.mark.parametrize("share", [1, 10_000])
def test_hot_payloads_and_repeated_ids(spark, monkeypatch, share):
    """Payloads that very many pages share, with and without ids, beside empty ones and others."""
    monkeypatch.setattr(warc_zip, "HOT_SHARE", share)
    rows = [(k if k % 3 else None, f"u{k % 5}", LONG) for k in range(300)] + [(None, "v", LONG + "!") for _ in range(200)]
    rows += [(7, "w", "") for _ in range(300)] + [(500 + k // 2, "x", f"{LONG} {k // 4}") for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(6)
    assert shown(warc_zip.round_trip(spark, pages).collect()) == expected(pages.collect())


def test_revisits_of_what_is_not_there(spark):
    kinds = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long"
    rows = [(1, "response", "d", 200, None), (2, "revisit", "d", 200, 1), (3, "revisit", "e", 200, 1), (4, "revisit", "d", 201, 1), (5, "revisit", "d", 200, 9), (6, "revisit", "d", 200, 9)]
    wrong = warc_zip.unfounded(spark.createDataFrame(rows, kinds)).collect()
    assert sorted((r.refers_to, r.payload_digest, r.payload_bytes) for r in wrong) == [(1, "d", 201), (1, "e", 200), (9, "d", 200)]


def test_many_members(spark, pages, monkeypatch):
    monkeypatch.setattr(warc_zip, "MEMBER_BYTES", 300)
    out = io.BytesIO()
    package = warc_zip.Package(out)
    data = [(k, f"http://h/{k % 3}", bytes([k]) * 200, None) for k in range(50)]
    for x in data:
        package.add(*x)
    package.close()
    found = warc_zip.members(out, len(out.getvalue()))
    assert sum(m.name.startswith(warc_zip.ARCHIVE) for m in found) > 10
    with zipfile.ZipFile(out) as z:
        for m in found:
            assert out.getvalue()[m.offset : m.offset + m.size] == z.read(m.name)


@pytest.mark.parametrize("limit", [None, 10])
def test_directories_with_zip64_and_comments(limit, monkeypatch):
    if limit:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    out = io.BytesIO(b"")
    out.write(b"before the archive? no")
    out.seek(0)
    with zipfile.ZipFile(out, "w") as z:
        for k in range(5):
            z.writestr(zipfile.ZipInfo(f"é{k}.warc"), b"data %d" % k * 9)
        z.writestr("deflated", b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.writestr("folder/", b"")
        z.comment = b"PK\x05\x06 is no end record here"
    size = len(out.getvalue())
    found = warc_zip.members(out, size)
    assert [m.name for m in found] == [f"é{k}.warc" for k in range(5)]
    assert [out.getvalue()[m.offset : m.offset + m.size] for m in found] == [b"data %d" % k * 9 for k in range(5)]
    with pytest.raises(ValueError):
        warc_zip.members(io.BytesIO(b"nothing"), 7)


def test_empty(spark, pages):
    assert warc_zip.round_trip(spark, pages.where("false")).count() == 0
