"""Archives against the pages they were written from."""

from __future__ import annotations

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from hushspan.llm import warc
from tests.llm.helpers import clashing, rows

PAGES = "page_id long, url string, html string"


def plain(given):
    """What the archives of `given` must say, row by row."""
    first = {}
    for page, _, html in given:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(first.get(data, page), page)
    out = []
    for page, _, html in given:
        data = (html or "").encode()
        again = data in first and (page is None or page > first[data])
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response",
                    first[data] if again else None))
    return sorted(out, key=repr)


def archived(spark, folder, table, **sizes):
    warc.write_archives(table, str(folder), **sizes)
    return warc.archived_pages(spark, f"{folder}/archives")


def awkward():
    long = "".join(f"<p>é {i} 😀\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>" for i in range(3000))
    copy = "x" * 100
    return [(1, "http://a/1", "short"), (2, "http://a/2", "short"), (3, None, None), (4, "", ""),
            (5, "http://a/\r\nX: y", long), (6, "http://a/6", long), (6, "http://a/6", long), (9, "u", copy), (8, "u", copy),
            (8, "u", copy), (None, "u", copy), (None, None, "only without an id " * 9), (None, None, None),
            (7, "u", "y" * 99), (10, "u", "y" * 99), (-3, "u", "0\r\n\r\n" * 40), (12, "u", "0\r\n\r\n" * 40)]


@pytest.mark.parametrize("sizes", [{}, {"segment": 200, "archive": 1000}, {"segment": 7000, "archive": 1}])
def test_pages_come_back(spark, tmp_path, sizes):
    given = awkward()
    assert rows(archived(spark, tmp_path / "w", spark.createDataFrame(given, PAGES), **sizes)) == plain(given)


def test_payloads_and_targets_come_back_whole(spark, tmp_path):
    given = awkward()
    warc.write_archives(clashing(spark.createDataFrame(given, PAGES)), str(tmp_path / "w"), segment=500, archive=3000)
    read = warc.read_archives(spark, f"{tmp_path}/w/archives")
    assert {f"{f.name} {f.dataType.simpleString().replace('bigint', 'long')}" for f in read.schema} == set(warc.RECORD.split(", "))
    got = read.collect()
    wanted = sorted(d for (p, _, h) in given for d in [(h or "").encode()])
    revisits = [r for r in got if r.warc_type == "revisit"]
    assert all(r.complete and r.payload is None for r in revisits)
    responses = sorted(bytes(r.payload) for r in got if r.warc_type == "response")
    assert len(responses) + len(revisits) == len(wanted) and set(responses) == set(wanted)
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got if r.payload is not None)
    assert {r.target_uri for r in got} == {"http://a/%0D%0AX: y" if u and "\r" in u else u for _, u, _ in given}


def test_files_are_bounded_and_cut_records_pass_over_their_ends(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(1, "u", "ab" * 50_000)], PAGES), str(tmp_path / "w"), segment=1000, archive=5000)
    files = list((tmp_path / "w" / "archives").glob("part-*"))
    assert len(files) > 10 and max(f.stat().st_size for f in files) < 5000 + 2000
    assert b"".join(f.read_bytes() for f in files).count(b"WARC-Segment-Total-Length") == 1
    assert rows(warc.archived_pages(spark, f"{tmp_path}/w/archives")) == plain([(1, "u", "ab" * 50_000)])


def _archive(tmp_path, *records):
    tmp_path.mkdir(parents=True)
    (tmp_path / "part-0").write_bytes(b"".join(records))
    return str(tmp_path)


def test_lost_segments_wrong_lengths_and_broken_framing_are_told(spark, tmp_path):
    digest = hashlib.sha256(b"z" * 5000).hexdigest()
    made = list(warc.page_records(f"<urn:page:1:{digest}>", "u", b"z" * 5000, digest, None, 1000))
    whole = _archive(tmp_path / "a", *reversed(made))
    lost = _archive(tmp_path / "b", *made[:2], *made[3:])
    unended = _archive(tmp_path / "c", *made[:-1])
    short = _archive(tmp_path / "d", *made[:-1], made[-1].replace(b"Total-Length: ", b"Total-Length: 1"))
    broken = _archive(tmp_path / "e", warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:1:{digest}>")],
                                                  warc._HEAD + b"5\r\nabc"))
    assert [(r.complete, bytes(r.payload)) for r in warc.read_archives(spark, whole).collect()] == [(True, b"z" * 5000)]
    for folder in (lost, unended, short, broken):
        assert [(r.warc_type, r.complete, r.payload) for r in warc.read_archives(spark, folder).collect()] == [("response", False, None)]
        assert [tuple(r) for r in warc.archived_pages(spark, folder).collect()] == [(1, None, None, "response", None)]


def test_framing():
    for data in (b"", b"a", b"a\r\n0\r\n\r\n" * 999, bytes(range(256)) * 99):
        for chunk in (1, 7, 4096):
            assert warc.unchunked(warc.chunked(data, chunk)) == data
    assert warc.unchunked(b"3;name=value\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    assert warc.unchunked(b"A\r\n0123456789\r\n0\r\n\r\n") == b"0123456789"
    for bad in (b"", b"x\r\n", b"3\r\nab", b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"-1\r\n\r\n"):
        assert warc.unchunked(bad) is None
    assert warc.message_payload(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nplain") == b"plain"
    assert warc.message_payload(b"HTTP/1.1 200 OK") is None


def test_a_hot_payload_an_empty_table_and_sql(spark, tmp_path):
    given = [(i, "u", "hot " * 30 if i % 3 else f"page {i} " * 20) for i in range(3000)]
    table = spark.createDataFrame(given, PAGES)
    assert rows(archived(spark, tmp_path / "a", table)) == plain(given)
    assert rows(archived(spark, tmp_path / "b", table.limit(0))) == []
    pages = spark.createDataFrame(given + awkward(), PAGES).toPandas()  # noqa: F841 - read by the SQL
    got = archived(spark, tmp_path / "c", spark.createDataFrame(given + awkward(), PAGES))
    want = duckdb.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.ORACLE})").fetchall()
    assert rows(got) == sorted(want, key=repr)


def test_ids_of_any_kind(spark, tmp_path):
    given = [("a b+c~*%2B:>", "u", "t" * 200), ("z", "u", "t" * 200), ("ü😀", None, "t")]
    warc.write_archives(spark.createDataFrame(given, "page_id string, url string, html string"), str(tmp_path / "w"))
    got = warc.archived_pages(spark, f"{tmp_path}/w/archives", "string").orderBy(F.col("page_id")).collect()
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [
        ("a b+c~*%2B:>", "response", None), ("z", "revisit", "a b+c~*%2B:>"), ("ü😀", "response", None)]
