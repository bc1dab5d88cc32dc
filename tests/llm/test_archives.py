from __future__ import annotations

import base64
import gzip
import hashlib

import pytest

from emberline.llm import archives, queries


def test_against_sql(agrees):
    agrees(queries.op6_warc, queries.ORACLES["op6_warc"], "sf0.01")


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_by_version(version):
    content = b"HTTP/1.0 200 OK\r\nX-Page-Id: 7\r\n\r\n<p>\n\nb</p>\n"
    data = archives.arc_head(version, "n.arc", "19990101120000") + archives.arc_record(version, "http://a/b c", "19990102", content, "n.arc", 0) + archives.arc_record(version, "http://x/", "20000101000000", b"", "n.arc", 9)
    for d in (data, gzip.compress(data)):
        info, a, b = archives.parse_arc(d)
        assert info["type"] == "filedesc" and info["url"] == "filedesc://n.arc"
        assert (a["url"], a["date"], a["type"], a["content"]) == ("http://a/b c", "19990102", "text/html", content)
        assert b["content"] == b"" and b["url"] == "http://x/"
    with pytest.raises(ValueError):
        list(archives.parse_arc(data[:-20]))


def test_unknown_versions_are_refused():
    with pytest.raises(ValueError):
        list(archives.parse_arc(archives.arc_head(1, "n", "1999").replace(b"1 0 emberline", b"9 0 emberline") + b"u i d t 0\n\n"))


def test_warc_dates_and_ids():
    assert archives.warc_date("19990102") == "1999-01-02T00:00:00Z"
    assert archives.warc_date("19990102030405") == "1999-01-02T03:04:05Z"
    assert archives.record_id(1, "d", "u") == archives.record_id(1, "d", "u") != archives.record_id(2, "d", "u")


def test_pages(spark):
    rows = [(3, "http://a/", "same"), (1, "http://b c\n/", "same"), (2, None, "same"), (4, "http://d/", None), (5, "http://e/", ""), (6, "http://f/", "é\r\n\r\nWARC/1.0\r\n\r\n"), (None, "http://g/", "same"), (None, "http://h/", "lone"), (1, "http://b/", "same"), (7, "http://i/", "x" * 5_000_000)]
    pages = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, content string, digest string").repartition(3)
    arc = archives.pages_to_arc(pages)
    read = archives.read_warc(archives.convert(arc), with_payload=True).collect()
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in read), key=str)
    assert got == sorted([(3, "revisit", 1, 4), (1, "response", None, 4), (1, "response", None, 4), (2, "revisit", 1, 4), (4, "response", None, 0), (5, "revisit", 4, 0), (6, "response", None, 18), (None, "revisit", 1, 4), (None, "response", None, 4), (7, "response", None, 5_000_000)], key=str)
    by = {r["page_id"]: r for r in read}
    assert by[6]["payload"] == "é\r\n\r\nWARC/1.0\r\n\r\n".encode() and by[2]["url"] == "about:blank" and by[1]["url"].startswith("http://b")
    assert by[6]["payload_digest"] == base64.b32encode(hashlib.sha1(by[6]["payload"]).digest()).decode()
    assert by[3]["payload"] == b"" and by[3]["date"] == "2024-01-01T00:00:00Z"


def test_small_payloads_are_no_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in archives.page_records(pages, min_bytes=3).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.page_records(pages).count() == 0


def test_plain_warc_is_read_too():
    record = archives.warc_record("response", [("WARC-Record-ID", "<x>"), ("WARC-Date", None)], b"abc")
    assert list(archives.parse_warc(record + record)) == [({"warc-type": "response", "warc-record-id": "<x>", "content-length": "3"}, b"abc")] * 2


def warc_heads(warc):
    return [h for r in warc.collect() for h, _ in archives.parse_warc(r["warc"])]


def test_revisits_refer_to_records_and_identifiers_are_unique(spark):
    rows = [(i % 5, f"http://x/{i}", "same" if i % 2 else f"own {i}") for i in range(20)] + [(1, "http://x/1", "same")] * 3
    arc = archives.pages_to_arc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).persist()
    heads = warc_heads(archives.convert(arc))
    assert heads == warc_heads(archives.convert(arc))
    infos = [h for h in heads if h["warc-type"] == "warcinfo"]
    records = {h["warc-record-id"]: h for h in heads if h["warc-type"] != "warcinfo"}
    assert len(records) == 23 and len(infos) == 4 and {h["warc-warcinfo-id"] for h in records.values()} == {h["warc-record-id"] for h in infos}
    revisits = [h for h in records.values() if h["warc-type"] == "revisit"]
    assert revisits
    for h in revisits:
        to = records[h["warc-refers-to"]]
        assert to["warc-type"] == "response" and to["x-page-id"] == h["x-refers-to-page"] and to["warc-payload-digest"] == h["warc-payload-digest"]
        assert (h["warc-refers-to-target-uri"], h["warc-refers-to-date"]) == (to["warc-target-uri"], to["warc-date"])
    assert sum("x-arc-checksum" in h for h in records.values()) > 5  # of version 2
    versions = {r["arc"].split(b"\n")[1][:1] for r in arc.collect()}
    assert versions == {b"1", b"2"}


def test_fields_of_old_records_are_kept(spark):
    data = archives.arc_head(2, "old.arc", "1997") + b"http://a/ 10.1.2.3 19970203040506 image/gif 404 abc - 99 old.arc 3\nGIF\n"
    (head,) = [h for h in warc_heads(archives.convert(spark.createDataFrame([(data,)], "arc binary"))) if h["warc-type"] == "resource"]
    assert (head["warc-ip-address"], head["x-arc-result-code"], head["x-arc-checksum"], head["content-type"], head["warc-date"]) == ("10.1.2.3", "404", "abc", "image/gif", "1997-02-03T04:05:06Z")


@pytest.mark.parametrize("fault", [b"broken line\n", b"http://a/ 0 1999 text/html -5\n", b"no end of line", b"http://a/ 0.0.0.0 1999 text/html 50\nshort"])
def test_malformed_archives(spark, fault):
    good = archives.arc_head(1, "n.arc", "1999") + archives.arc_record(1, "http://a/", "1999", b"abc", "n.arc", 0)
    table = spark.createDataFrame([(good + fault,), (good,), (None,), (b"",)], "arc binary")
    assert len([h for h in warc_heads(archives.convert(table, strict=False)) if h["warc-type"] == "resource"]) == 2
    assert archives.arc_records(table, strict=False).where("type = 'error'").count() == 1
    with pytest.raises(ValueError):
        list(archives.parse_arc(good + fault))


def test_ids_must_be_numbers(spark):
    with pytest.raises(TypeError):
        archives.page_records(spark.createDataFrame([("a", "u", "h")], "page_id string, url string, html string"))


def test_records_are_the_same_whether_payloads_are_broadcast_or_shuffled(spark, monkeypatch):
    rows = [(i, f"http://x/{i}", f"page {i % 7}" if i % 3 else f"own {i}") for i in range(200)]
    arc = archives.pages_to_arc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).persist()
    by = lambda heads: sorted(sorted(h.items()) for h in heads)
    broadcast = by(warc_heads(archives.convert(arc)))
    monkeypatch.setattr(archives, "small", lambda df, *_: df.hint("merge"))
    shuffled = warc_heads(archives.convert(arc))
    assert by(shuffled) == broadcast
    infos = {h["warc-record-id"] for h in shuffled if h["warc-type"] == "warcinfo"}
    assert infos and all(h["warc-warcinfo-id"] in infos for h in shuffled if h["warc-type"] != "warcinfo")
