import gzip
import hashlib
from collections import Counter
from pathlib import Path

import pytest

from tickloom.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    long, other = "<p>" + "é" * 600, "y" * 1000
    rows = [(1, "http://a/x", long), (2, "http://a/y", long), (3, None, long), (4, "u", "short"), (5, "u", "short"), (6, "a b\r\nWARC-Type: evil", other), (7, "u", None), (None, "u", other), (8, "u", "x" * 999), (9, "u", "x" * 999), (3, None, long)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string").repartition(3).persist()
    yield frame
    frame.unpersist()


def test_digest_matches_plain_version(pages):
    rows, want = pages.collect(), Counter()
    for r in rows:
        b = (r["html"] or "").encode()
        want[(r["page_id"], len(b), hashlib.sha1(b).hexdigest())] += 1
    got = warc.warc_digest(pages).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == want
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == Counter({(1, "revisit", 3): 1, (2, "revisit", 3): 1, (3, "response", None): 1, (3, "revisit", 3): 1, (4, "response", None): 1, (5, "response", None): 1, (6, "response", None): 1, (7, "response", None): 1, (None, "revisit", 6): 1, (8, "response", None): 1, (9, "response", None): 1})


def records_of(folder):
    for f in Path(folder).glob("part-*"):
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length"))
            assert rest[size : size + 4] == b"\r\n\r\n"
            yield head, rest[:size]
            data = rest[size + 4 :]


def test_files_are_warc_and_round_trip(spark, pages, tmp_path):
    path = warc.write_archive(pages.selectExpr("page_id AS key", "url", "CAST(html AS BINARY) AS payload"), str(tmp_path / "a"))
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    warc.write_warc_files(spark, path, str(tmp_path / "w"))
    found = list(records_of(tmp_path / "w"))
    assert len(found) == pages.count()
    assert Counter(b"WARC-Type: revisit" in h for h, _ in found)[True] == 4
    assert all(h.count(b"\r\nWARC-Type:") == 1 for h, _ in found)
    bodies = Counter(b.partition(b"\r\n\r\n")[2] for h, b in found if b"WARC-Type: response" in h)
    assert bodies[b"short"] == 2 and bodies[b"y" * 1000] == 1


def test_damage_is_noticed(spark, tmp_path, pages):
    path = warc.write_archive(pages.selectExpr("page_id AS key", "url", "CAST(html AS BINARY) AS payload"), str(tmp_path / "b"))
    spark.read.parquet(f"{path}/payloads").selectExpr("digest", "CAST('bad' AS BINARY) AS payload").write.parquet(f"{tmp_path}/c/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{tmp_path}/c/headers")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archive(spark, f"{tmp_path}/c").collect()


def test_empty_table(spark):
    assert warc.warc_digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
