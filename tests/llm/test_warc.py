"""WARC archives and the merged index against brute force."""

import os
import random
from collections import Counter

import pytest
from conftest import SMALL
from whole import table

from contextmill.llm import warc
from contextmill.llm.queries import QUERIES


def brute(pages):
    groups = {}
    for i, (key, _, html) in enumerate(pages):
        groups.setdefault((html or "").encode(), []).append(key)
    out = Counter()
    for payload, keys in groups.items():
        top = max((k for k in keys if k is not None), default=None)
        for k in keys:
            again = k != top
            out[(k, len(payload), warc.sha1(payload), "revisit" if again else "response", top if again else None)] += 1
    return out


def in_order(rows):
    """Positions without gaps, in the order of key, time and id."""
    rows = sorted(rows, key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(len(rows)))
    keys = [(r.url_key, r.timestamp, r.page_id is not None, r.page_id or 0) for r in rows]
    assert keys == sorted(keys)


def test_query(spark):
    rows = QUERIES["op6_warc_index_merge"](spark, SMALL).collect()
    assert Counter(tuple(r)[:5] for r in rows) == brute(table("pages", "page_id", "url", "html"))
    in_order(rows)


PAGES = [
    (1, "http://www.Example.com/a?b=2&a=1#x", "same"), (2, "https://example.com:443/a?a=1&b=2", "same"), (3, None, None), (4, "", ""),
    (5, "not a url\r\nX-Injected: yes", "WARC/1.1\r\n\r\n\r\n"), (6, "http://[bad", "é\r\n\r\n\x00" * 1000), (6, "http://[bad", "é\r\n\r\n\x00" * 1000),
    (None, "http://e.com/n", "same"), (9, "http://e.com/n", "x" * 3_000_000), (10, "http://e.com:8080/n", "x" * 3_000_000),
    (11, "http://e.com/n", "lone"),
]


def test_cases(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    pages = PAGES + [(100 + i, "http://hot.com/", f"page {i % 40}") for i in range(300)]
    spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, row int").repartition(6).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    folder = str(tmp_path / "w")
    captures = warc.write_archives(df, folder)
    assert captures.select("file").distinct().count() > 6
    in_order(warc.merge_index(captures).collect())
    rows = warc.read_archives(captures, folder).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == brute(pages)
    by_id = {p[0]: p for p in pages}
    for r in rows:
        if r.payload is not None:
            assert bytes(r.payload) == (by_id[r.page_id][2] or "").encode()
    # A capture's offset and length lead to its record.
    c = captures.first()
    content = open(f"{folder}/{c.file}", "rb").read()
    (_, _, data), = list(warc.members(content[c.offset : c.offset + c.length]))
    assert warc.read_record(data)[0]["X-Page-ID"] == ("" if c.page_id is None else str(c.page_id))
    empty = warc.write_archives(df.filter("false"), str(tmp_path / "e"))
    assert warc.merge_index(empty).count() == 0 and warc.read_archives(empty, str(tmp_path / "e")).count() == 0


def test_least_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    captures = warc.write_archives(df, str(tmp_path / "w"), least_bytes=3)
    assert {(c.page_id, c.kind) for c in captures.collect()} == {(1, "response"), (2, "response"), (3, "revisit"), (4, "response")}


def test_damage_is_found(spark, tmp_path):
    folder = str(tmp_path / "w")
    captures = warc.write_archives(spark.createDataFrame([(1, "u", "ab" * 99)], "page_id long, url string, html string"), folder)
    name = captures.first().file
    import gzip

    content = gzip.decompress(open(f"{folder}/{name}", "rb").read())
    os.unlink(f"{folder}/.{name}.crc") if os.path.exists(f"{folder}/.{name}.crc") else None
    open(f"{folder}/{name}", "wb").write(gzip.compress(content.replace(b"abab", b"abac")))
    with pytest.raises(Exception, match="damaged record"):
        warc.read_archives(captures, folder).collect()


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 40])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted(r.randrange(50) for _ in range(r.randrange(12))) for _ in range(k)]
    assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_url_keys():
    same = {warc.url_key(u) for u in ("http://www.Example.com/a?b=2&a=1#x", "https://example.com:443/a?a=1&b=2")}
    assert same == {"com,example)/a?a=1&b=2"}
    assert warc.url_key("http://e.com:8080") == "com,e:8080)/" and warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def test_ranges_are_bounded(spark, tmp_path, monkeypatch):
    """Many runs, one URL with most captures: every task merges about the rows it may hold."""
    monkeypatch.setattr(warc, "FILE_BYTES", 1500)
    monkeypatch.setattr(warc, "RANGE_ROWS", 50)
    pages = [(i, "http://hot.com/" if i % 3 else f"http://e{i}.com/", f"page {i}") for i in range(600)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(8).write.parquet(str(tmp_path / "p"))
    captures = warc.write_archives(spark.read.parquet(str(tmp_path / "p")), str(tmp_path / "w"))
    assert captures.select("run").distinct().count() > 50
    index = warc.merge_index(captures)
    in_order(index.collect())
    from pyspark.sql import functions as F

    held = [r["count"] for r in index.groupBy(F.input_file_name()).count().collect()]
    assert len(held) >= 8 and max(held) <= 150


def test_what_files_hold_is_not_broadcast(spark):
    df = QUERIES["op6_warc_index_merge"](spark, SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
