import base64
import hashlib

import pytest

from codestrata.llm import warc
from codestrata.session import Scratch


def rows():
    out = [(i, f"http://{'www.' * (i % 2)}Site{i % 5}.example.com/p/{i % 7}?q={i}#f", f"<p>page {i % 40}</p>" + "x" * (i % 9), "k", 1) for i in range(150)]
    same = [(1000 + i, "https://user@hot.example.org:80/same", "<b>same</b>", None, 2) for i in range(60)]
    odd = [(2000, None, None, None, None), (2001, "no host", "", None, 1), (None, "http://a.b/ c\td", "null id", None, 1), (None, "http://a.b/", "<b>same</b>", None, 1), (2002, "http://ü.de/ö", "größe " * 5000, None, 1), (2003, "", "only", None, 1), (2003, "", "only", None, 1)]
    return out + same + odd


def brute(table):
    largest = {}
    for i, _, html, *_ in table:
        if i is not None:
            largest[html or ""] = max(i, largest.get(html or "", i))
    count = {}
    for _, _, html, *_ in table:
        count[html or ""] = count.get(html or "", 0) + 1
    out = []
    for i, _, html, *_ in table:
        p, owner = (html or "").encode(), largest.get(html or "")
        revisit = count[html or ""] > 1 and owner is not None and owner != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", owner if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_lines", [3, 1000])
def test_round_trip_through_the_index(spark, block_lines):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string, key string, owner int")
    scratch = Scratch(spark, "t")
    archive = warc.Archive.write(df, scratch.path("a"), scratch, block_lines=block_lines)
    assert sum(p[4] for p in archive.parts) == len(rows())
    keys = df.select(warc.index_key(df["url"], df["page_id"]).alias("key"))
    assert sorted((tuple(r) for r in archive.lookup(keys).collect()), key=str) == brute(rows())
    hot = archive.get(spark, "https://hot.example.org/same")
    assert sorted(r["page_id"] for r in hot) == list(range(1000, 1060))
    assert [r["payload"] for r in hot if r["record_type"] == "response"] == [b"<b>same</b>"]
    assert archive.get(spark, "http://nowhere.example/") == []


def test_whole_query_and_limits(spark):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string, key string, owner int")
    assert sorted((tuple(r) for r in warc.archive_and_read(df).collect()), key=str) == brute(rows())
    assert {r["record_type"] for r in warc.archive_and_read(df, min_bytes=10**6).collect()} == {"response"}
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_reversed_host(spark):
    urls = {"http://www.a.com/x?y#z": "com,a,www)/x?y", "HTTPS://A.com": "com,a)", "mailto": ")mailto", "http://u:p@h.org:8080/q r": "org,h)/q%20r"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r[0]: r[1] for r in df.select("u", warc.surt(df["u"])).collect()} == urls
