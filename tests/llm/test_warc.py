import base64
import hashlib
from collections import defaultdict

from orbisect.llm import warc as W

PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "http://a/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (9, "http://c/", "<p>same</p>"), (3, None, None), (4, "http://d/", ""),
    (5, "http://e/\r\nx", "ünïcode \r\n\r\n WARC/1.1"), (None, "http://f/", "null id"), (None, "http://g/", "<p>same</p>"), (6, "http://h/", "y" * 200_000),
    (7, "http://i/", "twice"), (7, "http://i/", "twice"),
]


def sha(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def expected(rows, min_bytes=0):
    groups = defaultdict(list)
    for i, _, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, _, t in rows:
        size = len((t or "").encode())
        ids = groups[t or ""]
        top = max((x for x in ids if x is not None), default=None)
        revisit = size >= min_bytes and len(ids) > 1 and top is not None and i != top
        out.append((i, size, sha(t), "revisit" if revisit else "response", top if revisit else None))
    return sorted(map(str, out))


def digest(df):
    return sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in df.collect())


def test_records_come_back(spark):
    pages = spark.createDataFrame(ROWS, PAGES).repartition(3)
    assert digest(W.archived(pages)) == expected(ROWS)
    assert digest(W.archived(pages, min_bytes=100)) == expected(ROWS, 100)
    whole = {r.page_id: (r.url, r.payload) for r in W.archived(pages, payloads=True).collect() if r.record_type == "response"}
    assert whole[5] == ("http://e/%0D%0Ax", ROWS[5][2].encode()) and whole[6][1] == b"y" * 200_000
    assert whole[4] == ("http://d/", b"")  # the null page revisits the empty one


def test_selected_records_alone_are_read(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES)
    index = W.write_archives(W.planned(pages), f"file://{tmp_path}/x").cache()
    assert index.count() == len(ROWS)
    assert [r.page_id for r in W.read_records(index.where("page_id = 6")).collect()] == [6]


def test_ranges_merge_neighbours():
    assert [(a, b) for a, b, _ in W.ranges([(0, 10), (10, 5), (200, 5)], gap=50, most=1000)] == [(0, 15), (200, 205)]
    assert len(W.ranges([(0, 600), (600, 600)], most=1000)) == 2


def test_odd_tables(spark):
    from pyspark.sql import functions as F

    assert W.archived(spark.createDataFrame([], PAGES)).collect() == []
    pages = spark.createDataFrame(ROWS, PAGES).select("*", *(F.lit(1).alias(n) for n in ("sha1", "size", "kept", "n", "file", "offset")))
    assert digest(W.archived(pages)) == expected(ROWS)
