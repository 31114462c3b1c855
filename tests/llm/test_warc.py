import gzip
import hashlib
import tempfile
from collections import Counter
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

from shopflow.llm import warc as W
from shopflow.llm.common import read_table

SCHEMA = "page_id bigint, url string, html string"


def expected(rows):
    first = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= W.LEAST_DUPLICATE and p is not None:
            first[h] = min(p, first.get(h, p))
    out = Counter()
    for p, _, h in rows:
        data = (h or "").encode()
        revisit = h in first and first[h] != p
        out[p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None] += 1
    return out


def check(frame):
    rows = [(r.page_id, r.url, r.html) for r in frame.select("page_id", "url", "html").collect()]
    got = W.archive_index(frame).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(rows)
    got.sort(key=lambda r: r.capture_no)
    assert [r.capture_no for r in got] == list(range(len(got)))
    keys = [(r.url_key, r.captured, W._NO_PAGE if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys)
    return got


def test_pages_round_trip(spark):
    check(read_table(spark, "/root/testdata/sf0.01", "pages"))


BIG = "<p>" + "é\r\n\r\nWARC/1.1\r\n\r\n" * 20
ROWS = [(5, "http://a.org/x", BIG), (3, "http://a.org/y", BIG), (3, "http://a.org/y", BIG), (None, "http://a.org/z", BIG), (9, None, BIG + "!"),
        (10, "http://www.B.org:8080/q?x=1\r\nInjected: yes", "short"), (11, "not a url [", "short"), (12, "http://b.org", None), (13, "", ""),
        (None, None, None), (14, "http://c.org/a", "x" * 99), (15, "http://c.org/a", "x" * 99), (17, "http://c.org/a", "y" * 100), (16, "http://c.org/b", "y" * 100)]


def test_edges(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    check(frame)
    check(frame.selectExpr("*", "'c' as digest", "'c' as value", "'c' as at", "'c' as n", "'c' as first", "'c' as run", "'c' as range"))
    assert W.archive_index(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_url_and_hot_payload_spread(spark):
    rows = [(i, "http://hot.org/", BIG if i % 3 else f"{BIG}{i}") for i in range(3000)]
    got = check(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {1}


def test_files_are_plain_warc(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/warc"
    W.write_archives(spark.createDataFrame(ROWS, SCHEMA), path)
    records = []
    for f in Path(path).glob("*.gz"):
        with gzip.open(f) as stream:
            records += W.parse_archive(stream)
        with gzip.open(f) as stream:
            data = stream.read()
        assert not data or data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
    assert len(records) == len(ROWS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    tagged = [[(v, i, j) for j, v in enumerate(r)] for i, r in enumerate(runs)]
    merged = list(W.LoserTree([iter(r) for r in tagged], key=lambda x: x[0]))
    assert merged == sorted(x for r in tagged for x in r)


def test_url_keys():
    assert W.url_key("https://www.Example.com:443/A?b=C") == "com,example)/a?b=c"
    assert W.url_key(None) == "" and W.url_key("http://x.y:8080") == "y,x:8080)/"


def test_dates_are_utc_in_any_session_time_zone(spark):
    from pyspark.sql import functions as F
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        moments = spark.createDataFrame([(1704067201,), (1710054000,), (1730613600,)], "s bigint").select(W.warc_date(F.timestamp_seconds("s")).alias("d"))
        assert [r.d for r in moments.collect()] == ["2024-01-01T00:00:01Z", "2024-03-10T07:00:00Z", "2024-11-03T06:00:00Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
