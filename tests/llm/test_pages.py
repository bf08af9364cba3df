"""Operators on pages against brute force, with unusual rows."""

import base64
import hashlib
import random
import re
from collections import Counter
from urllib.parse import unquote, urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scrubline.llm import urls, warc
from scrubline.staging import new_path

URLS = [
    None, "", "no scheme", "http://net", "http://net/", "HTTP://A.NET/x", "https://a.example.net/en/1?x=1#y", "http://example.net/en", "http://example.com/de/", "http://xexample.com/de/",
    "http://b.example.com/de/z;q", "http://a.org/fr/1", "http://org/fr/", "http://a.org/FR/1", "x://y://z.net/q", "://net/", "http://a.net?x=/", "http://ÄÖ.net/ü", "http://a.net/\nnext", "http://u:p@h.net:80/p",
]


def by_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match("[^?#]*", rest[len(host) :])[0]


def page_table(spark, values):
    return spark.createDataFrame([(i, u, "h", 1, "p") for i, u in enumerate(values)], "page_id long, url string, host string, label int, found string")


def test_url_rules(spark):
    r = random.Random(3)
    more = [f"http://{r.choice('abc')}.{r.choice(['example.net', 'example.com', 'x.org', 'y.info'])}/{r.choice(['en', 'de', 'fr'])}/{r.randint(0, 99)}" for _ in range(200)]
    values = [*URLS, *more, more[0]]
    got = urls.judge(page_table(spark, values)).select("row.page_id", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(values)
    for row in got:
        host, path = parts(values[row.page_id])
        rule, verdict = by_rule(host, path)
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict if rule else row.verdict in ("allow", "block")


def test_url_trees_on_held_out_urls(spark):
    """Spam with digits and parameters against plain pages; half of the URLs are kept from training."""
    r = random.Random(5)
    word = lambda n: "".join(r.choices("abcdefghij", k=n))
    good = [f"https://www.{word(7)}.org/{word(5)}/{word(6)}.html" for _ in range(400)]
    bad = [f"http://{word(3)}-{r.randint(1000, 9999)}.{word(4)}.biz/{r.randint(10**6, 10**9)}?a={r.randint(1, 99)}&b={word(3)}&c=1" for _ in range(400)]
    # a third kind that only its parameters give away
    bad += [f"https://www.{word(7)}.org/{word(5)}?id={r.randint(10**5, 10**9)}&r={word(9)}" for _ in range(400)]
    good += [f"https://www.{word(7)}.org/{word(5)}/{word(9)}/{word(4)}" for _ in range(400)]
    rows = [(u, int(u in set(bad)), i % 2) for i, u in enumerate(r.sample(good + bad, 1600))]
    table = spark.createDataFrame(rows, "url string, label int, half int")
    ready = urls.parts(table).select("url", "host", "path", "row.label", "row.half")
    model = urls.UrlModel(ready.where("half = 0"), max_train=600)
    assert model.sample.count() == 600
    right = model.judge(ready.where("half = 1")).agg(F.avg((F.col("blocked") == (F.col("label") == 1)).cast("int"))).first()[0]
    assert right > 0.95


def test_suffix_rates_count_all_labels_but_a_rows_own_fold(spark):
    rows = [(f"http://h{i % 3}.{'biz' if i % 2 else 'org'}/{i}", i % 2) for i in range(300)] + [("http://alone.info/", 1)]
    ready = urls.parts(spark.createDataFrame(rows, "url string, label int")).select("url", "host", "path", "row.label")
    model = urls.UrlModel(ready, max_train=40)
    assert model.sample.count() == 40
    seen = model.rates["rate_1"].select(F.sum(F.expr("aggregate(rate_1_seen, 0L, (a, x) -> a + x)"))).first()[0]
    assert seen == 301
    rates = {r.url: (r.rate_1, r.rate_all) for r in model.features(ready).collect()}
    fitting = {r.url: (r.rate_1, r.rate_all) for r in model.features(ready, fitting=True).collect()}
    prior = 151.5 / 302
    assert rates["http://h1.biz/1"][0] == pytest.approx((150 + 5 * prior) / 155)
    assert rates["http://alone.info/"] == pytest.approx(((1 + 5 * prior) / 6,) * 2)
    assert fitting["http://alone.info/"] == pytest.approx((prior,) * 2)
    assert 0.5 < fitting["http://h1.biz/1"][0] < rates["http://h1.biz/1"][0]


def test_url_rows_with_odd_columns(spark):
    table = page_table(spark, ["http://a.info/", None, "http://a.net/"]).selectExpr("*", "map('a', 1) as m", "1 as `a``b.c`", "2 as Host2")
    out = urls.judge(table).select("row.*", "verdict")
    assert out.count() == 3 and out.columns == [*table.columns, "verdict"]


def test_url_tables_without_labels(spark):
    assert urls.judge(page_table(spark, ["http://a.info/"])).select("verdict").first()[0] == "allow"
    assert urls.judge(page_table(spark, ["http://a.info/", "http://a.net/"]).limit(0)).count() == 0


def test_url_features(spark):
    row = urls.lexical(urls.parts(page_table(spark, ["http://a-b.c1.org/x//y.html?p=1&q=2#z"]))).first()
    assert (row.depth, row.labels, row.hyphens, row.longest_label, row.parameters, row.has_fragment, row.has_extension) == (2, 3, 1, 3, 2, 1, 1)


# ── archives ──


def brute_records(pages, least=0):
    out = Counter()
    best = {}
    for i, _, html in pages:
        if i is not None:
            best[html or ""] = max(best.get(html or "", -1), i)
    for i, _, html in pages:
        body = (html or "").encode()
        head = best.get(html or "")
        revisit = head is not None and i != head and len(body) >= least
        out[i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", head if revisit else None] += 1
    return out


def pages(spark):
    r = random.Random(2)
    data = [(i, r.choice(URLS), r.choice(["same", "", None, f"own {i}", "é\r\n\r\nWARC/1.1\r\nx: y\r\n\r\n", "long " * 9000])) for i in range(120)]
    data += [(None, "http://n.org/", "same"), data[5], data[5]]
    return data, spark.createDataFrame([(*x, "t", 1) for x in data], "page_id long, url string, html string, digest string, bytes int").repartition(4)


def test_warc_round_trip(spark):
    data, table = pages(spark)
    for least in (0, 10):
        path = new_path(spark, "warc")
        warc.write(table, path, least_bytes=least, most_bytes=2000)
        got = warc.history(spark, path).collect()
        have = Counter((None if r.page_id is None else int(r.page_id), r.bytes, r.digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in got)
        assert have == brute_records(data, least)


def test_history_is_in_one_order(spark):
    _, table = pages(spark)
    path = new_path(spark, "warc")
    warc.write(table, path, most_bytes=900)
    out = warc.history(spark, path, range_rows=30).withColumn("part", F.spark_partition_id())
    rows = out.select("part", "url_key", "captured", "page").collect()
    keys = [(r.url_key, r.captured, -1 if r.page is None else r.page) for r in rows]
    assert keys == sorted(keys) and len({r.part for r in rows}) > 1


def test_records_are_fetched_by_their_place(spark):
    data, table = pages(spark)
    path = new_path(spark, "warc")
    warc.write(table, path, most_bytes=2000)
    rows = warc.history(spark, path).collect()
    assert len({r.archive for r in rows}) > 4  # archives are cut by bytes
    for r in rows:
        with open(unquote(urlparse(r.archive).path), "rb") as f:
            f.seek(r.offset)
            ((_, _, fields, block),) = warc.parse(f.read(r.length))
        assert fields["warc-record-id"] == f"<urn:x-page:{r.page_id or ''}>"
        if r.record_type == "response":
            assert len(block.partition(b"\r\n\r\n")[2]) == r.bytes


def test_text_ids(spark):
    rows = [("p-17", "http://a.org/", "same"), ("p-2", "http://a.org/", "same"), ("x", None, None)]
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id string, url string, html string"), path)
    got = {r.page_id: (r.record_type, r.refers_to, r.captured) for r in warc.history(spark, path).collect()}
    first = "2024-01-01T00:00:00Z"
    assert got == {"p-17": ("revisit", "p-2", first), "p-2": ("response", None, first), "x": ("response", None, first)}


def test_record_of_many_members(spark):
    import os

    record = b"WARC/1.1\r\nContent-Length: 40000000\r\n\r\n" + os.urandom(1000) * 40000 + b"\r\n\r\n"
    small = b"WARC/1.1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    members = [x for r in (small, record, small) for x in warc.packed(r)]
    assert len(members) == 5 and all(x.endswith(b"\0") for x in members)
    content = b"".join(members)
    found = list(warc.parse(content))
    assert [len(block) for *_, block in found] == [1, 40_000_000, 1]
    at, size = found[1][:2]
    assert len(list(warc.parse(content[at : at + size]))) == 1
    with pytest.raises(ValueError):
        list(warc.parse(content[: at + 100]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_runs_show_by_their_descents(slices):
    keys = [x for s in slices for x in sorted(s)]
    found = warc.in_order(keys)
    assert [i for r in found for i in r] == list(range(len(keys))) and len(found) <= len(slices)
    assert [keys[i] for i in warc.loser_tree(found, keys.__getitem__)] == sorted(keys)


def test_empty_archives(spark):
    _, table = pages(spark)
    path = new_path(spark, "warc")
    warc.write(table.limit(0), path)
    assert warc.history(spark, path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted(x) for x in runs]
    assert list(warc.loser_tree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key(spark):
    got = {r.url: r.key for r in page_table(spark, ["http://www.Example.com:80/A?b#c", "https://a.b.org", "odd"]).select("url", warc.url_key(F.col("url")).alias("key")).collect()}
    assert got == {"http://www.Example.com:80/A?b#c": "com:80,example)/a?b", "https://a.b.org": "org,b,a)", "odd": "odd"}
