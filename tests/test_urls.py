"""Relative URLs: the examples of RFC 3986, 5.4, and what pages hold."""

from urllib.parse import urljoin

import pytest

from pyspark.sql import functions as F

from lakequarry.functions import urls

BASE = "http://a/b/c/d;p?q"
# The RFC's normal and abnormal examples.
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s",
    "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g",
    "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..",
    "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x",
    "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x",
}


def resolved(spark, refs, base):
    rows = spark.createDataFrame([(n, r) for n, r in enumerate(refs)], "n int, r string").select("n", urls.absolute(F.col("r"), base).alias("u")).orderBy("n").collect()
    return [r.u for r in rows]


def test_examples_of_the_rfc(spark):
    assert dict(zip(EXAMPLES, resolved(spark, list(EXAMPLES), BASE), strict=True)) == EXAMPLES


@pytest.mark.parametrize("base", ["https://site.example", "https://site.example/", "https://site.example/System/Proposal/Default.aspx?x=1#y", "https://site.example:8443/a/b/"])
def test_links_of_pages(spark, base):
    refs = ["f/7.pdf", "../f/1.pdf", "/f", "?x=1", "https://other.example/a/../b", "//other.example/c", "a/b/../../../c", "d?u=../e"]
    want = [urljoin(base, r) for r in refs]
    want[4] = "https://other.example/b"  # the RFC takes dot segments out of absolute URLs too
    assert resolved(spark, refs, base) == want
    assert resolved(spark, [None, " f/7.pdf \n", "#t"], base)[:2] == [None, urljoin(base, "f/7.pdf")]


def test_a_reference_is_worked_out_once(spark):
    shown = str(spark.range(1).select(F.lit("a").alias("some_ref")).select(urls.absolute(F.col("some_ref"), "https://h.example/a/b?q"))._jdf.queryExecution().logical())
    assert shown.count("'some_ref") + shown.count("some_ref#") <= 2  # the one use, and the column's definition


def test_plain_references_and_hosts_are_as_parsed_ones(spark):
    base = "https://h.example/a/b?q"
    refs = ["x", "x/y", " x/y?a=/../b#c:d ", "x/./y", "../x", ".x", "x:y", "x/y:z", "?p", "#f", "//o.example/x", "/r", "x.y", "x..y/z", "x/.y", ""]
    want = [urljoin(base, r.strip()) for r in refs]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(refs)], "k int, r string")
    assert [r[0] for r in rows.orderBy("k").select(urls.absolute(F.col("r"), base)).collect()] == want
    given = {"https://h.example/a": True, "https://h.example/a b": False, "http://h.example/": False, "https://h.example:8/x?y": True, "https://h.example.org/": False, "HTTPS://H.EXAMPLE/": True, None: False}
    found = spark.createDataFrame([(u,) for u in given], "u string").select("u", urls.on_host(F.col("u"), "h.example")).collect()
    assert {r[0]: r[1] for r in found} == given
