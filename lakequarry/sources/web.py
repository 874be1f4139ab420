"""Web pages as a Spark data source: spark.read.format("web_pages"), one row a request.

Options: url (required); params, a JSON list of objects, one request each; method GET or POST; timeout in seconds; max_bytes; host, the only host that an answer may come from; path, the only path that an
answer may have (letters' case is the same). names, a JSON object: a parameter's name in the request where it is another one; fixed, a JSON object of fields that are sent with every request. tokens, a JSON list
of hidden inputs: the page itself is read first (token_timeout in seconds), and its inputs and cookies are sent with the request. Equality filters on the column `period`, `session`, `meeting`, `keyword`,
`councilor` or `category` are pushed into every request. Rows: request, the columns above as they were sent, url after redirects, status, html, error (null if it went well). A failed request is a row with
its error, so one failure does not end a scan.

A host gets at most `concurrency` requests at a time (3 unless given): a task sends its requests one after another, and a host's requests are dealt to so many tasks. `request` numbers them in the order given. With the option binary the answer's bytes are in
`content` and html is null. An answer that declares or has more than max_bytes is refused.

fetch_each() does the same for the rows of a table, each with a URL of its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from urllib.error import URLError
from urllib.parse import urlencode, urlsplit
from urllib.request import HTTPCookieProcessor, Request, build_opener

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

FIELDS = ("period", "session", "meeting", "keyword", "councilor", "category")
SCHEMA = ", ".join(["request int", *(f"{f} string" for f in FIELDS), "url string", "status int", "html string", "error string", "content binary"])
CONCURRENCY = 3  # fixed value: requests to a host at a time


def input_values(html: str, names: list[str]) -> dict[str, str]:
    """The values of the inputs whose id or name is one of names; empty where the page has none."""
    values = dict.fromkeys(names, "")
    for tag in re.findall(r"(?is)<input\b[^>]*>", html):
        own = {k.lower(): unescape(v) for k, _, v in re.findall(r"""(?s)([\w:-]+)\s*=\s*(["'])(.*?)\2""", tag)}
        for name in {own.get("id"), own.get("name")} & values.keys():
            values[name] = own.get("value", "")
    return values


def fetched(o: dict, opener, call: Request, timeout: str = "timeout") -> tuple[str, int, bytes]:
    """url, status and bytes of an answer that keeps the limits of the options."""
    most = int(o.get("max_bytes", 25 << 20))
    with opener.open(call, timeout=float(o.get(timeout, 8))) as answer:
        came = urlsplit(answer.url)
        if o.get("host") and came.hostname != o["host"]:
            raise ValueError(f"SOURCE_ID_MISMATCH: the answer comes from {came.hostname}")
        if o.get("path") and came.path.lower() != o["path"].lower():
            raise ValueError(f"PARSER_CONTRACT_CHANGED: the answer is another page, {came.path}")
        declared = answer.headers.get("Content-Length", "")
        body = b"" if declared.isdigit() and int(declared) > most else answer.read(most + 1)
        if len(body) > most or not body and declared.isdigit() and int(declared) > most:
            raise ValueError(f"SOURCE_TOO_LARGE: more than {most} bytes")
        return answer.url, answer.status, body


class _Requests(InputPartition):
    """Requests of one host, each with its number, that one task sends in turn."""

    def __init__(self, numbered: list[tuple[int, dict]]):
        self.numbered = numbered


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.pushed = options, {}

    def pushFilters(self, filters) -> Iterator:  # noqa: N802 - Spark's name
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                self.pushed[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[_Requests]:
        wanted = list(enumerate(json.loads(self.options.get("params", "[{}]"))))
        tasks = max(1, min(int(self.options.get("concurrency", CONCURRENCY)), len(wanted)))
        return [_Requests([(n, p | self.pushed) for n, p in wanted[k::tasks]]) for k in range(tasks)]

    def read(self, partition: _Requests) -> Iterator[tuple]:
        for number, sent in partition.numbered:
            yield self._row(number, sent)

    def _row(self, number: int, sent: dict) -> tuple:
        o = self.options
        fields = tuple(sent.get(f) for f in FIELDS)
        names, url = json.loads(o.get("names", "{}")), o["url"]
        opener = build_opener(HTTPCookieProcessor())  # a request's cookies are its own
        try:
            form = json.loads(o.get("fixed", "{}"))
            if o.get("tokens"):
                form |= input_values(fetched(o, opener, Request(url), "token_timeout")[2].decode("utf-8", "replace"), json.loads(o["tokens"]))
            coded = urlencode(form | {names.get(k, k): v for k, v in sent.items() if v is not None})
            if o.get("method", "GET").upper() == "POST":
                call = Request(url, coded.encode(), {"Referer": url})
            else:
                call = Request(f"{url}{'&' if '?' in url else '?'}{coded}" if coded else url)
            own, status, body = fetched(o, opener, call)
            if o.get("binary"):
                return (number, *fields, own, status, None, None, body)
            return (number, *fields, own, status, body.decode("utf-8", "replace"), None, None)
        except (URLError, OSError, ValueError) as e:
            return (number, *fields, url, getattr(e, "code", None), None, str(e), None)


def fetch_each(rows: DataFrame, url: Column, concurrency: int = CONCURRENCY, **options: str) -> DataFrame:
    """rows with the answer of each one's URL: url (after redirects), status, html, error and content, as the source gives them.

    A host's rows are dealt to `concurrency` keys; a key's rows lie in one task, which sends one request after another. A null URL gives an error. Columns of these names in rows are replaced.
    """
    names = ("url", "status", "html", "error", "content")
    kept = [c for c in rows.columns if c not in names]
    asked = rows.select(F.struct(*kept).alias("row"), url.alias("asked"))
    lane = F.pmod(F.xxhash64("asked", F.monotonically_increasing_id()), F.lit(concurrency)).cast("int")
    dealt = asked.withColumn("host", F.coalesce(F.lower(F.try_parse_url("asked", F.lit("HOST"))), F.lit(""))).withColumn("lane", lane).repartition("host", "lane")
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary())

    def one(asked: str | None) -> tuple:
        try:
            if not re.match("https?://", asked or ""):
                raise ValueError(f"INVALID_ARGUMENT: no web address: {asked}")
            own, status, body = fetched(options, build_opener(HTTPCookieProcessor()), Request(asked))
            return (own, status, None, None, body) if options.get("binary") else (own, status, body.decode("utf-8", "replace"), None, None)
        except (URLError, OSError, ValueError) as e:
            return asked, getattr(e, "code", None), None, str(e), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, asked in enumerate(b.column("asked").to_pylist()):
                answer = [pa.array([v], k) for v, k in zip(one(asked), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("row").slice(n, 1), *answer], ["row", *names])

    schema = f"row {asked.schema['row'].dataType.simpleString()}, url string, status int, html string, error string, content binary"
    return dealt.select("row", "asked").mapInArrow(run, schema).select("row.*", *names)


class WebPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ARG002 - fixed schema
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
