"""Queries over the driver's tables, each by the library's operators and, in SQL, for DuckDB. Queries read whole tables; a limit is there only where it is the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text, urls
from ..functions.codes import period_code, session_code, window_number
from ..operators import completeness as C
from ..operators import keyed, markup, paged, search, totals
from ..session import spread, table
from ..sources import results
from ..streaming import windows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query with its SQL."""
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def _laws(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records with articles: their lines."""
    lines = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct((i + 1).cast("string").alias("article_no"), line.alias("content")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("_pos"), "doc_id", F.col("lang").alias("category"), F.col("source").alias("law_name"), lines.alias("articles"))


_LINES = "SELECT doc_id, lang, source, string_split(text, chr(10)) AS lines FROM documents"


@query(f"""SELECT doc_id, source AS law_name, array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: contains(lines[i], 'that')), lambda i: i || ': ' || substring(lines[i], 1, 80) || '...'), '|') AS matched
FROM ({_LINES}) WHERE contains(lang, 'en') AND (contains(source, 'that') OR len(list_filter(lines, lambda l: contains(l, 'that'))) > 0) ORDER BY doc_id LIMIT 10""")
def law_search(spark: SparkSession, d: str) -> DataFrame:
    found = search.search_nested(_laws(spark, d), "that", "law_name", "articles", "content", "article_no", {"category": "en"}, 10)
    return found.select("doc_id", "law_name", F.array_join("matched", "|").alias("matched"))


@query("SELECT doc_id, lang AS category, CAST(len(string_split(text, chr(10))) AS INTEGER) AS articles_count FROM documents WHERE CAST(doc_id AS VARCHAR) = '77' OR contains(source, 'src9') ORDER BY doc_id LIMIT 1")
def law_detail_first_match(spark: SparkSession, d: str) -> DataFrame:
    laws = _laws(spark, d).withColumn("law_id", F.col("doc_id").cast("string"))
    return search.first_match(laws, "law_id", "77", "law_name", "src9").select("doc_id", "category", F.size("articles").alias("articles_count"))


@query("SELECT event_id, user_id, event_type FROM events WHERE contains(event_type, 'c') ORDER BY ts DESC NULLS LAST, event_id LIMIT 10")
def latest_filtered(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("_pos", F.col("event_id"))
    return search.latest(events, "ts", {"event_type": "c"}, 10).select("event_id", "user_id", "event_type")


@query("SELECT conv_id, turn, role FROM conversations WHERE contains(role, 'that') OR contains(text, 'that') ORDER BY conv_id, turn, role, text LIMIT 100")
def text_search_two_columns(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").withColumn("_pos", F.struct("conv_id", "turn", "role", "text"))
    return search.search_flat(turns, "that", ["role", "text"], limit=100).select("conv_id", "turn", "role")


@query("""WITH r AS (SELECT s_suppkey AS p, s_name AS n, s_acctbal AS a FROM supplier UNION ALL SELECT 1000000000, '合計', (SELECT round(sum(s_acctbal), 2) FROM supplier))
SELECT count(*) FILTER (n NOT LIKE '%合計%') AS agency_count, round(sum(a) FILTER (n NOT LIKE '%合計%'), 2) AS agency_sum, round(max(a) FILTER (n LIKE '%合計%'), 2) AS official_total,
 arg_max(n, row(a, -p)) FILTER (n NOT LIKE '%合計%') AS highest_name, max(a) FILTER (n NOT LIKE '%合計%') AS highest_amount, arg_min(n, row(a, p)) FILTER (n NOT LIKE '%合計%') AS lowest_name, min(a) FILTER (n NOT LIKE '%合計%') AS lowest_amount FROM r""")
def budget_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("_pos"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("amount"))
    total = rows.agg(F.lit(1_000_000_000).cast("long").alias("_pos"), F.lit("合計").alias("name"), F.round(F.sum("amount"), 2).alias("amount"))
    found = totals.summarize(rows.unionByName(total))
    return found.withColumns({c: F.round(c, 2) for c in ("agency_sum", "official_total")})


@query("""SELECT n_name AS nation, count(*) AS agency_count, round(sum(c_acctbal), 2) AS agency_sum, arg_max(c_name, row(c_acctbal, -c_custkey)) AS highest_name, max(c_acctbal) AS highest_amount,
 arg_min(c_name, row(c_acctbal, c_custkey)) AS lowest_name, min(c_acctbal) AS lowest_amount FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def budget_by_nation(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    rows = keyed.look_up(table(spark, d, "customer"), nation, "c_nationkey", "nation")
    rows = rows.select("nation", F.col("c_custkey").alias("_pos"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))
    return totals.summarize(rows, by=["nation"]).withColumn("agency_sum", F.round("agency_sum", 2)).drop("official_total")


@query("SELECT s_suppkey, round(s_acctbal, 2) AS amount FROM supplier")
def amount_parse(spark: SparkSession, d: str) -> DataFrame:
    shown = F.concat(F.lit("\ufeff　"), F.format_number("s_acctbal", 2), F.lit("  "))
    return table(spark, d, "supplier").select("s_suppkey", F.round(numbers.parse_amount(shown), 2).alias("amount"))


_SP = r"[\t\n\v\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _sql_decoded(x: str, entities=text.WITH_BLANK) -> str:
    for name, char in entities:
        x = f"regexp_replace({x}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}', 'gi')"
    return x


def _sql_plain(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SP}+', ' ', 'g'))"


@query(f"SELECT page_id, sha256({_sql_plain(_sql_decoded("regexp_replace(html, '<[^>]+>', ' ', 'g')"))}) AS plain_sha256 FROM pages")
def html_plain_text(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pages").select("page_id", "html")).select("page_id", F.sha2(text.text_of_markup(F.col("html")), 256).alias("plain_sha256"))


@query(rf"""SELECT page_id, CAST(i - 1 AS INTEGER) AS item, {_sql_plain(_sql_decoded("regexp_replace(li, '<[^>]+>', ' ', 'g')"))} AS content, regexp_extract(li, '(?is)\bhref\s*=\s*"(.*?)"', 1) AS link
FROM (SELECT page_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS li FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li\b.*?</li>') AS l FROM pages))""")
def html_items(spark: SparkSession, d: str) -> DataFrame:
    rows = markup.exploded(table(spark, d, "pages"), "html", r"(?is)<li\b.*?</li>", 0, "li", ["page_id"])
    return rows.select("page_id", F.col("_pos").alias("item"), text.text_of_markup(F.col("li")).alias("content"), markup.attribute(F.col("li"), "href").alias("link"))


@query(f"SELECT page_id, sha256({_sql_decoded('html', text.BASIC)}) AS decoded_sha256 FROM pages")
def entity_decode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2(text.decode_basic_entities(F.col("html")), 256).alias("decoded_sha256"))


@query(rf"""WITH c AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS li FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li\b[^>]*>(.*?)</li>', 1) AS l FROM pages)),
t AS (SELECT page_id, i, {_sql_plain(_sql_decoded("regexp_replace(li, '<[^>]+>', ' ', 'g')"))} AS v FROM c), n AS (SELECT page_id, i, v, lead(v) OVER (PARTITION BY page_id ORDER BY i) AS value FROM t)
SELECT page_id, v AS label, arg_max(value, i) AS value FROM n WHERE v IN ('de', 'the', 'in', 'was', 'is', 'un') AND value IS NOT NULL GROUP BY ALL""")
def label_value_next_cell(spark: SparkSession, d: str) -> DataFrame:
    cells = markup.cells_of(F.col("html"), text.text_of_markup, r"(?is)<li\b[^>]*>(.*?)</li>")
    rows = table(spark, d, "pages").select("page_id", F.lit(0).alias("table"), F.lit(0).alias("_pos"), cells.alias("cells"))
    return markup.label_values(rows, "page_id", ("de", "the", "in", "was", "is", "un"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '[?&]id=([^&#]*)', 1) AS id FROM pages""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", *[text.or_empty(urls.part(u, p, *k)).alias(a) for a, p, *k in (("host", "HOST"), ("path", "PATH"), ("id", "QUERY", "id"))])


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n FROM documents WHERE contains(text, 'the')")
def occurrences(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.contains("text", F.lit("the")))
    return docs.select("doc_id", text.occurrences(F.col("text"), "the").alias("n"))


_SNIPPETS = f"""WITH p AS (SELECT doc_id, page, t, string_split(t, 'able') AS g FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS page, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE contains(t, 'able')),
o AS (SELECT doc_id, page, t, i, CAST(list_sum(list_transform(g[:i], lambda x: length(x))) AS BIGINT) + 4 * (i - 1) AS pos FROM p, unnest(range(1, len(g))) u(i)),
v AS (SELECT *, greatest(0, pos - 45) AS s, least(length(t), pos + 4 + 45) AS e FROM o),
b AS (SELECT *, CASE WHEN s <= lag(e) OVER w THEN 0 ELSE 1 END AS new FROM v WINDOW w AS (PARTITION BY doc_id, page ORDER BY i)),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY i) AS k FROM b),
m AS (SELECT doc_id, page, any_value(t) AS t, k, min(s) AS s, max(e) AS e, count(*) AS n FROM k GROUP BY doc_id, page, k),
x AS (SELECT doc_id, page, k, n, CASE WHEN s > 0 THEN '...' ELSE '' END || {_sql_plain('substring(t, s + 1, e - s)')} || CASE WHEN e < length(t) THEN '...' ELSE '' END AS x FROM m)
SELECT doc_id AS record_id, CAST(page AS INTEGER) AS page, CAST(sum(n) AS BIGINT) AS match_count, string_agg(x, '|' ORDER BY k) FILTER (k <= 3) AS snippets FROM x GROUP BY doc_id, page"""


@query(_SNIPPETS)
def snippets(spark: SparkSession, d: str) -> DataFrame:
    found = paged.matches(paged.pages_from_text(table(spark, d, "documents"), "doc_id"), "able")
    return found.withColumn("snippets", F.array_join("snippets", "|"))


@query("""WITH c AS (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 15), r AS (SELECT count(*) AS attempted, count(text) AS ok, count(*) FILTER (contains(text, 'able')) AS hit FROM c)
SELECT 'able' AS keyword, CASE WHEN attempted > ok THEN 'partial' ELSE 'success' END AS scan_status, attempted AS attempted_records_count, ok AS succeeded_records_count, attempted - ok AS failed_records_count, hit AS matched_records_count FROM r""")
def cross_record_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    index = docs.select(F.col("doc_id").alias("_pos"), F.col("doc_id").alias("record_id"))
    own = lambda ids: paged.pages_from_text(docs.join(ids, F.col("doc_id") == F.col("record_id"), "left_semi"), "doc_id")
    return paged.scan(index, own, "able", 15)[2]


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props, min(event_id) AS first_at FROM events GROUP BY ALL")
def dedupe_keep_last(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_type", "value", "props", F.col("event_id").alias("_pos"))
    return keyed.keep_last(events, ["user_id", "event_type"]).withColumnRenamed("_pos", "first_at")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def revoked_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return keyed.without_denied(table(spark, d, "documents").select("doc_id", "lang", "source"), table(spark, d, "labels").where("toxic = 1"), "doc_id")


@query("""SELECT o_orderstatus, n AS returned_count, CASE o_orderstatus WHEN 'P' THEN NULL ELSE t END AS total_count, CASE o_orderstatus WHEN 'P' THEN NULL ELSE n >= t END AS is_complete
FROM (SELECT o_orderstatus, least(count(*), 1000) AS n, count(*) AS t FROM orders GROUP BY 1)""")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    counts = F.when(F.col("o_orderstatus") == "P", F.array("t", "t")).otherwise(F.array("t"))
    rows = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("t")).withColumn("returned_count", F.least("t", F.lit(1000))).withColumn("tab_counts", counts)
    return C.completeness(rows).select("o_orderstatus", "returned_count", "total_count", "is_complete")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 51")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return keyed.keyset_page(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 50, 100)


@query("SELECT c_custkey FROM customer WHERE starts_with(c_name, 'Customer#0000000') AND c_name > 'Customer#000000010' ORDER BY c_name LIMIT 21")
def keyset_page_prefix(spark: SparkSession, d: str) -> DataFrame:
    return keyed.keyset_page(table(spark, d, "customer"), "c_name", 20, "Customer#000000010", "Customer#0000000").select("c_custkey")


@query("""SELECT user_id, CAST(epoch(time_bucket(INTERVAL 1 hour, ts)) AS BIGINT) AS window_start, count(*) AS n, least(count(*), 1) AS allowed, greatest(count(*) - 1, 0) AS rejected FROM events GROUP BY 1, 2""")
def rate_window(spark: SparkSession, d: str) -> DataFrame:
    found = windows.rate_windows(table(spark, d, "events"), "ts", ["user_id"], 3600, 1)
    return found.select("user_id", F.unix_seconds("window_start").alias("window_start"), "n", F.col("allowed").cast("long").alias("allowed"), F.col("rejected").cast("long").alias("rejected"))


@query("""SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) ORDER BY ts, event_id) AS k FROM events) WHERE k <= 2""")
def rate_limited_rows(spark: SparkSession, d: str) -> DataFrame:
    return windows.within_limit(table(spark, d, "events"), "ts", ["user_id"], 86400, 2, "event_id").select("event_id")


_TTL = "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) + 86400 * (1 + event_id % 30) AS expiration FROM events"


@query(f"WITH e AS ({_TTL}), n AS (SELECT CAST(floor(epoch(max(ts))) AS BIGINT) AS now FROM events) SELECT event_id, expiration FROM e, n WHERE expiration > now")
def ttl_active(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    now = events.agg(F.max(F.unix_seconds("ts"))).scalar()  # a subquery of one row
    rows = events.select("event_id", (F.unix_seconds("ts") + 86400 * (1 + F.col("event_id") % 30)).alias("expiration"))
    return keyed.active(rows, now)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(r"""SELECT doc_id, regexp_replace(regexp_extract(text, '(?s)the (.*?)(?: of |$)', 1), '^[\s:/\v]+|[\s:/\v]+$', '', 'g') AS field FROM documents WHERE contains(text, 'the ')""")
def field_between_labels(spark: SparkSession, d: str) -> DataFrame:
    found = markup.review_field(F.col("text"), "the ", "the ", (" of ",))
    return table(spark, d, "documents").where(F.contains("text", F.lit("the "))).select("doc_id", found.alias("field"))


@query("SELECT count(*) AS rows, count(*) FILTER (length(text) > 0) AS n_valid, count(*) = count(*) FILTER (length(text) > 0) AS all_valid, count(DISTINCT doc_id) AS distinct_keys, count(*) = count(DISTINCT doc_id) AS \"unique\" FROM documents")
def uniqueness_and_validity(spark: SparkSession, d: str) -> DataFrame:
    return keyed.check_rows(table(spark, d, "documents"), F.length("text") > 0, "doc_id")


@query("SELECT c_custkey, CASE WHEN n_regionkey < 3 THEN n_name ELSE 'unknown' END AS n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def lookup_with_default(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return keyed.look_up(table(spark, d, "customer"), nation, "c_nationkey", "n_name", F.lit("unknown")).select("c_custkey", "n_name")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'decided' WHEN 'P' THEN 'in_review' ELSE 'not_stated' END AS status FROM orders")
def status_case(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda s: F.when(F.col("o_orderstatus") == s, "x")
    none = F.lit("")
    return table(spark, d, "orders").select("o_orderkey", markup.review_status(is_("F"), none, none, none, is_("P"), none).alias("status"))


@query("SELECT count(*) AS attempted, count(*) FILTER (s_acctbal > 0) AS succeeded, count(*) FILTER (NOT s_acctbal > 0) AS failed, CASE WHEN count(*) FILTER (NOT s_acctbal > 0) > 0 THEN 'partial' ELSE 'success' END AS status FROM supplier")
def partial_failure_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.partial_failures(table(spark, d, "supplier"), F.col("s_acctbal") > 0)


@query("""SELECT doc_id, i AS line, contains(l[i], 'able') AS hit FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE contains(text, 'able')), unnest(range(1, len(l) + 1)) u(i)
WHERE len(list_filter(l[greatest(1, i - 1):i + 1], lambda x: contains(x, 'able'))) > 0""")
def line_context(spark: SparkSession, d: str) -> DataFrame:
    found = search.lines_with_context(table(spark, d, "documents"), "doc_id", "text", "able", 1)
    return found.select("doc_id", F.col("line").cast("long").alias("line"), "hit")


@query("SELECT doc_id, CASE WHEN position('able' IN text) > 0 THEN substring(text, greatest(1, position('able' IN text) - 100), position('able' IN text) + 500 - greatest(1, position('able' IN text) - 100)) END AS around FROM documents")
def keyword_context(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.context(F.col("text"), "able").alias("around"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '(?is)<a\\b[^>]*>')) AS INTEGER) AS links FROM pages")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", markup.first_of(html, "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.size(markup.all_of(html, r"(?is)<a\b[^>]*>")).alias("links"))


@query("SELECT user_id, CAST(floor(epoch(ts) / 600) AS BIGINT) AS w, count(*) AS n FROM events GROUP BY 1, 2")
def window_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", window_number(F.col("ts"), 600).alias("w")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) FILTER (event_id % 2 = 0) AS old, arg_max(event_type, event_id) FILTER (event_id % 2 = 1) AS new FROM events GROUP BY 1)
SELECT key, coalesce(new, old) AS value, CASE WHEN new IS NULL THEN NULL ELSE 1060 END AS expiration FROM e""")
def key_value_put(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.lit(None).cast("long").alias("expiration"), F.col("event_id").alias("_pos"))
    old, new = (keyed.keep_last(events.where(F.col("_pos") % 2 == k), ["key"]).drop("_pos") for k in (0, 1))
    return keyed.put(old, new, F.lit(1000), 60)


@query(f"""SELECT page_id, sha256({_sql_plain(f"regexp_replace({_sql_decoded('html')}, '<[^>]*>', ' ', 'g')")}) AS escaped, sha256({_sql_plain(_sql_decoded("regexp_replace(html, '<[^>]*>', ' ', 'g')", text.BASIC))}) AS simple,
 sha256({_sql_plain(_sql_decoded("regexp_replace(regexp_replace(html, '<br\\s*/?>', ' ', 'gi'), '<[^>]*>', '', 'g')"))}) AS cell FROM pages""")
def markup_variants(spark: SparkSession, d: str) -> DataFrame:
    html, sha = F.col("html"), lambda c: F.sha2(c, 256)
    return spread(table(spark, d, "pages").select("page_id", "html")).select("page_id", sha(text.text_of_escaped_markup(html)).alias("escaped"), sha(text.text_of_simple_markup(html)).alias("simple"), sha(text.text_of_cell(html)).alias("cell"))


@query("SELECT o_orderkey, CASE WHEN k < 100 THEN lpad(CAST(k AS VARCHAR), 2, '0') ELSE CAST(k AS VARCHAR) END AS period, '07' || CASE WHEN k < 10 THEN '0' ELSE '' END || k AS session FROM (SELECT o_orderkey, o_orderkey % 120 AS k FROM orders)")
def period_and_session_codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 120
    return table(spark, d, "orders").select("o_orderkey", period_code(F.concat(F.lit(" "), k.cast("string"))).alias("period"), session_code(period_code(F.lit("")), k).alias("session"))


@query("SELECT c_custkey, c_name AS proposer, c_name AS label FROM customer")
def separators_and_label_colons(spark: SparkSession, d: str) -> DataFrame:
    proposer = text.without_trailing_separators(F.concat("c_name", F.lit(", ，　,")))
    return table(spark, d, "customer").select("c_custkey", proposer.alias("proposer"), text.label_of(F.concat(F.lit("： "), "c_name", F.lit(" :"))).alias("label"))


def _list_pages(spark: SparkSession, d: str) -> DataFrame:
    """A list page for each nation, with a row for each of its suppliers, as a proposal list shows them."""
    row = F.concat(
        F.lit('<tr><td><input type="hidden" name="x$hidProposalSN" value="'), F.col("s_suppkey").cast("string"), F.lit('"/><input type="hidden" id="hidProposalKind" value="'), (F.col("s_suppkey") % 3).cast("string"),
        F.lit('"></td><td> '), "s_name", F.lit("</td><td>a &amp; b</td><td>x, y，</td><td><a href='Detail.aspx?s="), (F.col("s_suppkey") + 1).cast("string"), F.lit("&amp;k=1'>subject</a></td><td>open</td></tr>"),
    )
    rows = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("row")))), lambda r: r["row"]), "\n").alias("rows"))
    return rows.select("page_id", F.concat(F.lit("<table><tr><th>no</th></tr>"), "rows", F.lit("</table>")).alias("html"))


@query("""SELECT s_nationkey AS page_id, CAST(s_suppkey AS VARCHAR) AS proposal_sn, CAST(s_suppkey % 3 AS VARCHAR) AS proposal_kind, 'Detail.aspx?s=' || (s_suppkey + 1) || '&k=1' AS detail_url, s_name AS number,
 'a & b' AS category, 'x, y' AS proposer, 'subject' AS subject, 'open' AS status FROM supplier""")
def proposal_rows(spark: SparkSession, d: str) -> DataFrame:
    found = markup.proposals(_list_pages(spark, d))
    return found.select("page_id", "proposal_sn", "proposal_kind", F.regexp_extract("detail_url", "Detail.*", 0).alias("detail_url"), "number", "category", "proposer", "subject", "status")


@query("""SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS total, CAST(o_orderkey % 90 + 1 AS INTEGER) AS page, 97 AS pages, 'q=' || o_custkey || '|r=on|s=' || o_orderstatus AS fields, CAST(o_orderkey AS VARCHAR) AS proposal_sn FROM orders""")
def pager_and_form(spark: SparkSession, d: str) -> DataFrame:
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    html = F.concat(
        F.lit("<span>共 "), F.format_number("o_custkey", 0), F.lit(" 筆</span> 第 "), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit("/97 頁<form><input name='q' value='"), cust, F.lit("'><input type='submit' name='go' value='1'>"),
        F.lit("<input type='checkbox' name='c' value='on'><input type='radio' name='r' value='on' checked><select name='s'><option value='Z'>z</option><option selected value='"), "o_orderstatus", F.lit("'>y</option></select></form>"),
        F.lit("<input type='hidden' id='ProposalSN' value='"), key, F.lit("'>"),
    )
    rows = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")).select("o_orderkey", html.alias("html"))
    pager, fields = markup.pager(F.col("html")), markup.form_fields(F.regexp_extract("html", "(?s)<form>.*</form>", 0))
    shown = F.array_join(F.transform(fields, lambda f: F.concat(f["name"], F.lit("="), f["value"])), "|")
    return rows.select("o_orderkey", pager["total"].alias("total"), pager["page"].alias("page"), pager["pages"].alias("pages"), shown.alias("fields"), markup.page_number(F.col("html")).alias("proposal_sn"))


@query("""SELECT s_nationkey AS page_id, max_by(s_name, s_suppkey) AS first_reading, CAST(CAST(max(s_suppkey) AS INTEGER) AS VARCHAR) AS first_reading_date, '' AS committee_opinion FROM supplier GROUP BY 1""")
def review_rows(spark: SparkSession, d: str) -> DataFrame:
    row = F.concat(F.lit("<tr><td>一讀(交付) 決議："), "s_name", F.lit(" / 交付日期："), F.col("s_suppkey").cast("string"), F.lit("</td></tr>"))
    pages = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("row")))), lambda r: r["row"]), "").alias("html"))
    rows = markup.table_rows(pages.withColumn("html", F.concat(F.lit("<table>"), "html", F.lit("</table>"))), "page_id", "html")
    return markup.reviews(rows, "page_id").select("page_id", "first_reading", "first_reading_date", "committee_opinion")


@query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"none\":null}' AS json FROM nation")
def json_results(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none"))
    return results.json_rows(rows).select(F.get_json_object("json", "$.n_nationkey").cast(rows.schema["n_nationkey"].dataType).alias("n_nationkey"), "json")


@query("SELECT page_id, url FROM pages WHERE page_id = 7 ORDER BY page_id LIMIT 1")
def url_of_id(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").withColumn("_pos", F.col("page_id"))
    return search.first_match(pages, "page_id", "7", "url", None).select("page_id", "url")


@query("""SELECT o_orderkey AS sn, o_orderstatus = 'F' AND o_custkey % 2 = 0 AS official, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS record_id,
 'Order%20' || o_orderkey || '%2F%C3%A9%20%26' AS encoded FROM orders""")
def official_urls(spark: SparkSession, d: str) -> DataFrame:
    scheme, host = F.when(F.col("o_orderstatus") == "F", "https").otherwise("http"), F.when(F.col("o_custkey") % 2 == 0, "site.example").otherwise("site.example.other")
    key = F.col("o_orderkey").cast("string")
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(scheme, F.lit("://"), host, F.lit("/MeetingRecord/"), key, F.lit("/a.pdf")).alias("u"))
    return rows.select(F.col("o_orderkey").alias("sn"), urls.on_host(F.col("u"), "site.example").alias("official"), urls.record_id(F.col("u"), "site.example").alias("record_id"), urls.encode(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit("/é &"))).alias("encoded"))


@query("""SELECT doc_id, doc_id % 7 <> 0 AND text IS NOT NULL AS complete FROM documents""")
def complete_records(spark: SparkSession, d: str) -> DataFrame:
    pages = F.transform(F.split("text", "\n", -1), lambda t, i: F.struct((i + 1).alias("page"), t.alias("text")))
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("record_id"), pages.alias("pages"))
    stated = rows.withColumn("total_pages", F.size("pages") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0))
    return stated.select("doc_id", paged.complete().alias("complete"))


def _supplier_pages(spark: SparkSession, d: str, row, head: str = "") -> DataFrame:
    """A page for each nation with a table: a row for each of its suppliers, by key."""
    rows = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("row")))), lambda r: r["row"]), "").alias("rows"))
    return rows.select("page_id", F.concat(F.lit(f"<table>{head}"), "rows", F.lit("</table>")).alias("html"))


@query("""SELECT s_nationkey AS page_id, CAST(s_suppkey AS VARCHAR) AS record_id, s_name AS meeting, '115/01/02' AS date, 'https://site.example/MeetingRecord/' || s_suppkey || '/a.pdf' AS pdf_url FROM supplier WHERE s_suppkey % 5 NOT IN (0, 1)""")
def meeting_record_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose link goes to another host (one key in five) or is no PDF (another one) are no records."""
    key = F.col("s_suppkey").cast("string")
    link = F.concat(F.when(F.col("s_suppkey") % 5 == 0, "https://other.example").otherwise(""), F.lit("/MeetingRecord/"), key, F.when(F.col("s_suppkey") % 5 == 1, "/a.doc").otherwise("/a.pdf"))
    row = F.concat(F.lit("<tr><td>"), key, F.lit("</td><td>115/01/02</td><td> "), "s_name", F.lit("</td><td><a href='"), link, F.lit("'>x</a></td></tr>"))
    return markup.meeting_records(_supplier_pages(spark, d, row), "page_id", "html", "https://site.example/").select("page_id", "record_id", "meeting", "date", "pdf_url")


@query("""SELECT s_nationkey AS page_id, CAST(s_suppkey AS VARCHAR) AS no, 'a & b' AS description, s_name AS name, s_suppkey || ' KB' AS size, 'https://site.example/f/' || s_suppkey || '.pdf' AS download_url FROM supplier""")
def attachment_rows(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    row = F.concat(F.lit("<tr><td>"), key, F.lit("</td><td>a &amp; b</td><td><a href='f/"), key, F.lit(".pdf'>"), "s_name", F.lit("</a></td><td>"), key, F.lit(" KB</td></tr>"))
    found = markup.attachments(_supplier_pages(spark, d, row, "<tr><td>序號</td><td>a</td><td>b</td><td>c</td></tr>"), "page_id", "html", "https://site.example/")
    return found.select("page_id", "no", "description", "name", "size", "download_url")


@query("""SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || 'x' AS period, 'k' || o_orderkey AS keyword, '0704' || lpad(CAST(o_orderkey % 20 AS VARCHAR), 2, '0') || '00' AS meeting, 'Meeting ' || o_orderkey AS title FROM orders""")
def form_controls(spark: SparkSession, d: str) -> DataFrame:
    """A list's selected option, an input's value, the code of a meeting by its number, and a page's title."""
    key, number = F.col("o_orderkey").cast("string"), F.lpad((F.col("o_orderkey") % 20).cast("string"), 2, "0")
    html = F.concat(
        F.lit("<title> Meeting "), key, F.lit("</title><select name='x$ddlPeriod'><option value='1'>1</option><option selected value='"), F.col("o_custkey").cast("string"), F.lit("x'>2</option></select><input name='x$txtKeyword' value='k"), key,
        F.lit("'><select name='x$ddlMeeting'><option value=''>-</option><option value='07030100'>第 3 次</option><option value='0704"), number, F.lit("00'>第 3 次</option></select>"),
    )
    h = F.col("html")
    return spread(table(spark, d, "orders").select("o_orderkey", "o_custkey")).select("o_orderkey", html.alias("html")).select(
        "o_orderkey", markup.control_value(h, "ddlPeriod").alias("period"), markup.control_value(h, "txtKeyword").alias("keyword"), markup.meeting_code(markup.options(h, "ddlMeeting"), "0704", 3).alias("meeting"), markup.meeting_title(h).alias("title"),
    )


@query("""SELECT o_orderkey AS sn, o_orderstatus AS status, c_name AS unit, n AS total_files FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def parent_detail_files(spark: SparkSession, d: str) -> DataFrame:
    """A list's rows, the detail of each and the number of its files: files are counted before they are joined."""
    files = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sn")).agg(F.count("*").alias("total_files"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("sn"), F.col("o_orderstatus").alias("status"), "o_custkey")
    details = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("unit"))
    return rows.join(details, "o_custkey", "left").join(files, "sn", "left").select("sn", "status", "unit", "total_files")
