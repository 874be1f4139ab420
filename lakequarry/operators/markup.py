r"""Rows, cells, labels, options and pagers of HTML pages, as Column expressions and DataFrame operators.

Pages are rows; a page is taken apart within its row by regular expressions, without a shuffle. Tags are matched without nesting. Names of attributes match in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions import text as X
from ..functions import urls
from .keyed import keep_last

ROW, CELL, DATA_CELL, TABLE = r"(?is)<tr\b.*?</tr>", r"(?is)<(?:td|th)\b[^>]*>(.*?)</(?:td|th)>", r"(?is)<td\b[^>]*>(.*?)</td>", r"(?is)<table\b[^>]*>(.*?)</table>"

# Labels of a detail page, and the fields of its review table: what a row holds, and the labels around each field's value.
DETAIL_LABELS = ("類別", "編號", "提案單位", "承辦單位", "相關單位", "連署人", "案由", "說明", "辦法", "備註", "提案類型", "會議", "狀態")
COLON = r"\s*[：:]?"
REVIEW_FIELDS = {
    "first_reading": ("一讀(交付)", r"一讀\(交付\)\s*(?:決議)?" + COLON, (r"/?交付日期" + COLON, "一讀日期" + COLON)),
    "first_reading_date": ("一讀(交付)", "(?:交付日期|一讀日期)" + COLON, ()),
    "committee_opinion": ("委員會審查意見", "委員會審查意見" + COLON, ("審查日期" + COLON,)),
    "committee_date": ("委員會審查意見", "審查日期" + COLON, ()),
    "second_reading_resolution": ("二讀決議", "二讀決議" + COLON, ("決議日期" + COLON,)),
    "second_reading_date": ("二讀決議", "決議日期" + COLON, ()),
    "third_reading_session": ("三讀決議", r"三讀決議\s*(?:決議大會屆次)?" + COLON, ("決議日期" + COLON,)),
    "third_reading_date": ("三讀決議", "決議日期" + COLON, ()),
}
EMPTY_REVIEW = "^(?:決議|日期|審查意見|大會屆次)?$"
NO_ATTACHMENTS = ("尚無任何資料", "總大小 0 bytes")


def all_of(html: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def first_of(html: Column, pattern: str, group: int = 0) -> Column:
    """The first match; or empty."""
    return F.regexp_extract(X.or_empty(html), pattern, group)


def attribute(tag: Column, name: str) -> Column:
    """A quoted attribute's value, decoded; or empty."""
    return X.decode_entities(first_of(tag, rf"(?is)\b{name}\s*=\s*([\"'])(.*?)\1", 2))


QUOTED = r"(?is)(\w+)\s*=\s*([\"'])(.*?)\2"


def attributes(tag: Column) -> Column:
    """Struct of the names (in small letters) and the values of all quoted attributes of a tag, as they are written. value_of() looks one up."""
    return F.struct(F.transform(all_of(tag, QUOTED, 1), F.lower).alias("names"), all_of(tag, QUOTED, 3).alias("values"))


def value_of(found: Column, name: str) -> Column:
    """The first value of that name, decoded; or empty."""
    return X.decode_entities(X.or_empty(F.get(found["values"], (F.array_position(found["names"], name) - 1).cast("int"))))


def named_tag(html: Column, tag: str, fragment: str) -> Column:
    """The first tag whose name or id holds the fragment."""
    return first_of(html, rf"(?is)<{tag}\b[^>]*(?:name|id)=[\"'][^\"']*{fragment}[^\"']*[\"'][^>]*>")


def hidden_value(html: Column, fragment: str) -> Column:
    return attribute(named_tag(html, "input", fragment), "value")


def select_body(html: Column, fragment: str) -> Column:
    return first_of(html, rf"(?is)<select\b[^>]*(?:name|id)=[\"'][^\"']*{fragment}[^\"']*[\"'][^>]*>(.*?)</select>", 1)


def options(html: Column, fragment: str) -> Column:
    """Array of (value, label) of a list's options; those with an empty value are left out."""
    tags = all_of(select_body(html, fragment), r"(?is)<option\b[^>]*value=[\"'][^\"']*[\"'][^>]*>.*?</option>")
    pair = lambda t: F.struct(X.strip(attribute(t, "value")).alias("value"), X.text_of_markup(F.regexp_extract(t, "(?is)>(.*)</option>", 1)).alias("label"))
    return F.filter(F.transform(tags, pair), lambda o: o["value"] != "")


def meeting_code(found: Column, session: str, number: str | int | None) -> Column:
    """Value of the first option of the session (four digits) whose label says so-manieth meeting; a session of eight digits is the code itself; or empty."""
    if len(session) == 8 and session.isdigit():
        return F.lit(session)
    if not str(number or "").strip().isdigit():
        return F.lit("")
    fits = lambda o: F.startswith(o["value"], F.lit(session[:4])) & o["label"].rlike(rf"第\s*{int(number)}\s*次")
    return F.coalesce(F.get(F.filter(found, fits), F.lit(0))["value"], F.lit(""))


def control_value(html: Column, fragment: str) -> Column:
    """The value that a form shows: of the list's selected option, or of the input."""
    chosen = lambda body: F.get(F.filter(all_of(body, r"(?is)<option\b[^>]*>"), lambda t: t.rlike(r"(?i)\bselected\b")), F.lit(0))
    shown = lambda body: F.when(body != "", attribute(chosen(body), "value")).otherwise(hidden_value(html, fragment))
    return X.strip(X.let(select_body(html, fragment), shown))


def form_fields(html: Column) -> Column:
    """Array of (name, value) that a form would send: inputs but buttons and unticked boxes, and lists' selected options. A tag's attributes are read once."""
    def field(tag: Column) -> Column:
        named = lambda a: F.struct(value_of(a, "name").alias("name"), F.lower(value_of(a, "type")).alias("type"), value_of(a, "value").alias("value"), tag.rlike(r"(?i)\bchecked\b").alias("ticked"))
        return X.let(attributes(tag), named)

    sent = lambda f: (f["name"] != "") & ~f["type"].isin("submit", "button", "image", "reset") & (~f["type"].isin("checkbox", "radio") | f["ticked"])
    pair = lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value"))
    inputs = lambda h: F.transform(F.filter(F.transform(all_of(h, r"(?is)<input\b[^>]*>"), field), sent), pair)
    chosen = lambda t: value_of(attributes(F.regexp_extract(t, r"(?is)(<option\b[^>]*\bselected\b[^>]*>)", 1)), "value")
    listed = lambda h: F.transform(all_of(h, r"(?is)<select\b[^>]*>.*?</select>"), lambda t: F.struct(value_of(attributes(F.regexp_extract(t, "(?s)^[^>]*>", 0)), "name").alias("name"), chosen(t).alias("value")))
    return X.let(html, lambda h: F.concat(inputs(h), F.filter(listed(h), lambda f: f["name"] != "")))


def pager(html: Column) -> Column:
    """Struct of total (only where just one is stated), page, pages and tab_counts."""
    counts = F.transform(all_of(html, rf"共[{X.SPACE}]*([0-9,]+)[{X.SPACE}]*筆", 1), lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("int"))
    pages = rf"([0-9]+)[{X.SPACE}]*/[{X.SPACE}]*([0-9]+)[{X.SPACE}]*頁"
    number = lambda k: first_of(html, pages, k).try_cast("int")  # noqa: E731 - no number is null
    return F.struct(X.let(counts, lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))).alias("total"), number(1).alias("page"), number(2).alias("pages"), counts.alias("tab_counts"))


def page_number(html: Column) -> Column:
    """The proposal's number that a page states: in its hidden field, else in its text; or empty."""
    hidden = first_of(named_tag(html, "input", "ProposalSN"), r"(?i)\bvalue\s*=\s*([\"'])([0-9]+)\1", 2)
    return X.let(hidden, lambda n: F.when(n != "", n).otherwise(first_of(X.text_of_escaped_markup(html), rf"(?:議案流水號|提案流水號)[{X.SPACE}]*[：:]?[{X.SPACE}]*([0-9]+)", 1)))


def exploded(pages: DataFrame, html: str, pattern: str, group: int, name: str, keep: list[str]) -> DataFrame:
    """A row for each match on a page, with `_pos` from 0 on."""
    return pages.select(*keep, F.posexplode(all_of(F.col(html), pattern, group)).alias("_pos", name))


def cells_of(row: Column, clean=X.text_of_markup, pattern: str = DATA_CELL) -> Column:
    return F.transform(all_of(row, pattern, 1), clean)


def proposals(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The proposals that list pages show: rows with a numeric hidden number and six cells at least. A number that a page shows twice keeps the later row at the earlier place."""
    rows = exploded(pages, html, ROW, 0, "_tr", [key]).where(F.col("_tr").rlike("(?i)hidProposalSN")).withColumn("proposal_sn", hidden_value(F.col("_tr"), "hidProposalSN")).withColumn("_c", cells_of(F.col("_tr")))
    rows = rows.where(F.col("proposal_sn").rlike("^[0-9]+$") & (F.size("_c") >= 6))
    link = first_of(F.col("_tr"), r"(?i)Detail\.aspx\?([^\"'\s<>]+)")
    cell = lambda k: F.get(F.col("_c"), F.lit(k))
    found = rows.select(
        key, "_pos", "proposal_sn", F.nullif(hidden_value(F.col("_tr"), "hidProposalKind"), F.lit("")).alias("proposal_kind"),
        F.when(link != "", X.decode_entities(link)).otherwise(F.concat(F.lit("Detail.aspx?s="), F.col("proposal_sn"))).alias("detail_url"), cell(1).alias("number"), cell(2).alias("category"),
        F.lit(None).cast("string").alias("councilor"), X.without_trailing_separators(cell(3)).alias("proposer"), F.lit("unknown").alias("proposer_type"), cell(4).alias("subject"), cell(5).alias("status"),
    )
    return keep_last(found, [key, "proposal_sn"])


def table_rows(pages: DataFrame, key: str, html: str, table_id: str | None = None, clean=X.text_of_escaped_markup) -> DataFrame:
    """key, table, _pos and cells of all rows of all tables (or of the one with the id) with a cell."""
    pattern = rf"(?is)<table\b[^>]*\bid=[\"']{table_id}[\"'][^>]*>(.*?)</table>" if table_id else TABLE
    tables = pages.select(key, F.posexplode(all_of(F.col(html), pattern, 1)).alias("table", "_t"))
    rows = tables.select(key, "table", F.posexplode(all_of(F.col("_t"), r"(?is)<tr\b[^>]*>(.*?)</tr>", 1)).alias("_pos", "_tr"))
    return rows.select(key, "table", "_pos", cells_of(F.col("_tr"), clean, CELL).alias("cells")).where(F.size("cells") > 0)


# What the first cells of a header row of a tab's table say, and the fields of its rows.
TAB_HEADER, TAB_FIELDS = ("編號", "類別", "提案議員"), ("number", "category", "councilor", "subject", "status", "remark")


def tab_rows(pages: DataFrame, key: str, html: str, tabs: dict[str, str]) -> DataFrame:
    """key, tab, _pos, TAB_FIELDS and link of the rows of each tab's table (tabs: its id by the tab's name): rows with four cells at least that are no header and do not say that there are none. A table that is not there, or says that it is empty, gives no row."""
    some = F.array(*[F.struct(F.lit(t).alias("tab"), X.let(first_of(F.col(html), rf"(?is)<table\b[^>]*\bid=[\"']{i}[\"'].*?</table>"), lambda x: F.when(~F.contains(x, F.lit(NO_ATTACHMENTS[0])), x)).alias("table")) for t, i in tabs.items()])
    rows = pages.select(key, F.explode(some).alias("t")).select(key, "t.tab", F.posexplode(all_of(F.col("t.table"), ROW)).alias("_pos", "_tr")).withColumn("_c", cells_of(F.col("_tr"), X.text_of_markup, r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"))
    cell = lambda k: X.or_empty(F.get("_c", F.lit(k)))
    header = F.lit(False)
    for k, name in enumerate(TAB_HEADER):
        header = header | (cell(k) == name)
    link = X.decode_entities(first_of(F.col("_tr"), r'(?i)href="([^"]+)"', 1))
    return rows.where((F.size("_c") >= 4) & ~header).select(key, "tab", "_pos", *[cell(k).alias(n) for k, n in enumerate(TAB_FIELDS)], link.alias("link"))


def tab_totals(pages: DataFrame, key: str, html: str, tabs: dict[str, str]) -> DataFrame:
    """key, tab, total and there (whether the page has the tab's table): the total that is stated between a tab's table and the next one's; null where none is, or several are."""
    starts = F.array_sort(F.filter(F.array(*[F.struct(F.instr(F.col(html), f'id="{i}"').alias("at"), F.lit(t).alias("tab")) for t, i in tabs.items()]), lambda s: s["at"] > 0))
    part = lambda s, k, all_: F.substring(F.col(html), s["at"], F.coalesce(F.get(all_, k + 1)["at"], F.length(html) + 1) - s["at"])
    found = pages.select(key, F.explode(X.let(starts, lambda all_: F.transform(all_, lambda s, k: F.struct(s["tab"].alias("tab"), pager(part(s, k, all_))["total"].alias("total"))))).alias("t"))
    every = pages.select(key, F.explode(F.array(*[F.lit(t) for t in tabs])).alias("tab"))
    return every.join(found.select(key, "t.tab", "t.total", F.lit(True).alias("there")), [key, "tab"], "left").withColumn("there", F.coalesce("there", F.lit(False)))


def tab_completeness(pages: DataFrame, key: str, html: str, tabs: dict[str, str]) -> DataFrame:
    """key, tab, there, returned_count, total_count and is_complete by tab: each tab's rows are held against its own total, so a page of two tabs has no unknown completeness."""
    counted = tab_rows(pages, key, html, tabs).groupBy(key, "tab").agg(F.count("*").alias("returned_count"))
    found = tab_totals(pages, key, html, tabs).join(counted, [key, "tab"], "left").withColumn("returned_count", F.coalesce("returned_count", F.lit(0)))
    return found.select(key, "tab", "there", "returned_count", F.col("total").alias("total_count"), (F.col("returned_count") >= F.col("total")).alias("is_complete"))


def label_values(rows: DataFrame, key: str, labels: tuple[str, ...] = DETAIL_LABELS) -> DataFrame:
    """key, label and value: a cell that is one of the labels takes the cell after it as its value; of a label's values the last on the page stays."""
    pairs = F.transform(F.col("cells"), lambda c, i: F.struct(X.label_of(c).alias("label"), F.get(F.col("cells"), i + 1).alias("value")))
    every = rows.select(key, F.struct("table", "_pos").alias("_row"), F.posexplode(F.filter(pairs, lambda p: p["label"].isin(*labels) & p["value"].isNotNull())).alias("_i", "_p"))
    found = every.select(key, F.struct("_row", "_i").alias("_pos"), F.col("_p.label").alias("label"), F.col("_p.value").alias("value"))
    return keep_last(found, [key, "label"]).drop("_pos")


def review_field(row: Column, marker: str, label: str, stops: tuple[str, ...]) -> Column:
    """What a row says after the label, up to the first stop; null where the row lacks the marker."""
    end = "|".join([*stops, "$"])
    raw = first_of(row, f"(?s){label}(.*?)(?:{end})", 1)
    value = F.regexp_replace(raw, rf"^[{X.SPACE}：:/]+|[{X.SPACE}：:/]+$", "")
    return F.when(F.contains(row, F.lit(marker)), X.let(value, lambda v: F.when(v.rlike(EMPTY_REVIEW), "").otherwise(v)))


def reviews(rows: DataFrame, key: str) -> DataFrame:
    """One row a page with its review fields; the last row that has a field's marker decides; or empty."""
    joined = rows.withColumn("_row", F.trim(F.array_join("cells", " "))).withColumn("_at", F.struct("table", "_pos"))
    fields = [(name, review_field(F.col("_row"), *how)) for name, how in REVIEW_FIELDS.items()]
    return joined.groupBy(key).agg(*[X.or_empty(F.max_by(c, F.when(c.isNotNull(), F.col("_at")))).alias(name) for name, c in fields])


def review_status(third: Column, third_date: Column, second: Column, second_date: Column, committee: Column, first: Column) -> Column:
    """decided, in_review or not_stated, by which fields are not empty."""
    some = lambda *cs: F.coalesce(F.nullif(F.concat_ws("", *cs), F.lit("")).isNotNull(), F.lit(False))
    return F.when(some(third, third_date, second, second_date), "decided").when(some(committee, first), "in_review").otherwise("not_stated")


def attachments(pages: DataFrame, key: str, html: str, base: str, header: str = "序號") -> DataFrame:
    """key, _pos, no, description, name, size and download_url of the files that pages list: rows with four cells but the header's. Refused when a page neither says that it has none nor shows any, or links to another host. Links are seen from base, the site's root."""
    marked = F.lit(False)
    for m in NO_ATTACHMENTS:
        marked = marked | F.contains(F.col(html), F.lit(m))
    shown = pages.where(~marked)
    rows = exploded(shown, html, r"(?is)<tr\b[^>]*>(.*?)</tr>", 1, "_tr", [key]).withColumn("_c", cells_of(F.col("_tr"), X.text_of_cell))
    cell = lambda k: F.get(F.col("_c"), F.lit(k))
    link = first_of(F.array_join(all_of(F.col("_tr"), DATA_CELL, 1), " "), r"(?i)<a\b[^>]*href=[\"']([^\"']+)[\"'][^>]*>", 1)
    url = F.when(link != "", urls.absolute(link, base))
    found = rows.where((F.size("_c") >= 4) & (cell(0) != header)).select(key, "_pos", cell(0).alias("no"), cell(1).alias("description"), cell(2).alias("name"), cell(3).alias("size"), url.alias("download_url"))
    host = base.split("/")[2]
    counted = found.groupBy(key).agg(F.count_if(F.col("download_url").isNotNull() & ~urls.on_host(F.col("download_url"), host)).alias("foreign"), F.count("*").alias("n"))
    bad = shown.select(key).join(counted, key, "left").where("n IS NULL OR foreign > 0").limit(1).collect()
    if bad:
        raise Refused("PARSER_CONTRACT_CHANGED", f"page {bad[0][0]} shows no attachment, or one of another host")
    return found


def meeting_records(pages: DataFrame, key: str, html: str, base: str, record_type: str = "議事錄") -> DataFrame:
    """record_id, meeting, date, record_type and pdf_url of rows that link to a PDF of the base's host under a numbered folder and have three cells at least."""
    rows = exploded(pages, html, ROW, 0, "_tr", [key]).withColumn("_href", first_of(F.col("_tr"), r"(?i)href=[\"']([^\"']+\.pdf(?:\?[^\"']*)?)[\"']", 1))
    cells = F.transform(all_of(F.col("_tr"), r"(?is)<t[dh][^>]*>.*?</t[dh]>"), X.text_of_simple_markup)
    path = X.decode_basic_entities(F.col("_href"))
    wanted = rows.where("_href <> ''").withColumn("_c", cells).withColumn("pdf_url", urls.absolute(path, base)).withColumn("record_id", first_of(path, r"(?i)MeetingRecord/([0-9]+)/", 1))
    wanted = wanted.where((F.size("_c") >= 3) & (F.col("record_id") != "") & urls.on_host(F.col("pdf_url"), base.split("/")[2]))
    return wanted.select(key, "_pos", "record_id", F.get("_c", F.lit(2)).alias("meeting"), F.get("_c", F.lit(1)).alias("date"), F.lit(record_type).alias("record_type"), "pdf_url")


def meeting_title(html: Column) -> Column:
    """The title of a detail page: of the element whose id says Meeting, else of the page's title; or empty."""
    span = X.text_of_escaped_markup(first_of(html, r"(?is)<span\b[^>]*id=[\"'][^\"']*Meeting[^\"']*[\"'][^>]*>(.*?)</span>", 1))
    return F.coalesce(F.nullif(span, F.lit("")), X.text_of_escaped_markup(first_of(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)))
