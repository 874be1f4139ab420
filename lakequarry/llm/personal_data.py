r"""Personal data in texts: patterns propose spans, checksums confirm them, context words move their scores. DataFrame functions only; no shuffle.

Base kinds are email, ip, card (Luhn) and phone; further kinds are iban (mod-97), ssn and tel (a telephone number without a country's code). A pattern's matches are leftmost and do not
overlap within a kind; one that fails its checks is dropped without another try. A span's score is its kind's prior, plus CONTEXT if a word that speaks for the kind stands within the 40
characters before it, less CONTEXT if one that speaks against it does. Base spans always stay, their score is information; a span of a further kind stays from LEAST on. So an ssn or a
tel needs a word, and an iban that passes mod-97 does not.

Patterns are possessive and start only where a run of their characters starts or the match before ended (\G), so that a long run without a match is read once and no group recurses. That changes no match.
Places are cumulative sums over the gaps between matches, taken in runs of 256 matches, so that texts with very many matches stay far from quadratic.

Defined results: a null text is an empty one and has no spans; starts and ends are code points, the end exclusive. Spans of different kinds may overlap. Texts of any length are read whole, within their row. Equal rows
give equal results. An empty table gives an empty one. Columns of any names are carried, but `personal`, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table, whole_text

# Fixed values of the contract: the base kinds in their order, with their patterns in plain form.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "tel": r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
}
BASE = ("email", "ip", "card", "phone")
#: The same matches, found without going back.
FAST = PLAIN | {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
}
#: A text without this holds no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
PRIOR = {"email": 90, "ip": 60, "card": 80, "phone": 70, "iban": 90, "ssn": 40, "tel": 30}
CONTEXT, LEAST, REACH = 30, 60, 40
FOR = {
    "email": "e-?mail|mail|contact|write", "ip": "ip|address|host|client|from", "card": "card|visa|mastercard|amex|credit|debit|payment", "phone": "tel|phone|call|mobile|fax|telefon|teléfono|téléphone",
    "iban": "iban|bank|account|konto|cuenta|compte", "ssn": "ssn|social|security|taxpayer", "tel": "tel|phone|call|mobile|fax|telefon|teléfono|téléphone",
}
AGAINST = {
    "email": "example|dummy", "ip": "version|release|build|section", "card": "order|invoice|isbn|tracking|serial", "phone": "order|invoice|serial", "iban": "part|serial|sku", "ssn": "part|order|serial|invoice", "tel": "order|invoice|part|serial|isbn",
}
RUN = 256


def _placed(items: Column, at: Column) -> Column:
    """(start, end, match) of items (gap, size, match) that begin at a place."""
    zero = F.struct(at.alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        return F.struct((start + x["size"]).alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["match"].alias("match")))).alias("out"))

    return F.aggregate(items, zero, step, lambda s: s["out"])


def proposed(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of the pattern's matches, leftmost and without overlaps."""
    def places(items: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / RUN).cast("int")), lambda k: F.slice(items, k * RUN + 1, RUN))
        sums = lambda runs: F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x["gap"] + x["size"]))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        before = lambda lengths: F.aggregate(lengths, zero, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        return let(runs, lambda own: F.flatten(F.zip_with(own, before(sums(own)), _placed)))

    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    item = lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("match"))
    return let(matches, lambda found: let(F.zip_with(found, F.slice(gaps, 1, F.size(found)), item), places))


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn checksum."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod_97(code: Column) -> Column:
    """Whether a code of letters A-Z and digits leaves 1 by 97, its first four characters put last and letters read as 10 to 35."""
    value = lambda c: F.ascii(c) - F.when(c <= "9", 48).otherwise(55)
    turned = F.split(F.concat(F.substr(code, F.lit(5)), F.left(code, F.lit(4))), "")
    return F.aggregate(F.transform(turned, value), F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _valid(kind: str, text: Column, m: Column) -> Column:
    match = m["match"]
    n_digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    before, after = F.when(m["start"] > 0, F.substring(text, m["start"], F.lit(1))).otherwise(""), F.substring(text, m["end"] + 1, F.lit(1))
    apart = ~before.rlike("[A-Za-z0-9+(.-]") & ~after.rlike("[A-Za-z0-9-]")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return n_digits.between(12, 19) & luhn(F.regexp_replace(match, "[ -]", ""))
    if kind == "phone":
        return n_digits.between(9, 15)
    if kind == "iban":
        code = F.replace(match, F.lit(" "), F.lit(""))
        return apart & F.length(code).between(15, 34) & mod_97(code)
    if kind == "ssn":
        return apart & ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "tel":
        return apart & ~(F.when(m["start"] > 1, F.substring(text, m["start"] - 1, F.lit(2))).otherwise("").rlike("[0-9)][ ]"))
    return F.lit(True)


def _words(words: str) -> str:
    return rf"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)"


def _score(kind: str, text: Column, m: Column) -> Column:
    start = F.greatest(m["start"] - REACH, F.lit(0))
    near = F.lower(F.substring(text, start + 1, m["start"] - start))
    return F.lit(PRIOR[kind]) + F.when(near.rlike(_words(FOR[kind])), CONTEXT).otherwise(0) - F.when(near.rlike(_words(AGAINST[kind])), CONTEXT).otherwise(0)


def spans_of(kind: str, text: Column) -> Column:
    """Array of (start, rank, end, kind, score) of a kind's spans that stay; rank: the kind's place in the order."""
    span = "array<struct<start:int,rank:int,end:int,kind:string,score:int>>"
    made = lambda m: F.struct(m["start"].alias("start"), F.lit(list(PLAIN).index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), _score(kind, text, m).alias("score"))
    found = F.transform(F.filter(proposed(text, FAST[kind]), lambda m: _valid(kind, text, m)), made)
    if kind not in BASE:
        found = F.filter(found, lambda s: s["score"] >= LEAST)
    there = F.contains(text, F.lit(NEEDS[kind])) & text.rlike(FAST[kind]) if kind in NEEDS else text.rlike(FAST[kind])
    return F.when(there, found.cast(span)).otherwise(F.array().cast(span))


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal: array of (start, rank, end, kind, score) by start, then kind."""
    columns = [c for c in docs.columns if c != "personal"]
    read = docs.select(F.struct(*columns).alias("row"), whole_text(text).alias("whole"))
    kinds = read.select("row", *[spans_of(kind, F.col("whole")).alias(kind) for kind in PLAIN])
    return kinds.select("row.*", F.array_sort(F.concat(*PLAIN)).alias("personal"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span as its kind in brackets; of spans that overlap the first counts."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        put = F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.concat(F.lit("["), x["kind"], F.lit("]"))))
        ahead = x["start"] >= s["at"]
        return F.struct(F.when(ahead, x["end"]).otherwise(s["at"]).alias("at"), F.when(ahead, put).otherwise(s["out"]).alias("out"))

    return F.aggregate(spans, zero, step, lambda s: F.array_join(F.concat(s["out"], F.array(F.substr(text, s["at"] + 1))), ""))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.filter("personal", lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in PLAIN]
    base = F.filter("personal", lambda s: s["rank"] < len(BASE))
    scores = F.array_join(F.transform("personal", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *counts[: len(BASE)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("personal")).alias("spans"), *counts[len(BASE) :], scores.alias("scores"))


def _sql_kind(kind: str) -> str:
    """SELECT of doc_id, start, rank, end, kind and score of a kind's spans, from d (doc_id, text)."""
    digits, before, after = "regexp_replace(m, '[^0-9]', '', 'g')", "CASE WHEN s > 0 THEN substring(text, s, 1) ELSE '' END", "substring(text, s + length(m) + 1, 1)"
    apart = f"NOT regexp_matches({before}, '[A-Za-z0-9+(.-]') AND NOT regexp_matches({after}, '[A-Za-z0-9-]')"
    code = "replace(m, ' ', '')"
    chars = f"string_split(substring({code}, 5) || substring({code}, 1, 4), '')"
    valid = {
        "ip": "len(list_filter(string_split(m, '.'), lambda p: coalesce(TRY_CAST(p AS INTEGER) > 255, true))) = 0",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN CAST({digits}[i] AS INTEGER) ELSE CAST({digits}[i] AS INTEGER) * 2 - CASE WHEN CAST({digits}[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"{apart} AND length({code}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform({chars}, lambda c: ascii(c) - CASE WHEN c <= '9' THEN 48 ELSE 55 END)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1",
        "ssn": f"{apart} AND NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$')",
        "tel": f"{apart} AND NOT regexp_matches(CASE WHEN s > 1 THEN substring(text, s - 1, 2) ELSE '' END, '[0-9)][ ]')",
    }.get(kind, "true")
    near = f"lower(substring(text, greatest(s - {REACH}, 0) + 1, s - greatest(s - {REACH}, 0)))"
    score = f"{PRIOR[kind]} + CASE WHEN regexp_matches({near}, '{_words(FOR[kind])}') THEN {CONTEXT} ELSE 0 END - CASE WHEN regexp_matches({near}, '{_words(AGAINST[kind])}') THEN {CONTEXT} ELSE 0 END"
    lengths = lambda x, upto: f"coalesce(list_sum(list_transform({x}[:{upto}], lambda y: length(y))), 0)"
    return f"""SELECT * FROM (SELECT doc_id, CAST(s AS INTEGER) AS s, {list(PLAIN).index(kind)} AS rank, CAST(s + length(m) AS INTEGER) AS e, '{kind}' AS kind, {score} AS score
 FROM (SELECT doc_id, text, ms[i] AS m, CAST({lengths("gs", "i")} + {lengths("ms", "i - 1")} AS BIGINT) AS s FROM (SELECT *, regexp_extract_all(text, '{PLAIN[kind]}') AS ms, string_split_regex(text, '{PLAIN[kind]}') AS gs FROM d), unnest(range(1, len(ms) + 1)) u(i)) WHERE {valid}) WHERE {"true" if kind in BASE else f"score >= {LEAST}"}"""


SQL = f"""WITH d AS (SELECT row_number() OVER () AS row, * FROM (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents)), r AS ({" UNION ALL ".join(f"({_sql_kind(k)})" for k in PLAIN).replace("doc_id", "row")}),
a AS (SELECT row, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in PLAIN)}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank < {len(BASE)}) AS base,
 string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, rank, e) AS scores FROM r GROUP BY row)
SELECT id AS doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in PLAIN)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN a USING (row)"""

QUERIES = {"op12_personal_data": op12_personal_data}
ORACLES = {"op12_personal_data": SQL}
