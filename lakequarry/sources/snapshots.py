"""Verified snapshots: a pointer names a manifest by hash, the manifest names the data by hash; anything that does not fit is refused.

Layout below a root folder (any file system that Spark reads):

    releases/{dataset}/active.json                     manifest_key, manifest_sha256
    verified/{dataset}/{snapshot}/manifest.json        the manifest
    verified/{dataset}/{snapshot}/normalized.json      a JSON array of records

A large snapshot has `parts` in its manifest instead of one array: objects of JSON lines with a sha256 and a record_count each. They are hashed on the executors, a file a task, and joined to what is declared.
The pointer is read at every call, so a revocation is never hidden by a cache. Checks are jobs of their own; they cannot be optimised away.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..errors import Refused
from ..functions.text import filled
from ..functions.urls import on_host, part
from ..operators.keyed import require_rows
from . import delimited, order, results
from .cache import Versioned, hold

LAW = "law_id string, law_name string, category string, published_at string, official_url string, history string, articles array<struct<article_no:string,content:string>>"
NEWS = "news_id string, title string, agency string, category string, published_at string, content_summary string, source_link string"
RECORD = "record_id string, pdf_url string, total_pages int, pages array<struct<page:int,text:string>>, cached_at string"


@dataclass(frozen=True)
class Snapshot:
    records: DataFrame  # with _pos, the place in the source
    manifest: dict


def read_object(spark: SparkSession, root: str, key: str) -> str:
    try:
        row = spark.read.text(f"{root}/{key}", wholetext=True).first()
    except AnalysisException as e:
        raise Refused("SNAPSHOT_UNVERIFIED", f"there is no {key}") from e
    return row.value if row else ""


def parsed(value: str, key: str) -> dict:
    try:
        found = json.loads(value)
    except ValueError as e:
        raise Refused("SNAPSHOT_UNVERIFIED", f"{key} is no JSON") from e
    if not isinstance(found, dict):
        raise Refused("SNAPSHOT_UNVERIFIED", f"{key} is no JSON object")
    return found


def is_hash(value) -> bool:
    return isinstance(value, str) and len(value) == 64 and all(c in "0123456789abcdefABCDEF" for c in value)


def is_safe_key(key, dataset: str) -> bool:
    return isinstance(key, str) and key.startswith(f"verified/{dataset}/") and ".." not in key


def read_time(value) -> datetime | None:
    try:
        found = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    except ValueError:
        return None
    return found if found.tzinfo else found.replace(tzinfo=datetime.now().astimezone().tzinfo)


def check_manifest(m: dict, dataset: str, manifest_key: str, revoked: Iterable[str]) -> None:
    """Refuses a manifest at its first rule that fails."""
    fetched, validated = read_time(m.get("fetched_at")), read_time(m.get("validated_at"))
    filled = lambda name: isinstance(m.get(name), str) and m[name] != ""
    coverage = m.get("coverage")
    rules = (
        (m.get("dataset_id") == dataset and filled("snapshot_id"), "UNVERIFIED", "has another identity"),
        (m.get("revoked") is not True, "REVOKED", "is revoked"),
        (m.get("validation_status") == "passed", "UNVERIFIED", "has not passed validation"),
        (m.get("schema_version") == "2.0" and filled("parser_version") and filled("validator_version") and fetched and validated, "UNVERIFIED", "lacks versions or times"),
        (bool(fetched and validated) and validated >= fetched, "UNVERIFIED", "was validated before it was fetched"),
        (is_safe_key(m.get("normalized_key"), dataset) and is_hash(m.get("normalized_sha256")), "UNVERIFIED", "names no data"),
        (all(f"/{m.get('snapshot_id')}/" in str(k) for k in (manifest_key, m.get("normalized_key"))), "UNVERIFIED", "has keys of another snapshot"),
        (str(m.get("normalized_sha256")).lower() not in {h.lower() for h in revoked}, "REVOKED", "is on the deny-list"),
        (isinstance(coverage, dict) and isinstance(coverage.get("scope"), str) and isinstance(coverage.get("complete"), bool), "UNVERIFIED", "does not state its coverage"),
    )
    for holds, code, what in rules:
        if not holds:
            raise Refused(f"SNAPSHOT_{code}", f"the snapshot of {dataset} {what}")


def _array_records(spark: SparkSession, root: str, m: dict, schema: StructType) -> DataFrame:
    try:
        delimited.refuse_large(spark, f"{root}/{m['normalized_key']}", "declare it in parts in the manifest", delimited.MOST_JSON)
        text = spark.read.text(f"{root}/{m['normalized_key']}", wholetext=True)
        head = text.select(F.sha2("value", 256).alias("hash"), F.json_array_length("value").alias("n")).first()
    except AnalysisException as e:
        raise Refused("SNAPSHOT_UNVERIFIED", f"there is no {m['normalized_key']}") from e
    if head is None or head["hash"] != m["normalized_sha256"].lower():
        raise Refused("SNAPSHOT_UNVERIFIED", "the data differ from their hash")
    if type(m.get("record_count")) is not int or head["n"] != m["record_count"]:
        raise Refused("SNAPSHOT_UNVERIFIED", "the data have another number of records")
    return text.select(F.posexplode(F.from_json("value", ArrayType(schema))).alias("_pos", "r")).select(F.col("_pos").cast("long"), "r.*")


def _part_records(spark: SparkSession, root: str, m: dict, dataset: str, schema: StructType) -> DataFrame:
    """Records of all parts with _pos in the manifest's order of parts and each part's order of lines."""
    parts = m["parts"]
    if not all(isinstance(p, dict) and is_safe_key(p.get("key"), dataset) and is_hash(p.get("sha256")) and type(p.get("record_count")) is int for p in parts):
        raise Refused("SNAPSHOT_UNVERIFIED", "a part is not declared whole")
    if len({p["key"] for p in parts}) < len(parts):
        raise Refused("SNAPSHOT_UNVERIFIED", "a part is declared twice")
    if listing_hash(p["sha256"].lower() for p in parts) != m["normalized_sha256"].lower() or sum(p["record_count"] for p in parts) != m.get("record_count"):
        raise Refused("SNAPSHOT_UNVERIFIED", "the parts differ from their hash or count")
    declared = spark.createDataFrame([(p["key"], p["sha256"].lower(), p["record_count"], n) for n, p in enumerate(parts)], "key string, hash string, declared long, part long")
    paths, top = [f"{root}/{p['key']}" for p in parts], order.qualified(spark, root)
    try:
        hashed = spark.read.format("binaryFile").load(paths).select(order.decoded(F.col("_metadata.file_path")).alias("_file"), F.sha2("content", 256).alias("own")).select(order.below(top).alias("key"), "own")
        lines = order.marked(spark.read.text(paths))
    except AnalysisException as e:
        raise Refused("SNAPSHOT_UNVERIFIED", "a part is missing") from e
    splits = hold(order.parts_of(lines).withColumn("key", order.below(top)))
    counts = splits.groupBy("key").agg(F.sum("n").alias("lines"))  # Spark gives no row for a file without bytes
    same = (F.coalesce("own", F.lit(hashlib.sha256().hexdigest())) == F.col("hash")) & (F.coalesce("lines", F.lit(0)) == F.col("declared"))
    if not declared.join(hashed, "key", "left").join(counts, "key", "left").where(~F.coalesce(same, F.lit(False))).isEmpty():
        splits.unpersist()
        raise Refused("SNAPSHOT_UNVERIFIED", "a part differs from its hash or count")
    ordered = order.numbered(lines, splits.join(declared.select("key", "part"), "key").drop("key"), "part")
    return ordered.select("_pos", F.from_json("value", schema).alias("r")).select("_pos", "r.*")


def listing_hash(hashes: Iterable[str]) -> str:
    """The hash of a snapshot in parts: of its parts' hashes, one a line."""
    return hashlib.sha256("\n".join(hashes).encode()).hexdigest()


def publish(records: DataFrame, root: str, dataset: str, snapshot: str, by: list[str], about: dict, rows_a_part: int = 1_000_000, ordered: bool = False) -> str:
    """Writes records as a snapshot in parts, in the order of the columns `by`, and makes it the active one; returns its hash.

    Executors write, hash and count the parts, of rows_a_part records at most; the driver sees a line for each part. about: what else the manifest says (times, versions, coverage, source_url). The pointer is written last, so a failed write leaves
    the snapshot before it active. ordered: the records are dealt and sorted by `by` already, so that what they are computed from was sampled and not they themselves. Without columns no order is asked: the records are written where they are read and nothing is shuffled.
    """
    spark, folder = records.sparkSession, f"verified/{dataset}/{snapshot}"
    ranged = records if ordered or not by else records.repartitionByRange(*by).sortWithinPartitions(*by)
    results.json_rows(ranged.drop("_pos")).write.option("maxRecordsPerFile", rows_a_part).text(f"{root}/{folder}/parts")
    top = order.qualified(spark, root)
    files = spark.read.format("binaryFile").load(f"{root}/{folder}/parts").select(order.decoded(F.col("_metadata.file_path")).alias("_file"), F.sha2("content", 256).alias("sha256"))
    lines = order.parts_of(order.marked(spark.read.text(f"{root}/{folder}/parts"))).groupBy("_file").agg(F.sum("n").alias("n"))
    listed = files.join(lines, "_file", "left").select(order.below(top).alias("key"), "sha256", F.coalesce("n", F.lit(0)).alias("n")).orderBy("key").collect()  # a row a part
    parts = [{"key": p.key, "sha256": p.sha256, "record_count": p.n} for p in listed]
    key, digest = f"{folder}/manifest.json", listing_hash(p["sha256"] for p in parts)
    manifest = json.dumps({"schema_version": "2.0", "dataset_id": dataset, "snapshot_id": snapshot, "normalized_key": f"{folder}/parts", "normalized_sha256": digest, "validation_status": "passed", "revoked": False, "record_count": sum(p["record_count"] for p in parts), "parts": parts} | about)
    results.put_text(spark, f"{root}/{key}", manifest)
    results.put_text(spark, f"{root}/releases/{dataset}/active.json", json.dumps({"manifest_key": key, "manifest_sha256": hashlib.sha256(manifest.encode()).hexdigest()}))
    return digest


def new_cache() -> Versioned:
    """A cache for load(): the verified snapshot of each dataset, until its pointer names another manifest."""
    return Versioned(lambda snapshot: snapshot.records.unpersist())


def load(spark: SparkSession, root: str, dataset: str, schema: str, revoked: Iterable[str] = (), check: Callable[[DataFrame], None] | None = None, cache: Versioned | None = None, scope: tuple = ()) -> Snapshot:
    """The active snapshot of a dataset, once every check has passed. revoked: hashes of data that must not be served.

    check: refuses records that break a rule of the dataset. With a cache, data whose manifest is the one they were verified under are not hashed and checked again; scope: what else the check depends on.
    """
    kind = StructType.fromDDL(schema)
    pointer_key = f"releases/{dataset}/active.json"
    pointer = parsed(read_object(spark, root, pointer_key), pointer_key)
    key, wanted = pointer.get("manifest_key"), pointer.get("manifest_sha256")
    if not is_safe_key(key, dataset) or not is_hash(wanted):
        raise Refused("SNAPSHOT_UNVERIFIED", f"the pointer of {dataset} names no manifest")
    text = read_object(spark, root, key)
    if hashlib.sha256(text.encode()).hexdigest() != wanted.lower():
        raise Refused("SNAPSHOT_UNVERIFIED", f"the manifest of {dataset} differs from its hash")
    manifest = parsed(text, key)
    check_manifest(manifest, dataset, key, revoked)

    def verified() -> Snapshot:
        records = _part_records(spark, root, manifest, dataset, kind) if manifest.get("parts") else _array_records(spark, root, manifest, kind)
        records = records if cache is None else hold(records)
        if check:
            try:
                check(records)
            except Exception:
                if cache is not None:
                    records.unpersist()  # what is refused is not kept
                raise
        return Snapshot(records, manifest)

    return verified() if cache is None else cache.get((root, dataset, *scope), wanted.lower(), verified)


def _filled(*columns: str) -> Column:
    verdict = F.lit(True)
    for c in columns:
        verdict = verdict & filled(F.col(c))
    return verdict


def load_laws(spark: SparkSession, root: str, host: str, revoked: Iterable[str] = (), cache: Versioned | None = None) -> Snapshot:
    """Laws, each with its fields, a non-blank article at least, and a URL of the host that carries its id."""
    articles = (F.size("articles") > 0) & F.forall("articles", lambda a: filled(a["article_no"]) & filled(a["content"]))
    valid = _filled("law_id", "law_name", "category", "published_at", "official_url") & articles & on_host(F.col("official_url"), host) & (part(F.col("official_url"), "QUERY", "id") == F.col("law_id"))
    return load(spark, root, "laws", LAW, revoked, lambda rows: require_rows(rows, valid, "law_id", "SNAPSHOT_UNVERIFIED", "laws"), cache, (host,))


def load_news(spark: SparkSession, root: str, host: str, path: str, revoked: Iterable[str] = (), cache: Versioned | None = None) -> Snapshot:
    """News, newest first by published_ts, each with its fields and a URL of the host and path that has an s parameter."""
    link = F.col("source_link")
    valid = _filled("news_id", "title", "agency", "category", "published_at", "content_summary", "source_link") & on_host(link, host) & (part(link, "PATH") == path) & part(link, "QUERY", "s").isNotNull()
    found = load(spark, root, "news", NEWS, revoked, lambda rows: require_rows(rows, valid, "news_id", "SNAPSHOT_UNVERIFIED", "news"), cache, (host, path))
    return Snapshot(found.records.withColumn("published_ts", F.try_to_timestamp("published_at")), found.manifest)


def load_record(spark: SparkSession, root: str, record_id: str) -> DataFrame | None:
    """A stored record of pages; None where there is none. One that is broken or another record is refused, never taken as missing."""
    from ..operators.paged import require_complete

    try:
        text = spark.read.text(f"{root}/meeting_records/{record_id}.json", wholetext=True)
    except AnalysisException:
        return None
    found = text.select(F.from_json("value", StructType.fromDDL(RECORD)).alias("r")).select("r.*")
    row = found.select("record_id").first()
    if row is None or row.record_id != record_id:
        raise Refused("CACHE_CONTRACT_INVALID", f"the stored record {record_id} is broken or another one")
    return require_complete(found)


def load_records(spark: SparkSession, root: str, record_ids: list[str]) -> DataFrame:
    """Those of the records (numbers) that are stored and whole, read in one scan; the others have no row."""
    from ..operators.paged import complete

    schema = StructType.fromDDL(RECORD)
    nothing = spark.createDataFrame([], schema)
    if not record_ids:
        return nothing
    try:
        text = spark.read.text(f"{root}/meeting_records/{{{','.join(record_ids)}}}.json", wholetext=True)
    except AnalysisException:  # none of them is stored
        return nothing
    found = text.select(F.regexp_extract(F.input_file_name(), "([^/]+)[.]json$", 1).alias("_file"), F.from_json("value", schema).alias("r")).select("_file", "r.*")
    return found.where(complete() & F.coalesce(F.col("record_id") == F.col("_file"), F.lit(False))).drop("_file")
