"""Parts of URLs, allow-lists of hosts, and relative URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def part(url: Column, name: str, key: str | None = None) -> Column:
    """PROTOCOL, HOST, PATH or QUERY (of a key); null where the URL is none or has no such part."""
    return F.try_parse_url(url, F.lit(name), F.lit(key)) if key else F.try_parse_url(url, F.lit(name))


def on_host(url: Column, host: str) -> Column:
    """True for https URLs of the host; false for anything else, nulls too. Of plain ones nothing is parsed."""
    parsed = F.coalesce((F.lower(part(url, "PROTOCOL")) == "https") & (F.lower(part(url, "HOST")) == host), F.lit(False))
    if not re.fullmatch(r"[a-z]+(?:\.[a-z]+)+", host):
        return parsed
    return F.coalesce(url.rlike(rf"^https://{re.escape(host)}/[A-Za-z0-9/._-]*\z"), F.lit(False)) | parsed


_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"  # scheme, authority with its slashes, path, query and fragment with their marks


def without_dots(path: Column) -> Column:
    """A path without its segments "." and "..": each ".." takes the segment before it away, and none goes above the root. A path that ends in such a segment ends in a slash."""
    parts = F.split(path, "/", -1)
    last = F.size(parts) - 1

    def step(kept: Column, x: Column) -> Column:
        up = F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        base = F.when(x["s"] == "..", up).otherwise(kept)
        return F.when(x["s"].isin(".", "..") & ~x["last"], base).otherwise(F.concat(base, F.array(F.when(x["s"].isin(".", ".."), "").otherwise(x["s"]))))

    items = F.transform(parts, lambda s, i: F.struct(s.alias("s"), (i == last).alias("last")))
    folded = F.aggregate(F.slice(items, F.lit(2), F.size(items)), F.array(F.lit("")), step, lambda kept: F.array_join(kept, "/"))
    return F.when(F.startswith(path, F.lit("/")) & path.rlike(r"/\.\.?(?:/|$)"), folded).otherwise(path)


def absolute(url: Column, base: str) -> Column:
    """url as seen from the page base, by the rules of RFC 3986 (5.2): absolute ones keep their own parts, "?" and "#" references keep the base's path, dot segments go. White space at the ends goes; null stays null."""
    scheme, authority, path, query = (re.match(_SPLIT, base)[k] or "" for k in (1, 2, 4, 5))
    folder = path[: path.rindex("/") + 1] if "/" in path else "/"
    here = F.lit(f"{scheme}:{authority}")
    names = ("scheme", "authority", "path", "query", "fragment")

    def resolved(ref: Column) -> Column:
        parts = F.struct(*[F.regexp_extract(ref, _SPLIT, k).alias(n) for n, k in zip(names, (1, 2, 4, 5, 6), strict=True)])
        parted = let(parts, lambda own: _resolved(*[own[n] for n in names], scheme, here, path, folder, query))
        if "/." in folder:
            return parted
        # a reference beside the base, without a colon or dot segments, is just what follows the folder
        return F.when(ref.rlike(r"^(?![^?#]*(?:/\.|:))[^/?#.]"), F.concat(here, F.lit(folder), ref)).otherwise(parted)

    return let(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), resolved)


def _resolved(own_scheme: Column, own_authority: Column, own_path: Column, own_query: Column, fragment: Column, scheme: str, here: Column, path: str, folder: str, query: str) -> Column:
    """A reference's parts as seen from a base's."""
    whole = F.concat(own_scheme, F.lit(":"), own_authority, without_dots(own_path), own_query, fragment)
    elsewhere = F.concat(F.lit(f"{scheme}:"), own_authority, without_dots(own_path), own_query, fragment)
    rooted = F.concat(here, without_dots(own_path), own_query, fragment)
    beside = F.concat(here, without_dots(F.concat(F.lit(folder), own_path)), own_query, fragment)
    same = F.concat(here, F.lit(path), F.when(own_query != "", own_query).otherwise(query), fragment)
    return F.when(own_scheme != "", whole).when(own_authority != "", elsewhere).when(own_path == "", same).when(F.startswith(own_path, F.lit("/")), rooted).otherwise(beside)


def record_id(url: Column, host: str, folder: str = "MeetingRecord") -> Column:
    """The number after the folder in the path of an https URL of the host; or empty."""
    return F.when(on_host(url, host), F.regexp_extract(part(url, "PATH"), rf"/{folder}/([0-9]+)/", 1)).otherwise("")


def encode(text: Column) -> Column:
    """Percent-encoded, a blank as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
