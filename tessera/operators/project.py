"""Projections and column processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import TYPE_DEFAULTS


def project(df: DataFrame, fields: list[str] | None = None, always: tuple[str, ...] = ("id", "score")) -> DataFrame:
    """Key, score and the fields asked for, each once; none given means all; an unknown one is an error."""
    if fields is None:
        return df
    if bad := [f for f in fields if f not in df.columns]:
        raise ValueError(f"unknown fields: {bad}")
    return df.select(*dict.fromkeys([*(c for c in always if c in df.columns), *fields]))


def backfill_defaults(df: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """Every declared column; missing columns and null values get the declared default, else that of the type
    (null for types without one). Undeclared columns stay."""
    defaults = defaults or {}
    def value(f):
        given = defaults.get(f.name, TYPE_DEFAULTS.get(type(f.dataType)))
        own = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        return own if given is None else F.coalesce(own, F.lit(given).cast(f.dataType))

    return df.withColumns({f.name: value(f) for f in schema})


def geo(text: str | Column) -> Column:
    """Struct of lon and lat of 'lon,lat'; null unless both are numbers within ±180 and ±90."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(text, ",")
    lon, lat = (F.get(parts, F.lit(i)).try_cast("double") for i in (0, 1))
    ok = (F.size(parts) == 2) & lon.between(-180, 180) & lat.between(-90, 90)
    return F.when(ok, F.struct(lon.alias("lon"), lat.alias("lat")))


def validated(df: DataFrame, required: list[str] = (), times: list[str] = (), geos: list[str] = ()) -> DataFrame:
    """`reasons`, an array of what is wrong with each row: required values missing, times that aren't ISO,
    places out of bounds. Rows without one are good."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in required]
    checks += [F.when(F.col(c).isNotNull() & F.try_to_timestamp(F.col(c)).isNull(), F.lit(f"{c} is no time")) for c in times]
    checks += [F.when(F.col(c).isNotNull() & geo(c).isNull(), F.lit(f"{c} is no place")) for c in geos]
    return df.withColumn("reasons", F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"))


def split_valid(df: DataFrame, **rules) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with reasons."""
    checked = validated(df, **rules)
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def to_index_types(df: DataFrame, times: list[str] = (), geos: list[str] = (), lists: list[str] = ()) -> DataFrame:
    """ISO times to epoch milliseconds, places to `<name>_lon` and `<name>_lat`, 'a;b' to arrays."""
    new = {c: F.unix_millis(F.try_to_timestamp(F.col(c).cast("string"))) for c in times}
    new |= {f"{c}_{part}": geo(c)[part] for c in geos for part in ("lon", "lat")}
    new |= {c: F.filter(F.split(c, ";"), lambda x: x != "") for c in lists}
    return df.withColumns(new)


def sanitize_text(raw: str) -> Column:
    """P5: text of bytes; ill-formed sequences become U+FFFD."""
    return F.make_valid_utf8(F.col(raw).cast("string"))


def record_id(account: Column, uri: Column, level: Column) -> Column:
    """md5 of account and uri; levels 0 and 1 add their file name unless the uri has it; other levels count as 2."""
    seed = uri
    for n, name in ((0, "/.abstract.md"), (1, "/.overview.md")):
        seed = F.when((level == n) & ~uri.endswith(name), F.concat(uri, F.lit(name))).otherwise(seed)
    return F.md5(F.concat_ws(":", account, seed).cast("binary"))


def rewrite_scope(df: DataFrame, source: str, target: str, move: bool, now: Column | None = None) -> DataFrame:
    """The rows of a subtree under another root: the uri itself, below it, or a `#` part of it, never a sibling
    with the same beginning. A copy starts its times and counter anew; a move keeps them."""
    source, target = source.rstrip("/"), target.rstrip("/")
    uri = F.col("uri")
    inside = (uri == source) | uri.startswith(source + "/") | uri.startswith(source + "#")
    new_uri = F.concat(F.lit(target), F.substr(uri, F.lit(len(source) + 1)))
    changes = {"uri": new_uri, "parent_uri": F.regexp_replace(new_uri, "/[^/]*$", ""), "id": record_id(F.col("account_id"), new_uri, F.col("level"))}
    if not move:
        now = now if now is not None else F.current_timestamp()
        changes |= {"updated_at": now, "active_count": F.lit(0).cast("long")} | ({"created_at": now} if "created_at" in df.columns else {})
    return df.where(inside).withColumns(changes)


def skill_root(uri: Column) -> Column:
    """Root of the package that a uri belongs to (the segment after `skills`), '' if hidden or none."""
    found = F.regexp_extract(uri, r"^(.*?/skills/([^/#]+))(?:[/#].*)?$", 1)
    return F.when(F.regexp_extract(found, r"/skills/([^/]+)$", 1).startswith("."), "").otherwise(found)


#: Substring of a uri and its category; the first that fits counts.
CATEGORIES = (("/preferences", "preferences"), ("/entities", "entities"), ("/events", "events"), ("/cases", "cases"), ("/patterns", "patterns"), ("/profile", "profile"), ("/tools", "tools"), ("/skills", "skills"))


def category_of(uri: Column) -> Column:
    """Category by the first substring that the uri contains, else null."""
    out = F.lit(None).cast("string")
    for part, name in reversed(CATEGORIES):
        out = F.when(uri.contains(part), name).otherwise(out)
    return out


def _safe(text: Column) -> Column:
    encoded = F.concat(F.lit("ext-"), F.rtrim(F.translate(F.base64(text.cast("binary")), "+/\r\n", "-_"), F.lit("=")))
    return F.when(text.rlike(r"[^\x00-\x7F]"), encoded).otherwise(F.regexp_replace(text, "[^A-Za-z0-9._-]", "-"))


def session_key(prefix: str, harness: Column, native: Column) -> Column:
    """P10: id of a session; characters that aren't safe become `-`, text that isn't ASCII its base64."""
    return F.concat_ws("__", F.lit(prefix), _safe(harness), _safe(native))


def peer_key(harness: Column, model: Column, provider: Column | None = None) -> Column:
    """P10: id of the assistant on the other side, harness__provider__model: components lose what isn't safe, runs of `-`
    and `-` or `.` at their ends; empty ones are left out, a missing model is `unknown`."""
    part = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9_.@-]+", "-"), "-{2,}", "-"), "^[-.]+|[-.]+$", "")
    named = lambda c: F.when(part(c) != "", part(c))
    last = F.when(F.coalesce(model, F.lit("")) == "", "unknown").otherwise(named(model))
    return F.concat_ws("__", named(harness), *([] if provider is None else [named(provider)]), last)


def usage_event_id(*parts: Column) -> Column:
    """Idempotent key of an event: the sha256 of the JSON array of its identity."""
    return F.concat(F.lit("ue_"), F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256))


