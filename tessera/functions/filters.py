"""Predicates: each function returns one Column, so Catalyst pushes what it can to the scan.

`compile_filter` turns the JSON form `{"op": ..., ...}` into a Column with the same functions.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime, time, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CONTEXT_TYPES

METRES_A_DEGREE = 111_320


def _col(field: str | Column) -> Column:
    return F.col(field) if isinstance(field, str) else field


def all_of(conditions: list[Column | None]) -> Column:
    """conjunction; None and an empty list don't restrict."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    """disjunction; an empty list matches nothing."""
    return reduce(or_, conditions, F.lit(False))


def eq(field: str, value, is_list: bool = False) -> Column:
    """equality, or membership in a list field."""
    return F.array_contains(_col(field), value) if is_list else _col(field) == F.lit(value)


def one_of(field: str, values: list, is_list: bool = False) -> Column:
    """any of the values; for a list field any overlap. No values match nothing."""
    if not values:
        return F.lit(False)
    return F.arrays_overlap(_col(field), F.array(*map(F.lit, values))) if is_list else _col(field).isin(*values)


def none_of(field: str, values: list, is_list: bool = False) -> Column:
    """complement of F4; rows with null pass."""
    return ~F.coalesce(one_of(field, values, is_list), F.lit(False))


def in_range(field: str, gte=None, gt=None, lte=None, lt=None) -> Column:
    """one- or two-sided range; nulls fail."""
    c = _col(field)
    bounds = [(gte, c.__ge__), (gt, c.__gt__), (lte, c.__le__), (lt, c.__lt__)]
    return all_of([c.isNotNull(), *(test(F.lit(v)) for v, test in bounds if v is not None)])


def out_of_range(field: str, gte=None, gt=None, lte=None, lt=None) -> Column:
    """outside a range; nulls fail."""
    return _col(field).isNotNull() & ~in_range(field, gte, gt, lte, lt)


def in_time(field: str, start: datetime | None = None, end: datetime | None = None) -> Column:
    """F8: from start up to, not including, end."""
    return in_range(field, gte=start, lt=end)


def segments(path: str) -> list[str]:
    return [s for s in path.split("/") if s]


def normal_path(field: str | Column) -> Column:
    """Path with one slash before each segment and none at the end."""
    return F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), _col(field)), "/+", "/"), "(?<=.)/$", "")


def path_scope(field: str, path: str, depth: int = -1) -> Column:
    """the node (depth 0), its children too (1) or more levels, or all below it (-1); slashes at the end and
    empty segments don't count. The scheme's `//` is such an empty segment. Prefix tests of the first segment, in any way
    it may be written, come first and reach the scan; uri_scope tests the whole prefix of uris in normal form."""
    parts = segments(path)
    base = "/" + "/".join(parts)
    own = normal_path(field)
    c = _col(field)
    written = c.startswith(parts[0]) | c.startswith("/" + parts[0]) | c.startswith("//") if parts else F.lit(True)
    inside = F.lit(True) if not parts else written & ((own == base) | own.startswith(base + "/"))
    if depth >= 0:
        inside &= F.size(F.filter(F.split(own, "/"), lambda s: s != "")) - len(parts) <= depth
    return inside


def uri_scope(field: str, uri: str, depth: int = -1) -> Column:
    """F9 for uris in normal form: StringStartsWith reaches the Parquet scan."""
    base = uri.rstrip("/")
    c = _col(field)
    inside = (c == base) | c.startswith(base + "/")
    if depth >= 0:
        inside &= (c == base) | (F.size(F.split(F.substr(c, F.lit(len(base) + 2)), "/")) <= depth)
    return inside


def contains(field: str, text: str) -> Column:
    """literal substring."""
    return _col(field).contains(text)


def prefix(field: str, text: str) -> Column:
    """literal prefix."""
    return _col(field).startswith(text)


def regex(field: str, pattern: str) -> Column:
    """a match of the Java regular expression anywhere."""
    return _col(field).rlike(pattern)


def degrees(radius: str | float) -> float:
    """Radius like '10km', '500m' or degrees as a number, in degrees; it must be above 0."""
    if isinstance(radius, str):
        m = re.fullmatch(r"\s*([0-9.]+)\s*(km|m)\s*", radius)
        if not m:
            raise ValueError(f"not a radius: {radius!r}")
        radius = float(m[1]) * (1000 if m[2] == "km" else 1) / METRES_A_DEGREE
    if not radius > 0:
        raise ValueError("a radius must be above 0")
    return radius


def geo_range(lon: str, lat: str, center: tuple[float, float], radius: str | float) -> Column:
    """within a planar circle, boundary included; a box test comes first."""
    return circle(lon, lat, center, degrees(radius))


def circle(x: str, y: str, center: tuple[float, float], radius: float) -> Column:
    """two numeric fields within radius of a center."""
    if not radius > 0:
        raise ValueError("a radius must be above 0")
    a, b = _col(x), _col(y)
    box = a.between(center[0] - radius, center[0] + radius) & b.between(center[1] - radius, center[1] + radius)
    return box & ((a - center[0]) * (a - center[0]) + (b - center[1]) * (b - center[1]) <= radius * radius)


def label_in(df: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """F16: rows whose key is among those of a key table."""
    return df.join(labels.select(key).distinct(), key, "left_semi")


def noop() -> Column:
    """no restriction."""
    return F.lit(True)


_TESTS = {
    "and": lambda f: all_of([compile_filter(x) for x in f["conds"]]),
    "or": lambda f: any_of([compile_filter(x) for x in f["conds"]]),
    "eq": lambda f: eq(f["field"], f["value"], f.get("list", False)),
    "must": lambda f: one_of(f["field"], f["conds"], f.get("list", False)),
    "must_not": lambda f: none_of(f["field"], f["conds"], f.get("list", False)),
    "range": lambda f: circle(*f["field"], f["center"], f["radius"]) if "center" in f else in_range(f["field"], **{k: f[k] for k in ("gte", "gt", "lte", "lt") if k in f}),
    "range_out": lambda f: out_of_range(f["field"], **{k: f[k] for k in ("gte", "gt", "lte", "lt") if k in f}),
    "time_range": lambda f: in_range(f["field"], gte=f.get("gte"), lte=f.get("lte")),
    "geo_range": lambda f: geo_range(*f["field"], f["center"], f["radius"]),
    "path": lambda f: path_scope(f["field"], f["path"], f.get("depth", -1)),
    "contains": lambda f: contains(f["field"], f["substring"]),
    "prefix": lambda f: prefix(f["field"], f["prefix"]),
    "regex": lambda f: regex(f["field"], f["pattern"]),
    "label_in": lambda f: one_of(f.get("field", "id"), f["labels"]),
    "noop": lambda f: noop(),
}


def compile_filter(tree: dict | None) -> Column:
    """Column of a filter in JSON form; none or {} don't restrict, an unknown op is an error."""
    if not tree:
        return noop()
    if tree.get("op") not in _TESTS:
        raise ValueError(f"unknown filter op: {tree.get('op')!r}")
    return _TESTS[tree["op"]](tree)


def merge_filters(*conditions: Column | None) -> Column:
    """Conjunction of what is given."""
    return all_of([*conditions])


def build_scope(context_type: str | None = None, base: Column | None = None, targets: list[str] = (), depth: int = -1, extra: Column | None = None, levels: list[int] | None = None) -> Column:
    """type AND base AND (any target subtree) AND extra AND level-in."""
    return merge_filters(
        eq("context_type", context_type) if context_type else None,
        base,
        any_of([uri_scope("uri", t, depth) for t in targets]) if targets else None,
        extra,
        one_of("level", [*levels]) if levels else None,
    )


_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def _moment(value: str, now: datetime, upper: bool) -> datetime:
    if m := re.fullmatch(r"(\d+)([smhdw])", value.strip().lower()):
        return now - timedelta(**{_UNITS[m[2]]: int(m[1])})
    if re.fullmatch(r"\d{4}-\d\d-\d\d", value.strip()):
        day = datetime.fromisoformat(value.strip()).date()
        return datetime.combine(day, time.max if upper else time.min, now.tzinfo or UTC)
    found = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    return found if found.tzinfo else found.replace(tzinfo=UTC)


def time_bounds(field: str, since: str | None, until: str | None, now: datetime) -> Column:
    """relative (`2h`: so long before now), date-only (whole days in now's zone) or ISO bounds; both included."""
    if field not in ("updated_at", "created_at"):
        raise ValueError(f"no time field: {field}")
    low = _moment(since, now, False) if since else None
    high = _moment(until, now, True) if until else None
    if low and high and low > high:
        raise ValueError("since lies after until")
    return in_range(field, gte=low, lte=high)


def _listed(value: str | list | None) -> list[str]:
    parts = value.split(",") if isinstance(value, str) else [*(value or [])]
    return [*dict.fromkeys(s for p in parts if (s := str(p).strip().lower()))]


def context_type_filter(value: str | list | None) -> Column:
    """any of the types named; an unknown one is an error."""
    names = _listed(value)
    if bad := [n for n in names if n not in CONTEXT_TYPES]:
        raise ValueError(f"unknown context types: {bad}")
    return one_of("context_type", names) if names else noop()


def level_filter(value: str | list | None) -> Column:
    """any of the levels 0, 1, 2 named; others are ignored."""
    found = [int(n) for n in _listed(value) if n in ("0", "1", "2")]
    return one_of("level", found) if found else noop()


def tags_all(tags: list[str], field: str = "search_tags") -> Column:
    """all `key=value` tags, lower case and trimmed; of a key given twice the last value counts."""
    last: dict[str, str] = {}
    for tag in tags:
        key, sign, value = (p.strip().lower() for p in tag.partition("="))
        if sign and key and value and "=" not in value:
            last[key] = value
    return all_of([F.array_contains(_col(field), f"{k}={v}") for k, v in last.items()])


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob over whole relative paths: `*` and `?` stay inside a segment, `**` crosses."""
    parts = [p for p in pattern.split("/") if p not in ("", ".")]
    if not parts:
        raise ValueError("empty glob")
    out = []
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out.append(".*" if last else "(?:[^/]+/)*")
            continue
        one = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in re.sub(r"\*+", "*", part))
        out.append(one if last else one + "/")
    return "^" + "".join(out) + "$"


def glob(field: str, pattern: str) -> Column:
    """relative paths that a glob matches, after `.` and empty segments are dropped."""
    own = F.array_join(F.filter(F.split(_col(field), "/"), lambda s: ~s.isin("", ".")), "/")
    return own.rlike(glob_regex(pattern))


def in_scope(account: str, user: str, peer: str | None = None, context_type: str | None = None, targets: list[str] = ()) -> Column:
    """rows of the account in one of the default roots of a type (the user's own, and the peer's), or in the
    targets given; the root as target doesn't restrict. Subtrees of other peers are left out."""
    roots = {"memory": [f"ctx://user/{user}/memories"], "skill": [f"ctx://user/{user}/skills", "ctx://agent/skills"], "resource": ["ctx://resources", f"ctx://user/{user}/resources"]}
    if peer:
        roots["memory"].append(f"ctx://user/{user}/peers/{peer}/memories")
    wanted = [*dict.fromkeys(t.rstrip("/") for t in targets)] or [r for k, v in roots.items() if context_type in (None, k) for r in v]
    where = noop() if any(t in ("ctx:", "") for t in wanted) else any_of([uri_scope("uri", t) for t in wanted])
    peers = F.col("uri").startswith(f"ctx://user/{user}/peers/")
    own_peer = uri_scope("uri", f"ctx://user/{user}/peers/{peer}") if peer else F.lit(False)
    return all_of([F.col("account_id") == account, eq("context_type", context_type) if context_type else None, where, ~peers | own_peer])


ASSETS = r"(?i)\.(png|jpe?g|gif|svg|ico|webp|css|js|woff2?|ttf|mp[34]|avi|mov|zip|gz|tar|pdf|docx?|xlsx?|pptx?|exe|dmg)$"


def url_filter(url: str, hosts: list[str] | None = None, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """http(s) urls of the hosts (any, if none), under an included and no excluded path prefix, no assets."""
    part = lambda p: F.coalesce(F.try_parse_url(_col(url), F.lit(p)), F.lit(""))
    path = F.when(part("PATH") == "", "/").otherwise(part("PATH"))
    return all_of([
        F.lower(part("PROTOCOL")).isin("http", "https"),
        F.lower(part("HOST")).isin(*[h.lower() for h in hosts]) if hosts else None,
        any_of([path.startswith(p) for p in include]) if include else None,
        ~any_of([path.startswith(p) for p in exclude]) if exclude else None,
        ~path.rlike(ASSETS),
    ])


def expired(field: str, now: datetime) -> Column:
    """an expiry time that is set and past."""
    return F.col(field).isNotNull() & (F.col(field) <= F.lit(now))


