"""Tag arrays and field merges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _strings(*items: str) -> Column:
    return F.array(*map(F.lit, items)).cast("array<string>")


def hotness(active_count: Column, updated_at: Column, now: Column, half_life_days: float = 7) -> Column:
    """sigmoid(ln(1 + n)) * 2^(-age / half-life); null times give 0, ages below 0 count as 0."""
    age = (F.unix_micros(now) - F.unix_micros(updated_at)) / 86_400e6
    age = F.when(age < 0, 0.0).otherwise(age)  # greatest() would pass over a null
    return F.coalesce(1 / (1 + F.exp(-F.log1p(active_count))) * F.pow(F.lit(2.0), -age / half_life_days), F.lit(0.0))


def _key(tag: Column) -> Column:
    return F.substring_index(tag, "=", 1)


def _put(tags: Column, key: Column, tag: Column) -> Column:
    """tags with tag in the place of the one of its key, or at the end."""
    has = F.exists(tags, lambda t: _key(t) == key)
    return F.when(has, F.transform(tags, lambda t: F.when(_key(t) == key, tag).otherwise(t))).otherwise(F.concat(tags, F.array(tag)))


def normalize_tags(tags: Column) -> Column:
    """Valid `key=value` tags in lower case, trimmed; the last value of a key stands at the key's first place."""
    clean = F.transform(F.coalesce(tags, _strings()), lambda t: F.regexp_replace(F.lower(F.trim(t)), r"\s*=\s*", "="))
    valid = F.filter(clean, lambda t: t.rlike(r"^[^=]+=[^=]+$"))
    return F.aggregate(valid, _strings(), lambda out, t: _put(out, _key(t), t))


def decimal_text(value: Column) -> Column:
    """Plain decimal text without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def merge_tags(existing: Column, incoming: Column) -> Column:
    """Incoming `k=v`, `k+=v` and `k-=v` applied in order to the valid existing tags; sums start from 0. Struct of
    `tags` and `error`; the first value that isn't a number is the error."""
    kind = "struct<tags:array<string>,error:string>"

    def step(s: Column, raw: Column) -> Column:
        t = F.regexp_replace(F.lower(F.trim(raw)), r"\s*([+-]?=)\s*", "$1")
        op = F.regexp_extract(t, r"^[^=]*?([+-]?)=", 1)
        key, value = F.regexp_extract(t, r"^([^=]*?)[+-]?=", 1), F.regexp_extract(t, r"=([^=]*)$", 1)
        number = value.try_cast("decimal(38,10)")
        old_text = F.get(F.transform(F.filter(s["tags"], lambda x: _key(x) == key), lambda x: F.substring_index(x, "=", -1)), F.lit(0))
        old = F.when(old_text.isNull(), F.lit(0).cast("decimal(38,10)")).otherwise(old_text.try_cast("decimal(38,10)"))
        total = F.when(op == "-", old - number).otherwise(old + number).cast("decimal(38,10)")
        new = F.struct(_put(s["tags"], key, F.concat(key, F.lit("="), F.when(op == "", value).otherwise(decimal_text(total)))).alias("tags"), F.lit(None).cast("string").alias("error")).cast(kind)
        bad = F.struct(s["tags"].alias("tags"), F.concat(F.lit("not a number: "), raw).alias("error")).cast(kind)
        return F.when(s["error"].isNotNull() | ~t.rlike(r"^[^=]+=[^=]+$"), s).when((op != "") & total.isNull(), bad).otherwise(new)

    start = F.struct(normalize_tags(existing).alias("tags"), F.lit(None).cast("string").alias("error")).cast(kind)
    return F.aggregate(F.coalesce(incoming, _strings()), start, step)


def preserve_type_tag(existing: Column, incoming: Column, key: str = "memory_type") -> Column:
    """The existing type tag first, then the incoming tags without theirs."""
    is_type = lambda t: t.startswith(f"{key}=")
    own = F.slice(F.filter(F.coalesce(existing, _strings()), is_type), 1, 1)
    rest = F.when(F.size(own) > 0, F.filter(F.coalesce(incoming, _strings()), lambda t: ~is_type(t))).otherwise(F.coalesce(incoming, _strings()))
    return F.concat(own, rest)


def merge_field(op: str, current: Column, patch: Column) -> Column:
    """`sum` adds (null and '' keep), `immutable` is set once while null or blank, `replace` keeps on null and ''."""
    blank = lambda c: c.isNull() | (F.trim(c.cast("string")) == "")
    if op == "sum":
        both = F.coalesce(current.try_cast("double"), F.lit(0.0)) + patch.try_cast("double")
        return F.when(blank(patch), current.try_cast("double")).otherwise(both)
    if op == "immutable":
        return F.when(blank(current), patch).otherwise(current)
    if op in ("replace", "patch"):
        return F.when(blank(patch), current).otherwise(patch)
    raise ValueError(f"unknown merge: {op}")


def finite_or(value: Column, default: float) -> Column:
    """The value as a finite double, else the default."""
    number = value.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")), number).otherwise(F.lit(default))
