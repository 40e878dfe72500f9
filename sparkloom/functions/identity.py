"""Stable identifiers, canonical JSON, times and checks of values. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import squeezed


def _joined(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def short(text: Column, most: int = 2000) -> Column:
    return F.substring(squeezed(text), 1, most)


def marked_cut(text: Column, most: int) -> Column:
    """Cut, with a mark where something is missing."""
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...[truncated]")))


def entity_id(kind: Column, name: Column) -> Column:
    return F.sha2(_joined(kind, F.lower(squeezed(name))), 256)


def canonical_id(subject: Column, kind: Column, answer: Column) -> Column:
    inner = _joined(F.lower(F.trim(subject)), kind, F.substring(F.sha2(answer, 256), 1, 16))
    return F.concat(F.lit("cu|"), F.substring(F.sha2(inner, 256), 1, 32))


def event_id(family: Column, contract: Column, artifact: Column, native: Column, kind: Column, session: Column, locator: Column) -> Column:
    """From the native id (and locator) where there is one, else from kind, session and locator; null without an anchor."""
    own = F.concat_ws("|", F.lit("ev"), family, contract, artifact, native, locator)
    other = F.concat_ws("|", F.lit("ev"), family, contract, artifact, kind, session, locator)
    return F.when(native.isNotNull(), F.sha2(own, 256)).when(session.isNotNull() | locator.isNotNull(), F.sha2(other, 256))


def cache_key(*hashes: Column) -> Column:
    return F.substring(F.sha2(_joined(*hashes), 256), 1, 32)


def repeat_key(kind: Column, subject: Column, answer: Column) -> Column:
    """Equal for exact repeats of a unit."""
    tidy = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return _joined(kind, tidy(subject), F.substring(tidy(answer), 1, 120))


def view_id(kind: Column, generation: Column, builder: Column, refs: Column) -> Column:
    ordered = F.array_sort(F.array_distinct(refs))
    return F.concat(F.lit("view:"), F.sha2(F.concat_ws("|", kind, generation, builder, ordered), 256))


def tools_named(text: Column, tools: list[str]) -> Column:
    """The tools that a text names, in order, whatever their case."""
    low = F.lower(text)
    return F.filter(F.array(*[F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in sorted(set(tools))]), lambda t: t.isNotNull())


def entity_stem(path: Column) -> Column:
    """The last part of a path, in lower case; null where nothing is left."""
    t = F.trim(F.coalesce(path, F.lit("")))
    parts = F.filter(F.split(t, r"[\\/]+"), lambda p: p != "")
    return F.nullif(F.lower(F.trim(F.coalesce(F.try_element_at(parts, F.lit(-1)), t))), F.lit(""))


def canonical_json(text: Column) -> Column:
    """Without white space, with keys in order, at every level; null where the text is no JSON."""
    return F.to_json(F.try_parse_json(text))


def json_checksum(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


def json_list(text: Column) -> Column:
    """A JSON list as strings; another value, or a text that is no JSON, is a list of itself; nothing is an empty list."""
    value = F.try_parse_json(text)
    as_list = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.to_json(v))
    one = F.when(value.isNull(), F.array(text)).when(F.schema_of_variant(value).startswith("ARRAY"), as_list).otherwise(F.array(F.to_json(value)))
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(one)


def mended_json(text: Column) -> Column:
    """Canonical JSON; backslashes that begin no escape are doubled where the text would not parse otherwise."""
    return F.coalesce(canonical_json(text), canonical_json(F.regexp_replace(text, r'\\(?!["\\/bfnrtu])', r"\\\\")))


def utc_time(value: Column) -> Column:
    """A time as text in UTC ending in Z, with milliseconds only where there are some; what is no time stays as it is.

    Takes epoch milliseconds as digits, and ISO times with or without a zone."""
    t = F.trim(value)
    millis = F.rlike(t, F.lit("^[0-9]{13,}$"))
    parsed = F.when(millis, F.timestamp_millis(F.expr("0L") + t.try_cast("bigint"))).otherwise(F.when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]|$)")), F.try_to_timestamp(t)))
    whole = F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    exact = F.when(F.extract(F.lit("SECOND"), parsed) % 1 == 0, whole).otherwise(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return F.when(t == "", F.lit(None)).when(t.endswith("Z"), t).otherwise(F.coalesce(exact, t))


def month_of(month: Column, time: Column) -> Column:
    m, t = squeezed(month), squeezed(time)
    return F.when(F.char_length(m) >= 7, F.substring(m, 1, 7)).when(F.char_length(t) >= 7, F.substring(t, 1, 7)).otherwise(F.lit("未知"))


def in_window(time: Column, start: str, end: str) -> Column:
    """Whether a clock time lies in HH:MM..HH:MM, which may span midnight; the end is outside."""
    minutes = lambda hhmm: int(hhmm[:2]) * 60 + int(hhmm[3:])
    now, low, high = F.hour(time) * 60 + F.minute(time), minutes(start), minutes(end)
    return ((now >= low) & (now < high)) if low <= high else ((now >= low) | (now < high))


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the check of card numbers."""
    doubled = F.transform(F.reverse(F.split(digits, "")), lambda d, i: d.try_cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))
    return F.coalesce(F.rlike(digits, F.lit("^[0-9]{13,19}$")) & (total % 10 == 0), F.lit(False))


def topic_key(text: Column) -> Column:
    """The canonical topic key, or null where it is none: a known type with its number of parts, decoded once."""
    bad = F.rlike(text, F.lit(r"[\x00-\x1f\x7f]|%(?![0-9A-Fa-f]{2})"))
    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    part = r"[^:/\\\s\x00-\x1f\x7f]([^:/\\\x00-\x1f\x7f]*[^:/\\\s\x00-\x1f\x7f])?"
    known = F.rlike(decoded, F.lit(rf"^((project|decision|subject):{part}|goal:{part}:{part}:{part})$"))
    return F.when(~bad & known & ~F.rlike(decoded, F.lit("%[0-9A-Fa-f]{2}")), decoded)
