"""Column functions on texts. All but gram_jaccard and window_hashes stay in the JVM."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    """Trimmed, with each run of ASCII white space as one space; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0b\f\r]+", " "))


def content_hash(text: Column) -> Column:
    """32 hex digits over the squeezed text."""
    return F.substring(F.sha2(squeezed(text), 256), 1, 32)


def raw_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def record_id(*parts: Column) -> Column:
    """sha256 over parts joined by a bar."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def pair_id(a: Column, b: Column) -> Column:
    """16 hex digits for an unordered pair."""
    return F.substring(F.sha1(F.concat_ws("|", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))), 1, 16)


def windows(text: Column, n: int) -> Column:
    """All windows of n characters, in one pass over the text; none where it is shorter."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))


#: Fixed value: an odd number of 64 bits, of which window_hashes takes powers.
BASE = 0x9E3779B97F4A7C15


def window_hashes(text: Column, n: int) -> Column:
    """The distinct 64-bit hashes of all windows of n characters, made in a task; none where the text is shorter or null."""

    def hashes(column: pa.Array) -> pa.Array:
        out = []
        for t in column:
            c = np.frombuffer((t.as_py() or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            h = np.zeros(max(0, len(c) - n + 1), np.uint64)
            for i in range(n if len(h) else 0):
                h = h * np.uint64(BASE) + c[i : i + len(h)]
            out.append(np.unique(h).view(np.int64))
        return pa.array(out, pa.list_(pa.int64()))

    return F.arrow_udf(hashes, "array<bigint>")(text)


def char_grams(text: Column, n: int = 4) -> Column:
    """Distinct n-grams of characters without white space; a shorter text is its own gram."""
    bare = F.regexp_replace(text, r"[ \t\n\x0b\f\r]+", "")
    return F.when(F.char_length(bare) < n, F.array(bare)).otherwise(F.array_distinct(windows(bare, n)))


def tokens(text: Column) -> Column:
    """Distinct lower-case words of ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


#: A word as Python's \w+ takes it: letters and digits of any script, and the underscore.
WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Distinct lower-case words of any script."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct values; 0 when both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def gram_jaccard(a: Column, b: Column, n: int = 4) -> Column:
    """jaccard(char_grams(a), char_grams(b)) of whole texts, whose grams are made in a task and not kept as arrays; null if either is null."""
    white = re.compile(r"[ \t\n\x0b\f\r]+")

    def grams(text: str) -> set[str]:
        bare = white.sub("", text)
        return {bare[i : i + n] for i in range(max(1, len(bare) - n + 1))}

    def likeness(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            if not (x.is_valid and y.is_valid):
                out.append(None)
                continue
            p, q = grams(x.as_py()), grams(y.as_py())
            both = len(p & q)
            out.append(both / (len(p) + len(q) - both))
        return pa.array(out, pa.float64())

    return F.arrow_udf(likeness, "double")(a, b)


def skeleton(text: Column) -> Column:
    """Identifiers, paths and numbers masked, in this order."""
    for pattern, mark in ((r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"), (r"[A-Za-z]:\\[^ \t\n]+", "<path>"),
        (r"/[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)+", "<path>"), (r"[0-9]+", "<num>")):
        text = F.regexp_replace(text, pattern, mark)
    return text


# Mark and pattern of structural noise, in this order.
NOISE = (
    (" UUID ", r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    (" PATH ", r"[A-Za-z]:[\\/][^\s\"'<>|]*"),
    ("$1 PATH ", r"(^|[^A-Za-z0-9])/[a-zA-Z][\p{L}\p{N}_\-/.]*"),
    (" NUM ", r"\b\d[\d.,eE+-]*\b"),
)


def semantic_text(text: Column) -> Column:
    """A text with identifiers, paths and numbers of any notation replaced by marks."""
    for mark, pattern in NOISE:
        text = F.regexp_replace(text, pattern, mark)
    return text


def occurrences(text: Column, needle: str) -> Column:
    """How often a needle occurs, without regard to case or overlap."""
    return ((F.char_length(text) - F.char_length(F.replace(F.lower(text), F.lit(needle.lower()), F.lit("")))) / len(needle)).cast("long")


def without_tags(text: Column, tags: tuple[str, ...] = ("script", "style", "nav")) -> Column:
    """Elements of the given names cut out whole."""
    for tag in tags:
        text = F.regexp_replace(text, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return text


def first_class(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The name of the first rule of which a keyword occurs."""
    low = F.lower(text)
    out = None
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w.lower()))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


# Mark and pattern of the simple masks.
MASKS = (
    ("<EMAIL>", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("<IP>", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("<PHONE>", r"\+?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3,4}[ -]?[0-9]{0,4}"),
    ("<KEY>", r"AKIA[A-Z0-9]{16}"),
)


def masked(text: Column) -> Column:
    for mark, pattern in MASKS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def at_index_floor(values: Column, percent: int) -> Column:
    """The element at int(n * percent / 100) of a sorted array, at most the last."""
    ordered = F.array_sort(values)
    return F.try_element_at(ordered, F.least(F.size(ordered), F.floor(F.size(ordered) * percent / 100).cast("int") + 1))
