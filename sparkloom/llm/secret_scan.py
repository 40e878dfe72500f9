"""Secret scans with corpus-wide ownership frequency.

Each whole text is scanned for candidate spans. The hash of every candidate's value is then counted over the
corpus by distinct repositories and owners: a value that several owners hold is a copied example, one that stays
with a single owner (and does not look like a placeholder) is a live-looking credential. Copies of one text are one
holding, whoever keeps them: each distinct text counts for one repository and one owner, the first by name.

Spans are code points of the whole match, ends exclusive. Base kinds are assign, access and hex, and their spans are
all kept. Further candidates are pem (private key blocks), jwt, and prefixed (vendor-prefixed tokens); ``reported``
keeps those of them that the ownership counts call live. All patterns take linear time.

Defined cases: a null or empty text has no spans; null repositories and owners count as one each; repeated rows
and copies in other repositories are each answered and do not add owners; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, quoted

# Kind, pattern, group that holds the value, least length of the value.
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("prefixed", r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})", 0, 1),
)
BASE_KINDS = ("assign", "access", "hex")
# The same matches, written so that a run too short for the kind ends early.
_SEARCHED = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
_COMPILED = [(kind, re.compile(_SEARCHED.get(kind, p), re.ASCII), group, least) for kind, p, group, least in PATTERNS]
# A linear-time test that no text with a span fails.
_HINT = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|PRIVATE KEY|eyJ|gh[pousr]_|xox[abprs]-|sk_live_|AIza"
# Parts of values that mark a placeholder.
PLACEHOLDERS = ("example", "changeme", "dummy", "placeholder", "xxxxxx", "your_", "redacted")
#: A value that so many distinct owners or repositories hold is a copied example.
SHARED_BY = 2
#: ``redact_live`` in the pipeline leaves a value in the clear only where so many hold it, each in a text of its own.
WIDELY_SHARED_BY = 10

SPAN = "struct<kind_order int, kind string, start int, end int, value_hash long, placeholder boolean>"


def find_spans(text: str) -> list[tuple[int, str, int, int, int, bool]]:
    """All spans of a text, by start, then by kind as listed."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(_COMPILED):
        for m in pattern.finditer(text):
            value = m.group(group)
            if len(value) >= least:
                h = int.from_bytes(hashlib.sha256(value.encode("utf-8", "surrogatepass")).digest()[:8], "little", signed=True)
                low = value.lower()
                found.append((order, kind, m.start(), m.end(), h, any(p in low for p in PLACEHOLDERS)))
    return sorted(found, key=lambda s: (s[2], s[0]))


def spans_of(texts: pa.Array) -> pa.Array:
    """The spans of every text."""
    fields = [pa.field("kind_order", pa.int32()), pa.field("kind", pa.string()), pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("value_hash", pa.int64()), pa.field("placeholder", pa.bool_())]
    names = [f.name for f in fields]
    hints = pc.match_substring_regex(texts.cast(pa.large_string()), _HINT)
    found = [find_spans(t.as_py()) if h.as_py() else [] for t, h in zip(texts, hints, strict=True)]
    return pa.array([[dict(zip(names, s, strict=True)) for s in one] for one in found], type=pa.list_(pa.struct(fields)))


def ownership(scanned: DataFrame) -> DataFrame:
    """value_hash with its numbers of distinct repositories and owners in the corpus, one of each for a distinct text."""
    named = lambda c: F.coalesce(F.concat(F.lit("."), F.col(c).cast("string")), F.lit(""))  # noqa: E731  without one: a name that no other has
    each = scanned.where(F.size("spans") > 0).select(F.explode("spans.value_hash").alias("value_hash"), "text_hash", named("repository").alias("r"), named("owner").alias("o"))
    held = each.groupBy("value_hash", "text_hash").agg(F.min("r").alias("r"), F.min("o").alias("o"))
    return held.groupBy("value_hash").agg(F.countDistinct("r").alias("n_repositories"), F.countDistinct("o").alias("n_owners"))


def judge(scanned: DataFrame, shared_by: int = SHARED_BY) -> DataFrame:
    """row_id and its spans, each with n_repositories, n_owners and live; only rows that have spans."""
    s = scanned.where(F.size("spans") > 0).select("row_id", F.explode("spans").alias("s")).withColumn("value_hash", F.col("s.value_hash"))
    judged = s.join(ownership(scanned), "value_hash").select(
        "row_id",
        F.struct(
            "s.start",
            "s.kind_order",
            "s.kind",
            "s.end",
            "n_repositories",
            "n_owners",
            (~F.col("s.placeholder") & (F.greatest("n_owners", "n_repositories") < shared_by)).alias("live"),
        ).alias("span"),
    )
    return judged.groupBy("row_id").agg(F.array_sort(F.collect_list("span")).alias("judged"))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", repository: str = "source", owner: str = "source") -> DataFrame:
    """key and ``judged`` (an empty array without spans) for every row of docs."""
    found = F.arrow_udf(spans_of, f"array<{SPAN}>")
    rows = docs.select(F.col(key).alias("key"), F.col(repository).alias("repository"), F.col(owner).alias("owner"), F.xxhash64(text).alias("text_hash"), found(F.col(text)).alias("spans"))
    scanned = materialize(rows.withColumn("row_id", F.monotonically_increasing_id()))
    judged = judge(scanned)
    empty = F.array().cast(judged.schema["judged"].dataType)
    return scanned.join(judged, "row_id", "left").select(F.col("key").alias(key), F.coalesce("judged", empty).alias("judged"))


def reported(judged: Column) -> Column:
    """Of judged spans all base ones, and the others that are live."""
    return F.filter(judged, lambda s: s["kind"].isin(*BASE_KINDS) | s["live"])


def redact(text: str | None, starts: list[int], ends: list[int], mark: str = "[SECRET]") -> str | None:
    """text with the union of the spans replaced by a mark."""
    out, at = [], 0
    for start, end in sorted(zip(starts, ends, strict=True)):
        if start >= at:
            out += [(text or "")[at:start], mark]
        at = max(at, end)
    return "".join([*out, (text or "")[at:]])


def redact_live(docs: DataFrame, text: str = "text", repository: str = "source", owner: str = "source", shared_by: int = SHARED_BY) -> DataFrame:
    """docs with the credentials in text replaced that fewer than ``shared_by`` hold; all rows and columns stay.

    Only the rows that hold a span are shuffled."""
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc"), F.col(repository).alias("repository"), F.col(owner).alias("owner"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    found = F.arrow_udf(spans_of, f"array<{SPAN}>")
    scanned = materialize(whole.withColumn("spans", found("text")).drop("text").withColumn("row_id", F.monotonically_increasing_id()))
    live = judge(scanned, shared_by).select("row_id", F.filter("judged", lambda s: s["live"]).alias("live"))

    def masked(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        return pa.array([redact(t.as_py(), a.as_py(), b.as_py()) for t, a, b in zip(texts, starts, ends, strict=True)], type=pa.string())

    cut = F.arrow_udf(masked, "string")
    hit = scanned.where(F.size("spans") > 0).join(live, "row_id").select("doc", cut(F.col(f"doc.{quoted(text)}"), "live.start", "live.end").alias("masked"))
    rest = scanned.where(F.size("spans") == 0).select("doc", F.lit(None).cast("string").alias("masked"))
    return rest.unionByName(hit).select(*[F.coalesce("masked", F.col(f"doc.{quoted(c)}")).alias(c) if c == text else F.col(f"doc.{quoted(c)}").alias(c) for c in docs.columns])
