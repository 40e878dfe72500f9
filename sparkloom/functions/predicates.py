"""Predicates and scores of rows. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import squeezed

# Words that name no interest, and folders that name no project.
NOISE_WORDS = ("cid", "date", "title", "const", "output", "node_modules", "file", "new", "master", "token", "gem")
NOISE_DIRS = ("desktop", "documents", "downloads", "src", "tmp", "temp", "home", "users")
# Keys of JSON objects whose values are sealed, and keys that must stay byte by byte.
SENSITIVE_KEYS = r"(?i)^(password|passwd|pwd|secret|token|api_?key|authorization|cookie)$|(?i)(_password|_secret|_token|_api_key)$"
INTEGRITY_KEYS = r"(?i)^ids$|(?i)(_id|_hash|_checksum|_fingerprint)$"


def is_noise(word: Column) -> Column:
    """A listed word, a mix of 12 and more letters and digits, a file name, or a piece of a hash."""
    w = F.lower(word)
    return w.isin(*NOISE_WORDS) | F.rlike(w, F.lit(r"^[a-z0-9]{12,}$|^[a-z0-9]+\.(jpg|png|jpeg|json|txt|db)$|[a-f0-9]{10,}"))


def is_project_name(name: Column) -> Column:
    """Two to forty characters that are no identifier, number, or folder of every machine."""
    n = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"[.\\/（(]+$", "")
    odd = F.rlike(F.lower(n), F.lit(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^skill_\d+$|^[0-9a-f]{12,}$|^\d+$"))
    return F.char_length(n).between(2, 40) & ~odd & ~F.lower(n).isin(*NOISE_DIRS)


def is_faithful_short(text: Column) -> Column:
    n = F.trim(F.coalesce(text, F.lit("")))
    return F.char_length(n).between(4, 40) & F.rlike(n, F.lit(r"[\p{L}\p{N}]"))


def vectorizable(rich: Column, content: Column, title: Column, least: int) -> Column:
    """The text to embed: the rich text if long enough, else the content, after the title; null if both are short."""
    body = F.when(F.char_length(F.trim(rich)) >= least, F.trim(rich)).when(F.char_length(F.trim(content)) >= least, F.trim(content))
    return F.when(body.isNotNull(), F.concat_ws("\n", F.nullif(F.trim(title), F.lit("")), body))


def is_restricted(service: Column, category: Column, services: tuple[str, ...], parts: tuple[str, ...]) -> Column:
    hit = F.coalesce(service.isin(*services), F.lit(False))
    for p in parts:
        hit = hit | F.coalesce(F.contains(category, F.lit(p)), F.lit(False))
    return hit


def stepped(x: Column, *steps: tuple[float, float]) -> Column:
    """The value of the highest step that x reaches, else 0."""
    out = None
    for least, value in steps:
        out = F.when(x >= least, value) if out is None else out.when(x >= least, value)
    return out.otherwise(0.0)


def insight_score(evidence: Column, span: Column, recurrence: Column, strength: Column, contradictions: Column) -> Column:
    # The steps of each part.
    total = stepped(evidence, (100, 1.0), (10, 0.8), (3, 0.5)) + stepped(span, (90, 1.0), (30, 0.8), (7, 0.5)) + stepped(recurrence, (4, 1.0), (2, 0.7),
        (1, 0.3)) + stepped(strength, (0.85, 1.0), (0.7, 0.7), (0.5, 0.4))
    return F.round(F.greatest(F.lit(0.0), total - F.least(contradictions, F.lit(2)) * 0.35), 2)


def sealed_json(pairs: Column) -> Column:
    """map<string, string> with the values of sensitive keys replaced by a mark with a fingerprint; integrity keys stay as they are."""
    seal = lambda v: F.concat(F.lit("[SEALED:field-secret:fp:"), F.substring(F.sha2(v, 256), 1, 12), F.lit("]"))
    return F.transform_values(pairs, lambda k, v: F.when(F.rlike(k, F.lit(SENSITIVE_KEYS)) & ~F.rlike(k, F.lit(INTEGRITY_KEYS)) & ~v.isin("", "null", "None",
        "undefined", "true", "false") & ~v.startswith("[SEALED:"), seal(v)).otherwise(v))


def tidy(text: Column) -> Column:
    return F.lower(squeezed(text))
