"""Tokens and classes that retrieval and review work with. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import jaccard

# Words that say nothing about a query.
GENERIC = ("用户", "个人", "信息", "内容", "数据", "查询", "问题", "答案", "什么", "多少", "query", "case", "content", "private", "answer", "data", "user", "no", "the", "has", "what", "with", "from", "about")
# Openings of an assistant's tool messages, and marks of compacted summaries.
TOOL_PREFIX = r"^(\[Bash\]|\[Tool:|\[Thinking\]|\[Read\]|\[Edit\]|\[Write\]|\[Grep\]|\[Glob\]|\[TodoWrite\]|\[Agent\]|\[WebFetch\]|\[WebSearch\]|\[Skill\]|\[Task\]\s*\{)"
COMPACT_SUMMARY = r"(?i)(This session is being continued from a previous conversation|was compacted\.\s*The summary below is the authoritative context)"
# What a user says who adopts or corrects an answer, or only nods.
CORRECTED = r"(?i)(不对|错了|应该是|其实不是|并非如此|搞错|(^|[^\p{L}\p{N}_])(no,|(wrong|incorrect|actually)($|[^\p{L}\p{N}_])))"
ADOPTED = r"(?i)(解决了|可以了|就这样|谢谢|多谢|管用|生效了|(^|[^\p{L}\p{N}_])(works|worked|thanks|thank you|perfect|great)($|[^\p{L}\p{N}_]))"
NOD = r"(?i)^(嗯+|呃+|啊+|好[的嘞呀吧]?|行|可以|是的?|对的?|没错|ok(ay)?|yes|y|继续|接着说|continue|go on|收到|明白|懂了|了解|谢谢|thanks?|差不多了|就这样|没问题|可以了|同意|赞成|行吧|好吧|嗯嗯)[\s!~。．.!！…]*$"
# A query that only literal evidence may answer.
LITERAL = (r"(?i)仅当证据逐字包含(?:校验码)?\s*([^\s，。；！？]+)", r"(?i)only\s+answer\s+if\s+(?:the\s+)?evidence\s+(?:literally\s+)?contains\s+([^\s,.;!?]+)")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def _pairs(run: Column) -> Column:
    """The two-letter windows of a run; none for a single letter."""
    n = F.char_length(run) - 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(run, i, F.lit(2))))


def retrieval_tokens(text: Column) -> Column:
    """Sorted distinct Latin words and pairs of neighbouring Han letters, without the generic ones."""
    low = F.lower(F.coalesce(text, F.lit("")))
    runs = _all(F.regexp_replace(low, r"\s+", ""), r"[\u3400-\u9fff]+")
    both = F.concat(_all(low, "[a-z0-9_]{2,}"), F.flatten(F.transform(runs, _pairs)))
    return F.array_sort(F.array_except(F.array_distinct(both), F.array(*[F.lit(w) for w in GENERIC])))


def query_tokens(query: Column, most: int = 4) -> Column:
    """The longest distinct identifiers and Han runs of a query (ties: in the order of their letters)."""
    found = F.array_distinct(_all(query, r"[\u4e00-\u9fff]{2,}|[A-Za-z_][A-Za-z0-9_\-]{3,}"))
    ordered = F.array_sort(F.transform(found, lambda t: F.struct((-F.char_length(t)).alias("n"), t.alias("t"))))
    return F.slice(F.transform(ordered, lambda x: x["t"]), 1, most)


def needles(query: Column) -> Column:
    """What a keyword search looks for: lower-case identifiers, then Han pairs (or a lone Han letter), each once."""
    words = F.transform(_all(query, r"[A-Za-z_][A-Za-z0-9_\-.\\/]{3,}"), lambda w: F.regexp_replace(F.lower(w), r"^[.\-\\/_]+|[.\-\\/_]+$", ""))
    grams = F.flatten(F.transform(_all(query, r"[\u4e00-\u9fff]+"), lambda r: F.when(F.char_length(r) == 1, F.array(r)).otherwise(_pairs(r))))
    return F.array_distinct(F.filter(F.concat(words, grams), lambda w: w != ""))


def like_escaped(text: Column) -> Column:
    for c in ("\\", "%", "_"):
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def required_literals(query: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*[_all(query, p, 1) for p in LITERAL])))


def review_text(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[ \t\n\x0b\f\r]+", " "))


def review_tokens(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.concat(_all(low, "[a-z0-9_]{2,}"), _pairs(F.regexp_replace(low, r"[^\u4e00-\u9fff]", ""))))


def pair_score(a: Column, b: Column) -> Column:
    """Similarity of two token sets, and a hundredth for each of up to eight shared tokens; 0 where one is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(jaccard(a, b) + F.least(shared, F.lit(8)) * 0.01)


def confirmation(text: Column) -> Column:
    """corrected, adopted or none; a correction wins."""
    return F.when(F.rlike(text, F.lit(CORRECTED)), "corrected").when(F.rlike(text, F.lit(ADOPTED)), "adopted").otherwise("none")


def short_confirmation(text: Column) -> Column:
    """Nothing, or under 30 characters that only nod."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (t == "") | ((F.char_length(t) < 30) & F.rlike(t, F.lit(NOD)))


def is_tool_message(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(TOOL_PREFIX)), F.lit(False))


def is_compact_summary(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(COMPACT_SUMMARY)), F.lit(False))


def answerability(doc: Column, confidence: Column, unit_type: Column, subject: Column) -> Column:
    """0..1 from shape, assertion, length and metadata, less for code, noise and length."""
    doc = F.coalesce(doc, F.lit(""))
    has = lambda p: F.rlike(doc, F.lit(p))
    n = F.char_length(doc)
    # Weight of each sign.
    signs = (
        (0.25, has(r"[？?].{2,}")),
        (0.20, has(r"(用户|项目|我).{0,20}(使用|偏好|要求|希望|采用|默认)")),
        (0.15, n.between(20, 280)),
        (0.15, F.coalesce(confidence > 0, F.lit(False))),
        (0.15, F.coalesce(unit_type != "", F.lit(False))),
        (0.10, F.coalesce(subject != "", F.lit(False))),
        (-0.15, has(r"[{};]|def |class |import |function |SELECT |http")),
        (-0.20, has(r"(Prompted |Attached |rollout-|Assistant Rules|InvalidTemplate)")),
        (-0.15, n > 800),
    )
    total = F.lit(0.0)
    for weight, sign in signs:
        total = total + F.when(sign, weight).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3)
