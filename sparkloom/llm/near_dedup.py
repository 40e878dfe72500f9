"""MinHash near-dedup: universal hash minima, bands, verification on full sets, and star-contraction components.

Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a document's set is its distinct 5-word shingles (its whole
word sequence when shorter). Documents are linked when 100 * intersection >= percent * union.

1. Documents with equal sets form a class, which its smallest id stands for; only classes go on.
2. Each class gets 125 minima in 25 bands of 5. At a similarity of 0.85 all bands miss a link with probability
   4e-7, at 0.8 with 5e-5.
3. Every bucket first compares its members with one pivot. Pairs are checked on signatures, then on full sets.
4. Links become components by alternating large-star and small-star.
5. Buckets whose members still lie in several components hold pairs not yet compared. All of these are compared:
   members outside a bucket's main component meet the bucket's members. Both sides are dealt by size of set and
   into blocks of about BLOCK, only blocks of sizes that allow a link meet, and each pair of blocks is a group of its
   own, so no task holds a bucket. A first pass over signatures finds the members that may have a link there, a second one verifies their pairs on
   full sets and returns links only; a pair is compared in the first bucket that both share.

No bucket is capped, no bucket's pairs are listed, and no links or components reach the driver.

Defined cases: null, empty and blank texts have empty sets, are linked with nothing and stand alone; rows
without an id join the class of rows with an equal set and are otherwise linked with nothing; repeated rows are
copies, and rows with equal ids are one node; ties go to the smaller id; extra columns
are ignored (or passed on by ``keep_first``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import lowered, materialize, quoted, release, rolling_word_hashes, span_hashes, utf8, word_spans

WORDS = 5
BANDS, ROWS = 25, 5
MINIMA = BANDS * ROWS
PERCENT = 85
#: Members of a block, on average; two blocks of a bucket meet in one group.
BLOCK = 256
#: Tasks over which a bucket's rows are dealt where they are joined with what is known of the bucket.
SALTS = 16
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 32, MINIMA, dtype=np.uint32)[:, None] | np.uint32(1)
_B = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)[:, None]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    codes = lowered(utf8(text))
    starts, ends = word_spans(codes)
    return np.unique(rolling_word_hashes(span_hashes(codes, starts, ends), WORDS))


def signature(items: np.ndarray) -> np.ndarray:
    """The minima of MINIMA universal hashes over the upper halves of the items; all bits set for an empty set."""
    out = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    high = (items >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 2048):
        np.minimum(out, (_A * high[at : at + 2048] + _B).min(axis=1), out=out)
    return out


def least_matches(percent: int) -> int:
    """Equal minima below which a pair with the similarity asked for lies over 7 standard deviations out."""
    p = percent / 100
    return int(MINIMA * p - 7 * np.sqrt(MINIMA * p * (1 - p)))


def _summaries(texts: pa.Array) -> pa.Array:
    rows = []
    for t in texts:
        s = shingles(t.as_py())
        digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
        rows.append({"n": len(s), "digest": digest, "minima": signature(s).astype("<u4").tobytes() if len(s) else None})
    return pa.array(rows, type=pa.struct([("n", pa.int64()), ("digest", pa.binary()), ("minima", pa.binary())]))


def _sets(texts: pa.Array) -> pa.Array:
    return pa.array([shingles(t.as_py()).astype("<u8").tobytes() for t in texts], type=pa.binary())


def jaccard_at_least(a: pa.Array, b: pa.Array, percent: int) -> pa.Array:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x.as_py(), dtype="<u8"), np.frombuffer(y.as_py(), dtype="<u8")
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(100 * both >= percent * (len(x) + len(y) - both))
    return pa.array(out, type=pa.bool_())


def shingle_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, set) of the texts(id, text) whose id is in wanted(id).

    The merge join keeps the plan the same at every size, as the wanted ids grow with the corpus."""
    found = texts.join(wanted.distinct().hint("merge"), "id", "left_semi")
    return materialize(found.select("id", F.arrow_udf(_sets, "binary")("text").alias("set")))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs(a, b) of ids in sets(id, set) whose sets are similar enough."""
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    near = 100 * F.least(F.length("sa"), F.length("sb")) >= percent * F.greatest(F.length("sa"), F.length("sb"))

    def check(a: pa.Array, b: pa.Array) -> pa.Array:
        return jaccard_at_least(a, b, percent)

    links = pairs.join(left, "a").join(right, "b").where(near).where(F.arrow_udf(check, "boolean")("sa", "sb"))
    return materialize(links.select("a", "b").distinct())


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links(a, b): the smallest id reachable, by alternating large-star and small-star.

    Each round is written to the shared folder; a round that changes no edge ends it."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        following = materialize(small.where("u <> v").distinct())
        same = edges.count() == following.count() and edges.join(following, ["u", "v"], "left_anti").isEmpty()
        release(edges)
        edges = following
        if same:
            break
    ids = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return ids.unionByName(ids.select(F.col("component").alias("id"), "component").distinct())


CELL = ["key", "out_class", "in_class", "i", "j"]
MEMBER = "key long, out_class int, in_class int, i int, j int, band int, pivot long, main long, id long, component long, n long, minima binary"
_NAMES = [x.split()[0] for x in MEMBER.split(", ")]


def _possible(outside: pa.Table, block: pa.Table, percent: int):
    """For each row of outside, the rows of block of another component that it may be linked with and meets here first."""
    least = least_matches(percent)
    ids, comps, ns = (block[c].to_numpy() for c in ("id", "component", "n"))
    sigs = np.frombuffer(b"".join(block["minima"].to_pylist()), dtype="<u4").reshape(-1, MINIMA)
    columns = (outside[x].to_pylist() for x in ("id", "component", "n", "minima", "band", "pivot", "main"))
    for row, (i, c, n, s, band, pivot, main) in enumerate(zip(*columns, strict=True)):
        if i == pivot:
            continue
        # Two rows outside the main component meet twice, and the pivot has been compared.
        hit = (comps != c) & ((comps == main) | (ids > i)) & (ids != pivot) & (100 * np.minimum(ns, n) >= percent * np.maximum(ns, n))
        at = np.flatnonzero(hit)
        same = sigs[at] == np.frombuffer(s, dtype="<u4")
        keep = same.sum(axis=1) >= least
        at, same = at[keep], same[keep]
        bands = same.reshape(-1, BANDS, ROWS).all(axis=2)
        yield row, at[bands.argmax(axis=1) == band] if len(at) else at


def _involved(percent: int):
    def run(key, outside: pa.Table, block: pa.Table) -> pa.Table:
        left, right = [], np.zeros(block.num_rows, dtype=bool)
        if outside.num_rows and block.num_rows:
            for row, at in _possible(outside, block, percent):
                right[at] = True
                if len(at):
                    left.append(row)
        both = pa.concat_tables([outside.take(pa.array(left, type=pa.int64())), block.filter(pa.array(right))])
        return both.append_column("is_outside", pa.array([True] * len(left) + [False] * int(right.sum()), type=pa.bool_()))

    return run


def _linked(percent: int):
    def run(key, outside: pa.Table, block: pa.Table) -> pa.Table:
        a, b, root = [], [], {}

        def find(x):
            while (y := root.get(x, x)) != x:
                x = y
            return x

        if outside.num_rows and block.num_rows:
            sets = [np.frombuffer(x, dtype="<u8") for x in block["set"].to_pylist()]
            ids, comps = block["id"].to_pylist(), block["component"].to_pylist()
            own, own_comps, own_sets = (outside[c].to_pylist() for c in ("id", "component", "set"))
            for row, at in _possible(outside, block, percent):
                mine = np.frombuffer(own_sets[row], dtype="<u8")
                for j in at.tolist():
                    if (x := find(own_comps[row])) != (y := find(comps[j])):
                        both = len(np.intersect1d(mine, sets[j], assume_unique=True))
                        if 100 * both >= percent * (len(mine) + len(sets[j]) - both):
                            root[max(x, y)] = min(x, y)
                            a.append(min(own[row], ids[j])), b.append(max(own[row], ids[j]))
        return pa.table([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

    return run


def remaining_links(buckets: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join what labels(id, component) leaves apart in buckets(key, band, id, pivot)."""
    members = buckets.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # A bucket's rows are dealt over SALTS tasks wherever they meet the few rows that describe the bucket.
    salted = lambda rows: rows.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALTS)))
    copied = lambda few: few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    counts = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("size"), F.count("*").alias("parts"))
    # Sets whose sizes allow the similarity lie in the same size class or in neighbouring ones; a small bucket is one class.
    size_class = F.when(F.col("size") > BLOCK, F.floor(F.log("n") / float(np.log(100 / percent * 1.0001)))).otherwise(0).cast("int")
    signed = salted(members).join(copied(main.where("parts > 1 and size > 2").drop("parts")), ["key", "salt"]).join(classes.select("id", "n", "minima"), "id")
    signed = materialize(signed.withColumn("size_class", size_class))
    blocks = F.ceil(F.count("*") / BLOCK).cast("int")
    inner = signed.groupBy("key", F.col("size_class").alias("in_class")).agg(blocks.alias("in_blocks"))
    outer = signed.where("component <> main").groupBy("key", F.col("size_class").alias("out_class")).agg(blocks.alias("out_blocks"))
    meet = outer.withColumn("in_class", F.explode(F.sequence(F.col("out_class") - 1, F.col("out_class") + 1))).join(inner, ["key", "in_class"])
    meet = copied(meet)
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inside = signed.withColumnRenamed("size_class", "in_class").join(meet, ["key", "in_class", "salt"]).withColumn("j", dealt("in_blocks")).withColumn("i", every("out_blocks"))
    outside = signed.where("component <> main").withColumnRenamed("size_class", "out_class").join(meet, ["key", "out_class", "salt"]).withColumn("i", dealt("out_blocks")).withColumn("j", every("in_blocks"))
    inside, outside = (rows.select([F.col(c).alias(c) for c in _NAMES]) for rows in (inside, outside))
    found = materialize(outside.groupBy(*CELL).cogroup(inside.groupBy(*CELL)).applyInArrow(_involved(percent), f"{MEMBER}, is_outside boolean"))
    full = found.join(sets, "id")
    left, right = (full.where(F.col("is_outside") == side).select([F.col(c).alias(c) for c in [*_NAMES, "set"]]) for side in (True, False))
    return left.groupBy(*CELL).cogroup(right.groupBy(*CELL)).applyInArrow(_linked(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of docs; key must be an integer column."""
    raw = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = materialize(raw.withColumn("s", F.arrow_udf(_summaries, "n long, digest binary, minima binary")("text")).select("id", "s.n", "s.digest", "s.minima"))
    classes = rows.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("minima").alias("minima"))
    classes = materialize(classes)

    bands = F.array(*[F.xxhash64(F.substring("minima", 4 * ROWS * i + 1, 4 * ROWS), F.lit(i)) for i in range(BANDS)])
    every = classes.select("id", F.posexplode(bands).alias("band", "key"))
    pivots = every.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = materialize(every.join(pivots, "key"))
    star = buckets.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    sets = shingle_sets(raw, buckets.select("id"))
    links = verified(star, sets, percent)
    labels = materialize(components(links))
    rest = materialize(remaining_links(buckets, labels, classes, sets, percent))
    if not rest.isEmpty():
        labels = components(links.unionByName(rest))
    release(sets)
    named = classes.select("digest", "id").join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    grouped = named.withColumnRenamed("component", "found")
    done = rows.select("id", "n", "digest").join(grouped, "digest", "left").withColumn("component_id", F.coalesce("found", "id"))
    return done.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _whole(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, doc): each row as one struct, whatever its columns are called."""
    return docs.select(F.col(quoted(key)).alias("id"), F.col(quoted(text)).alias("text"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc"))


def _least(doc: str = "doc"):
    """Of several rows, the one whose JSON text is least: the same one whatever the order they come in."""
    return F.min_by(doc, F.to_json(doc, {"ignoreNullFields": "false"})).alias("doc")


def _first_rows(docs: DataFrame, percent: int, key: str, text: str) -> DataFrame:
    """keep_first for ids that repeat: each row is a node of its own, and the row of the smallest id stays."""
    rows = materialize(_whole(docs, key, text).groupBy("id", "text").agg(_least()).withColumn("row", F.monotonically_increasing_id()))
    found = materialize(near_duplicates(rows.select("row", "text"), percent, "row", "text").where("n_shingles > 0").select("row", "component_id"))
    named = found.join(rows.select("row", "id"), "row")
    firsts = named.groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("first")).select("first.row")
    return rows.join(found.join(firsts, "row", "left_anti").select("row").hint("merge"), "row", "left_anti").select("doc")


def _without_id(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The rows without an id, one of each text that no row with an id has; texts without a word all stay."""
    all_ = _whole(docs, key, text)
    rows, worded = all_.where(F.col("id").isNull()), F.coalesce(F.rlike("text", F.lit(r"[^ \t\n\x0b\f\r]")), F.lit(False))
    others = all_.where(F.col("id").isNotNull()).select(F.sha2("text", 256).alias("hash")).where("hash is not null").distinct()
    firsts = rows.where(worded).groupBy(F.sha2("text", 256).alias("hash")).agg(_least())
    return firsts.join(others.hint("merge"), "hash", "left_anti").select("doc").unionByName(rows.where(~worded).select("doc"))


def keep_first(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that are not the first of their group; of rows with equal id and text one stays, the one
    whose JSON is least.

    Where ids repeat, it is decided row by row. Only the ids to drop are matched with docs. Rows without an id go only
    where another row has the same text."""
    known, columns = docs.where(F.col(key).isNotNull()), [F.col(quoted(c)) for c in docs.columns]
    whole = [F.col(f"doc.{quoted(c)}").alias(c) for c in docs.columns]
    if known.groupBy(key).count().where("count > 1").isEmpty():
        found = materialize(near_duplicates(known, percent, key, text))
        left = known.join(found.where(~F.col("kept")).select(key).distinct().hint("merge"), key, "left_anti").select(columns)
    else:
        left = _first_rows(known, percent, key, text).select(whole)
    missing = docs.where(F.col(key).isNull())
    return left if missing.isEmpty() else left.unionByName(_without_id(docs, key, text).select(whole))
