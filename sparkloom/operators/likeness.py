"""Pairs of like sets of a bucket, found by sketches of the sets; the sets themselves are only sent for pairs that may be alike.

A sketch has one bit flipped for each member, so two sketches differ in at most as many bits as the sets differ in members,
and sets of a Jaccard similarity of percent / 100 differ in at most (100 - percent) / (100 + percent) of their sizes' sum.
Whatever differs in more bits is ruled out for sure; the rest is confirmed on the full sets. Sketches are as long as the sets
ask for and fold by halves, so the two of a pair are compared at the length of the shorter one.

Sketches are sorted by bucket and size and cut into blocks. Blocks meet if sizes in them can be alike; they grow with the
table, so a row is sent to a bounded number of them, and what is shuffled grows as the table does. The comparisons of a
bucket still grow with the square of its rows of like sizes, at a few operations on machine words each."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.shared import materialize

#: Rows of a block on average: LEAST_ROWS, more where there are more than BLOCKS times as many rows, up to MOST_ROWS.
LEAST_ROWS, BLOCKS, MOST_ROWS = 2048, 16, 65_536
#: Bits of a sketch for each member by which sets may differ; rows of two blocks that are compared at a time.
BITS, TILE = 3, (128, 512)
#: Members of a string: its windows of so many characters.
GRAM = 4
#: Words of the bit table that keeps sets no pair names from being sent.
FILTER_WORDS = 1 << 18
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _distinct(h: np.ndarray) -> np.ndarray:
    """Sorted, each once; np.unique sorts them by way of a table, which takes several times as long."""
    h = np.sort(h)
    keep = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def _hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each row's members: of lists of hashes those, of strings their windows of GRAM characters."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        for row in column:
            yield _distinct(row.values.to_numpy(zero_copy_only=False).view(np.uint64)) if row.is_valid else np.zeros(0, np.uint64)
        return
    for row in column:
        c = np.frombuffer((row.as_py() or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if 0 < len(c) < GRAM:  # a shorter text is its own gram
            c = np.concatenate([c, np.full(GRAM - len(c), 1 << 32, np.uint64)])
        n = max(0, len(c) - GRAM + 1)
        h = np.zeros(n, np.uint64)
        for k in range(GRAM):
            h += (c[k : k + n] + np.uint64(1)) * _FACTORS[k]
        yield _distinct(_mixed(h))


def hashed(members: Column, kind: str) -> Column:
    """Members as they are sent: strings in a list as hashes, hashes and whole strings as they are."""
    return F.transform(members, lambda m: F.xxhash64(m)) if kind == "array<string>" else members


def _words(n: np.ndarray, percent: int) -> np.ndarray:
    """Words of 64 bits of the sketch of a set of n members, a power of 2."""
    wanted = np.maximum(2, BITS * 2 * n * (100 - percent) / (100 + percent) / 64)
    return (1 << np.ceil(np.log2(wanted)).astype(np.int64)).astype(np.int64)


def sketched(rows: DataFrame, percent: int) -> DataFrame:
    """rows(id, bucket, members) as (id, bucket, n, kind, sketch): kind is equal for equal sets."""

    def sketch(column: pa.Array) -> pa.Array:
        n, kind, sketches = [], [], []
        for h in _hashes(column):
            words = int(_words(np.array([len(h)]), percent)[0])
            flips = np.bincount((_mixed(h) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
            n.append(len(h))
            kind.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
            sketches.append(np.packbits(flips.astype(np.uint8), bitorder="little").tobytes())
        return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(kind, pa.binary()), pa.array(sketches, pa.binary())], names=["n", "kind", "sketch"])

    return rows.select("id", "bucket", F.arrow_udf(sketch, "n int, kind binary, sketch binary")("members").alias("s")).select("id", "bucket", "s.n", "s.kind", "s.sketch")


def placed(sets: DataFrame, percent: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """sets(id, bucket, n, sketch) sorted by bucket and size and cut into blocks, written once, and the pairs of blocks to compare."""
    rows = sets.count()
    size = max(LEAST_ROWS, min(MOST_ROWS, -(-rows // BLOCKS)))
    dealt = sets.select("id", "bucket", "n", "sketch").repartitionByRange(max(1, -(-rows // size)), "bucket", "n", "id")
    cut = materialize(dealt.withColumn("block", F.spark_partition_id()))
    ends = cut.groupBy("block").agg(F.min(F.struct("bucket", "n")).alias("low"), F.max(F.struct("bucket", "n")).alias("high")).orderBy("block").collect()  # a row a block
    cells = [(r["block"], r["block"]) for r in ends]
    for k, r in enumerate(ends):
        for s in ends[k + 1 :]:
            if s["low"]["bucket"] != r["high"]["bucket"] or percent * s["low"]["n"] > 100 * r["high"]["n"]:
                break
            cells.append((r["block"], s["block"]))
    return cut, cells


class _Side:
    """Rows of a block, sorted by bucket, size and id."""

    def __init__(self, table: pa.Table, codes: dict[str, int], percent: int):
        self.id, self.n = table["id"].to_numpy(), table["n"].to_numpy().astype(np.int64)
        self.key = (np.array([codes[b] for b in table["bucket"].to_pylist()], dtype=np.int64) << 32) | self.n
        self.sketch, self.words = table["sketch"].combine_chunks(), _words(self.n, percent)
        self.role = table["role"].to_numpy()
        self.order = np.lexsort((self.id, self.key))

    def of(self, words: int, folded: int, role: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of a length and role, in order, with their sketches folded."""
        at = self.order[(self.words[self.order] == words) & ((self.role[self.order] == role) | (role == 0))]
        m = np.frombuffer(b"".join(self.sketch.take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), words)
        while m.shape[1] > folded:
            half = m.shape[1] // 2
            m = m[:, :half] ^ m[:, half:]
        return at, m


def _alike(left: _Side, right: _Side, percent: int, roles: tuple[int, int], own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in left, in right) of rows that their sketches don't rule out; of a block with its own rows each pair once.

    Rows meet in tiles that stay in a core's cache. So many words are counted of all pairs as rule out sets that have
    nothing to do with each other, the others only of what is left."""
    words, bits, few, apart = (np.zeros(TILE, t) for t in (np.uint64, np.uint8, np.uint8, np.uint32))
    for wl in np.unique(left.words):
        for wr in (wl // 2, wl, wl * 2):
            if not (right.words == wr).any() or (own and wr < wl):
                continue
            w = int(min(wl, wr))
            (at, x), (to, y) = left.of(wl, w, roles[0]), right.of(wr, w, roles[1])
            if not len(at) or not len(to):
                continue
            across = np.ascontiguousarray(y.T)
            key, n, m, code = right.key[to], left.n[at], right.n[to], left.key[at] >> 32 << 32
            low, high = np.searchsorted(key, code | -(-percent * n // 100), "left"), np.searchsorted(key, code | 100 * n // percent, "right")
            if own and wl == wr:  # the same rows in the same order
                low = np.maximum(low, np.arange(len(at)) + 1)
            for s in range(0, len(at), TILE[0]):
                e = min(s + TILE[0], len(at))
                some = high[s:e] > low[s:e]
                if not some.any():
                    continue
                lo, hi = int(low[s:e][some].min()), int(high[s:e].max())
                for lo_ in range(lo, hi, TILE[1]):
                    hi_ = min(hi, lo_ + TILE[1])
                    most = (100 - percent) * int(n[s:e].max() + m[lo_:hi_].max()) // (100 + percent)
                    first = min(w, 1 + int(2 * most + 6 * most**0.5) // 64)
                    word, bit, sum_, all_ = (t[: e - s, : hi_ - lo_] for t in (words, bits, few, apart))
                    all_[...] = 0
                    for k in range(first):
                        np.bitwise_xor(x[s:e, k, None], across[k, lo_:hi_], out=word)
                        if k % 3:
                            np.bitwise_count(word, out=bit)
                            np.add(sum_, bit, out=sum_)
                        else:
                            np.bitwise_count(word, out=sum_)
                        if k % 3 == 2 or k == first - 1:  # three words are at most 192 bits
                            np.add(all_, sum_, out=all_)
                    i, j = np.divmod(np.flatnonzero(all_ <= most), hi_ - lo_)
                    if not len(i):
                        continue
                    far = all_[i, j].astype(np.int64)
                    i, j = i + s, j + lo_
                    most = (100 - percent) * (n[i] + m[j]) // (100 + percent)
                    keep = (far <= most) & (j >= low[i]) & (j < high[i])
                    i, j, far, most = i[keep], j[keep], far[keep], most[keep]
                    for k in range(first, w):
                        if not len(i):
                            break
                        far = far + np.bitwise_count(x[i, k] ^ across[k, j])
                        if k % 4 == 3 or k == w - 1:
                            keep = far <= most
                            i, j, far, most = i[keep], j[keep], far[keep], most[keep]
                    if len(i):
                        yield at[i], to[j]


def _met(rows: DataFrame, cells: list[tuple[int, int]], percent: int, roles: tuple[int, int], first: bool) -> DataFrame:
    def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if left.num_rows and right.num_rows:
            own, least = key[0].as_py() == key[1].as_py(), {}
            codes = {b: k for k, b in enumerate(sorted({*left["bucket"].to_pylist(), *right["bucket"].to_pylist()}))}
            x, y = _Side(left, codes, percent), _Side(right, codes, percent)
            for turned in (False, True)[: 1 if own or roles[0] == roles[1] else 2]:
                for i, j in _alike(x, y, percent, roles[::-1] if turned else roles, own and roles[0] == roles[1]):
                    a, b = (y.id[j], x.id[i]) if turned else (x.id[i], y.id[j])
                    if roles[0] == roles[1]:
                        a, b = np.minimum(a, b), np.maximum(a, b)
                    a, b = a[a < b], b[a < b]
                    if first:  # the first row before each, not all of them
                        order = np.lexsort((a, b))
                        a, b = a[order], b[order]
                        start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
                        for p, q in zip(a[start].tolist(), b[start].tolist(), strict=True):
                            least[q] = min(p, least.get(q, p))
                    else:
                        found.append((a, b))
            if least:
                found.append((np.fromiter(least.values(), np.int64), np.fromiter(least.keys(), np.int64)))
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"a": a, "b": b})

    spark = rows.sparkSession
    by, columns = ["i", "j"], ["id", "bucket", "n", "sketch", "role"]
    side = lambda c: rows.join(F.broadcast(spark.createDataFrame(cells, "i int, j int")), F.col("block") == F.col(c)).select(*[F.col(x).alias(x) for x in by + columns]).groupBy(*by)
    return side("i").cogroup(side("j")).applyInArrow(compare, "a long, b long")


def candidates(rows: DataFrame, cells: list[tuple[int, int]], percent: int) -> DataFrame:
    """(a, b), a < b, of all pairs of placed rows that may be alike."""
    return _met(rows.withColumn("role", F.lit(0)), cells, percent, (0, 0), False)


def between(rows: DataFrame, cells: list[tuple[int, int]], percent: int) -> DataFrame:
    """(a, b), a < b, of placed rows with role 1 and 2 that may be alike."""
    return _met(rows, cells, percent, (1, 2), False)


def behind(rows: DataFrame, cells: list[tuple[int, int]], percent: int) -> DataFrame:
    """(id) of placed rows that some row before them may be like; a task returns each of its rows once at most."""
    return _met(rows.withColumn("role", F.lit(0)), cells, percent, (0, 0), True).select(F.col("b").alias("id")).distinct()


def named(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows(id, ...) less those whose id surely is not in ids(id): one bit an id, in at most FILTER_WORDS words."""
    word = F.pmod(F.shiftright(F.xxhash64("id"), 6), F.lit(FILTER_WORDS)).alias("_word")
    bit = F.pmod(F.xxhash64("id"), F.lit(64)).cast("int")
    bits = ids.select(word, F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64) as int))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return rows.withColumn("_word", word).join(F.broadcast(bits), "_word").where(F.getbit("_bits", bit) == 1).drop("_word", "_bits")


def confirmed(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, common, na, nb) of the pairs(a, b) whose sets are alike by the full members of rows(id, members)."""
    pairs = materialize(pairs.select("a", "b"))
    full = named(rows.select("id", "members"), pairs.select(F.explode(F.array("a", "b")).alias("id")))

    def counts(left: pa.Array, right: pa.Array) -> pa.Array:
        out = [(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)) for x, y in zip(_hashes(left), _hashes(right), strict=True)]
        return pa.StructArray.from_arrays([pa.array([o[k] for o in out], pa.int32()) for k in range(3)], names=["common", "na", "nb"])

    side = lambda c: full.select(F.col("id").alias(c), F.col("members").alias(f"m{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.arrow_udf(counts, "common int, na int, nb int")("ma", "mb").alias("c"))
    return both.select("a", "b", "c.common", "c.na", "c.nb").where(f"100L * common >= {percent}L * (na + nb - common)")
