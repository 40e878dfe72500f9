"""Suffix-array dedup: bytes covered by a string of 200 bytes that also starts anywhere else in the corpus.

A suffix array over the whole corpus would be far larger than the corpus, so its suffixes are first brought
together by content. Each 200-byte string is filed under the smallest hash among its 32-byte windows (the leftmost
of equal ones); equal strings are always filed alike. Successive strings of a document with the same smallest
window form a segment, 92 strings on average. Then:

1. Segments whose window hash occurs once in the corpus hold no repeat and are dropped.
2. Equal segments are folded before the sort, by their bytes' hash within a window hash; all strings of a segment that
   occurs twice repeat. Of each kind one goes on.
3. The different segments of a window hash go to one shard, and each shard (about a megabyte) builds the suffix
   array of its segments by two-stage sorting: only suffixes smaller than their successors are sorted directly, the
   others are induced by a scan over the buckets of first bytes. Strings whose common prefix with a neighbour in
   the array reaches 200 bytes repeat.
4. A window hash with more than HOT different segments would make one task large. Its segments are halved: all their
   strings hold the window, and each holds at least half of the other bytes on the left or on the right of it, so a
   string is filed under that half as well. Equal halves are folded, halves that stay alone hold no repeat and are
   dropped, and groups that are still too large are halved again, at most eight times; then they go to the shards.

Matches never cross documents, and are judged on the input, not on what is left.

Defined cases: a null text is empty; texts shorter than 200 bytes lose nothing; rows that repeat are copies of each
other and lose everything from 200 bytes on; null ids are allowed; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import _tables, materialize, utf8

LENGTH = 200
WINDOW = 32
#: Bytes of segments in a shard, on average.
SHARD_BYTES = 1_000_000
#: Different segments filed alike that a shard may take; larger groups are halved first.
HOT = 1_024
SEPARATOR = 0xFF  # never occurs in UTF-8


def sliding_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w successive values, from prefix and suffix minima of blocks of w."""
    n = len(h) - w + 1
    blocks = np.full(-(-len(h) // w) * w, np.iinfo(h.dtype).max, dtype=h.dtype)
    blocks[: len(h)] = h
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def window_hashes(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A hash of each window of a text, which files strings and decides nothing."""
    n = len(data)
    power, inverse = _tables(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data + np.uint64(1)) * power[:n], out=sums[1:])
    grams = n - window + 1
    h = (sums[window:] - sums[:grams]) * inverse[:grams]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def segments(data: np.ndarray, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window hash, digest, first start and number of starts of each segment of a text."""
    n = len(data)
    if n < length:
        return (np.empty(0, dtype=np.uint64),) * 2 + (np.empty(0, dtype=np.int64),) * 2
    h = window_hashes(data, window)
    least = sliding_minimum(h, length - window + 1)
    # The string's smallest window is another one if its hash changes, or if it began the string before.
    moved = (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1])
    first = np.concatenate([[0], np.flatnonzero(moved) + 1])
    count = np.diff(first, append=len(least))
    end = first + count - 1 + length
    whole = memoryview(data)
    digest = np.fromiter((xxhash.xxh3_64_intdigest(whole[s:e]) for s, e in zip(first.tolist(), end.tolist(), strict=True)), dtype=np.uint64, count=len(first))
    return least[first], digest, first, count


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The wanted positions of text (uint8), and those their order depends on, sorted by suffix up to depth bytes.

    Two-stage sorting: suffixes smaller than their successors (type B) are sorted directly; each other one (type A)
    is placed in the bucket of its first byte when the scan over the buckets meets its successor."""
    n = len(text)
    differs = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)  # the last suffix is larger than the empty one
    runs = np.diff(differs, prepend=-1)
    rises = np.append(text[differs[:-1]] < text[differs[:-1] + 1], False)
    type_b = np.repeat(rises, runs)
    # A wanted type A needs its successors up to the next type B.
    chosen = np.zeros(n, dtype=bool)
    chosen[wanted] = True
    next_b = np.where(type_b, np.arange(n), n)
    next_b = np.minimum.accumulate(next_b[::-1])[::-1]
    starts = np.flatnonzero(chosen)
    marks = np.zeros(n + 2, dtype=np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(next_b[starts], n - 1) + 1, -1)
    chosen = np.cumsum(marks)[:n] > 0

    padded = np.concatenate([text, np.zeros(depth, dtype=np.uint8)])
    strings = np.ndarray(shape=(n,), dtype=f"S{depth}", buffer=padded.data, strides=(1,))
    b = np.flatnonzero(chosen & type_b)
    b = b[np.argsort(strings[b], kind="stable")] if len(b) else b
    b_of = np.searchsorted(text[b], np.arange(257))

    induced_first = np.zeros(n, dtype=bool)
    induced_first[: n - 1] = chosen[: n - 1] & ~type_b[: n - 1]
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    if chosen[n - 1]:  # induced by the empty suffix
        pending[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        bucket, frontier = [], np.concatenate(pending[c]) if pending[c] else np.empty(0, dtype=np.int64)
        while len(frontier):
            bucket.append(frontier)
            before = frontier[frontier > 0] - 1
            frontier = before[induced_first[before] & (text[before] == c)]
        bucket.append(b[b_of[c] : b_of[c + 1]])
        scanned = np.concatenate(bucket)
        out.append(scanned)
        before = scanned[scanned > 0] - 1
        before = before[induced_first[before] & (text[before] > c)]
        if len(before):
            before = before[np.argsort(text[before], kind="stable")]
            heads = text[before]
            cuts = np.flatnonzero(heads[1:] != heads[:-1]) + 1
            for part in np.split(before, cuts):
                pending[text[part[0]]].append(part)
    return np.concatenate(out)


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as one number; past the end they are zero."""
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(shape=(len(text) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the starts begin a string of length bytes (length a multiple of 8) that also starts at another of them."""
    order = suffix_order(text, starts, length)
    is_start = np.zeros(len(text), dtype=bool)
    is_start[starts] = True
    order = order[is_start[order]]
    words = words_at(text)
    pairs = np.arange(len(order) - 1)
    for k in range(0, length, 8):  # adjacent common prefixes, as far as length
        pairs = pairs[words[order[pairs] + k] == words[order[pairs + 1] + k]]
    repeats = np.zeros(len(text), dtype=bool)
    repeats[order[pairs]] = repeats[order[pairs + 1]] = True
    return repeats[starts]


def _segment_rows(length: int):
    names = ["id", "text_hash", "hash", "digest", "start", "n", "copies"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cols: list[list[np.ndarray]] = [[] for _ in names]
                for i, h, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    window, digest, first, n = segments(utf8(t.as_py()), length)
                    if not len(window):
                        continue
                    _, one, place, copies = np.unique(digest, return_index=True, return_inverse=True, return_counts=True)
                    here = copies[place] > 1  # repeats within the document are settled here, in runs of starts
                    begins, stops = (first[here], first[here] + n[here])
                    cuts = np.flatnonzero(begins[1:] != stops[:-1])
                    if len(begins):
                        begins, stops = begins[np.append(0, cuts + 1)], stops[np.append(cuts, -1)]
                    k, zero = len(one) + len(begins), np.zeros(len(begins), dtype=np.int64)
                    cols[0].append(np.full(k, i)), cols[1].append(np.full(k, h))
                    cols[2].append(np.concatenate([window[one].astype(np.int64), zero])), cols[3].append(np.concatenate([digest[one].astype(np.int64), zero]))
                    cols[4].append(np.concatenate([first[one], begins]).astype(np.int32)), cols[5].append(np.concatenate([n[one], stops - begins]).astype(np.int32))
                    cols[6].append(np.concatenate([copies, zero]).astype(np.int32))
                kinds = (np.int64,) * 4 + (np.int32,) * 3
                yield pa.record_batch([pa.array(np.concatenate(c) if c else np.empty(0, k)) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def _slices(length: int):
    """The bytes of the wanted segments of each text."""

    def run(batches):
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                data, rows = (text.as_py() or "").encode("utf-8", "surrogatepass"), wanted.as_py()
                pieces = [data[r["start"] : r["start"] + r["n"] - 1 + length] for r in rows]
                columns = [pa.array([r[c] for r in rows], type=pa.int32() if c in ("start", "n") else pa.int64()) for c in ("id", "text_hash", "hash", "digest", "c", "distinct", "start", "n")]
                yield pa.record_batch([*columns, pa.array(pieces, type=pa.binary())], names=["id", "text_hash", "hash", "digest", "c", "distinct", "start", "n", "bytes"])

    return run


def _flag_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


FLAGS = "id long, text_hash long, start int, n int"


def _shard(length: int):
    def run(key, table):
        rows = {(r["hash"], r["digest"]): r for r in table.to_pylist()}  # a row of the table may come twice
        rows = [rows[k] for k in sorted(rows)]
        text = np.frombuffer(b"".join(r["bytes"] + bytes([SEPARATOR]) for r in rows), dtype=np.uint8)
        sizes = np.array([len(r["bytes"]) + 1 for r in rows])
        counts = np.array([r["n"] for r in rows])
        at = np.cumsum(sizes) - sizes
        starts = np.repeat(at - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        flags = np.zeros(len(text) + 1, dtype=bool)
        flags[starts] = repeated_starts(text, starts, length)
        out: list[tuple] = []
        for r, a, n in zip(rows, at, counts, strict=True):
            if r["c"] == 1:  # all strings of the others are settled
                for s, e in zip(*_flag_runs(flags[a : a + n]), strict=True):
                    out.append((r["id"], r["text_hash"], r["start"] + int(s), int(e - s)))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.table([pa.array([r[i] for r in out], type=k) for i, k in enumerate(kinds)], names=["id", "text_hash", "start", "n"])

    return run


def _halves(length: int, window: int = WINDOW):
    """Each segment in two, filed by more of the text that its strings share; see the module.

    All strings of a segment hold bytes low..high of it. Those that start m bytes or more before low hold m bytes more
    on the left, the others hold the rest on the right, so the bytes not yet shared are halved."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                data, low, high, n = r["bytes"], r["low"], r["high"], r["n"]
                if low is None:
                    low = int(np.argmin(window_hashes(np.frombuffer(data[:length], dtype=np.uint8), window)))
                    high = low + window
                rest = length - (high - low)
                m = (rest + 1) // 2
                cut = max(0, min(n, low - m + 1)) if rest else n
                for side, a, b, s, e in ((b"l", 0, cut, low - m, high), (b"r", cut, n, low, high + rest - m + 1)):
                    if a < b:
                        group = xxhash.xxh3_64_intdigest(side + r["hash"].to_bytes(8, "little", signed=True) + data[s:e])
                        part = data[a : b - 1 + length]
                        out.append((_signed(group), _signed(xxhash.xxh3_64_intdigest(part)), r["id"], r["text_hash"], r["c"], r["start"] + a, b - a, s - a, e - a, part))
            kinds = (pa.int64(),) * 5 + (pa.int32(),) * 4 + (pa.binary(),)
            yield pa.record_batch([pa.array([r[i] for r in out], type=k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in HALF.split(", ")])

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


HALF = "hash long, digest long, id long, text_hash long, c long, start int, n int, low int, high int, bytes binary"


def repeated_runs(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(id, text_hash, start, n): runs of n successive starts of repeated strings, for docs(id long, text)."""
    docs = docs.select("id", F.xxhash64("text").alias("text_hash"), "text")
    every = docs.where(F.octet_length("text") >= length).select("id", "text_hash", "text")
    every = materialize(every.mapInArrow(_segment_rows(length), "id long, text_hash long, hash long, digest long, start int, n int, copies int"))
    found = every.where("copies > 0")
    shared = found.groupBy("hash").agg(F.sum("copies").alias("c")).where("c > 1").select("hash")
    met = materialize(found.join(shared, "hash"))
    kinds = met.groupBy("hash", "digest").agg(F.sum("copies").alias("c"), F.min(F.struct("id", "text_hash", "start", "n")).alias("one"))
    kinds = materialize(kinds)
    spread = kinds.groupBy("hash").agg(F.count("*").alias("distinct"))
    kinds = kinds.join(spread, "hash")

    settled = every.where("copies = 0").select("id", "text_hash", "start", "n")
    copies = met.where("copies = 1").join(kinds.where("c > 1").select("hash", "digest"), ["hash", "digest"]).select("id", "text_hash", "start", "n")

    apart = kinds.where("distinct > 1").select("hash", "digest", "c", "distinct", "one.*")
    wanted = apart.groupBy("id", "text_hash").agg(F.collect_list(F.struct("id", "text_hash", "hash", "digest", "c", "distinct", "start", "n")).alias("wanted"))
    pieces = docs.join(wanted, ["id", "text_hash"]).select("text", "wanted")
    schema = "id long, text_hash long, hash long, digest long, c long, distinct long, start int, n int, bytes binary"
    pieces = materialize(pieces.mapInArrow(_slices(length), schema))
    sort = ["hash", "digest", "id", "text_hash", "c", "start", "n", "bytes"]
    ready, repeats = pieces.where(F.col("distinct") <= hot).select(sort), [settled, copies]
    many = pieces.where(F.col("distinct") > hot).dropDuplicates(["hash", "digest"]).select(*sort, F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))
    while not many.isEmpty():
        halves = materialize(many.mapInArrow(_halves(length), HALF))
        one = F.min(F.struct("id", "text_hash", "start", "n", "low", "high", "bytes")).alias("one")
        same = materialize(halves.groupBy("hash", "digest").agg(F.sum("c").alias("c"), one))
        repeats.append(halves.where("c = 1").join(same.where("c > 1").select("hash", "digest"), ["hash", "digest"]).select("id", "text_hash", "start", "n"))
        same = same.join(same.groupBy("hash").agg(F.count("*").alias("distinct")).where("distinct > 1"), "hash").select("hash", "digest", "c", "distinct", "one.*")
        ready = ready.unionByName(same.where(F.col("distinct") <= hot).select(sort))
        many = same.where(F.col("distinct") > hot).select(*sort, "low", "high")
    size = ready.agg(F.sum(F.col("n") + (length - 1))).first()[0] or 0
    sharded = ready.withColumn("shard", F.pmod(F.xxhash64("hash"), F.lit(max(1, -(-size // SHARD_BYTES)))))
    repeats.append(sharded.groupBy("shard").applyInArrow(_shard(length), FLAGS))
    return reduce(DataFrame.unionByName, repeats)


def _union(runs: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by strings that start in the runs."""
    out: list[list[int]] = []
    for s, e in sorted((r["start"], r["start"] + r["n"] - 1 + length) for r in runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(key, n_bytes, spans array<struct<start, end>>, kept binary) for every row of docs."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    runs = repeated_runs(rows, length, hot).groupBy("id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("runs"))

    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, runs in zip(texts, found, strict=True):
            data, spans = t.as_py().encode("utf-8", "surrogatepass"), _union(runs.as_py() or [], length)
            edges = [0, *(x for s in spans for x in s), len(data)]
            out.append({"n_bytes": len(data), "spans": [{"start": s, "end": e} for s, e in spans], "kept": b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))})
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.array(out, type=pa.struct([("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())]))

    done = F.arrow_udf(cut, "n_bytes long, spans array<struct<start long, end long>>, kept binary")
    joined = rows.withColumn("text_hash", F.xxhash64("text")).join(runs, ["id", "text_hash"], "left")
    return joined.select(F.col("key").alias(key), done("text", "runs").alias("r")).select(key, "r.*")
