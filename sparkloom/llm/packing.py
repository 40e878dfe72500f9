"""Best-fit packing of token pieces into fixed-length sequences, certified by dual-feasible lower bounds.

Texts are tokenised in Arrow batches; a document longer than a sequence is cut into full pieces, its remainder
first. Pieces are dealt to partitions of bounded size and packed there by best-fit decreasing. Dual-feasible functions
over a histogram of lengths give a lower bound on its bins, for each partition and for all pieces together. A partition
that misses its bound is packed in other orders too, completing one bin after the other, and the best packing is taken.
While the whole isn't certified, partitions with gaps exchange documents: bins with no more room than all bins must have
on average stay, the others are pooled, dealt anew with another salt and packed again, until the bound of the whole is
met, a round gains nothing, or a single partition is left. Each row tells the bins and the bound of the partition it was packed in and of
the whole run, so what stays uncertified shows.

Defined cases: a null text is empty; every document ends with one end token, so none is empty; repeated rows and
ids are separate documents; very long texts and runs of one character or of white space are tokenised whole; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize

CAPACITY = 1024
END_TOKEN = 2
#: Pieces packed by one task. Small partitions lose a part of a bin each, which the exchange brings back.
PER_PARTITION = 1_000
#: Room that a completed bin may keep so that longer pieces can fill it, in the order they are tried.
SLACKS = (8, 4, 16, 2)
#: Rounds at most; their number is part of a sequence's name.
ROUNDS = 6
PIECES = "piece int, start long, length long, ids binary"


# Fixed value: how byte-level BPE splits a text before merging.
BYTE_LEVEL_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str):
    """text -> little-endian ids as the tokenizer file at path gives them, without added special tokens.

    A plain byte-level BPE file runs in a faster encoder of the same vocabulary; others run as they are."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    spec = json.loads(tokenizer.to_str())
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and model["type"] == "BPE"
    if not plain or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", [])):
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    import tiktoken

    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> bytes:
        try:
            ids = fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # a run of white space so long that the faster encoder's pattern gives up
            ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids)
        return ids.astype("<u4").tobytes()

    return encode


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids): the pieces of every document, ids as little-endian unsigned 32-bit integers."""
    end = np.array([END_TOKEN], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                places, piece, start, length, ids = [], [], [], [], []
                for i, t in enumerate(part.column(1)):
                    all_ids = encode(t.as_py() or "") + end
                    n = len(all_ids) // 4
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n, capacity), n]
                    for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        places.append(i), piece.append(j), start.append(a), length.append(b - a), ids.append(all_ids[4 * a : 4 * b])
                yield pa.record_batch(
                    [part.column(0).take(pa.array(places, type=pa.int64())), pa.array(piece, type=pa.int32()), pa.array(start, type=pa.int64()), pa.array(length, type=pa.int64()), pa.array(ids, type=pa.binary())],
                    names=["key", "piece", "start", "length", "ids"],
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {PIECES}").withColumnRenamed("key", key)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best dual-feasible-function bound on the bins that lengths need."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """The same from how many pieces have each length.

    Used are the identity, the rounding functions u_k and the threshold functions of Martello and Toth."""
    counts = counts.astype(np.float64)
    sizes = np.arange(capacity + 1, dtype=np.float64)
    best = -(-int((counts * sizes).sum()) // capacity)
    for k in range(1, 51):
        scaled = (k + 1) * sizes / capacity
        whole = np.isclose(scaled, np.round(scaled))
        u = np.where(whole, sizes / capacity, np.floor(scaled) / k)
        best = max(best, int(np.ceil((counts * u).sum() - 1e-7)))
    for t in range(1, capacity // 2 + 1):
        u = np.where(sizes > capacity - t, capacity, np.where(sizes < t, 0, sizes))
        best = max(best, int(-(-int((counts * u).sum()) // capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every piece, and the room left in every bin."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, have = [], 0  # bit r of have: some bin has room r
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        fitting = have >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                have &= ~(1 << room)
        else:
            b, room = len(rooms), capacity
            rooms.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        rooms[b] = room - need
        if rooms[b]:
            open_bins[rooms[b]].append(b)
            have |= 1 << rooms[b]
    return bins, offsets, np.array(rooms, dtype=np.int64)


def complete_bins(lengths: np.ndarray, capacity: int, slack: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as best_fit_decreasing(), by completing one bin after the other: the longest piece left, with pieces that
    fill its room but for ``slack`` at most, or as well as any can, the longest first. Sums are bits of an integer, so
    all are tried; slack keeps the short pieces for the bins that need them."""
    left: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable")[::-1]:
        left.setdefault(int(lengths[i]), []).append(int(i))
    bins, offsets, rooms = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), []
    sizes = sorted(left)
    while sizes:
        room = capacity - sizes[-1]
        chosen, sums, parts = [sizes[-1]], [1], []
        inside = (1 << room + 1) - 1
        for size in sizes:
            if size > room:
                break
            count, step = min(len(left[size]) - (size == sizes[-1]), room // size), 1
            while count > 0:
                n = min(step, count)
                sums.append(sums[-1] | sums[-1] << n * size & inside)
                parts.append((size, n))
                count, step = count - n, 2 * step
        most = sums[-1].bit_length() - 1
        least = max(0, min(most, room - slack))
        for j in range(len(parts) - 1, -1, -1):
            size, n = parts[j]
            low, high = max(0, least - n * size), most - n * size
            if high >= 0 and sums[j] >> low & (1 << high - low + 1) - 1:  # what is left can still be filled
                chosen += [size] * n
                least, most = low, high
        at = 0
        for size in chosen:
            i = left[size].pop()
            bins[i], offsets[i], at = len(rooms), at, at + size
        rooms.append(capacity - at)
        sizes = [s for s in sizes if left[s]]
    return bins, offsets, np.array(rooms, dtype=np.int64)


def _pack_round(items: DataFrame, partitions: int, salt: int, capacity: int) -> DataFrame:
    """items(item, length) with part, bin, offset, room, and the part's bins and bound."""

    def run(key, table):
        table = table.sort_by([("length", "descending"), ("item", "ascending")])
        lengths = table["length"].to_numpy()
        n, bound = len(lengths), lower_bound(lengths, capacity)
        bins, offsets, rooms = best_fit_decreasing(lengths, capacity)
        for slack in SLACKS:
            if len(rooms) == bound:
                break
            other = complete_bins(lengths, capacity, slack)
            if (len(other[2]), -(other[2] ** 2).sum()) < (len(rooms), -(rooms**2).sum()):
                bins, offsets, rooms = other
        columns = [table["item"], table["length"], table["part"], pa.array(bins), pa.array(offsets), pa.array(rooms[bins]), pa.array(np.full(n, len(rooms))), pa.array(np.full(n, bound))]
        return pa.table(columns, names=["item", "length", "part", "bin", "offset", "room", "bins", "bound"])

    dealt = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(partitions)).alias("part"))
    return dealt.groupBy("part").applyInArrow(run, "item long, length long, part long, bin long, offset long, room long, bins long, bound long")


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """items(item long, length long), lengths at most capacity -> (item, sequence_id, offset, part_bins, part_bound, run_bins, run_bound).

    Offsets are gapless from 0 in every sequence. part_bins and part_bound are the sequences of the partition that the
    item was packed in, and the lower bound on them; run_bins and run_bound those of all items."""
    one, long = F.lit(1).cast("long"), lambda n: F.lit(n).cast("long")
    full = items.where(F.col("length") == capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), one.alias("part_bins"), one.alias("part_bound"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in items.groupBy("length").count().collect():  # at most one row a length
        counts[r["length"]] = r["count"]
    bound, done = bound_of_counts(counts, capacity), int(counts[capacity])
    spare = int(bound * capacity - (counts * np.arange(capacity + 1)).sum()) // max(1, bound)

    def named(packed: DataFrame, salt: int) -> DataFrame:
        # Round, partition and bin each have bits of their own; full pieces are named by their item, below 2**60.
        name = F.expr(f"shiftleft({salt + 1}L, 60) + shiftleft(part, 24) + bin")
        return packed.select("item", name.alias("sequence_id"), "offset", F.col("bins").alias("part_bins"), F.col("bound").alias("part_bound"))

    rest, settled = items.where(F.col("length") < capacity), full
    n, salt, before = int(counts[:capacity].sum()), 0, None
    while n:
        packed = materialize(_pack_round(rest, -(-n // per_partition), salt, capacity))
        parts = packed.groupBy("part").agg(F.max("bins").alias("bins"))
        made = parts.agg(F.sum("bins").alias("bins"), F.count("*").alias("parts")).first()
        if before is not None and made["bins"] >= before[1]:  # the exchange gained nothing: the bins stay as they were
            settled, done = settled.unionByName(named(before[0], salt - 1)), done + before[1]
            break
        # What one partition has packed alone would be packed alike again.
        if salt + 1 >= rounds or done + made["bins"] <= bound or made["parts"] == 1:
            settled, done = settled.unionByName(named(packed, salt)), done + made["bins"]
            break
        settled = settled.unionByName(named(packed.where(F.col("room") <= spare), salt))
        pooled = packed.where(F.col("room") > spare)
        open_bins = pooled.select("part", "bin").distinct().count()
        done, before = done + made["bins"] - open_bins, (pooled, open_bins)
        rest, salt = pooled.select("item", "length"), salt + 1
        n = rest.count()
    return settled.withColumns({"run_bins": long(done), "run_bound": long(bound)})


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", per_partition: int = PER_PARTITION) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset, part_bins, part_bound, run_bins, run_bound) for every piece of every document."""
    pieces = tokenize(docs, tokenizer_path, capacity, key, text).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    pieces = materialize(pieces.withColumn("item", F.monotonically_increasing_id()))
    placed = pack(pieces.select("item", "length"), capacity, per_partition)
    return pieces.join(placed, "item").select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "part_bins", "part_bound", "run_bins", "run_bound")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of every sequence, from pieces(item, ids) and placed(item, sequence_id, offset)."""
    parts = pieces.select("item", "ids").join(placed, "item")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    return parts.groupBy("sequence_id").agg(F.unhex(F.array_join(ordered, "")).alias("ids"))

