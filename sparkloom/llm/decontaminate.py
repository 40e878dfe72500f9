"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and items are compared after lower-casing A-Z and turning each ASCII white-space character into a space, so
positions stay those of the input. An item of n characters matches a region of a document when at most
e = floor(edits_percent * n / 100) edits turn one into the other.

An alignment within e edits keeps at least n + 1 - q * (e + 1) of the item's q-grams, all on diagonals (document
position minus item position) no more than e apart, hence inside one of the overlapping diagonal bands used here. A document's shared q-grams are counted by (item, band), only bands that reach the bound
are kept, and those are verified by a banded alignment. e is lowered for short items until the bound is positive;
items shorter than q are searched exactly.

Defined cases: null and empty texts match nothing; null and empty items are skipped; an item that occurs several
times in a document is reported once, at its best (then first) region; repeated document rows are each answered;
items that repeat an id, or have none, are one item with the best match; ids are numbers or strings; texts that repeat
one q-gram very often are counted without listing its pairs; extra columns are ignored (or passed on by ``keep_clean``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import code_points, gram_hashes, lowered, materialize

Q = 10
EDITS_PERCENT = 8
#: Characters of items that one pass over the documents holds in memory; a larger benchmark takes several passes, whose
#: results are joined, so it bounds memory and leaves nothing out. An index takes about 50 bytes a character.
PASS_CHARS = 4_000_000
#: Occurrences among the items beyond which a q-gram may be left out of an item's count.
FREQUENT = 64
#: Pairs of equal q-grams of a text and the items that are built at once.
MOST_PAIRS = 1 << 21
#: Diagonals that one alignment runs over.
MOST_DIAGONALS = 1 << 16


def normalized(text: str | None) -> np.ndarray:
    codes = lowered(code_points(text))
    return np.where((codes >= 9) & (codes <= 13), np.uint32(32), codes)


def edit_budget(n: int, percent: int = EDITS_PERCENT, q: int = Q) -> int:
    """The edits allowed for n characters, such that at least one q-gram must be shared."""
    return max(0, min(n * percent // 100, n // q - 1))


def banded_distance(item: np.ndarray, region: np.ndarray, low: int, high: int, limit: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best alignment of the whole item inside region on diagonals low..high, if within limit.

    Row by row over the item; column d of a row is the region's position i + d. Ties go to the earliest end."""
    width, big = high - low + 1, 1 << 30
    diagonal = np.arange(low, high + 1)
    cost = np.where((diagonal >= 0) & (diagonal <= len(region)), 0, big)
    start = diagonal.copy()
    steps = np.arange(width)
    off = max(0, -low)
    padded = np.full(off + max(len(region), len(item) + high) + 1, 0xFFFFFFFF, dtype=np.uint32)
    padded[off : off + len(region)] = region
    for i, c in enumerate(item, 1):
        at = i + diagonal  # the region's positions after this row
        inside = (at >= 0) & (at <= len(region))
        both = cost + (padded[i + low - 1 + off : i + high + off] != c)
        skip = np.full(width, big)
        skip[:-1] = cost[1:] + 1
        skip_start = start.copy()
        skip_start[:-1] = start[1:]
        take = skip < both
        best, origin = np.where(take, skip, both), np.where(take, skip_start, start)
        best = np.where(inside, best, big)
        lead = best - steps  # a step along the row costs 1
        reach = np.minimum.accumulate(lead)
        source = np.maximum.accumulate(np.where(lead == reach, steps, 0))
        cost, start = np.minimum(reach + steps, big), origin[source]
        cost = np.where(inside, cost, big)
        if cost.min() > limit:
            return None
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), int(len(item) + diagonal[end])


class ItemIndex:
    """The q-grams of benchmark items, sorted by hash, with a bit table that most other q-grams fail.

    Of q-grams that the items hold very often an item leaves out up to half its bound, and its bound sinks by as many;
    the lemma then still holds."""

    def __init__(self, items: list[tuple[object, str]], percent: int = EDITS_PERCENT, q: int = Q):
        self.q = q
        items = [(i, codes) for i, t in items if len(codes := normalized(t))]
        self.short = [(i, codes) for i, codes in items if len(codes) < q]
        items = [(i, codes) for i, codes in items if len(codes) >= q]
        self.ids = [i for i, _ in items]
        self.codes = [codes for _, codes in items]
        n = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.edits = np.array([edit_budget(int(x), percent, q) for x in n], dtype=np.int64)
        self.least = np.maximum(1, n + 1 - q * (self.edits + 1))
        grams = [gram_hashes(c, q) for c in self.codes] or [np.empty(0, dtype=np.uint64)]
        of = np.repeat(np.arange(len(items)), [len(g) for g in grams][: len(items)])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        every = np.concatenate(grams)
        _, kind, often = np.unique(every, return_inverse=True, return_counts=True)
        often = often[kind]
        order = np.lexsort((-often, of))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        out = (often > FREQUENT) & (rank < self.least[of] // 2)
        self.least -= np.bincount(of[out], minlength=len(items))
        of, place, every = of[~out], place[~out], every[~out]
        order = np.argsort(every, kind="stable")
        self.of, self.place = of[order], place[order]
        self.grams, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(order))
        bits = max(16, int(len(self.grams) * 16 - 1).bit_length()) if len(self.grams) else 16
        self.shift = np.uint64(64 - min(bits, 28))
        self.table = np.zeros(1 << min(bits, 28), dtype=bool)
        self.table[self.grams >> self.shift] = True
        self.fewest = int(self.least.min()) if len(items) else 0
        self.offset = max((len(c) for c in self.codes), default=0)

    def _cells(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells (item << 40 | cell of its diagonals), sorted, and the shared q-grams in each."""
        none = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        hashes = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.table[hashes >> self.shift])
        if len(at) < self.fewest:
            return none
        gram = np.searchsorted(self.grams, hashes[at])
        good = gram < len(self.grams)
        at, gram = at[good], gram[good]
        good = self.grams[gram] == hashes[at]
        at, gram = at[good], gram[good]
        if len(at) < self.fewest:
            return none
        counts = self.first[gram + 1] - self.first[gram]
        held = np.zeros(len(self.grams), dtype=np.int64)
        np.add.at(held, gram, 1)
        # Pairs of places are built for q-grams that few places share; for the others they are counted without.
        many = held * (self.first[1:] - self.first[:-1]) > MOST_PAIRS if counts.sum() > MOST_PAIRS else np.zeros(len(held), dtype=bool)
        single = ~many[gram]
        where = np.repeat(self.first[gram[single]] - np.cumsum(counts[single]) + counts[single], counts[single]) + np.arange(counts[single].sum())
        item, diagonal = self.of[where], np.repeat(at[single], counts[single]) - self.place[where]
        total = np.bincount(item, minlength=len(self.ids))
        heavy = np.flatnonzero(many)
        for g in heavy:
            np.add.at(total, self.of[self.first[g] : self.first[g + 1]], held[g])
        # Items whose shared q-grams are too few anywhere go first.
        enough = total >= self.least
        keep = enough[item]
        item, diagonal = item[keep], diagonal[keep]
        cells, shared = np.unique((item << 40) | ((diagonal + self.offset) // (self.edits[item] + 1)), return_counts=True)
        parts = [(cells, shared), *(x for g in heavy for x in self._counted(int(g), at[gram == g], len(codes), enough))]
        if len(parts) > 1:
            cells, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            shared = np.bincount(back, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
        return cells, shared

    def _counted(self, g: int, at: np.ndarray, length: int, enough: np.ndarray):
        """(cells, counts) of one q-gram at places ``at`` of a text, item by item.

        The places are summed up once; each of the item's places then costs one difference per cell."""
        before = np.zeros(length + 1, dtype=np.int64)
        before[at + 1] = 1
        before = np.cumsum(before)
        entries = slice(self.first[g], self.first[g + 1])
        of, place = self.of[entries], self.place[entries]
        for i in np.unique(of):
            if not enough[i]:
                continue
            width = int(self.edits[i]) + 1
            low, high = (int(at[0]) - int(place[of == i].max()) + self.offset) // width, (int(at[-1]) - int(place[of == i].min()) + self.offset) // width
            bounds = np.arange(low, high + 2) * width - self.offset
            shared = np.zeros(high - low + 1, dtype=np.int64)
            for p in place[of == i]:
                shared += np.diff(before[np.clip(bounds + p, 0, length)])
            found = np.flatnonzero(shared)
            yield (int(i) << 40) | (found + low), shared[found]

    def bands(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, lowest, highest diagonal) of the bands that share enough q-grams with an item."""
        cells, held = self._cells(codes)
        if not len(cells):
            return []
        # A band is two neighbouring cells of e + 1 diagonals: any e + 1 successive diagonals lie within one.
        after = np.minimum(np.searchsorted(cells, cells + 1), len(cells) - 1)
        total = held + np.where(cells[after] == cells + 1, held[after], 0)
        of, cell = cells >> 40, cells & ((1 << 40) - 1)
        found, width = total >= self.least[of], self.edits[of] + 1
        return list(zip(of[found].tolist(), (cell * width - self.offset)[found].tolist(), ((cell + 2) * width - 1 - self.offset)[found].tolist(), strict=True))

    def matches(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """(item id, start, end, edits) of the best region of every item found in a text."""
        codes = normalized(text)
        bands = self.bands(codes)
        if not bands and not self.short:
            return []
        whole = codes.astype("<u4").tobytes()
        out = [(i, at, at + len(c), 0) for i, c in self.short if (at := _exact(whole, c)) >= 0]
        for i, parts in groupby(_joined(bands), key=lambda band: band[0]):
            item, e = self.codes[i], int(self.edits[i])
            if (at := _exact(whole, item)) >= 0:
                out.append((self.ids[i], at, at + len(item), 0))
                continue
            for _, low, high in parts:
                a, b = max(0, low - e), min(len(codes), high + len(item) + e)
                if found := banded_distance(item, codes[a:b], low - e - a, high + e - a, e):
                    out.append((self.ids[i], found[1] + a, found[2] + a, found[0]))
        # The best region of an item, of its equal ones the first.
        best = {}
        for m in sorted(out, key=lambda m: (m[3], m[1], m[2])):
            best.setdefault(m[0], m)
        return sorted(best.values(), key=lambda m: (m[0] is None, m[0] if m[0] is not None else 0))


def _exact(whole: bytes, codes: np.ndarray) -> int:
    """The first place of codes in a text of little-endian 32-bit code points, or -1."""
    needle = codes.astype("<u4").tobytes()
    at = whole.find(needle)
    while at % 4 and at >= 0:
        at = whole.find(needle, at + 1)
    return at // 4 if at >= 0 else -1


def _joined(bands: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping bands of an item as one, as far as MOST_DIAGONALS; a wider one is cut where two bands still overlap."""
    out: list[tuple[int, int, int]] = []
    for i, low, high in sorted(bands):
        if out and out[-1][0] == i and low <= out[-1][2] + 1 and high - out[-1][1] < MOST_DIAGONALS:
            out[-1] = (i, out[-1][1], max(high, out[-1][2]))
        else:
            out.append((i, low, high))
    return out


def _passes(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The items, in lists of about PASS_CHARS characters (or one longer item); only one list is on the driver at a time."""
    items = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("t <> ''")
    size = items.agg(F.sum(F.char_length("t"))).first()[0] or 0
    passes = -(-size // PASS_CHARS)
    dealt = materialize(items.withColumn("pass", F.pmod(F.xxhash64("i", "t"), F.lit(max(1, passes))))) if passes > 1 else items.withColumn("pass", F.lit(0))
    for n in range(passes):
        found = [(r["i"], r["t"]) for r in dealt.where(F.col("pass") == n).select("i", "t").toLocalIterator()]
        yield sorted(found, key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1]))


def _matcher(docs: DataFrame, benchmark: DataFrame, item: str, items: list[tuple[object, str]], percent: int):
    """A function of texts that gives the matches of the items, and the broadcast that it uses."""
    shared = docs.sparkSession.sparkContext.broadcast(ItemIndex(items, percent))
    kind = benchmark.schema[item].dataType
    arrow_kind = benchmark.select(item).limit(0).toArrow().schema.field(0).type
    out = pa.list_(pa.struct([("item_id", arrow_kind), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))
    names = ("item_id", "start", "end", "edits")

    def found(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(names, m, strict=True)) for m in shared.value.matches(t.as_py())] for t in texts], type=out)

    return F.arrow_udf(found, f"array<struct<item_id {kind.simpleString()}, start long, end long, edits long>>")


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = EDITS_PERCENT, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, start, end, edits) for every document and benchmark item found in it."""
    out = None
    for items in _passes(benchmark, item, item_text):
        if out is not None:  # finish the pass before, so that its index goes
            out = materialize(out)
        find = _matcher(docs, benchmark, item, items, percent)
        one = docs.select(F.col(key).alias("key"), find(F.col(text)).alias("m")).where(F.size("m") > 0).select("key", F.explode("m").alias("m"))
        one = one.select(F.col("key").alias(key), "m.*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        kind = benchmark.schema[item].dataType
        out = docs.limit(0).select(F.col(key), F.lit(None).cast(kind).alias("item_id"), *[F.lit(None).cast("long").alias(c) for c in ("start", "end", "edits")])
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, percent: int = EDITS_PERCENT, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows in which a benchmark item is found; all columns stay."""
    for n, items in enumerate(_passes(benchmark, item, item_text)):
        if n:
            docs = materialize(docs)
        docs = docs.where(F.size(_matcher(docs, benchmark, item, items, percent)(F.col(text))) == 0)
    return docs
