"""Benchmark decontamination: notices that hold passages of evaluation items."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docketlake.llm import kernel
from docketlake.llm.notices import KEY, TEXT

N = 5                    # words of a shingle
RADIUS = 20              # largest distance of 64-bit fingerprints; similarity 0.8 lies at 9.7 +- 2.9 bits
BLOCKS = 4               # fingerprint blocks of 16 bits; one of them is within RADIUS // BLOCKS
ITEM_BYTES = 16 << 20    # text of the items that one broadcast holds, at most
WINDOW_BLOCK = 4096      # windows fingerprinted at once

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_BITS = np.arange(64, dtype=np.uint64)
_POP16 = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _words(s: kernel.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a lower-cased slice: runs without ASCII punctuation or space."""
    begin, end = kernel.runs(~_SEPARATOR[s.buf], s.start, s.end)
    return kernel.ordered_hashes(s.buf, begin, end), begin


def _lowered(batch: pa.RecordBatch, text: str) -> pa.RecordBatch:
    at = batch.schema.get_field_index(text)
    return batch.set_column(at, text, pc.utf8_lower(pc.fill_null(batch.column(text).cast(pa.large_string()), "")))


def fingerprints(shingles: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the windows of ``width`` shingles that begin at each ``start``; repeats count as often as they occur."""
    first = int(start.min())
    part = shingles[first: int(start.max()) + width]
    votes = ((part[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(votes, axis=0, dtype=np.int32)])
    ahead = total[start - first + width] - total[start - first] > 0
    return (ahead.astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def weighted_similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two shingle multisets."""
    a, b = Counter(x.tolist()), Counter(y.tolist())
    both = sum(min(c, b[k]) for k, c in a.items() if k in b)
    return both / (len(x) + len(y) - both)


class _Items:
    """Items of one broadcast: shingle lookup and a multi-index per window length."""

    def __init__(self, ids: list, texts: list[str]):
        s = kernel.from_texts(pc.utf8_lower(pa.array(texts, pa.large_string())).to_pylist())
        hashes, begin = _words(s)
        self.ids, self.size, self.shingles = [], [], []
        for key, a, b in zip(ids, *kernel.row_bounds(s, begin), strict=True):
            if b > a:
                self.ids.append(key)
                self.size.append(int(b - a))
                self.shingles.append(kernel.chain(hashes[a:b], min(N, b - a)))
        owner = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.shingles])
        token = np.concatenate(self.shingles) if self.ids else np.zeros(0, np.uint64)
        pairs = np.unique(np.stack([token, owner.astype(np.uint64)]), axis=1) if len(token) else np.zeros((2, 0), np.uint64)
        self.token, self.owner = pairs[0], pairs[1].astype(np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.token & np.uint64((1 << 20) - 1)).view(np.int64)] = True
        self.short = sorted({n for n in self.size if n < N})
        self.of_size = {n: [i for i, m in enumerate(self.size) if m == n] for n in set(self.size)}
        self.print = np.concatenate([fingerprints(x, np.zeros(1, np.int64), len(x)) for x in self.shingles]) \
            if self.ids else token
        self.tables: dict[tuple[int, int], np.ndarray] = {}

    def hits(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles that some item has, with those items."""
        at = np.flatnonzero(self.maybe[(shingles & np.uint64((1 << 20) - 1)).view(np.int64)])
        low, high = (np.searchsorted(self.token, shingles[at], side) for side in ("left", "right"))
        count = high - low
        where = np.repeat(at, count)
        step = np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count)
        return where, self.owner[np.repeat(low, count) + step]

    def within(self, prints: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
        """For items of a length: window numbers whose fingerprint lies within the radius.

        Two fingerprints within RADIUS bits differ by at most RADIUS // BLOCKS in one block, so the
        items of every block value within that distance are all the candidates there are.
        """
        members = self.of_size[size]
        for part in range(0, len(members), 64):
            group = members[part: part + 64]
            table = self.tables.get((size, part))
            if table is None:
                table = self.tables[size, part] = np.zeros((BLOCKS, 1 << 16), np.uint64)
                values = np.arange(1 << 16, dtype=np.uint64)
                for j, item in enumerate(group):
                    for b in range(BLOCKS):
                        near = _POP16[values ^ (self.print[item] >> np.uint64(16 * b) & np.uint64(0xFFFF))]
                        table[b] |= (near <= RADIUS // BLOCKS).astype(np.uint64) << np.uint64(j)
            mask = np.zeros(len(prints), np.uint64)
            for b in range(BLOCKS):
                mask |= table[b][(prints >> np.uint64(16 * b) & np.uint64(0xFFFF)).view(np.int64)]
            for j, item in enumerate(group):
                at = np.flatnonzero(mask >> np.uint64(j) & np.uint64(1))
                yield item, at[np.bitwise_count(prints[at] ^ self.print[item]) <= RADIUS]


def _matches(items: _Items, hashes: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, float, int]]:
    """Best window of one text for each item: item, first word, words, similarity, distance."""
    windows: dict[int, list[tuple[int, int]]] = {}
    for n in [*items.short, N]:
        where, item = items.hits(kernel.chain(hashes, n))
        for p, i in zip(where.tolist(), item.tolist(), strict=True):
            size = items.size[i]
            if min(size, N) == n:
                last = max(len(hashes) - size, 0)
                windows.setdefault(size, []).append((min(max(p - size + n, 0), last), min(p, last)))
    best: dict[int, tuple[float, int, int, int]] = {}
    for size, spans in windows.items():
        width = min(size, len(hashes))
        shingles = kernel.chain(hashes, min(N, width))
        shingle_width = max(width - N + 1, 1)
        cover = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in set(spans)]))
        for block in range(0, len(cover), WINDOW_BLOCK):
            starts = cover[block: block + WINDOW_BLOCK]
            for group in np.split(starts, np.flatnonzero(np.diff(starts) > 4 * shingle_width) + 1):
                prints = fingerprints(shingles, group, shingle_width)
                for item, near in items.within(prints, size):
                    for k in near.tolist():
                        first = int(group[k])
                        alike = weighted_similarity(shingles[first: first + shingle_width], items.shingles[item])
                        if alike >= threshold:
                            far = int(np.bitwise_count(prints[k] ^ items.print[item]))
                            best[item] = max(best.get(item, (0.0, 0, 0, 0)), (alike, -first, width, far))
    for item, (alike, first, width, far) in best.items():
        yield item, -first, width, alike, far


def leaked_items(notices: DataFrame, items: DataFrame, key: str = KEY, text: str = TEXT, item_key: str = "item_id",
                 item_text: str = "text", threshold: float = 0.8, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Notices that hold an evaluation item: one row per notice and item, with the best window.

    Columns ``key, item_id, start_word, n_words, similarity, distance``.  Words are lower-cased
    runs without ASCII punctuation and space.  A window has as many words as the item (all words
    of a shorter text).  Windows that share a shingle with an item - no other can be similar -
    get a SimHash; windows within ``RADIUS`` bits, found by the multi-index, are compared by the
    Jaccard similarity of their five-word shingles, repeats counted; ``threshold`` or more is a
    leak.  Ties go to the first window.  Items of under five words are one shingle.  NULL, empty
    and wordless notices and items never match; repeated rows give repeated results for notices
    and one result for items.  Other columns are ignored.

    Notices stay where they lie.  Items are broadcast in blocks of at most ``item_bytes`` of
    text, one pass over the notices per block.
    """
    spark = notices.sparkSession
    own = items.select(F.col(item_key).alias("id"), F.col(item_text).alias("t")).where(F.length("t") > 0).distinct()
    total = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    # Half the bound on average, so that an uneven block stays below it.
    blocks = max(1, -(-2 * total // item_bytes))
    item_kind = items.schema[item_key].dataType
    schema = T.StructType([T.StructField(key, notices.schema[key].dataType), T.StructField("item_id", item_kind)]) \
        .add("start_word", "long").add("n_words", "long").add("similarity", "double").add("distance", "integer")
    id_type = to_arrow_type(item_kind)
    found = None
    for block in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == block).collect()
        sent = spark.sparkContext.broadcast(([r.id for r in rows], [r.t for r in rows]))

        def search(batches, sent=sent):
            known = _Items(*sent.value)
            for s in kernel.slices((_lowered(b, text) for b in batches), text):
                hashes, begin = _words(s)
                maybe = np.zeros(len(s.start), bool)
                for n in [*known.short, N]:
                    where, _ = known.hits(kernel.chain(hashes, n))
                    maybe[kernel.row_of(s, begin[where])] = True
                lo, hi = kernel.row_bounds(s, begin)
                rows, out = [], []
                for r in np.flatnonzero(maybe).tolist():
                    for m in _matches(known, hashes[lo[r]: hi[r]], threshold):
                        rows.append(r)
                        out.append(m)
                cols = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [s.batch.column(key).take(pa.array(rows, pa.int64())), pa.array([known.ids[i] for i in cols[0]], id_type),
                     pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()),
                     pa.array(cols[4], pa.int32())], schema.names)

        part = notices.select(key, text).mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(notices: DataFrame, items: DataFrame, key: str = KEY, text: str = TEXT, **options) -> DataFrame:
    """Notices that hold no item; those with a NULL key are kept."""
    hit = leaked_items(notices, items, key, text, **options).select(key).distinct()
    return notices.join(hit, key, "left_anti")
