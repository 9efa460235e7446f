"""Repeated passages of notice texts, by anchored strings.

A suffix array of all bytes is never built, and suffixes are not sorted or merged.  Every
``length``-byte string is anchored at the least of its half-length grams, so equal strings
have equal anchors, and the strings of one anchor lie in one *reach* of text.  Reaches that
occur twice, by their 64-bit hash, settle all their strings.  The strings of the others - the
borders of copies - are counted one by one under their gram and a 64-bit hash of their own, in
partial counts, so the borders of a gram that very many texts share are spread like any others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm import kernel
from docketlake.llm.notices import KEY, TEXT
from docketlake.llm.store import saved

LENGTH = 400
PIECE_BYTES = 2 << 20      # a longer text is anchored in pieces that overlap by a string
BATCH_STRINGS = 200_000    # border strings a task sends at once
BROADCAST_ROWS = 1_000_000  # places of border reaches (40 bytes each) that are broadcast
_POSITION_BITS = 23
_ROW = ["row_a", "row_b"]  # identity of a row: 128 bits over key and text, so equal rows are one


def _anchors(s: kernel.Slice, length: int) -> tuple[np.ndarray, ...]:
    """Row, first start, last start, anchor, gram hash and reach hash of every reach of a slice."""
    gram, window = length // 2, length - length // 2 + 1
    n = len(s.buf)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    sums = kernel.prefix_sums(s.buf)
    at = np.arange(n - gram + 1)
    grams = kernel.span_hash(sums, at, at + gram)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    least, span = (grams & ~low) | at.astype(np.uint64), 1
    while 2 * span <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    count = n - length + 1
    least = np.minimum(least[:count], least[window - span: window - span + count])
    start = np.arange(count)
    row = kernel.row_of(s, start)
    start = start[start + length <= s.end[row]]
    if not len(start):
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    row, anchor = row[start], (least[start] & low).view(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    first, last = start[head], start[np.append(head[1:], len(start)) - 1]
    anchor = anchor[head]
    reach = kernel.span_hash(sums, first, last + length) ^ kernel.mix((anchor - first).astype(np.uint64))
    return row[head], first, last, anchor, grams[anchor], reach


def _pieces(batches, text: str, length: int) -> Iterator[tuple[kernel.Slice, int]]:
    """Slices of whole rows; a row over ``PIECE_BYTES`` comes in pieces with their offset."""
    for s in kernel.slices(batches, text, PIECE_BYTES):
        if len(s.buf) <= PIECE_BYTES:
            yield s, 0
            continue
        for at in range(0, len(s.buf) - length + 1, PIECE_BYTES):
            part = s.buf[at: at + PIECE_BYTES + length - 1]
            yield kernel.Slice(s.batch, part, np.array([0]), np.array([len(part)])), at


def identified(notices: DataFrame, key: str = KEY, text: str = TEXT, carry: Sequence[str] = ()) -> DataFrame:
    """Key and text as ``key, text`` with the row's identity and other columns as ``carried``."""
    own = notices.select(F.col(key).alias("key"), F.col(text).alias("text"),
                         F.struct(F.lit(0).alias("_"), *carry).alias("carried"))
    return own.select(F.xxhash64("key", "text").alias("row_a"), F.xxhash64("text", F.lit(1), "key").alias("row_b"),
                      "key", "text", "carried")


def reaches(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every reach of every whole text: identity, ``first, last, anchor, gram, reach`` (byte positions)."""

    def find(batches):
        for s, offset in _pieces(batches, "text", length):
            row, first, last, anchor, gram, reach = _anchors(s, length)
            yield pa.RecordBatch.from_arrays(
                [*(s.batch.column(c).take(pa.array(row)) for c in _ROW), *(pa.array(x - s.start[row] + offset) for x in (first, last, anchor)),
                 pa.array(kernel.signed(gram)), pa.array(kernel.signed(reach))],
                names)

    names = [*_ROW, "first", "last", "anchor", "gram", "reach"]
    schema = T.StructType([T.StructField(name, T.LongType()) for name in names])
    return rows.where(F.octet_length("text") >= length).select(*_ROW, "text").mapInArrow(find, schema)


def _border_strings(rows: DataFrame, borders: DataFrame, length: int) -> DataFrame:
    """Every string of each border reach ``(gram, string, reach, copies, at)``, from the text it was first seen in.

    ``string`` is its hash, ``at`` its start after the first one of the reach.
    """
    places = borders.groupBy(*_ROW).agg(F.collect_list(F.struct("gram", "reach", "copies", "first", "last")).alias("places"))
    if borders.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)

    def flush(held):
        counts = [len(h) for *_, h in held]
        gram, reach, copies = (np.repeat(np.array([h[i] for h in held], np.int64), counts) for i in range(3))
        strings, at = np.concatenate([h[3] for h in held]), np.concatenate([np.arange(n, dtype=np.int32) for n in counts])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, kernel.signed(strings), reach, copies, at)],
                                          ["gram", "string", "reach", "copies", "at"])

    def cut(batches):
        held, size = [], 0
        for batch in batches:
            for text, found in zip(batch.column("text"), batch.column("places"), strict=True):
                raw = np.frombuffer(text.cast(pa.binary()).as_buffer(), np.uint8)
                for p in found.as_py():
                    sums = kernel.prefix_sums(raw[p["first"]: p["last"] + length])
                    start = np.arange(p["last"] - p["first"] + 1)
                    held.append((p["gram"], p["reach"], p["copies"], kernel.span_hash(sums, start, start + length)))
                    size += len(start)
                    if size >= BATCH_STRINGS:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    # Rows that are equal come more than once; all their reaches have copies anyway.
    return rows.select(*_ROW, "text").join(places, _ROW).select("text", "places").mapInArrow(
        cut, "gram long, string long, reach long, copies long, at int")


def _lone_strings(strings: DataFrame) -> DataFrame:
    """Places ``(gram, reach, lone)`` of the strings that occur once, by reach; a reach has at most ``length`` of them.

    A string that is counted once has one owner, whatever maximum is taken, so the owners of
    a string that many texts share are never brought together.
    """
    once = strings.groupBy("gram", "string").agg(
        F.count("*").alias("n"), F.max("reach").alias("reach"), F.max("copies").alias("copies"), F.max("at").alias("at"))
    return once.where("n = 1 AND copies = 1").groupBy("gram", "reach").agg(F.sort_array(F.collect_list("at")).alias("lone"))


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Ranges of starts (identity, ``first, last``) of all strings of ``length`` bytes that also start elsewhere."""
    found = saved(reaches(rows, length), "reaches")
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("reach").alias("r0"), F.max("reach").alias("r1")) \
        .where("n > 1").select("gram", (F.col("r0") == F.col("r1")).alias("alike"))
    shared = saved(found.join(grams, "gram"), "shared")
    several = shared.where("NOT alike").groupBy("gram", "reach").agg(
        F.count("*").alias("copies"), F.min(F.struct(*_ROW, "first", "last", "anchor")).alias("place"))
    several = saved(several.select("gram", "reach", "copies", "place.*"), "variants")
    settled = shared.where("alike").select(*_ROW, "first", "last")
    copied = shared.where("NOT alike").join(several.where("copies > 1").select("gram", "reach"), ["gram", "reach"]) \
        .select(*_ROW, "first", "last")
    lone = _lone_strings(_border_strings(rows, several, length))
    # All other strings of a reach that occurs once start elsewhere too: the ranges between the lone ones.
    single = several.where("copies = 1").join(lone, ["gram", "reach"], "left").select(
        *_ROW, "first", F.expr("concat(array(-1), coalesce(lone, array()), array(cast(last - first + 1 AS int)))").alias("edge"))
    partly = saved(single.select(
        *_ROW, "first", F.explode(F.expr("transform(sequence(1, size(edge) - 1), i -> struct("
                                         "edge[i - 1] + 1 AS low, edge[i] - 1 AS high))")).alias("r"))
        .where("r.low <= r.high")
        .select(*_ROW, (F.col("first") + F.col("r.low")).alias("first"), (F.col("first") + F.col("r.high")).alias("last")), "borders")
    return settled.unionByName(copied).unionByName(partly)


def drop_repeats(notices: DataFrame, key: str = KEY, text: str = TEXT, length: int = LENGTH,
                 carry: list[str] | None = None) -> DataFrame:
    """Cut every byte that lies in a string of ``length`` bytes which also starts elsewhere.

    One row per input row: ``key, n_bytes, spans, kept`` and the columns named in ``carry``.  Strings are compared as UTF-8 bytes, in
    this text or any other, overlapping ones included, never across two texts; they are judged on
    the input, so every copy goes, the first too.  ``spans`` are the maximal removed runs
    (begin, end), ``kept`` the remaining bytes.  NULL and empty texts have no bytes.  Keys may
    be NULL or repeat: every row is a text of its own.  Other columns are ignored.
    """
    carry = list(carry or ())
    own = identified(notices, key, text, carry)
    starts = repeated_spans(own, length).groupBy(*_ROW).agg(
        F.collect_list(F.struct("first", "last")).alias("starts"))  # no more than a text has bytes

    def cut(batches):
        for batch in batches:
            spans, kept, size = [], [], []
            for raw, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("starts").to_pylist(), strict=True):
                raw, runs = raw or b"", []
                for s in sorted(found or (), key=lambda s: s["first"]):
                    end = s["last"] + length
                    if runs and s["first"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([s["first"], end])
                edges = [0, *(x for r in runs for x in r), len(raw)]
                size.append(len(raw))
                spans.append([{"begin": a, "end": b} for a, b in runs])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("carried"), pa.array(size, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                ["key", "carried", "n_bytes", "spans", "kept"])

    schema = T.StructType([own.schema["key"], own.schema["carried"]]).add("n_bytes", "long").add(
        "spans", T.ArrayType(T.StructType().add("begin", "long").add("end", "long"))).add("kept", "binary")
    done = own.join(starts, _ROW, "left").select("key", "carried", "text", "starts").mapInArrow(cut, schema)
    return done.select(F.col("key").alias(key), "n_bytes", "spans", "kept", *[F.col("carried")[c].alias(c) for c in carry])
