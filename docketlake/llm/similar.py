"""N-gram Jaccard join of notice texts with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm import kernel
from docketlake.llm.components import components
from docketlake.llm.notices import KEY, TEXT
from docketlake.llm.store import saved

SKETCH_BITS = 22      # counters of the document-frequency sketch
SKETCH_PARTS = 16     # pieces in which the sketch is added up
MAX_MATCHES = 3       # longest prefix extension tried
VERIFY_COST = 8.0     # cost of verifying a candidate against reading one posting
KEY_BOUND = 1_000_000  # keys (one number or hash each) that a broadcast may hold
STAR_ROUNDS = 3       # linear rounds (one leader per text) before the pairwise round

_SEED = 0x5851F42D4C957F2D
_DIGEST = ["n_shingles", "set_a", "set_b"]


def _row_shingles(s: kernel.Slice, n: int) -> Iterator[np.ndarray]:
    buf = kernel.fold(s.buf)
    begin, end = kernel.words(s)
    hashes = kernel.ordered_hashes(buf, begin, end)
    for a, b in zip(*kernel.row_bounds(s, begin), strict=True):
        yield kernel.shingles(hashes[a:b], n)


def frequency_sketch(notices: DataFrame, text: str = TEXT, n: int = 3, bits: int = SKETCH_BITS) -> np.ndarray:
    """Document frequency of every shingle of every text, in a table of ``2**bits`` counters.

    Tasks send their counters in pieces, which are added up per piece; only the finished
    table of fixed size reaches the driver.  Counters are reduced to their log2 level
    above the mean load, so the table means the same at every input size.
    """
    size, parts = 1 << bits, SKETCH_PARTS

    def count(batches):
        table, seen = np.zeros(size, np.uint32), False
        for s in kernel.slices(batches, text):
            seen = True
            found = [kernel.mix(x) >> np.uint64(64 - bits) for x in _row_shingles(s, n) if len(x)]
            if found:
                place, often = np.unique(np.concatenate(found).view(np.int64), return_counts=True)
                table[place] += often.astype(np.uint32)
        if seen:
            pack = zstandard.ZstdCompressor(level=1)
            yield pa.record_batch([pa.array(range(parts), pa.int32()),
                                   pa.array([pack.compress(x.tobytes()) for x in np.split(table, parts)], pa.binary())],
                                  ["part", "counts"])

    def add(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        total = np.zeros(size // parts, np.uint64)
        number = None
        for batch in part:
            for k, x in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                number, total = k, total + np.frombuffer(unpack.decompress(x), np.uint32)
        yield pa.record_batch([pa.array([number], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                              ["part", "counts"])

    pieces = (notices.select(text).mapInArrow(count, "part int, counts binary")
              .groupBy("part").applyInArrow(add, "part int, counts binary"))
    table = np.zeros((parts, size // parts), np.uint64)
    for row in pieces.collect():
        table[row.part] = np.frombuffer(row.counts, np.uint64)
    load = max(1.0, float(table.mean()))
    return np.floor(np.log2(np.maximum(table.ravel() / load, 1.0))).astype(np.uint8)


def prefix_length(size: int, threshold: int) -> int:
    """Tokens of the shortest prefix in which partners must share one token.

    A partner at ``threshold`` percent shares at least ``ceil(threshold * size / 100)`` tokens.
    """
    return size - (threshold * size + 99) // 100 + 1


def adaptive_prefix(tokens: np.ndarray, levels: np.ndarray, threshold: int,
                    max_matches: int = MAX_MATCHES) -> tuple[np.ndarray, int]:
    """Prefix of a text's tokens, rarest first, and how many of them a partner must share.

    The prefix that is ``k - 1`` tokens longer than the shortest must share ``k`` tokens.
    Longer prefixes read more postings but leave fewer candidates (at most postings
    over ``k``); ``k`` is chosen by the cheaper sum of both.
    """
    level = levels[(kernel.mix(tokens) >> np.uint64(64 - int(len(levels)).bit_length() + 1)).view(np.int64)]
    order = np.sort((level.astype(np.uint64) << np.uint64(58)) | (tokens >> np.uint64(6)))
    shortest = prefix_length(len(order), threshold)
    longest = min(len(order), shortest + max_matches - 1)
    postings = np.cumsum(np.exp2((order[:longest] >> np.uint64(58)).astype(float)))[shortest - 1:]
    matches = np.arange(1, len(postings) + 1)
    best = int(np.argmin(postings + VERIFY_COST * postings / matches))
    return order[: shortest + best], best + 1


def shingle_profiles(notices: DataFrame, levels: np.ndarray, key: str = KEY, text: str = TEXT, n: int = 3,
                     threshold: int = 90, max_matches: int = MAX_MATCHES) -> DataFrame:
    """Set size, 128-bit set digest, prefix and required matches of every text."""
    sent = notices.sparkSession.sparkContext.broadcast(levels)  # 2**SKETCH_BITS bytes, whatever the input
    kind = notices.schema[key].dataType

    def profile(batches):
        for s in kernel.slices(batches, text):
            rows = list(_row_shingles(s, n))
            seed = np.uint64(_SEED)
            made = [adaptive_prefix(x, sent.value, threshold, max_matches) if len(x) else (x, 0) for x in rows]
            yield pa.record_batch([
                s.batch.column(key),
                pa.array([len(x) for x in rows], pa.int64()),
                pa.array(np.array([x.sum(dtype=np.uint64) for x in rows], np.uint64).view(np.int64)),
                pa.array(np.array([kernel.mix(x ^ seed).sum(dtype=np.uint64) for x in rows], np.uint64).view(np.int64)),
                pa.array([m for _, m in made], pa.int32()),
                pa.array([kernel.signed(p) for p, _ in made], pa.list_(pa.int64())),
            ], ["key", "n_shingles", "set_a", "set_b", "matches", "prefix"])

    schema = T.StructType([T.StructField("key", kind)]) .add("n_shingles", "long").add("set_a", "long") \
        .add("set_b", "long").add("matches", "integer").add("prefix", T.ArrayType(T.LongType()))
    return notices.select(key, text).mapInArrow(profile, schema)


def packed_texts(notices: DataFrame, wanted: DataFrame, key: str = KEY, text: str = TEXT, n: int = 3) -> DataFrame:
    """Compressed whole texts ``(key, packed)`` of the wanted notices.

    ``wanted`` holds ``key`` and the set digest; of rows that repeat a key, those with another
    set are left out.
    """
    kind = notices.schema[key].dataType
    seed = np.uint64(_SEED)

    def pack(batches):
        coder = zstandard.ZstdCompressor(level=3)
        for s in kernel.slices(batches, text):
            rows = list(_row_shingles(s, n))
            same = [len(x) == size and x.sum(dtype=np.uint64).view(np.int64) == a
                    and kernel.mix(x ^ seed).sum(dtype=np.uint64).view(np.int64) == b
                    for x, size, a, b in zip(rows, *(s.batch.column(c).to_pylist() for c in _DIGEST), strict=True)]
            raw = s.buf.tobytes()
            yield pa.record_batch([s.batch.column("key"),
                                   pa.array([coder.compress(raw[i:j]) for i, j in zip(s.start, s.end, strict=True)], pa.binary())],
                                  ["key", "packed"]).filter(pa.array(same, pa.bool_()))

    found = notices.select(F.col(key).alias("key"), F.col(text).alias(text)).join(_small(wanted, KEY_BOUND), "key")
    return found.mapInArrow(pack, T.StructType([T.StructField("key", kind), T.StructField("packed", T.BinaryType())]))


def _small(keys: DataFrame, bound: int) -> DataFrame:
    """The keys with a broadcast hint if there are at most ``bound``; Spark shuffles them otherwise."""
    return F.broadcast(keys) if keys.count() <= bound else keys


def verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: int) -> DataFrame:
    """Pairs ``(a, b)`` whose shingle sets reach the similarity, by comparing the whole sets."""
    kind = pairs.schema["a"].dataType

    def compare(batches):
        coder = zstandard.ZstdDecompressor()

        def tokens(packed: bytes) -> np.ndarray:
            raw = np.frombuffer(coder.decompress(packed), np.uint8)
            bounds = np.array([0]), np.array([len(raw)])
            return next(_row_shingles(kernel.Slice(None, raw, *bounds), n))

        last, x = None, None
        for batch in batches:
            keep = []
            for first, second in zip(batch.column("packed_a").to_pylist(), batch.column("packed_b").to_pylist(), strict=True):
                if first != last:
                    last, x = first, tokens(first)
                y = tokens(second)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    needed = texts.join(_small(keys, KEY_BOUND), "key", "left_semi")
    a = needed.select(F.col("key").alias("a"), F.col("packed").alias("packed_a"))
    b = needed.select(F.col("key").alias("b"), F.col("packed").alias("packed_b"))
    # Joined on ``a`` last, so that a leader's pairs follow each other.
    return pairs.select("a", "b").join(b, "b").join(a, "a").mapInArrow(
        compare, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _may_reach(threshold: int, ahead: Column | None = None) -> Column:
    """Can two texts that share this token reach the similarity, given their sizes and lone tokens?

    ``ahead`` is a further bound of what they can share, from the token's places.
    """
    most = F.least(F.col("size_a") - F.col("alone_a"), F.col("size_b") - F.col("alone_b"), *([] if ahead is None else [ahead]))
    return 100 * most >= threshold * (F.col("size_a") + F.col("size_b") - most)


def similar_notices(notices: DataFrame, key: str = KEY, text: str = TEXT, n: int = 3,
                    threshold: int = 90, max_matches: int = MAX_MATCHES) -> DataFrame:
    """Group notices whose texts are alike: one row ``key, n_shingles, component_id`` per input row.

    Words are folded (A-Z) and split on ASCII white space.  A text's set is its distinct
    ``n``-word shingles; a text of fewer words is one shingle.  Two notices link when
    ``100 * intersection >= threshold * union``; ``component_id`` is the smallest key
    reachable by links.  NULL, empty and blank texts have no shingle and link with
    nothing.  Rows that repeat a key share one component, found by the largest of their
    sets.  A NULL key is kept as a row of its own with a NULL component.  Other columns
    are ignored.

    Method: equal sets become one class.  Each class gets a prefix of its rarest tokens
    (document-frequency sketch over all texts), lengthened where that is cheaper, with as
    many more tokens to share.  Three linear rounds compare every class with one leader of
    its tokens; after that only tokens that still join different components give pairs,
    which must be able to reach the threshold by their sizes and lone tokens, and share ``min`` of the two required numbers of tokens.  Every pair is
    verified on its whole sets.  Pairs inside a component are not needed and not made,
    so a group of thousands of copies costs its size, not its square.
    """
    levels = frequency_sketch(notices, text, n)
    profiles = saved(shingle_profiles(notices, levels, key, text, n, threshold, max_matches), "profiles")
    filled = profiles.where("n_shingles > 0 AND key IS NOT NULL")
    # A key stands for one set: of rows that repeat it, the largest.
    chosen = filled.groupBy("key").agg(F.max(F.struct(*_DIGEST)).alias("set")).select("key", "set.*")
    classes = saved(chosen.groupBy(*_DIGEST).agg(F.min("key").alias("rep")), "classes")
    member = chosen.join(classes, _DIGEST).select("key", "rep")
    postings = (filled.withColumnRenamed("key", "rep").join(classes, ["rep", *_DIGEST], "left_semi")
                .dropDuplicates(["rep"])
                .select("rep", F.col("n_shingles").alias("size"), "matches", F.size("prefix").alias("width"),
                        F.posexplode("prefix").alias("pos", "token")))
    shared = postings.groupBy("token").agg(F.count("*").alias("texts")).where("texts > 1").select("token")
    of_text = Window.partitionBy("rep")
    # A rarer prefix token that no other prefix has is in no partner: ``alone`` counts those before a
    # posting, ``lonely`` all of a text.
    postings = saved(postings.join(shared, "token").select(
        "rep", "size", "matches", "token", "pos", (F.col("pos") - F.row_number().over(of_text.orderBy("pos")) + 1).alias("alone"),
        (F.col("width") - F.count("*").over(of_text)).alias("lonely")), "postings")
    wanted = classes.withColumnRenamed("rep", "key").join(
        postings.select(F.col("rep").alias("key")).distinct(), "key", "left_semi")
    texts = saved(packed_texts(notices, wanted, key, text, n), "texts")

    links = tried = label = None
    for turn in range(STAR_ROUNDS):
        pairs = _leader_pairs(_open_postings(postings, label), threshold, turn)
        if tried is not None:
            pairs = _untried(pairs, tried)
        pairs = saved(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        near = verified(pairs, texts, n, threshold)
        links = saved(near if links is None else links.unionByName(near), "links")
        label = components(links)

    rest = _open_postings(postings, label)
    one = rest.select("token", F.col("rep").alias("a"), F.col("size").alias("size_a"),
                      F.col("matches").alias("need_a"), F.col("component").alias("in_a"), F.col("alone").alias("alone_a"), F.col("pos").alias("pos_a"))
    two = rest.select("token", F.col("rep").alias("b"), F.col("size").alias("size_b"),
                      F.col("matches").alias("need_b"), F.col("component").alias("in_b"), F.col("alone").alias("alone_b"), F.col("pos").alias("pos_b"))
    # Only the first ``need`` shared tokens have to meet: before them lie fewer than ``need`` others.
    ahead = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) + F.least("need_a", "need_b") - 1
    pairs = (one.join(two, "token")
             .where((F.col("a") < F.col("b")) & (F.col("in_a") != F.col("in_b")) & _may_reach(threshold, ahead))
             .groupBy("a", "b").agg(F.count("*").alias("shares"), F.first(F.least("need_a", "need_b")).alias("need"))
             .where("shares >= need").select("a", "b"))
    pairs = saved(_untried(pairs, tried), "pairs")
    label = components(saved(links.unionByName(verified(pairs, texts, n, threshold)), "links"))
    grouped = member.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", F.coalesce("component", "rep").alias("component_id"))
    return (profiles.select("key", "n_shingles").join(grouped, "key", "left")
            .select(F.col("key").alias(key), "n_shingles", F.coalesce("component_id", "key").alias("component_id")))


def _leader_pairs(open_posts: DataFrame, threshold: int, turn: int) -> DataFrame:
    """For every text the leader that most of its tokens name.

    A token's leader is the text with the fewest lone tokens, which is the likeliest to have
    links; equal ones are told apart by a hash that differs from turn to turn.
    """
    leaders = open_posts.groupBy("token").agg(
        F.min_by(F.struct("rep", "size", "component", "alone"), F.struct("lonely", F.xxhash64("rep", F.lit(turn)), "rep")).alias("leader"))
    met = (open_posts.join(leaders, "token")
           .where("rep != leader.rep AND component != leader.component")
           .select(F.col("rep").alias("b"), F.col("size").alias("size_b"), F.col("alone").alias("alone_b"),
                   F.col("leader.rep").alias("a"), F.col("leader.size").alias("size_a"), F.col("leader.alone").alias("alone_a"))
           .where(_may_reach(threshold))
           .groupBy("a", "b").agg(F.count("*").alias("votes")))
    return met.groupBy("b").agg(F.max_by("a", F.struct("votes", "a")).alias("a")).select("a", "b")


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    return pairs.select("a", "b", low, high).join(tried.select(low, high), ["low", "high"], "left_anti").select("a", "b")


def _open_postings(postings: DataFrame, label: DataFrame | None) -> DataFrame:
    """Postings of tokens whose texts lie in more than one component."""
    if label is None:
        return postings.withColumn("component", F.col("rep"))
    labelled = postings.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    mixed = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")) \
        .where("low != high").select("token")
    return labelled.join(mixed, "token")
