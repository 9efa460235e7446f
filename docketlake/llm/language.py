"""Language-model scores of notice texts by deleted interpolation.

A word's probability mixes three estimates: how often it follows its context, how often it
occurs, and one over the vocabulary.  The mixture depends on how frequent the context is and is
learned by expectation-maximisation on deleted counts: every training word is predicted from the
counts without its own occurrence.

Counts are exact and cover all training texts.  They grow with the corpus, so they are never in
one place: texts are packed in chunks; a chunk asks each bucket of the key space once for each of
its distinct words and word pairs (its own counts in the same message), the bucket adds up and
answers.  A pair that occurs in a third of all texts is one key per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm import kernel
from docketlake.llm.notices import KEY, TEXT
from docketlake.llm.store import saved

CHUNK_BYTES = 4 << 20     # text of a chunk, at most (or one longer text)
BUCKET_BYTES = 12 << 20   # text per bucket of the key space: some 1.5 million distinct pairs
GRID = 4                  # steps per octave in which estimates are tabulated for learning the mixture
LEVELS = 40               # context-frequency buckets: none, 1, 2-3, 4-7, ...
EM_STEPS = 60
_EDGE = np.uint64(0x2545F4914F6CDD1D)  # the end token; as context, the start of a text
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def chunks(notices: DataFrame, learn: Column, key: str = KEY, text: str = TEXT) -> DataFrame:
    """Texts packed into rows of a few MB: keys, learn flags, sizes and the folded bytes."""
    kind = notices.schema[key].dataType
    own = notices.select(F.col(key).alias("key"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text).alias("text"))

    def pack(batches):
        for s in kernel.slices(batches, "text", CHUNK_BYTES):
            row = [pa.array([s.batch.column(c).to_pylist()], t) for c, t in (("key", pa.list_(s.batch.schema.field("key").type)),
                                                                             ("learn", pa.list_(pa.bool_())))]
            size = s.end - s.start
            yield pa.RecordBatch.from_arrays([*row, pa.array([size.tolist()], pa.list_(pa.int64())), pa.array([len(s.buf)], pa.int64()),
                                              pa.array([zstandard.compress(kernel.fold(s.buf).tobytes(), 3)], pa.binary())],
                                             ["keys", "learn", "sizes", "n_bytes", "body"])

    schema = T.StructType([T.StructField("keys", T.ArrayType(kind))]).add("learn", T.ArrayType(T.BooleanType())) \
        .add("sizes", T.ArrayType(T.LongType())).add("n_bytes", "long").add("body", "binary")
    packed = own.mapInArrow(pack, schema)
    # Written before use, so the number stays with its chunk.
    return saved(packed.withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def _tokens(learn: list[bool], sizes: list[int], body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word and pair hashes of all tokens of a chunk, row bounds in tokens, and which tokens are learned from."""
    raw = np.frombuffer(zstandard.decompress(body), np.uint8) if sum(sizes) else np.zeros(0, np.uint8)
    end = np.cumsum(np.array(sizes, np.int64))
    s = kernel.Slice(None, raw, end - np.array(sizes, np.int64), end)
    begin, stop = kernel.words(s)
    low, high = kernel.row_bounds(s, begin)
    # Each row's words are followed by the end token.
    count = high - low + 1
    bounds = np.concatenate([[0], np.cumsum(count)])
    word = np.full(bounds[-1], _EDGE, np.uint64)
    inner = np.ones(len(word), bool)
    inner[bounds[1:] - 1] = False
    word[inner] = kernel.ordered_hashes(raw, begin, stop)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[bounds[:-1]] = _EDGE
    pair = kernel.mix(before * _PAIR + kernel.mix(word))
    return word, pair, bounds, np.repeat(np.array(learn, bool), count)


def _keys(tokens: np.ndarray, learned: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in (bucket, key) order, their learned counts, where each token's key is, bucket bounds."""
    key, which = np.unique(tokens, return_inverse=True)
    count = np.bincount(which, learned, minlength=len(key)).astype(np.uint32)
    bucket = (kernel.mix(key) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(key), np.int64)
    place[order] = np.arange(len(key))
    return key[order], count[order], place[which], np.searchsorted(bucket[order], np.arange(buckets + 1))


def _ask(packed: DataFrame, buckets: int) -> DataFrame:
    def ask(batches):
        for batch in batches:
            for learn, sizes, body, chunk in zip(*(batch.column(c).to_pylist() for c in ("learn", "sizes", "body", "chunk")), strict=True):
                word, pair, _, learned = _tokens(learn, sizes, body)
                sides = [_keys(t, learned, buckets) for t in (word, pair)]
                for first in range(0, buckets, 256):
                    numbers = range(first, min(first + 256, buckets))
                    cols = [[] for _ in range(4)]
                    for b in numbers:
                        for i, (key, count, _, bound) in enumerate(sides):
                            part = slice(bound[b], bound[b + 1])
                            cols[2 * i].append(key[part].tobytes())
                            cols[2 * i + 1].append(_pack(count[part]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk] * len(numbers), pa.int64()), pa.array(list(numbers), pa.int32()),
                         *(pa.array(c, pa.binary()) for c in cols)],
                        ["chunk", "bucket", "words", "word_counts", "pairs", "pair_counts"])

    return packed.select("learn", "sizes", "body", "chunk").mapInArrow(
        ask, "chunk long, bucket int, words binary, word_counts binary, pairs binary, pair_counts binary")


def _totals(keys: list[bytes], counts: list[bytes]) -> tuple[list[bytes], int, int]:
    """Answers in the order of the questions, the sum of all counts and the number of keys with one."""
    parts = [np.frombuffer(k, np.uint64) for k in keys]
    _, which = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(which, np.concatenate([_unpack(c, np.uint32) for c in counts])) if len(which) else np.zeros(0)
    told = total[which].astype(np.uint32)
    ends = np.cumsum([len(p) for p in parts])
    return [_pack(x) for x in np.split(told, ends[:-1])], int(total.sum()), int((total > 0).sum())


def _answers(asked: DataFrame) -> DataFrame:
    def answer(group: pa.Table) -> pa.Table:
        words, n, v = _totals(group.column("words").to_pylist(), group.column("word_counts").to_pylist())
        pairs, _, _ = _totals(group.column("pairs").to_pylist(), group.column("pair_counts").to_pylist())
        rows = group.num_rows
        return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "words": pa.array(words, pa.binary()),
                         "pairs": pa.array(pairs, pa.binary()), "n": pa.array([n] + [0] * (rows - 1), pa.int64()),
                         "v": pa.array([v] + [0] * (rows - 1), pa.int64())})

    return asked.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, words binary, pairs binary, n long, v long")


def counted_tokens(packed: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """Per chunk the corpus counts of every token and its pair, with the rows' keys and bounds."""

    def code(batches):
        for batch in batches:
            names = ("keys", "learn", "sizes", "body", "told")
            out = [[] for _ in range(4)]
            for learn, sizes, body, told in zip(*(batch.column(c).to_pylist() for c in names[1:]), strict=True):
                word, pair, bounds, learned = _tokens(learn, sizes, body)
                told = sorted(told, key=lambda r: r["bucket"])
                for i, (tokens, column) in enumerate(((word, "words"), (pair, "pairs"))):
                    place = _keys(tokens, learned, buckets)[2]
                    out[i].append(_pack(np.concatenate([_unpack(r[column], np.uint32) for r in told])[place]))
                out[2].append(np.diff(bounds).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("keys"), batch.column("learn"), pa.array(out[2], pa.list_(pa.int64())),
                 pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["keys", "learn", "n_tokens", "words", "pairs"])

    told = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "words", "pairs")).alias("told"))
    kind = packed.schema["keys"]
    schema = T.StructType([kind]).add("learn", T.ArrayType(T.BooleanType())).add("n_tokens", T.ArrayType(T.LongType())) \
        .add("words", "binary").add("pairs", "binary")
    return packed.join(told, "chunk").select("keys", "learn", "sizes", "body", "told").mapInArrow(code, schema)


def _token_counts(learn, n_tokens, words, pairs, starts: int) -> tuple[np.ndarray, ...]:
    """Of every token: its count, its pair's count, its context's count; and the row bounds and learn flags."""
    bounds = np.concatenate([[0], np.cumsum(n_tokens)]).astype(np.int64)
    word, pair = _unpack(words, np.uint32).astype(np.int64), _unpack(pairs, np.uint32).astype(np.int64)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[bounds[:-1]] = starts
    return word, pair, context, bounds, np.repeat(np.array(learn, bool), n_tokens)


def _level(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def deleted_table(coded: DataFrame, n: int, starts: int) -> DataFrame:
    """How often training tokens have which deleted estimates: ``level, pair_step, word_step, times``.

    Estimates are tabulated on a logarithmic grid, so the table has a bounded number of rows;
    step -1 stands for an estimate of nothing.
    """

    def tabulate(batches):
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("learn", "n_tokens", "words", "pairs")), strict=True):
                word, pair, context, _, learned = _token_counts(*row, starts)
                word, pair, context = word[learned] - 1, pair[learned] - 1, context[learned] - 1
                steps = [np.where(x > 0, np.round(-GRID * np.log2(np.maximum(x, 1) / np.maximum(of, 1))), -1).astype(np.int64)
                         for x, of in ((pair, context), (word, np.int64(n - 1)))]
                cell, times = np.unique((_level(context) << 40) | ((steps[0] + 1) << 20) | (steps[1] + 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell >> 40), pa.array((cell >> 20 & 0xFFFFF) - 1),
                                                  pa.array((cell & 0xFFFFF) - 1), pa.array(times)],
                                                 ["level", "pair_step", "word_step", "times"])

    names = "level long, pair_step long, word_step long, times long"
    return coded.select("learn", "n_tokens", "words", "pairs").mapInArrow(tabulate, names) \
        .groupBy("level", "pair_step", "word_step").agg(F.sum("times").alias("times"))


def learn_mixture(cells: Iterator, v: int, steps: int = EM_STEPS) -> np.ndarray:
    """Weights (pair, word, uniform) of every context level, by expectation-maximisation."""
    weights = np.full((LEVELS, 3), 1 / 3)
    weights[0] = 0.0, 0.5, 0.5
    data = np.array([(r["level"], r["pair_step"], r["word_step"], r["times"]) for r in cells], float).reshape(-1, 4)
    level = data[:, 0].astype(np.int64)
    estimates = np.stack([np.where(data[:, i] >= 0, 2.0 ** (-data[:, i] / GRID), 0.0) for i in (1, 2)]
                         + [np.full(len(data), 1 / (v + 1))], axis=1)
    for _ in range(steps):
        share = weights[level] * estimates
        share *= (data[:, 3] / share.sum(axis=1))[:, None]
        total = np.stack([np.bincount(level, share[:, i], minlength=LEVELS) for i in range(3)], axis=1)
        seen = total.sum(axis=1) > 0
        weights[seen] = total[seen] / total[seen].sum(axis=1, keepdims=True)
    # A level without training tokens takes the weights of the next lower one.
    for k in range(2, LEVELS):
        if not (level == k).any():
            weights[k] = weights[k - 1]
    # No level may rule an unseen word out.
    weights = np.maximum(weights, 1e-6)
    weights[0, 0] = 0.0
    return weights / weights.sum(axis=1, keepdims=True)


def score_language(notices: DataFrame, learn: Column, key: str = KEY, text: str = TEXT) -> DataFrame:
    """Score all notices with a model of those for which ``learn`` holds (NULL: not).

    One row per input row: ``key, held_out, n_tokens, n_known, train_tokens, base_score, score``.
    Words are folded (A-Z) and split on ASCII white space; a text's words are followed by one end
    token.  ``n_known`` counts tokens that occur in training, ``train_tokens`` is their number N.
    ``base_score`` sums log10((c + 1) / (N + V + 1)), ``score`` is the model's log10 probability.
    NULL and empty texts are their end token.  Keys may be NULL or repeat.  Without any training
    text every word is equally likely under both.
    """
    packed = chunks(notices, learn, key, text)
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    answers = saved(_answers(_ask(packed, buckets)), "answers")
    sums = answers.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = sums.n or 0, sums.v or 0
    coded = saved(counted_tokens(packed, answers, buckets), "coded")
    starts = packed.select(F.explode("learn").alias("l")).where("l").count()
    weights = learn_mixture((r.asDict() for r in deleted_table(coded, n, starts).toLocalIterator()), v)
    sent = notices.sparkSession.sparkContext.broadcast(weights)

    def score(batches):
        mix = sent.value
        for batch in batches:
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("learn", "n_tokens", "words", "pairs")), strict=True)):
                word, pair, context, bounds, _ = _token_counts(*row, starts)
                w = mix[_level(context)]
                p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 2] / (v + 1)
                base = np.log10((word + 1) / (n + v + 1))
                at = bounds[:-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("keys").slice(i, 1).flatten(), pa.array([not x for x in row[0]], pa.bool_()), pa.array(np.diff(bounds)),
                     pa.array(np.add.reduceat((word > 0).astype(np.int64), at)), pa.array(np.full(len(at), n, np.int64)),
                     pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at))], schema.names)

    schema = T.StructType([T.StructField(key, notices.schema[key].dataType)]).add("held_out", "boolean").add("n_tokens", "long") \
        .add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    return coded.mapInArrow(score, schema)
