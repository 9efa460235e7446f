"""Quality score of notice texts by compression with dictionaries of good and bad text."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm import kernel
from docketlake.llm.notices import KEY, TEXT, labelled_sample

FIT_ROWS = 3_000        # labelled notices per label that the model is fitted on, at most
FIT_BYTES = 24 << 20    # text of those notices, at most
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 2 << 10   # texts are compressed in blocks, so that length does not drown the dictionary


class QualityModel(NamedTuple):
    """Two dictionaries and a logistic curve; bounded by ``DICTIONARY_BYTES`` whatever the input."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def _coders(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    flags = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    made = []
    for data in (good, bad):
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=3)
        made.append(zstandard.ZstdCompressor(dict_data=d, **flags))
    return made


def compressed_sizes(text: bytes, coders: list[zstandard.ZstdCompressor]) -> tuple[float, float, float]:
    """Normalised compressed-size difference, log of the compressed share, and 1.

    The difference is the size under the bad dictionary less that under the good one, over
    the sum of both; the share is that sum over twice the length, so that text which
    compresses by itself (repeats) is told from text that merely fits both dictionaries.
    The whole text counts, block by block; an empty text gives no difference and share 1.
    """
    good = bad = 0
    for at in range(0, len(text), BLOCK_BYTES):
        block = text[at: at + BLOCK_BYTES]
        good += len(coders[0].compress(block))
        bad += len(coders[1].compress(block))
    return ((bad - good) / (bad + good), math.log((bad + good) / (2 * len(text))), 1.0) if good else (0.0, 0.0, 1.0)


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or plain text as dictionary when there is too little to train on."""
    blocks = [t[a: a + BLOCK_BYTES] for t in texts for a in range(0, len(t), BLOCK_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(blocks)[:DICTIONARY_BYTES]


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, ...]:
    """Weights of the logistic curve through labelled sizes (Newton steps, small ridge)."""
    scale = x.std(axis=0)
    scale[scale == 0] = 1.0
    design, beta = x / scale, np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(len(beta))
        step = np.linalg.solve(hess, design.T @ (y - p) - 1e-2 * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple((beta / scale).tolist())


def fit_quality(notices: DataFrame, labels: DataFrame, key: str = KEY, text: str = TEXT, label: str = "quality",
                learn: Column | None = None, rows: int = FIT_ROWS, max_bytes: int = FIT_BYTES) -> QualityModel:
    """Fit on at most ``rows`` labelled notices of each label and ``max_bytes`` of text, chosen by a hash of the key.

    ``learn`` is a condition on the key: which labels may be learned from.  Two thirds build the dictionaries, the rest
    calibrates the score.  Texts of over ``8 * max_bytes / rows`` bytes are scored but not
    learned from.  With one label missing, the model is constant at the label there is
    (0.5 without any label).  Notices without label, key or text are not learned from.
    """
    found = labelled_sample(notices, labels, key, label, rows, learn, 8 * max_bytes // max(rows, 1), text) \
        .orderBy(F.xxhash64(F.col("_key").cast("string")), "_key").select("_label", text).collect()
    bad, good = (_within([r[1].encode() for r in found if r[0] == value], max_bytes // 2) for value in (0, 1))
    if not good or not bad:
        return QualityModel(b"", b"", (0.0, 0.0, 0.0 if not good and not bad else 8.0 if good else -8.0))
    if min(len(good), len(bad)) < 3:
        fit = held = (good, bad)
    else:
        fit, held = ([[t for i, t in enumerate(part) if (i % 3 == 2) == kept] for part in (good, bad)] for kept in (False, True))
    data = [_dictionary(part) for part in fit]
    coders = _coders(*data)
    x = np.array([compressed_sizes(t, coders) for part in held for t in part])
    y = np.repeat([1.0, 0.0], [len(part) for part in held])
    del found, good, bad, fit, held, coders
    kernel.release()
    return QualityModel(*data, _logistic(x, y))


def _within(texts: list[bytes], limit: int) -> list[bytes]:
    ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0)
    return texts[: max(1, int(np.searchsorted(ends, limit, side="right")))]


def score_quality(notices: DataFrame, model: QualityModel, text: str = TEXT, threshold: float = 0.3) -> DataFrame:
    """Adds ``score`` (0 to 1, higher is likelier good) and ``predicted`` to every notice.

    The score is the calibrated size difference of the whole text; NULL and empty texts
    score as no difference.  Columns of those names in the input are replaced.  Rows are
    scored where they lie; nothing is shuffled.
    """
    kept = [f for f in notices.schema.fields if f.name not in ("score", "predicted")]
    sent = notices.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = sent.value
        coders = _coders(m.good, m.bad) if m.good else None
        for batch in batches:
            column = pc.fill_null(batch.column(text), "").cast(pa.large_binary())
            sizes = [compressed_sizes(t.as_py(), coders) if coders else (0.0, 0.0, 1.0) for t in column]
            p = 1 / (1 + np.exp(-np.clip(np.array(sizes) @ np.array(m.weights), -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                [f.name for f in kept] + ["score", "predicted"])
        kernel.release()

    schema = T.StructType([*kept]).add("score", "double").add("predicted", "integer")
    return notices.select(*[f.name for f in kept]).mapInArrow(score, schema)
