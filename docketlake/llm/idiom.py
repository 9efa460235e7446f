"""Language of notice texts by a string kernel over landmarks."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm.notices import KEY, TEXT
from docketlake.llm.store import saved

FIT_ROWS = 500        # notices per language that are learned from, at most
FIT_BYTES = 16 << 10  # longest text that is learned from; longer ones are scored all the same
SPARE = 1.5           # how many more are looked at, since hashes do not fall evenly
LANDMARKS = 32        # landmark windows per language
LANGUAGES = 128       # languages told apart: the most frequent ones of the texts learned from
WINDOW = 2_000        # characters of a window; the windows of a text vote by their length
ALPHABET = 96         # most frequent letters of the landmarks, a symbol each
GRAMS = 32_768        # n-grams of 1 to 3 symbols that kernels count: the most frequent ones of the landmarks
RIDGE = 1e-2          # share of the mean feature square that the regression adds to its diagonal
CELLS = 4 << 20       # entries of the presence matrix built at once
NONE, OTHER = 0, 1    # symbols of everything between letters, and of letters outside the alphabet


class KernelModel(NamedTuple):
    """Landmarks and weights; bounded by the parameters, whatever the input."""

    languages: list[str]
    letters: np.ndarray    # code points of the alphabet, most frequent first
    grams: np.ndarray      # codes of the n-grams that count, sorted
    landmarks: np.ndarray  # presence of the n-grams in the landmarks, landmark by n-gram
    weights: np.ndarray    # landmark kernels to one score per language


# ---- texts as symbols ----------------------------------------------------------------------------------------


def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def symbol_table(letters: np.ndarray) -> np.ndarray:
    """Symbol of every code point below 2^16; the last entry stands for all others."""
    table = np.where(np.append(_letter_table(), True), OTHER, NONE).astype(np.int32)
    for at, letter in enumerate(letters):
        table[letter] = OTHER + 1 + at
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of a lower-cased text, a run of anything but letters as one, with such a one at both ends."""
    found = table[np.minimum(_code_points(text), len(table) - 1)]
    found = np.concatenate(([NONE], found, [NONE]))
    return found[np.append(True, (found[1:] != NONE) | (found[:-1] != NONE))]


def windows(length: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Even parts of at most ``window`` symbols that cover the whole text; neighbours share two."""
    parts = max(1, -(-length // window))
    edges = [length * i // parts for i in range(parts + 1)]
    return [(a, min(length, b + 2)) for a, b in zip(edges, edges[1:])]


def gram_codes(found: np.ndarray) -> list[np.ndarray]:
    """Codes of the 1-, 2- and 3-grams at every place: base ``ALPHABET + 2`` numbers above those of shorter ones."""
    base = ALPHABET + 2
    two = found[:-1] * base + found[1:]
    three = two[:-1] * base + found[2:]
    return [found, two + base, three + base + base * base]


def gram_space() -> int:
    base = ALPHABET + 2
    return base + base ** 2 + base ** 3


def column_table(grams: np.ndarray) -> np.ndarray:
    """Column of every n-gram code; those that do not count share the column after the last."""
    table = np.full(gram_space(), len(grams), dtype=np.int32)
    table[grams] = np.arange(len(grams), dtype=np.int32)
    return table


def presence(parts: list[np.ndarray], columns: np.ndarray, count: int) -> np.ndarray:
    """Presence of the counted n-grams in each part, as a float matrix."""
    seen = np.zeros((len(parts), count + 1), dtype=np.float32)
    for row, part in zip(seen, parts):
        for codes in gram_codes(part):
            row[columns[codes]] = 1
    return seen[:, :count]


def kernel(seen: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Shared n-grams over the geometric mean of both numbers of n-grams; 0 where there are none."""
    own = np.sqrt(np.maximum(seen.sum(axis=1), 1))[:, None]
    theirs = np.sqrt(np.maximum(landmarks.sum(axis=1), 1))[None, :]
    return (seen @ landmarks.T / own / theirs).astype(np.float64)


# ---- fitting -------------------------------------------------------------------------------------------------


def _learned(notices: DataFrame, key: str, text: str, label: str, learn: Column | None, rows: int, longest: int,
             languages: int) -> DataFrame:
    """``_label, _text, _place``: at most ``rows`` distinct texts of each of the most frequent languages, by a hash of key and text."""
    known = notices.where(learn) if learn is not None else notices
    known = known.select(F.col(key).cast("string").alias("_key"), F.col(label).alias("_label"), F.col(text).alias("_text")) \
        .where("_label IS NOT NULL").where(F.octet_length("_text").between(1, longest) & F.col("_text").rlike(r"\p{L}"))
    common = known.groupBy("_label").count().orderBy(F.desc("count"), "_label").limit(languages).collect()
    spark = notices.sparkSession
    # Hashes below a bound hold some SPARE times the texts wanted, so only those are shuffled.
    bounds = spark.createDataFrame(
        [(r["_label"], min((1 << 63) - 1, int((1 << 64) * SPARE * rows / r["count"]) - (1 << 63))) for r in common],
        T.StructType([known.schema["_label"]]).add("_below", "long"))
    order = Window.partitionBy("_label").orderBy("_order")
    few = known.select("_label", "_text", F.xxhash64("_key", "_text").alias("_order")).join(F.broadcast(bounds), "_label") \
        .where("_order <= _below").groupBy("_label", "_order").agg(F.first("_text").alias("_text"))
    return saved(few.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= rows).select("_label", "_text", "_place"), "learned")


def _alphabet(texts: list[str]) -> np.ndarray:
    points, n = np.unique(np.concatenate([_code_points(t) for t in texts]), return_counts=True)
    letter = _letter_table()
    inside = (points < len(letter)) & letter[np.minimum(points, len(letter) - 1)]
    points, n = points[inside], n[inside]
    return points[np.lexsort((points, -n))][:ALPHABET].astype(np.int64)


def _landmarks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(letters, grams, presence)`` of landmark texts, each cut to its first window."""
    letters = _alphabet(texts)
    table = symbol_table(letters)
    parts = [symbols(t, table)[:WINDOW] for t in texts]
    codes, n = np.unique(np.concatenate([np.unique(np.concatenate(gram_codes(p))) for p in parts]), return_counts=True)
    grams = np.sort(codes[np.lexsort((codes, -n))][:GRAMS])
    return letters, grams, presence(parts, column_table(grams), len(grams))


def fit_languages(notices: DataFrame, key: str = KEY, text: str = TEXT, label: str = "lang", learn: Column | None = None,
                  rows: int = FIT_ROWS, landmarks: int = LANDMARKS, languages: int = LANGUAGES) -> KernelModel:
    """Kernel ridge regression of every language against the rest, on Nystroem features of landmarks.

    ``learn`` is a condition on the columns: which rows may be learned from.  At most ``rows``
    texts of each of the ``languages`` most frequent labels are, chosen by a hash of key and text;
    texts without a letter, over ``FIT_BYTES`` bytes or without label are not.  The first
    ``landmarks`` of each language are the landmarks; only those and the sums of the
    features reach the driver.  Without any text to learn from the model knows no language.
    """
    found = _learned(notices, key, text, label, learn, rows, FIT_BYTES, languages)
    first = found.where(F.col("_place") <= landmarks).select("_label", "_text").orderBy("_label", "_place").collect()
    names = sorted({r[0] for r in first})
    if not names:
        return KernelModel([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    letters, grams, marks = _landmarks([r[1] for r in first])
    # Nystroem features: kernels with the landmarks, whitened by the landmarks' own kernel.
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    used = values > 1e-6 * values[-1]
    root = vectors[:, used] / np.sqrt(values[used])
    draft = KernelModel(names, letters, grams, marks, root)
    gram, cross = _normal_equations(found.select("_label", "_text"), draft)
    ridge = RIDGE * np.trace(gram) / len(gram)
    weights = root @ np.linalg.solve(gram + ridge * np.eye(len(gram)), cross)
    return draft._replace(weights=weights)


def _normal_equations(found: DataFrame, draft: KernelModel) -> tuple[np.ndarray, np.ndarray]:
    """Feature products and feature sums per language (target 1, others -1), added up by Spark."""
    sent = found.sparkSession.sparkContext.broadcast(draft)
    k, languages = draft.weights.shape[1], len(draft.languages)

    def partial(batches):
        m = sent.value
        place = {name: i for i, name in enumerate(m.languages)}
        gram, cross = np.zeros((k, k)), np.zeros((k, languages))
        table, columns = symbol_table(m.letters), column_table(m.grams)
        for batch in batches:
            for labels, texts in _slices(batch, ["_label", "_text"], len(m.grams)):
                parts, owner = [], []
                for label, text in zip(labels, texts):
                    whole = symbols(text, table)
                    for a, b in windows(len(whole)):
                        parts.append(whole[a:b])
                        owner.append(place[label])
                features = kernel(presence(parts, columns, len(m.grams)), m.landmarks) @ m.weights
                target = np.full((len(parts), languages), -1.0)
                target[np.arange(len(parts)), owner] = 1.0
                gram += features.T @ features
                cross += features.T @ target
        yield pa.RecordBatch.from_arrays([pa.array([i for i in range(k)], pa.int32()),
                                          pa.array(np.hstack([gram, cross]).tolist(), pa.list_(pa.float64()))], ["line", "sums"])

    def added(key, lines):
        total = np.sum(np.vstack([np.asarray(v.as_py()) for v in lines.column("sums")]), axis=0)
        return pa.table({"line": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tolist()], pa.list_(pa.float64()))})

    schema = "line int, sums array<double>"
    lines = found.mapInArrow(partial, schema).groupBy("line").applyInArrow(added, schema).orderBy("line").collect()
    both = np.array([r.sums for r in lines])
    return both[:, :k], both[:, k:]


# ---- scoring -------------------------------------------------------------------------------------------------


def _slices(batch: pa.RecordBatch, names: list[str], grams: int):
    """Columns of runs of rows whose windows fill a bounded presence matrix; a longer text is a run of its own."""
    most = max(1, CELLS // max(grams, 1))
    sizes = pc.fill_null(pc.utf8_length(batch.column(names[-1])), 0).to_numpy(zero_copy_only=False) // WINDOW + 1
    first, held = 0, 0
    for at, size in enumerate([*sizes.tolist(), most + 1]):
        if at > first and held + size > most:
            yield [batch.column(n).slice(first, at - first).to_pylist() for n in names]
            first, held = at, 0
        held += size


def window_scores(parts: list[np.ndarray], model: KernelModel, columns: np.ndarray) -> np.ndarray:
    """One score per window and language: batched products of presence, landmarks and weights."""
    most, out = max(1, CELLS // max(len(model.grams), 1)), []
    for first in range(0, len(parts), most):
        seen = presence(parts[first: first + most], columns, len(model.grams))
        out.append(kernel(seen, model.landmarks) @ model.weights)
    return np.vstack(out)


def score_languages(notices: DataFrame, model: KernelModel, text: str = TEXT) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1) to every notice.

    The whole text counts: its windows' regression values, weighted by length, are averaged;
    the language with the largest mean wins (ties: the first in order) and the score is
    ``(mean + 1) / 2``, kept within 0 and 1.  NULL texts and texts without a letter are ``und``
    with score 0, and so is every text when the model knows no language.  Columns of those names in
    the input are replaced.  Rows are scored where they lie; nothing is shuffled.
    """
    kept = [f for f in notices.schema.fields if f.name not in ("lang_pred", "score")]
    sent = notices.sparkSession.sparkContext.broadcast(model)
    letters = "_has_letter"
    while letters in notices.columns:
        letters += "_"

    def score(batches):
        m = sent.value
        table, columns = symbol_table(m.letters), column_table(m.grams)
        for batch in batches:
            names, scores = [], []
            for known, texts in _slices(batch, [letters, text], len(m.grams)):
                wholes = [symbols(t, table) if has and m.languages else None for has, t in zip(known, texts)]
                cuts = [windows(len(w)) if w is not None else [] for w in wholes]
                parts = [w[a:b] for w, c in zip(wholes, cuts) for a, b in c]
                values = window_scores(parts, m, columns) if parts else None
                at = 0
                for cut in cuts:
                    if not cut:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    weight = np.array([b - a for a, b in cut], dtype=np.float64)
                    mean = weight @ values[at: at + len(cut)] / weight.sum()
                    at += len(cut)
                    best = int(mean.argmax())
                    names.append(m.languages[best])
                    scores.append(float(np.clip((mean[best] + 1) / 2, 0, 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [f.name for f in kept] + ["lang_pred", "score"])

    schema = T.StructType([*kept]).add("lang_pred", "string").add("score", "double")
    seen = notices.select(*[f.name for f in kept], F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(letters))
    return seen.mapInArrow(score, schema)
