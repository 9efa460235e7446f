"""Token counts of notice texts from counts of their distinct pre-tokens."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm import kernel
from docketlake.llm.notices import KEY, TEXT
from docketlake.llm.store import saved

FREQUENT = 1 << 18        # pre-tokens whose counts are broadcast, at most (some 4 MB, 35 MB as a table in a task)
FLUSH_WORDS = 100_000     # distinct pre-tokens a task holds before it hands them on
BATCH_ROWS = 250          # texts cut at once


def load_rules(path: str) -> tuple[str, list[str], bool]:
    """Text of a byte-level ``tokenizer.json``, its special strings, and whether a space is put first.

    Other kinds are refused, since their pre-tokens are not independent.
    """
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    rules = json.loads(text)
    cut = rules.get("pre_tokenizer") or {}
    if rules["model"]["type"] != "BPE" or cut.get("type") != "ByteLevel" or rules.get("normalizer"):
        raise ValueError("only byte-level BPE files without normalizer are supported")
    special = sorted((t["content"] for t in rules["added_tokens"]), key=len, reverse=True)
    return text, special, bool(cut.get("add_prefix_space"))


class PreTokenizer:
    """Cuts a text as the library does: special strings first, then words, numbers, marks and spaces."""

    # Fixed value: the word pattern of byte-level vocabularies.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, special: list[str], space_first: bool):
        import regex

        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.word = regex.compile(self.PATTERN)
        self.space_first = space_first

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens of a text with their numbers, and the number of special strings in it (a token each)."""
        if self.special is None or not self.special.search(text):
            return Counter(self.word.findall(self._led(text))), 0
        parts = self.special.split(text)
        found: Counter = Counter()
        for part in parts:
            if part:
                found.update(self.word.findall(self._led(part)))
        return found, len(parts) - 1

    def _led(self, text: str) -> str:
        return " " + text if self.space_first and text and not text[0].isspace() else text


def _texts(batches, text: str):
    """Texts of batches, a few hundred at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(first, BATCH_ROWS)
            yield part, part.column(text).to_pylist()


def pretoken_table(notices: DataFrame, rules: tuple[str, list[str], bool], text: str = TEXT) -> DataFrame:
    """``word, times, n``: every distinct pre-token of all texts, how often it occurs, its pieces.

    Tasks hand on their own totals; each distinct pre-token is then counted once.
    """
    model, *cutting = rules
    sent = notices.sparkSession.sparkContext.broadcast(model)

    def tally(batches):
        cut, held = PreTokenizer(*cutting), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                              ["word", "times"])

        for _, values in _texts(batches, text):
            for value in values:
                held.update(cut.frequencies(value or "")[0])
            if len(held) > FLUSH_WORDS:
                yield out()
                held.clear()
        yield out()
        held.clear()
        kernel.release()

    def pieces(batches):
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(sent.value)
        library.encode_special_tokens = True
        for batch in batches:
            for part, words in _texts([batch], "word"):
                n = [len(e.ids) for e in library.encode_batch_fast(words, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("times"), pa.array(n, pa.int32())],
                                                 ["word", "times", "n"])
        del library
        kernel.release()

    totals = notices.select(text).mapInArrow(tally, "word string, times long").groupBy("word").agg(F.sum("times").alias("times"))
    return totals.mapInArrow(pieces, "word string, times long, n int")


def frequent_words(table: DataFrame, most: int = FREQUENT) -> pa.Table:
    """Piece counts of the most frequent pre-tokens (``word, n``), ``most`` or fewer.

    A histogram over the powers of two of the frequency gives the threshold, so only the chosen
    words reach the driver.
    """
    level = F.floor(F.log2("times")).cast("int")
    steps = {r.level: r.words for r in table.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()}
    total, cut = 0, 64
    for k in sorted(steps, reverse=True):
        total += steps[k]
        if total > most:
            break
        cut = k
    return table.where(level >= cut).select("word", "n").toArrow()


def count_tokens(notices: DataFrame, rules_path: str, key: str = KEY, text: str = TEXT, limit: int = 1024,
                 frequent: int = FREQUENT) -> DataFrame:
    """Tokens of every notice: ``key, n_bytes, n_tokens, over_limit`` (more than ``limit``), a row per input row.

    Tokens are those the library of the file gives for the whole text: no begin, end or added
    marks; a special string inside a text is one token, as is the library's default.  NULL and
    empty texts have none.  Keys may be NULL or repeat; other columns are ignored.

    Pieces are counted once per distinct pre-token and joined to each text's pre-token
    frequencies, which are then summed; no token id is ever made for a text.  The counts of
    frequent pre-tokens (at most ``frequent``) are joined inside the tasks, so that no hot word is
    shuffled; the rest is a plain join on the 64-bit hash of the pre-token.
    """
    rules = load_rules(rules_path)
    table = saved(pretoken_table(notices, rules, text), "pretokens")
    _, *cutting = rules
    known = notices.sparkSession.sparkContext.broadcast(frequent_words(table, frequent))

    def local(batches):
        frequent_table = known.value
        counts = dict(zip(frequent_table.column("word").to_pylist(), frequent_table.column("n").to_pylist(), strict=True))
        cut = PreTokenizer(*cutting)
        for part, values in _texts(batches, "text"):
            rows, settled, words, times = [], [], [], []
            for i, value in enumerate(values):
                found, total = cut.frequencies(value or "")
                rare = []
                for word, k in found.items():
                    n = counts.get(word)
                    if n is None:
                        rare.append((word, k))
                    else:
                        total += n * k
                # What is settled goes with the first line of the text, and only there.
                rows.extend([i] * max(len(rare), 1))
                settled.extend([total, *[None] * (len(rare) - 1)])
                words.extend([w for w, _ in rare] or [None])
                times.extend([k for _, k in rare] or [0])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(at) for c in ("key", "code", "n_bytes")), pa.array(settled, pa.int64()),
                 pa.array(words, pa.string()), pa.array(times, pa.int32())], schema.names)
        counts.clear()
        kernel.release()

    own = notices.select(F.col(key).alias("key"), F.xxhash64(text).alias("code"),
                         F.coalesce(F.octet_length(text), F.lit(0)).alias("n_bytes"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("key", notices.schema[key].dataType)]).add("code", "long").add("n_bytes", "integer") \
        .add("settled", "long").add("word", "string").add("times", "integer")
    word_hash = F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("word")
    lines = own.mapInArrow(local, schema).select("key", "code", "n_bytes", "settled", word_hash, "times")
    counts = table.select(F.xxhash64("word").alias("word"), "n")
    total = lines.join(counts, "word", "left").groupBy("key", "code", "n_bytes").agg(
        F.sum(F.coalesce("settled", F.lit(0)) + F.col("times") * F.coalesce("n", F.lit(0))).alias("total"),
        F.count("settled").alias("rows"))
    # Equal rows were summed together; each gets its share and a row of its own.
    share = (F.col("total") / F.col("rows")).cast("long")
    return total.select(F.col("key").alias(key), F.col("n_bytes").cast("long").alias("n_bytes"), share.alias("n_tokens"),
                        (share > limit).alias("over_limit"), F.explode(F.sequence(F.lit(1), "rows")).alias("_copy")).drop("_copy")
