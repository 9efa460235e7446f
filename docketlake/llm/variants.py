"""Spelling variants among the words of notice texts, from a bit-sliced position index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.notices import KEY, TEXT
from docketlake.llm.store import saved

LETTERS = r"[A-Za-zÀ-ÿ]+"
SLICE_WORDS = 1024        # index entries searched at once
SLICE_LETTERS = 1 << 18   # letters of them
BLOCK_WORDS = 4096        # blocks above are cut into finer ones
BROADCAST_BLOCKS = 500_000  # block keys (20 bytes) that are broadcast, at most
BLOCK = ["k", "x", "y", "part"]
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_counts(notices: DataFrame, key: str = KEY, text: str = TEXT, min_length: int = 7, min_count: int = 2,
                alter: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``word, n``: the letter runs of all whole texts, A-Z lower-cased, of enough letters and occurrences.

    ``alter`` maps key and lower-cased run to the word that counts; it may shorten a run, not
    lengthen it.  NULL texts hold no words; repeated rows count as often as they come.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = notices.select(F.col(key).alias("_key"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), 0)).alias("_run")) \
        .where(F.length("_run") >= min_length).withColumn("_run", F.translate("_run", upper, lower))
    word = alter(F.col("_key"), F.col("_run")) if alter else F.col("_run")
    return runs.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word") \
        .agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


# ---- blocks --------------------------------------------------------------------------------------------------


def _part(word: str) -> Column:
    """Hash of what a word's block shares: the ``x`` letters before the window and those after it."""
    after = F.greatest(F.col("k") - F.col("y"), F.lit(0))
    return F.xxhash64(F.substring(word, F.lit(1), F.col("x")), F.substring(word, F.length(word) - after + 1, after))


def _entries(words: DataFrame, shortest: int) -> DataFrame:
    """Index entries ``word, n, k, wider, x, y, part``.

    Words one edit apart share all letters outside the place of the edit.  With ``k`` letters
    in the shorter one, that place lies in one of three windows ``[x, y)`` of the shorter word
    and both share ``x`` letters before and ``k - y`` after the window.  Every word stands once as
    the shorter or an equally long one (``k`` is its length) and once as the longer one.
    """
    k = F.col("k")
    roles = F.array(F.struct(F.length("word").alias("k"), F.lit(False).alias("wider")),
                    F.struct((F.length("word") - 1).alias("k"), F.lit(True).alias("wider")))
    cuts = [F.lit(0), F.floor(k / 3).cast("int"), F.floor(2 * k / 3).cast("int"), k + 1]
    windows = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in zip(cuts, cuts[1:])])
    return words.select("word", "n", F.inline(roles)).where(k >= shortest) \
        .select("word", "n", "k", "wider", F.inline(windows)).where("x < y").withColumn("part", _part("word"))


def _finer(entries: DataFrame) -> DataFrame:
    """Entries under both halves of their window."""
    middle = F.floor((F.col("x") + F.col("y")) / 2).cast("int")
    halves = F.array(F.struct(F.col("x"), middle.alias("y")), F.struct(middle.alias("x"), F.col("y")))
    return entries.select("word", "n", "k", "wider", F.inline(halves)).withColumn("part", _part("word"))


def _blocks(words: DataFrame) -> DataFrame:
    """Entries whose blocks hold at most ``BLOCK_WORDS`` words, or have a window of one place.

    Windows of crowded blocks are halved, again and again; a block with a window of one place only
    holds words that differ in one or two letters.  Every pair still meets in exactly one block.
    """
    shortest = words.agg(F.min(F.length("word"))).first()[0] or 1
    pending, settled = _entries(words, shortest), []
    while True:
        crowded = saved(pending.where("y - x > 1").groupBy(*BLOCK).count().where(F.col("count") > BLOCK_WORDS).drop("count"), "crowded")
        number = crowded.count()
        if not number:
            break
        keys = F.broadcast(crowded) if number <= BROADCAST_BLOCKS else crowded
        settled.append(pending.join(keys, BLOCK, "left_anti"))
        pending = saved(_finer(pending.join(keys, BLOCK, "left_semi")), "halved")
    for part in settled:
        pending = pending.unionByName(part)
    return pending


# ---- bit-sliced search ---------------------------------------------------------------------------------------


def _bits(member: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, first column in the lowest bit."""
    width = -(-member.shape[1] // 64) * 64
    padded = np.zeros((len(member), width), dtype=bool)
    padded[:, : member.shape[1]] = member
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def near_pairs(codes: np.ndarray, lengths: np.ndarray, block: np.ndarray, k: np.ndarray, x: np.ndarray, y: np.ndarray,
               wider: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(shorter, other)``: index pairs of the same block whose only edit lies in the block's window.

    ``codes`` holds the letters of the words, a row each.  Per place and letter there is a
    bitset over the words; the words not wider ask for all others at once.  Three bitsets per
    asking word are carried from place to place: words without an error so far, words with one
    replaced letter, and words with one letter more, which are matched one place further on.
    The place of an edit is where the words first differ, so it lies in one window only.
    """
    letters = np.unique(codes)
    ids = np.searchsorted(letters, codes)
    ask = np.flatnonzero(~wider)
    mine, last = ids[ask], k[ask]
    low, high = x[ask], y[ask]
    longest = int(last.max(initial=0))

    def index(place: int) -> np.ndarray:
        if place >= codes.shape[1]:
            return np.zeros((len(letters), words), dtype=np.uint64)
        return _bits(np.where(place < lengths, ids[:, place], -1)[None, :] == np.arange(len(letters))[:, None])

    groups = np.unique(block, return_inverse=True)[1]
    clear = _bits(groups[None, :] == np.arange(groups.max(initial=0) + 1)[:, None])[groups[ask]]
    words = clear.shape[1]
    equal_role, wider_role = _bits(~wider[None, :])[0], _bits(wider[None, :])[0]
    replaced, inserted, out = np.zeros_like(clear), np.zeros_like(clear), np.zeros_like(clear)
    here = index(0)
    for place in range(longest + 1):
        inside = np.where((low <= place) & (place < high), ALL, np.uint64(0))[:, None]
        ended = last == place
        if ended.any():
            # Past the last letter: a wider word may have one more.
            out[ended] = (replaced[ended] & equal_role) | ((inserted[ended] | clear[ended] & inside[ended]) & wider_role)
        if place == longest:
            break
        after = index(place + 1)
        letter = mine[:, place]
        match, shifted = here[letter], after[letter]
        miss = clear & ~match & inside
        replaced = (replaced & match) | miss
        inserted = (inserted | miss) & shifted
        clear = clear & match
        here = after
    rows, slots = np.nonzero(out)
    found, bit = np.nonzero((out[rows, slots][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
    return ask[rows[found]], slots[found] * 64 + bit


def _search(slice_: pa.Table) -> pa.RecordBatch | None:
    """Per word of a slice: number of near words and the most frequent one of them, from this slice's blocks."""
    number = [slice_.column(c).to_numpy() for c in BLOCK]
    fresh = np.append(True, np.any([c[1:] != c[:-1] for c in number], axis=0)) if slice_.num_rows else np.zeros(0, bool)
    block = np.cumsum(fresh) - 1
    keep = np.flatnonzero(np.bincount(block)[block] > 1) if len(block) else np.zeros(0, np.int64)
    if not len(keep):
        return None
    slice_, block = slice_.take(pa.array(keep)), block[keep]
    words = slice_.column("word").to_pylist()
    lengths = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    codes = np.zeros((len(words), int(lengths.max())), dtype=np.uint32)
    codes[np.arange(codes.shape[1])[None, :] < lengths[:, None]] = points
    k, x, y, wider = (slice_.column(c).to_numpy(zero_copy_only=False) for c in ("k", "x", "y", "wider"))
    shorter, other = near_pairs(codes, lengths, block, k, x, y, wider)
    if not len(shorter):
        return None
    # Equally long words ask for each other; a wider word is told by the shorter one.
    told = wider[other]
    asking = np.concatenate([shorter, other[told]])
    near = np.concatenate([other, shorter[told]])
    n = slice_.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    best = np.full(len(words), len(words))
    np.minimum.at(best, asking, rank[near])
    counts = np.bincount(asking, minlength=len(words))
    seen = np.flatnonzero(counts)
    form = np.array(order)[best[seen]]
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in seen]), pa.array(counts[seen].astype(np.int64)), pa.array(n[form]), pa.array([words[i] for i in form])],
        ["word", "n_near", "near_n", "near"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted entries in runs of whole blocks, as many as fill a slice; one larger block is a run of its own."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE_WORDS):
            held.append(batch.slice(first, SLICE_WORDS))
            table = pa.Table.from_batches(held)
            number = [table.column(c).to_numpy() for c in BLOCK]
            starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in number], axis=0)) + 1
            sizes = pc.cast(pc.utf8_length(table.column("word")), pa.int64()).to_numpy()
            at = 0
            while len(starts) and starts[-1] > at:
                full = min(at + SLICE_WORDS, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE_LETTERS)) + at + 1)
                fits = starts[(starts > at) & (starts <= full)]
                end = int(fits[-1]) if len(fits) else int(starts[starts > at][0])
                yield table.slice(at, end - at)
                at = end
            held = table.slice(at).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, near_n, near`` of the words that have near ones: one letter inserted, deleted or replaced.

    ``near`` is the near word of largest ``n``, the smallest of equally frequent ones.  Blocks are sorted
    into tasks by their key; only partial counts and bests leave a task, never pairs.
    """

    def search(batches):
        for slice_ in _slices(batches):
            found = _search(slice_)
            if found is not None:
                yield found

    sorted_ = _blocks(words.select("word", "n")).repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    found = sorted_.select("word", "n", *BLOCK, "wider").mapInArrow(search, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")) \
        .select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


# ---- operator ------------------------------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form: the end of the chain of forms.

    Each round joins the chains with themselves, which doubles the steps taken.  A form
    is more frequent than its word by the ratio, so chains are short and never closed.
    """
    roots = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = saved(roots.join(ahead, "root", "left").select("word", "root", "next"), "roots")
        if further.where("next IS NOT NULL").isEmpty():
            return roots
        roots = further.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of a table ``word, n``.

    Two words are near when they differ by one inserted, deleted or replaced code point.  A word's
    form is its near word of largest ``n`` if that is at least ``ratio`` times its own, else NULL; its root
    is the last form of the chain, the word itself without a form.  Words must be distinct and not
    NULL, as :func:`word_counts` gives them, and ``ratio`` above 1; other columns are not read.  An empty table
    gives an empty one.  Words may be of any length: blocks are cut where they are crowded, by
    windows of the word, never by a number of partners.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = saved(words.select("word", "n"), "words")
    near = near_words(words)
    known = saved(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        *[F.when(F.col("near_n") >= ratio * F.col("n"), F.col(a)).alias(b) for a, b in (("near", "form"), ("near_n", "form_n"))]), "forms")
    roots = _roots(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
