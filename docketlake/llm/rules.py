"""Learned decision lists over text statistics, emitted as ordered Spark conditions."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm import kernel
from docketlake.llm.notices import KEY, TEXT, labelled_sample

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("n_symbols", "n_dup_lines", "n_repeat_words", "word_chars")
FIT_ROWS = 10_000      # notices of each label the list is learned from, at most
MIN_COVER = 5          # notices a rule must cover when it is grown
MIN_WORTH = 0.8        # a rule must reach this (p - n) / (p + n) on the pruning rows
MAX_RULES = 16
MAX_TERMS = 4
CUTS = 64              # candidate thresholds of a statistic
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


class Term(NamedTuple):
    """``statistic <= cut`` or ``statistic > cut``."""

    statistic: str
    above: bool
    cut: float

    def sql(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.cut!r}D"


class DecisionList(NamedTuple):
    """Rules in order: the first whose terms all hold rejects; notices that meet none are kept."""

    rules: tuple[tuple[Term, ...], ...]

    def rejects(self) -> Column:
        """The list as one ordered conditional expression over the statistics columns."""
        out = None
        for rule in self.rules:
            hit = F.expr(" AND ".join(t.sql() for t in rule))
            out = F.when(hit, True) if out is None else out.when(hit, True)
        return F.lit(False) if out is None else out.otherwise(False)


def text_statistics(notices: DataFrame, text: str = TEXT) -> DataFrame:
    """Adds the statistics of every whole text (all long) to its row.

    ``n_words``; ``word_chars``: code points in words; ``n_symbols``: characters of
    ``#*$%&|<>``; ``n_dup_lines``: lines with a word that equal an earlier line;
    ``n_repeat_words``: words inside a three-word window that the text holds twice or
    more.  NULL and empty texts give zeros.  Columns of those names are replaced.
    """
    kept = [f for f in notices.schema.fields if f.name not in STATISTICS]

    def measure(batches):
        for s in kernel.slices(batches, text):
            found = _statistics(s)
            yield pa.RecordBatch.from_arrays([s.batch.column(f.name) for f in kept] + [pa.array(x) for x in found],
                                             [f.name for f in kept] + list(STATISTICS))

    schema = T.StructType([*kept])
    for name in STATISTICS:
        schema = schema.add(name, "long")
    return notices.select(*dict.fromkeys([*(f.name for f in kept), text])).mapInArrow(measure, schema)


def _per_row(s: kernel.Slice, flags: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[s.end] - total[s.start]


def _again(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values grouped by row: is it equal to an earlier one; does it occur twice or more."""
    order = np.lexsort((np.arange(len(row)), value, row))
    same = np.zeros(len(row), bool)
    r, v = row[order], value[order]
    same[1:] = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    later, often = np.zeros_like(same), np.zeros_like(same)
    later[order], often[order] = same, twice
    return later, often


def _statistics(s: kernel.Slice) -> list[np.ndarray]:
    sums = kernel.prefix_sums(s.buf)
    begin, end = kernel.words(s)
    lo, hi = kernel.row_bounds(s, begin)
    row = np.repeat(np.arange(len(s.start)), hi - lo)
    first_bytes = np.concatenate([[0], np.cumsum((s.buf & 0xC0) != 0x80, dtype=np.int64)])
    chars = np.concatenate([[0], np.cumsum(first_bytes[end] - first_bytes[begin])])
    # Three-word windows that lie in one row.
    triples = kernel.chain(kernel.span_hash(sums, begin, end), 3)
    inside = np.flatnonzero(row[: len(triples)] == row[2:]) if len(row) > 2 else np.zeros(0, np.int64)
    _, often = _again(row[inside], triples[inside])
    covered = np.zeros(len(row), bool)
    for k in range(3):
        covered[inside[often] + k] = True
    repeat = np.concatenate([[0], np.cumsum(covered)])
    # Lines end at \n or at the end of their row.
    l_begin, l_end = kernel.runs(s.buf != 0x0A, s.start, s.end)
    l_row = kernel.row_of(s, l_begin)
    has_word = np.searchsorted(begin, l_begin) < np.searchsorted(begin, l_end)
    later, _ = _again(l_row[has_word], kernel.span_hash(sums, l_begin[has_word], l_end[has_word]))
    dup = np.bincount(l_row[has_word][later], minlength=len(s.start))
    return [hi - lo, chars[hi] - chars[lo], _per_row(s, _SYMBOL[s.buf]), dup.astype(np.int64), repeat[hi] - repeat[lo]]


def _columns(data: np.ndarray) -> dict[str, np.ndarray]:
    """Raw statistics and their shares of the words."""
    raw = {name: data[:, i].astype(float) for i, name in enumerate(STATISTICS)}
    return raw | {f"{name}_share": raw[name] / np.maximum(raw["n_words"], 1) for name in SHARES}


def with_shares(stats: DataFrame) -> DataFrame:
    """The derived columns that rules may test: each statistic per word."""
    return stats.withColumns({f"{name}_share": F.col(name) / F.greatest("n_words", F.lit(1)) for name in SHARES})


def learn_list(data: np.ndarray, bad: np.ndarray) -> DecisionList:
    """Sequential covering: grow a rule for bad notices, prune it, drop what it covers, go on.

    A rule grows term by term by information gain on two thirds of the rows and loses its
    last terms while that does not lower ``(p - n) / (p + n)`` on the other third.  Learning
    ends when a rule does not reach ``MIN_WORTH`` there, or covers none.
    """
    columns, rules = _columns(data), []
    part = np.arange(len(bad)) % 3 == 2
    grow, prune = np.flatnonzero(~part), np.flatnonzero(part)
    while len(rules) < MAX_RULES and bad[grow].any():
        rule, left = [], grow
        while len(rule) < MAX_TERMS and not bad[left].all():
            best = _best_term(columns, bad, left)
            if best is None:
                break
            rule.append(best)
            left = left[_holds(columns, best, left)]
        if not rule:
            break
        worth = [_worth(columns, bad, rule[:k], prune) for k in range(1, len(rule) + 1)]
        rule = rule[: int(np.argmax(worth)) + 1]
        if max(worth) <= MIN_WORTH:
            break
        rules.append(tuple(rule))
        grow, prune = (at[~_covers(columns, rule, at)] for at in (grow, prune))
    return DecisionList(tuple(rules))


def _holds(columns, term: Term, at: np.ndarray) -> np.ndarray:
    return (columns[term.statistic][at] > term.cut) == term.above


def _covers(columns, rule, at: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([_holds(columns, t, at) for t in rule]) if len(at) else np.zeros(0, bool)


def _worth(columns, bad, rule, at: np.ndarray) -> float:
    hit = _covers(columns, rule, at)
    p = int(bad[at][hit].sum())
    n = int(hit.sum()) - p
    return (p - n) / (p + n) if p + n else -1.0


def _best_term(columns, bad, at: np.ndarray) -> Term | None:
    """Term with the largest gain in information over the rows still covered."""
    p0, n0 = bad[at].sum(), (~bad[at]).sum()
    before = np.log2(p0 / (p0 + n0))
    best, top = None, 1e-9
    for name, values in columns.items():
        x = values[at]
        for cut in np.unique(np.quantile(x, np.linspace(0, 1, CUTS + 1), method="lower"))[:-1]:
            over = x > cut
            for above in (True, False):
                hit = over == above
                p = bad[at][hit].sum()
                n = hit.sum() - p
                if p and p + n >= MIN_COVER:
                    gain = p * (np.log2(p / (p + n)) - before)
                    if gain > top:
                        best, top = Term(name, above, float(cut)), gain
    return best


def fit_rules(notices: DataFrame, labels: DataFrame, key: str = KEY, text: str = TEXT, label: str = "quality",
              rows: int = FIT_ROWS) -> DecisionList:
    """Learn a list from the whole texts of at most ``rows`` notices of each label, chosen by a hash of the key.

    Label 0 is bad.  Without bad or without good notices the list is empty and rejects nothing.
    """
    sample = text_statistics(labelled_sample(notices, labels, key, label, rows, text=text), text) \
        .select("_key", "_label", *STATISTICS).toPandas()
    # Growing and pruning rows are told apart by their place in a random but fixed order.
    sample = sample.sort_values("_key").sample(frac=1.0, random_state=1)
    bad = sample["_label"].to_numpy() == 0
    if not bad.any() or bad.all():
        return DecisionList(())
    return learn_list(sample[list(STATISTICS)].to_numpy(), bad)


def apply_rules(stats: DataFrame, rules: DecisionList, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Adds ``base_failed`` and ``kept``: the two fixed rules first, then the learned list in order.

    Columns of those two names are replaced; all others stay as they are.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    own = {c: f"_own_{c}" for c in stats.columns if c in {f"{name}_share" for name in SHARES}}
    judged = with_shares(stats.withColumnsRenamed(own)).withColumn("base_failed", failed) \
        .withColumn("kept", ~F.col("base_failed") & ~rules.rejects()) \
        .drop(*[f"{name}_share" for name in SHARES])
    return judged.withColumnsRenamed({v: k for k, v in own.items()})
