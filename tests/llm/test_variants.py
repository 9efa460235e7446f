"""Spelling variants against a comparison of all pairs."""

import random

import numpy as np
import pytest

from docketlake.llm import variants


def edits_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(p != q for p, q in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(counts, ratio=10):
    out = {}
    forms = {}
    for w, n in counts.items():
        near = [v for v in counts if edits_one(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (n, len(near), counts[best] if forms[w] else None)
    rows = []
    for w, (n, near, form_n) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n, near, form_n))
    return sorted(rows)


def mutated(r, w, letters):
    at = r.randrange(len(w) + 1)
    kind = r.randrange(3)
    if kind == 0:
        return w[:at] + r.choice(letters) + w[at:]
    at = min(at, len(w) - 1)
    return w[:at] + (r.choice(letters) if kind == 1 else "") + w[at + 1:]


@pytest.fixture(scope="module")
def vocabulary():
    r = random.Random(4)
    letters = "abcàÿ"
    words = {"".join(r.choice(letters) for _ in range(r.randrange(1, 14))) for _ in range(300)}
    words |= {"severance" * 40, "severance" * 40 + "s", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "𝒶bcdefg", "abcdefg"}
    for w in list(words):
        for _ in range(4):
            words.add(mutated(r, w, letters))
    words.discard("")
    return {w: int(10 ** r.uniform(0, 4)) for w in sorted(words)}


@pytest.mark.parametrize("block, slice_", [(4096, 1024), (8, 16)])
def test_variants_equal_all_pairs(spark, vocabulary, monkeypatch, block, slice_):
    monkeypatch.setattr(variants, "BLOCK_WORDS", block)
    monkeypatch.setattr(variants, "SLICE_WORDS", slice_)
    words = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    got = sorted(tuple(r) for r in variants.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == brute(vocabulary)


def test_chain_of_forms(spark):
    counts = {"closing": 3000, "closinq": 200, "cloosinq": 9, "clooosinq": 1, "payroll": 5}
    words = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, form string")
    got = sorted(tuple(r) for r in variants.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == brute(counts)
    assert {r[0]: r[2] for r in got}["cloosinq"] == "closing"


def test_word_counts(spark, notices):
    rows = [(1, "Closing CLOSING closing, layoffs-layoffs"), (None, "Éclosion éclosion layoffs"), (2, None), (2, ""), (3, "short"), (3, "short")]
    got = {r.word: r.n for r in variants.word_counts(notices(rows)).collect()}
    assert got == {"closing": 3, "layoffs": 3}
    cut = variants.word_counts(notices(rows), alter=lambda key, run: run.substr(1, 7), min_count=1)
    assert {r.word: r.n for r in cut.collect()} == {"closing": 3, "layoffs": 3, "Éclosio": 1, "éclosio": 1}


def test_empty(spark, notices):
    words = variants.word_counts(notices([]))
    assert variants.spelling_variants(words).collect() == []
    with pytest.raises(ValueError):
        variants.spelling_variants(words, ratio=1)


def test_near_pairs_of_one_block():
    words = ["abcd", "abce", "abbd", "abcdd", "xabcd", "abc"]
    lengths = np.array([len(w) for w in words])
    codes = np.zeros((len(words), 5), dtype=np.uint32)
    for row, w in zip(codes, words):
        row[: len(w)] = [ord(c) for c in w]
    k = np.full(len(words), 4)
    wider = lengths == 5
    low, high = np.zeros(len(words), int), np.full(len(words), 5)
    keep = lengths >= 4
    a, b = variants.near_pairs(codes[keep], lengths[keep], np.zeros(5, int), k[keep], low[keep], high[keep], wider[keep])
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (2, 0)]
