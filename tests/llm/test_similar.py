import random
import re

import numpy as np

from docketlake.llm import kernel
from docketlake.llm.components import components
from docketlake.llm.similar import adaptive_prefix, prefix_length, similar_notices


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, threshold):
    sets = {k: shingle_set(t, n) for k, t in rows}
    group = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                near = sets[a] and sets[b] and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both)
                if near and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return {k: (len(sets[k]), group[k]) for k in sets}


def texts():
    r = random.Random(7)
    vocabulary = [f"plant{i}" for i in range(400)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(40, 120))) for _ in range(12)]
    rows = []
    for i, t in enumerate(base):
        rows.append(t)
        for _ in range(4):
            words = t.split()
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(["amended", "revised", "plant9"])
            rows.append(" ".join(words))
        if i % 4 == 0:
            rows += [t, t.upper(), t + " closing", "  " + t.replace(" ", "\n")]
    return rows + ["", None, "  \n", "Layoff", "layoff", "two words", "Two\tWORDS", "a b c", "a b c d " * 3000]


def test_groups_equal_brute_force(spark, notices):
    rows = list(enumerate(texts()))
    random.Random(3).shuffle(rows)
    for n, threshold in ((3, 90), (5, 80)):
        got = {r.hash: (r.n_shingles, r.component_id) for r in similar_notices(notices(rows), n=n, threshold=threshold).collect()}
        assert got == brute(rows, n, threshold)


def test_null_and_repeated_keys_and_no_rows(spark, notices, empty):
    same = "warn notice of a closing at the north plant " * 3
    rows = [(None, same), (1, same), (1, same), (2, same), (3, "x"), (None, None)]
    got = sorted(((r.hash, r.component_id) for r in similar_notices(notices(rows)).collect()), key=str)
    assert got == sorted([(None, None), (None, None), (1, 1), (1, 1), (2, 1), (3, 3)], key=str)
    assert similar_notices(empty).count() == 0


def test_string_keys(notices):
    rows = [("b", "one two three four"), ("a", "one two three four"), ("c", "five")]
    got = {r.hash: r.component_id for r in similar_notices(notices(rows, "string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


def test_prefix_keeps_the_guarantee():
    """Partners at the threshold share the smaller of both required numbers of prefix tokens."""
    r = np.random.default_rng(5)
    levels = r.integers(0, 9, 1 << 10).astype(np.uint8)
    for _ in range(200):
        common = r.integers(0, 2**63, int(r.integers(1, 90))).astype(np.uint64)
        x, y = (np.unique(np.concatenate([common, r.integers(0, 2**63, int(r.integers(0, 8))).astype(np.uint64)])) for _ in range(2))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 90 * (len(x) + len(y) - both):
            (p, k), (q, m) = (adaptive_prefix(t, levels, 90, 4) for t in (x, y))
            assert len(np.intersect1d(p, q)) >= min(k, m)
    assert prefix_length(10, 90) == 2


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_hashes_by_stretches_equal_hashes_of_the_whole():
    r = random.Random(3)
    s = kernel.from_texts([" ".join("x" * r.randint(1, 90) for _ in range(r.randint(0, 40))) for _ in range(30)] + ["", None])
    begin, end = kernel.words(s)
    whole = kernel.span_hash(kernel.prefix_sums(s.buf), begin, end)
    for stretch in (1, 7, 100, 1 << 18):
        assert (kernel.ordered_hashes(s.buf, begin, end, stretch) == whole).all()
    assert len(kernel.ordered_hashes(s.buf, begin[:0], end[:0])) == 0
