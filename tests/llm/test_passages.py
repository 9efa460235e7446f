import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docketlake.llm import passages
from docketlake.llm.passages import drop_repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        cut = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                cut[i:i + length] = True
        out.append(bytes(x for x, c in zip(b, cut) if not c))
    return out


def random_texts(seed, length):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randint(1, 5)))
    block = lambda n: "".join(word() for _ in range(n))
    shared = [block(length // 2) for _ in range(3)]
    rows = []
    for _ in range(25):
        parts = [block(r.randint(0, length))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, len(s) // 2)
            parts += [s[a:a + r.randint(length // 2, 2 * length)], block(r.randint(0, 20))]
        rows.append("".join(parts))
    return [*rows, "", None, "ab" * length, "ab" * length + "x", "a" * (length + 1), "a" * (length - 1), rows[0], rows[1], rows[1]]


def check(notices, texts, length):
    rows = list(enumerate(texts))
    got = {r.hash: r for r in drop_repeats(notices(rows), length=length).collect()}
    for (k, t), kept in zip(rows, brute(texts, length)):
        raw = (t or "").encode()
        assert bytes(got[k].kept) == kept, k
        assert got[k].n_bytes == len(raw)
        assert sum(s.end - s.begin for s in got[k].spans) == len(raw) - len(kept)
        assert all(a.end < b.begin for a, b in zip(got[k].spans, got[k].spans[1:]))


def test_equals_brute_force(notices):
    for seed, length in ((1, 40), (2, 41), (3, 16)):
        check(notices, random_texts(seed, length), length)


def test_long_texts_come_in_pieces(notices, monkeypatch):
    monkeypatch.setattr(passages, "PIECE_BYTES", 300)
    texts = random_texts(4, 40)
    rows = list(enumerate(texts))
    # The pieces are cut by this process's helper; the tasks use the same code.
    starts = set()
    for s, offset in passages._pieces(notices(rows).toArrow().to_batches(), "notes", 40):
        row, first, last, *_ = passages._anchors(s, 40)
        starts.update((s.batch.column("hash")[int(r)].as_py(), int(i - s.start[r] + offset))
                      for r, f, t in zip(row, first, last) for i in range(f, t + 1))
    assert starts == {(k, i) for k, t in rows for i in range(len((t or "").encode()) - 39)}


def test_null_and_repeated_keys_no_rows_and_carried_columns(notices, empty):
    text = "the plant closes on the first of may " * 4
    rows = [(None, text), (1, text), (1, "short"), (1, "short"), (2, None)]
    out = drop_repeats(notices(rows), length=60, carry=["score", "key"]).collect()
    assert sorted((str(r.hash), bytes(r.kept), r.score, r["key"]) for r in out) == sorted(
        [("None", b"", "x", "z"), ("1", b"", "x", "z"), ("1", b"short", "x", "z"), ("1", b"short", "x", "z"), ("2", b"", "x", "z")])
    assert drop_repeats(empty, length=60).count() == 0


def test_borders_of_one_shared_passage_are_spread(spark, notices):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    shared, length = word(60), 40
    texts = [word(30) + shared + word(30) for _ in range(200)]
    check(notices, texts, length)
    rows = passages.identified(notices(list(enumerate(texts))))
    places = passages.reaches(rows, length)
    several = places.groupBy("gram", "reach").agg(F.count("*").alias("copies"), F.min(F.struct("row_a", "row_b", "first", "last")).alias("p")) \
        .select("gram", "reach", "copies", "p.*")
    hot = several.groupBy("gram").count().orderBy(F.desc("count")).first()
    assert hot["count"] >= 100
    strings = passages._border_strings(rows, several, length)
    # The variants of the hot gram meet under many keys, and never as one group of the gram.
    assert strings.where(F.col("gram") == hot["gram"]).select("string").distinct().count() > hot["count"]
    plan = passages._lone_strings(strings)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(gram" in plan and not re.search(r"hashpartitioning\(gram#\d+L?, \d+\)", plan)
