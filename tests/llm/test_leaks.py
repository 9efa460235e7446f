import random
import re
from collections import Counter

from docketlake.llm.leaks import RADIUS, fingerprints, leaked_items, without_leaks


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def shingles(words):
    return [tuple(words[k:k + min(5, len(words))]) for k in range(max(1, len(words) - 4))] if words else []


def brute(rows, items, threshold):
    out = {}
    for k, text in rows:
        words = words_of(text)
        for i, item in items:
            own, best = words_of(item), 0.0
            if not own:
                continue
            a = Counter(shingles(own))
            for s in range(max(1, len(words) - len(own) + 1)):
                b = Counter(shingles(words[s:s + len(own)]))
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both) if b else 0.0)
            if best >= threshold:
                out[k, i] = best
    return out


def test_equals_brute_force(spark, notices):
    r = random.Random(5)
    vocabulary = [f"term{i}" for i in range(300)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(r.randint(12, 60)))) for i in range(30)] + [(30, "one two three"), (31, ""), (32, None), (33, "É. Closing!"),
                                                                          (34, "same same same same same same same same")]
    rows = [(k, " ".join(make(r.randint(0, 150)))) for k in range(20)]
    for k in range(40):
        words = r.choice(items[:30])[1].split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            words[r.randrange(len(words))] = "changed"
        rows.append((100 + k, " ".join(make(r.randint(0, 80)) + words + make(r.randint(0, 80)))))
    rows += [(200, items[3][1].upper() + "!!"), (201, "so one, two. THREE times"), (202, "é closing"), (203, None), (204, ""),
             (205, "same " * 9), (206, " ".join(items[4][1].split()[:-2]))]
    table = spark.createDataFrame(items + items[:2], "item_id int, text string")
    for item_bytes in (1 << 20, 1500):
        got = {(x.hash, x.item_id): x for x in leaked_items(notices(rows), table, item_bytes=item_bytes).collect()}
        want = brute(rows, items, 0.8)
        assert {k: x.similarity for k, x in got.items()} == want
        assert all(x.distance <= RADIUS for x in got.values())


def test_null_keys_and_no_rows(spark, notices, empty):
    items = spark.createDataFrame([(1, "the plant in the north closes for good this year")], "item_id int, text string")
    rows = [(None, "the plant in the north closes for good this year"), (4, "x"), (5, "see: the plant in the north closes for good this year")]
    assert sorted(str(x.hash) for x in leaked_items(notices(rows), items).collect()) == ["5", "None"]
    assert sorted(str(x.hash) for x in without_leaks(notices(rows), items).collect()) == ["4", "None"]
    assert leaked_items(empty, items).count() == 0
    assert leaked_items(notices(rows), items.limit(0)).count() == 0


def test_fingerprint_of_a_window_is_that_of_its_shingles():
    import numpy as np

    x = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    starts = np.arange(20)
    alone = [fingerprints(x[s:s + 30], np.zeros(1, np.int64), 30)[0] for s in starts]
    assert fingerprints(x, starts, 30).tolist() == alone
