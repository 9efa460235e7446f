"""The string kernel against sets in plain Python, and languages on held-out notices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlake.llm import idiom
from docketlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_symbols(text, letters):
    out = [0]
    for c in text.lower():
        s = letters.get(c, 1) if c.isalpha() else 0
        if s or out[-1]:
            out.append(s)
    return out if not out[-1] else [*out, 0]


def plain_grams(found):
    return {tuple(found[i: i + p]) for p in (1, 2, 3) for i in range(len(found) - p + 1)}


def test_kernel_equals_sets():
    texts = ["Notice of layoffs: 45 workers.", "avis de licenciement à Lyon", "x", "Äußerung  ÄUSSERUNG", "同僚 notice"]
    letters, grams, marks = idiom._landmarks(texts)
    known = {chr(c): 2 + i for i, c in enumerate(letters)}
    table, columns = idiom.symbol_table(letters), idiom.column_table(grams)
    others = [*texts, "notice à l'usine, 45 personnes", "ßß"]
    parts = [idiom.symbols(t, table) for t in others]
    assert [p.tolist() for p in parts] == [plain_symbols(t, known) for t in others]
    counted = set().union(*(plain_grams(plain_symbols(t, known)) for t in texts))
    sets = [plain_grams(plain_symbols(t, known)) & counted for t in others]
    want = [[len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1)) for b in sets[: len(texts)]] for a in sets]
    assert idiom.kernel(idiom.presence(parts, columns, len(grams)), marks) == pytest.approx(np.array(want), abs=1e-6)


def test_windows_cover_the_text():
    for length in (1, 3, 1999, 2000, 2001, 9_999):
        cut = idiom.windows(length)
        assert cut[0][0] == 0 and cut[-1][1] == length
        assert all(b - 2 == c or b == length for (_, b), (c, _) in zip(cut, cut[1:]))


def test_scores_equal_ridge_over_all_windows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("workers and plant", "en"), ("les usines et ouvriers", "fr"),
            ("the plant closed", "en"), ("une usine ferme", "fr"), ("plant", "en")])]
    notices = spark.createDataFrame(rows, "hash long, notes string, lang string").repartition(3)
    model = idiom.fit_languages(notices, landmarks=2)
    table, columns = idiom.symbol_table(model.letters), idiom.column_table(model.grams)
    seen = idiom.presence([idiom.symbols(t, table) for _, t, _ in rows], columns, len(model.grams))
    k = idiom.kernel(seen, model.landmarks)
    values, vectors = np.linalg.eigh(idiom.kernel(model.landmarks, model.landmarks))
    features = k @ vectors / np.sqrt(values)
    target = np.array([[1 if lang == name else -1 for name in model.languages] for *_, lang in rows])
    gram = features.T @ features
    weights = np.linalg.solve(gram + idiom.RIDGE * np.trace(gram) / len(gram) * np.eye(len(gram)), features.T @ target)
    want = features @ weights
    got = {r.hash: (r.lang_pred, r.score) for r in idiom.score_languages(notices, model).collect()}
    for i, line in enumerate(want):
        assert got[i][0] == model.languages[int(line.argmax())]
        assert got[i][1] == pytest.approx(min(1, max(0, (line.max() + 1) / 2)), abs=1e-6)


def test_missing_empty_and_long_texts(spark):
    long = "the plant closed its doors " * 20_000
    rows = [(1, "the plant closed and workers left", "en"), (2, "une usine ferme et les ouvriers partent", "fr"), (None, None, "en"),
            (3, "", None), (4, "12 345 !", "fr"), (5, long, None), (5, long, None), (6, "ouvriers", None), (None, "workers", "en")]
    notices = spark.createDataFrame([(*r, 7, "old", True) for r in rows],
                                    "hash long, notes string, lang string, score int, lang_pred string, _has_letter boolean")
    model = idiom.fit_languages(notices, learn=F.col("hash") < 3)
    out = idiom.score_languages(notices, model)
    assert sorted(out.columns) == sorted(notices.columns)
    got = [(r.hash, r.lang_pred) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (2, "fr"), (None, "und"), (3, "und"), (4, "und"), (5, "en"), (5, "en"), (6, "fr"),
                                           (None, "en")], key=str)
    assert all(0 <= r.score <= 1 and (r.lang_pred != "und" or r.score == 0) for r in out.collect())


def test_nothing_to_learn_from(spark):
    notices = spark.createDataFrame([(1, "workers", None)], "hash long, notes string, lang string")
    model = idiom.fit_languages(notices)
    assert [(r.lang_pred, r.score) for r in idiom.score_languages(notices, model).collect()] == [("und", 0.0)]
    none = notices.where("false")
    assert idiom.score_languages(none, idiom.fit_languages(none)).collect() == []


def test_registered_query_on_held_out_documents(spark):
    out = {r.doc_id: r for r in QUERIES["op12_language_id"](spark, SF).collect()}
    documents = spark.read.parquet(f"{SF}/documents.parquet").withColumn("rest", F.crc32(F.col("doc_id").cast("string")) % 4).collect()
    assert set(out) == {r.doc_id for r in documents} and len(out) == len(documents)
    assert all(out[r.doc_id].held_out == (r.rest == 2) for r in documents)
    held = [r for r in documents if r.rest == 2 and r.text]
    assert sum(out[r.doc_id].lang_pred == r.lang for r in held) > 0.97 * len(held)
