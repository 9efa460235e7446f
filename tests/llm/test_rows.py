"""Scores, counts, rules, archives and dialogues on small rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docketlake.llm import archive, counts, dialogues, language, quality, rules
from docketlake.llm.queries import BYTE_RULES, QUERIES


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


TEXTS = ["", None, " \n\t", "Closing", "Closing the plant\nClosing the plant\n\nClosing the plant", "é ß 中 # $ a", "a b c a b c a b c",
         "x\rx", "word " * 4000, "it's 45's   end  \n\n <|endoftext|> after<|endoftext|>", "tab\tand nbsp 　 wide 😀😀"]


def test_statistics(notices, empty):
    got = {r.hash: r for r in rules.text_statistics(notices(list(enumerate(TEXTS)))).collect()}
    for k, text in enumerate(TEXTS):
        w = plain_words(text)
        triples = Counter(zip(w, w[1:], w[2:]))
        hit = {i + j for i in range(len(w) - 2) if triples[tuple(w[i:i + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if plain_words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))
        assert tuple(got[k][name] for name in rules.STATISTICS) == want, k
        assert got[k].source_name == "county list"
    assert rules.text_statistics(empty).count() == 0


def test_decision_list_finds_planted_rules_and_runs_as_a_condition(spark):
    r = np.random.default_rng(3)
    data = r.integers(0, 100, (3000, 5))
    data[:, 0] = r.integers(60, 500, 3000)
    bad = (data[:, 2] > 80) | ((data[:, 3] > 60) & (data[:, 4] > 70))
    learned = rules.learn_list(data, bad)
    frame = spark.createDataFrame(data.tolist(), ", ".join(f"{n} long" for n in rules.STATISTICS))
    kept = np.array([x.kept for x in rules.apply_rules(frame, learned, repeat_percent=10**6).select(*rules.STATISTICS, "kept").collect()])
    assert (kept == ~bad).mean() > 0.97
    assert rules.learn_list(data, np.zeros(3000, bool)).rules == ()


def labelled(spark, n=120):
    r = random.Random(2)
    good, bad = [f"filing{i}" for i in range(60)], [f"$$spam{i}!!" for i in range(60)]
    rows = [(k, " ".join(r.choice(good if k % 2 else bad) for _ in range(r.randint(60, 120)))) for k in range(n)]
    return rows, spark.createDataFrame([(k, k % 2, 0) for k in range(n)] + [(None, 1, 0), (5, None, 0)], "hash long, quality int, toxic int")


def test_quality_on_held_out_rows(spark, notices, empty):
    rows, labels = labelled(spark)
    frame = notices(rows + [(1000, None), (1001, ""), (None, "filing1 filing2")])
    model = quality.fit_quality(frame, labels, learn=F.col("hash") % 3 != 0)
    out = quality.score_quality(frame, model).collect()
    assert len(out) == len(rows) + 3 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.hash is not None and r.hash < 1000 and r.hash % 3 == 0]
    assert sum(r.predicted == r.hash % 2 for r in held) >= 0.95 * len(held)
    assert quality.score_quality(empty, model).count() == 0
    none = quality.fit_quality(frame, labels.limit(0))
    assert {r.score for r in quality.score_quality(frame, none).collect()} == {0.5}


def test_rules_are_fitted_on_labelled_rows(spark, notices):
    rows, labels = labelled(spark)
    frame = notices(rows)
    learned = rules.fit_rules(frame, labels)
    out = rules.apply_rules(rules.text_statistics(frame), learned).collect()
    assert all(r.kept == (r.hash % 2 == 1) for r in out if not r.base_failed)
    assert rules.fit_rules(frame, labels.limit(0)).rules == ()


def test_token_counts_equal_the_library(notices, empty):
    library = Tokenizer.from_file(BYTE_RULES)
    rows = [(k % 6 or None, t) for k, t in enumerate(TEXTS + TEXTS[-3:])]
    for frequent in (1, 1 << 20):
        out = counts.count_tokens(notices(rows), BYTE_RULES, limit=20, frequent=frequent).collect()
        want = [(k, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 20) for k, t in rows]
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out)
    assert counts.count_tokens(empty, BYTE_RULES).count() == 0


def test_language_scores_follow_the_counts(notices, empty, monkeypatch):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice("ab cd EF gh ij kl".split()) for _ in range(r.randint(0, 30)))) for k in range(60)] + [(60, None), (61, "new word")]
    learn = F.col("hash") % 3 != 0
    out = {x.hash: x for x in language.score_language(notices(rows), learn).collect()}
    tokens = {k: [w.lower() for w in plain_words(t)] + ["</end>"] for k, t in rows}
    count = Counter(w for k, ws in tokens.items() if k % 3 for w in ws)
    n, v = sum(count.values()), len(count)
    for k, ws in tokens.items():
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)
        assert (out[k].n_tokens, out[k].n_known, out[k].train_tokens) == (len(ws), sum(w in count for w in ws), n)
        assert out[k].base_score == pytest.approx(base) and out[k].held_out == (k % 3 == 0)
        assert math.isfinite(out[k].score) and out[k].score < 0
    assert language.score_language(empty, learn).count() == 0
    alone = language.score_language(notices([(None, "a b"), (None, "a b")]), F.lit(False)).collect()
    assert [x.train_tokens for x in alone] == [0, 0]


def test_mixture_prefers_what_predicts():
    cells = [{"level": 5, "pair_step": 0, "word_step": 40, "times": 90}, {"level": 5, "pair_step": -1, "word_step": 8, "times": 10},
             {"level": 1, "pair_step": -1, "word_step": 4, "times": 50}]
    w = language.learn_mixture(iter(cells), 100)
    assert w[5, 0] > 0.8 and w[1, 1] > 0.9 and np.allclose(w.sum(axis=1), 1)


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, "x") for k, u, h in rows], "page_id long, source_url string, html string, digest string")


def test_archive_round_trip(spark, tmp_path):
    mark = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big = "é<p>" * 30000
    rows = [(1, "http://a.example/x", "small"), (2, None, "small"), (3, "u\r\nv", big), (4, "u", big), (5, "u", None), (6, "u", ""),
            (7, "u", mark * 2000), (-8, "u", "\r\n0\r\n\r\n" * 300), (9, "u", big)]
    path = str(tmp_path / "archive")
    archive.write_archives(pages(spark, rows), path, segment_bytes=5000)
    out = {r.record_id: r for r in archive.reassemble(archive.read_records(spark, path)).collect()}
    assert len(out) == len(rows)
    for k, _, html in rows:
        r = out[f"<urn:page:{k}>"]
        if k in (3, 4):
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", "<urn:page:9>", None)
        else:
            assert (r.record_type, bytes(r.payload)) == ("response", (html or "").encode())
    sizes = {r.record_id: r.payload_bytes for r in archive.resolved(archive.reassemble(archive.read_records(spark, path))).collect()}
    assert sizes["<urn:page:3>"] == len(big.encode())
    none = str(tmp_path / "none")
    archive.write_archives(pages(spark, []), none)
    assert archive.reassemble(archive.read_records(spark, none)).count() == 0


def test_archive_of_repeated_and_missing_page_ids(spark, tmp_path):
    small, large, huge = "s" * 20, "m" * 2000, "h" * 9000
    rows = [(1, "u", huge), (1, "u", huge), (1, "v", "h" * 9001), (None, "u", huge), (None, "w", "n" * 9000), (None, "w", "n" * 9000),
            (2, "u", large), (2, "u", large), (0, "u", large), (None, "u", large), (3, "u", small), (3, "u", small), (None, "u", small),
            (None, "u", None), (None, "u", None), (7, "u", "plain")]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    path = str(tmp_path / "archive")
    archive.write_archives(pages(spark, rows), path, segment_bytes=4000)
    records = archive.reassemble(archive.read_records(spark, path)).collect()
    assert len({r.record_id for r in records}) == len(records) == len(rows)
    assert {r.refers_to for r in records} - {None} <= {r.record_id for r in records if r.record_type == "response"}
    for segment_bytes in (4000, archive.SEGMENT_BYTES):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(archive.write_archives, "__defaults__", (*archive.write_archives.__defaults__[:-1], segment_bytes))
            out = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in QUERIES["op3_page_archive"](spark, folder).collect()]
        assert sorted(out, key=str) == sorted([
            (1, 9000, "response", None), (1, 9000, "response", None), (1, 9001, "response", None), (None, 9000, "revisit", 1),
            (None, 9000, "response", None), (None, 9000, "revisit", None),
            (2, 2000, "response", None), (2, 2000, "response", None), (0, 2000, "revisit", 2), (None, 2000, "revisit", 2),
            (3, 20, "response", None), (3, 20, "response", None), (None, 20, "response", None),
            (None, 0, "response", None), (None, 0, "response", None), (7, 5, "response", None)], key=str)


def test_missing_segments_are_errors(spark, tmp_path):
    path = str(tmp_path / "archive")
    archive.write_archives(pages(spark, [(1, "u", "abc" * 9000)]), path, segment_bytes=4000)
    records = archive.read_records(spark, path)
    with pytest.raises(Exception, match="not complete"):
        archive.reassemble(records.where("segment != 2")).collect()


@pytest.mark.parametrize("payload", [b"", b"a", b"x" * 10000, archive.VERSION * 3, b"\r\n0\r\n\r\n"])
def test_chunked_framing(payload):
    framed = archive.chunked(payload, 7)
    assert archive.unchunked(framed) == payload and archive.VERSION not in framed
    with pytest.raises(ValueError):
        archive.unchunked(framed[:-5])


def test_dialogue_seen_by_every_participant(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "Ann", "hi"), (1, 2, "bob", "hé"), (1, 3, "ann", None), (1, 3, "ann", None), (2, 0, "system", "x"),
            (3, None, None, "?"), (None, 0, "ann", "lost"), (4, 600, "ann", "late"), (4, 1, "bob", "early")]
    turns = spark.createDataFrame([(*r, "m") for r in rows], "conv_id long, turn long, role string, text string, messages string")
    out = {(r.conversation, r.part, r.participant): r for r in dialogues.rotate_perspectives(turns).collect()}
    assert set(out) == {(1, 0, "ann"), (1, 0, "bob"), (3, 0, "unknown"), (None, 0, "ann"),
                        (4, 0, "ann"), (4, 0, "bob"), (4, 1, "ann"), (4, 1, "bob")}
    seen = out[1, 0, "bob"]
    assert [(m.role, m.name, m.content) for m in seen.messages] == [
        ("system", None, "rules"), ("user", "ann", "hi"), ("assistant", None, "hé"), ("user", "ann", ""), ("user", "ann", "")]
    assert [seen.rendered[m.begin:m.end] for m in seen.masks] == ["hé\n"]
    assert [out[1, 0, "ann"].rendered[m.begin:m.end] for m in out[1, 0, "ann"].masks] == ["hi\n", "\n", "\n"]
    assert dialogues.rotate_perspectives(turns.limit(0)).count() == 0


def test_archives_of_both_versions_and_of_none(spark, tmp_path):
    def record(version, k, block):
        head = f"WARC/{version}\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{k}>\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    blocks = [b"first", b"holds WARC/1.0\r\n and WARC/1.1\r\n inside", b""]
    for version in ("1.0", "1.1", "0.18"):
        (tmp_path / version).mkdir()
        (tmp_path / version / "a.warc").write_bytes(b"".join(record(version, k, b) for k, b in enumerate(blocks)))
    for version in ("1.0", "1.1"):
        got = archive.read_records(spark, str(tmp_path / version)).collect()
        assert [bytes(r[-1]) for r in sorted(got, key=lambda r: r[0])] == blocks
    with pytest.raises(Exception, match="not an archive"):
        archive.read_records(spark, str(tmp_path / "0.18")).collect()


def test_rules_leave_columns_of_the_caller_alone(spark, notices):
    stats = rules.text_statistics(notices([(1, "the plant closes " * 40), (2, "x")]))
    learned = rules.fit_rules(notices([]), spark.createDataFrame([], "hash long, quality int"))
    mine = stats.withColumn("n_symbols_share", F.lit("mine")).withColumn("kept", F.lit("old"))
    out = rules.apply_rules(mine, learned)
    assert {c for c in out.columns} == {*mine.columns, "base_failed"}
    assert [r.n_symbols_share for r in out.collect()] == ["mine", "mine"]


def test_quality_of_documents_without_an_id(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    extra = documents.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    documents.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = QUERIES["op9_quality_score"](spark, str(tmp_path))
    assert [r.held_out for r in out.where("doc_id IS NULL").collect()] == [True]
    assert out.where("held_out IS NULL OR score IS NULL").count() == 0
