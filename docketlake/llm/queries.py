"""Registered queries of the training-data operators: given tables in, contract columns out."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm import (
    archive, counts, dialogues, idiom, language, leaks, passages, pieces, quality, rules, similar, variants, whitening,
)
from docketlake.llm.notices import from_documents
from docketlake.llm.store import batches_by_bytes
from docketlake.session import work_dir

BYTE_RULES = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches_by_bytes(spark)
    return from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "hash")


def _fold(parts: int) -> Column:
    """Fold of a notice: crc32 of its key as text."""
    return F.crc32(F.col("hash").cast("string")) % parts


@query
def op1_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_notices(_notices(spark, sf_dir), PIECE_MODEL)
    back = pieces.decode_notices(encoded, PIECE_MODEL)
    return back.select(F.col("hash").alias("doc_id"), F.size("piece_ids").alias("n_pieces"), "piece_ids",
                       (F.col("decoded") == F.coalesce("notes", F.lit(""))).alias("round_trip"))


@query
def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = passages.drop_repeats(_notices(spark, sf_dir), length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return cut.select(F.col("hash").alias("doc_id"), "n_bytes", removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_page_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumnRenamed("url", "source_url")
    path = work_dir(spark, "llm-archive")
    archive.write_archives(pages, path)
    whole = archive.reassemble(archive.read_records(spark, path))
    found = archive.resolved(whole)

    def number(record: str) -> Column:
        # Nothing stands for a missing page id.
        return F.nullif(F.regexp_extract(record, r"page:(-?\d+)", 1), F.lit("")).cast("long")

    return found.select(
        number("record_id").alias("page_id"), "payload_bytes",
        F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"), "record_type",
        number("refers_to").alias("refers_to"))


ORACLES["op3_page_archive"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN response <> page_id THEN response END AS refers_to
FROM q
"""


@query
def op4_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks.leaked_items(_notices(spark, sf_dir), items).withColumnRenamed("hash", "doc_id")


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(_notices(spark, sf_dir), BYTE_RULES, limit=1024).withColumnRenamed("hash", "doc_id")


@query
def op6_language_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.score_language(_notices(spark, sf_dir), learn=_fold(7) != 2).withColumnRenamed("hash", "doc_id")


@query
def op9_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    notices = _notices(spark, sf_dir)
    model = quality.fit_quality(notices, _labels(spark, sf_dir), learn=_fold(5) != 0)
    return quality.score_quality(notices, model, threshold=0.3).select(
        F.col("hash").alias("doc_id"), F.coalesce(_fold(5) == 0, F.lit(True)).alias("held_out"), "score", "predicted")


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    notices = _notices(spark, sf_dir)
    learned = rules.fit_rules(notices, _labels(spark, sf_dir))
    return rules.apply_rules(rules.text_statistics(notices), learned).select(
        F.col("hash").alias("doc_id"), *rules.STATISTICS, "base_failed", "kept")


@query
def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return dialogues.rotate_perspectives(turns).select(
        F.col("conversation").alias("conv_id"), "part", "participant", F.size("messages").alias("n_messages"), "rendered",
        F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["begin"].cast("string"), m["end"].cast("string"))), ",").alias("masks"))


ORACLES["op7_perspectives"] = r"""
WITH t AS (
  SELECT conv_id, coalesce(turn // 512, 0) AS part, turn,
         CASE WHEN coalesce(lower(trim(role)), '') = '' THEN 'unknown' ELSE lower(trim(role)) END AS speaker,
         coalesce(text, '') AS body
  FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> 'system'
), m AS (
  SELECT t.conv_id, part, participant, speaker = participant AS own,
         concat('<|', CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = participant THEN 'assistant'
                           ELSE concat('user name=', speaker) END, '|>') AS head, body,
         row_number() OVER w AS n
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
  WINDOW w AS (PARTITION BY t.conv_id, part, participant ORDER BY turn NULLS FIRST, speaker, body)
), o AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, part, participant ORDER BY n) AS e FROM m
)
SELECT conv_id, CAST(part AS BIGINT) AS part, participant, CAST(count(*) AS INTEGER) AS n_messages,
       string_agg(concat(head, body, chr(10)), '' ORDER BY n) AS rendered,
       coalesce(string_agg(concat(CAST(e - length(body) - 1 AS BIGINT), '-', CAST(e AS BIGINT)), ',' ORDER BY n) FILTER (WHERE own), '') AS masks
FROM o GROUP BY conv_id, part, participant
"""


@query
def op8_similar_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar.similar_notices(_notices(spark, sf_dir), n=3, threshold=90)
    return found.select(F.col("hash").alias("doc_id"), "n_shingles", "component_id")


ORACLES["op8_similar_notices"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_slice(words, i, i + 2) AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)
), sized AS (
  SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id
), shared AS (
  SELECT shingle FROM s GROUP BY shingle HAVING count(*) > 1
), t AS (
  SELECT s.* FROM s JOIN shared USING (shingle)
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM (SELECT x.doc_id AS p, y.doc_id AS q, count(*) AS k FROM t x JOIN t y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
        GROUP BY ALL) JOIN sized a ON a.doc_id = p JOIN sized b ON b.doc_id = q
  WHERE 100 * k >= 90 * (a.n + b.n - k)
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(node, seen) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.seen
)
SELECT sized.doc_id, CAST(n AS BIGINT) AS n_shingles, c AS component_id
FROM sized JOIN (SELECT node, min(seen) AS c FROM reach GROUP BY node) ON node = sized.doc_id
"""


def _every_31st(key: Column, run: Column) -> Column:
    """The run without one of its code points where 31 divides the crc32 of key and run."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.word_counts(_notices(spark, sf_dir), min_length=7, min_count=2, alter=_every_31st)
    return variants.spelling_variants(words, ratio=10)


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    notices = documents.select(F.col("doc_id").alias("hash"), F.col("text").alias("notes"), "lang")
    held_out = F.coalesce(_fold(4) == 2, F.lit(True))  # without an id a text is never learned from
    model = idiom.fit_languages(notices, learn=~held_out)
    return idiom.score_languages(notices.drop("lang"), model).select(
        F.col("hash").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")


@query
def op13_whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whitening.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return whitening.whiten(vectors, whitening.fit_whitening(vectors, components=4))


# The checksum is taken a half byte at a time; its 16 remainders are fixed values of the polynomial.
ORACLES["op11_spelling_variants"] = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL
), hexed AS (
  SELECT run, times, hex(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run)) AS digits FROM runs
), summed AS (
  SELECT run, times, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(digits)),
      lambda i: CAST(instr('0123456789ABCDEF', digits[(i // 2) * 2 + 2 - i % 2]) - 1 AS BIGINT))),
    lambda c, x: xor([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580,
                      3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][1 + (xor(c, x) & 15)], c >> 4))) AS h
  FROM hexed
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n
  FROM (SELECT times, CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word
        FROM summed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), shorter AS (
  SELECT DISTINCT word, n, length(word) AS size, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest
  FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON w.word = s.rest
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON w.word = s.rest
), best AS (
  SELECT p.word, count(*) AS n_near, arg_min(p.near, struct_pack(less := -w.n, near := p.near)) AS near, max(w.n) AS near_n
  FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form,
         CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), chain(word, root) AS (
  SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
), roots AS (
  SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL
)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word
"""
