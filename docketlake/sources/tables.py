"""Scans and snapshots of the stored tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.session import work_dir


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


PARTS = 64  # buckets of a stored table by state
KEPT = 4    # versions whose files stay for readers that are still at work

Runs = dict[int, list[tuple[str, int]]]  # bucket -> its runs, oldest first, as (folder, rows)


def part_of(*columns: Column | str) -> Column:
    """Bucket of a row: a number, so that NULL and odd values need no folder name of their own."""
    return F.pmod(F.xxhash64(*columns), F.lit(PARTS)).cast("int")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions that are kept; a version is committed once its manifest is there."""
    fs, root = _fs(spark, f"{path}/_manifest")
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, Runs]:
    """Number and runs of the newest version, or of the newest below ``before``; 0 without one.

    The manifest is all that is read to find the files: ``PARTS`` buckets of a few runs each.
    """
    known = [n for n in versions(spark, path) if before is None or n < before]
    return (known[-1], _runs_of(spark, path, known[-1])) if known else (0, {})


def _runs_of(spark: SparkSession, path: str, version: int) -> Runs:
    fs, file = _fs(spark, f"{path}/_manifest/{version:010d}.json")
    stream = fs.open(file)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {int(part): [(folder, n) for folder, n in runs] for part, runs in json.loads(text).items()}


def read_runs(spark: SparkSession, path: str, runs: Runs, schema: T.StructType | None = None) -> DataFrame:
    """All rows of some runs with the ``_version`` that wrote them; a key may be in several."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(*(f"{path}/{folder}/_part={part}" for part, found in runs.items() for folder, _ in found))
    number = F.regexp_extract("_metadata.file_path", r".*/version=(\d+)", 1).cast("long")
    return rows.select("*", number.alias("_version"))


def newest(rows: DataFrame, key: Sequence[str] = ("state", "hash")) -> DataFrame:
    """The row of the newest version of each key, without ``_version``; at most one row per key and task is shuffled."""
    w = Window.partitionBy(*key).orderBy(F.desc("_version"))
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth", "_version")


def read_snapshot(
    spark: SparkSession,
    path: str,
    before: int | None = None,
    schema: T.StructType | None = None,
    parts: Collection[int] | None = None,
    key: Sequence[str] = ("state", "hash"),
) -> DataFrame | None:
    """The table as of the newest committed version, or the newest below ``before``; None without one.

    ``parts`` reads only those buckets.  Buckets of a single run are read as they lie; where there are
    several, the newest row of each key counts.
    """
    _, runs = manifest(spark, path, before)
    if parts is not None:
        runs = {p: found for p, found in runs.items() if p in parts}
    whole = {p: found for p, found in runs.items() if len(found) == 1}
    layered = {p: found for p, found in runs.items() if len(found) > 1}
    frames = []
    if whole:
        frames.append(read_runs(spark, path, whole, schema).drop("_version"))
    if layered:
        frames.append(newest(read_runs(spark, path, layered, schema), key))
    return reduce(DataFrame.unionByName, frames) if frames else None


def write_snapshot(df: DataFrame, path: str, version: int, key: str = "", partition: str = "state",
                   sort: str = "notice_date") -> str:
    """Write rows as the runs of a version, which is in force once it is committed; returns the folder.

    The folder has a name of its own, so a job that is lost or repeated touches no file in force.
    A bucket is one file while it is small; adaptive execution splits a hot one by its size among many writers.
    """
    folder = f"{path}/version={version:010d}.{key}.{uuid.uuid4().hex[:8]}"
    df.withColumn("_part", part_of(partition)).hint("rebalance", F.col("_part")).sortWithinPartitions("_part", partition, sort) \
        .write.partitionBy("_part").parquet(folder)
    return folder


def folding(runs: Runs, incoming: Mapping[int, int]) -> Runs:
    """Runs that a batch (rows by bucket) is written together with.

    Those are the newest runs of each touched bucket, as long as the next older one has at most
    twice the rows gathered so far.  Runs grow geometrically: a bucket of n rows has about log2(n) of them,
    and a row is rewritten about as often, however many batches there are.
    """
    folded: Runs = {}
    for part, rows in incoming.items():
        found, first = runs.get(part, []), len(runs.get(part, []))
        while first and found[first - 1][1] <= 2 * rows:
            first -= 1
            rows += found[first][1]
        if found[first:]:
            folded[part] = found[first:]
    return folded


def commit_snapshot(spark: SparkSession, path: str, version: int, folder: str, folded: Runs, base: Runs) -> Runs:
    """Put a written version in force: ``base`` without the ``folded`` runs, with those of ``folder``.

    The manifest appears as a whole by a rename.  A version that is there already was made by another
    writer and raises.
    """
    name = folder.rsplit("/", 1)[1]
    counts = spark.read.parquet(folder).groupBy("_part").count().collect()  # at most PARTS rows
    runs = {part: list(found) for part, found in base.items()}
    for part, n in counts:
        left = len(runs.get(part, [])) - len(folded.get(part, []))
        runs[part] = [*runs.get(part, [])[:left], (name, n)]
    fs, target = _fs(spark, f"{path}/_manifest/{version:010d}.json")
    if fs.exists(target):
        raise RuntimeError(f"version {version} of {path} was written by somebody else")
    _, draft = _fs(spark, f"{path}/_manifest/{name}.draft")
    out = fs.create(draft, True)
    try:
        out.write(json.dumps(runs).encode())
    finally:
        out.close()
    if not fs.rename(draft, target):
        raise RuntimeError(f"version {version} of {path} could not be committed")
    return runs


def vacuum(spark: SparkSession, path: str, kept: int = KEPT) -> int:
    """Delete the files that none of the newest ``kept`` versions reads; returns the number of folders.

    Run folders of jobs that never committed go too, once a later version is the oldest kept.
    """
    known = versions(spark, path)
    old, held = known[:-kept], known[-kept:]
    if not old:
        return 0
    live = {(f, p) for n in held for p, found in _runs_of(spark, path, n).items() for f, _ in found}
    dead = {(f, p) for n in old for p, found in _runs_of(spark, path, n).items() for f, _ in found} - live
    live_folders = {f for f, _ in live}
    fs, root = _fs(spark, path)
    lost = {s.getPath().getName() for s in fs.listStatus(root)} - live_folders
    gone = [f for f in lost if f.startswith("version=") and int(f[8:].partition(".")[0]) < held[0]]
    gone += [f"{f}/_part={p}" for f, p in dead if f in live_folders]
    # Manifests go last: what a lost vacuum leaves behind is found again.
    for name in [*gone, *(f"_manifest/{n:010d}.json" for n in old)]:
        fs.delete(_fs(spark, f"{path}/{name}")[1], True)
    return len(gone)


FILE_ROWS = 1000  # payloads of a file: texts pack so well that a task would read all of a large one


def stored(df: DataFrame, purpose: str, by: Sequence[str] = (), file_rows: int = 0) -> DataFrame:
    """Write a frame to the shared work folder and read it back, so that it is computed once.

    ``by`` names the columns of its folders.  With ``file_rows`` no file has more rows, so that the next
    step is dealt over all cores by files, however few tasks wrote them and however small they are.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.option("maxRecordsPerFile", file_rows).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str, batch_id: int) -> None:
    """Append one batch; a replayed batch replaces its own folder."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def has_batch(spark: SparkSession, path: str, batch_id: int) -> bool:
    """Is a batch appended as a whole?"""
    fs, marker = _fs(spark, f"{path}/batch_id={batch_id}/_SUCCESS")
    return fs.exists(marker)


def read_appended(spark: SparkSession, path: str, schema, below: int | None = None, numbered: bool = False,
                  number: T.StructField = T.StructField("batch_id", T.LongType())) -> DataFrame:
    """All appended batches, or only those below a batch number; ``numbered`` keeps the folder's ``number``."""
    fs, root = _fs(spark, path)
    full = T.StructType([*schema.fields, number])
    if not fs.exists(root) or not len(fs.listStatus(root)):
        df = spark.createDataFrame([], full)
    else:
        df = spark.read.schema(full).parquet(path)
    if below is not None:
        df = df.where(F.col(number.name) < below)
    return df if numbered else df.drop(number.name)
