"""Record collections and ledger versions on shared storage.

A collection is a folder of JSON-lines record files (schemaless records,
one id per record, append-only).  Reading it yields the union of all keys,
missing keys as null.  Appends are committed as a whole, with a summary of
their keys and types (``commits``); the reader's own inference is needed for
files of other writers only.  The working ledger is replaced by writing a new version folder,
never by overwriting the folder being read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import to_timestamp_ntz
from ..functions.text import fingerprint_parts, row_text
from ..operators.metrics import build_rollup
from ..schema import DATE, LEDGER, LEDGER_COLUMNS, REQUIRED_SYNC, TYPE
from .commits import Commit, commit, commits, find_commit, json_type, merged, new_attempt, settled
from .csv import require_columns
from .files import fs_and_path, has_visible_files, path_exists

ID = "_id"
MONTH_KEY = "month_key"
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def append_collection(
    records: DataFrame,
    path: str,
    idempotent: bool = False,
    max_records_per_file: int | None = None,
    required: Iterable[str] = REQUIRED_SYNC,
    batch: str | None = None,
) -> int:
    """Append every row as one record with its own id; returns the number of records added.

    An append counts as a whole or not at all: its files are read only once
    its commit names them (``commits``), so a run that dies adds nothing.
    ``batch`` names what is appended: a batch that was committed before adds
    nothing and returns 0, so a caller repeats a failed run under its name.

    Ids are random (``uuid()``), or with ``idempotent=True`` a SHA-256 of the
    record's content, and records whose id an earlier such append has
    committed are left out (use it only when a record's content identifies
    it; records that are identical within one call share an id and are all
    written).  The count comes from an ``Observation`` of the write
    itself (no second pass).  Files hold at most ``max_records_per_file``
    records when it is set (the record store committed 400 at a time; on
    files that limit would only multiply small files, so the default is
    one file per write task).  Missing required columns raise before
    anything is written.
    """
    require_columns(records.columns, required)
    spark = records.sparkSession
    batch = uuid.uuid4().hex if batch is None else batch
    if find_commit(spark, path, batch) is not None:
        return 0
    cols = records.columns
    rid = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false", "timestampNTZFormat": TS_FORMAT}), 256) if idempotent else F.expr("uuid()")
    out = records.select(rid.alias(ID), *cols)
    known = [c.folder for c in commits(spark, path) if c.content_ids] if idempotent else []
    if known:
        out = out.join(spark.read.schema(f"{ID} string").json(known), ID, "left_anti")
    obs = Observation(f"append_{uuid.uuid4().hex}")
    held = [F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)]
    # Nulls are written, so a key that is null in every record is still a key.
    folder = new_attempt(path, batch)
    w = out.observe(obs, F.count(F.lit(1)).alias("n"), *held).write.option("timestampNTZFormat", TS_FORMAT).option("ignoreNullFields", False)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    w.json(folder)
    seen = obs.get
    n = int(seen["n"])
    # Keys and types as inference would find them: none without records, no type where all are null.
    types = [T.NullType() if not seen[f"n{i}"] else json_type(records.schema[c].dataType) for i, c in enumerate(cols)] if n else []
    keys = T.StructType([T.StructField(c, t) for c, t in zip([ID, *cols], [T.StringType(), *types], strict=True)]) if n and None not in types else T.StructType([])
    unknown = bool(n) and not keys.fields
    done = Commit(batch, folder, n, idempotent, "" if unknown else keys.json())
    return n if commit(spark, path, done) else 0


def read_collection(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType | None = None,
    keep_id: bool = False,
) -> DataFrame:
    """All records of one or more collections; columns are the union of keys.

    Records count if an append committed them, or if another writer's files
    lie in the collection's folder.  Keys and types come from the summaries of
    the commits; only files without one are passed over to infer them
    (conflicting types are widened alike); ``schema`` replaces both where it is
    known.  Records of other writers count like our own, and an append of no
    rows adds no key.  A missing or empty collection gives an empty ledger.  A
    text ``Date`` is parsed to TIMESTAMP_NTZ.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    roots = [p for p in roots if path_exists(spark, p)]
    frames = [f for f in (_records(spark, root, schema) for root in roots) if f is not None]
    if not frames:
        return spark.createDataFrame([], LEDGER)
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f, allowMissingColumns=True)
    if not df.columns:
        return spark.createDataFrame([], LEDGER)
    if not keep_id and ID in df.columns:
        df = df.drop(ID)
    if DATE in df.columns:
        df = df.withColumn(DATE, to_timestamp_ntz(F.col(DATE), df.schema[DATE].dataType))
    front = [c for c in LEDGER_COLUMNS if c in df.columns]
    return df.select(*front, *[c for c in df.columns if c not in front])


def _records(spark: SparkSession, root: str, schema: T.StructType | None) -> DataFrame | None:
    """Records of one collection in one scan, or None if it has none."""
    reader = spark.read.option("timestampNTZFormat", TS_FORMAT)
    done = [c for c in commits(spark, root) if c.records]
    folders = [c.folder for c in done]
    others = [root] if has_visible_files(spark, root) else []
    if not folders and not others:
        return None
    if schema is None:
        schema = T.StructType([])
        for c in done:
            if c.schema:
                schema = merged(schema, T.StructType.fromJson(json.loads(c.schema)))
        unknown = others + [c.folder for c in done if not c.schema]
        if unknown:
            schema = merged(schema, reader.json(unknown).schema)
        schema = settled(schema)
    return reader.schema(schema).json(folders + others)


def replace_ledger(ledger: DataFrame, root: str, partition_by_month: bool = False, rollup: bool = True, fingerprint: bool = False) -> str:
    """Write the ledger as a new version under ``root`` and return its path.

    Versions are named by write time, so the newest complete one (with
    ``_SUCCESS``) is the current ledger; readers of older versions are never
    disturbed.  ``partition_by_month`` adds a ``month_key`` (``yyyy-MM``)
    directory level, so month views prune whole folders (for large ledgers).
    The rows are rebalanced on ``month_key`` first: each month lands in few
    files instead of one per write task, and AQE splits a hot month over
    several tasks.

    The version's rollup (sums by month, category and type) is written beside
    it afterwards, from the four columns it needs of the files just written;
    ``rollup=False`` leaves it out.  ``fingerprint=True`` also
    writes the fingerprint of its rows, one row, which tells whether another
    table has the same rows (``same_as_current``) without reading this version.
    """
    spark = ledger.sparkSession
    path = f"{root.rstrip('/')}/v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    if partition_by_month:
        keyed = ledger.withColumn(MONTH_KEY, F.date_format(F.col(DATE), "yyyy-MM")).hint("rebalance", MONTH_KEY)
        w = keyed.write.partitionBy(MONTH_KEY)
    else:
        w = ledger.write
    w.mode("errorifexists").parquet(path)
    if rollup:
        build_rollup(spark.read.parquet(path)).write.mode("errorifexists").parquet(rollup_path(path))
    if fingerprint:
        ledger_fingerprint(spark.read.parquet(path)).write.mode("errorifexists").parquet(fingerprint_path(path))
    return path


def _beside(version: str, mark: str) -> str:
    folder, _, name = version.rstrip("/").rpartition("/")
    return f"{folder}/{mark}-{name.removeprefix('v-')}"


def rollup_path(version: str) -> str:
    """Where the rollup of a ledger version lies: beside it, under the same name with ``r-`` for ``v-``."""
    return _beside(version, "r")


def fingerprint_path(version: str) -> str:
    """Where the fingerprint of a ledger version lies: beside it, under the same name with ``f-`` for ``v-``."""
    return _beside(version, "f")


def ledger_fingerprint(ledger: DataFrame) -> DataFrame:
    """Fingerprint parts (one row) of a ledger's rows: text and type of each."""
    typed = row_text(ledger).withColumn("text", F.concat("text", F.lit(", Type: "), F.coalesce(F.col(TYPE), F.lit("\0"))))
    return fingerprint_parts(typed)


def current_fingerprint(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprint parts of the current version; computed from the version itself where none was written."""
    version = current_ledger_path(spark, root)
    if version is None:
        return ledger_fingerprint(spark.createDataFrame([], LEDGER))
    path = fingerprint_path(version)
    return spark.read.parquet(path) if path_exists(spark, f"{path}/_SUCCESS") else ledger_fingerprint(spark.read.parquet(version))


def same_as_current(ledger: DataFrame, root: str) -> bool:
    """Whether the current version under ``root`` has exactly the rows of ``ledger``, in any order (then it need not be replaced)."""
    spark = ledger.sparkSession
    if current_ledger_path(spark, root) is None:
        return False
    return ledger_fingerprint(ledger).first() == current_fingerprint(spark, root).first()


def current_ledger_path(spark: SparkSession, root: str) -> str | None:
    fs, p = fs_and_path(spark, root)
    if not fs.exists(p):
        return None
    versions = sorted(
        (s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith("v-")),
        reverse=True,
    )
    for v in versions:
        if fs.exists(fs_and_path(spark, f"{v}/_SUCCESS")[1]):
            return v
    return None


def read_current_ledger(spark: SparkSession, root: str) -> DataFrame:
    path = current_ledger_path(spark, root)
    return spark.createDataFrame([], LEDGER) if path is None else spark.read.parquet(path)


def read_current_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Rollup of the current ledger version; built from the version itself where none was written (or its write did not finish)."""
    version = current_ledger_path(spark, root)
    if version is None:
        return build_rollup(spark.createDataFrame([], LEDGER))
    path = rollup_path(version)
    return spark.read.parquet(path) if path_exists(spark, f"{path}/_SUCCESS") else build_rollup(spark.read.parquet(version))
