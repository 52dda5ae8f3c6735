"""Commits of appends to a record collection.

An append writes its files to a folder of its own, and counts only once a small manifest names that folder.  A manifest's
name follows from the append's batch id and is created at most once, so a batch that is sent again adds nothing, and a run
that died left files that no manifest names.  The manifest also has the append's keys and types, as the reader's inference
would find them, so that reading needs no pass over the records to learn them.

``<collection>/_commits/manifests/<batch>.json`` and ``<collection>/_commits/data/<batch>/<attempt>/``; files that lie in the
collection's own folder are other writers'.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .files import fs_and_path, path_exists

MANIFEST = "batch string, folder string, records bigint, content_ids boolean, schema string"


@dataclass
class Commit:
    """One append: its batch id, the folder of its files, its record count, whether ids follow from content, keys and types as JSON."""

    batch: str
    folder: str
    records: int
    content_ids: bool
    schema: str


def _manifest(root: str, batch: str) -> str:
    return f"{root.rstrip('/')}/_commits/manifests/{hashlib.sha256(batch.encode()).hexdigest()[:40]}.json"


def new_attempt(root: str, batch: str) -> str:
    """A folder for one attempt at a batch, used by no other attempt."""
    return f"{root.rstrip('/')}/_commits/data/{hashlib.sha256(batch.encode()).hexdigest()[:40]}/{uuid.uuid4().hex}"


def commits(spark: SparkSession, root: str) -> list[Commit]:
    """All commits of a collection, in the order of their batch ids; a manifest that was not written to its end does not count."""
    folder = f"{root.rstrip('/')}/_commits/manifests"
    if not path_exists(spark, folder):
        return []
    rows = spark.read.schema(MANIFEST).json(folder).where("folder is not null and schema is not null").orderBy("batch").collect()
    return [Commit(**r.asDict()) for r in rows]


def find_commit(spark: SparkSession, root: str, batch: str) -> Commit | None:
    path = _manifest(root, batch)
    if not path_exists(spark, path):
        return None
    rows = spark.read.schema(MANIFEST).json(path).where("folder is not null and schema is not null").collect()
    return Commit(**rows[0].asDict()) if rows else None


def commit(spark: SparkSession, root: str, done: Commit) -> bool:
    """Name an attempt's files; False if the batch was committed before (that commit stays).

    The manifest is created only if it does not exist, which the file system decides; one that a dead run left
    unfinished is replaced.
    """
    path = _manifest(root, done.batch)
    if find_commit(spark, root, done.batch) is not None:
        return False
    fs, p = fs_and_path(spark, path)
    try:
        out = fs.create(p, bool(fs.exists(p)))
    except Exception:
        if find_commit(spark, root, done.batch) is not None:  # another writer of the batch was faster
            return False
        raise
    out.write(bytearray((json.dumps(asdict(done)) + "\n").encode()))
    out.close()
    return True


# --- keys and types ----------------------------------------------------------


def json_type(t: T.DataType) -> T.DataType | None:
    """The type that inference finds for values of a type written as JSON; None where it depends on the values."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T.LongType()
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return T.DoubleType()
    if isinstance(t, (T.BooleanType, T.NullType)):
        return t
    if isinstance(t, T.ArrayType):
        inner = json_type(t.elementType)
        return None if inner is None else T.ArrayType(inner)
    if isinstance(t, T.StructType):
        inner = [(f.name, json_type(f.dataType)) for f in t.fields]
        return None if any(x is None for _, x in inner) else T.StructType([T.StructField(n, x) for n, x in sorted(inner, key=lambda f: f[0])])
    if isinstance(t, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)):
        return T.StringType()
    return None


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds values of both, by the rules of inference: numbers widen, structs merge, anything else is text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merged(a, b)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType))
    if {type(a), type(b)} <= {T.LongType, T.DoubleType}:
        return T.DoubleType()
    return T.StringType()


def merged(a: T.StructType, b: T.StructType) -> T.StructType:
    """Union of the keys of two summaries, in name order."""
    types = {f.name: f.dataType for f in a.fields}
    for f in b.fields:
        types[f.name] = wider(types[f.name], f.dataType) if f.name in types else f.dataType
    return T.StructType([T.StructField(n, types[n]) for n in sorted(types)])


def settled(t: T.DataType) -> T.DataType:
    """A type to read with: what only ever was null is text."""
    if isinstance(t, T.NullType):
        return T.StringType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(settled(t.elementType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, settled(f.dataType)) for f in t.fields])
    return t
