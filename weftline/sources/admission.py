"""Admission of files: identity by content, an immutable store, a registry, and the schema-drift gate.

The registry is a folder with one JSON file for each content, named by its hash and created only if absent: that one step admits a file, so
of two admissions of one content, at any time and on any driver, exactly one registers it. An entry holds all that admission decided, the schema
included; the baseline that the next file is held against is the schema of the latest accepted entry, so there is no second file to keep in step.
Files of a folder are read and profiled together, in one job, and judged one after the other by path.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profiling
from .files import UnsupportedFormatError, facts_of, read_any, read_sheets

REGISTRY = "content_hash string, filename string, format string, status string, encoding string"
ENTRY = f"{REGISTRY}, seq bigint, columns array<struct<name:string,dtype:string>>"


@dataclass
class Admission:
    status: str
    content_hash: str
    format: str = ""
    encoding: str = ""
    rows: DataFrame | None = None
    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    type_changed: list[str] = field(default_factory=list)
    renames: dict[str, str] = field(default_factory=dict)
    path: str = ""
    error: str = ""


def file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = file_system(spark, path)
    return system.exists(where)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless there is one of its name; whether it did. Only one of several writers does.

    A distributed store's own create-if-absent decides; on a local disk a hard link to the whole file, as plain creation there looks first.
    """
    where, system = file_system(spark, path)
    if system.getUri().getScheme() == "file":
        local = where.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        draft = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(draft, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(draft)
    try:
        out = system.create(where, False)
    except Exception as error:  # noqa: BLE001  the gateway wraps what the store raised
        if system.exists(where):
            return False
        raise error
    out.write(text.encode())
    out.close()
    return True


def entries(spark: SparkSession, store: str) -> DataFrame:
    """All entries, several of a content that was run again."""
    path = f"{store}/registry"
    return spark.read.schema(ENTRY).json(path) if exists(spark, path) else spark.createDataFrame([], ENTRY)


def registry(spark: SparkSession, store: str) -> DataFrame:
    """The latest entry of each content."""
    names = [c.split()[0] for c in REGISTRY.split(", ")]
    latest = entries(spark, store).groupBy("content_hash").agg(F.max_by(F.struct(*names[1:]), "seq").alias("e"))
    return latest.select("content_hash", *[f"e.{n}" for n in names[1:]])


def unseen(files: DataFrame, known: DataFrame) -> DataFrame:
    """Of incoming files (with content_hash) the first of each content that the registry lacks."""
    first = files.groupBy("content_hash").agg(F.min("path").alias("path"))
    return first.join(known.select("content_hash"), "content_hash", "left_anti")


def baseline(spark: SparkSession, store: str) -> DataFrame:
    """Schema of the last accepted file, else the expected one: pos, name, dtype."""
    last = entries(spark, store).where("status = 'accepted'").orderBy(F.desc("seq"), "content_hash").limit(1)
    found = last.select(F.posexplode("columns").alias("pos", "c")).select("pos", "c.name", "c.dtype")
    return profiling.expected_schema(spark) if last.isEmpty() else found


def register(spark: SparkSession, store: str, entry: dict, rerun: bool = False) -> bool:
    """Commits an entry under its content's hash; a rerun adds one beside it."""
    digest = entry["content_hash"]
    line = json.dumps(entry, sort_keys=True) + "\n"
    if put_if_absent(spark, f"{store}/registry/{digest}.json", line):
        return True
    again = 1
    while rerun and not put_if_absent(spark, f"{store}/registry/{digest}-{again}.json", line):
        again += 1
    return rerun


def keep(spark: SparkSession, path: str, kept: str) -> None:
    """Copies a file's bytes into the store unless they are there."""
    if not exists(spark, kept):
        (source, at), (target, to) = file_system(spark, path), file_system(spark, kept)
        draft, _ = file_system(spark, f"{kept}.{uuid.uuid4().hex}")
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(at, source, to, draft, False, spark._jsc.hadoopConfiguration())
        if not to.rename(draft, target):
            to.delete(draft, False)


def gate(observed: list[tuple[str, str]], old: list[tuple[str, str]]) -> dict:
    """added, removed, type_changed (a file's tens of columns) against a baseline, and the proposed renames. Columns without values never change type."""
    now, before = dict(observed), dict(old)
    found = {"added": [n for n in now if n not in before], "removed": [n for n in before if n not in now], "type_changed": [n for n in now if n in before and now[n] not in (before[n], "empty")]}
    return found | {"renames": profiling.propose_mapping(found["added"], found["removed"])[0]}


def admit_all(spark: SparkSession, paths: str, store: str, rerun: bool = False) -> list[Admission]:
    """Every file of a folder (or pattern), by path: its bytes stored under their hash, its schema accepted or up for review.

    Content that is already registered, whatever its status, or that an earlier path holds, is a duplicate unless ``rerun``. A file that can't be parsed leaves
    nothing behind (status ``unsupported``). An accepted schema is the baseline of the files after it, its empty columns included.
    """
    facts = facts_of(spark, paths).orderBy("path").collect()
    known = {r["content_hash"]: r for r in registry(spark, store).join(F.broadcast(spark.createDataFrame([(h,) for h in sorted({f["content_hash"] for f in facts})], "content_hash string")), "content_hash").collect()} if facts else {}
    fresh, seen = [], set()
    for f in facts:
        if f["content_hash"] not in seen and (rerun or f["content_hash"] not in known):
            fresh.append(f)
        seen.add(f["content_hash"])
    sheets = read_sheets(spark, fresh)
    kinds = {(r["file"], r["pos"]): r["dtype"] for r in profiling.profiles(sheets.cells, ["file"]).select("file", "pos", "dtype").collect()} if fresh else {}
    last = [(r["name"], r["dtype"]) for r in baseline(spark, store).orderBy("pos").collect()]
    top = entries(spark, store).agg(F.max("seq")).first()[0]
    seq = -1 if top is None else top
    out, chosen = [], {f["path"] for f in fresh}
    for f in facts:
        digest, old = f["content_hash"], known.get(f["content_hash"])
        if f["path"] not in chosen:
            out.append(Admission("duplicate", digest, f["format"], old["encoding"] if old else f["encoding"], path=f["path"]))
            continue
        if f["file"] in sheets.errors:
            out.append(Admission("unsupported", digest, f["format"], path=f["path"], error=sheets.errors[f["file"]]))
            continue
        keep(spark, f["path"], f"{store}/raw/{digest}.{f['format']}")
        observed = [(n, kinds.get((f["file"], i), "empty")) for i, n in enumerate(sheets.headers.get(f["file"], []))]
        found = gate(observed, last)
        status = "review_required" if found["added"] or found["removed"] or found["type_changed"] else "accepted"
        seq += 1
        entry = {"content_hash": digest, "filename": f["path"].rsplit("/", 1)[-1], "format": f["format"], "status": status, "encoding": f["encoding"], "seq": seq, "columns": [{"name": n, "dtype": t} for n, t in observed]}
        if not register(spark, store, entry, rerun):
            out.append(Admission("duplicate", digest, f["format"], f["encoding"], path=f["path"]))
            continue
        last = observed if status == "accepted" else last
        out.append(Admission(status, digest, f["format"], f["encoding"], path=f["path"], **found))
    return out


def admit(spark: SparkSession, path: str, store: str, rerun: bool = False) -> Admission:
    """One file, with its rows where it isn't a duplicate; a file that can't be parsed raises."""
    found = admit_all(spark, path, store, rerun)[0]
    if found.status == "unsupported":
        raise UnsupportedFormatError(found.error)
    if found.status != "duplicate":
        found.rows = read_any(spark, path)[0]
    return found
