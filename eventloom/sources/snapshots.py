"""Publishing several tables at once, where renames of folders aren't atomic and others publish too.

A publication is a folder of its own that never changes, and one small pointer file that
makes it the newest: ``versions/<number>.json`` is created only if it isn't there. So of two
publishers that start from the same version one wins, the other gets a Conflict, and
nobody reads half of either. Readers take the pointer with the largest number that is
whole; older versions stay until expire().

Creating a file only if it is absent is one step everywhere: a hard link on a local disk,
an exclusive create elsewhere. An exclusive create may be seen while it is being written; such
a pointer isn't JSON yet, and for GRACE seconds counts as somebody's publication under way.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from eventloom.sources import sinks

#: Seconds after which a pointer that isn't whole is taken for one whose publisher died.
GRACE = 600


class Conflict(RuntimeError):
    """Somebody else has published since the version that this publication is based on."""


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    manifest: dict


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text; false, and nothing done, if there is one."""
    fs, where = _fs(spark, path)
    fs.mkdirs(where.getParent())
    if (local := sinks.local_path(spark, path)) is not None:
        staged = f"{local}.{uuid.uuid4().hex}"
        try:
            with open(staged, "w", encoding="utf-8") as out:
                out.write(text)
                out.flush()
                os.fsync(out.fileno())
            os.link(staged, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(staged)
    try:
        out = fs.create(where, False)
    except Exception as fault:
        if "FileAlreadyExists" in str(fault) or "already exists" in str(fault):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, Version | None, float]]:
    """(number, version or None where the pointer isn't whole, seconds since it was written), newest first."""
    fs, where = _fs(spark, f"{root}/versions")
    if not fs.exists(where):
        return []
    found = []
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if name.endswith(".json") and name[:-5].isdigit():
            stream = fs.open(status.getPath())
            try:
                text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
            finally:
                stream.close()
            try:
                said = json.loads(text)
                version = Version(int(name[:-5]), f"{root}/{said['folder']}", said["manifest"])
            except (ValueError, KeyError, TypeError):
                version = None
            found.append((int(name[:-5]), version, time.time() - status.getModificationTime() / 1000))
    return sorted(found, key=lambda x: -x[0])


def versions(spark: SparkSession, root: str) -> list[Version]:
    """What has been published, newest first."""
    return [v for _, v, _ in _pointers(spark, root.rstrip("/")) if v is not None]


def newest(spark: SparkSession, root: str) -> Version | None:
    return next(iter(versions(spark, root)), None)


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, base: int | None = None, inputs: dict[str, DataFrame] | None = None, code: dict | None = None, validate=None) -> Version:
    """Publish the tables as the version after ``base`` (0: the first one; None: the newest as this starts).

    They are written, read back and checked as sinks.publish() does, and become visible with
    the pointer alone. A Conflict, or any failure before, leaves what was published as it was and
    removes what this publication wrote.
    """
    root = root.rstrip("/")
    pointers = _pointers(spark, root)
    last = next((v.number for _, v, _ in pointers if v is not None), 0)
    base = last if base is None else base
    if last != base or any(v is None and number > last and age < GRACE for number, v, age in pointers):
        raise Conflict(f"{root} is at version {last}, and this publication is based on {base}")
    number = max([base, *(n for n, _, _ in pointers)]) + 1
    folder = f"snapshots/{number:012d}-{uuid.uuid4().hex}"
    fs, where = _fs(spark, f"{root}/{folder}")
    try:
        manifest = sinks.publish(spark, tables, f"{root}/{folder}", inputs=inputs, code=code, validate=validate)
        pointer = json.dumps({"folder": folder, "manifest": manifest, "base": base}, sort_keys=True)
        if not create_once(spark, f"{root}/versions/{number:012d}.json", pointer):
            raise Conflict(f"version {number} of {root} has been published by somebody else")
    except BaseException:
        fs.delete(where, True)
        raise
    return Version(number, f"{root}/{folder}", manifest)


def load(spark: SparkSession, root: str, number: int | None = None, verify: bool = True) -> tuple[Version, dict[str, DataFrame]]:
    """A version (None: the newest) and its tables; with verify their content is compared with the manifest first."""
    root = root.rstrip("/")
    version = next((v for v in versions(spark, root) if number in (None, v.number)), None)
    if version is None:
        raise FileNotFoundError(f"{root} has no version {number or ''}".rstrip())
    if verify:
        manifest, tables = sinks.load_published(spark, version.folder)
        if manifest != version.manifest:
            raise ValueError(f"the manifest of version {version.number} isn't what was published")
        return version, tables
    return version, {name: spark.read.parquet(f"{version.folder}/{name}") for name in version.manifest if name not in ("inputs", "code")}


def expire(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Remove all but the newest ``keep`` versions, pointers first, and folders of publications that never got one; the numbers removed.

    Folders without a pointer that are younger than GRACE may be under way and stay.
    """
    root = root.rstrip("/")
    found = versions(spark, root)
    gone = found[max(1, keep) :]
    for v in gone:
        fs, where = _fs(spark, f"{root}/versions/{v.number:012d}.json")
        fs.delete(where, False)
    held = {v.folder.rsplit("/", 1)[1] for v in found[: max(1, keep)]}
    dead = {v.folder.rsplit("/", 1)[1] for v in gone}
    fs, where = _fs(spark, f"{root}/snapshots")
    if fs.exists(where):
        for status in fs.listStatus(where):
            name = status.getPath().getName()
            if name in dead or name not in held and time.time() - status.getModificationTime() / 1000 > GRACE:
                fs.delete(status.getPath(), True)
    return [v.number for v in gone]
