"""Writers: contract tables, staged publication, manifests."""

from __future__ import annotations

import contextlib
import json
import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def to_contract(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of the contract in order, cast to its types; a missing nullable one is null."""
    made = []
    for f in schema.fields:
        if f.name in df.columns:
            made.append(F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata))
        elif f.nullable:
            made.append(F.lit(None).cast(f.dataType).alias(f.name, metadata=f.metadata))
        else:
            raise ValueError(f"{f.name} is missing")
    return df.select(*made)


def write_new(df: DataFrame, path: str, force: bool = False) -> None:
    """Parquet at a path that must not exist, unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def inferred(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The rows with some columns cast to given types and the rest as they are; no rows are an error."""
    if df.isEmpty():
        raise ValueError("there are no rows to infer a schema from")
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in df.columns})


def code_state(*modules) -> dict:
    """SHA-256 of the source files of modules, and the commit and cleanness of the repository they stand in (null without one)."""
    import hashlib
    import subprocess
    from pathlib import Path

    files = {m.__name__: hashlib.sha256(Path(m.__file__).read_bytes()).hexdigest() for m in modules}
    folder = str(Path(modules[0].__file__).parent) if modules else "."
    run = lambda *args: subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True)
    try:
        head, changed = run("rev-parse", "HEAD"), run("status", "--porcelain")
    except OSError:
        head = None
    found = head is not None and head.returncode == 0
    return {"code": files, "commit": head.stdout.strip() if found else None, "clean": not changed.stdout.strip() if found else None}


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path on this machine's disk, if that is what it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_text(spark: SparkSession, path: str, text: str, force: bool = False) -> None:
    """A text file that is there in full or not at all: written beside the path, then renamed over it in one step.

    What stood there before is gone only once the new text is there.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    if fs.exists(target) and not force:
        raise FileExistsError(path)
    if (local := local_path(spark, path)) is not None:
        beside = f"{local}.{uuid.uuid4().hex}"
        try:
            with open(beside, "w", encoding="utf-8", newline="") as out:
                out.write(text)
                out.flush()
                os.fsync(out.fileno())
            # A checksum that an earlier writer left isn't this text's.
            with contextlib.suppress(FileNotFoundError):
                os.remove(os.path.join(os.path.dirname(local), f".{os.path.basename(local)}.crc"))
            os.replace(beside, local)
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.remove(beside)
        return
    try:
        out = fs.create(staged)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf).rename(fs.makeQualified(staged), fs.makeQualified(target), options)
    finally:
        if fs.exists(staged):
            fs.delete(staged, False)


def markdown(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """A report: each table under its heading, with a line that says how many rows there are if not all are shown (a report's limit)."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    parts = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        lines = ["| " + " | ".join(map(cell, df.columns)) + " |", "|" + " --- |" * len(df.columns)]
        lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
        if len(rows) > most:
            lines.append(f"\n{most} of {df.count()} rows")
        parts.append(f"## {name}\n\n" + "\n".join(lines))
    return "\n\n".join(parts) + "\n"


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, force: bool = False, inputs: dict[str, DataFrame] | None = None, code: dict | None = None, validate=None) -> dict:
    """Write all tables beside the path, check them, and rename the folder into place; returns the manifest.

    Each table is read back and must have the schema, the rows and the content that were
    written. The manifest has digests of the tables, and of ``inputs`` and ``code`` (see
    code_state()) if given. ``validate`` is called with the tables as they were read back,
    before they are renamed; what it raises stops the publication. A failure leaves what
    was at the path as it was.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and not force:
        raise FileExistsError(path)
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    old = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.old")
    manifest, read = {}, {}
    try:
        for name, df in tables.items():
            # Counted while it is written, so that rows lost on the way are seen.
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{staged}/{name}")
            back = read[name] = spark.read.parquet(f"{staged}/{name}")
            if [(f.name, f.dataType) for f in back.schema] != [(f.name, f.dataType) for f in df.schema]:
                raise ValueError(f"{name}: what was read back has another schema")
            rows = back.count()
            if rows != seen.get["rows"]:
                raise ValueError(f"{name}: {seen.get['rows']} rows were written and {rows} read back")
            manifest[name] = {"rows": rows, "columns": back.columns, "sha256": content_sha256(back)}
        if validate is not None:
            validate(read)
        if inputs is not None:
            manifest["inputs"] = {name: {"columns": df.columns, "sha256": content_sha256(df)} for name, df in inputs.items()}
        if code is not None:
            manifest["code"] = code
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{staged}/manifest.json"))
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if fs.exists(target):
            fs.rename(target, old)
        if not fs.rename(staged, target):
            raise OSError(f"can't rename to {path}")
        fs.delete(old, True)
    except BaseException:
        if fs.exists(old) and not fs.exists(target):
            fs.rename(old, target)
        fs.delete(staged, True)
        raise
    return manifest


def load_published(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """The manifest and tables of a publication, once their content has been compared with the manifest's digests."""
    manifest = json.loads(spark.read.text(f"{path.rstrip('/')}/manifest.json", wholetext=True).first()[0])
    tables = {}
    for name, said in manifest.items():
        if name in ("inputs", "code"):
            continue
        tables[name] = spark.read.parquet(f"{path.rstrip('/')}/{name}")
        if content_sha256(tables[name]) != said["sha256"]:
            raise ValueError(f"{name} isn't what was published")
    return manifest, tables


def check_inputs(manifest: dict, inputs: dict[str, DataFrame]) -> None:
    """Inputs of a later step must be those of the publication, column by column and row by row."""
    for name, said in manifest["inputs"].items():
        if name not in inputs or content_sha256(inputs[name].select(*said["columns"])) != said["sha256"]:
            raise ValueError(f"{name} has changed since it was published")


def content_sha256(df: DataFrame) -> str:
    """A digest of the rows as a multiset, whatever their order: sums of row hashes, taken in 32-bit parts."""
    row = F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256)
    rows = df.select(row.alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(8)]
    return rows.select(*[p.alias(f"p{k}") for k, p in enumerate(parts)]).select(F.sha2(F.concat_ws(",", *[F.coalesce(f"p{k}", F.lit("0")) for k in range(8)]), 256)).first()[0]


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Quoted CSV of the named columns; others are ignored."""
    df.select(*columns).write.option("header", True).option("quoteAll", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line with its keys in order; nulls are kept."""
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", False).json(path)


def overwrite_slugs(df: DataFrame, path: str, slug: str = "slug", searched: DataFrame | None = None) -> None:
    """Replace the partitions of the slugs that the rows have; the rest of the cache stays.

    With ``searched`` (a column of slugs), slugs that were searched and gave nothing replace
    theirs too: by a row of nulls, which cached() takes as searched and empty.
    """
    if searched is not None:
        nothing = searched.select(slug).distinct().join(df.select(slug), slug, "left_anti")
        df = df.unionByName(nothing, allowMissingColumns=True)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(slug).parquet(path)


def cached(spark: SparkSession, path: str, slug: str = "slug") -> tuple[DataFrame, DataFrame]:
    """The cache's rows, and the slugs that were searched, those without any rows among them."""
    rows = spark.read.parquet(path)
    some = F.coalesce(*[F.col(c).isNotNull() | F.lit(None) for c in rows.columns if c != slug], F.lit(False))
    return rows.filter(some), rows.select(slug).distinct()
