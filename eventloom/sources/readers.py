"""Readers of the engine's inputs. All paths are opened by Spark, so any store will do."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Types of a schema contract and Spark's for them.
CONTRACT_TYPES = {"large_string": "string", "int64": "bigint", "float64": "double", "double": "double", "list<element: large_string>": "array<string>"}


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, optional: dict[str, str] | None = None) -> DataFrame:
    """A projected scan; optional columns that the files lack are null of the given type."""
    df = spark.read.parquet(path)
    for name, kind in (optional or {}).items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.select(*columns) if columns else df


def per_source(spark: SparkSession, paths: dict[str, tuple[str, bool]]) -> DataFrame:
    """Tables of several sources as one, tagged with _source; (path, required): a table that isn't required may be missing."""
    out = None
    for source, (path, required) in paths.items():
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            if required:
                raise FileNotFoundError(path)
            continue
        df = spark.read.parquet(path).withColumn("_source", F.lit(source))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def by_file(spark: SparkSession, pattern: str) -> DataFrame:
    """Parquet files with the name of each (without ending) and the place of each row in it."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.parquet)?$", 1)
    return spark.read.parquet(pattern).select("*", name.alias("_file"), F.col("_metadata.row_index").alias("_row"))


def first_rows(files: DataFrame, most: int) -> DataFrame:
    """The first rows of each file that by_file() read: a sampling operator."""
    return files.filter(F.col("_row") < most)


def json_caches(spark: SparkSession, pattern: str, element: DataType | str) -> DataFrame:
    """One row per claim of caches that hold an array each: slug (the file's name), ordinal, claim and raw text.

    A cache that isn't an array of objects gives a single row with a null claim and ``status`` bad; an empty one gives a row of status empty.
    """
    kind = element if isinstance(element, str) else element.simpleString()
    files = spark.read.text(pattern, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1).alias("slug"), "value")
    parsed = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
    rows = files.select("slug", parsed.alias("claims"))
    rows = rows.select("slug", F.when(F.col("claims").isNull(), "bad").when(F.size("claims") == 0, "empty").otherwise("ok").alias("status"), F.posexplode_outer("claims").alias("ordinal", "one"))
    raw = F.to_json("one")
    return rows.select("slug", "status", "ordinal", F.from_json(raw, kind).alias("claim"), raw.alias("raw"))


def jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One object per line that isn't blank; a line that isn't an object of the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def csv(spark: SparkSession, pattern: str) -> DataFrame:
    """All columns as text, quoted fields over several lines; empty fields are empty text."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(pattern).na.fill("")


def documents(spark: SparkSession, pattern: str) -> DataFrame:
    """Whole text files: the folder that holds each (a card's identifier), its path and its text."""
    path = F.col("_metadata.file_path")
    return spark.read.text(pattern, wholetext=True).select(F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("card_id"), path.alias("path"), F.col("value").alias("text"))


def with_documents(wanted: DataFrame, docs: DataFrame, key: str = "card_id") -> DataFrame:
    """Wanted rows with their documents; a missing one is null and ``missing``, never clean."""
    return wanted.join(docs, key, "left").withColumn("missing", F.col("text").isNull())


def newest(files: DataFrame, slug: str = "slug", day: str = "day", *tie: str) -> DataFrame:
    """Of dated copies of a page the newest one for each slug; of one day's the one with the largest ``tie`` columns."""
    return files.groupBy(slug).agg(F.max_by(F.struct("*"), F.struct(day, *tie)).alias("_r")).select("_r.*")


def footer(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Rows and columns of Parquet files from their footers: a count that reads no column."""
    df = spark.read.parquet(path)
    return df.count(), df.columns


def with_match(claims: DataFrame, companies: DataFrame, slug: str = "slug") -> tuple[DataFrame, DataFrame]:
    """Claims of caches with the company of their slug, and the slugs of caches without one, counted. companies: slug and any other columns."""
    known = companies.dropDuplicates([slug])
    unmatched = claims.join(known, slug, "left_anti").groupBy(slug).agg(F.count(F.lit(1)).alias("n_claims"))
    return claims.join(known, slug), unmatched


def mapping(text: str) -> dict:
    """A configuration file as a mapping (YAML where that is installed, else JSON)."""
    try:
        import yaml
    except ImportError:
        found = json.loads(text)
    else:
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError("a mapping is expected")
    return found


def firm(text: str, slug: str) -> dict:
    """The entry of one firm in a list of firms (under ``firms``), by its slug."""
    for entry in mapping(text).get("firms", ()):
        if isinstance(entry, dict) and entry.get("slug") == slug:
            return entry
    raise LookupError(slug)


def aliases(spark: SparkSession, text: str) -> DataFrame:
    """(alias, canonical) from a manual alias table: a list under ``entries`` of a canonical name and its aliases.

    An alias of two names is an error, whatever its case and spaces.
    """
    seen: dict[str, str] = {}
    rows = []
    for entry in mapping(text).get("entries", ()):
        for alias in (entry["canonical"], *entry.get("aliases", ())):
            key = " ".join(alias.casefold().split())
            if seen.setdefault(key, entry["canonical"]) != entry["canonical"]:
                raise ValueError(f"{alias!r} stands for two names")
            rows.append((alias, entry["canonical"]))
    return spark.createDataFrame(rows, "alias string, canonical string")


def contract(text: str) -> tuple[StructType, tuple[str, ...]]:
    """The schema and the event types of a contract in JSON.

    Fields: ordered (name, type, nullable); metadata.schema_version must equal the document's
    schema_version, and event_types must be defined one by one.
    """
    doc = json.loads(text)
    metadata = doc.get("metadata", {})
    if isinstance(metadata, list):
        metadata = {m["key"]: m["value"] for m in metadata}
    if doc.get("schema_version") != metadata.get("schema_version"):
        raise ValueError("the versions of the document and of its metadata differ")
    kinds = tuple(doc.get("event_types", ()))
    if set(kinds) != set(doc.get("event_type_definitions", {})) and doc.get("event_type_definitions") is not None:
        raise ValueError("event types and definitions differ")
    schema = StructType()
    for f in doc["fields"]:
        if f["type"] not in CONTRACT_TYPES:
            raise ValueError(f"unknown type {f['type']!r}")
        schema = schema.add(f["name"], _type(CONTRACT_TYPES[f["type"]]), f.get("nullable", True), {"contract": f["type"]})
    return schema, kinds


def _type(name: str) -> DataType:
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType

    return {"string": StringType(), "bigint": LongType(), "double": DoubleType(), "array<string>": ArrayType(StringType())}[name]


def selectors(text: str) -> dict:
    """A page's selector configuration: entry selector, fields, and bounds of the number of rows."""
    found = mapping(text)
    for key in ("entry_selector", "fields"):
        if key not in found.get("selectors", {}):
            raise ValueError(f"selectors.{key} is missing")
    return found


def results_about(snippets: DataFrame, name_col: str, text_col: str, url_col: str) -> DataFrame:
    """Search results that name their company, each address once, the first one seen (ordinal)."""
    named = snippets.filter(F.lower(F.col(text_col)).contains(F.lower(F.col(name_col))))
    first = named.groupBy(name_col, url_col).agg(F.min_by(F.struct("*"), "ordinal").alias("_r"))
    return first.select("_r.*")


def fenced_json(text):
    """A Column: model output without the code fence around it."""
    return F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*|\s*```$", "")
