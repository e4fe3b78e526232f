"""Sources and sinks of event logs, JSON documents and file trees, all by Spark's own readers and writers."""

from __future__ import annotations

import json
import tomllib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "event_id string, run_id string, ts string, type string, payload string, trace_id string, span_id string, parent_span_id string, prev_hash string, event_hash string"
REQUIRED = ["event_id", "run_id", "ts", "type"]


def _payload_as_text(raw: DataFrame) -> DataFrame:
    """The line's fields as columns, the payload as JSON text with sorted keys."""
    parsed = raw.withColumn("e", F.from_json("value", EVENT, {"primitivesAsString": "false"}))
    return parsed.select("*", "e.*").drop("e")


def _numbered_lines(lines: DataFrame) -> DataFrame:
    """lines (file, block and more) with ord, a line's place in its file, from 1.

    Two passes over the splits: a task reads a split's lines one after the other, so their ids follow each other; the
    first id and the count of each split (one row a split) give, summed over the splits before it, where it begins in
    its file. Lines themselves are not ordered by anything, so a file of any size is read by as many tasks as it has splits."""
    own = lines.withColumn("id", F.monotonically_increasing_id())
    splits = own.groupBy("file", "block").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select("file", "block", "first_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return own.join(begins, ["file", "block"]).withColumn("ord", F.col("before") + F.col("id") - F.col("first_id") + 1).drop("id", "first_id", "before")


def _places_within(found: DataFrame, by: str) -> DataFrame:
    """ord of lines (file, ord) counted from the first line in their file with the same value of `by`."""
    first = found.groupBy(F.col("file").alias("_file"), F.col(by).alias("_by")).agg(F.min("ord").alias("_first"))
    met = found.join(first, (F.col("file") == F.col("_file")) & F.col(by).eqNullSafe(F.col("_by")))
    return met.withColumn("ord", F.col("ord") - F.col("_first") + 1).drop("_file", "_by", "_first")


def read_events(spark: SparkSession, path: str, tolerant: bool = False, by: str | None = None) -> DataFrame:
    """An event log, a JSON object a line, with ord (the line's place in its file, from 1) - the order is part of
    the data. With `by`, a column whose values' lines stand together in one file each (append_events(together=)), ord is the
    place among the lines of a value. Blank lines are skipped. A malformed line fails the query when it is read, or is left out if tolerant."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).where(F.trim("value") != "")
    event_id = F.get_json_object("value", "$.event_id")
    bad = F.try_parse_json("value").isNull() | event_id.isNull()
    raw = _numbered_lines(raw.where(~bad) if tolerant else raw)
    found = _payload_as_text(raw)
    if not tolerant:
        found = found.withColumn("event_id", F.when(bad, F.raise_error(F.concat(F.lit("malformed event: "), F.left("value", F.lit(80))))).otherwise(F.col("event_id")))
    return (_places_within(found, by) if by else found).drop("value", "file", "block")


def append_events(events: DataFrame, path: str, by: str | None = None, together: tuple[str, str] | None = None) -> None:
    """A compact JSON object a line, fields in alphabetical order; in a folder for each value of `by`, should it be given.
    With together (a column and one to order by, which is not written), the lines of each value stand in order in one file,
    and a file holds many values: files follow the size of a log, not the number of its runs."""
    if together:
        events = events.repartition(together[0]).sortWithinPartitions(*together).drop(together[1])
    lines = events.select(*([by] if by else []), F.to_json(F.struct(*sorted(events.columns))).alias("value"))
    (lines.write.partitionBy(by) if by else lines.write).mode("append").text(path)


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """The same log as a stream of files."""
    return _payload_as_text(spark.readStream.text(path)).drop("value")


def load_artifact(spark: SparkSession, path: str, schema: str, required: list[str] | None = None, lines: bool = False) -> DataFrame:
    """A JSON document by its schema, or with lines what write_artifact() writes, an object a line; a missing required
    field fails the query."""
    found = spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    for name in required or []:
        found = found.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{name} is missing"))).otherwise(F.col(name)))
    return found


def load_artifact_or_default(spark: SparkSession, path: str, schema: str, default: list | None = None) -> DataFrame:
    """The document, or the default rows where nothing is there."""
    try:
        return load_artifact(spark, path, schema)
    except AnalysisException:
        return spark.createDataFrame(default or [], schema)


def inside(root: str, path: str) -> str:
    """root/path, refused where it would leave the root or is no relative path."""
    parts = path.replace("\\", "/").split("/")
    if path.startswith(("/", "\\")) or ":" in parts[0] or ".." in parts or not path.strip("/"):
        raise ValueError(f"{path!r} is not below {root!r}")
    return f"{root.rstrip('/')}/{'/'.join(p for p in parts if p not in ('', '.'))}"


def write_artifact(df: DataFrame, path: str, root: str | None = None) -> DataFrame:
    """Replaces the document under Spark's commit protocol, fields in alphabetical order; gives sha256 and size of its
    rows. The hash is that of a tree over the rows' own hashes in order (hash_tree), so no task holds all rows. With a
    root, path is relative and has to stay below it."""
    out = inside(root, path) if root is not None else path
    text = df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))
    text.write.mode("overwrite").text(out)
    written = df.sparkSession.read.text(out).select(F.sha2("value", 256).alias("key"), F.octet_length("value").alias("n"))
    each = written.groupBy("key").agg(F.count("*").alias("copies"), F.sum(F.col("n") + 1).alias("n"))
    leaves = each.select("key", F.sha2(F.concat_ws(" ", "key", "copies"), 256).alias("hash"), "n")
    return hash_tree(leaves).select(F.col("hash").alias("sha256"), F.col("n").alias("size"))


def hash_tree(leaves: DataFrame, wide: int = 16) -> DataFrame:
    """hash, n (sum), n_leaves over leaves (key: unique, 64 hex digits of a hash; hash; n); 64 zeros without leaves.

    A Merkle tree by the digits of the keys: a node is the hash of its children's hashes in order of key, so the result
    depends on neither order nor partitions. Its depth follows the count: deep enough that the lowest nodes hold `wide`
    leaves on average, and every other node has at most 16 children. So no task ever gathers more than that."""
    depth, n = 0, leaves.count()
    while n > wide * 16**depth:
        depth += 1
    level = leaves.select("key", "hash", "n", F.lit(1).cast("long").alias("n_leaves"))
    for digits in range(depth, -1, -1):
        children = F.transform(F.array_sort(F.collect_list(F.struct("key", "hash"))), lambda x: x["hash"])
        prefix = F.substring("key", 1, digits) if digits else F.lit("")
        level = level.groupBy(prefix.alias("key")).agg(F.sha2(F.array_join(children, ""), 256).alias("hash"), F.sum("n").alias("n"), F.sum("n_leaves").alias("n_leaves"))
    whole = level.agg(F.max("hash").alias("hash"), F.sum("n").alias("n"), F.sum("n_leaves").alias("n_leaves"))  # one row, or none
    return whole.select(F.coalesce("hash", F.repeat(F.lit("0"), F.lit(64))).alias("hash"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"))


def scan_files(spark: SparkSession, path: str, ignored: Column | None = None) -> DataFrame:
    """path (relative to the root), length, content of every file below, ignored ones left out."""
    root = path.rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    plain = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), "^.*?" + root.replace("file://", "").replace(".", r"\.") + "(?=.)", "")
    found = found.select(plain.alias("path"), "length", "modificationTime", "content")
    return found if ignored is None else found.where(~ignored)


def manifest(files: DataFrame) -> DataFrame:
    """path, sha256, size of a package, in order, with its totals."""
    own = files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
    totals = own.agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))
    return own.join(F.broadcast(totals)).orderBy("path")


def ignore_patterns(spark: SparkSession, path: str) -> list[str]:
    """Lines of an ignore file (small, read on the driver) without comments and blanks."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    return [r.v for r in lines.collect()]


def deep_merge(base: dict, over: dict) -> dict:
    """Configuration: nested tables are merged, anything else is replaced."""
    return base | {k: deep_merge(base[k], v) if isinstance(base.get(k), dict) and isinstance(v, dict) else v for k, v in over.items()}


def load_config(text: str, kind: str) -> dict:
    """TOML or JSON by the standard library, YAML where a reader for it is installed."""
    if kind == "toml":
        return tomllib.loads(text)
    if kind == "json":
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def package_manifest(text: str, kind: str) -> dict:
    """name, version, description, dependencies and entry points of a project file."""
    data = load_config(text, kind)
    project = data.get("project", data) if kind == "toml" else data
    dependencies = project.get("dependencies", [])
    return {
        "name": project.get("name"), "version": project.get("version"), "description": project.get("description"),
        "dependencies": sorted(dependencies), "entrypoints": sorted(project.get("scripts", project.get("bin", {})) or {}),
    }
