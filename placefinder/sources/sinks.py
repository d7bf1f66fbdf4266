"""Checked exports, manifests, and results as CSV."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ExportError(ValueError):
    """A table that must not be published."""


def counts(df: DataFrame, required: list[str], key: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """One row of counts: rows, missing_<column>, outside, duplicates."""
    missing = [F.count(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", 1)).alias(f"missing_{c}") for c in required]
    outside = F.count(F.when(~(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])), 1)) if box else F.lit(0)
    return df.agg(F.count(F.lit(1)).alias("rows"), *missing, outside.cast("long").alias("outside"), (F.count(key) - F.countDistinct(key)).alias("duplicates"))


def export(df: DataFrame, path: str, required: list[str], key: str, box: tuple[float, float, float, float] | None = None, form: str = "parquet") -> dict[str, int]:
    """Write a table only if it has rows, no missing values, nothing outside the box and no key twice."""
    found = counts(df, required, key, box).first().asDict()
    wrong = ["no rows"] if not found["rows"] else [f"{n} {k}" for k, n in found.items() if k != "rows" and n]
    if wrong:
        raise ExportError(", ".join(wrong))
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)
    return found


def write_text(spark, path: str, text: str) -> None:
    """A small file, by Spark's own file systems."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def replace_text(spark, path: str, text: str) -> None:
    """Like :func:`write_text`, but a reader sees the old file or the new one and nothing between: written aside, then
    renamed over it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs
    aside = f"{path}.{uuid.uuid4().hex}"
    write_text(spark, aside, text)
    system = files.Path(path).getFileSystem(conf)
    old, new = system.makeQualified(files.Path(path)), system.makeQualified(files.Path(aside))
    options = spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
    options[0] = files.Options.Rename.OVERWRITE
    files.FileContext.getFileContext(old.toUri(), conf).rename(new, old, options)


def checksum(df: DataFrame) -> dict:
    """rows, and an order-free checksum over all rows and columns, computed where the rows are."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)")).alias("sum")).first()
    return {"rows": row.n, "checksum": str(row["sum"])}


def publish(tables: dict[str, DataFrame], root: str, info: dict | None = None, expected: dict | None = None) -> str:
    """Write a build as a new version and then point ``root/current.json`` at it; readers see all of it or none. Where
    ``expected`` (name: :func:`checksum`) is given and a written table differs, the pointer stays and it is an error."""
    spark = next(iter(tables.values())).sparkSession
    version = f"{root.rstrip('/')}/v{time.time_ns()}"
    manifest = {"version": version, "tables": {}, "info": info or {}}
    for name, df in tables.items():
        df.write.parquet(f"{version}/{name}")
        manifest["tables"][name] = checksum(spark.read.parquet(f"{version}/{name}"))
    wrong = [name for name, found in manifest["tables"].items() if expected is not None and expected.get(name) != found]
    wrong += sorted(set(expected or {}) - set(manifest["tables"]))
    if wrong:
        raise ExportError(f"not as expected: {', '.join(wrong)}")
    write_text(spark, f"{version}/manifest.json", json.dumps(manifest))
    replace_text(spark, f"{root.rstrip('/')}/current.json", json.dumps({"version": version}))
    return version


def read_text(spark, path: str) -> str | None:
    """A small file; none if there is no such file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def dump(spark, root: str, target: str, order: dict[str, list[str]] | None = None) -> str:
    """Copy the current version under ``root`` to ``target``, tables in the physical order named for them; returns the
    version copied. The copy has its manifest last, so one without a manifest is no dump."""
    version = json.loads(read_text(spark, f"{root.rstrip('/')}/current.json"))["version"]
    held = json.loads(read_text(spark, f"{version}/manifest.json"))
    for name in held["tables"]:
        rows, by = spark.read.parquet(f"{version}/{name}"), (order or {}).get(name)
        (rows.repartitionByRange(*by).sortWithinPartitions(*by) if by else rows).write.mode("overwrite").parquet(f"{target.rstrip('/')}/{name}")
    replace_text(spark, f"{target.rstrip('/')}/manifest.json", json.dumps(held))
    return version


def restore(spark, source: str, root: str) -> str:
    """Publish a dump under ``root``; a table that is missing or differs from the dump's manifest stops it."""
    text = read_text(spark, f"{source.rstrip('/')}/manifest.json")
    if text is None:
        raise ExportError("no manifest")
    held = json.loads(text)
    return publish({name: spark.read.parquet(f"{source.rstrip('/')}/{name}") for name in held["tables"]}, root, held["info"], held["tables"])


def digests(spark, path: str) -> DataFrame:
    """file, bytes, sha256 of every file below ``path``; a file of more than 2 GB is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed, empty = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while listed.hasNext():  # a scan leaves out files without a byte
        one = listed.next()
        if not one.getLen():
            empty.append((one.getPath().toString(),))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    read = files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    none = spark.createDataFrame(empty, "file string").select("file", F.lit(0).cast("long").alias("bytes"), F.sha2(F.lit(b""), 256).alias("sha256"))
    return read.unionByName(none)


def record(spark, path: str, outputs: dict[str, dict]) -> dict:
    """Add ``outputs`` (name: what is known of it) to the JSON manifest at ``path``; entries of other runs stay."""
    held = json.loads(read_text(spark, path) or "{}").get("outputs", {})
    manifest = {"generated_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "outputs": held | outputs}
    replace_text(spark, path, json.dumps(manifest, indent=2))
    return manifest


def guarded(value: Column) -> Column:
    """A cell that a spreadsheet won't run as a formula."""
    text = value.cast("string")
    return F.when(text.rlike(r"^[=+\-@\t\r]") & ~text.rlike(r"^[+-]?\d+(\.\d+)?$"), F.concat(F.lit("'"), text)).otherwise(text)


def results_csv(df: DataFrame, path: str, order: str = "row_id") -> None:
    """Results in input order, sorted by range so that no task holds them all."""
    df.repartitionByRange(order).sortWithinPartitions(order).select(*(guarded(F.col(c)).alias(c) for c in df.columns)).write.mode("overwrite").csv(path, header=True)
