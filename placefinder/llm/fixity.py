"""Operator 3: Merkle fixity audit of WARC replicas (DataFrame functions).

Pages become WARC response records. Records lie in archives of ``SLOTS`` slots by id, in offset order;
a leaf is the hash of a slot's records, and every node above hashes the ordered run of ``FANOUT``
children, which is an offset range of the archive. Two replicas are compared root by root; only the
children of nodes that differ are compared next, down to the slots that are damaged.

Edge cases: null url or html count as empty; a null page_id is placed by a hash of its record, in
archives of its own (negative numbers); repeated rows share a slot and must occur as often in the
other replica: copies that it lacks are "missing", copies that it has beyond them "extra"; records that only one
replica has are "missing" or "extra"; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import discard, save

FANOUT, LEVELS = 16, 2
SLOTS = FANOUT ** (LEVELS + 1) // 4
#: So many different records of a slot are hashed as one list; more are dealt by so many hexadecimal digits first.
MOST_IN_LIST, DEALT_DIGITS = 4096, (6, 3)


def record(url: Column, html: Column) -> Column:
    """A WARC response record as text."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    size = F.octet_length(html).cast("string")
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), size, F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))


def records(pages: DataFrame, page_id: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, archive, slot, n_bytes, leaf (sha256 of the record)."""
    made = pages.select(F.col(page_id).cast("long").alias("page_id"), record(F.col(url_col), F.col(html_col)).alias("body"))
    hashed = made.select("page_id", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("leaf"))
    place = F.coalesce("page_id", F.pmod(F.xxhash64("leaf"), F.lit(1 << 30)))
    archive = F.when(F.col("page_id").isNull(), -1 - F.floor(place / SLOTS)).otherwise(F.floor(place / SLOTS))
    return hashed.select("page_id", archive.cast("long").alias("archive"), F.pmod(place, F.lit(SLOTS)).cast("long").alias("slot"), "n_bytes", "leaf")


def _join_hashes(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, digest: hash of the ordered values below each key (at most FANOUT, or MOST_IN_LIST of a slot's records)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    listed = F.transform(ordered, lambda x: F.concat(x["o"].cast("string"), F.lit(":"), x["v"]))
    return rows.groupBy(*keys).agg(F.sha2(F.concat_ws(",", listed), 256).alias("digest"))


def _slots(counted: DataFrame) -> DataFrame:
    """archive, node, digest of each slot. The records of a slot with more than ``MOST_IN_LIST`` different ones are
    dealt by the first digits of their hashes, and hashed from the finest deal up, so no list grows with a slot."""
    slot = ["archive", "node"]
    large = save(counted.groupBy(*slot).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_IN_LIST).select(*slot))
    if large.isEmpty():
        discard(large)
        return _join_hashes(counted, slot, "leaf", "times")
    small = _join_hashes(counted.join(large, slot, "left_anti"), slot, "leaf", "times")
    dealt = counted.join(large, slot, "left_semi").withColumn("part", F.substring("leaf", 1, DEALT_DIGITS[0]))
    dealt = _join_hashes(dealt, [*slot, "part"], "leaf", "times")
    for digits in DEALT_DIGITS[1:]:
        finer = dealt.withColumnRenamed("part", "finer").withColumn("part", F.substring("finer", 1, digits))
        dealt = _join_hashes(finer, [*slot, "part"], "finer", "digest")
    return small.unionByName(_join_hashes(dealt, slot, "part", "digest"))


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels of the trees from slots (0) to roots, each archive, node, digest. Equal records of a slot are
    counted before they are gathered."""
    counted = leaves.groupBy("archive", F.col("slot").alias("node"), "leaf").agg(F.count(F.lit(1)).alias("times"))
    counted = save(counted.withColumn("times", F.col("times").cast("string")))
    levels = [save(_slots(counted))]
    discard(counted)
    for _ in range(LEVELS):
        below = levels[-1].select("archive", F.floor(F.col("node") / FANOUT).alias("up"), "node", "digest")
        levels.append(save(_join_hashes(below, ["archive", "up"], "node", "digest").withColumnRenamed("up", "node")))
    below = levels[-1].select("archive", F.lit(0).cast("long").alias("up"), "node", "digest")
    levels.append(save(_join_hashes(below, ["archive", "up"], "node", "digest").withColumnRenamed("up", "node")))
    return levels


def damaged_slots(primary: list[DataFrame], replica: list[DataFrame]) -> DataFrame:
    """(archive, slot) of slots that differ, found by descending from differing roots only."""
    suspects: DataFrame | None = None
    for level in range(len(primary) - 1, -1, -1):
        one = primary[level].withColumnRenamed("digest", "one")
        two = replica[level].withColumnRenamed("digest", "two")
        if suspects is not None:
            width = 1 << 62 if level == len(primary) - 2 else FANOUT
            parent = F.floor(F.col("node") / F.lit(width)).cast("long")
            one = one.withColumn("up", parent).join(suspects, ["archive", "up"], "left_semi").drop("up")
            two = two.withColumn("up", parent).join(suspects, ["archive", "up"], "left_semi").drop("up")
        differ = one.join(two, ["archive", "node"], "full_outer").filter(~F.col("one").eqNullSafe(F.col("two"))).select("archive", "node")
        suspects = save(differ.withColumnRenamed("node", "up"))
    return suspects.select("archive", F.col("up").alias("slot"))


def audit(primary: DataFrame, replica: DataFrame, **columns: str) -> DataFrame:
    """One row per record: page_id, archive, slot, byte_offset (in its own replica), n_bytes, leaf_sha256, status.

    status: ok, changed (the slot holds a record in its place that the primary lacks), missing (not, or not as
    often, in the replica) or extra (in the replica alone and in no record's place, or one copy more there than in
    the primary; its row is the replica's).
    """
    one, two = save(records(primary, **columns)), save(records(replica, **columns))
    damaged = damaged_slots(tree(one), tree(two)).withColumn("bad", F.lit(True))
    slot = ["archive", "slot"]
    left, right = one.join(damaged, slot, "left"), two.join(damaged, slot, "left_semi")
    # How often each record of a damaged slot occurs in either replica.
    count = lambda rows, name: rows.groupBy(*slot, "leaf").agg(F.count(F.lit(1)).alias(name))
    both = count(left.filter("bad"), "n1").join(count(right, "n2"), [*slot, "leaf"], "full_outer").na.fill(0, ["n1", "n2"])
    # Records that only the replica holds stand for records that it lost, one for one.
    new = F.when(F.col("n1") == 0, F.col("n2")).otherwise(0)
    lost = F.greatest(F.col("n1") - F.col("n2"), F.lit(0))
    before = Window.partitionBy(*slot).orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(*slot)
    both = both.select(*slot, "leaf", "n1", "n2", F.coalesce(F.sum(lost).over(before), F.lit(0)).alias("lost_before"), F.coalesce(F.sum(new).over(before), F.lit(0)).alias("new_before"), F.sum(lost).over(total).alias("lost"), F.sum(new).over(total).alias("new"))
    both = save(both)
    copy = F.row_number().over(Window.partitionBy(*slot, "leaf").orderBy("page_id"))
    bad = left.filter("bad").join(both, [*slot, "leaf"]).withColumn("copy", copy)
    place = F.col("lost_before") + F.col("copy") - F.col("n2")
    status = F.when(F.col("copy") <= F.col("n2"), "ok").when(place <= F.col("new"), "changed").otherwise("missing")
    sound = left.filter("bad IS NULL").withColumn("status", F.lit("ok"))
    columns_in = ["page_id", "archive", "slot", "n_bytes", "leaf", "status"]
    flagged = sound.select(*columns_in).unionByName(bad.withColumn("status", status).select(*columns_in))
    order = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    offset = F.expr(f"coalesce(sum(n_bytes) OVER (PARTITION BY archive ORDER BY slot, leaf, page_id {order}), 0)").alias("byte_offset")
    columns_out = ["page_id", "archive", "slot", "byte_offset", "n_bytes", F.col("leaf").alias("leaf_sha256"), "status"]
    rows = flagged.select("*", offset).select(*columns_out)
    # Where the extra records lie in the replica, among all records of their archives there.
    surplus = both.filter("n2 > n1")
    lying = two.join(surplus.select("archive").distinct(), "archive", "left_semi").select("*", offset)
    lying = lying.join(surplus, [*slot, "leaf"]).withColumn("copy", F.row_number().over(Window.partitionBy(*slot, "leaf").orderBy("page_id", "byte_offset")))
    beyond = F.when(F.col("n1") > 0, F.col("copy") > F.col("n1")).otherwise(F.col("new_before") + F.col("copy") > F.col("lost"))
    extra = lying.filter(beyond).withColumn("status", F.lit("extra"))
    return rows.unionByName(extra.select(*columns_out))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files (plain or gzipped): file, byte_offset, url, html.

    A file is read by one task, as the format has no index; offsets are those of the unpacked file.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(parse_warc(content))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["file", "byte_offset", "url", "html"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, "file string, byte_offset long, url string, html string")


def parse_warc(content: bytes) -> Iterator[tuple[int, str, str]]:
    """(offset, target url, body) of each response record; a broken tail ends the file."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    stream = io.BytesIO(data)
    while True:
        at = stream.tell()
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline().strip()):
            key, _, value = line.partition(b":")
            fields[key.strip().lower()] = value.strip()
        size = int(fields.get(b"content-length", b"0"))
        body = stream.read(size)
        if len(body) == size and fields.get(b"warc-type") == b"response":
            yield at, fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), body.decode("utf-8", "replace")
