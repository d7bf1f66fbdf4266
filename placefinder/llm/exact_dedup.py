"""Operator 6: exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text, stripped of white space, is cut where its own content says so, and each chunk is named by a
64-bit hash. Chunks are deduplicated and the names verified byte for byte: a hash shared by two
different chunks is reported, and those chunks then carry their content beside the name, so a name
always stands for one content. Documents are grouped by their ordered lists of names; a long text is
never moved to be compared, only its short list is.

Edge cases: a null text counts as empty, and all empty texts are equal (one empty recipe); a null
doc_id takes part but loses every tie, and a row with a null id is kept only if its group has no
other; repeated rows (same id, same text) are members like others and share the fate of their id; an
empty table gives an empty result; other columns are ignored.

:func:`without_exact_duplicates` decides row by row, so one id may stand for different texts: of each group one
row stays, of rows that tie the one with the least hash of all columns, of rows alike in every column any; ids may
be of any type there, and rows with a null id stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import discard, save
from .shared import row_hash, without_rows

#: White space that does not count, fixed by the definition of equal texts.
BLANKS = " \t\n\x0b\x0c\r"
#: A cut comes after one of these pairs of letters, at the least after MIN_CHUNK characters and at the
#: most after MAX_CHUNK: whether a place is a cut depends on the text near it alone.
CUT = "[aeiouáéèíóúäöü][nrstl]|[.,;:!?][A-ZÀ-Þ]"
MIN_CHUNK, MAX_CHUNK = 512, 4096
#: More colliding names than this mean a broken hash (64 bits give some 300 among 10^11 chunks): an error, nothing is
#: left out.
MOST_COLLISIONS = 10_000


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def chunks(norm: Column) -> Column:
    """The text's content-defined chunks, in order; together they are the whole text."""
    pattern = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 2}}}?(?:{CUT})|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def collisions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Names (``name``) that two different chunks of ``docs`` share: every distinct chunk is compared in full."""
    pieces = docs.select(F.explode(chunks(normalised(F.col(text_col)))).alias("piece"))
    distinct = pieces.select(F.xxhash64("piece").alias("name"), "piece").groupBy("name", "piece").agg(F.lit(1).alias("one"))
    return distinct.groupBy("name").count().filter("count > 1").select("name")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, code_points, text_sha256, and the recipe: ``names`` and, for colliding names only, ``contents``."""
    return _cut(docs, F.col(id_col).cast("long"), text_col).drop("row")


def _cut(docs: DataFrame, doc_id: Column, text_col: str) -> DataFrame:
    """As :func:`recipes`, with ``row``, a hash of the whole row."""
    shared = [row.name for row in collisions(docs, text_col).limit(MOST_COLLISIONS + 1).collect()]
    if len(shared) > MOST_COLLISIONS:
        raise RuntimeError(f"over {MOST_COLLISIONS} chunk names stand for several chunks: the hash of chunks is broken")
    cut = docs.select(
        doc_id.alias("doc_id"),
        row_hash(docs).alias("row"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("code_points"),
        normalised(F.col(text_col)).alias("norm"),
    ).select("doc_id", "row", "code_points", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm")).alias("pieces"))
    contents = F.array().cast("array<string>")
    if shared:
        ids = F.array(*[F.lit(x) for x in shared])
        contents = F.filter("pieces", lambda piece: F.array_contains(ids, F.xxhash64(piece)))
    return cut.select("doc_id", "row", "code_points", "text_sha256", F.transform("pieces", lambda piece: F.xxhash64(piece)).alias("names"), contents.alias("contents"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The member with the most code points, then the smallest id, stays. Groups are found by partial
    aggregation, so a group of any size is summed on the map side; the join back has one row per
    group on one side, and adaptive execution splits the other where a group is hot.
    """
    rows = save(recipes(docs, id_col, text_col))
    best = F.max(F.struct("code_points", (-F.col("doc_id")).alias("neg_id")))
    groups = rows.groupBy("names", "contents").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    # Saved, so that the join deals both sides anew and can split the rows of a hot group.
    groups = save(groups.select("names", "contents", (-F.col("best.neg_id")).alias("keep_id"), "group_size"))
    return rows.join(groups, ["names", "contents"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group of equal texts."""
    rows = save(_cut(docs, F.col(id_col), text_col).select("doc_id", "row", "code_points", "names", "contents"))
    order = F.struct((-F.col("code_points")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = save(rows.groupBy("names", "contents").agg(F.min(order).alias("best")))
    placed = rows.join(groups, ["names", "contents"])
    won = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row") == F.col("best.row"))
    decided = save(placed.select("doc_id", "row", won.alias("won")))
    out = without_rows(docs, decided.filter(~F.col("won")).select("doc_id", "row"), id_col)
    again = save(decided.filter("won AND doc_id IS NOT NULL").groupBy("doc_id", "row").count().filter("count > 1").select("doc_id", "row"))
    discard(rows, groups, decided)
    if again.isEmpty():
        discard(again)
        return out
    alike = out.join(again, (out[id_col] == again["doc_id"]) & (row_hash(out) == again["row"]), "left_semi")
    held = "_row" + max(docs.columns, key=len)  # a name that no column has
    return without_rows(out, again, id_col).unionByName(alike.withColumn(held, row_hash(alike)).dropDuplicates([id_col, held]).drop(held))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
