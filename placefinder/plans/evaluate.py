"""Accuracy of results against known places, and the gate that compares two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G

# How confident a wrong answer to a hopeless query may be, and the gate's tolerances.
MISS_CONFIDENCE, OVERALL, WRONG_CONFIDENCE, GROUP_SHARE, GROUP_LEAST, LEVEL = 0.8, 0.005, 0.05, 0.02, 2, 0.02


def score(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """One row for each case (id, endpoint, qtype, kind, truth_lat, truth_lon, radius_m, truth_number; null truth: a
    miss) from ``hits`` (id, rank, lat, lon, confidence, housenumber): hit1, hit5, dist1_m, top_conf, correct."""
    joined = hits.join(cases.select("id", "truth_lat", "truth_lon", "radius_m", "truth_number"), "id")
    far = G.haversine_m(F.col("truth_lon"), F.col("truth_lat"), F.col("lon"), F.col("lat"))
    number = F.col("truth_number").isNull() | (F.lower(F.coalesce("housenumber", F.lit(""))) == F.lower("truth_number"))
    ok = (F.col("d") <= F.col("radius_m")) & number
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    found = joined.withColumn("d", far).withColumn("ok", ok).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_results"), first("confidence").alias("top_conf"), first("d").alias("dist1_m"), first("ok").alias("hit1"), F.max(F.when(F.col("rank") <= 5, F.col("ok"))).alias("hit5")
    )
    rows = cases.join(found, "id", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    miss = F.col("truth_lat").isNull()
    hit = lambda c: F.when(~miss, F.coalesce(c, F.lit(False)))
    right = F.when(miss, F.col("top_conf").isNull() | (F.col("top_conf") < MISS_CONFIDENCE)).otherwise(F.coalesce("hit1", F.lit(False)))
    return rows.select("id", "endpoint", "qtype", "kind", "n_results", "top_conf", hit("hit1").alias("hit1"), hit("hit5").alias("hit5"), F.when(~miss, F.col("dist1_m")).alias("dist1_m"), right.alias("correct"))


def summary(scored: DataFrame) -> DataFrame:
    """Metrics of all cases and of each endpoint, endpoint and qtype, kind and qtype. The median is the upper middle."""
    keys = F.array(F.lit("ALL"), F.col("endpoint"), F.concat_ws("/", "endpoint", "qtype"), F.concat(F.lit("kind:"), "kind"), F.concat(F.lit("qtype:"), "qtype"))
    rows = scored.withColumn("grp", F.explode(keys))
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 3)
    # The upper middle of n values is the one at place floor(n / 2). Counts by kilometre (some 20,000 in a group at most)
    # name the kilometre that holds it; only that one's distinct distances are ranked.
    from pyspark.sql import Window

    far = rows.filter("dist1_m IS NOT NULL").withColumn("km", F.floor(F.col("dist1_m") / 1000)).groupBy("grp", "km", "dist1_m").agg(F.count(F.lit(1)).alias("n"))
    by_km = far.groupBy("grp", "km").agg(F.sum("n").alias("n"))
    group, upto = Window.partitionBy("grp"), Window.partitionBy("grp").orderBy("km").rowsBetween(Window.unboundedPreceding, -1)
    by_km = by_km.select("grp", "km", F.floor(F.sum("n").over(group) / 2).alias("at"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), "n")
    holder = by_km.filter((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("n"))).select("grp", "km", "at", "before")
    inner = Window.partitionBy("grp").orderBy("dist1_m").rowsBetween(Window.unboundedPreceding, 0)
    ranked = far.join(holder, ["grp", "km"]).withColumn("upto", F.col("before") + F.sum("n").over(inner))
    middle = ranked.filter(F.col("upto") > F.col("at")).groupBy("grp").agg(F.round(F.min("dist1_m"), 1).alias("median_dist_m"))
    out = rows.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), share("correct").alias("correct"), F.sum(F.col("correct").cast("long")).alias("n_correct"), share("hit1").alias("hit1"), share("hit5").alias("hit5"),
        F.round(F.avg((F.col("n_results") == 0).cast("double")), 3).alias("no_result"),
        F.round(F.avg(F.when(F.col("correct"), F.col("top_conf"))), 3).alias("conf_when_right"), F.round(F.avg(F.when(~F.col("correct"), F.col("top_conf"))), 3).alias("conf_when_wrong"),
    )
    return out.join(middle, "grp", "left")


def gate(base: DataFrame, current: DataFrame) -> DataFrame:
    """Groups of ``current`` (grp, n, n_correct, correct, conf_when_wrong) that fell behind ``base``: grp, reason."""
    both = base.alias("b").join(current.alias("c"), "grp", "left")
    c = lambda name: F.coalesce(F.col(f"c.{name}"), F.lit(0))
    allowed = F.greatest(F.lit(GROUP_LEAST), F.round(GROUP_SHARE * F.col("b.n")))
    whole = F.col("grp") == "ALL"
    level = F.col("grp").startswith("level:")
    reason = (
        F.when(whole & (c("correct") < F.col("b.correct") - OVERALL), "overall")
        .when(whole & (F.col("c.conf_when_wrong") > F.col("b.conf_when_wrong") + WRONG_CONFIDENCE), "confidence when wrong")
        .when(level & (F.col("c.correct") < F.col("b.correct") - LEVEL), "level")
        .when(~whole & ~level & (c("n_correct") < F.col("b.n_correct") - allowed), "group")
    )
    return both.select("grp", reason.alias("reason")).filter("reason IS NOT NULL")
