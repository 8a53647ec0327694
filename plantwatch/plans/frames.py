"""The frames that registered queries start from, and the same frames in SQL.

The driver's tables hold no sensor data, so ``events`` stands in for a history:
equipment is user_id modulo 4, a tag is an event type. Hourly means make the
wide frame, its first 60 % of hours train, robust z by tag make the scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plantwatch.functions.scalar import seconds_between, trunc
from plantwatch.operators import scoring
from plantwatch.operators.islands import islands

TAGS = ("click", "error", "purchase", "signup", "view")
WEIGHTS = {f"{t}_z": 1.0 for t in TAGS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 4).cast("int").alias("equip_id"), F.col("event_type").alias("tag"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq"), "value")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).groupBy("equip_id", "tag", trunc("HOUR", "ts").alias("ts")).agg(F.avg("value").alias("value"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """equip_id, ts, split and a column for each tag, null where an hour has no sample of it."""
    w = hourly(spark, sf_dir).groupBy("equip_id", "ts").pivot("tag", list(TAGS)).agg(F.first("value"))
    i, n = F.row_number().over(W.partitionBy("equip_id").orderBy("ts")), F.count("*").over(W.partitionBy("equip_id"))
    return w.withColumn("split", F.when(i <= F.floor(n * 0.6), "train").otherwise("score"))


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).unpivot(["equip_id", "ts", "split"], list(TAGS), "tag", "value").where("value is not null")


def z_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long(spark, sf_dir).withColumnsRenamed({"tag": "detector", "value": "score"})
    params = scoring.calibrate(rows.where("split = 'train'"))
    return scoring.apply_calibration(rows, params)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A z for each tag, fused, and a regime by the size of the first z."""
    z = z_long(spark, sf_dir).groupBy("equip_id", "ts").pivot("detector", list(TAGS)).agg(F.first("z"))
    z = z.select("equip_id", "ts", *[F.coalesce(t, F.lit(0.0)).alias(f"{t}_z") for t in TAGS])
    label = F.when(F.col("click_z") < 0, 0).when(F.col("click_z") < 1, 1).otherwise(2)
    return scoring.fuse(z, WEIGHTS).withColumn("regime_label", label.cast("int")).withColumn("regime_state", F.concat(F.lit("state"), F.col("regime_label").cast("string")))


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plantwatch.operators.cleaning import context_z

    return context_z(long(spark, sf_dir))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of two hours or more with a fused score over one half, as episodes."""
    runs = islands(scores(spark, sf_dir).withColumn("hot", F.col("fused") > 0.5), "hot").where("hot and n_rows >= 2")
    severity = F.when(F.col("n_rows") >= 4, "CRITICAL").when(F.col("n_rows") == 3, "HIGH").otherwise("MEDIUM")
    culprits = F.when(F.col("n_rows") % 2 == 0, "click(s1), view").otherwise("purchase")
    number = F.row_number().over(W.partitionBy("equip_id").orderBy("start_ts")).cast("long")
    return runs.select("equip_id", number.alias("episode_id"), "start_ts", "end_ts", seconds_between("start_ts", "end_ts").alias("duration_s"), F.col("n_rows").alias("len"), culprits.alias("culprits"), severity.alias("severity"))


def _each(pattern: str, sep: str = ", ") -> str:
    return sep.join(pattern.format(t=t) for t in TAGS)


#: The same frames for DuckDB.
SQL = f"""WITH hist AS (SELECT CAST(user_id % 4 AS INTEGER) AS equip_id, event_type AS tag, ts, event_id AS seq, value FROM events),
hourly AS (SELECT equip_id, tag, date_trunc('hour', ts) AS ts, avg(value) AS value FROM hist GROUP BY 1, 2, 3),
hours AS (SELECT equip_id, ts, row_number() OVER (PARTITION BY equip_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY equip_id) AS n FROM (SELECT DISTINCT equip_id, ts FROM hourly)),
split AS (SELECT equip_id, ts, CASE WHEN i <= floor(n * 0.6) THEN 'train' ELSE 'score' END AS split FROM hours),
long AS (SELECT h.equip_id, h.ts, s.split, h.tag, h.value FROM hourly h JOIN split s USING (equip_id, ts)),
wide AS (SELECT equip_id, ts, {_each("max(value) FILTER (tag = '{t}') AS {t}")}, split FROM long GROUP BY equip_id, ts, split),
cal1 AS (SELECT equip_id, tag, quantile_cont(value, 0.5) AS median, stddev_pop(value) AS sd, quantile_cont(value, 0.98) AS q_raw, count(*) AS n FROM long WHERE split = 'train' GROUP BY 1, 2),
cal2 AS (SELECT l.equip_id, l.tag, quantile_cont(abs(l.value - c.median), 0.5) AS mad FROM long l JOIN cal1 c USING (equip_id, tag) WHERE l.split = 'train' GROUP BY 1, 2),
calib AS (SELECT c.*, CASE WHEN m.mad * 1.4826 >= 1e-3 THEN m.mad * 1.4826 WHEN c.sd > 1e-3 THEN c.sd ELSE 1.0 END AS scale FROM cal1 c JOIN cal2 m USING (equip_id, tag)),
zlong AS (SELECT l.equip_id, l.ts, l.split, l.tag AS detector, l.value AS score, greatest(-8.0, least(8.0, (l.value - c.median) / greatest(c.scale, 1e-9))) AS z FROM long l JOIN calib c USING (equip_id, tag)),
zwide AS (SELECT equip_id, ts, {_each("coalesce(max(z) FILTER (detector = '{t}'), 0.0) AS {t}_z")} FROM zlong GROUP BY 1, 2),
zstat AS (SELECT equip_id, {_each("avg({t}_z) AS {t}_m, stddev_pop({t}_z) AS {t}_s")} FROM zwide GROUP BY 1),
scores AS (SELECT z.*, {_each("0.2 * ((z.{t}_z - s.{t}_m) / CASE WHEN s.{t}_s > 1e-9 THEN s.{t}_s ELSE 1.0 END)", " + ")} AS fused,
  CAST(CASE WHEN click_z < 0 THEN 0 WHEN click_z < 1 THEN 1 ELSE 2 END AS INTEGER) AS regime_label, 'state' || CASE WHEN click_z < 0 THEN 0 WHEN click_z < 1 THEN 1 ELSE 2 END AS regime_state FROM zwide z JOIN zstat s USING (equip_id)),
health AS (SELECT *, 100.0 / (1.0 + fused * fused) AS h, CASE WHEN 100.0 / (1.0 + fused * fused) <= 70 THEN 'ALERT' WHEN 100.0 / (1.0 + fused * fused) <= 85 THEN 'WATCH' ELSE 'GOOD' END AS zone FROM scores),
melted AS (SELECT equip_id, ts, replace(detector, '_z', '') AS detector, z FROM (UNPIVOT (SELECT equip_id, ts, {_each("{t}_z")} FROM scores) ON {_each("{t}_z")} INTO NAME detector VALUE z)),
tstat AS (SELECT equip_id, tag, avg(value) AS train_mean, stddev_samp(value) AS train_std FROM long WHERE split = 'train' GROUP BY 1, 2 HAVING stddev_samp(value) > 0),
context AS (SELECT l.equip_id, l.tag, l.ts, l.value, t.train_mean, t.train_std, (l.value - t.train_mean) / t.train_std AS z FROM long l JOIN tstat t USING (equip_id, tag) WHERE l.split = 'score'),
rruns AS (SELECT equip_id, regime_label, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows, run FROM (SELECT *, sum(CASE WHEN regime_label IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY equip_id ORDER BY ts) AS run FROM (SELECT *, lag(regime_label) OVER (PARTITION BY equip_id ORDER BY ts) AS p FROM scores)) GROUP BY equip_id, regime_label, run),
hot AS (SELECT equip_id, run, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows FROM (SELECT *, sum(CASE WHEN fused > 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY equip_id ORDER BY ts) AS run FROM scores) WHERE fused > 0.5 GROUP BY equip_id, run HAVING count(*) >= 2),
eps AS (SELECT equip_id, row_number() OVER (PARTITION BY equip_id ORDER BY start_ts) AS episode_id, start_ts, end_ts, CAST(epoch(end_ts - start_ts) AS DOUBLE) AS duration_s, n_rows AS len, CASE WHEN n_rows % 2 = 0 THEN 'click(s1), view' ELSE 'purchase' END AS culprits, CASE WHEN n_rows >= 4 THEN 'CRITICAL' WHEN n_rows = 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM hot)
"""
