"""Batches, sinks, master data, cold starts and array functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plantwatch.operators import batch, history, regimes, rolling, runs, tables
from plantwatch.plans import frames as f
from plantwatch.plans.catalog import query
from plantwatch.session import kept
from plantwatch.sources import sinks

E = "equip_id"
COLS = list(f.TAGS)


@query("s31_run_stats", """SELECT s.equip_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, avg(fused) AS mean_fused, max(fused) AS max_fused, any_value(coalesce(n_episodes, 0)) AS n_episodes, any_value(coalesce(episode_s, 0.0)) AS episode_s
  FROM scores s LEFT JOIN (SELECT equip_id, count(*) AS n_episodes, sum(duration_s) AS episode_s FROM eps GROUP BY 1) e USING (equip_id) GROUP BY 1""", "mean_fused max_fused episode_s")  # fmt: skip
def _(s, d):
    return runs.run_stats(f.scores(s, d), f.spans(s, d))


@query("s32_score_rows", "SELECT equip_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(printf('%.5e', fused) AS DOUBLE) AS fused, CAST(printf('%.5e', click_z) AS DOUBLE) AS click_z FROM scores", "fused click_z")
def _(s, d):
    return sinks.as_text(f.scores(s, d).select(E, "ts", "fused", "click_z"))


@query("s33_episode_rows", "SELECT equip_id, episode_id, start_ts, end_ts, duration_s / 3600 AS duration_hours, lower(severity) AS severity, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS severity_rank, culprits FROM eps", "duration_hours")
def _(s, d):
    return sinks.episode_rows(f.spans(s, d))


@query("s34_json_lines", "SELECT equip_id, episode_id, len, severity, culprits FROM eps")
def _(s, d):
    rows = f.spans(s, d).select(E, "episode_id", "len", "severity", "culprits")
    return sinks.json_lines(rows).select(F.from_json("value", rows.schema).alias("x")).select("x.*")


@query("s36_artifact_cache", "SELECT equip_id, count(*) AS n FROM eps GROUP BY 1")
def _(s, d):
    kept = sinks.Artifacts()
    kept.put("episodes", f.spans(s, d))
    return kept.get("episodes").groupBy(E).agg(F.count("*").alias("n"))


@query("s38_buffer_cleanup", "SELECT equip_id, tag, ts, seq FROM (SELECT *, row_number() OVER (PARTITION BY equip_id, tag ORDER BY ts DESC) AS k FROM (SELECT h.*, max(ts) OVER (PARTITION BY equip_id, tag) AS t1 FROM hist h) WHERE ts >= t1 - INTERVAL 24 HOUR) WHERE k <= 20")
def _(s, d):
    return history.tail_buffer(f.history(s, d), 24, 20, [E, "tag"]).select(E, "tag", "ts", "seq")


def _equipment(s, d):
    """Suppliers stand in for equipment, their nations for its types."""
    nation = f.table(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("type"))
    rows = f.table(s, d, "supplier").join(nation, "s_nationkey")
    return rows.select(F.col("s_suppkey").cast("int").alias(E), F.col("s_name").alias("code"), "type", (F.col("s_acctbal") > 0).alias("is_active"))


_EQUIP = "(SELECT CAST(s_suppkey AS INTEGER) AS equip_id, s_name AS code, n_name AS type, s_acctbal > 0 AS is_active FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_TAGMAP = "(SELECT CAST(l_suppkey AS INTEGER) AS equip_id, 'tag' || l_linenumber AS tag, max(l_quantity) > 45 AS is_active FROM lineitem GROUP BY 1, 2)"


def _tag_map(s, d):
    rows = f.table(s, d, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias(E), F.concat(F.lit("tag"), F.col("l_linenumber").cast("string")).alias("tag"))
    return rows.agg((F.max("l_quantity") > 45).alias("is_active"))


@query("s43_equipment_types", f"SELECT type, count(*) AS instances FROM {_EQUIP} GROUP BY 1", base=False)
def _(s, d):
    return runs.equipment_types(_equipment(s, d))


@query("s43_equipment_instances", f"SELECT equip_id, code, type, is_active FROM {_EQUIP} WHERE type = (SELECT min(n_name) FROM nation JOIN supplier ON s_nationkey = n_nationkey) AND is_active", base=False)
def _(s, d):
    rows = _equipment(s, d)
    first = rows.agg(F.min("type")).first()[0]
    return runs.equipment_of(rows, first)


@query("s43_tag_mappings", f"SELECT e.equip_id, code, tag FROM {_EQUIP} e LEFT JOIN (SELECT * FROM {_TAGMAP} WHERE is_active) t USING (equip_id)", base=False)
def _(s, d):
    return runs.tag_mappings(_equipment(s, d).drop("is_active"), _tag_map(s, d)).select(E, "code", "tag")


@query("s43_sync", f"SELECT CASE WHEN known THEN equip_id ELSE top + row_number() OVER (PARTITION BY known ORDER BY code) END AS equip_id, code, coalesce(seen, FALSE) AS is_active FROM (SELECT equip_id, code, equip_id <= 5 AS known, equip_id > 3 AS seen, 5 AS top FROM {_EQUIP} WHERE equip_id <= 8)", base=False)
def _(s, d):
    rows = _equipment(s, d).select(E, "code")
    return runs.sync_equipment(rows.where("equip_id <= 5").withColumn("is_active", F.lit(True)), rows.where("equip_id > 3 and equip_id <= 8").select("code")).select(F.col(E).cast("long").alias(E), "code", "is_active")


@query("s47_run_metadata", """SELECT equip_id, train_rows, score_rows, coalesce(n, 0) AS n_episodes, CASE WHEN m >= 3 THEN 'CRITICAL' WHEN coalesce(n, 0) > 0 THEN 'WARNING' ELSE 'HEALTHY' END AS health_status, '1f6cbdd4e0c2b2f0' AS config_signature FROM (SELECT equip_id, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'score') AS score_rows FROM split GROUP BY 1)
  LEFT JOIN (SELECT equip_id, count(*) AS n FROM eps GROUP BY 1) USING (equip_id) JOIN (SELECT equip_id, avg(fused) AS m FROM scores GROUP BY 1) USING (equip_id)""")  # fmt: skip
def _(s, d):
    return runs.run_metadata(f.wide(s, d), runs.run_stats(f.scores(s, d), f.spans(s, d)), "1f6cbdd4e0c2b2f0")


@query("s48_tag_view", f"SELECT equip_id, code, type, tag FROM {_EQUIP} JOIN {_TAGMAP} t USING (equip_id)", base=False)
def _(s, d):
    return _equipment(s, d).drop("is_active").join(_tag_map(s, d), E).select(E, "code", "type", "tag")


@query("t02_resume", "SELECT equip_id, w AS window_start FROM (SELECT DISTINCT equip_id, time_bucket(INTERVAL 1 DAY, ts) AS w FROM hist) JOIN (SELECT equip_id, min(ts) AS t0 FROM hist GROUP BY 1) USING (equip_id) WHERE equip_id = 3 OR w >= date_trunc('day', t0) + INTERVAL 10 DAY")
def _(s, d):
    rows = f.history(s, d)
    windows = rows.select(E, F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("window_start")).distinct()
    done = rows.where("equip_id <> 3").groupBy(E).agg((F.date_trunc("DAY", F.min("ts")).cast("timestamp_ntz") + F.expr("INTERVAL 10 DAYS")).alias("last_end"))
    return runs.unfinished(windows, done)


@query("t03_chunk_plan", "SELECT equip_id, chunk, n, CASE WHEN n = 1 THEN 'bootstrap' ELSE 'replay' END AS step FROM (SELECT *, row_number() OVER (PARTITION BY equip_id ORDER BY chunk) AS n FROM (SELECT DISTINCT equip_id, strftime(ts, 'chunk_%Y%m%d') AS chunk FROM hist)) WHERE NOT (equip_id = 0 AND n <= 3)")
def _(s, d):
    chunks = f.history(s, d).select(E, F.date_format("ts", "'chunk_'yyyyMMdd").alias("chunk")).distinct()
    done = chunks.where("equip_id = 0").orderBy("chunk").limit(3)
    return runs.chunk_plan(chunks, done)


@query("t04_accumulate", """SELECT equip_id, k + 1 AS attempts, CASE k WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END AS n_rows, t0 AS window_start, t0 + INTERVAL 1 MINUTE * (1440 * CAST(2 ^ k AS INTEGER)) AS window_end, CASE WHEN CASE k WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END >= 150 THEN 'COMPLETE' ELSE 'FAILED' END AS status
  FROM (SELECT *, CASE WHEN n0 >= 150 THEN 0 WHEN n1 >= 150 THEN 1 ELSE 2 END AS k FROM (SELECT equip_id, t0, count(*) FILTER (ts < t0 + INTERVAL 1 DAY) AS n0, count(*) FILTER (ts < t0 + INTERVAL 2 DAY) AS n1, count(*) FILTER (ts < t0 + INTERVAL 4 DAY) AS n2 FROM hist JOIN (SELECT equip_id, min(ts) AS t0 FROM hist GROUP BY 1) USING (equip_id) GROUP BY 1, 2))""")  # fmt: skip
def _(s, d):
    return runs.accumulate(f.history(s, d), 1440, 150)


@query("a26_regime_quality", """SELECT equip_id, silhouette, silhouette >= 0.15 AS regime_quality_ok FROM (SELECT equip_id, avg((greatest(a, b) - least(a, b)) / greatest(greatest(a, b), 1e-12)) AS silhouette FROM (SELECT equip_id, sqrt(click_z ^ 2 + view_z ^ 2) AS a, sqrt((click_z - 3) ^ 2 + (view_z - 3) ^ 2) AS b FROM scores) GROUP BY 1)""", "silhouette")
def _(s, d):
    return regimes.quality_gate(regimes.silhouette(f.scores(s, d), ["click_z", "view_z"], np.array([[0.0, 0.0], [3.0, 3.0]])))


@query("f14_auto_k")
def _(s, d):
    return regimes.fit_auto_k(f.scores(s, d).select(E, "ts", *[f"{t}_z" for t in COLS]), [f"{t}_z" for t in COLS], 2, 3)[1].select(E, "ts", "regime_label")


@query("w28_culprit_basics", "SELECT equip_id, episode_id, start_ts, end_ts, duration_s / 3600 AS duration_hours, culprits FROM eps", "duration_hours")
def _(s, d):
    return tables.culprit_basics(f.spans(s, d))


def _bands(rows: str) -> str:
    """Energies by band of a list ``l``, from the definition of the discrete Fourier transform."""
    power = "list_sum(list_transform(range(0, n), lambda t: (l[t + 1] - m) * cos(2 * pi() * k * t / n))) ^ 2 + list_sum(list_transform(range(0, n), lambda t: (l[t + 1] - m) * sin(2 * pi() * k * t / n))) ^ 2"
    band = lambda low, high: f"CASE WHEN n >= 4 THEN coalesce(list_sum(list_transform(list_filter(range(0, n // 2 + 1), lambda k: 2.0 * k / n >= {low} AND 2.0 * k / n < {high}), lambda k: {power})), 0.0) ELSE 0.0 END"
    names = ", ".join(f"{band(low, high)} AS energy_{i}" for i, (low, high) in enumerate(rolling.BANDS))
    return f"SELECT equip_id, ts, {names} FROM (SELECT equip_id, ts, l, len(l) AS n, list_avg(l) AS m FROM ({rows}))"


_LAST8 = "SELECT equip_id, ts, list(coalesce(click, 0.0)) OVER (PARTITION BY equip_id ORDER BY ts ROWS 7 PRECEDING) AS l FROM wide"
_ENERGIES = "energy_0 energy_1 energy_2"


def _last8(s, d):
    return f.wide(s, d).fillna(0.0, COLS).withColumn("l", F.collect_list("click").over(rolling.frame(8)))


@query("w07_spectral_filled", _bands(_LAST8), _ENERGIES)
def _(s, d):
    rows = f.wide(s, d).fillna(0.0, COLS)
    return rows.select(E, "ts", *[e.alias(f"energy_{i}") for i, e in enumerate(rolling.spectral("click", rolling.frame(8), 8))])


@query("w09_fourier", _bands(_LAST8), _ENERGIES)
def _(s, d):
    rows = _last8(s, d).withColumn("e", rolling.fourier_energy("l"))
    return rows.select(E, "ts", *[F.when(F.size("l") >= 4, F.col("e")[i]).otherwise(0.0).alias(f"energy_{i}") for i in range(3)])


@query("w10_goertzel", _bands(_LAST8), _ENERGIES)
def _(s, d):
    return _last8(s, d).select(E, "ts", *[e.alias(f"energy_{i}") for i, e in enumerate(rolling.band_energy("l", 8))])


@query("e01_rolling_apply", "SELECT equip_id, ts, max(click) OVER w - min(click) OVER w AS spread FROM wide WINDOW w AS (PARTITION BY equip_id ORDER BY ts ROWS 7 PRECEDING)", "spread")
def _(s, d):
    return f.wide(s, d).select(E, "ts", rolling.apply("click", rolling.frame(8), np.ptp).alias("spread"))


@query("e02_map_elements", "SELECT equip_id, tag, list_sum(list_transform(l, lambda x: x * x)) AS energy FROM (SELECT equip_id, tag, list(value) AS l FROM long GROUP BY 1, 2)", "energy")
def _(s, d):
    arrays = f.long(s, d).groupBy(E, "tag").agg(F.collect_list("value").alias("l"))
    return arrays.select(E, "tag", rolling.map_elements("l", lambda x: float((x * x).sum())).alias("energy"))


@query("n07_arrays_and_maps", "SELECT equip_id, tag, n, total FROM (SELECT equip_id, tag, count(*) AS n, sum(value) AS total FROM long GROUP BY 1, 2) WHERE n > 1", "total")
def _(s, d):
    by_tag = f.long(s, d).groupBy(E, "tag").agg(F.collect_list("value").alias("l"))
    maps = by_tag.groupBy(E).agg(F.map_from_entries(F.collect_list(F.struct("tag", "l"))).alias("m"))
    rows = maps.select(E, F.explode(F.map_filter("m", lambda k, v: F.size(v) > 1)).alias("tag", "l"))
    return rows.select(E, "tag", F.size("l").cast("long").alias("n"), F.aggregate("l", F.lit(0.0), lambda a, x: a + x).alias("total"))


def _batch(s, d):
    return batch.run(f.history(s, d), batch.Settings(COLS, keep=kept))


@query("e09_batch_scores")
def _(s, d):
    return _batch(s, d)["scores"]


@query("e10_batch_tables")
def _(s, d):
    """Rows by table and equipment of a whole batch; a few tables, as each is built from the batch's scores."""
    found = _batch(s, d)
    parts = [found[n].groupBy(E).agg(F.count("*").alias("n")).withColumn("name", F.lit(n)) for n in ("episodes", "zones_by_day", "defect_summary", "regime_dwell")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("place", F.row_number().over(W.partitionBy(E).orderBy("name")))
