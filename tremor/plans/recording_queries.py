"""Queries on recordings that Spark writes as files from the driver's tables and reads again by the lines' rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import line_rules
from ..sources import tdms
from ..sources.proxies import table
from ..sources.shared import shared_path
from .registry import query

#: How the lines name their files, groups and channels.
RULES = {
    "epump2": {"filename": {"split": "_", "sn_index": 1, "reference_index": 2, "time_index": [3, 4], "time_order": "dmy"}, "channels": {"up_group": "Vib Up_0", "down_group": "Vib Down_0", "acc_channel": "ACC"}},
    "epump4": {"filename": {"split": "_", "sn_index": 0, "reference_index": 1, "time_index": [3, 4], "time_order": "ymd"}, "channels": {"up_group": "Vib Up_0", "down_group": "Vib Down_0", "acc_channel": "ACC"}},
    "etilt1": {
        "filename": {"split": "_", "sn_index": 4, "reference_index": 1, "time_index": [2, 3], "time_order": "ymd"},
        "channels": {"conditional": [{"when": {"reference": "4031033"}, "up_group": "Measure_9", "down_group": "Measure_10", "acc_channel": "ACC1"}, {"when": {"reference": "*"}, "up_group": "Measure_1", "down_group": "Measure_2", "acc_channel": "ACC1"}]},
    },
}


def _written(spark: SparkSession, sf_dir: str) -> str:
    """Files of 64 embeddings each: the first halves are the up channel, the second halves the down channel."""
    parts = table(spark, sf_dir, "embeddings").withColumn("f", F.floor(F.col("vec_id") / 64)).groupBy("f").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<float>").alias("x")))).alias("v"))
    number, kind = F.col("f").cast("string"), F.col("f") % 3
    tilt = F.when(F.col("f") % 2 == 1, "4031033").otherwise("999")
    path = (
        F.when(kind == 0, F.concat(F.lit("epump2/x_S"), number, F.lit("_R"), (F.col("f") % 5).cast("string"), F.lit("_02012026_030405.tdms")))
        .when(kind == 1, F.concat(F.lit("deep/ETILT1/E-Tilt_"), tilt, F.lit("_20260102_030405_S"), number, F.lit(".tdms.zst")))
        .otherwise(F.concat(F.lit("elsewhere/S"), number, F.lit("_R"), (F.col("f") % 5).cast("string"), F.lit("_L4-C162-_20260102_030405.tdms")))
    )
    tilted = F.when(tilt == "4031033", F.array(F.lit("Measure_9"), F.lit("Measure_10"))).otherwise(F.array(F.lit("Measure_1"), F.lit("Measure_2")))
    groups = F.when(kind == 1, tilted).otherwise(F.array(F.lit("Vib Up_0"), F.lit("Vib Down_0")))
    half = lambda first: F.flatten(F.transform("v", lambda r: F.slice(r.x, first, 32)))
    sides = F.posexplode(F.array(half(1), half(33)))
    rows = parts.select(path.alias("relative_path"), groups.alias("groups"), F.when(kind == 1, "ACC1").otherwise("ACC").alias("channel"), sides.alias("side", "samples"))
    step = F.create_map(F.lit("wf_increment"), F.lit("0.00003"))
    root = shared_path(spark, "recordings")
    tdms.write(rows.select("relative_path", F.element_at("groups", F.col("side") + 1).alias("group"), "channel", F.lit(0).cast("long").alias("start"), "samples", step.alias("properties")), root)
    return root


_FILES = """f AS (SELECT vec_id // 64 AS f, vec_id, embedding FROM embeddings),
n AS (SELECT f, f % 3 AS kind, CASE f % 3 WHEN 0 THEN 'epump2' WHEN 1 THEN 'etilt1' ELSE 'epump4' END AS line, 'S' || f AS sn,
  CASE WHEN f % 3 = 1 THEN CASE WHEN f % 2 = 1 THEN '4031033' ELSE '999' END ELSE 'R' || f % 5 END AS reference FROM f GROUP BY f),
g AS (SELECT *, CASE WHEN kind = 1 THEN 'ACC1' ELSE 'ACC' END AS channel, CASE WHEN kind <> 1 THEN 'Vib Up_0' WHEN f % 2 = 1 THEN 'Measure_9' ELSE 'Measure_1' END AS up_group,
  CASE WHEN kind <> 1 THEN 'Vib Down_0' WHEN f % 2 = 1 THEN 'Measure_10' ELSE 'Measure_2' END AS down_group FROM n)"""


@query(f"""WITH {_FILES}, v AS (SELECT f, i, CAST(v AS DOUBLE) AS v FROM (SELECT f, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM f)),
s AS (SELECT f, count(*) FILTER (i <= 32) AS up_n, round(sum(v) FILTER (i <= 32), 4) AS up_sum, count(*) FILTER (i > 32) AS down_n, round(sqrt(avg(v * v) FILTER (i > 32)), 6) AS down_rms FROM v GROUP BY f)
SELECT line, sn, reference, '20260102_030405' AS time, channel AS acc_channel, up_group, down_group, 33333 AS sampling_rate, up_n, up_sum, down_n, down_rms FROM g JOIN s USING (f)""")
def recordings_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rules.read_recordings(spark, _written(spark, sf_dir), RULES)
    total = lambda x, f: F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v.cast("double")))
    n = lambda c: F.size(c).cast("long")
    values = [n("up_data").alias("up_n"), F.round(total("up_data", lambda v: v), 4).alias("up_sum"), n("down_data").alias("down_n"), F.round(F.sqrt(total("down_data", lambda v: v * v) / n("down_data")), 6).alias("down_rms")]
    return rows.select("line", "sn", "reference", "time", "acc_channel", "up_group", "down_group", "sampling_rate", *values)


@query(f"""WITH {_FILES} SELECT line, sn, sn || '_' || direction AS sample_id, CASE direction WHEN 'up' THEN up_group ELSE down_group END AS group_name, channel AS channel_name, 33333 AS sampling_rate, reference, '20260102_030405' AS time
FROM g, (SELECT unnest(['up', 'down']) AS direction)""")
def samples_of_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = tdms.read(spark, _written(spark, sf_dir), values="false")
    return line_rules.sample_rows(channels, RULES).drop("direction")
