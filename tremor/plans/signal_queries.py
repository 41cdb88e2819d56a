"""Queries on signals held as arrays, in expressions, and on ordered event values, in windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators.features import with_features
from ..sources.proxies import table
from .registry import query

_L = "l AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT vec_id, avg(v) AS mu, count(*) AS n, sqrt(avg(v * v)) AS rms, max(abs(v)) AS peak, avg(abs(v)) AS level, sum(v * v) AS e FROM l GROUP BY vec_id)"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def _r(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


@query(f"""WITH {_L}, c AS (SELECT l.vec_id, any_value(n) AS n, any_value(mu) AS mu, avg((v - mu) ** 2) AS m2, avg((v - mu) ** 3) AS m3, avg((v - mu) ** 4) AS m4 FROM l JOIN m USING (vec_id) GROUP BY l.vec_id)
SELECT vec_id, round(mu, 6) AS mean, round(sqrt(m2), 6) AS std, round(m3 / m2 ** 1.5 * sqrt(n * (n - 1.0)) / (n - 2), 6) AS skew, round(((n * n - 1) * m4 / (m2 * m2) - 3 * (n - 1) ** 2) / ((n - 2) * (n - 3)) + 3, 6) AS kurtosis FROM c""")
def signal_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir).withColumn("mu", A.mean(F.col("x")))
    x, mu = F.col("x"), F.col("mu")
    return rows.select("vec_id", _r(mu, "mean"), _r(F.sqrt(A.central_moment(x, mu, 2)), "std"), _r(A.skewness(x, mu), "skew"), _r(A.kurtosis(x, mu), "kurtosis"))


@query(f"WITH {_L} SELECT vec_id, round(rms, 6) AS rms, round(peak / rms, 6) AS crest, round(peak / level, 6) AS impulse FROM m")
def signal_crest_impulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _signals(spark, sf_dir).select("vec_id", _r(A.rms(x), "rms"), _r(A.crest(x), "crest"), _r(A.impulse(x), "impulse"))


@query(f"WITH {_L}, p AS (SELECT vec_id, v, lead(v) OVER (PARTITION BY vec_id ORDER BY i) AS w FROM l) SELECT vec_id, round(count(*) FILTER (WHERE v * w < 0) / (count(*) - 1), 6) AS zcr FROM p GROUP BY vec_id")
def zero_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("vec_id", _r(A.zero_crossing_rate(F.col("x")), "zcr"))


@query(f"""WITH {_L}, s AS (SELECT unnest([0, 15, 30, 44]) AS s), w AS (SELECT l.vec_id, s, sqrt(avg(v * v)) AS r FROM l JOIN s ON i > s AND i <= s + 20 GROUP BY ALL) SELECT vec_id, count(*) AS windows, round(avg(r), 6) AS mean_rms, round(max(r), 6) AS max_rms FROM w GROUP BY vec_id""")
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.transform(A.windows(F.col("x"), 20, 15), A.rms)
    return _signals(spark, sf_dir).withColumn("r", levels).select("vec_id", F.size("r").cast("long").alias("windows"), _r(A.mean(F.col("r")), "mean_rms"), _r(F.array_max("r"), "max_rms"))


@query(f"WITH {_L}, q AS (SELECT vec_id, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM l GROUP BY vec_id), d AS (SELECT l.vec_id, quantile_cont(abs(v - b), 0.5) AS mad FROM l JOIN q USING (vec_id) GROUP BY l.vec_id) SELECT vec_id, round(greatest(1.4826 * mad, (c - a) / 1.349), 6) AS scale FROM q JOIN d USING (vec_id)")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("vec_id", _r(A.robust_scale(F.col("x")), "scale"))


@query(f"WITH {_L} SELECT l.vec_id, round(-sum(CASE WHEN v = 0 THEN 0 ELSE v * v / e * ln(v * v / e) END), 6) AS entropy FROM l JOIN m USING (vec_id) GROUP BY l.vec_id")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("vec_id", _r(A.energy_entropy(F.col("x")), "entropy"))


@query(f"WITH {_L}, p AS (SELECT l.vec_id, (v - mu) * (lead(v) OVER (PARTITION BY l.vec_id ORDER BY i) - mu) AS a, (v - mu) ** 2 AS b FROM l JOIN m USING (vec_id)) SELECT vec_id, round(sum(a) / sum(b), 6) AS r1 FROM p GROUP BY vec_id")
def autocorr_lag1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).withColumn("mu", A.mean(F.col("x"))).select("vec_id", _r(A.autocorrelation(F.col("x"), F.col("mu")), "r1"))


@query(f"WITH {_L}, f AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM l WHERE v > 0), r AS (SELECT vec_id, g, count(*) AS n FROM f GROUP BY ALL) SELECT m.vec_id, CAST(coalesce(max(r.n), 0) AS INTEGER) AS run FROM m LEFT JOIN r USING (vec_id) GROUP BY m.vec_id")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("vec_id", A.longest_run(F.col("x"), F.lit(0.0)).alias("run"))


@query(f"WITH {_L}, q AS (SELECT vec_id, (i - 1) // 16 AS k, sqrt(avg(v * v)) AS r FROM l GROUP BY ALL) SELECT vec_id, round(max(r) / min(r), 6) AS ratio, round(stddev_pop(r) / avg(r), 6) AS cv FROM q GROUP BY vec_id")
def quartile_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir).withColumn("r", F.transform(A.quarters(F.col("x")), A.rms))
    r = F.col("r")
    return rows.select("vec_id", _r(F.array_max(r) / F.array_min(r), "ratio"), _r(F.sqrt(A.central_moment(r, A.mean(r), 2)) / A.mean(r), "cv"))


@query(f"WITH {_L}, h AS (SELECT vec_id, (i + 1) // 2 AS k, sum(v) / sqrt(2) AS lo, sum(CASE WHEN i % 2 = 1 THEN v ELSE -v END) / sqrt(2) AS hi FROM l GROUP BY ALL) SELECT vec_id, round(sum(lo * lo), 6) AS low, round(sum(hi * hi), 6) AS high FROM h GROUP BY vec_id")
def haar_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir).withColumn("h", A.haar(F.col("x")))
    energy = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v * v)
    return rows.select("vec_id", _r(energy(F.col("h.low")), "low"), _r(energy(F.col("h.high")), "high"))


@query("""SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(coalesce(stddev_samp(value) OVER w, 0), 6) AS std FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)""")
def rolling_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 3)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(by), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value").over(by), F.lit(0.0)), 6).alias("std"))


@query("""SELECT event_id, round(coalesce(avg(value * value) OVER s / nullif(avg(value * value) OVER l, 0), 0), 6) AS ratio FROM events WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), l AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING)""")
def sta_lta(spark: SparkSession, sf_dir: str) -> DataFrame:
    by, energy = Window.partitionBy("user_id").orderBy("ts", "event_id"), F.col("value") * F.col("value")
    long = F.avg(energy).over(by.rowsBetween(-24, -5))
    return table(spark, sf_dir, "events").select("event_id", F.round(F.coalesce(F.avg(energy).over(by.rowsBetween(-4, 0)) / F.nullif(long, F.lit(0.0)), F.lit(0.0)), 6).alias("ratio"))


@query("""WITH d AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events) SELECT user_id, count(d) AS intervals, round(stddev_pop(d) / avg(d), 6) AS cv, round(count(*) FILTER (WHERE d BETWEEN 0.8 * m AND 1.2 * m) / count(d), 6) AS periodicity FROM d JOIN (SELECT user_id, quantile_cont(d, 0.5) AS m FROM d GROUP BY user_id) USING (user_id) GROUP BY user_id""")
def interval_periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = table(spark, sf_dir, "events").withColumn("u", F.unix_micros(F.col("ts").cast("timestamp")))
    gaps = gaps.select("user_id", (F.col("u") - F.lag("u").over(Window.partitionBy("user_id").orderBy("u"))).cast("double").alias("d"))
    middle = gaps.groupBy("user_id").agg(F.percentile("d", F.lit(0.5)).alias("m"))
    near = F.count_if(F.col("d").between(0.8 * F.col("m"), 1.2 * F.col("m")))
    return gaps.join(middle, "user_id").groupBy("user_id").agg(F.count("d").alias("intervals"), F.round(F.stddev_pop("d") / F.avg("d"), 6).alias("cv"), F.round(near / F.count("d"), 6).alias("periodicity"))


#: The tables name no sampling rate; their samples are read as if taken at this one.
RATE = 8000.0


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, sampling_rate, signal): every embedding, and every user's event values in the order of time."""
    vectors = _signals(spark, sf_dir).select(F.concat(F.lit("vec"), "vec_id").alias("sample_id"), F.col("x").alias("signal"))
    series = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("v"))
    users = series.select(F.concat(F.lit("user"), F.coalesce(F.col("user_id").cast("string"), F.lit(""))).alias("sample_id"), F.col("v.value").cast("array<double>").alias("signal"))
    return vectors.union(users).select("sample_id", F.lit(RATE).alias("sampling_rate"), "signal")


@query()
def recording_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of all recordings; short ones are padded to a frame, and one without finite samples has nulls and the reason."""
    return with_features(recordings(spark, sf_dir))
