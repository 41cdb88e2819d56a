"""Queries on spectra and envelopes of embeddings as short recordings of 64 values; SQL sums the waves term by term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spectra as S
from ..sources.proxies import table
from .registry import query

_L = "l AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def _recordings(spark: SparkSession, sf_dir: str, rate: float) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.lit(rate).alias("rate"))


def _r(c: str | Column, name: str, n: int = 6) -> Column:
    return F.round(c, n).alias(name)


_WELCH = f"""{_L}, fr AS (SELECT vec_id, s, j - s AS i, v - avg(v) OVER (PARTITION BY vec_id, s) AS d FROM l JOIN (SELECT unnest([0, 16, 32]) AS s) ON j >= s AND j < s + 32),
w AS (SELECT *, d * (0.5 - 0.5 * cos(2 * pi() * i / 32)) AS y FROM fr),
t AS (SELECT vec_id, s, k, sum(y * cos(2 * pi() * ((i * k) % 32) / 32)) AS re, sum(y * sin(2 * pi() * ((i * k) % 32) / 32)) AS im FROM w, (SELECT unnest(range(17)) AS k) GROUP BY ALL),
p AS (SELECT vec_id, k, avg(re * re + im * im) * (CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END) / (20000 * 12.0) AS psd, k * 625.0 AS hz FROM t GROUP BY vec_id, k)"""


@query(f"""WITH {_WELCH}, a AS (SELECT vec_id, sum((psd + 1e-12) * hz) / sum(psd + 1e-12) AS c, sum(psd + 1e-12) AS w, exp(avg(ln(psd + 1e-12))) / (avg(psd + 1e-12) + 1e-12) AS flat, sum(psd) AS s, (sum(psd) - (sum(psd) FILTER (k IN (0, 16))) / 2) * 625 AS total FROM p GROUP BY vec_id),
r AS (SELECT vec_id, hz, sum(psd) OVER (PARTITION BY vec_id ORDER BY k) AS upto FROM p), o AS (SELECT vec_id, min(hz) AS roll FROM r JOIN a USING (vec_id) WHERE upto >= 0.85 * s GROUP BY vec_id),
b AS (SELECT vec_id, (sum(psd) FILTER (k BETWEEN 2 AND 6) - (sum(psd) FILTER (k IN (2, 6))) / 2) * 625 AS high, (sum(psd) FILTER (k BETWEEN 7 AND 14) - (sum(psd) FILTER (k IN (7, 14))) / 2) * 625 AS ultra FROM p GROUP BY vec_id)
SELECT vec_id, round(c, 4) AS centroid_hz, round(sqrt(sum((hz - c) ** 2 * (psd + 1e-12)) / any_value(w)), 4) AS bandwidth_hz, CAST(any_value(roll) AS DOUBLE) AS rolloff85_hz,
  round(any_value(flat), 6) AS flatness, round(any_value(high) / any_value(total), 6) AS high_ratio, round(any_value(ultra) / any_value(total), 6) AS ultra_ratio
FROM p JOIN a USING (vec_id) JOIN b USING (vec_id) JOIN o USING (vec_id) GROUP BY vec_id, c""")
def welch_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    spectra = S.welch(_recordings(spark, sf_dir, 20000.0), "vec_id", size=F.lit(32), overlap=F.lit(16))
    return S.spectral_shape(spectra).select("vec_id", _r("centroid_hz", "centroid_hz", 4), _r("bandwidth_hz", "bandwidth_hz", 4), "rolloff85_hz", _r("flatness", "flatness"), _r("high_ratio", "high_ratio"), _r("ultra_ratio", "ultra_ratio"))


@query(f"""WITH {_L}, w AS (SELECT vec_id, s, avg(v) AS mu FROM l JOIN (SELECT unnest(range(0, 49, 4)) AS s) ON j >= s AND j < s + 16 GROUP BY ALL),
k AS (SELECT vec_id, s, avg((v - mu) ** 4) / avg((v - mu) ** 2) ** 2 AS k FROM l JOIN w USING (vec_id) WHERE j >= s AND j < s + 16 GROUP BY ALL)
SELECT vec_id, round(max(k), 6) AS sk_max, round(avg(k), 6) AS sk_mean, round(quantile_cont(k, 0.95), 6) AS sk_q95, round(arg_max(s, (k, -s)) / 48.0, 6) AS sk_time_to_max FROM k GROUP BY vec_id""")
def spectral_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _recordings(spark, sf_dir, 1.0).select("vec_id", S.sliding_kurtosis(F.col("x"), 16, 4).alias("k"))
    return rows.select("vec_id", *(_r(f"k.{c}", f"sk_{c}") for c in ("max", "mean", "q95", "time_to_max")))


@query(f"""WITH {_L}, m AS (SELECT vec_id, j // 8 AS part, avg(v) AS mu, sqrt(avg(v * v)) AS rms FROM l GROUP BY ALL),
k AS (SELECT vec_id, part, any_value(rms) AS rms, avg((v - mu) ** 4) / avg((v - mu) ** 2) ** 2 AS k FROM l JOIN m USING (vec_id) WHERE part = j // 8 GROUP BY ALL)
SELECT vec_id, round(stddev_pop(rms) / avg(rms), 6) AS rms_cv, round(max(rms) / min(rms), 5) AS rms_max_min_ratio, round(stddev_pop(k) / avg(abs(k)), 6) AS kurt_cv, 0.0::DOUBLE AS high_ratio_cv FROM k GROUP BY vec_id""")
def segment_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.segment_stability(_recordings(spark, sf_dir, 20000.0), "vec_id")
    return rows.select("vec_id", _r("rms_cv", "rms_cv"), _r("rms_max_min_ratio", "rms_max_min_ratio", 5), _r("kurt_cv", "kurt_cv"), _r("high_ratio_cv", "high_ratio_cv"))


@query(f"""WITH {_L}, k AS (SELECT unnest(range(33)) AS k),
x AS (SELECT vec_id, k, sum(v * cos(2 * pi() * ((j * k) % 64) / 64)) * (CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) AS re, -sum(v * sin(2 * pi() * ((j * k) % 64) / 64)) * (CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) AS im FROM l, k GROUP BY vec_id, k),
z AS (SELECT vec_id, n, sqrt(sum(re * cos(2 * pi() * ((n * k) % 64) / 64) - im * sin(2 * pi() * ((n * k) % 64) / 64)) ** 2 + sum(re * sin(2 * pi() * ((n * k) % 64) / 64) + im * cos(2 * pi() * ((n * k) % 64) / 64)) ** 2) / 64 AS e FROM x, (SELECT unnest(range(64)) AS n) GROUP BY vec_id, n),
d AS (SELECT vec_id, n, e, e - avg(e) OVER (PARTITION BY vec_id) AS c FROM z),
s AS (SELECT vec_id, k, sum(c * (0.5 - 0.5 * cos(2 * pi() * n / 63)) * cos(2 * pi() * ((n * k) % 64) / 64)) ** 2 + sum(c * (0.5 - 0.5 * cos(2 * pi() * n / 63)) * sin(2 * pi() * ((n * k) % 64) / 64)) ** 2 AS p FROM d, k GROUP BY vec_id, k),
q AS (SELECT vec_id, sum(p) FILTER (k >= 1) AS total, sum(p) FILTER (k BETWEEN 1 AND 19) AS a, sum(p) FILTER (k BETWEEN 20 AND 32) AS b, arg_max(k, p) FILTER (k >= 1) AS f FROM s GROUP BY vec_id),
g AS (SELECT vec_id, avg(c ** 4) / avg(c ** 2) ** 2 AS kurt FROM d GROUP BY vec_id)
SELECT vec_id, round(a / total, 6) AS env_mod_shudder, round(b / total, 6) AS env_mod_rough, CAST(f AS DOUBLE) AS env_peak_f, round(kurt, 6) AS env_kurt FROM q JOIN g USING (vec_id)""")
def envelope_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.with_envelopes(_recordings(spark, sf_dir, 64.0))
    return rows.select("vec_id", _r("env_mod_shudder", "env_mod_shudder"), _r("env_mod_rough", "env_mod_rough"), "env_peak_f", _r("env_kurt", "env_kurt"))
