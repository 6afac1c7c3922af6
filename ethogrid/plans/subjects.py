"""Queries of the subject-level operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid.functions import scalars as fn
from ethogrid.operators import audit, calibrate, catalog, design, evaluation, stats
from ethogrid.plans.behaviour import r6
from ethogrid.plans.behaviour_sql import SPEED, STATES, TRACKS
from ethogrid.sources import adapters
from ethogrid.sources.tables import written

FEATURES = ["f_orders", "f_mean_price", "f_max_price", "f_acctbal"]
VEHICLE = "BUILDING"
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
QUERIES: dict = {}
ORACLE: dict = {}

FISH = """
WITH fish AS (
  SELECT 'F_' || lpad(CAST(c.c_custkey AS VARCHAR), 6, '0') AS video_id, c.c_mktsegment AS compound,
         CASE c.c_nationkey % 3 WHEN 0 THEN '0.03' WHEN 1 THEN '0.1' ELSE '1' END AS concentration_mM,
         CAST(DATE '2024-01-01' + CAST(c.c_custkey % 12 AS INTEGER) AS DATE) AS date,
         CASE WHEN c.c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, c.c_acctbal > 0 AS reviewed,
         CAST(count(o.o_orderkey) AS DOUBLE) AS f_orders, avg(o.o_totalprice) AS f_mean_price, max(o.o_totalprice) AS f_max_price, c.c_acctbal AS f_acctbal
  FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'
  GROUP BY c.c_custkey, c.c_mktsegment, c.c_nationkey, c.c_acctbal),
long AS (SELECT video_id, compound, concentration_mM, date, 'f_orders' AS feature, f_orders AS value FROM fish UNION ALL SELECT video_id, compound, concentration_mM, date, 'f_mean_price', f_mean_price FROM fish
  UNION ALL SELECT video_id, compound, concentration_mM, date, 'f_max_price', f_max_price FROM fish UNION ALL SELECT video_id, compound, concentration_mM, date, 'f_acctbal', f_acctbal FROM fish)
"""
PRED = """
WITH e0 AS (SELECT vec_id, label, unnest(range(0, 10)) AS cls, unnest(embedding[1:10]) AS logit FROM embeddings),
e1 AS (SELECT vec_id, label, CAST(cls AS INTEGER) AS cls, exp(20.0::DOUBLE * CAST(logit AS DOUBLE)) AS w FROM e0),
lp AS (SELECT vec_id, label, cls, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM e1),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, cls) AS r FROM lp),
pr AS (SELECT vec_id, label, max(cls) FILTER (r = 1) AS predicted, max(p) FILTER (cls = label) AS p_true, max(r) FILTER (cls = label) AS label_rank,
              vec_id % 5 AS repeat, CASE WHEN vec_id % 3 = 0 THEN 'A' ELSE 'B' END AS scheme FROM rk GROUP BY vec_id, label)
"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query(FISH + """SELECT compound, count(*) AS animals, CAST(sum(CASE WHEN reviewed THEN 1 ELSE 0 END) AS BIGINT) AS accepted, count(DISTINCT date) AS dates,
  string_agg(DISTINCT concentration_mM, ', ' ORDER BY concentration_mM) AS doses FROM fish GROUP BY compound""")
def compound_summary(spark, sf) -> DataFrame:
    return audit.compounds(adapters.subjects(spark, sf))


@query(FISH + """SELECT date, count(*) AS animals, count(DISTINCT compound) AS compounds, round(avg(CASE WHEN sex = 'F' THEN 1.0 ELSE 0.0 END), 6) + 0 AS female_share,
  string_agg(DISTINCT compound, ', ' ORDER BY compound) AS names FROM fish GROUP BY date""")
def date_summary(spark, sf):
    return audit.dates(adapters.subjects(spark, sf)).select("date", "animals", "compounds", *r6("female_share"), "names")


@query(FISH + "SELECT date, " + ", ".join(f"count(*) FILTER (compound = '{s}') AS \"{s}\"" for s in SEGMENTS) + " FROM fish GROUP BY date")
def compound_by_date(spark, sf):
    return audit.compound_by_date(adapters.subjects(spark, sf), SEGMENTS)


@query(FISH + "SELECT feature AS \"column\", count(*) FILTER (value IS NULL) AS missing FROM long GROUP BY feature HAVING count(*) FILTER (value IS NULL) > 0")
def missing_values(spark, sf):
    return audit.missing(adapters.subjects(spark, sf), FEATURES + ["sex", "date"])


@query(FISH + "SELECT count(*) AS groups, count(*) >= 3 AS go FROM (SELECT 1 FROM fish GROUP BY compound, concentration_mM HAVING count(*) >= 90 AND count(DISTINCT date) >= 2)")
def stop_rule(spark, sf):
    return audit.stop_rule(adapters.subjects(spark, sf), 90)


@query(FISH + """, g AS (SELECT compound, date, count(DISTINCT concentration_mM) AS d FROM fish GROUP BY ALL)
SELECT count(*) AS animals, count(DISTINCT compound) AS compounds, count(DISTINCT date) AS dates, CAST(sum(CASE WHEN reviewed THEN 1 ELSE 0 END) AS BIGINT) AS accepted,
  round(count(*) / count(DISTINCT date), 6) + 0 AS animals_per_date, count(*) FILTER (f_mean_price IS NULL) AS without_feature,
  (SELECT count(*) FROM (SELECT compound FROM fish GROUP BY compound HAVING count(DISTINCT date) = 1)) AS single_date_compounds,
  (SELECT count(*) FILTER (d >= 2) FROM g) AS compound_dates_with_doses, (SELECT count(*) FROM g) AS compound_dates FROM fish""")
def audit_facts(spark, sf):
    got = audit.facts(adapters.subjects(spark, sf))
    return got.select(*[c for c in got.columns if c != "animals_per_date"], *r6("animals_per_date"))


@query(FISH + """, d AS (SELECT date, median(f_mean_price) AS lo, median(f_max_price) AS hi FROM fish GROUP BY date),
m AS (SELECT median(lo) AS lo0, median(hi) AS hi0, median(hi - lo) * 0.1 AS tolerance FROM d)
SELECT date, round(lo, 6) + 0 AS lo, round(hi, 6) + 0 AS hi, round(tolerance, 6) + 0 AS tolerance, abs(lo - lo0) > tolerance OR abs(hi - hi0) > tolerance AS moved FROM d, m""")
def framing(spark, sf):
    return audit.framing(adapters.subjects(spark, sf), "f_mean_price", "f_max_price").select("date", *r6("lo", "hi", "tolerance"), "moved")


@query(FISH.replace("WITH fish", "WITH RECURSIVE fish", 1) + """, d AS (SELECT date, median(f_mean_price) AS lo, median(f_max_price) AS hi FROM fish GROUP BY date),
r AS (SELECT date AS a, date AS b FROM d UNION SELECT r.a, y.date FROM r JOIN d x ON x.date = r.b JOIN d y ON abs(x.lo - y.lo) <= 5000 AND abs(x.hi - y.hi) <= 5000),
c AS (SELECT a AS date, min(b) AS first_date FROM r GROUP BY a)
SELECT date, CAST(dense_rank() OVER (ORDER BY first_date) AS INTEGER) AS setup FROM c""")
def recording_setups(spark, sf):
    """Single linkage of recording dates."""
    rows = audit.setups(audit.framing(adapters.subjects(spark, sf), "f_mean_price", "f_max_price"), 5000.0)
    return spark.createDataFrame(rows, "date date, setup int")


@query(FISH + """, a AS (SELECT *, count(*) OVER (PARTITION BY compound, concentration_mM) AS n FROM fish), b AS (SELECT * FROM a WHERE n >= 95),
c AS (SELECT compound FROM b GROUP BY compound HAVING count(DISTINCT concentration_mM) > 1) SELECT video_id, compound, concentration_mM FROM b WHERE compound IN (SELECT compound FROM c)""")
def class_filter(spark, sf):
    return audit.filter_classes(adapters.subjects(spark, sf), 95, by_dose=True).select("video_id", "compound", "concentration_mM")


@query(FISH + "SELECT 'f_zero' AS feature, 'constant' AS reason UNION ALL SELECT 'f_none', 'missing'")
def useless_features(spark, sf):
    t = adapters.subjects(spark, sf).withColumn("f_zero", F.lit(0.0)).withColumn("f_none", F.lit(None).cast("double"))
    return audit.useless_features(t, [*FEATURES, "f_zero", "f_none"])


@query(FISH + """, f AS (SELECT feature, coalesce(median(value), 0) AS fill FROM long GROUP BY feature),
v AS (SELECT video_id, l.feature, CASE WHEN l.feature = 'f_orders' THEN ln(1 + coalesce(value, fill)) ELSE coalesce(value, fill) END AS v FROM long l JOIN f ON l.feature = f.feature),
s AS (SELECT feature, avg(v) AS mean, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS sd FROM v GROUP BY feature)
SELECT video_id, v.feature, round((v - mean) / sd, 6) + 0 AS z FROM v JOIN s ON v.feature = s.feature""")
def preprocess(spark, sf):
    t = adapters.subjects(spark, sf)
    fitted = audit.fit_preprocess(t, FEATURES, ["f_orders"])
    return audit.preprocess(t, ["video_id"], FEATURES, fitted, ["f_orders"]).select("video_id", "feature", *r6("z"))


@query(FISH + "SELECT video_id, " + ", ".join(f"CASE WHEN compound = '{s}' THEN 1 ELSE 0 END AS \"compound={s}\"" for s in SEGMENTS[:4]) + " FROM fish")
def one_hot(spark, sf):
    return audit.one_hot(adapters.subjects(spark, sf).select("video_id", "compound"), "compound", SEGMENTS[:4]).drop("compound")


@query(FISH + """, e AS (SELECT *, 1 + CASE WHEN date >= '2024-01-05' THEN 1 ELSE 0 END + CASE WHEN date >= '2024-01-09' THEN 1 ELSE 0 END AS epoch FROM fish),
v AS (SELECT * FROM e WHERE compound = 'BUILDING' AND f_mean_price IS NOT NULL), a AS (SELECT date, median(f_mean_price) AS m, count(*) AS n FROM v GROUP BY date),
b AS (SELECT epoch, median(f_mean_price) AS m, count(*) AS n FROM v GROUP BY epoch), c AS (SELECT median(f_mean_price) AS m FROM v)
SELECT e.video_id, CAST(e.epoch AS INTEGER) AS epoch, round(coalesce(CASE WHEN a.n >= 25 THEN a.m END, CASE WHEN b.n >= 25 THEN b.m END, c.m), 6) + 0 AS baseline,
  round(e.f_mean_price - coalesce(CASE WHEN a.n >= 25 THEN a.m END, CASE WHEN b.n >= 25 THEN b.m END, c.m), 6) + 0 AS normalised
FROM e LEFT JOIN a ON a.date = e.date LEFT JOIN b ON b.epoch = e.epoch CROSS JOIN c""")
def vehicle_normalise(spark, sf):
    got = audit.vehicle_normalise(adapters.subjects(spark, sf), "f_mean_price", VEHICLE, ["2024-01-05", "2024-01-09"], 25)
    return got.select("video_id", "epoch", *r6("baseline", "normalised"))


_EFFECT = """
n AS (SELECT feature, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, avg(value) FILTER (g) AS m1, avg(value) FILTER (NOT g) AS m2, var_samp(value) FILTER (g) AS v1,
        var_samp(value) FILTER (NOT g) AS v2, count(DISTINCT value) AS nv FROM r WHERE value IS NOT NULL GROUP BY feature),
k AS (SELECT feature, g, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk,
        count(*) OVER (PARTITION BY feature, value) AS t FROM r WHERE value IS NOT NULL),
u AS (SELECT feature, sum(rk) FILTER (g) AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM k GROUP BY feature),
ef AS (SELECT n.feature, n1, n2, m1 AS group_mean, m2 AS control_mean,
   coalesce((m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 0) * (1 - 3.0 / (4.0 * (n1 + n2) - 9)), 0) AS hedges_g, r1 - n1 * (n1 + 1) / 2.0 AS u,
   (greatest(r1 - n1 * (n1 + 1) / 2.0, n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0)) - n1 * n2 / 2.0 - 0.5)
     / nullif(sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))), 0) AS z, ties
   FROM n JOIN u ON n.feature = u.feature WHERE n1 >= 2 AND n2 >= 2 AND nv > 1)
"""
def _p_sql() -> str:
    """p of the rows of ``ef``: exact by products of (1 - q^(n + i)) / (1 - q^i), a pair of steps for each i up to 8, else the normal tail."""
    out = """, sz AS (SELECT DISTINCT least(n1, n2) AS m, greatest(n1, n2) AS n FROM ef WHERE least(n1, n2) <= 8 AND n1 * n2 <= 2500 AND ties = 0),
x0 AS (SELECT m, n, j, CASE WHEN j = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM (SELECT m, n, unnest(range(0, CAST(m * n + 1 AS BIGINT))) AS j FROM sz))"""
    for i in range(1, 9):
        out += f""",
y{i} AS (SELECT a.m, a.n, a.j, a.v - coalesce(b.v, 0) AS v FROM x{i - 1} a LEFT JOIN x{i - 1} b ON b.m = a.m AND b.n = a.n AND b.j = a.j - a.n - {i} AND a.m >= {i}),
x{i} AS (SELECT m, n, j, CASE WHEN m >= {i} THEN sum(v) OVER (PARTITION BY m, n, j % {i} ORDER BY j) ELSE v END AS v FROM y{i})"""
    poly = str(stats.ERFC[-1])
    for k in reversed(stats.ERFC[:-1]):
        poly = f"({k} + t * {poly})"
    return out + f""",
pe AS (SELECT ef.feature, least(1.0, 2 * sum(v) FILTER (j >= ceil(greatest(u, m * n - u))) / sum(v)) AS p FROM ef JOIN x8 ON m = least(n1, n2) AND n = greatest(n1, n2) AND ties = 0 GROUP BY ef.feature),
pn AS (SELECT feature, least(1.0, CASE WHEN z < 0 THEN 2 - e ELSE e END) AS p FROM (SELECT feature, z, t * exp(-x * x + {poly}) AS e FROM
  (SELECT feature, z, abs(z) / sqrt(2.0::DOUBLE) AS x, 1.0 / (1.0 + 0.5 * abs(z) / sqrt(2.0::DOUBLE)) AS t FROM ef)))
SELECT ef.feature, n1, n2, round(group_mean, 6) + 0 AS group_mean, round(control_mean, 6) + 0 AS control_mean, round(hedges_g, 6) + 0 AS hedges_g, round(u, 6) + 0 AS u, round(z, 6) + 0 AS z,
  round(coalesce(pe.p, pn.p), 6) + 0 AS p_value, CASE WHEN pe.p IS NULL THEN 'normal' ELSE 'exact' END AS p_method FROM ef LEFT JOIN pe ON pe.feature = ef.feature LEFT JOIN pn ON pn.feature = ef.feature"""


_GROUP = FISH + """, dd AS (SELECT DISTINCT date FROM fish WHERE compound = 'MACHINERY' AND concentration_mM = '0.1' AND sex = 'F'),
r AS (SELECT feature, true AS g, value FROM long l WHERE compound = 'MACHINERY' AND concentration_mM = '0.1'
      UNION ALL SELECT feature, false, value FROM long WHERE compound = 'BUILDING' AND date IN (SELECT date FROM long WHERE compound = 'MACHINERY' AND concentration_mM = '0.1')),
""" + _EFFECT


def _effects(spark, sf) -> DataFrame:
    rows = stats.control_rows(adapters.subjects(spark, sf), "MACHINERY", VEHICLE, "0.1")
    return stats.effects(stats.unpivot(rows, ["video_id", "is_group"], FEATURES), ["feature"])


def _shown(effects: DataFrame) -> DataFrame:
    return effects.select("feature", "n1", "n2", *r6("group_mean", "control_mean", "hedges_g", "u", "z", "p_value"), "p_method")


@query(_GROUP + _p_sql())
def compare_to_control(spark, sf):
    return _shown(_effects(spark, sf))


@query(FISH + """, r AS (SELECT CAST(date AS VARCHAR) || '|' || concentration_mM || '|' || sex || '|' || feature AS feature, compound = 'MACHINERY' AS g, value FROM (
  SELECT compound, date, concentration_mM, sex, 'f_acctbal' AS feature, f_acctbal AS value FROM fish UNION ALL SELECT compound, date, concentration_mM, sex, 'f_orders', f_orders FROM fish)
  WHERE compound IN ('MACHINERY', 'BUILDING')),""" + _EFFECT + _p_sql())
def cell_effects(spark, sf):
    """Group against vehicle in every cell of date, dose and sex: mostly small samples, exact p where nothing ties."""
    t = adapters.subjects(spark, sf).where(F.col("compound").isin("MACHINERY", VEHICLE)).withColumn("is_group", F.col("compound") == "MACHINERY")
    long = stats.unpivot(t, ["date", "concentration_mM", "sex", "is_group"], ["f_acctbal", "f_orders"])
    long = long.select(F.concat_ws("|", F.col("date").cast("string"), "concentration_mM", "sex", "feature").alias("feature"), "is_group", "value")
    return _shown(stats.effects(long, ["feature"]))


@query(_GROUP + "SELECT feature, round(hedges_g, 6) + 0 AS hedges_g, CAST(row_number() OVER (ORDER BY abs(hedges_g) DESC, feature) AS INTEGER) AS place FROM ef QUALIFY place <= 3")
def top_differences(spark, sf):
    from pyspark.sql import Window

    got = _effects(spark, sf)  # one row a feature
    place = F.row_number().over(Window.orderBy(F.desc(F.abs("hedges_g")), "feature"))
    return got.withColumn("place", place).where("place <= 3").select("feature", *r6("hedges_g"), "place")


@query(FISH + """, p AS (SELECT compound, feature, (abs(hash0) % 1000 + 1) / 1000.0 AS p_value FROM
  (SELECT compound, feature, CAST(('0x' || substr(sha256(compound || ':' || feature), 1, 7)) AS BIGINT) AS hash0 FROM (SELECT DISTINCT compound, feature FROM long))),
o AS (SELECT *, row_number() OVER (PARTITION BY compound ORDER BY p_value, feature) AS k, count(*) OVER (PARTITION BY compound) AS m FROM p)
SELECT compound, feature, p_value::DOUBLE AS p_value, round(least(1.0, min(p_value * m / k) OVER (PARTITION BY compound ORDER BY p_value DESC, feature DESC ROWS UNBOUNDED PRECEDING)), 6)::DOUBLE + 0 AS q_value FROM o""")
def bh_q(spark, sf):
    rows = stats.unpivot(adapters.subjects(spark, sf), ["compound"], FEATURES).select("compound", "feature").distinct()
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", "compound", "feature"), 256), 1, 7), 16, 10).cast("long")
    got = stats.benjamini_hochberg(rows.withColumn("p_value", (h % 1000 + 1) / 1000.0), ["compound"])
    return got.select("compound", "feature", "p_value", *r6("q_value"))


@query(FISH + """SELECT compound, count(f_mean_price) AS n, round(avg(f_mean_price), 6) + 0 AS mean, round(stddev_samp(f_mean_price), 6) + 0 AS sd, round(median(f_mean_price), 6) + 0 AS median,
  round(quantile_cont(f_mean_price, 0.25), 6) + 0 AS q1, round(quantile_cont(f_mean_price, 0.75), 6) + 0 AS q3, round(min(f_mean_price), 6) + 0 AS min, round(max(f_mean_price), 6) + 0 AS max FROM fish GROUP BY compound""")
def feature_by_compound(spark, sf):
    got = stats.describe(adapters.subjects(spark, sf), ["compound"], "f_mean_price")
    return got.select("compound", "n", *r6("mean", "sd", "median", "q1", "q3", "min", "max"))


@query(FISH + """, s AS (SELECT feature, value AS score, compound AS own FROM long WHERE video_id = 'F_000007' AND value IS NOT NULL)
SELECT s.feature, CASE WHEN l.compound = 'BUILDING' THEN 'vehicle' ELSE 'own' END AS "against",
  round((count(*) FILTER (value < score) + count(*) FILTER (value <= score)) / 2.0 / count(*) * 100, 6) + 0 AS percentile
FROM s JOIN long l ON l.feature = s.feature AND l.value IS NOT NULL AND (l.compound = s.own OR l.compound = 'BUILDING') GROUP BY ALL""")
def subject_profile(spark, sf):
    """Percentiles of one subject within its compound and within the vehicle."""
    long = stats.unpivot(adapters.subjects(spark, sf), ["video_id", "compound"], FEATURES)
    one = long.where("video_id = 'F_000007' and value is not null").select("feature", F.col("value").alias("score"), F.col("compound").alias("own"))
    both = long.join(F.broadcast(one), "feature").where((F.col("compound") == F.col("own")) | (F.col("compound") == VEHICLE))
    both = both.withColumn("against", F.when(F.col("compound") == VEHICLE, "vehicle").otherwise("own"))
    return stats.percentile_of_score(both, ["feature", "against"]).select("feature", "against", *r6("percentile"))


@query(FISH + """, t AS (SELECT date, compound FROM fish WHERE date NOT IN (DATE '2024-01-03', DATE '2024-01-08', DATE '2024-01-12')),
a AS (SELECT DISTINCT date FROM fish), n AS (SELECT DISTINCT date AS near FROM t),
c AS (SELECT date, near FROM (SELECT a.date, n.near, row_number() OVER (PARTITION BY a.date ORDER BY abs(a.date - n.near), n.near) AS rn FROM a, n) WHERE rn = 1),
s AS (SELECT date, compound, count(*) / sum(count(*)) OVER (PARTITION BY date) AS share FROM t GROUP BY date, compound)
SELECT c.date, c.near, s.compound, round(s.share, 6) + 0 AS share FROM c JOIN s ON s.date = c.near""")
def date_only_nearest(spark, sf):
    t = adapters.subjects(spark, sf)
    train = t.where(~F.col("date").cast("string").isin("2024-01-03", "2024-01-08", "2024-01-12"))
    return evaluation.nearest_date_prior(train, t).select("date", "near", "compound", *r6("share"))


@query(FISH + """, o AS (SELECT video_id, compound, count(*) OVER (PARTITION BY compound) AS n, row_number() OVER (PARTITION BY compound ORDER BY sha256('7:' || compound || ':' || video_id), video_id) AS k FROM fish)
SELECT video_id, CASE WHEN n >= 5 AND k <= greatest(1, CAST(round_even(n * 0.2::DOUBLE, 0) AS INTEGER)) THEN 'test' ELSE 'train' END AS split FROM o""")
def hash_split(spark, sf):
    return design.hash_split(adapters.subjects(spark, sf), "compound", "video_id", 0.2, 7).select("video_id", "split")


@query(FISH + """, a AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY video_id) AS k, row_number() OVER (PARTITION BY date ORDER BY sha256('3:' || CAST(date AS VARCHAR) || ':' || video_id), video_id) AS r FROM fish)
SELECT x.video_id, y.compound AS permuted FROM a x JOIN a y ON x.date = y.date AND x.k = y.r""")
def permute_within_date(spark, sf):
    return design.permute_within(adapters.subjects(spark, sf), "date", "video_id", "compound", 3).select("video_id", "permuted")


@query(FISH + """, o AS (SELECT video_id, compound, count(*) OVER (PARTITION BY compound) AS n, row_number() OVER (PARTITION BY compound ORDER BY video_id) - 1 AS i FROM fish)
SELECT video_id, compound FROM o WHERE n <= 4 OR list_contains(list_transform([0, 1, 2, 3], lambda j: CAST(round_even(j * ((n - 1) / 3.0), 0) AS BIGINT)), i)""")
def evenly_spaced(spark, sf):
    return design.evenly_spaced(adapters.subjects(spark, sf), "compound", "video_id", 4).select("video_id", "compound")


def _pred(spark, sf) -> DataFrame:
    got = evaluation.predicted(adapters.predictions(spark, sf))
    return got.withColumn("repeat", F.col("vec_id") % 5).withColumn("scheme", F.when(F.col("vec_id") % 3 == 0, "A").otherwise("B"))


_CLASS = """
sd AS (SELECT scheme, repeat, label AS cls, 1 AS s, 0 AS q, CASE WHEN label = predicted THEN 1 ELSE 0 END AS tp FROM pr UNION ALL SELECT scheme, repeat, predicted, 0, 1, 0 FROM pr),
"""


@query(PRED + "SELECT vec_id, label, predicted, round(p_true, 6) + 0 AS p_true, CAST(label_rank AS BIGINT) AS label_rank FROM pr")
def predicted_class(spark, sf):
    got = _pred(spark, sf)
    return got.select("vec_id", "label", "predicted", *r6("p_true"), F.col("label_rank").cast("long").alias("label_rank"))


@query(PRED + "," + _CLASS + """pc AS (SELECT scheme, repeat, cls, sum(s) AS n, sum(q) AS nq, sum(tp) AS tp FROM sd GROUP BY ALL),
m1 AS (SELECT scheme, repeat, avg(tp / n) FILTER (n > 0) AS ba, avg(coalesce(2.0 * tp / nullif(n + nq, 0), 0)) AS f1 FROM pc GROUP BY ALL),
m2 AS (SELECT scheme, repeat, avg(-ln(least(greatest(p_true, 2.220446049250313e-16), 1 - 2.220446049250313e-16))) AS ll, avg(CASE WHEN label_rank <= 3 THEN 1.0 ELSE 0.0 END) AS top3, count(*) AS n FROM pr GROUP BY ALL)
SELECT m1.scheme, m1.repeat, round(ba, 6) + 0 AS balanced_accuracy, round(f1, 6) + 0 AS macro_f1, round(ll, 6) + 0 AS log_loss, round(top3, 6) + 0 AS top3, n FROM m1 JOIN m2 ON m1.scheme = m2.scheme AND m1.repeat = m2.repeat""")
def metrics(spark, sf):
    got = evaluation.metrics(_pred(spark, sf), ("scheme", "repeat"))
    return got.select("scheme", "repeat", *r6("balanced_accuracy", "macro_f1", "log_loss", "top3"), "n")


@query(PRED + "," + _CLASS + """pc AS (SELECT cls, sum(s) AS n, sum(q) AS nq, sum(tp) AS tp FROM sd GROUP BY cls)
SELECT cls, round(coalesce(tp / nullif(nq, 0), 0), 6) + 0 AS "precision", round(coalesce(tp / nullif(n, 0), 0), 6) + 0 AS recall, round(coalesce(2.0 * tp / nullif(n + nq, 0), 0), 6) + 0 AS f1, CAST(n AS BIGINT) AS support FROM pc""")
def per_class(spark, sf):
    return evaluation.per_class(_pred(spark, sf)).select("cls", *r6("precision", "recall", "f1"), "support")


@query(PRED + "SELECT label, predicted, count(*) AS n FROM pr GROUP BY ALL")
def confusion(spark, sf):
    return evaluation.confusion(_pred(spark, sf))


@query(PRED + "SELECT label, predicted, count(*) AS n FROM pr WHERE label <> predicted GROUP BY ALL ORDER BY n DESC, label, predicted LIMIT 10")
def top_confusions(spark, sf):
    return evaluation.top_confusions(_pred(spark, sf))


@query(PRED + """, k AS (SELECT cls, label = cls AS own, rank() OVER (PARTITION BY cls ORDER BY p) + (count(*) OVER (PARTITION BY cls, p) - 1) / 2.0 AS rk FROM lp)
SELECT cls, round((sum(rk) FILTER (own) - count(*) FILTER (own) * (count(*) FILTER (own) + 1) / 2.0) / (count(*) FILTER (own) * count(*) FILTER (NOT own)), 6) + 0 AS auroc FROM k GROUP BY cls
HAVING count(*) FILTER (own) > 0 AND count(*) FILTER (NOT own) > 0""")
def auroc(spark, sf):
    return evaluation.auroc(adapters.predictions(spark, sf)).select("cls", *r6("auroc"))


@query(PRED + """, b AS (SELECT scheme, repeat, label, avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END) AS rc FROM
  (SELECT scheme, repeat, label, predicted FROM pr WHERE scheme = 'A'
   UNION ALL SELECT 'B', repeat, label, CASE WHEN vec_id % 2 = 0 THEN label ELSE predicted END FROM pr WHERE vec_id IN (SELECT vec_id FROM pr WHERE scheme = 'A')) GROUP BY ALL),
c AS (SELECT scheme, repeat, avg(rc) AS ba FROM b GROUP BY ALL)
SELECT round(avg(b.ba - a.ba), 6) + 0 AS date_effect, count(*) AS repeats FROM c a JOIN c b ON a.repeat = b.repeat AND a.scheme = 'A' AND b.scheme = 'B'""")
def date_effect(spark, sf):
    """Every example is scored in scheme B, and those that ``_pred`` gives to scheme A in A as well; in B those with even ids are taken as predicted right."""
    got = _pred(spark, sf)
    right = F.when(F.col("vec_id") % 2 == 0, F.col("label")).otherwise(F.col("predicted"))
    got = got.where("scheme = 'A'").unionByName(got.withColumn("predicted", right).withColumn("scheme", F.lit("B")))
    return evaluation.date_effect(got).select(*r6("date_effect"), "repeats")


@query("""SELECT p_partkey, upper(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS label, replace(lower(trim(p_name)), ' ', '') AS key, regexp_replace(lower(p_name), '[^a-z0-9]', '_', 'g') AS slug,
  'M_' || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 4, '0') ELSE CAST(p_partkey AS VARCHAR) END AS subject, regexp_replace(p_brand || ' + ' || p_type, '\\s+', '', 'g') AS dose FROM part""")
def label_normalise(spark, sf):
    p = adapters.read(spark, sf, "part")
    name = F.col("p_name")
    return p.select(
        "p_partkey", fn.compound_label(name).alias("label"), fn.compound_key(name).alias("key"), fn.slug(name).alias("slug"),
        fn.subject_key(F.lit("M"), F.col("p_partkey")).alias("subject"), fn.dose_label(F.concat_ws(" + ", "p_brand", "p_type")).alias("dose"),
    )


@query("""WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '-' WHEN c_custkey % 11 = 0 THEN '  ' ELSE CAST(c_custkey AS VARCHAR) END AS cell FROM customer)
SELECT c_custkey, CASE WHEN trim(cell) = '' THEN NULL WHEN trim(cell) = '-' THEN 0.0::DOUBLE ELSE CAST(cell AS DOUBLE) END AS distance, CASE WHEN trim(cell) IN ('', '-') THEN NULL ELSE CAST(cell AS DOUBLE) END AS speed,
  try_strptime('20' || lpad(CAST(240000 + c_custkey AS VARCHAR), 6, '0'), '%Y%m%d')::DATE AS day FROM t""")
def cell_parse(spark, sf):
    key = F.col("c_custkey")
    cell = F.when(key % 7 == 0, "-").when(key % 11 == 0, "  ").otherwise(key.cast("string"))
    return adapters.read(spark, sf, "customer").select(
        "c_custkey", fn.measured(cell, 0.0).alias("distance"), fn.measured(cell, None).alias("speed"), fn.parse_yymmdd(key + 240000).alias("day")
    )


@query("""WITH r AS (SELECT *, CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN '.0' ELSE ' ' END AS b FROM customer)
SELECT c_custkey, coalesce(try_cast(b AS DOUBLE) = CAST(c_custkey AS DOUBLE), trim(b) = CAST(c_custkey AS VARCHAR)) AS same FROM r""")
def same_label(spark, sf):
    a = F.col("c_custkey").cast("string")
    b = F.concat(a, F.when(F.col("c_custkey") % 2 == 0, ".0").otherwise(" "))
    return adapters.read(spark, sf, "customer").select("c_custkey", fn.same_label(a, b).alias("same"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
b AS (SELECT vec_id, least(e[1], e[3]) AS a0, least(e[2], e[4]) AS a1, greatest(e[1], e[3]) AS a2, greatest(e[2], e[4]) AS a3, least(e[5], e[7]) AS b0, least(e[6], e[8]) AS b1, greatest(e[5], e[7]) AS b2, greatest(e[6], e[8]) AS b3, e FROM v),
i AS (SELECT *, greatest(least(a2, b2) - greatest(a0, b0), 0) * greatest(least(a3, b3) - greatest(a1, b1), 0) AS x, (a2 - a0) * (a3 - a1) + (b2 - b0) * (b3 - b1) AS s FROM b)
SELECT vec_id, round(CASE WHEN s - x > 0 THEN x / (s - x) ELSE 0 END, 6) + 0 AS iou, round(CASE WHEN e[2] >= 0 THEN degrees(atan2(abs(e[1]), e[2])) ELSE 180 - degrees(atan2(abs(e[1]), -e[2])) END, 6) + 0 AS tilt FROM i""")
def box_iou(spark, sf):
    e = [F.element_at("embedding", k).cast("double") for k in range(1, 9)]
    a = F.array(F.least(e[0], e[2]), F.least(e[1], e[3]), F.greatest(e[0], e[2]), F.greatest(e[1], e[3]))
    b = F.array(F.least(e[4], e[6]), F.least(e[5], e[7]), F.greatest(e[4], e[6]), F.greatest(e[5], e[7]))
    got = adapters.read(spark, sf, "embeddings").select("vec_id", fn.box_iou(a, b).alias("iou"), fn.tilt_deg(e[0], e[1]).alias("tilt"))
    return got.select("vec_id", *r6("iou", "tilt"))


@query("""WITH t AS (SELECT user_id % 5 AS grp, CASE event_type WHEN 'click' THEN 'Controlled Swim' WHEN 'purchase' THEN 'Erratic Movement' WHEN 'view' THEN 'Freezing/Drift' END AS state FROM events),
c AS (SELECT grp, state, count(*) AS n FROM t WHERE state IS NOT NULL GROUP BY ALL), g AS (SELECT grp, sum(n) AS total FROM c GROUP BY grp),
q AS (SELECT * FROM (VALUES ('Controlled Swim', 0.5), ('Erratic Movement', 0.2), ('Freezing/Drift', 0.3)) v(state, q))
SELECT g.grp, round(0.5 * sum(abs(coalesce(c.n, 0) / g.total - q.q)), 6) + 0 AS tv FROM g CROSS JOIN q LEFT JOIN c ON c.grp = g.grp AND c.state = q.state GROUP BY g.grp""")
def tv_distance(spark, sf):
    kind = F.col("event_type")
    state = F.when(kind == "click", "Controlled Swim").when(kind == "purchase", "Erratic Movement").when(kind == "view", "Freezing/Drift").otherwise("Undetermined")
    rows = adapters.read(spark, sf, "events").select((F.col("user_id") % 5).alias("grp"), state.alias("state"))
    kept = {"Controlled Swim": 0.5, "Erratic Movement": 0.2, "Freezing/Drift": 0.3}
    target = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(q).alias("proportion")) for s, q in kept.items()])
    targets = rows.select("grp").distinct().select("grp", F.inline(target))
    return calibrate.total_variation(calibrate.proportions(rows, "grp", list(kept)), targets, "grp").select("grp", *r6("tv"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey * 37) % 256 AS r, (l_suppkey * 91) % 256 AS g, (l_orderkey * 17) % 256 AS b FROM lineitem),
h AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM p),
v AS (SELECT *, CASE WHEN d = 0 THEN 0.0 WHEN hi = r THEN ((60.0 * (g - b) / d) % 360.0 + 360.0) % 360.0 WHEN hi = g THEN 120.0 + 60.0 * (b - r) / d ELSE 240.0 + 60.0 * (r - g) / d END / 2 AS hue,
  CASE WHEN hi = 0 THEN 0.0 ELSE 255.0 * d / hi END AS sat FROM h)
SELECT CASE WHEN hi < 40 THEN 3 WHEN sat < 40 THEN 2 WHEN hue BETWEEN 40 AND 85 THEN 1 WHEN hue < 20 OR hue > 160 THEN 0 ELSE -1 END AS colour, count(*) AS n FROM v GROUP BY ALL""")
def hsv_classify(spark, sf):
    r, g, b = (F.col("l_partkey") * 37) % 256, (F.col("l_suppkey") * 91) % 256, (F.col("l_orderkey") * 17) % 256
    rows = adapters.read(spark, sf, "lineitem").select(r.alias("r"), g.alias("g"), b.alias("b"))
    h, s, v = fn.hsv(*map(F.col, "rgb"))
    rows = rows.select(h.alias("hue"), s.alias("sat"), v.alias("val"))
    h, s, v = map(F.col, ("hue", "sat", "val"))
    rules = [((h < 20) | (h > 160), 0), (h.between(40, 85), 1), (s < 40, 2), (v < 40, 3)]
    return rows.select(fn.last_rule(rules).alias("colour")).groupBy("colour").agg(F.count("*").alias("n"))


@query("""SELECT l_suppkey, l_quantity, l_discount, count(*) AS copies, CAST(min(l_orderkey) AS BIGINT) AS first_order FROM lineitem GROUP BY l_suppkey, l_quantity, l_discount HAVING count(*) > 1""")
def dedupe_audit(spark, sf):
    got = catalog.duplicate_groups(adapters.read(spark, sf, "lineitem"), ["l_suppkey", "l_quantity", "l_discount"], "l_orderkey")
    return got.select("l_suppkey", "l_quantity", "l_discount", F.size("rows").cast("long").alias("copies"), F.col("rows")[0].alias("first_order"))


_MATCH = """WITH tr AS (SELECT p_size AS k, CAST(p_partkey AS BIGINT) AS trial FROM part),
vi AS (SELECT CAST(s_nationkey + 1 AS INTEGER) * 2 AS k, CAST(s_suppkey AS BIGINT) AS video FROM supplier),
t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY trial) AS n FROM tr), v AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY video) AS n FROM vi)
"""


def _trials(spark, sf):
    t = adapters.read(spark, sf, "part").select(F.col("p_size").alias("k"), F.col("p_partkey").alias("trial"))
    return t, adapters.read(spark, sf, "supplier").select(((F.col("s_nationkey") + 1) * 2).alias("k"), F.col("s_suppkey").alias("video"))


@query(_MATCH + """SELECT t.k, t.trial, CASE WHEN t.n = 1 THEN f.video END AS video, CASE WHEN f.video IS NULL THEN 'unmatched_trial' WHEN t.n = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM t LEFT JOIN (SELECT * FROM v WHERE n = 1) f ON f.k = t.k
UNION ALL SELECT k, NULL, video, CASE WHEN n > 1 THEN 'duplicate_video' ELSE 'unmatched_video' END FROM v WHERE n > 1 OR k NOT IN (SELECT k FROM tr)""")
def first_wins_match(spark, sf):
    return catalog.match_first(*_trials(spark, sf), ["k"], "trial", "video")


@query(_MATCH + "SELECT DISTINCT k, 'trial' AS side FROM tr WHERE k NOT IN (SELECT k FROM vi) UNION ALL SELECT DISTINCT k, 'video' FROM vi WHERE k NOT IN (SELECT k FROM tr)")
def unmatched_keys(spark, sf):
    return catalog.unmatched(*_trials(spark, sf), ["k"])


@query("""WITH m AS (SELECT 'F_' || CAST(c_custkey AS VARCHAR) AS video_id, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 20.0::DOUBLE END AS minutes, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 1200 + (c_custkey % 80) - 40.0::DOUBLE END AS duration_s FROM customer)
SELECT video_id, CASE WHEN duration_s IS NULL THEN 'corrupt' ELSE 'mismatch' END AS kind, minutes * 60 AS expected_s, duration_s FROM m WHERE duration_s IS NULL OR minutes IS NULL OR abs(duration_s - minutes * 60) > 30""")
def duration_mismatches(spark, sf):
    k = F.col("c_custkey")
    m = adapters.read(spark, sf, "customer").select(
        F.concat(F.lit("F_"), k.cast("string")).alias("video_id"), F.when(k % 13 != 0, F.lit(20.0)).alias("minutes"),
        F.when(k % 17 != 0, 1200 + (k % 80) - F.lit(40.0)).alias("duration_s"),
    )
    return catalog.duration_mismatches(m)


@query()
def greedy_sample(spark, sf):
    """Spaced candidates of each subject; order-dependent, tested by its properties."""
    t = adapters.tracks(spark, sf)
    return design.greedy_sample(design.candidates(t, 1, 2, 10), 6, 4, 11)


_SETS = [
    {"freeze": 3.0, "min_freeze_s": 8.0, "erratic": 6.0, "surface_depth": 20.0, "min_dead_s": 8.0}, {"freeze": 1.0, "min_freeze_s": 2.0, "erratic": 12.0, "surface_depth": 20.0, "min_dead_s": 8.0},
    {"freeze": 8.0, "min_freeze_s": 20.0, "erratic": 9.0, "surface_depth": 40.0, "min_dead_s": 30.0}, {"freeze": 9.0, "min_freeze_s": 2.0, "erratic": 9.0, "surface_depth": 0.0, "min_dead_s": 8.0},
]
_TARGETS = [("even", 0.4, 0.2, 0.3, 0.05), ("odd", 0.2, 0.4, 0.2, 0.2)]
_KEPT = ["Controlled Swim", "Erratic Movement", "Freezing/Drift", "Surface Breach"]


def _set_sql() -> str:
    sets = ", ".join(f"({i}, {', '.join(f'{float(v)}::DOUBLE' for v in s.values())})" for i, s in enumerate(_SETS))
    states = STATES[len(SPEED) :].replace("PARTITION BY video_id", "PARTITION BY sid, video_id").replace("FROM spd)", "FROM spx)")
    for old, new in (("speed <= 3.0", "speed <= fz"), ("span >= 8.0 AS is_dead", "span >= dd AS is_dead"), ("y_from_frame_top <= 20.0", "y_from_frame_top <= dp"), ("still AND span >= 8.0 THEN", "still AND span >= fz_s THEN"), ("speed >= 6.0", "speed >= er")):
        assert old in states
        states = states.replace(old, new)
    q = ", ".join(f"('{g}', {', '.join(f'{x / sum(qs)}::DOUBLE' for x in qs)})" for g, *qs in _TARGETS)
    return (
        TRACKS + SPEED + f"ps_(sid, fz, fz_s, er, dp, dd) AS (VALUES {sets}), spx AS (SELECT * FROM spd, ps_ WHERE er > fz)," + states
        + f"""ct AS (SELECT sid, CASE WHEN CAST(substr(video_id, 3) AS INTEGER) % 2 = 0 THEN 'even' ELSE 'odd' END AS grp, count(*) AS total, count(*) FILTER (state <> 'Undetermined') AS known,
  {", ".join(f"count(*) FILTER (state = '{k}') AS n{i}" for i, k in enumerate(_KEPT))} FROM st GROUP BY ALL),
tg(grp, q0, q1, q2, q3) AS (VALUES {q})
SELECT CAST(sid AS INTEGER) AS set_no, ct.grp, round(0.5 * ({" + ".join(f"abs(n{i} / (n0 + n1 + n2 + n3) - q{i})" for i in range(4))}), 6) + 0 AS tv, round(known / total, 6) + 0 AS coverage, n0 + n1 + n2 + n3 AS scored
FROM ct JOIN tg ON tg.grp = ct.grp"""
    )


def _with_speed(spark, sf, sets: int = 1) -> tuple[DataFrame, int]:
    """Tracks with speed and group, dealt for ``sets`` parameter sets, and their number of rows."""
    from ethogrid.operators import kinematics

    rows = adapters.read(spark, sf, "events").count()
    parts = calibrate.dealt(rows, sets, spark.sparkContext.defaultParallelism)
    t = kinematics.smoothed_speed(adapters.tracks(spark, sf, parts), 24.0)
    t = t.withColumn("grp", F.when(F.substring("video_id", 3, 10).cast("int") % 2 == 0, "even").otherwise("odd"))
    return t, rows


def _targets(spark) -> DataFrame:
    return spark.createDataFrame([(g, s, float(q)) for g, *qs in _TARGETS for s, q in zip(_KEPT, qs, strict=True)], "grp string, state string, proportion double")


@query(_set_sql())
def parameter_scores(spark, sf):
    """Distance from the target shares and coverage of four parameter sets in both groups, labelled in one job."""
    tracks, rows = _with_speed(spark, sf, len(_SETS))
    return calibrate.score_sets(tracks, _targets(spark), _SETS, _KEPT, rows=rows).select("set_no", "grp", *r6("tv", "coverage"), "scored")


@query()
def threshold_search(spark, sf):
    """The thresholds whose states, in bins, come closest to the target shares; each batch of sets is one job over all tracks."""
    objective = calibrate.sets_objective(written(_with_speed(spark, sf)[0], "speed"), _targets(spark), _KEPT, {"surface_depth": 20.0, "min_dead_s": 8.0}, 24.0)
    ranges = {"freeze": (0.1, 10.0), "min_freeze_s": (0.5, 30.0), "erratic": (0.1, 40.0)}
    best, tv = calibrate.search(objective, ranges, 8, 2, 1, ("freeze", "min_freeze_s", "erratic"), {"freeze": 3.0, "min_freeze_s": 8.0, "erratic": 6.0})
    return spark.createDataFrame([(round(best["freeze"], 6), round(best["min_freeze_s"], 6), round(best["erratic"], 6), round(tv, 6))], "freeze double, min_freeze_s double, erratic double, tv double")
