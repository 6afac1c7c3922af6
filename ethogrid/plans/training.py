"""Queries of folds, training tasks, saved models and studies over the subject table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid.functions.scalars import epoch_of
from ethogrid.operators import artifact, evaluation, folds as folding, studies, training
from ethogrid.operators.networks import Settings
from ethogrid.plans.behaviour import r6
from ethogrid.plans.subjects import FEATURES, FISH, VEHICLE
from ethogrid.sources import adapters
from ethogrid.sources.tables import new_folder, written

QUERIES: dict = {}
ORACLE: dict = {}
SETTINGS = Settings(hidden=(16, 8), rate=5e-3, batch=64, epochs=40, patience=6, members=3)
GROUPS = {"prices": ["f_mean_price", "f_max_price"], "sex": ["sex"]}
USED = {"prices": True, "sex": False}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# Scheme A as a recursion over the dates, largest first: `have` holds each fold's counts of each label, the cost of a fold is how far it moves from a k-th of all.
FOLDS = FISH.replace("WITH ", "WITH RECURSIVE ", 1) + """,
rp AS (SELECT unnest(range(0, 2)) AS repeat), s AS (SELECT video_id, compound AS label, CAST(date AS VARCHAR) AS day FROM fish),
sp AS (SELECT label, count(DISTINCT day) AS days, count(*) AS n FROM s GROUP BY label),
lb AS (SELECT label, n, row_number() OVER (ORDER BY label) AS c FROM sp WHERE days > 1), nl AS (SELECT list(n ORDER BY c) AS whole, count(*) AS nc, max(n) AS most FROM lb),
dy AS (SELECT DISTINCT day FROM s JOIN lb USING (label)), k AS (SELECT least(5, count(*), (SELECT most FROM nl)) AS k FROM dy),
cn AS (SELECT dy.day, lb.c, coalesce(x.n, 0) AS n FROM dy CROSS JOIN lb LEFT JOIN (SELECT day, label, count(*) AS n FROM s GROUP BY ALL) x ON x.day = dy.day AND x.label = lb.label),
dv AS (SELECT day, list(n ORDER BY c) AS v, sum(n) AS size FROM cn GROUP BY day),
od AS (SELECT repeat, day, v, size, row_number() OVER (PARTITION BY repeat ORDER BY size DESC, sha256('1:' || repeat || ':' || day)) AS step FROM dv, rp),
rec AS (SELECT repeat, CAST(0 AS BIGINT) AS step, '' AS day, CAST(-1 AS BIGINT) AS fold, list_transform(range(0, k), lambda f: list_transform(range(0, nc), lambda c: CAST(0 AS BIGINT))) AS have FROM rp, k, nl
  UNION ALL
  SELECT repeat, step, day, best - 1, list_transform(range(1, CAST(k + 1 AS BIGINT)), lambda f: CASE WHEN f = best THEN list_transform(range(1, CAST(nc + 1 AS BIGINT)), lambda c: CAST(have[f][c] + v[c] AS BIGINT)) ELSE have[f] END) FROM (
    SELECT r.repeat, o.step, o.day, r.have, o.v, k.k, nl.nc, CAST(list_min(list_transform(range(1, CAST(k.k + 1 AS BIGINT)), lambda f: (
        CAST(list_sum(list_transform(range(1, CAST(nl.nc + 1 AS BIGINT)), lambda c: o.v[c] * (2 * k.k * r.have[f][c] - 2 * nl.whole[c] + k.k * o.v[c]))) AS HUGEINT) * 1000000 + CAST(list_sum(r.have[f]) AS HUGEINT)) * 100 + f)) % 100 + 100 AS BIGINT) % 100 AS best
    FROM rec r JOIN od o ON o.repeat = r.repeat AND o.step = r.step + 1, k, nl)),
pl AS (SELECT s.video_id, s.label, s.day, coalesce(sp.days = 1, false) AS pinned, sp.n, sum(0) OVER () AS z FROM s JOIN sp USING (label)),
st AS (SELECT label, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, least(5, max(n) OVER ()) AS kb FROM sp),
fo AS (SELECT 'A' AS scheme, CAST(rp.repeat AS INTEGER) AS repeat, pl.video_id, CAST(CASE WHEN pl.pinned THEN -1 ELSE rec.fold END AS INTEGER) AS fold FROM pl CROSS JOIN rp LEFT JOIN rec ON rec.repeat = rp.repeat AND rec.day = pl.day AND rec.step > 0
  UNION ALL SELECT 'B', CAST(repeat AS INTEGER), video_id, CAST((row_number() OVER (PARTITION BY repeat, s.label ORDER BY sha256('1:' || repeat || ':' || video_id), video_id) - 1 + start) % kb AS INTEGER) FROM s JOIN st ON st.label = s.label CROSS JOIN rp)
"""


def _labelled(spark, sf) -> DataFrame:
    return adapters.subjects(spark, sf).withColumn("label", F.col("compound"))


def _folds(spark, sf) -> DataFrame:
    return folding.folds(_labelled(spark, sf), 5, 2, 1)


@query(FOLDS + "SELECT scheme, repeat, video_id, fold FROM fo")
def folds(spark, sf):
    """Both schemes and two repeats for every subject."""
    return _folds(spark, sf)


@query(FOLDS + """, j AS (SELECT fo.*, s.label, CAST(s.day AS DATE) AS date FROM fo JOIN s USING (video_id)), rn AS (SELECT DISTINCT scheme, repeat, fold FROM fo WHERE fold >= 0),
tr AS (SELECT rn.scheme, rn.repeat, rn.fold, j.label, j.date, count(*) AS n FROM rn JOIN j ON j.scheme = rn.scheme AND j.repeat = rn.repeat AND j.fold <> rn.fold GROUP BY ALL),
pr AS (SELECT scheme, repeat, fold, label AS cls, sum(n) / sum(sum(n)) OVER (PARTITION BY scheme, repeat, fold) AS p FROM tr GROUP BY scheme, repeat, fold, label),
td AS (SELECT DISTINCT scheme, repeat, fold, date FROM tr), qd AS (SELECT DISTINCT scheme, repeat, fold, date FROM j WHERE fold >= 0),
nr AS (SELECT * FROM (SELECT q.*, t.date AS near, row_number() OVER (PARTITION BY q.scheme, q.repeat, q.fold, q.date ORDER BY abs(date_diff('day', q.date, t.date)), t.date) AS o FROM qd q JOIN td t ON t.scheme = q.scheme AND t.repeat = q.repeat AND t.fold = q.fold) WHERE o = 1),
dm AS (SELECT nr.scheme, nr.repeat, nr.fold, nr.date, pr.cls, coalesce(sum(tr.n) FILTER (tr.label = pr.cls), 0) / sum(tr.n) AS p
  FROM nr JOIN pr ON pr.scheme = nr.scheme AND pr.repeat = nr.repeat AND pr.fold = nr.fold JOIN tr ON tr.scheme = nr.scheme AND tr.repeat = nr.repeat AND tr.fold = nr.fold AND tr.date = nr.near GROUP BY ALL)
SELECT j.scheme, j.repeat, j.fold, 'majority' AS model, j.video_id, j.label, pr.cls, round(pr.p, 6) + 0 AS p FROM j JOIN pr ON pr.scheme = j.scheme AND pr.repeat = j.repeat AND pr.fold = j.fold
UNION ALL SELECT j.scheme, j.repeat, j.fold, 'date_only', j.video_id, j.label, dm.cls, round(dm.p, 6) + 0 FROM j JOIN dm ON dm.scheme = j.scheme AND dm.repeat = j.repeat AND dm.fold = j.fold AND dm.date = j.date""")
def baseline_predictions(spark, sf):
    """Out-of-fold probabilities of the two baselines, as training tasks."""
    rows = training.as_rows(_labelled(spark, sf), FEATURES, ["sex"])
    long = training.cross_fit(rows, _folds(spark, sf), models=("majority", "date_only"), seed=1)
    return long.select("scheme", "repeat", "fold", "model", "video_id", "label", "cls", *r6("p"))


@query()
def model_scores(spark, sf):
    """All four models over both schemes: scores of each repeat."""
    rows = training.as_rows(_labelled(spark, sf), FEATURES, ["sex"])
    sums = training.cross_tally(rows, _folds(spark, sf), log=[FEATURES.index("f_orders")], settings=SETTINGS, seed=1)
    return evaluation.tally_metrics(sums, ("model", "scheme", "repeat"))


@query()
def network_predictions(spark, sf):
    """Probabilities of a network ensemble over scheme B, averaged over its members."""
    rows = training.as_rows(_labelled(spark, sf), FEATURES, ["sex"])
    return training.cross_fit(rows, _folds(spark, sf).where("scheme = 'B' AND repeat = 0"), models=("network",), log=[FEATURES.index("f_orders")], settings=SETTINGS, seed=1)


_SETUPS = ["2024-01-05", "2024-01-09"]


@query()
def ablations(spark, sf):
    """Prices left out, sex added, and the vehicle pair: changes of balanced accuracy."""
    setup = epoch_of(F.col("date"), _SETUPS).cast("string")
    got = studies.run_ablations(_labelled(spark, sf), FEATURES, ["sex"], GROUPS, USED, VEHICLE, ["f_orders"], ("majority", "date_only", "logistic"), 5, 2, SETTINGS, 1, setup)
    return studies.ablation_report(written(got, "ablations"))


@query()
def dose_models(spark, sf):
    """One dose model for each compound: raw, permuted and normalised scores side by side."""
    setup = epoch_of(F.col("date"), _SETUPS).cast("string")
    return studies.dose_scores(_labelled(spark, sf), FEATURES, ["sex"], VEHICLE, ["f_orders"], ("date_only", "logistic"), 5, 2, SETTINGS, 1, setup=setup)


@query(FISH + """, e AS (SELECT *, 1 + CASE WHEN date >= '2024-01-05' THEN 1 ELSE 0 END + CASE WHEN date >= '2024-01-09' THEN 1 ELSE 0 END AS setup, ln(1 + f_orders) AS l_orders FROM fish),
v AS (SELECT * FROM e WHERE compound = 'BUILDING'), a AS (SELECT date, count(*) AS n, median(l_orders) AS x, median(f_mean_price) AS y FROM v GROUP BY date),
b AS (SELECT setup, count(*) AS n, median(l_orders) AS x, median(f_mean_price) AS y FROM v GROUP BY setup), c AS (SELECT median(l_orders) AS x, median(f_mean_price) AS y FROM v),
r AS (SELECT e.*, CASE WHEN a.n >= 25 THEN 'date' WHEN b.n >= 25 THEN 'setup' ELSE 'all' END AS reference, CASE WHEN a.n >= 25 THEN a.x WHEN b.n >= 25 THEN b.x ELSE c.x END AS x, CASE WHEN a.n >= 25 THEN a.y WHEN b.n >= 25 THEN b.y ELSE c.y END AS y
  FROM e LEFT JOIN a ON a.date = e.date LEFT JOIN b ON b.setup = e.setup CROSS JOIN c)
SELECT video_id, reference, round(l_orders - x, 6) + 0 AS n_f_orders, round(f_mean_price - y, 6) + 0 AS n_f_mean_price FROM r""")
def vehicle_reference(spark, sf):
    """Features minus the vehicle medians of the date, the setup or all, in one pass for all features."""
    names = ["f_orders", "f_mean_price"]
    got = studies.minus_vehicle(studies.logged(_labelled(spark, sf), names, ["f_orders"]), names, VEHICLE, epoch_of(F.col("date"), _SETUPS).cast("string"), least=25)
    return got.select("video_id", "reference", *r6("n_f_orders", "n_f_mean_price"))


@query(FISH + """, n AS (SELECT date, compound, count(*) AS n FROM fish GROUP BY ALL), t AS (SELECT date, sum(n) AS n FROM n GROUP BY date), c AS (SELECT DISTINCT compound FROM fish)
SELECT f.video_id, c.compound AS cls, round(coalesce(n.n, 0) / t.n, 6) + 0 AS p FROM fish f CROSS JOIN c JOIN t ON t.date = f.date LEFT JOIN n ON n.date = f.date AND n.compound = c.compound""")
def saved_model(spark, sf):
    """A date model fitted on all subjects, saved, loaded and applied."""
    folder = new_folder(spark, "model")
    artifact.save_model(_labelled(spark, sf), folder, "date_only", FEATURES, ["sex"], seed=1)
    return artifact.load_model(spark, folder).predict(_labelled(spark, sf)).select("video_id", "cls", *r6("p"))


@query(FISH + "SELECT 0.0::DOUBLE AS gap, count(*) AS shared FROM fish")
def reloaded_network(spark, sf):
    """Largest difference of a saved network's probabilities from its reference predictions."""
    folder = new_folder(spark, "model")
    table = _labelled(spark, sf)
    artifact.save_model(table, folder, "network", FEATURES, ["sex"], ["f_orders"], SETTINGS, 1)
    return artifact.load_model(spark, folder).gap(table)
