"""Queries for the keyed bank: one batch step (J8) and the streaming forms (K1-K3)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from noisesift import fixtures
from noisesift.fixtures import with_views
from noisesift.plans.contrast_plans import DIM, N_CLASSES
from noisesift.plans.registry import ORACLES, register
from noisesift.streaming import bank

K, TTU = 8, 3.0


def _rows(spark: SparkSession, d: str):
    w = fixtures.weighted(spark, d)
    return w.select(F.col("label").cast("int").alias("class"), "batch_id", "vec_id", "w", F.col("embedding").alias("vec"))


# One step from the start state: every slot has score 1 and life TTU (> 1), and every
# weight is below 1, so the weight policy pairs slots (all tied, slot order) with the
# K smallest rows by (w, vec_id); nothing expires.
J8_SQL = with_views("weighted") + f"""
SELECT CAST(label AS INT) AS class, CAST(rn - 1 AS INT) AS slot, vec_id, w AS score, CAST({TTU} AS DOUBLE) AS life FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY w, vec_id) AS rn FROM weighted) WHERE rn <= {K}"""


@register("j8_bank_apply_batch", J8_SQL)
def j8_bank_apply_batch(spark: SparkSession, d: str):
    start = bank.initial_bank_df(spark, N_CLASSES, K, DIM, TTU)
    out = bank.bank_apply_batch(start, _rows(spark, d), "weight", TTU, K)
    return out.select("class", "slot", "vec_id", "score", "life")


@register("k1_stream_bank_weight")
def k1_stream_bank_weight(spark: SparkSession, d: str):
    src = bank.stage_stream_source(spark, _rows(spark, d))
    return bank.stream_bank(spark, src, "weight", TTU, K, DIM).select("class", "slot", "vec_id", "score", "life", "last_batch")


@register("k2_stream_bank_time")
def k2_stream_bank_time(spark: SparkSession, d: str):
    src = bank.stage_stream_source(spark, _rows(spark, d))
    return bank.stream_bank(spark, src, "time", TTU, K, DIM).select("class", "slot", "vec_id", "score", "life", "last_batch")


@register("k3_stream_profile", ORACLES["j9_momentum_profile"])
def k3_stream_profile(spark: SparkSession, d: str):
    src = bank.stage_stream_source(spark, _rows(spark, d))
    out = bank.stream_profile(spark, src, 0.9)
    return out.select("class", F.col("dim").cast("int").alias("dim"), F.round("profile", 6).alias("profile"))


# The same over micro-batches of one file each, some batches split over two of them.
FILES = 12


@register("k1_stream_bank_weight_batches")
def k1_stream_bank_weight_batches(spark: SparkSession, d: str):
    src = bank.stage_stream_files(spark, _rows(spark, d), FILES)
    return bank.stream_bank(spark, src, "weight", TTU, K, DIM, files_per_trigger=1).select("class", "slot", "vec_id", "score", "life", "last_batch")


@register("k2_stream_bank_time_batches")
def k2_stream_bank_time_batches(spark: SparkSession, d: str):
    src = bank.stage_stream_files(spark, _rows(spark, d), FILES)
    return bank.stream_bank(spark, src, "time", TTU, K, DIM, files_per_trigger=1).select("class", "slot", "vec_id", "score", "life", "last_batch")


@register("k3_stream_profile_batches", ORACLES["j9_momentum_profile"])
def k3_stream_profile_batches(spark: SparkSession, d: str):
    src = bank.stage_stream_files(spark, _rows(spark, d), FILES)
    out = bank.stream_profile(spark, src, 0.9, files_per_trigger=1)
    return out.select("class", F.col("dim").cast("int").alias("dim"), F.round("profile", 6).alias("profile"))


# --------------------------------------------------------------- K1 / K2 oracles
# The bank replayed in SQL: a recursive CTE whose working table is every class's K
# slots after step t (t = the class's t-th batch in order). Each step ranks slots
# and new rows with windows and fetches the paired rows by rank.
_STEPS_SQL = """
, rws AS (SELECT CAST(label AS INT) AS class, batch_id, vec_id, w FROM weighted),
steps AS (SELECT class, batch_id, CAST(row_number() OVER (PARTITION BY class ORDER BY batch_id) - 1 AS BIGINT) AS t
          FROM (SELECT DISTINCT class, batch_id FROM rws)),
nr AS (SELECT r.class, s.t, r.vec_id, r.w, row_number() OVER (PARTITION BY r.class, s.t ORDER BY r.w, r.vec_id) - 1 AS a,
              count(*) OVER (PARTITION BY r.class, s.t) AS n
       FROM rws r JOIN steps s ON r.class = s.class AND r.batch_id = s.batch_id),
cnt AS (SELECT DISTINCT class, t, n FROM nr),
st(t, class, slot, vid, score, life) AS (
  SELECT 0::BIGINT, c.class, s.slot::BIGINT, (-1 - s.slot)::BIGINT, 1.0::DOUBLE, @TTU::DOUBLE
  FROM (SELECT DISTINCT class FROM rws) c, range(@K) s(slot)
  UNION ALL
  SELECT z.t + 1, z.class, z.slot, coalesce(z.rep_a, z.vid),
         CASE WHEN z.rep_a IS NULL THEN z.score ELSE z.rep_w END, CASE WHEN z.rep_a IS NULL THEN z.l1 ELSE @TTU END
  FROM (
    SELECT y.*, (SELECT nr.vec_id FROM nr WHERE nr.class = y.class AND nr.t = y.t AND nr.a = y.pick) AS rep_a,
                (SELECT nr.w FROM nr WHERE nr.class = y.class AND nr.t = y.t AND nr.a = y.pick) AS rep_w
    FROM (@PICK) y) z
),
last AS (SELECT class, max(t) AS t FROM st GROUP BY class),
lb AS (SELECT class, max(batch_id) AS last_batch FROM rws GROUP BY class)
SELECT s.class, CAST(s.slot AS INT) AS slot, s.vid AS vec_id, s.score, s.life, lb.last_batch
FROM st s JOIN last USING (class, t) JOIN lb USING (class)"""

# time policy: expired slots (oldest first) take the largest rows; the rest pair live slots (score desc) with rows (asc).
_PICK_TIME = """
SELECT x.*, CASE WHEN x.is_exp AND x.er < x.tc THEN x.n - x.tc + x.er WHEN NOT x.is_exp AND x.lr < x.m THEN x.lr END AS pick
FROM (
  SELECT v.*, least(sum(CASE WHEN NOT v.is_exp AND v.score > v.wmin THEN 1 ELSE 0 END) OVER (PARTITION BY v.class),
                    (SELECT count(*) FROM nr WHERE nr.class = v.class AND nr.t = v.t AND nr.a < v.n - v.tc AND nr.w < v.max_live)) AS m
  FROM (
    SELECT u.*, least(u.ne, u.n) AS tc FROM (
      SELECT p.t, p.class, p.slot, p.vid, p.score, p.life - 1 AS l1, (p.life - 1 <= 0) AS is_exp,
             row_number() OVER (PARTITION BY p.class, (p.life - 1 <= 0) ORDER BY p.life, p.slot) - 1 AS er,
             row_number() OVER (PARTITION BY p.class, (p.life - 1 <= 0) ORDER BY p.score DESC, p.slot) - 1 AS lr,
             sum(CASE WHEN p.life - 1 <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY p.class) AS ne,
             max(CASE WHEN p.life - 1 > 0 THEN p.score END) OVER (PARTITION BY p.class) AS max_live, c.n,
             (SELECT nr.w FROM nr WHERE nr.class = p.class AND nr.t = p.t AND nr.a = 0) AS wmin
      FROM st p JOIN cnt c ON c.class = p.class AND c.t = p.t) u) v) x"""

# weight policy: all slots (score desc) pair with rows (asc) first; leftover rows fill expired slots, oldest first.
_PICK_WEIGHT = """
SELECT x.*, CASE WHEN x.lr < x.m THEN x.lr WHEN x.exp2 AND x.er2 < least(x.ne2, x.n - x.m) THEN x.m + x.er2 END AS pick
FROM (
  SELECT v.*, (v.lr >= v.m AND v.l1 <= 0) AS exp2,
         row_number() OVER (PARTITION BY v.class, (v.lr >= v.m AND v.l1 <= 0) ORDER BY v.l1, v.slot) - 1 AS er2,
         sum(CASE WHEN v.lr >= v.m AND v.l1 <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY v.class) AS ne2
  FROM (
    SELECT u.*, least(sum(CASE WHEN u.score > u.wmin THEN 1 ELSE 0 END) OVER (PARTITION BY u.class),
                      (SELECT count(*) FROM nr WHERE nr.class = u.class AND nr.t = u.t AND nr.w < u.max_score)) AS m
    FROM (
      SELECT p.t, p.class, p.slot, p.vid, p.score, p.life - 1 AS l1,
             row_number() OVER (PARTITION BY p.class ORDER BY p.score DESC, p.slot) - 1 AS lr,
             max(p.score) OVER (PARTITION BY p.class) AS max_score, c.n,
             (SELECT nr.w FROM nr WHERE nr.class = p.class AND nr.t = p.t AND nr.a = 0) AS wmin
      FROM st p JOIN cnt c ON c.class = p.class AND c.t = p.t) u) v) x"""


def bank_oracle_sql(policy: str) -> str:
    body = _STEPS_SQL.replace("@PICK", _PICK_TIME if policy == "time" else _PICK_WEIGHT)
    body = body.replace("@TTU", repr(float(TTU))).replace("@K", str(K))
    return with_views("weighted").replace("WITH ", "WITH RECURSIVE ", 1) + body


ORACLES["k1_stream_bank_weight"] = bank_oracle_sql("weight")
ORACLES["k2_stream_bank_time"] = bank_oracle_sql("time")
ORACLES["k1_stream_bank_weight_batches"] = ORACLES["k1_stream_bank_weight"]
ORACLES["k2_stream_bank_time_batches"] = ORACLES["k2_stream_bank_time"]
