"""Queries for reweighting and contrastive jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from noisesift import fixtures
from noisesift.fixtures import with_views
from noisesift.functions.metrics import cross_entropy
from noisesift.operators import contrast, sampling, tiles, weights
from noisesift.operators.ranking import hash_fraction
from noisesift.plans.registry import register
from noisesift.plans.sampling_plans import hexfrac_sql
from noisesift.plans.shaping import BANK8_SQL

DIM = 64
N_CLASSES = 10
T_INFO = 0.5
T_SC, T_BASE = 0.5, 0.07
ETA = 0.5


def _w(spark: SparkSession, d: str):
    return fixtures.weighted(spark, d).withColumnRenamed("label", "class")


def _lst(v) -> str:
    return "[" + ", ".join(repr(float(x)) for x in np.ravel(v)) + "]::DOUBLE[]"


def gate_sql(p: weights.GateParams, x: str, y: str) -> str:
    """DuckDB text of the J1 gate (single output) for the same parameters."""
    emb = "[" + ", ".join(_lst(r) for r in p.class_emb) + "]"
    inp = f"({emb}[{y} + 1] || {x})"
    hidden = [f"greatest(list_dot_product({_lst(p.w1[h])}, {inp}) + {float(p.b1[h])!r}, 0.0)" for h in range(p.w1.shape[0])]
    z = " + ".join(f"{float(p.w2[0][h])!r} * {hidden[h]}" for h in range(len(hidden))) + f" + {float(p.b2[0])!r}"
    return f"(1.0 / (1.0 + exp(-({z}))) * {float(p.scale)!r})"


GATE = weights.formula_gate(N_CLASSES, DIM)
GATE2 = weights.formula_gate(2, DIM)


# ------------------------------------------------------------------ H6, H7, J7
TOPR_SQL = """
, tr AS (SELECT vec_id, batch_id, label, w FROM (
           SELECT *, row_number() OVER (PARTITION BY batch_id, label ORDER BY w DESC, vec_id) AS rn,
                  count(*) OVER (PARTITION BY batch_id, label) AS n FROM weighted)
         WHERE n <= 1 OR rn <= greatest(floor(0.5 * n), 1))"""


@register("h6_top_ratio", with_views("weighted") + TOPR_SQL + " SELECT vec_id, batch_id, label AS class, w FROM tr")
def h6_top_ratio(spark: SparkSession, d: str):
    return contrast.top_ratio(_w(spark, d), 0.5).select("vec_id", "batch_id", "class", "w")


@register("h7_exclude_by_bank_max", with_views("weighted") + TOPR_SQL + "," + BANK8_SQL + """
, bm AS (SELECT label, max(w) AS m FROM bank WHERE w <> 1.0 GROUP BY label)
SELECT tr.vec_id, tr.label AS class, tr.w FROM tr LEFT JOIN bm ON tr.label = bm.label WHERE bm.m IS NULL OR tr.w > bm.m""")
def h7_exclude_by_bank_max(spark: SparkSession, d: str):
    w = _w(spark, d)
    bank = contrast.bank_topk(w.select("class", "vec_id", F.col("w").alias("score")), 8)
    return contrast.exclude_by_bank_max(contrast.top_ratio(w, 0.5), bank).select("vec_id", "class", "w")


@register("j7_bank_topk", with_views("weighted") + "," + BANK8_SQL + " SELECT label AS class, CAST(slot AS INT) AS slot, vec_id FROM bank")
def j7_bank_topk(spark: SparkSession, d: str):
    w = _w(spark, d).select("class", "vec_id", F.col("w").alias("score"))
    return contrast.bank_topk(w, 8).select("class", "slot", "vec_id")


# ------------------------------------------------------------------ J1-J3, J12
@register("j1_instance_weight", with_views("weighted") + f" SELECT vec_id, round({gate_sql(GATE, 'embedding', 'label')}, 6) AS weight FROM weighted")
def j1_instance_weight(spark: SparkSession, d: str):
    w = fixtures.weighted(spark, d)
    return weights.instance_weight(w, GATE, "embedding", "label", method="builtin").select("vec_id", F.round("weight", 6).alias("weight"))


@register("j1_instance_weight_arrow", with_views("weighted") + f" SELECT vec_id, round({gate_sql(GATE, 'embedding', 'label')}, 6) AS weight FROM weighted")
def j1_instance_weight_arrow(spark: SparkSession, d: str):
    w = fixtures.weighted(spark, d)
    return weights.instance_weight_arrow(w, GATE, "embedding", "label").select("vec_id", F.round("weight", 6).alias("weight"))


CE_PARTS_SQL = f"""
, lse AS (SELECT vec_id, label, w, logits, list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) - logits[label + 1] AS loss,
                 {hexfrac_sql('vec_id')} AS u FROM predictions)"""


@register("j2_weighted_loss", with_views("predictions") + CE_PARTS_SQL + """
SELECT avg(w * loss) FILTER (WHERE u >= 0.5) AS weighted_aug_loss, avg(loss) FILTER (WHERE u >= 0.5) AS aug_loss,
       avg(loss) FILTER (WHERE u < 0.5) AS clean_loss,
       (avg(w * loss) FILTER (WHERE u >= 0.5) + avg(loss) FILTER (WHERE u < 0.5)) / 2 AS blend FROM lse""")
def j2_weighted_loss(spark: SparkSession, d: str):
    p = fixtures.predictions(spark, d).select("w", cross_entropy("logits", "label").alias("loss"), hash_fraction("vec_id").alias("u"))
    return weights.weighted_loss(p.where(F.col("u") >= 0.5), p.where(F.col("u") < 0.5))


@register("j3_logit_weighted_loss", with_views("predictions") + """
, s AS (SELECT vec_id, label, list_transform(logits, lambda z, i: z * (w * i / 10.0)) AS z FROM predictions)
SELECT vec_id, round(list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) - z[label + 1], 6) AS loss FROM s""")
def j3_logit_weighted_loss(spark: SparkSession, d: str):
    p = fixtures.predictions(spark, d)
    cw = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.col("w") * i / F.lit(10.0))
    return p.select("vec_id", F.round(weights.logit_weighted_loss("logits", cw, "label"), 6).alias("loss"))


@register("j12_weight_ranking_loss", with_views("weighted") + f"""
, b AS (SELECT embedding, label % 2 AS y FROM weighted),
s AS (SELECT {gate_sql(GATE2, 'embedding', 'y')} AS wp, {gate_sql(GATE2, 'embedding', '(1 - y)')} AS wn FROM b)
SELECT -sum(wp - wn) AS rank_loss, avg(greatest(wp, wn) + ln(exp(wn - greatest(wp, wn)) + exp(wp - greatest(wp, wn))) - wp) AS ce_loss FROM s""")
def j12_weight_ranking_loss(spark: SparkSession, d: str):
    w = fixtures.weighted(spark, d).withColumn("y", F.col("label") % 2)
    return weights.weight_ranking_loss(w, GATE2, "embedding", "y")


# ------------------------------------------------------------------ J4-J6, J9
INFO_SQL = f"""
, qs AS (SELECT batch_id, label, vec_id, 0 AS side, embedding AS qv, embedding AS k FROM weighted
         UNION ALL SELECT batch_id, label, vec_id, 1, list_reverse(embedding), embedding FROM weighted),
lg AS (SELECT batch_id, label, vec_id, side, list_dot_product(qv, k) / {T_INFO} AS s, 1 AS is_pos FROM qs
       UNION ALL SELECT q.batch_id, q.label, q.vec_id, q.side, list_dot_product(q.qv, b.embedding) / {T_INFO}, 0
       FROM qs q JOIN bank b ON q.label = b.label),
per AS (SELECT batch_id, label, vec_id, side, max(s) AS m, sum(s * is_pos) AS pos FROM lg GROUP BY ALL),
rowloss AS (SELECT l.batch_id, l.label, l.vec_id, l.side, p.m + ln(sum(exp(l.s - p.m))) - p.pos AS loss
            FROM lg l JOIN per p USING (batch_id, label, vec_id, side) GROUP BY l.batch_id, l.label, l.vec_id, l.side, p.m, p.pos),
inner_l AS (SELECT batch_id, label AS class, avg(loss) AS loss, count(*) AS n FROM rowloss GROUP BY ALL)"""

SC_SQL = f"""
, pr AS (SELECT a.batch_id, a.vec_id, a.label AS ya, b.label AS yb, list_dot_product(a.embedding, b.embedding) / {T_SC} AS s
         FROM weighted a JOIN weighted b ON a.batch_id = b.batch_id AND a.vec_id <> b.vec_id),
anc AS (SELECT batch_id, vec_id, max(s) AS m, avg(s) FILTER (WHERE ya = yb) AS mpos, count(*) FILTER (WHERE ya = yb) AS npos FROM pr GROUP BY ALL),
al AS (SELECT pr.batch_id, pr.vec_id, -({T_SC} / {T_BASE}) * (a.mpos - (a.m + ln(sum(exp(pr.s - a.m))))) AS l
       FROM pr JOIN anc a USING (batch_id, vec_id) WHERE a.npos > 0 GROUP BY pr.batch_id, pr.vec_id, a.m, a.mpos),
intra AS (SELECT batch_id, avg(l) AS loss, count(*) AS anchors FROM al GROUP BY batch_id)"""


def _info_inputs(spark: SparkSession, d: str):
    w = _w(spark, d)
    q = w.select("batch_id", "class", F.col("embedding").alias("q"), F.reverse("embedding").alias("q_aug"), F.col("embedding").alias("k"))
    bank = contrast.bank_topk(w.select("class", "vec_id", F.col("embedding").alias("vec"), F.col("w").alias("score")), 8)
    return q, bank


@register("j4_info_nce", with_views("weighted") + "," + BANK8_SQL + INFO_SQL + " SELECT batch_id, class, round(loss, 6) AS loss, n FROM inner_l")
def j4_info_nce(spark: SparkSession, d: str):
    q, bank = _info_inputs(spark, d)
    out = contrast.info_nce(q, bank, T_INFO, method="builtin")
    return out.select("batch_id", "class", F.round("loss", 6).alias("loss"), "n")


@register("j5_supervised_contrast", with_views("weighted") + SC_SQL + " SELECT batch_id, round(loss, 6) AS loss, anchors FROM intra")
def j5_supervised_contrast(spark: SparkSession, d: str):
    w = _w(spark, d).select("batch_id", "vec_id", "class", F.col("embedding").alias("vec"))
    out = contrast.supervised_contrast(w, T_SC, T_BASE, max_batch=64, method="builtin")
    return out.select("batch_id", F.round("loss", 6).alias("loss"), "anchors")


@register("j4_info_nce_arrow", with_views("weighted") + "," + BANK8_SQL + INFO_SQL + " SELECT batch_id, class, round(loss, 6) AS loss, n FROM inner_l")
def j4_info_nce_arrow(spark: SparkSession, d: str):
    q, bank = _info_inputs(spark, d)
    out = contrast.info_nce_arrow(q, bank, T_INFO)
    return out.select("batch_id", "class", F.round("loss", 6).alias("loss"), "n")


@register("j5_supervised_contrast_arrow", with_views("weighted") + SC_SQL + " SELECT batch_id, round(loss, 6) AS loss, anchors FROM intra")
def j5_supervised_contrast_arrow(spark: SparkSession, d: str):
    w = _w(spark, d).select("batch_id", "vec_id", "class", F.col("embedding").alias("vec"))
    out = contrast.supervised_contrast_arrow(w, T_SC, T_BASE)
    return out.select("batch_id", F.round("loss", 6).alias("loss"), "anchors")


@register("j4_info_nce_blocks", with_views("weighted") + "," + BANK8_SQL + INFO_SQL + " SELECT batch_id, class, round(loss, 6) AS loss, n FROM inner_l")
def j4_info_nce_blocks(spark: SparkSession, d: str):
    """The bank in blocks of 1,000 doubles, merged by log-sum-exp."""
    q, bank = _info_inputs(spark, d)
    return tiles.info_nce_blocks(q, bank, T_INFO, cells=1000).select("batch_id", "class", F.round("loss", 6).alias("loss"), "n")


# batches of 200 rows, with and without an augmented view of each
SC_TILES_SQL = f"""
, vw AS (SELECT vec_id // 200 AS batch_id, vec_id, 0 AS side, label, embedding FROM weighted
         UNION ALL SELECT vec_id // 200, vec_id, 1, label, list_reverse(embedding) FROM weighted @WHERE),
pr AS (SELECT a.batch_id, a.vec_id, a.side, a.label AS ya, b.label AS yb, list_dot_product(a.embedding, b.embedding) / {T_SC} AS s
       FROM vw a JOIN vw b ON a.batch_id = b.batch_id AND (a.vec_id <> b.vec_id OR a.side <> b.side)),
anc AS (SELECT batch_id, vec_id, side, max(s) AS m, avg(s) FILTER (WHERE ya = yb) AS mpos, count(*) FILTER (WHERE ya = yb) AS npos FROM pr GROUP BY ALL),
al AS (SELECT pr.batch_id, pr.vec_id, pr.side, -({T_SC} / {T_BASE}) * (a.mpos - (a.m + ln(sum(exp(pr.s - a.m))))) AS l
       FROM pr JOIN anc a USING (batch_id, vec_id, side) WHERE a.npos > 0 GROUP BY pr.batch_id, pr.vec_id, pr.side, a.m, a.mpos)
SELECT batch_id, round(avg(l), 6) AS loss, count(*) AS anchors FROM al GROUP BY batch_id"""


def _sc_tiles(spark: SparkSession, d: str, *aug: str):
    w = _w(spark, d).select(F.floor(F.col("vec_id") / 200).alias("batch_id"), "class", F.col("embedding").alias("vec"), F.reverse("embedding").alias("rev"))
    out = tiles.supervised_contrast_tiles(w, T_SC, T_BASE, aug_vecs=aug, tile=64)
    return out.select("batch_id", F.round("loss", 6).alias("loss"), "anchors")


@register("j5_supervised_contrast_tiles", with_views("weighted") + SC_TILES_SQL.replace("@WHERE", "WHERE false"))
def j5_supervised_contrast_tiles(spark: SparkSession, d: str):
    return _sc_tiles(spark, d)


@register("j5_supervised_contrast_aug", with_views("weighted") + SC_TILES_SQL.replace("@WHERE", ""))
def j5_supervised_contrast_aug(spark: SparkSession, d: str):
    return _sc_tiles(spark, d, "rev")


@register("j6_contrast_total", with_views("weighted") + "," + BANK8_SQL + INFO_SQL + SC_SQL + f"""
, wi AS (SELECT batch_id, sum(({N_CLASSES} - class) * loss) AS wl FROM inner_l GROUP BY batch_id)
SELECT coalesce(wi.batch_id, intra.batch_id) AS batch_id, round(coalesce(wi.wl, 0) + 0.5 * coalesce(intra.loss, 0), 6) AS total
FROM wi FULL JOIN intra ON wi.batch_id = intra.batch_id""")
def j6_contrast_total(spark: SparkSession, d: str):
    q, bank = _info_inputs(spark, d)
    inner = contrast.info_nce(q, bank, T_INFO, method="builtin")
    w = _w(spark, d).select("batch_id", "vec_id", "class", F.col("embedding").alias("vec"))
    intra = contrast.supervised_contrast(w, T_SC, T_BASE, max_batch=64, method="builtin")
    tot = contrast.contrast_total(inner, intra, N_CLASSES, 1.0, 0.5)
    return tot.select("batch_id", F.round("total", 6).alias("total"))


@register("j9_momentum_profile", with_views("weighted") + """
, e AS (SELECT label AS class, batch_id, unnest(embedding) AS x, unnest(range(64)) AS dim FROM weighted),
m AS (SELECT class, batch_id, dim, avg(x) AS x FROM e GROUP BY ALL),
b AS (SELECT class, batch_id, row_number() OVER (PARTITION BY class ORDER BY batch_id) - 1 AS i, count(*) OVER (PARTITION BY class) AS n
      FROM (SELECT DISTINCT class, batch_id FROM m)),
c AS (SELECT class, batch_id, CASE WHEN i = 0 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - 1 - i) END AS coef FROM b)
SELECT m.class, CAST(m.dim AS INT) AS dim, round(sum(c.coef * m.x), 6) AS profile FROM m JOIN c USING (class, batch_id) GROUP BY m.class, m.dim""")
def j9_momentum_profile(spark: SparkSession, d: str):
    w = _w(spark, d).select("class", "batch_id", F.col("embedding").alias("vec"))
    out = contrast.momentum_profile(w, 0.9)
    return out.select("class", F.col("dim").cast("int").alias("dim"), F.round("profile", 6).alias("profile"))


# ------------------------------------------------------------------ J10, J11, J13-J16
def theta0(n_classes: int = N_CLASSES, dim: int = DIM) -> np.ndarray:
    k = np.arange(n_classes * dim).reshape(n_classes, dim)
    return ((k * 37) % 101 - 50) / 1000.0


def _meta_parts(spark: SparkSession, d: str):
    w = fixtures.weighted(spark, d).select("vec_id", F.col("embedding").alias("x"), F.col("label").alias("y"), "w",
                                          hash_fraction("vec_id").alias("u"))
    aug = w.where(F.col("u") >= 0.5)
    clean = w.where((F.col("u") >= 0.2) & (F.col("u") < 0.5))
    val = w.where(F.col("u") < 0.2)
    return aug, clean, val


def _grad_sql(src: str, theta: str, coef: str, name: str) -> str:
    """DuckDB: sum over rows of coef * (p - onehot) x, rows ``src(vec_id, x, y, w, n)`` against ``theta(c, d, t)``."""
    return f"""
{name}_lg AS (SELECT r.vec_id, th.c, sum(th.t * r.x[th.d + 1]) AS z FROM {src} r, {theta} th GROUP BY ALL),
{name}_mx AS (SELECT vec_id, max(z) AS m FROM {name}_lg GROUP BY vec_id),
{name}_p AS (SELECT l.vec_id, l.c, exp(l.z - x.m) / sum(exp(l.z - x.m)) OVER (PARTITION BY l.vec_id) AS p FROM {name}_lg l JOIN {name}_mx x USING (vec_id)),
{name}_r AS (SELECT p.vec_id, p.c, (p.p - CASE WHEN p.c = r.y THEN 1.0 ELSE 0.0 END) * ({coef}) AS rc FROM {name}_p p JOIN {src} r USING (vec_id)),
{name} AS (SELECT rr.c, d.d, sum(rr.rc * r.x[d.d + 1]) AS g FROM {name}_r rr JOIN {src} r USING (vec_id), range({DIM}) d(d) GROUP BY ALL)"""


META_SQL = with_views("weighted") + f"""
, parts AS (SELECT vec_id, embedding AS x, label AS y, w, {hexfrac_sql('vec_id')} AS u FROM weighted),
aug AS (SELECT * FROM parts WHERE u >= 0.5), clean AS (SELECT * FROM parts WHERE u >= 0.2 AND u < 0.5), val AS (SELECT * FROM parts WHERE u < 0.2),
n AS (SELECT (SELECT count(*) FROM aug) AS na, (SELECT count(*) FROM clean) AS nc, (SELECT count(*) FROM val) AS nv),
theta AS (SELECT c.c, d.d, (((c.c * {DIM} + d.d) * 37) % 101 - 50) / 1000.0 AS t FROM range({N_CLASSES}) c(c), range({DIM}) d(d)),
{_grad_sql('aug', 'theta', 'r.w / (SELECT na FROM n)', 'ga')},
{_grad_sql('clean', 'theta', '1.0 / (SELECT nc FROM n)', 'gc')},
theta2 AS (SELECT th.c, th.d, th.t - {ETA} * 0.5 * (ga.g + gc.g) AS t FROM theta th JOIN ga USING (c, d) JOIN gc USING (c, d)),
{_grad_sql('val', 'theta2', '1.0 / (SELECT nv FROM n)', 'gv')},
gx AS (SELECT r.vec_id, gv.c, sum(gv.g * r.x[gv.d + 1]) AS gx FROM aug r, gv GROUP BY ALL),
dv AS (SELECT p.vec_id, sum((p.p - CASE WHEN p.c = r.y THEN 1.0 ELSE 0.0 END) * gx.gx) AS dot_val
       FROM ga_p p JOIN gx USING (vec_id, c) JOIN aug r USING (vec_id) GROUP BY p.vec_id)"""


@register("j10_meta_influence", META_SQL + f"""
SELECT vec_id, round(dot_val, 6) AS dot_val, round(dot_val * 1e6, 3) AS dot_val_e6,
       round(-({ETA} * 0.5 / (SELECT na FROM n)) * dot_val * 1e9, 3) AS meta_grad_e9 FROM dv""")
def j10_meta_influence(spark: SparkSession, d: str):
    aug, clean, val = _meta_parts(spark, d)
    step = weights.meta_influence(aug, clean, val, theta0(), ETA)
    return step.influence.select("vec_id", F.round("dot_val", 6).alias("dot_val"), F.round(F.col("dot_val") * 1e6, 3).alias("dot_val_e6"),
                                 F.round(F.col("meta_grad") * 1e9, 3).alias("meta_grad_e9"))


# The central difference agrees with the exact derivative to ~1e-11 here, far below the
# reported precision, so J10's exact SQL is J11's oracle.
@register("j11_meta_influence_fd", META_SQL + f"""
SELECT vec_id, round(dot_val, 6) AS dot_val_fd, round(-({ETA} * 0.5 / (SELECT na FROM n)) * dot_val * 1e6, 3) AS meta_grad_fd_e6 FROM dv""")
def j11_meta_influence_fd(spark: SparkSession, d: str):
    aug, clean, val = _meta_parts(spark, d)
    th = theta0()
    step = weights.meta_influence(aug, clean, val, th, ETA)
    n_aug = aug.count()
    fd = weights.meta_influence_fd(step.influence, step.g_val_next, th, ETA, n_aug, eps=1e-4)
    return fd.select("vec_id", F.round("dot_val_fd", 6).alias("dot_val_fd"), F.round(F.col("meta_grad_fd") * 1e6, 3).alias("meta_grad_fd_e6"))


J13_SQL = with_views("corpus") + r"""
, tl AS (SELECT index, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS tl FROM corpus),
tk AS (SELECT index, unnest(tl) AS token FROM tl),
cells AS (SELECT index, CAST(('0x' || substr(md5(token), 1, 8)) AS BIGINT) % 64 AS b, count(*) AS c FROM tk GROUP BY ALL),
head AS (SELECT c.c, d.d, (((c.c * 64 + d.d) * 37) % 101 - 50) / 1000.0 AS t FROM range(2) c(c), range(64) d(d)),
dense AS (SELECT t.index, d.d, coalesce(cl.c, 0) AS c FROM corpus t CROSS JOIN range(64) d(d)
          LEFT JOIN cells cl ON cl.index = t.index AND cl.b = d.d)
SELECT index, string_agg(CAST(c AS VARCHAR), ' ' ORDER BY d) AS features,
       (SELECT sum(h.t * x.c) FROM dense x JOIN head h ON h.d = x.d AND h.c = 0 WHERE x.index = o.index) AS logit0,
       (SELECT sum(h.t * x.c) FROM dense x JOIN head h ON h.d = x.d AND h.c = 1 WHERE x.index = o.index) AS logit1
FROM dense o GROUP BY index"""


@register("j13_batch_features", J13_SQL)
def j13_batch_features(spark: SparkSession, d: str):
    tr = fixtures.corpus(spark, d)
    out = contrast.batch_features(tr, "text", 64, head=theta0(2, 64), id_col="index")
    return out.select("index", F.array_join(F.col("features").cast("array<int>"), " ").alias("features"),
                      F.element_at("logits", 1).alias("logit0"), F.element_at("logits", 2).alias("logit1"))


# A toy model in place of the user's: hidden = tanh(A x), logits = B hidden, cross-entropy with the label.
TOY_A, TOY_B = theta0(6, DIM) * 3, theta0(N_CLASSES, 6) * 20


def toy_scorer():
    def predict(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        hidden = np.tanh(x @ TOY_A.T)
        z = hidden @ TOY_B.T
        top = z.max(axis=1)
        loss = top + np.log(np.exp(z - top[:, None]).sum(axis=1)) - z[np.arange(len(z)), y.astype(int)]
        return {"features": hidden, "logits": z, "loss": loss}

    return predict


@register("j13_batch_scorer", with_views("weighted") + f"""
, h AS (SELECT vec_id, label, [{", ".join(f"tanh(list_dot_product({_lst(r)}, embedding))" for r in TOY_A)}] AS hidden FROM weighted),
z AS (SELECT *, [{", ".join(f"list_dot_product({_lst(r)}, hidden)" for r in TOY_B)}] AS z FROM h)
SELECT vec_id, hidden[1] AS feature0, hidden[6] AS feature5, z[1] AS logit0, z[10] AS logit9,
       list_max(z) + ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) - z[label + 1] AS loss FROM z""")
def j13_batch_scorer(spark: SparkSession, d: str):
    w = fixtures.weighted(spark, d).select("vec_id", "embedding", "label")
    out = contrast.batch_features(w, scorer=toy_scorer, inputs=["embedding", "label"], shapes=[[DIM], None])
    at = lambda c, k: F.element_at(c, k)
    return out.select("vec_id", at("features", 1).alias("feature0"), at("features", 6).alias("feature5"), at("logits", 1).alias("logit0"), at("logits", 10).alias("logit9"), "loss")


@register("j14_baseline_fit")
def j14_baseline_fit(spark: SparkSession, d: str):
    aug, clean, val = _meta_parts(spark, d)
    train = clean.unionByName(aug)
    w = weights.instance_weight(train, GATE, "x", "y", "gate_w")
    model = weights.baseline_fit(w, "x", "y", weight="gate_w", max_iter=20)
    return weights.baseline_predict(model, val, "x").select("vec_id", "y", "pred")


@register("j14_baseline_optimum", with_views("weighted") + f"""
, parts AS (SELECT label AS y, {hexfrac_sql('vec_id')} AS u FROM weighted)
SELECT DISTINCT y AS class, TRUE AS at_optimum FROM parts WHERE u >= 0.2""")
def j14_baseline_optimum(spark: SparkSession, d: str):
    """Fitted to convergence with a penalty, the gradient at the head vanishes for every class."""
    aug, clean, _ = _meta_parts(spark, d)
    w = weights.instance_weight(clean.unionByName(aug), GATE, "x", "y", "gate_w")
    model = weights.baseline_fit(w, "x", "y", weight="gate_w", max_iter=500, reg=0.01, tol=1e-10)
    g = weights.fit_gradient(model, w, "x", "y", weight="gate_w", reg=0.01)
    return g.select("class", (F.col("gradient") < 1e-4).alias("at_optimum"))


def reweight_sql(epochs: int) -> str:
    """DuckDB text of ``weights.reweight_fit`` unrolled over ``epochs`` (head starts at 0,
    weights at 1): per epoch a J10 look-ahead, new weights ``max(-meta_grad, 0)``
    normalised to mean 1, then a weighted step of the head."""
    na, nc = "(SELECT na FROM n)", "(SELECT nc FROM n)"
    sql = with_views("weighted") + f"""
, parts AS (SELECT vec_id, embedding AS x, label AS y, w, {hexfrac_sql('vec_id')} AS u FROM weighted),
aug AS (SELECT * FROM parts WHERE u >= 0.5), clean AS (SELECT * FROM parts WHERE u >= 0.2 AND u < 0.5), val AS (SELECT * FROM parts WHERE u < 0.2),
n AS (SELECT (SELECT count(*) FROM aug) AS na, (SELECT count(*) FROM clean) AS nc, (SELECT count(*) FROM val) AS nv),
theta0 AS (SELECT c.c, d.d, 0.0::DOUBLE AS t FROM range({N_CLASSES}) c(c), range({DIM}) d(d)),
w0 AS (SELECT vec_id, 1.0::DOUBLE AS w FROM aug)"""
    for e in range(epochs):
        sql += f""",
a{e} AS (SELECT a.vec_id, a.x, a.y, ww.w FROM aug a JOIN w{e} ww USING (vec_id)),
{_grad_sql(f'a{e}', f'theta{e}', 'r.w', f'ga{e}')},
{_grad_sql('clean', f'theta{e}', '1.0', f'gc{e}')},
tp{e} AS (SELECT t.c, t.d, t.t - {ETA} * (0.5 * ga{e}.g / {na} + 0.5 * gc{e}.g / {nc}) AS t
          FROM theta{e} t JOIN ga{e} USING (c, d) JOIN gc{e} USING (c, d)),
{_grad_sql('val', f'tp{e}', '1.0 / (SELECT nv FROM n)', f'gv{e}')},
gx{e} AS (SELECT r.vec_id, gv{e}.c, sum(gv{e}.g * r.x[gv{e}.d + 1]) AS gx FROM aug r, gv{e} GROUP BY ALL),
dv{e} AS (SELECT p.vec_id, sum((p.p - CASE WHEN p.c = r.y THEN 1.0 ELSE 0.0 END) * gx{e}.gx) AS dot
          FROM ga{e}_p p JOIN gx{e} USING (vec_id, c) JOIN aug r USING (vec_id) GROUP BY p.vec_id),
raw{e} AS (SELECT vec_id, greatest(({ETA} * 0.5 / {na}) * dot, 0.0) AS r FROM dv{e}),
w{e + 1} AS (SELECT vec_id, CASE WHEN (SELECT sum(r) FROM raw{e}) > 0 THEN r * (SELECT count(*) FROM raw{e}) / (SELECT sum(r) FROM raw{e})
                                 ELSE 1.0 END AS w FROM raw{e}),
b{e} AS (SELECT a.vec_id, a.x, a.y, ww.w FROM aug a JOIN w{e + 1} ww USING (vec_id)),
{_grad_sql(f'b{e}', f'theta{e}', 'r.w', f'gb{e}')},
theta{e + 1} AS (SELECT t.c, t.d, t.t - {ETA} * (0.5 * gb{e}.g / {na} + 0.5 * gc{e}.g / {nc}) AS t
                 FROM theta{e} t JOIN gb{e} USING (c, d) JOIN gc{e} USING (c, d))"""
    return sql + f"\nSELECT vec_id, w FROM w{epochs}"


def softmax_fit_sql(steps: int) -> str:
    """DuckDB text of ``weights.softmax_fit`` on clean + augmented rows weighted by the J1
    gate, then the argmax prediction on the validation rows."""
    sql = with_views("weighted") + f"""
, parts AS (SELECT vec_id, embedding AS x, label AS y, {gate_sql(GATE, 'embedding', 'label')} AS w, {hexfrac_sql('vec_id')} AS u FROM weighted),
tr AS (SELECT * FROM parts WHERE u >= 0.2), val AS (SELECT * FROM parts WHERE u < 0.2),
sw AS (SELECT sum(w) AS s FROM tr),
theta0 AS (SELECT c.c, d.d, 0.0::DOUBLE AS t FROM range({N_CLASSES}) c(c), range({DIM}) d(d))"""
    for e in range(steps):
        sql += f""",
{_grad_sql('tr', f'theta{e}', 'r.w', f'g{e}')},
theta{e + 1} AS (SELECT t.c, t.d, t.t - {ETA} * g{e}.g / (SELECT s FROM sw) AS t FROM theta{e} t JOIN g{e} USING (c, d))"""
    return sql + f""",
lv AS (SELECT r.vec_id, r.y, th.c, sum(th.t * r.x[th.d + 1]) AS z FROM val r, theta{steps} th GROUP BY ALL)
SELECT vec_id, y, CAST(arg_max(c, z * 1e12 - c) AS INT) AS pred FROM lv GROUP BY vec_id, y"""


@register("j14_baseline_fit_gd", softmax_fit_sql(3))
def j14_baseline_fit_gd(spark: SparkSession, d: str):
    w = fixtures.weighted(spark, d).select("vec_id", F.col("embedding").alias("x"), F.col("label").alias("y"),
                                          hash_fraction("vec_id").alias("u"))
    w = weights.instance_weight(w, GATE, "x", "y", "w")
    train, val = w.where(F.col("u") >= 0.2), w.where(F.col("u") < 0.2)
    theta = weights.softmax_fit(train, N_CLASSES, DIM, steps=3, eta=ETA, weight="w")
    return weights.softmax_predict(val, theta).select("vec_id", "y", "pred")


@register("j15_reweight_fit", reweight_sql(2))
def j15_reweight_fit(spark: SparkSession, d: str):
    aug, clean, val = _meta_parts(spark, d)
    w, _losses = weights.reweight_fit(spark, aug, clean, val, N_CLASSES, DIM, epochs=2, eta=ETA)
    return w


@register("j16_noise_audit", with_views("weighted") + f"""
, f AS (SELECT vec_id, embedding, label AS orig,
               CASE WHEN {hexfrac_sql('vec_id')} < 0.3 THEN CAST((label + 1 + floor({hexfrac_sql('vec_id', 43)} * 9)) % 10 AS INT) ELSE label END AS label,
               {hexfrac_sql('vec_id')} < 0.3 AS is_flipped FROM weighted),
g AS (SELECT vec_id, is_flipped, {gate_sql(GATE, 'embedding', 'label')} AS w FROM f),
r AS (SELECT *, rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2.0 AS rk FROM g)
SELECT avg(w) FILTER (WHERE is_flipped) AS mean_w_flipped, avg(w) FILTER (WHERE NOT is_flipped) AS mean_w_clean,
       (sum(rk) FILTER (WHERE NOT is_flipped) - count(*) FILTER (WHERE NOT is_flipped) * (count(*) FILTER (WHERE NOT is_flipped) + 1) / 2.0)
         / (count(*) FILTER (WHERE NOT is_flipped) * count(*) FILTER (WHERE is_flipped))::DOUBLE AS auc FROM r""")
def j16_noise_audit(spark: SparkSession, d: str):
    w = sampling.flip_labels(fixtures.weighted(spark, d), 0.3, 10, "label", "vec_id")
    g = weights.instance_weight(w, GATE, "embedding", "label", "w")
    return weights.noise_audit(g.select("vec_id", "w", "is_flipped"))
