"""Queries for the trained gate (J1 in full, J10, J15)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from noisesift import fixtures
from noisesift.fixtures import with_views
from noisesift.operators import gate
from noisesift.plans.contrast_plans import DIM, ETA, N_CLASSES, _grad_sql, _lst, _meta_parts
from noisesift.plans.registry import register
from noisesift.plans.sampling_plans import hexfrac_sql

# ------------------------------------------------------------------ J1 with scores and two hidden layers
SCORES = [("readability", 0.0, 250.0, 10, 3), ("cola", 0.0, 1.0, 5, 2)]
DEEP = gate.formula_gate(N_CLASSES, DIM, hidden=(8, 6), scores=SCORES)


def _deep_sql() -> str:
    def rows(table) -> str:
        return "[" + ", ".join(_lst(r) for r in table) + "]"

    def layer(name: str, w, b, act: str) -> str:
        cells = ", ".join(f"{act}(list_dot_product({_lst(r)}, {name}) + {float(v)!r}" + (", 0.0)" if act == "greatest" else ")") for r, v in zip(w, b, strict=True))
        return f"[{cells}]"

    parts = [f"{rows(DEEP.class_emb)}[label + 1]", "embedding"]
    for s in DEEP.scores:
        n = len(s.table)
        parts.append(f"{rows(s.table)}[1 + greatest(least(trunc(({s.col} - {s.lo!r}) / {(s.hi - s.lo) / n!r})::INT, {n - 1}), 0)]")
    (w1, b1), (w2, b2), (w3, b3) = DEEP.layers
    return with_views("weighted") + f"""
, scored AS (SELECT *, CAST((vec_id * 7) % 300 AS DOUBLE) - 20 AS readability, CAST(vec_id % 100 AS DOUBLE) / 100.0 AS cola FROM weighted),
inp AS (SELECT vec_id, {' || '.join(parts)} AS v FROM scored),
h1 AS (SELECT vec_id, {layer('v', w1, b1, 'greatest')} AS v FROM inp),
h2 AS (SELECT vec_id, {layer('v', w2, b2, 'greatest')} AS v FROM h1)
SELECT vec_id, round({DEEP.scale!r} / (1.0 + exp(-({layer('v', w3, b3, '')}[1]))), 6) AS weight FROM h2"""


@register("j1_instance_weight_deep", _deep_sql())
def j1_instance_weight_deep(spark: SparkSession, d: str):
    w = fixtures.weighted(spark, d).withColumns({"readability": ((F.col("vec_id") * 7) % 300).cast("double") - 20, "cola": (F.col("vec_id") % 100) / F.lit(100.0)})
    return gate.gate_weight(w, DEEP, "embedding", "label").select("vec_id", F.round("weight", 6).alias("weight"))


# ------------------------------------------------------------------ J15: the gate trained over two windows
SMALL = gate.formula_gate(N_CLASSES, DIM, hidden=(6,))
STEPS, WINDOW, RATE = 4, 2, 400.0


def _gate_fit_sql() -> str:
    """DuckDB text of ``gate.gate_fit`` unrolled: the gate's parameters as rows ``(name, i, j, v)``."""
    e, h = SMALL.class_emb.shape[1], len(SMALL.layers[0][1])
    f = lambda i, m, salt: f"((({i}) * {m} + j) * 37 + {salt}) % 101 - 50) / 500.0"
    sql = with_views("weighted") + f"""
, parts AS (SELECT vec_id, embedding AS x, label AS y, {hexfrac_sql('vec_id')} AS u FROM weighted),
aug AS (SELECT * FROM parts WHERE u >= 0.5), clean AS (SELECT * FROM parts WHERE u >= 0.2 AND u < 0.5), val AS (SELECT * FROM parts WHERE u < 0.2),
n AS (SELECT (SELECT count(*) FROM aug) AS na, (SELECT count(*) FROM clean) AS nc, (SELECT count(*) FROM val) AS nv),
theta0 AS (SELECT c.c, d.d, 0.0::DOUBLE AS t FROM range({N_CLASSES}) c(c), range({DIM}) d(d)),
xin AS (SELECT vec_id, {e} + d.d AS d, x[d.d + 1] AS v FROM aug, range({DIM}) d(d)),
phi0 AS (
  SELECT 'emb' AS name, i, j, ({f('i', e, 3)} AS v FROM range({N_CLASSES}) r(i), range({e}) s(j)
  UNION ALL SELECT 'w1', i, j, ({f('i', e + DIM, 7)} FROM range({h}) r(i), range({e + DIM}) s(j)
  UNION ALL SELECT 'b1', j, 0, ({f('0', h, 11)} FROM range({h}) s(j)
  UNION ALL SELECT 'w2', j, 0, ({f('0', h, 13)} FROM range({h}) s(j)
  UNION ALL SELECT 'b2', 0, 0, ({f('0', 1, 17)} FROM range(1) s(j)),
{_grad_sql('val', 'theta0', '1.0 / (SELECT nv FROM n)', 'gv0')}"""

    def forward(t: int) -> str:
        return f""",
inp{t} AS (SELECT a.vec_id, p.j AS d, p.v FROM aug a JOIN phi{t} p ON p.name = 'emb' AND p.i = a.y UNION ALL SELECT * FROM xin),
hid{t} AS (SELECT i.vec_id, w.i AS k, sum(w.v * i.v) + any_value(b.v) AS z FROM inp{t} i JOIN phi{t} w ON w.name = 'w1' AND w.j = i.d
           JOIN phi{t} b ON b.name = 'b1' AND b.i = w.i GROUP BY i.vec_id, w.i),
out{t} AS (SELECT h.vec_id, {SMALL.scale!r} / (1 + exp(-(sum(w.v * greatest(h.z, 0)) + (SELECT v FROM phi{t} WHERE name = 'b2')))) AS w
           FROM hid{t} h JOIN phi{t} w ON w.name = 'w2' AND w.i = h.k GROUP BY h.vec_id)"""

    for t in range(STEPS):
        opens, closes = t % WINDOW == 0, (t + 1) % WINDOW == 0
        sql += forward(t) + f""",
aw{t} AS (SELECT a.vec_id, a.x, a.y, o.w FROM aug a JOIN out{t} o USING (vec_id)),
{_grad_sql(f'aw{t}', f'theta{t}', 'r.w / (SELECT na FROM n)', f'ga{t}')},
{_grad_sql('clean', f'theta{t}', '1.0 / (SELECT nc FROM n)', f'gc{t}')},
theta{t + 1} AS (SELECT th.c, th.d, th.t - {ETA} * 0.5 * (ga{t}.g + gc{t}.g) AS t FROM theta{t} th JOIN ga{t} USING (c, d) JOIN gc{t} USING (c, d)),
{_grad_sql('val', f'theta{t + 1}', '1.0 / (SELECT nv FROM n)', f'gv{t + 1}')},
gx{t} AS (SELECT r.vec_id, g.c, sum(g.g * r.x[g.d + 1]) AS gx FROM aug r, gv{t + 1} g GROUP BY ALL),
mg{t} AS (SELECT p.vec_id, -({ETA} * 0.5 / (SELECT na FROM n)) * sum((p.p - CASE WHEN p.c = r.y THEN 1.0 ELSE 0.0 END) * gx.gx) AS m
          FROM ga{t}_p p JOIN gx{t} gx USING (vec_id, c) JOIN aug r USING (vec_id) GROUP BY p.vec_id),
do{t} AS (SELECT o.vec_id, m.m * o.w * (1 - o.w / {SMALL.scale!r}) AS g FROM out{t} o JOIN mg{t} m USING (vec_id)),
dh{t} AS (SELECT h.vec_id, h.k, h.z, o.g AS og, CASE WHEN h.z > 0 THEN o.g * w.v ELSE 0 END AS g
          FROM hid{t} h JOIN do{t} o USING (vec_id) JOIN phi{t} w ON w.name = 'w2' AND w.i = h.k),
gp{t} AS (
  SELECT 'b2' AS name, 0 AS i, 0 AS j, sum(g) AS g FROM do{t}
  UNION ALL SELECT 'w2', k, 0, sum(og * greatest(z, 0)) FROM dh{t} GROUP BY k
  UNION ALL SELECT 'b1', k, 0, sum(g) FROM dh{t} GROUP BY k
  UNION ALL SELECT 'w1', k, i.d, sum(dh.g * i.v) FROM dh{t} dh JOIN inp{t} i USING (vec_id) GROUP BY k, i.d
  UNION ALL SELECT 'emb', a.y, w.j, sum(dh.g * w.v) FROM dh{t} dh JOIN aug a USING (vec_id) JOIN phi{t} w ON w.name = 'w1' AND w.i = dh.k AND w.j < {e} GROUP BY a.y, w.j),
gm{t} AS (SELECT (1 - {ETA}) * sum(a.g * b.g) / sum(a.g * a.g) AS gamma FROM gv{t} a JOIN gv{t + 1} b USING (c, d)),
dw{t} AS (SELECT name, i, j, g.g{'' if opens else f' + (SELECT gamma FROM gm{t}) * b.g'} AS g FROM gp{t} g{'' if opens else f' JOIN dw{t - 1} b USING (name, i, j)'}),
phi{t + 1} AS (SELECT p.name, p.i, p.j, p.v{f' - {RATE} * coalesce(g.g, 0)' if closes else ''} AS v FROM phi{t} p{f' LEFT JOIN dw{t} g USING (name, i, j)' if closes else ''})"""
    return sql + forward(STEPS) + f"""
SELECT o.vec_id, round(o.w, 6) AS w, round((o.w - s.w) * 1e3, 6) AS change_e3 FROM out{STEPS} o JOIN out0 s USING (vec_id)"""


@register("j15_gate_fit", _gate_fit_sql())
def j15_gate_fit(spark: SparkSession, d: str):
    aug, clean, val = _meta_parts(spark, d)
    fit = gate.gate_fit(spark, aug, clean, val, SMALL, N_CLASSES, DIM, STEPS, ETA, RATE, WINDOW, clip=None)
    before = gate.gate_weight(fit.weights, SMALL, "x", "y", "w0")
    return before.select("vec_id", F.round("w", 6).alias("w"), F.round((F.col("w") - F.col("w0")) * 1e3, 6).alias("change_e3"))
