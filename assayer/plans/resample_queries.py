"""Queries of the tree resampler: intervals of a continuous mean, and the design effects of all tasks in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import vocab
from assayer.operators import multinomial as T
from assayer.operators.reliability import task_outcomes
from assayer.operators.resample import implications
from assayer.plans.standins import responses, sql, table
from assayer.sources.shared import stored

Q, SQL = {}, {}
_MASK = "4294967295::UBIGINT"
#: Heights of the trees in SQL: up to 2^HIGH cells a group.
HIGH, LOW = 22, 12
CONTINUOUS = 200


def query(name: str, oracle: str):
    def add(f):
        Q[name], SQL[name] = f, oracle
        return f

    return add


def _scramble(x: str) -> str:
    one = f"(xor({x}, ({x}) >> 16) * 2146121005::UBIGINT) & {_MASK}"
    two = f"(xor({one}, ({one}) >> 15) * 2221713035::UBIGINT) & {_MASK}"
    return f"xor({two}, ({two}) >> 16)"


def _uniform(i: str) -> str:
    return f"(({_scramble(f'(key + (({i} + 1) * 7919)::UBIGINT) & {_MASK}')}) + 0.5) / 4294967296.0::DOUBLE"


_FEW = f"list_sum(list_transform(range(n), lambda i: (({_uniform('i')}) < p)::BIGINT))"
_PROPOSED = f"""list_filter(list_transform(range({T.ATTEMPTS}), lambda t: list_transform([struct_pack(u := ({_uniform('2 * t')}) - 0.5, v := {_uniform('2 * t + 1')})],
  lambda x: list_transform([floor((2 * a / (0.5 - abs(x.u)) + wide) * x.u + n * q + 0.5)::BIGINT],
  lambda k: CASE WHEN k >= 0 AND k <= n AND ((0.5 - abs(x.u) >= 0.07 AND x.v <= 0.92 - 4.2 / wide) OR ln(x.v * (2.83 + 5.1 / wide) * spread / (a / ((0.5 - abs(x.u)) * (0.5 - abs(x.u))) + wide))
    <= lgamma(mode + 1) + lgamma(n - mode + 1) - lgamma(greatest(k, 0) + 1) - lgamma(greatest(n - k, 0) + 1) + (k - mode) * ln(q / (1 - q))) THEN k END)[1])[1]), lambda k: k IS NOT NULL)[1]"""
_WAITED = f"list_sum(list_transform(range(1, {T.WAITS + 1}), lambda j: (list_sum(list_transform(range(j), lambda i: floor(ln({_uniform('i')}) / ln(1 - q)) + 1)) <= n)::BIGINT))"
_DRAW = f"""CASE WHEN n = 0 OR p <= 0 THEN 0 WHEN p >= 1 THEN n WHEN n <= {T.FEW} THEN {_FEW}
  ELSE list_transform([CASE WHEN n * q < 10 THEN {_WAITED} ELSE coalesce({_PROPOSED}, mode) END], lambda k: CASE WHEN p > 0.5 THEN n - k ELSE k END)[1] END"""


def tree(cells: str, name: str, high: int, resamples: int, seed: int = vocab.SEED) -> str:
    """CTEs `name`_tree: g, r, b, n of the leaves that a resample draws; cells: a CTE of g, o, k, in the order o."""
    step = f"b, h, node, n, g, wl / w AS p, least(wl / w, 1 - wl / w) AS q, {_scramble(f'xor({_scramble(f"({_scramble(f'(b::UBIGINT + {seed * 65537}::UBIGINT) & {_MASK}')} + (h * 1000003)::UBIGINT) & {_MASK}")}, node::UBIGINT & {_MASK})')} AS key"
    shape = "sqrt(n * q * (1 - q)) AS spread, 1.15 + 2.53 * sqrt(n * q * (1 - q)) AS wide, -0.0873 + 0.0248 * (1.15 + 2.53 * sqrt(n * q * (1 - q))) + 0.01 * q AS a, floor((n + 1) * q)::BIGINT AS mode"
    return f"""{name}_cells AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o) - 1 AS r FROM {cells}),
{name}_w AS (SELECT g, h, r >> h AS node, sum(k)::DOUBLE AS w FROM {name}_cells, range({high + 1}) t(h) GROUP BY ALL),
{name}_tree(g, h, node, b, n) AS (
  SELECT g, {high}::BIGINT, 0::BIGINT, b, w::BIGINT FROM {name}_w, range({resamples}) t(b) WHERE h = {high}
  UNION ALL
  SELECT g, h - 1, 2 * node + side, b, CASE side WHEN 0 THEN l ELSE n - l END FROM (
    SELECT *, {_DRAW} AS l FROM (SELECT *, {shape} FROM (
      SELECT {step} FROM (SELECT t.*, x.w, coalesce(y.w, 0) AS wl FROM {name}_tree t JOIN {name}_w x ON x.g = t.g AND x.h = t.h AND x.node = t.node LEFT JOIN {name}_w y ON y.g = t.g AND y.h = t.h - 1 AND y.node = 2 * t.node WHERE t.h > 0)))
  ), (VALUES (0), (1)) s(side) WHERE CASE side WHEN 0 THEN l ELSE n - l END > 0)"""


_PRICE = f"""WITH RECURSIVE c AS (SELECT 0 AS g, l_extendedprice AS o, count(*) AS k FROM lineitem GROUP BY ALL),
{tree('c', 'c', HIGH, CONTINUOUS)},
m AS (SELECT b, sum(n * o) / sum(n) AS m FROM c_tree t JOIN c_cells c ON c.g = t.g AND c.r = t.node WHERE t.h = 0 GROUP BY b)
SELECT round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi FROM m"""


@query("iid_mean_bootstrap", _PRICE)
def iid_mean_bootstrap(spark, d):
    """Interval of the mean of a column with about as many distinct values as rows."""
    return T.mean_interval(table(spark, d, "lineitem"), "l_extendedprice", [], CONTINUOUS).select(*[F.round(c, 4).alias(c) for c in ("lo", "hi")])


_TASKS = ("hands_ge_1", "hands_eq_2", "manipulation", "grasp")
_EFFECTS = sql(f"""WITH o AS (SELECT cluster, unnest(['hands_ge_1', 'hands_eq_2', 'manipulation']) AS task, unnest([hands >= 1, hands = 2, manip])::INT::DOUBLE AS value FROM responses WHERE status = 'ok' AND judge = 'A'),
i AS (SELECT task AS g, value AS o, count(*) AS k FROM o WHERE value IS NOT NULL GROUP BY ALL),
{tree('i', 'i', 1, vocab.RESAMPLES)},
im AS (SELECT t.g, b, sum(n * o) / sum(n) AS m FROM i_tree t JOIN i_cells c ON c.g = t.g AND c.r = t.node WHERE t.h = 0 GROUP BY ALL),
j AS (SELECT task AS g, cluster AS o, 1 AS k, sum(value) AS s, count(value) AS c FROM o WHERE value IS NOT NULL GROUP BY ALL),
{tree('j', 'j', LOW, vocab.RESAMPLES)},
jm AS (SELECT t.g, b, sum(n * s) / sum(n * c) AS m FROM j_tree t JOIN j_cells c ON c.g = t.g AND c.r = t.node WHERE t.h = 0 GROUP BY ALL),
e AS (SELECT g, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM im GROUP BY 1),
f AS (SELECT g, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM jm GROUP BY 1),
p AS (SELECT task, count(*) AS n, count(DISTINCT cluster) AS clusters, avg(value) AS point FROM o WHERE value IS NOT NULL GROUP BY 1)
SELECT task, coalesce(n, 0) AS n, clusters, round(point, 6) AS point, round(e.lo, 6) AS iid_lo, round(e.hi, 6) AS iid_hi, round(f.lo, 6) AS cluster_lo, round(f.hi, 6) AS cluster_hi,
  round(CASE WHEN e.hi > e.lo THEN pow((f.hi - f.lo) / (e.hi - e.lo), 2) END, 6) AS design_effect, CASE WHEN n IS NULL THEN 'no answers that are ok for this task' END AS why_absent,
  round(CASE WHEN n > clusters AND e.hi > e.lo THEN (pow((f.hi - f.lo) / (e.hi - e.lo), 2) - 1) / (n / clusters - 1) END, 6) AS icc, round(CASE WHEN e.hi > e.lo THEN (f.hi - f.lo) / (e.hi - e.lo) - 1 END, 6) AS width_excess,
  round(CASE WHEN e.hi > e.lo AND f.hi > f.lo THEN 1 - (e.hi - e.lo) / (f.hi - f.lo) END, 6) AS understated
FROM (SELECT unnest({list(_TASKS)!r}) AS task) LEFT JOIN p USING (task) LEFT JOIN e ON e.g = task LEFT JOIN f ON f.g = task""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("design_effects_by_task", _EFFECTS)
def design_effects_by_task(spark, d):
    """Both intervals and the design effect of every task, one that nobody answered included."""
    rows = stored(task_outcomes(responses(spark, d).where("judge = 'A'"), "cluster"), "outcomes")
    tasks = spark.createDataFrame([(t,) for t in _TASKS], "task string")
    numbers = ("point", "iid_lo", "iid_hi", "cluster_lo", "cluster_hi", "design_effect", "icc", "width_excess", "understated")
    effects = T.design_effects(rows, tasks, "value", "cluster")
    return effects.withColumns(implications(F.col("design_effect"), F.col("n") / F.col("clusters"))).withColumns({c: F.round(c, 6) for c in numbers})
