"""Queries of the response log as a stream: what keyed state holds after runs that stop and go on."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.plans.standins import EVENTS, events
from assayer.streaming import state

Q, SQL = {}, {}


def query(name: str, oracle: str):
    def add(f):
        Q[name], SQL[name] = f, oracle
        return f

    return add


def _log(spark, d):
    return events(spark, d).select(F.col("user_id").alias("frame_id"), F.col("event_type").alias("prompt_variant"), "event_id", "value", "conf")


def _measures():
    return {"n_ok": F.col("prompt_variant") != "error", "positive": (F.col("prompt_variant") != "error") & (F.col("conf") > 0.5), "cost": F.col("value"), "latency": F.col("conf") * 1000}
_FIRST = f"{EVENTS}, first_ AS (SELECT * FROM (SELECT user_id AS frame_id, event_type AS prompt_variant, event_id, value, conf, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS seen FROM ev) WHERE r = 1)"


@query("response_log_stream", "SELECT user_id AS frame_id, event_type AS prompt_variant, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def response_log_stream(spark, d):
    """The winners that the state holds after three runs over a log that grows between them."""
    return state.winners(spark, state.replay(_log(spark, d), "event_id", _measures())).select("frame_id", "prompt_variant", "event_id")


@query("running_rates_stream", f"WITH {_FIRST} SELECT prompt_variant, count(*) AS n, count(*) FILTER (prompt_variant <> 'error') AS n_ok, count(*) FILTER (prompt_variant <> 'error' AND conf > 0.5) AS positive, round(sum(value), 4) AS cost, round(sum(conf * 1000), 4) AS latency, sum(seen)::BIGINT AS arrivals FROM first_ GROUP BY 1")
def running_rates_stream(spark, d):
    """Running sums over winners and how many answers arrived, from state."""
    mark = state.replay(_log(spark, d), "event_id", _measures())
    seen = state.arrivals(spark, mark).groupBy("prompt_variant").agg(F.sum("seen").alias("arrivals"))
    return state.rates(spark, mark).join(seen, "prompt_variant").withColumns({c: F.round(c, 4) for c in ("cost", "latency")})


@query("resume_from_state", f"""WITH {EVENTS}, work AS (SELECT DISTINCT user_id, event_type FROM ev), half AS (SELECT (max(event_id) + 1) // 20 AS h FROM ev), done AS (SELECT DISTINCT user_id, event_type FROM ev, half WHERE event_id < h),
n AS (SELECT event_type, count(*) AS n FROM done GROUP BY 1)
SELECT w.event_type AS prompt_variant, count(*) AS work, count(d.user_id) AS done, count(*) - count(d.user_id) AS remaining, count(d.user_id) = count(*) AS finished FROM work w LEFT JOIN done d USING (user_id, event_type) GROUP BY 1""")
def resume_from_state(spark, d):
    """A run that stopped after a twentieth of the log: what is done, what remains, and which variants are finished."""
    log = _log(spark, d)
    cut = (log.agg(F.max("event_id")).first()[0] + 1) // 20
    mark = state.replay(log.where(F.col("event_id") < cut), "event_id", _measures(), [])
    work = log.select(*state.KEYS).distinct()
    per = lambda df, name: df.groupBy("prompt_variant").agg(F.count(F.lit(1)).alias(name))
    out = per(work, "work").join(per(state.remaining(work, state.winners(spark, mark)), "remaining"), "prompt_variant", "left").join(state.rates(spark, mark).select("prompt_variant", F.col("n").alias("done")), "prompt_variant", "left").fillna(0)
    return out.withColumn("finished", F.col("done") == F.col("work")).select("prompt_variant", "work", "done", "remaining", "finished")
