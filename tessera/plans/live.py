"""The live scoreboard (ST): closed forms with SQL counterparts, and the folded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators.scan import floored_scan, running_best, running_sums
from ..streaming import scoreboard as B
from .base import det_plan

_LOG = "c AS (SELECT run_id AS match_id, event_id AS seq, sec AS sc, event_type, k, user_id FROM det)"


def log(det: DataFrame) -> DataFrame:
    return det.select(F.col("run_id").alias("match_id"), F.col("event_id").alias("seq"), F.col("sec").alias("at"), "event_type", "k", "user_id")


_DELTA = "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END"


@det_plan("st02_absolute_score", f"@DET, {_LOG}, s AS (SELECT *, count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER (PARTITION BY match_id ORDER BY sc, seq) AS seg, CASE WHEN event_type = 'purchase' THEN k ELSE {_DELTA} END AS step FROM c), r AS (SELECT *, sum(step) OVER (PARTITION BY match_id, seg ORDER BY sc, seq) AS run FROM s) SELECT seq, (run - least(0, min(run) OVER (PARTITION BY match_id, seg ORDER BY sc, seq)))::BIGINT AS score FROM r")
def st02(det: DataFrame) -> DataFrame:
    c = log(det).withColumn("delta", F.expr(_DELTA)).withColumn("absolute", F.expr("case when event_type = 'purchase' then k end"))
    return floored_scan(c, ["match_id"], ["at", "seq"], absolute="absolute").select("seq", "score")


@det_plan("st03_floored_score", f"@DET, {_LOG}, r AS (SELECT *, sum({_DELTA}) OVER (PARTITION BY match_id ORDER BY sc, seq) AS run FROM c) SELECT seq, (run - least(0, min(run) OVER (PARTITION BY match_id ORDER BY sc, seq)))::BIGINT AS score FROM r")
def st03(det: DataFrame) -> DataFrame:
    c = log(det).withColumn("delta", F.expr(_DELTA))
    return floored_scan(c, ["match_id"], ["at", "seq"]).select("seq", "score")


_RUNS = f"{_LOG}, v AS (SELECT match_id, sc * 100000000 + seq AS o, sc, k % 2 = 0 AS running FROM c WHERE event_type = 'view'), d AS (SELECT *, coalesce(lag(running) OVER (PARTITION BY match_id ORDER BY o), FALSE) AS before FROM v), x AS (SELECT match_id, o, sc, running FROM d WHERE running <> before), sp AS (SELECT * FROM (SELECT match_id, running, sc AS since, lead(sc) OVER (PARTITION BY match_id ORDER BY o) AS until FROM x) WHERE running), e AS (SELECT match_id, max(sc) AS fin FROM c GROUP BY match_id)"


def changes(det: DataFrame) -> DataFrame:
    v = log(det).where("event_type = 'view'").select("match_id", "at", "seq", (F.col("k") % 2 == 0).alias("running"))
    return B.running_changes(v, ["match_id"], ["at", "seq"])


def spans(det: DataFrame) -> DataFrame:
    w = W.partitionBy("match_id").orderBy("at", "seq")
    return changes(det).withColumn("until", F.lead("at").over(w)).where("running").select("match_id", F.col("at").alias("since"), "until")


@det_plan("st04_clock_read", f"@DET, {_RUNS} SELECT e.match_id, greatest(0, 100000000 - sum(greatest(0, least(coalesce(until, fin), fin) - since)))::BIGINT AS clock FROM sp JOIN e ON sp.match_id = e.match_id GROUP BY e.match_id")
def st04(det: DataFrame) -> DataFrame:
    end = log(det).groupBy("match_id").agg(F.max("at").alias("fin"))
    s = spans(det).join(end, "match_id").groupBy("match_id").agg(F.sum(B.elapsed(F.col("since"), F.col("until"), F.col("fin"))).alias("gone"))
    return s.select("match_id", F.greatest(F.lit(0), F.lit(100000000) - F.col("gone")).cast("bigint").alias("clock"))


@det_plan("st05_idempotent_commands", f"@DET, {_RUNS} SELECT match_id, count(*) AS changes FROM x GROUP BY match_id")
def st05(det: DataFrame) -> DataFrame:
    return changes(det).groupBy("match_id").agg(F.count("*").alias("changes"))


@det_plan("st06_clock_resets", f"@DET, {_LOG} SELECT seq, count(CASE WHEN event_type = 'signup' THEN 1 END) OVER (PARTITION BY match_id ORDER BY sc, seq) AS segment, CASE WHEN event_type = 'signup' THEN CASE WHEN k % 3 = 0 THEN 300 ELSE 1500 END END AS target FROM c")
def st06(det: DataFrame) -> DataFrame:
    """Resets as boundaries of segments, with the length that the clock is set to."""
    reset = F.col("event_type") == "signup"
    target = F.when(reset, F.when(F.col("k") % 3 == 0, B.OVERTIME).otherwise(B.PERIOD))
    return log(det).select("seq", F.count(F.when(reset, 1)).over(W.partitionBy("match_id").orderBy("at", "seq")).alias("segment"), target.alias("target"))


@det_plan("st09_penalty_countdown", f"@DET, {_RUNS}, p AS (SELECT match_id, seq, sc, CASE k % 3 WHEN 0 THEN 120 WHEN 1 THEN 300 ELSE 600 END * 1000 AS dur FROM c WHERE event_type = 'purchase' AND k < 50) SELECT p.seq, greatest(0, min(p.dur) - coalesce(sum(greatest(0, least(coalesce(sp.until, e.fin), e.fin) - greatest(sp.since, p.sc))), 0))::BIGINT AS remaining FROM p JOIN e ON p.match_id = e.match_id LEFT JOIN sp ON sp.match_id = p.match_id AND coalesce(sp.until, e.fin) > p.sc GROUP BY p.seq")
def st09(det: DataFrame) -> DataFrame:
    """A penalty's time left: its length less what the clock ran from then to the match's end.

    What the clock has run up to a time follows from the changes so far:
    each start counts the time since it, each pause takes that off again.
    So a penalty needs two running sums and meets no span. One that begins
    after the clock's last stop counts all time from then, as in the SQL.
    """
    c = log(det).where("match_id is not null")
    p = c.where("event_type = 'purchase' and k < 50").selectExpr("match_id", "seq", "at", "case k % 3 when 0 then 120 when 1 then 300 else 600 end * 1000 as dur", "0L as way", "0L as since")
    s = changes(det).withColumn("way", F.when(F.col("running"), 1).otherwise(-1).cast("bigint"))
    s = s.select("match_id", "seq", "at", F.lit(None).cast("int").alias("dur"), "way", (F.col("way") * F.col("at")).alias("since"))
    rows = running_sums(p.union(s), ["match_id"], ["at", "seq"], {"ways": "way", "sinces": "since"}).where("dur is not null")
    end = c.groupBy("match_id").agg(F.max("at").alias("fin"))
    all_ = s.groupBy("match_id").agg(F.sum("way").alias("n"), F.sum("since").alias("m"), F.max(F.when(F.col("way") < 0, F.col("at"))).alias("stopped"))
    j = rows.join(end, "match_id").join(all_, "match_id", "left")
    gone = F.sum(F.expr("if(if(n = 1, fin, stopped) > at, fin * n - m - (at * ways - sinces), fin - at)"))
    return j.groupBy("seq").agg(F.greatest(F.lit(0), F.min("dur") - F.coalesce(gone, F.lit(0))).cast("bigint").alias("remaining"))


@det_plan("st14_partial_update", f"@DET, {_LOG} SELECT seq, last_value(CASE WHEN k % 3 = 0 THEN 'c' || k END IGNORE NULLS) OVER w AS color, last_value(CASE WHEN k % 5 = 0 THEN 's' || k END IGNORE NULLS) OVER w AS short FROM c WINDOW w AS (PARTITION BY match_id ORDER BY sc, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def st14(det: DataFrame) -> DataFrame:
    w = W.partitionBy("match_id").orderBy("at", "seq").rowsBetween(W.unboundedPreceding, 0)
    keep = lambda c: F.last(F.expr(c), ignorenulls=True).over(w)
    return log(det).select("seq", keep("case when k % 3 = 0 then concat('c', k) end").alias("color"), keep("case when k % 5 = 0 then concat('s', k) end").alias("short"))


@det_plan("st15_penalty_warning", "@DET SELECT event_id, k <= 30 AS warn FROM det WHERE event_type = 'purchase'")
def st15(det: DataFrame) -> DataFrame:
    return det.where("event_type = 'purchase'").select("event_id", (F.col("k") <= 30).alias("warn"))


def commands(det: DataFrame, path: str, body: str) -> DataFrame:
    """The command log: a path and a JSON body of SQL expressions over the log's columns."""
    return log(det).withColumn("path", F.expr(path)).withColumn("body", F.to_json(F.expr(body))).select("match_id", "seq", "at", "path", "body")


_ALL = "case event_type when 'click' then '/score' when 'error' then '/score' when 'view' then if(k % 2 = 0, '/clock/start', '/clock/pause') when 'purchase' then '/penalty/add' when 'signup' then '/period' else '/nowhere' end"
_BODY = "named_struct('team', if(user_id % 2 = 0, 'A', 'B'), 'delta', if(event_type = 'error', -1, 1), 'duration', element_at(array(120, 300, 600, 90), cast(k % 4 + 1 as int)), 'label', if(k % 3 = 0, 'prol', 'p2'), 'seconds', cast(null as double), 'value', cast(null as string))"


@det_plan("st01_command_fold", None)
def st01(det: DataFrame) -> DataFrame:
    return B.fold(commands(det, _ALL, _BODY))


def _fold_sql(state: str) -> str:
    """All result columns of a fold, from a query ``s`` of the state after each command."""
    return f"@DET, {_LOG}, {state} SELECT match_id, seq, status::INT AS status, (sum((status = 200)::INT) OVER (PARTITION BY match_id ORDER BY sc, seq))::BIGINT AS rev, score_a::BIGINT AS score_a, score_b::BIGINT AS score_b, clock::DOUBLE AS clock, FALSE AS running, penalties_a::INT AS penalties_a, penalties_b::INT AS penalties_b, label FROM s"


_AT = "PARTITION BY match_id ORDER BY sc, seq"
_STILL = "0 AS score_a, 0 AS score_b"
_ST07 = f"r AS (SELECT *, 1500 + sum(CASE WHEN k % 2 = 1 THEN k - 60 ELSE 0 END) OVER ({_AT}) AS run FROM c), s AS (SELECT *, CASE WHEN k % 2 = 0 AND k % 3 = 2 THEN 404 ELSE 200 END AS status, {_STILL}, run - least(0, min(run) OVER ({_AT})) AS clock, 0 AS penalties_a, 0 AS penalties_b, 'P1' AS label FROM r)"
_ST08 = f"t AS (SELECT *, user_id % 2 AS team, k % 10 = 0 AS clears FROM c), g AS (SELECT *, sum(clears::INT) OVER (PARTITION BY match_id, team ORDER BY sc, seq) AS seg FROM t), n AS (SELECT *, sum((NOT clears)::INT) OVER (PARTITION BY match_id, team, seg ORDER BY sc, seq) AS adds FROM g), p AS (SELECT *, least(3, adds) AS held, CASE WHEN NOT clears AND adds > 3 THEN 404 ELSE 200 END AS status FROM n), s AS (SELECT *, {_STILL}, 1500 AS clock, coalesce(last_value(CASE WHEN team = 0 THEN held END IGNORE NULLS) OVER ({_AT}), 0) AS penalties_a, coalesce(last_value(CASE WHEN team = 1 THEN held END IGNORE NULLS) OVER ({_AT}), 0) AS penalties_b, 'P1' AS label FROM p)"
_ST11 = f"t AS (SELECT *, sum((k % 4 = 0)::INT) OVER ({_AT}) % 2 AS swapped FROM c), l AS (SELECT *, (user_id + swapped) % 2 AS own, CASE WHEN k % 4 = 3 THEN CASE WHEN event_type = 'error' THEN -1 ELSE 1 END ELSE 0 END AS d FROM t), r AS (SELECT *, sum(CASE WHEN own = 0 THEN d ELSE 0 END) OVER ({_AT}) AS r0, sum(CASE WHEN own = 1 THEN d ELSE 0 END) OVER ({_AT}) AS r1, sum((own = 0 AND k % 4 = 2)::INT) OVER ({_AT}) AS p0, sum((own = 1 AND k % 4 = 2)::INT) OVER ({_AT}) AS p1 FROM l), f AS (SELECT *, r0 - least(0, min(r0) OVER ({_AT})) AS s0, r1 - least(0, min(r1) OVER ({_AT})) AS s1 FROM r), s AS (SELECT *, CASE WHEN k % 4 = 2 AND (CASE own WHEN 0 THEN p0 ELSE p1 END) > 3 THEN 404 ELSE 200 END AS status, CASE swapped WHEN 0 THEN s0 ELSE s1 END AS score_a, CASE swapped WHEN 0 THEN s1 ELSE s0 END AS score_b, 1500 AS clock, least(3, CASE swapped WHEN 0 THEN p0 ELSE p1 END) AS penalties_a, least(3, CASE swapped WHEN 0 THEN p1 ELSE p0 END) AS penalties_b, 'P1' AS label FROM f)"
_ST12 = f"t AS (SELECT *, coalesce(last_value(CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'PROL' ELSE 'P1' END END IGNORE NULLS) OVER ({_AT}), 'P1') AS label, coalesce(last_value(CASE WHEN k % 3 = 1 THEN greatest(1, k * 10) END IGNORE NULLS) OVER ({_AT}), 1500) AS per, coalesce(last_value(CASE WHEN k % 3 = 2 THEN greatest(1, k * 10) END IGNORE NULLS) OVER ({_AT}), 300) AS ot FROM c), s AS (SELECT *, 200 AS status, {_STILL}, CASE WHEN label LIKE 'PROL%' THEN ot ELSE per END AS clock, 0 AS penalties_a, 0 AS penalties_b FROM t)"


@det_plan("st07_direction_adjust", _fold_sql(_ST07))
def st07(det: DataFrame) -> DataFrame:
    body = "named_struct('value', element_at(array('up', 'down', 'sideways'), cast(k % 3 + 1 as int)), 'delta', k - 60)"
    return B.fold(commands(det, "if(k % 2 = 0, '/clock/direction', '/clock/adjust')", body))


@det_plan("st08_penalty_limit", _fold_sql(_ST08))
def st08(det: DataFrame) -> DataFrame:
    return B.fold(commands(det, "if(k % 10 = 0, '/penalty/clear', '/penalty/add')", _BODY))


#: Starts, pauses and a few penalties; everything else changes nothing.
_TICK = "case when k = 1 then '/penalty/add' when k between 10 and 40 then '/clock/start' when k between 41 and 60 then '/clock/pause' else '/visible' end"
_TICK_BODY = "named_struct('team', if(user_id div 16 % 2 = 0, 'A', 'B'), 'duration', element_at(array(120, 300, 600, 90), cast(user_id div 16 % 4 + 1 as int)))"
_ENDS = f"{_LOG}, v AS (SELECT match_id, sc, seq, k <= 40 AS running FROM c WHERE k BETWEEN 10 AND 60), d AS (SELECT *, coalesce(lag(running) OVER (PARTITION BY match_id ORDER BY sc, seq), FALSE) AS before FROM v), sp AS (SELECT * FROM (SELECT match_id, running, sc AS since, lead(sc) OVER (PARTITION BY match_id ORDER BY sc, seq) AS until FROM d WHERE running <> before) WHERE running), p AS (SELECT match_id, sc, CASE user_id // 16 % 2 WHEN 0 THEN 'A' ELSE 'B' END AS team, CASE user_id // 16 % 4 WHEN 1 THEN 300 WHEN 2 THEN 600 ELSE 120 END AS dur, row_number() OVER (PARTITION BY match_id ORDER BY sc, seq) AS id FROM c WHERE k = 1), o AS (SELECT p.*, greatest(sp.since, p.sc) AS a, sp.until AS b FROM p JOIN sp ON p.match_id = sp.match_id AND (sp.until IS NULL OR sp.until > p.sc)), g AS (SELECT *, coalesce(sum(b - a) OVER (PARTITION BY match_id, id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ran FROM o), x AS (SELECT match_id, CAST(id AS VARCHAR) AS penalty, team, round((a + dur - ran)::DOUBLE - 0.05::DOUBLE, 2) AS ends FROM g WHERE ran < dur AND (b IS NULL OR ran + b - a >= dur))"


def _ends(happened: DataFrame) -> DataFrame:
    return happened.where("path = 'expired'").select("match_id", "penalty", "team", E.rounded("at", 2).alias("ends"))


@det_plan("st10_penalty_expiry", f"@DET, {_ENDS} SELECT * FROM x")
def st10(det: DataFrame) -> DataFrame:
    """Each penalty that ends, at its own time, whether a command follows or not."""
    return _ends(B.happenings(commands(det, _TICK, _TICK_BODY)))


def replayed(det: DataFrame) -> tuple[DataFrame, str]:
    """The command log as a stream with timers: what happened, and the folder of the stream's state.

    A last command of a match of its own, long after all others, moves the
    watermark over every penalty's end.
    """
    from ..operators.store import materialise, shared_path
    from ..streaming.timers import replay

    spark = det.sparkSession
    c = commands(det, _TICK, _TICK_BODY)
    last = c.agg((F.max("at") + 86_400_000).alias("at")).select(F.lit(-1).cast("bigint").alias("match_id"), F.lit(-1).cast("bigint").alias("seq"), "at", F.lit("/visible").alias("path"), F.lit("{}").alias("body"))
    # in order of time, so that a batch of commands is of few hours
    log_ = materialise(c.unionByName(last.where("at is not null")).repartitionByRange("at").sortWithinPartitions("at"))
    checkpoint = shared_path(spark, "board-state")
    return replay(spark, log_.inputFiles()[0].rsplit("/", 1)[0], log_.schema, shared_path(spark, "board-rows"), checkpoint, files=100_000), checkpoint


@det_plan("st10_timer_stream", f"@DET, {_ENDS} SELECT * FROM x")
def st10_stream(det: DataFrame) -> DataFrame:
    """The same ends from the stream, where timers show them."""
    return _ends(replayed(det)[0])


@det_plan("st11_swap_remove", _fold_sql(_ST11))
def st11(det: DataFrame) -> DataFrame:
    return B.fold(commands(det, "case k % 4 when 0 then '/swap' when 1 then '/penalty/remove' when 2 then '/penalty/add' else '/score' end", _BODY))


@det_plan("st12_period_rules", _fold_sql(_ST12))
def st12(det: DataFrame) -> DataFrame:
    return B.fold(commands(det, "case k % 3 when 0 then '/period' when 1 then '/period/duration' else '/period/ot_duration' end", "named_struct('value', k * 10, 'label', if(k % 2 = 0, 'prol', 'p1'))"))


@det_plan("st16_malformed_commands", f"@DET, {_LOG}, s AS (SELECT *, CASE k % 5 WHEN 0 THEN 400 WHEN 1 THEN 400 WHEN 2 THEN 400 WHEN 3 THEN 404 ELSE 200 END AS status FROM c) SELECT match_id, seq, status::INT AS status, (sum((status = 200)::INT) OVER ({_AT}))::BIGINT AS rev, (sum(CASE WHEN status = 200 AND user_id % 2 = 0 THEN 1 ELSE 0 END) OVER ({_AT}))::BIGINT AS score_a FROM s")
def st16(det: DataFrame) -> DataFrame:
    """Bodies that are no JSON, no object, or hold no number are answered with 400 and change nothing."""
    body = "case k % 5 when 0 then '{broken' when 1 then '[1]' when 2 then '{\"team\":\"A\",\"delta\":\"x\"}' when 3 then '{}' else if(user_id % 2 = 0, '{\"team\":\"A\",\"delta\":1}', '{\"team\":\"B\",\"delta\":\"1\"}') end"
    c = log(det).withColumn("path", F.lit("/score")).withColumn("body", F.expr(body)).select("match_id", "seq", "at", "path", "body")
    return B.fold(c).select("match_id", "seq", "status", "rev", "score_a")


@det_plan("st13_snapshot", f"@DET, {_ENDS}, n AS (SELECT match_id, count(*) AS n FROM c GROUP BY match_id), e AS (SELECT match_id, count(DISTINCT ends) AS e, count(*) AS gone FROM x GROUP BY match_id), r AS (SELECT match_id, arg_max(running, sc * 100000000 + seq) AS running FROM v GROUP BY match_id), a AS (SELECT match_id, count(*) AS adds FROM p GROUP BY match_id) SELECT n.match_id, n.n + coalesce(e.e, 0) AS rev, coalesce(r.running, FALSE) AS running, coalesce(a.adds, 0) - coalesce(e.gone, 0) AS penalties FROM n LEFT JOIN e ON n.match_id = e.match_id LEFT JOIN r ON n.match_id = r.match_id LEFT JOIN a ON n.match_id = a.match_id")
def st13(det: DataFrame) -> DataFrame:
    """The state of each match as the stream's state store holds it."""
    from ..streaming.timers import snapshot

    return snapshot(det.sparkSession, replayed(det)[1]).where("match_id >= 0").select("match_id", "rev", "running", "penalties")


@det_plan("k05_late_subscribers", f"@DET, {_ENDS}, t AS (SELECT match_id, sc::DOUBLE AS ends, seq, 0 AS o FROM c UNION ALL SELECT DISTINCT match_id, ends, NULL, -1 FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ends, o, seq) AS rev FROM t), s AS (SELECT match_id, max(rev) AS rev FROM r GROUP BY match_id), u AS (SELECT DISTINCT user_id, run_id AS match_id, user_id % 7 AS behind FROM det) SELECT u.user_id, u.match_id, s.rev AS snapshot_rev, count(r.rev) AS missed FROM u JOIN s ON u.match_id = s.match_id LEFT JOIN r ON r.match_id = u.match_id AND r.rev > s.rev - u.behind GROUP BY 1, 2, 3")
def k05_late(det: DataFrame) -> DataFrame:
    """Clients who were away get the snapshot from the state store; of what happened, they missed the revisions after the last they saw."""
    from ..streaming.timers import catch_up, snapshot

    happened, state = replayed(det)
    now = snapshot(det.sparkSession, state)
    clients = det.select("user_id", F.col("run_id").cast("bigint").alias("match_id")).distinct()
    clients = clients.join(now.select("match_id", "rev"), "match_id").select("user_id", "match_id", (F.col("rev") - F.col("user_id") % 7).alias("seen"))
    return catch_up(clients, now, happened)


@det_plan("w13_running_score", f"@DET, {_LOG}, r AS (SELECT *, user_id % 2 AS team, sum({_DELTA}) OVER (PARTITION BY match_id, user_id % 2 ORDER BY sc, seq) AS run FROM c), f AS (SELECT *, run - least(0, min(run) OVER (PARTITION BY match_id, team ORDER BY sc, seq)) AS score FROM r) SELECT match_id, team, seq, score::BIGINT AS score, (max(score) OVER (PARTITION BY match_id, team ORDER BY sc, seq))::BIGINT AS best FROM f")
def w13(det: DataFrame) -> DataFrame:
    """Each team's running score, floored at zero, and the best it had so far."""
    c = log(det).withColumn("delta", F.expr(_DELTA)).withColumn("team", F.col("user_id") % 2)
    s = floored_scan(c, ["match_id", "team"], ["at", "seq"])
    return running_best(s, ["match_id", "team"], ["at", "seq"], "score", "best").select("match_id", "team", "seq", "score", "best")
