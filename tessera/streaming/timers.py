"""The scoreboard as a stream that is driven by timers.

A match's commands wait in a list until the watermark has passed them, so
that they are carried out in the order of their times however they
arrive. A penalty that ends while its clock runs has its time in the
future: a timer stands for the earliest of these ends and of the waiting
commands. When it fires, all that has come due happens at its own time,
and the timer is set anew. A penalty's end therefore shows without any
command after it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.scan import running_sum
from ..operators.store import materialise
from .scoreboard import HAPPENED, NAMES, Board, Team, happen, told

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Seconds whose commands wait together.
HOUR = 3600


class Scoreboard(StatefulProcessor):
    """State of a match: ``board`` (one value), ``penalties`` by id, and ``waiting`` commands by the hour, in ``chunks`` as they came.

    However many commands wait, an hour's are in memory at once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.board = handle.getValueState("board", "text string")
        self.penalties = handle.getMapState("penalties", "id string", "team string, duration int, left double")
        self.waiting = handle.getMapState("waiting", "hour long, chunk long", "rows string")
        self.chunks = handle.getValueState("chunks", "n long")

    def wait(self, rows: list[tuple]) -> None:
        hours: dict[int, list[tuple]] = {}
        for r in rows:
            hours.setdefault(int(r[0] // HOUR), []).append(r)
        n = self.chunks.get()[0] if self.chunks.exists() else 0
        for hour, own in hours.items():
            self.waiting.updateValue((hour, n), (json.dumps(own),))
            n += 1
        self.chunks.update((n,))

    def held(self, hour: int, chunks: list[int]) -> list[tuple]:
        return [tuple(r) for n in chunks for r in json.loads(self.waiting.getValue((hour, n))[0])]

    def load(self, since: float) -> Board:
        if not self.board.exists():
            return Board(since=since)
        board = Board.load(self.board.get()[0])
        for (ident,), (team, duration, left) in sorted(self.penalties.iterator(), key=lambda p: int(p[0][0])):
            board.teams.setdefault(team, Team()).penalties.append({"id": ident, "duration": duration, "left": left})
        return board

    def save(self, board: Board) -> None:
        self.penalties.clear()
        raw = json.loads(board.dump())
        for name, t in raw["teams"].items():
            for p in t["penalties"]:
                self.penalties.updateValue((p["id"],), (name, int(p["duration"]), float(p["left"])))
            t["penalties"] = []
        self.board.update((json.dumps(raw),))

    def alarm(self, times: list[float]) -> None:
        """One timer, at the earliest of the times."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if times:
            self.handle.registerTimer(ceil(min(times) * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        times = [t / 1000 for t in self.handle.listTimers()]
        for pdf in rows:
            fresh = [(float(r.at), int(r.seq), r.path, r.body) for r in pdf.itertuples()]
            self.wait(fresh)
            times = [min(times + [r[0] for r in fresh])]
        self.alarm(times)
        yield pd.DataFrame(columns=NAMES)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        hours: dict[int, list[int]] = {}
        for hour, n in sorted(self.waiting.keys()):
            hours.setdefault(hour, []).append(n)
        board, later = None, []
        for hour in sorted(hours):
            rows = self.held(hour, hours[hour])
            ready, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
            if ready:
                board = board or self.load(min(r[0] for r in ready))
                for n in hours[hour]:
                    self.waiting.removeKey((hour, n))
                if later:
                    self.wait(later)
                yield told(happen(board, int(key[0]), ready))
            if later:
                break
        board = board or self.load(now)
        yield told(happen(board, int(key[0]), [], now))
        self.save(board)
        due = board.due()
        self.alarm([r[0] for r in later] + ([] if due is None else [due]))

    def close(self) -> None:
        pass


@contextmanager
def timers(spark: SparkSession):
    """Inside, the session's streams keep their state where timers can be kept; the setting is put back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def timed(commands: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """What happens to each match (``HAPPENED``), from a stream of commands ``(match_id, seq, at, path, body)``.

    Commands may arrive out of order by up to ``delay``; later ones are
    dropped. To be started inside ``timers``.
    """
    c = commands.withColumn("ts", F.timestamp_millis((F.col("at") * 1000).cast("bigint"))).withWatermark("ts", delay)
    return c.groupBy("match_id").transformWithStateInPandas(Scoreboard(), outputStructType=HAPPENED, outputMode="Append", timeMode="EventTime")


def replay(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, delay: str = "10 minutes", files: int = 1) -> DataFrame:
    """Run a folder of command files through the stream, ``files`` of them at a time, and read what it wrote."""
    with timers(spark):
        stream = timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source), delay)
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(HAPPENED).parquet(sink)


def snapshot(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``match_id, rev, running, penalties, board``: the latest state of each match, read from the stream's state store."""
    with timers(spark):
        var = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
        board = var("board").load().select(F.col("key.match_id").alias("match_id"), F.col("value.text").alias("board"))
        held = var("penalties").option("flattenCollectionTypes", "true").load().select(F.col("key.match_id").alias("match_id"))
        held = held.groupBy("match_id").agg(F.count("*").alias("penalties"))
        state = F.from_json("board", "rev bigint, running boolean")
        out = board.join(held, "match_id", "left").withColumn("state", state)
        return materialise(out.select("match_id", "state.*", F.coalesce("penalties", F.lit(0)).alias("penalties"), "board"))


def catch_up(clients: DataFrame, snapshot: DataFrame, happened: DataFrame) -> DataFrame:
    """What each of ``clients(user_id, match_id, seen)`` is told on return: the snapshot's revision, and how many revisions it missed.

    Revisions are those up to the snapshot; a client that saw later ones
    than the snapshot missed none. Several ends of one time are one
    revision.
    """
    one = happened.where("path = 'expired' or status = 200").select("match_id", F.col("rev").alias("of")).distinct()
    now = snapshot.select("match_id", F.col("rev").alias("snapshot_rev"))
    one = one.join(now, "match_id").where("of <= snapshot_rev").select("match_id", "of")
    c = clients.join(now, "match_id")
    # how many revisions there are up to what each client saw, counted along all of a match's revisions
    rows = one.selectExpr("match_id", "of as at", "1L as n", "cast(null as bigint) as user_id", "cast(null as bigint) as snapshot_rev")
    rows = rows.union(c.select("match_id", F.col("seen").cast("bigint"), F.lit(0).cast("bigint"), "user_id", "snapshot_rev"))
    seen = running_sum(rows.where("match_id is not null"), ["match_id"], ["at"], "n", "before").where("snapshot_rev is not null")
    every = one.groupBy("match_id").agg(F.count("*").alias("every"))
    out = seen.join(every, "match_id", "left").groupBy("user_id", "match_id", "snapshot_rev")
    return out.agg(F.sum(F.coalesce("every", F.lit(0)) - F.when(F.col("at").isNull(), F.coalesce("every", F.lit(0))).otherwise(F.col("before"))).alias("missed"))
