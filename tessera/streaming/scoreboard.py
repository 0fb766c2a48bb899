"""Live scoreboard: command parsing, closed forms over windows, and a keyed fold for batch and stream.

Time is data: every command carries its epoch seconds, so results do not
depend on when a query runs. Where a running value has a closed form it is
computed with windows; the whole state is a fold per match.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Paths of commands (fixed values).
PATHS = [
    "/score", "/score/set", "/team", "/team/logo", "/main/logo", "/period", "/period/duration", "/period/ot_duration", "/visible", "/clock/start",
    "/clock/pause", "/clock/reset", "/clock/direction", "/clock/adjust", "/penalty/add", "/penalty/remove", "/penalty/clear", "/swap",
]
#: Lengths in seconds (fixed values): a period, an overtime, penalties; penalties of a team at once.
PERIOD, OVERTIME, PENALTIES, MOST = 1500, 300, (120, 300, 600), 3
#: Seconds left at which a penalty counts as over (fixed value).
OVER = 0.05
BODY = "team string, delta double, value string, duration int, id string, seconds double, label string, resetClock boolean, name string, short string, color string, textColor string, bgMode string, broken string"


def parse_commands(df: DataFrame) -> DataFrame:
    """Typed commands of ``path`` and ``body``, with the status that the caller would be answered."""
    out = df.withColumn("data", F.from_json("body", BODY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
    status = F.when(F.col("data.broken").isNotNull() | F.col("data").isNull(), 400).when(~F.col("path").isin(PATHS), 404).otherwise(200)
    return out.withColumn("status", status)


def running_changes(df: DataFrame, keys: list[str], order: list[str], on: str = "running") -> DataFrame:
    """Only commands that change the state count: repeats of start or pause are dropped."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("before", F.lag(on, 1, False).over(w)).where(F.col(on) != F.col("before")).drop("before")


def running_spans(changes: DataFrame, keys: list[str], at: str = "at", on: str = "running") -> DataFrame:
    """From each start to the next pause; the last may be open."""
    w = W.partitionBy(*keys).orderBy(at)
    return changes.withColumn("until", F.lead(at).over(w)).where(F.col(on)).select(*keys, F.col(at).alias("since"), "until")


def elapsed(since: Column, until: Column, now: Column) -> Column:
    """Seconds of a span before ``now``."""
    return F.greatest(F.lit(0), F.least(F.coalesce(until, now), now) - since)


@dataclass
class Team:
    score: int = 0
    fields: dict[str, str] = field(default_factory=dict)
    penalties: list[dict[str, Any]] = field(default_factory=list)


@dataclass
class Board:
    """State of a match. ``left`` is the clock's value at ``since``; penalties run while it runs."""

    teams: dict[str, Team] = field(default_factory=lambda: {"A": Team(), "B": Team()})
    label: str = "P1"
    lengths: dict[str, int] = field(default_factory=lambda: {"period": PERIOD, "overtime": OVERTIME})
    running: bool = False
    up: bool = False
    left: float = float(PERIOD)
    since: float = 0.0
    visible: bool = True
    logo: str = ""
    rev: int = 0
    made: int = 0

    @classmethod
    def load(cls, text: str) -> Board:
        raw = json.loads(text)
        raw["teams"] = {k: Team(**t) for k, t in raw["teams"].items()}
        return cls(**raw)

    def dump(self) -> str:
        return json.dumps(asdict(self))

    def kind(self) -> str:
        return "overtime" if self.label.upper().startswith("PROL") else "period"

    def clock(self, now: float) -> float:
        """The clock's value; one that counts up has no limit."""
        if not self.running:
            return self.left
        gone = now - self.since
        return self.left + gone if self.up else max(0.0, self.left - gone)

    def settle(self, now: float) -> None:
        """Bring all values to ``now``."""
        gone = now - self.since if self.running else 0.0
        self.left = self.clock(now)
        for t in self.teams.values():
            for p in t.penalties:
                p["left"] = max(0.0, p["left"] - gone)
        self.since = now

    def due(self) -> float | None:
        """When the next penalty is over, if no command comes before."""
        ends = [self.since + max(0.0, p["left"] - OVER) for t in self.teams.values() for p in t.penalties]
        return min(ends, default=None) if self.running else None

    def expire(self, now: float) -> list[tuple[float, str, str, int]]:
        """Bring the state to ``now``: time, team, penalty and revision of those that were over on the way, each at its own time.

        All that end at one time are one revision.
        """
        gone = []
        while (at := self.due()) is not None and at <= now:
            self.settle(at)
            self.rev += 1
            for name, t in self.teams.items():
                gone += [(at, name, p["id"], self.rev) for p in t.penalties if p["left"] <= OVER + 1e-6]
                t.penalties = [p for p in t.penalties if p["left"] > OVER + 1e-6]
        self.settle(now)
        return gone

    def rearm(self) -> None:
        self.running, self.up, self.left = False, False, float(self.lengths[self.kind()])

    def apply(self, path: str, data: dict[str, Any], now: float) -> int:
        """Carry out a command; 200 bumps the revision, 404 and 400 (a value that is no number) leave the state as it was."""
        self.expire(now)
        step = COMMANDS.get(path)
        try:
            if step is None or step(self, data) is False:
                return 404
        except (TypeError, ValueError, OverflowError):
            return 400
        self.rev += 1
        return 200

    def receive(self, path: str, body: str | None, now: float) -> int:
        """Carry out a command as it came in; a body that is no JSON object is answered with 400, an absent one is empty."""
        try:
            data = json.loads(body) if body else {}
        except ValueError:
            data = None
        if not isinstance(data, dict):
            self.expire(now)
            return 400
        return self.apply(path, data, now)


def _team(b: Board, d: dict[str, Any]) -> Team:
    return b.teams["A" if d["team"] == "A" else "B"]


def _needs_team(f):
    return lambda b, d: f(b, d, _team(b, d)) if "team" in d else False


def _score(b, d, t):
    t.score = max(0, t.score + int(d.get("delta", 0)))


def _set(b, d, t):
    if "value" not in d:
        return False
    t.score = max(0, int(d["value"]))


def _look(b, d, t):
    t.fields |= {k: d[k] for k in ("name", "short", "color", "textColor") if k in d}
    if d.get("bgMode") in ("gradient", "color", "none"):
        t.fields["bgMode"] = d["bgMode"]


def _team_logo(b, d, t):
    t.fields["logo"] = str(d.get("value", ""))


def _main_logo(b, d):
    b.logo = str(d.get("value", ""))


def _period(b, d):
    b.label = str(d.get("label", b.label)).upper()
    if d.get("resetClock", True):
        b.rearm()


def _length(kind, default):
    def run(b, d):
        b.lengths[kind] = max(1, int(d.get("value", default)))
        if b.kind() == kind and not b.running:
            b.rearm()

    return run


def _visible(b, d):
    b.visible = bool(d.get("value", True))


def _run(on):
    def run(b, d):
        b.running = on

    return run


def _reset(b, d):
    if "seconds" in d:
        b.running, b.left = False, max(0.0, float(d["seconds"]))
    else:
        b.rearm()


def _direction(b, d):
    way = d.get("value", "up")
    if way not in ("up", "down"):
        return False
    b.up = way == "up"


def _adjust(b, d):
    b.left = max(0.0, b.left + float(d.get("delta", 0)))


def _penalty(b, d, t):
    length = int(d.get("duration", PENALTIES[0]))
    if len(t.penalties) >= MOST:
        return False
    length = length if length in PENALTIES else PENALTIES[0]
    b.made += 1
    # penalties are numbered here; an id that a caller sends is not looked at
    t.penalties.append({"id": str(b.made), "duration": length, "left": float(length)})


def _remove(b, d, t):
    t.penalties = [p for p in t.penalties if p["id"] != str(d.get("id", ""))]


def _clear(b, d, t):
    t.penalties = []


def _swap(b, d):
    b.teams = {"A": b.teams["B"], "B": b.teams["A"]}


COMMANDS = dict(
    zip(
        PATHS,
        [
            _needs_team(_score), _needs_team(_set), _needs_team(_look), _needs_team(_team_logo), _main_logo, _period, _length("period", PERIOD),
            _length("overtime", OVERTIME), _visible, _run(True), _run(False), _reset, _direction, _adjust, _needs_team(_penalty), _needs_team(_remove),
            _needs_team(_clear), _swap,
        ],
    )
)

RESULT = "match_id bigint, seq bigint, status int, rev bigint, score_a bigint, score_b bigint, clock double, running boolean, penalties_a int, penalties_b int, label string"


def _rows(board: Board, match: int, pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in pdf.sort_values(["at", "seq"]).itertuples():
        status = board.receive(r.path, r.body, float(r.at))
        a, b = board.teams["A"], board.teams["B"]
        out.append((match, r.seq, status, board.rev, a.score, b.score, board.clock(float(r.at)), board.running, len(a.penalties), len(b.penalties), board.label))
    return pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])


def in_order(commands: DataFrame) -> DataFrame:
    """Each match's commands in one partition and in order of time, so that a fold sees them batch by batch."""
    n = int(commands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return commands.repartition(n, "match_id").sortWithinPartitions("match_id", "at", "seq")


def stretches(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[int, bool, pd.DataFrame]]:
    """Of batches in order, each match's rows: its number, whether it begins here, and the rows."""
    last = None
    for pdf in parts:
        for match, own in pdf.groupby("match_id", sort=False):
            yield int(match), match != last, own
            last = match


def fold(commands: DataFrame) -> DataFrame:
    """State after each command of ``(match_id, seq, at, path, body)``; matches are folded in parallel, each in batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for match, new, pdf in stretches(parts):
            if new:
                board = Board(since=float(pdf["at"].iloc[0]))
            yield _rows(board, match, pdf)

    return in_order(commands.where("match_id is not null")).mapInPandas(run, RESULT)


def stream(commands: DataFrame) -> DataFrame:
    """The same fold over a stream; each match's state is kept between micro-batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches))
        board = Board.load(state.get[0]) if state.exists else Board(since=float(pdf["at"].min()))
        out = _rows(board, int(key[0]), pdf)
        state.update((board.dump(),))
        yield out

    return commands.groupBy("match_id").applyInPandasWithState(run, RESULT, "board string", "append", GroupStateTimeout.NoTimeout)


#: What happens to a match: its commands, and penalties that are over, under the path ``expired``.
HAPPENED = "match_id bigint, at double, seq bigint, path string, status int, rev bigint, team string, penalty string"


def happen(board: Board, match: int, rows: list[tuple[float, int, str, str | None]], until: float | None = None) -> list[tuple]:
    """Carry out commands ``(at, seq, path, body)`` in order; with what is over on the way and, after the last of them, ``until`` then."""

    def over(gone: list[tuple[float, str, str, int]]) -> list[tuple]:
        return [(match, at, None, "expired", None, rev, team, penalty) for at, team, penalty, rev in gone]

    out = []
    for at, seq, path, body in sorted(rows, key=lambda r: r[:2]):
        out += over(board.expire(at))
        status = board.receive(path, body, at)
        out.append((match, at, seq, path, status, board.rev, None, None))
    if until is not None:
        while (at := board.due()) is not None and at <= until:
            out += over(board.expire(at))
    return out


def told(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES).astype({"seq": "Int64", "status": "Int64"})


def happenings(commands: DataFrame, until: float = float("inf")) -> DataFrame:
    """Each match's commands and ends of penalties, each at its own time, up to ``until``; matches are folded in parallel, each in batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        board, last = None, None
        for match, new, pdf in stretches(parts):
            if new:
                if board is not None:
                    yield told(happen(board, last, [], until))
                board, last = Board(since=float(pdf["at"].iloc[0])), match
            yield told(happen(board, match, [(float(r.at), r.seq, r.path, r.body) for r in pdf.itertuples()]))
        if board is not None:
            yield told(happen(board, last, [], until))

    return in_order(commands.where("match_id is not null")).mapInPandas(run, HAPPENED)


NAMES = [c.split()[0] for c in HAPPENED.split(", ")]


def snapshot(states: DataFrame) -> DataFrame:
    """The latest state of each match, which a new subscriber gets first."""
    last = F.row_number().over(W.partitionBy("match_id").orderBy(F.desc("rev"), F.desc("seq")))
    return states.withColumn("rn", last).where("rn = 1").drop("rn")
