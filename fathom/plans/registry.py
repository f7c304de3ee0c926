"""Session layouts and the choice between an event table and its session table."""

from __future__ import annotations

import uuid
import warnings
from dataclasses import dataclass, field
from datetime import datetime
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sessions


#: The states of a layout, the columns of a session table and the behavioural functions.
class State(Enum):
    BUILDING = "Building"
    ACTIVE = "Active"
    REFRESHING = "Refreshing"
    STALE = "Stale"
    ERROR = "Error"
    DROPPED = "Dropped"


def fingerprint(df: DataFrame) -> tuple:
    """What a table is made of just now: its plan and its files. New, removed or rewritten files change it, as does another definition of a view."""
    return df.semanticHash(), tuple(sorted(df.inputFiles()))


@dataclass
class Layout:
    """A session table of a source: how it was built, from which version and files, and over which time range."""

    name: str
    source: str
    user_key: str
    timeout_seconds: int
    version: int = 0
    state: State = State.BUILDING
    data: DataFrame | None = None
    covers: tuple[datetime | None, datetime | None] = (None, None)
    rows: int = 0
    source_rows: int = 0
    made_of: tuple | None = None
    table: str | None = None


@dataclass(frozen=True)
class Decision:
    use: str
    layout: str | None
    reason: str
    state: str | None = None
    speed_up: float = 1.0


SESSION_COLUMNS = frozenset({"session_id", "session_start", "session_end", "event_sequence", "session_event_count", "session_timeout"})
BEHAVIOURAL = frozenset({"funnel_count", "cohort_analysis", "path_analysis"})


def pattern(functions: set[str], columns: set[str], event_columns: set[str]) -> str:
    """behavioural, hybrid or event, from the functions and resolved columns of a query, not from its text."""
    if {f.lower() for f in functions} & BEHAVIOURAL:
        return "behavioural"
    used = {c.lower() for c in columns}
    if used & SESSION_COLUMNS:
        return "hybrid" if used & ({c.lower() for c in event_columns} - SESSION_COLUMNS) else "behavioural"
    return "event"


@dataclass
class Registry:
    """Layouts by name; table names are case-insensitive. A layout becomes Active only once its data is there."""

    layouts: dict[str, Layout] = field(default_factory=dict)
    versions: dict[str, int] = field(default_factory=dict)

    def create(self, name: str, source: str, events: DataFrame, user_key: str = "user_id", timeout_seconds: int = 1800, covers=(None, None), table: str | None = None, source_rows: int = 0, buckets: int = 0, **columns) -> Layout:
        """Registers a session table of the events; one of the same name is replaced.

        With `table` it is written under that name, dealt by user into `buckets` (the session's number of shuffle partitions by default),
        so behavioural queries read it without a shuffle, and becomes Active once it is there, with its rows counted. Without, it is
        a plan over the events, computed by each query."""
        layout = Layout(name, source.lower(), user_key, timeout_seconds, self.versions.get(source.lower(), 0), covers=covers, source_rows=source_rows, made_of=fingerprint(events), table=table)
        self.layouts[name.lower()] = layout
        try:
            data = sessions.sessionize(events, timeout_seconds, user=user_key, **columns)
            if table:
                spark = events.sparkSession
                n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
                data.write.mode("overwrite").bucketBy(n, "user_key").sortBy("user_key", "session_seq").saveAsTable(table)
                data = spark.table(table)
                layout.rows, layout.source_rows = data.agg(F.count("*"), F.sum("session_event_count")).first()
                layout.source_rows = layout.source_rows or 0
            layout.data, layout.state = data, State.ACTIVE
        except Exception:
            layout.state = State.ERROR
            raise
        return layout

    def changed(self, source: str) -> None:
        """The source has new data: its layouts are stale until refreshed."""
        key = source.lower()
        self.versions[key] = self.versions.get(key, 0) + 1
        for x in self.layouts.values():
            if x.source == key and x.state is State.ACTIVE:
                x.state = State.STALE

    def refresh(self, name: str, events: DataFrame, batch: DataFrame, **columns) -> Layout:
        """Adds a batch: only users in it are built anew. events are those before the batch."""
        x = self.layouts[name.lower()]
        x.state = State.REFRESHING
        try:
            data = sessions.refresh(x.data, events, batch, x.timeout_seconds, user=x.user_key, **columns)
            if x.table:  # a stored table is stored again: under a name of its own first, as the new data are read from the old
                n, fresh = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), f"{x.table}_{uuid.uuid4().hex[:8]}"
                data.write.bucketBy(n, "user_key").sortBy("user_key", "session_seq").saveAsTable(fresh)
                events.sparkSession.sql(f"DROP TABLE IF EXISTS {x.table}")
                events.sparkSession.sql(f"ALTER TABLE {fresh} RENAME TO {x.table}")
                data = events.sparkSession.table(x.table)
                x.rows, x.source_rows = data.agg(F.count("*"), F.coalesce(F.sum("session_event_count"), F.lit(0))).first()
            x.data = data
        except Exception:
            x.state = State.ERROR
            raise
        x.version, x.state, x.made_of = self.versions.get(x.source, 0), State.ACTIVE, None
        return x

    def rebuild(self, name: str, events: DataFrame, **columns) -> Layout:
        """The layout anew from its source as it is now."""
        x = self.layouts[name.lower()]
        return self.create(x.name, x.source, events, x.user_key, x.timeout_seconds, x.covers, x.table, **columns)

    def drop(self, name: str, spark: SparkSession | None = None) -> None:
        x = self.layouts.pop(name.lower())
        x.state = State.DROPPED
        if x.table and spark:
            spark.sql(f"DROP TABLE IF EXISTS {x.table}")

    def decide(self, source: str, user_key: str = "user_id", timeout_seconds: int | None = None, since: datetime | None = None, until: datetime | None = None, route: str = "auto", rows: int = 0, events: DataFrame | None = None) -> Decision:
        """Which layout answers a behavioural query; anything that could change its result falls back to the event table.

        Legal: Active, same user key, same timeout if the query has one, the time range covered, source unchanged since the refresh: nobody said
        changed(), and with `events`, the source as it would be read now, its files and plan are those that the layout was built from.
        Worth it: session rows are fewer than 0.7 times the event rows, where both are known. route: auto, never, or a layout's name to force."""
        if route == "never":
            return Decision("events", None, "not wanted")
        own = [x for x in self.layouts.values() if x.source == source.lower() and (route == "auto" or x.name.lower() == route.lower())]
        reason = "no session table"
        for x in own:
            if x.state is not State.ACTIVE:
                reason = f"{x.name} is {x.state.value}"
            elif x.version != self.versions.get(x.source, 0):
                reason = f"{x.name} is older than its source"
            elif events is not None and x.made_of is not None and x.made_of != fingerprint(events):
                x.state, reason = State.STALE, f"{x.name} is older than its source"
            elif x.user_key != user_key:
                reason = f"{x.name} has another user key"
            elif timeout_seconds is not None and timeout_seconds != x.timeout_seconds:
                reason = f"{x.name} has another timeout"
            elif (x.covers[0] and (since is None or since < x.covers[0])) or (x.covers[1] and (until is None or until > x.covers[1])):
                reason = f"{x.name} covers only part of the range"
            elif route == "auto" and x.rows and x.source_rows and x.rows >= 0.7 * x.source_rows:
                reason = f"{x.name} is not small enough"
            else:
                return Decision("sessions", x.name, "legal", x.state.value, round(x.source_rows / x.rows, 2) if x.rows and x.source_rows else 1.0)
        if not own:
            warnings.warn(guidance(source, rows), stacklevel=2)
        return Decision("events", None, reason)

    def events(self, source: str, table: DataFrame, **options) -> DataFrame:
        """The events for a behavioural operator, from the session table where decide() allows it. Results are the same either way."""
        d = self.decide(source, events=table, **options)
        return sessions.events_of(self.layouts[d.layout.lower()].data) if d.layout else table


def guidance(source: str, rows: int = 0) -> str:
    """What to create so that behavioural queries get a session layout."""
    gain = 5 if rows >= 10_000 else 2
    return f"behavioural query on {source} without a session table; consider CREATE SESSION MATERIALIZED VIEW {source}_sessions FROM {source} USER KEY user_id SESSION TIMEOUT 30 MINUTE (about {gain}x)"
