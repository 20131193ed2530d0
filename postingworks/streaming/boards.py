"""The queue's liveness as keyed state: one stateful processor per board, run days applied in event-time order.

Snapshot rows of a board wait in its state until the watermark has passed their run day; then a timer applies the day, so
rows may come in any order and in any number of files within the allowed lateness. What changes is appended to a log; the
queue at any time is its first content with the last change of each row. State lives in RocksDB: a board's postings are
parts of a map there and its rows stream past, so no board has to fit in memory. A board whose runs stop gets a `silent`
row once that many days have gone by without one.
"""

from __future__ import annotations

import datetime
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from postingworks.functions import fixed_values as fv
from postingworks.functions.scale import last_row

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTRY = "id string, last_seen_live date, miss_count int, closed_on date, closed_reason string, repost_count int, reposted_on date"
COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]
CHANGES = f"company string, posting_id string, run_date date, event string, {ENTRY}"
SILENT_AFTER = 14
DAY = datetime.timedelta(days=1)
DAY_MS = 86_400_000
DATES = ("last_seen_live", "closed_on", "reposted_on")
PARTS = 256
HELD_ROWS = 200_000


def _ms(day: datetime.date) -> int:
    return (day - datetime.date(1970, 1, 1)).days * DAY_MS


def _plain(value):
    return None if value is None or value is pd.NaT or value != value else value


def _part(posting: str | None) -> int:
    return zlib.crc32((posting or "").encode()) % PARTS


def _dated(entry: tuple) -> tuple:
    return tuple(datetime.date.fromisoformat(v) if c in DATES and v else v for c, v in zip(COLUMNS, entry))


class Board(StatefulProcessor):
    """State of one board: its queue rows, the rows of run days to come, and its last run.

    Postings are kept in parts by a hash, each part one JSON list, so a call to the state store moves many of them. A part
    is read, changed and written at a time; rows that wait are appended in pieces and never read before their day.
    """

    def __init__(self, silent_after: int = SILENT_AFTER) -> None:
        self.silent_after = silent_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "part int", "rows string")
        self.waiting = handle.getMapState("waiting", "run_date date, part int, piece int", "postings string")
        self.days = handle.getMapState("days", "run_date date", "complete boolean, board_type string")
        self.pieces = handle.getValueState("pieces", "n int")
        self.last_run = handle.getValueState("last_run", "run_date date")

    def _load(self, part: int) -> dict:
        """{posting: row in the order of `COLUMNS`} of a part, days as ISO text."""
        packed = self.entries.getValue((part,))
        return {row[0]: tuple(row[1:]) for row in json.loads(packed[0])} if packed else {}

    def _store(self, part: int, rows: dict) -> None:
        self.entries.updateValue((part,), (json.dumps([[posting, *entry] for posting, entry in rows.items()]),))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        fresh = defaultdict(dict)
        for row in initialState.itertuples(index=False):
            posting = _plain(row.posting_id)
            values = [_plain(getattr(row, c)) for c in COLUMNS]
            fresh[_part(posting)][posting] = tuple(int(v or 0) if c in ("miss_count", "repost_count") else v.isoformat() if c in DATES and v else v
                                                   for c, v in zip(COLUMNS, values))
        for part, rows in fresh.items():
            self._store(part, {**self._load(part), **rows})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not key[0]:  # a heartbeat, which only moves the watermark
            return iter([])
        done = self.last_run.get()
        facts, held, n = {}, defaultdict(set), 0
        for some in rows:
            # a day that is applied already changes nothing; marker rows have no posting
            some = some[some["run_date"].notna()]
            open_days = some if done is None else some[some["run_date"] > done[0]]
            for day, whole, kind, posting in open_days[["run_date", "complete", "board_type", "posting_id"]].drop_duplicates().itertuples(index=False):
                complete, known = facts.get(day, (True, None))
                whole, kind = _plain(whole), _plain(kind)
                facts[day] = (complete and (whole is None or bool(whole)), max(filter(None, (known, kind)), default=None))
                if _plain(posting):
                    held[day, _part(posting)].add(posting)
                    n += 1
            if n >= HELD_ROWS:
                self._keep(held)
                held, n = defaultdict(set), 0
        self._keep(held)
        for day, (complete, kind) in facts.items():
            before = self.days.getValue((day,)) or (True, None)
            self.days.updateValue((day,), (bool(before[0]) and complete, max(filter(None, (before[1], kind)), default=None)))
            self.handle.registerTimer(_ms(day + DAY))
        return iter([])

    def _keep(self, held: dict) -> None:
        if held:
            piece = (self.pieces.get() or (0,))[0]
            for (day, part), postings in held.items():
                self.waiting.updateValue((day, part, piece), (json.dumps(sorted(postings)),))
            self.pieces.update((piece + 1,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, odd = divmod(expiredTimerInfo.getExpiryTimeInMs(), DAY_MS)
        day = datetime.date(1970, 1, 1) + datetime.timedelta(days=at)
        last = self.last_run.get()
        if odd:  # the board's silence
            if last is not None and last[0] + datetime.timedelta(days=self.silent_after) == day:
                yield pd.DataFrame([(key[0], None, day, "silent", *[None] * len(COLUMNS))], columns=self._names())
            return
        day -= DAY
        if last is not None and day <= last[0]:
            return
        self.last_run.update((day,))
        self.handle.registerTimer(_ms(day + datetime.timedelta(days=self.silent_after)) + 1)
        for changed in self._apply(day):
            for a in range(0, len(changed), 5000):
                yield pd.DataFrame([(key[0], posting, day, event, *entry) for posting, event, entry in changed[a:a + 5000]],
                                   columns=self._names())

    @staticmethod
    def _names() -> list[str]:
        return ["company", "posting_id", "run_date", "event", *COLUMNS]

    def _apply(self, day: datetime.date) -> Iterator[list]:
        """What a day's waiting rows change, part by part; no more than a part is held."""
        complete, kind = self.days.getValue((day,)) or (True, None)
        self.days.removeKey((day,))
        pieces = defaultdict(list)
        for run_date, part, piece in list(self.waiting.keys()):
            if run_date == day:
                pieces[part].append(piece)
        if pieces:  # an empty listing changes nothing
            parts = sorted(part for part, in self.entries.keys())

            def live(part: int) -> set:
                return {p for piece in pieces.get(part, ()) for p in json.loads(self.waiting.getValue((day, part, piece))[0])}

            open_rows = missing = 0
            for part in parts:
                there = live(part)
                for posting, entry in self._load(part).items():
                    if entry[3] is None:
                        open_rows += 1
                        missing += posting not in there
            vanish = open_rows >= fv.MASS_VANISH_MIN_OPEN and missing / open_rows > fv.MASS_VANISH_FRACTION
            limit = fv.CLOSE_AFTER_MISSES * (fv.MASS_VANISH_FACTOR if vanish else 1)
            for part in parts:
                there, rows, changed = live(part), self._load(part), []
                for posting, entry in rows.items():
                    event, after = entry_after(entry, posting in there, complete, limit, kind in fv.CHECKABLE_TYPES, day.isoformat())
                    if after != entry:
                        rows[posting] = after
                        changed.append((posting, event, _dated(after)))
                if changed:
                    self._store(part, rows)
                    yield changed
            for part, some in pieces.items():
                for piece in some:
                    self.waiting.removeKey((day, part, piece))

    def close(self) -> None:
        pass


def entry_after(entry: tuple, live: bool, complete: bool, limit: int, checkable: bool, day: datetime.date | str) -> tuple[str | None, tuple]:
    """A queue row (in the order of `COLUMNS`) after one listing of its board: the event and the row; days all as dates or ISO text."""
    row, seen, misses, closed_on, reason, reposts, reposted_on = entry
    if live:
        if closed_on is None or reason == "manual":
            return None, (row, day, 0, closed_on, reason, reposts, reposted_on)
        return "reopened", (row, day, 0, None, None, reposts + 1, day)
    if not complete or closed_on is not None:
        return None, entry
    due = misses + 1 >= limit and (seen is None or seen < day)
    if due and checkable:  # without a double check it counts as listed
        return None, (row, day, 0, closed_on, reason, reposts, reposted_on)
    if due:
        return "closed", (row, seen, misses + 1, day, "removed", reposts, reposted_on)
    return None, (row, seen, misses + 1, closed_on, reason, reposts, reposted_on)


def board_changes(snapshots: DataFrame, queue: DataFrame, late: str = "7 days", silent_after: int = SILENT_AFTER) -> DataFrame:
    """The streamed changes of the queue. `snapshots(company, posting_id, run_date, complete, board_type)` is a stream; rows
    of a day later than the watermark change nothing, a null posting says that the board was read. A row of the empty company
    is a heartbeat: its day moves the watermark and nothing else."""
    spark = queue.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = snapshots.select("company", "posting_id", "run_date", "complete", "board_type", F.col("run_date").cast("timestamp").alias("ts"))
    first = queue.select("company", "posting_id", *COLUMNS).groupBy("company")
    return rows.where("company IS NOT NULL").withWatermark("ts", late).groupBy("company").transformWithStateInPandas(
        statefulProcessor=Board(silent_after), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime", initialState=first)


def follow_boards(snapshots: DataFrame, queue: DataFrame, log: str, checkpoint: str, **options) -> StreamingQuery:
    """Starts the stream that appends the queue's changes to `log`; it goes on from its checkpoint when started again."""
    return (board_changes(snapshots, queue, **options).writeStream.format("parquet").option("path", log)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def queue_after(queue: DataFrame, changes: DataFrame) -> DataFrame:
    """The queue with the last change of each of its rows."""
    last = last_row(changes.where("id IS NOT NULL").select("company", "posting_id", "run_date", *COLUMNS), ["company", "posting_id"],
                    F.col("run_date")).select("company", "posting_id", F.struct(*COLUMNS).alias("_now"))
    joined = queue.join(last, ["company", "posting_id"], "left")
    return joined.select(*[F.when(F.col("_now").isNull(), F.col(c)).otherwise(F.col(f"_now.{c}")).alias(c) if c in COLUMNS[1:] else F.col(c)
                           for c in queue.columns])
