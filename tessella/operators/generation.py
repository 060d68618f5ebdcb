"""Generation sessions: streamed pieces of text become numbered events, and readers resume after the last one they saw.

pieces: session_id, seq (from 1, in order of a session), at (milliseconds), kind (`delta` or what ends a session), text.
events: session_id, event_id (from 1, gapless), kind, at, text. Deltas are gathered into one event until it has `letters`
characters or its next piece comes `wait` milliseconds or more after its first; texts keep their order, and nothing is lost or
repeated: a piece whose seq was seen is passed over, and so is a delta without text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WAIT, LETTERS = 200, 512
#: A replay's bounds: events, and bytes of text.
MOST_EVENTS, MOST_BYTES = 1000, 2 << 20


class Session:
    """What a session carries between pieces: the next event's number, the last piece seen, and the open event's text and times."""

    def __init__(self, event_id: int = 1, seq: int = 0, held: str = "", since: int = 0, last: int = 0):
        self.event_id, self.seq, self.held, self.since, self.last = event_id, seq, held, since, last

    def flush(self) -> list[tuple[int, str, int, str]]:
        if not self.held:
            return []
        out = [(self.event_id, "delta", self.last, self.held)]
        self.event_id, self.held = self.event_id + 1, ""
        return out

    def take(self, seq: int, at: int, kind: str, text: str | None, wait: int, letters: int) -> list[tuple[int, str, int, str]]:
        if seq <= self.seq:
            return []
        self.seq, out = seq, []
        if kind != "delta":
            out += self.flush()
            out.append((self.event_id, kind, at, text or ""))
            self.event_id += 1
            return out
        if not text:
            return []
        if self.held and at - self.since >= wait:
            out += self.flush()
        if not self.held:
            self.since = at
        self.held, self.last = self.held + text, at
        return out + (self.flush() if len(self.held) >= letters else [])


def session_events(pieces: DataFrame, wait: int = WAIT, letters: int = LETTERS) -> DataFrame:
    """The events of a table of pieces. A session's pieces come sorted to one task, which holds its open event alone."""
    kinds = [pieces.limit(0).select("session_id").toArrow().schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, session = None, Session()
        for batch in batches:
            out = []
            for name, seq, at, kind, text in zip(*(c.to_pylist() for c in batch.columns)):
                if name != own:
                    out += [(own, *e) for e in session.flush()]
                    own, session = name, Session()
                out += [(own, *e) for e in session.take(seq, at, kind, text, wait, letters)]
            yield rows(out)
        yield rows([(own, *e) for e in session.flush()])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, kinds)], ["session_id", "event_id", "kind", "at", "text"])

    ordered = pieces.repartition("session_id").sortWithinPartitions("session_id", "seq").select("session_id", F.col("seq").cast("long"), F.col("at").cast("long"), "kind", "text")
    return ordered.mapInArrow(run, f"session_id {dict(pieces.dtypes)['session_id']}, event_id long, kind string, at long, text string")


def stream_events(pieces: DataFrame, wait: int = WAIT, letters: int = LETTERS, idle: bool = True) -> DataFrame:
    """The events of a stream of pieces, from state kept by session.

    With idle an open event is also sent when nothing follows it in time; such a query looks for those for ever, so it suits triggers
    at intervals. Without, it waits for the session's next piece.

    Pieces of a session must not overtake each other from one batch to the next; within a batch they may come in any order.
    """
    schema = f"session_id {dict(pieces.dtypes)['session_id']}, event_id long, kind string, at long, text string"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session = Session(*state.get) if state.exists else Session()
        if idle and state.hasTimedOut:
            out = session.flush()
        else:
            table = pd.concat(list(frames)).sort_values("seq")
            out = [e for r in table.itertuples(index=False) for e in session.take(int(r.seq), int(r.at), r.kind, r.text, wait, letters)]
        state.update((session.event_id, session.seq, session.held, session.since, session.last))
        if idle and session.held:
            state.setTimeoutDuration(max(1, wait))
        yield pd.DataFrame([(key[0], *e) for e in out], columns=["session_id", "event_id", "kind", "at", "text"])

    return pieces.groupBy("session_id").applyInPandasWithState(step, schema, "event_id long, seq long, held string, since long, last long", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def replay(events: DataFrame, seen: DataFrame, most: int = MOST_EVENTS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """What readers (session_id, reader, last_event_id) get on coming back: (session_id, reader, event_id, kind, at, text).

    All later events in order, if they are `most` and `most_bytes` or less; else one `result_snapshot` with the whole text, numbered as
    the last delta, and the events after that delta. Readers of a session who saw everything get nothing.
    """
    later = events.join(seen, "session_id").filter(F.col("event_id") > F.col("last_event_id"))
    load = later.groupBy("session_id", "reader").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    over = load.filter((F.col("n") > most) | (F.col("size") > most_bytes)).select("session_id", "reader")
    names = ["session_id", "reader", "event_id", "kind", "at", "text"]
    increments = later.join(over, ["session_id", "reader"], "left_anti").select(names)
    deltas = events.filter("kind = 'delta'").join(over.select("session_id").distinct(), "session_id", "left_semi")
    # the snapshot is the session's result: one text, as it is kept for good
    result = deltas.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "text"))).alias("all"), F.max("event_id").alias("event_id"), F.max("at").alias("at"))
    whole = result.select("session_id", "event_id", "at", F.array_join(F.transform("all", lambda x: x["text"]), "").alias("text"))
    snapshots = over.join(whole, "session_id").select("session_id", "reader", "event_id", F.lit("result_snapshot").alias("kind"), "at", "text")
    rest = later.join(over, ["session_id", "reader"], "left_semi").join(whole.select("session_id", F.col("event_id").alias("_last")), "session_id").filter(F.col("event_id") > F.col("_last")).select(names)
    return increments.union(snapshots).union(rest)
