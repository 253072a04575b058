"""Reading and narration events as streams: status machines, sittings, pauses, partial audio; each with keyed state.

Every operator takes a stream (or, for a replay, a batch) of small event rows
and keeps a few numbers for each key, so state grows with keys, not events.
Within a key, events of a micro-batch are taken in the order of ``ts`` and then
``seq``; ``ts`` is milliseconds of event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.intervals import as_of
from lectern.streaming.timers import MIN_CARD_MS

# Status of a section that is being made, or is over; else it is pending.
IN_FLIGHT = ("synthesizing", "aligning", "encoding")
TERMINAL = ("ready", "failed")
#: Chunks between two marks of a section's progress.
EACH = 10
MIN_SITTING_MS, STALE_MS, GROWN_MS = 1_000, 300_000, 1_500


def read_events(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A stream of Parquet event files from a folder, ``files`` at most in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def with_snapshot(live: DataFrame, snapshot: DataFrame) -> DataFrame:
    """For one consumer: the snapshot's rows (a batch) before the live batch's, as a client sees them that has just connected.

    Within foreachBatch, or for a batch of events. Live rows that the snapshot already shows are left out.
    """
    before = snapshot.withColumn("origin", F.lit(0))
    fresh = live.join(snapshot, snapshot.columns, "left_anti").withColumn("origin", F.lit(1))
    return before.unionByName(fresh.select(*before.columns))


def after_snapshot(snapshot: DataFrame, write):
    """A function for foreachBatch that passes each micro-batch to ``write(rows, number)``, the first one behind the snapshot.

    snapshot is read when that first batch runs; a batch that is run again is
    passed on again under its number (see write_once).
    """
    def pass_on(live: DataFrame, number: int) -> None:
        write(with_snapshot(live, snapshot) if number == 0 else live.select(*snapshot.columns).withColumn("origin", F.lit(1)), number)

    return pass_on


def latest_status(events: DataFrame) -> DataFrame:
    """(book, section, status, ts): the last status of each section, as a running aggregate (update mode) or of a batch."""
    return events.groupBy("book", "section").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "seq")).alias("s")).select("book", "section", "s.status", "s.ts")


def finished_books(sections: DataFrame) -> DataFrame:
    """Books all of whose sections are ready or failed."""
    return sections.groupBy("book").agg(F.bool_and(F.col("status").isin(*TERMINAL)).alias("done")).where("done").select("book")


def _ordered(frames: Iterator[pd.DataFrame]) -> list:
    rows = pd.concat(list(frames))
    return list(rows.sort_values(["ts", "seq"], kind="stable").itertuples(index=False))


def _stateful(events: DataFrame, keys: list[str], step, out: str, state: str) -> DataFrame:
    """events through step(key, rows, state values or None) -> (output rows, new state values, or None to forget the key).

    Of a batch, events are sorted by key and time and folded as they come, so
    no key's events are held at once; null keys are keys of their own there.
    """
    names = [c.split()[0] for c in out.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows, now = step(key, _ordered(frames), held.get if held.exists else None)
        if now is not None:
            held.update(now)
        elif held.exists:
            held.remove()
        yield pd.DataFrame([(*key, *r) for r in rows], columns=names)

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for frame in frames:
            rows = []
            for key, part in frame.groupby(keys, sort=False, dropna=False):
                held = held if key == last else None
                found, held = step(key, list(part.itertuples(index=False)), held)
                rows += [(*key, *r) for r in found]
                last = key
            yield pd.DataFrame(rows, columns=names)

    if not events.isStreaming:
        return events.repartition(*keys).sortWithinPartitions(*keys, "ts", "seq").mapInPandas(replay, out)
    return events.groupBy(*keys).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


# -- narration -------------------------------------------------------------------------------


def section_progress(events: DataFrame) -> DataFrame:
    """(book, section, ts, status, done, marked) of each change of a section: its status, its finished chunks, and those marked so far.

    events: book, section, ts, seq, kind (``status`` or ``chunk``), status,
    chunk. A chunk counts once. Every EACH chunks the finished ones are marked,
    and marks never shrink while a section is made. Failing puts all chunks
    back; being ready clears them, for the section is then whole.
    """
    def step(key, rows, held):
        status, chunks, marked = held or ("pending", "", 0)
        done = set(map(int, chunks.split())) if chunks else set()
        out = []
        for e in rows:
            if e.kind == "chunk":
                if e.chunk in done:
                    continue
                done.add(int(e.chunk))
                if len(done) % EACH:
                    continue
                marked = max(marked, len(done))
            else:
                status = e.status
                if status in TERMINAL:
                    done, marked = set(), 0
            out.append((int(e.ts), status, len(done), marked))
        return out, (status, " ".join(map(str, sorted(done))), marked)

    return _stateful(events, ["book", "section"], step, "book long, section int, ts long, status string, done int, marked int", "status string, chunks string, marked int")


def distinct_chunks(events: DataFrame) -> DataFrame:
    """(book, section, chunk, ts) of each finished chunk that its section doesn't have yet; a section's chunks are forgotten, state and all, when it is ready.

    events: as for section_progress. State is kept for sections that are being made only.
    """
    def step(key, rows, held):
        done, out = set(held[0] if held else ()), []
        for e in rows:
            if e.kind == "status":
                done = set() if e.status == "ready" else done
            elif e.chunk not in done:
                done.add(int(e.chunk))
                out.append((int(e.chunk), int(e.ts)))
        return out, (sorted(done),) if done else None

    return _stateful(events, ["book", "section"], step, "book long, section int, chunk int, ts long", "done array<int>")


def chunks_within(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Finished-chunk events of a stream, once for each (book, section, chunk) within ``delay`` of event time; what is older leaves the state."""
    marked = events.where("kind = 'chunk'").withColumn("at", F.timestamp_millis("ts")).withWatermark("at", delay)
    return marked.dropDuplicatesWithinWatermark(["book", "section", "chunk"]).drop("at")


def recovered(sections: DataFrame) -> DataFrame:
    """sections (book, section, status and others) as a start finds them: in flight under no worker, or failed, become pending; ``reset`` tells which."""
    reset = F.col("status").isin(*IN_FLIGHT, "failed")
    return sections.withColumn("reset", F.coalesce(reset, F.lit(False))).withColumn("status", F.when(reset, "pending").otherwise(F.col("status")))


def write_once(path: str):
    """A function for foreachBatch: each micro-batch's rows in a folder of its number, which a repeated batch replaces.

    A query that stops between writing and its checkpoint runs that batch again;
    its rows stand once all the same. Read the rows with ``read_once``.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_once(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_once has written, with the number of its batch."""
    return spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path)


def resumptions(events: DataFrame) -> DataFrame:
    """(book, section, ts, partial_ms) where parked playback goes on: the section is ready, or its playable beginning has grown by GROWN_MS since.

    events: book, section, ts, seq, kind (``park``, ``partial`` or ``ready``), partial_ms.
    """
    def step(key, rows, held):
        parked, base, known = held or (False, 0, 0)
        out = []
        for e in rows:
            if e.kind == "park":
                parked, base = True, known
            else:
                known = max(known, int(e.partial_ms or 0))
                if parked and (e.kind == "ready" or known - base >= GROWN_MS):
                    parked = False
                    out.append((int(e.ts), known))
        return out, (parked, base, known)

    return _stateful(events, ["book", "section"], step, "book long, section int, ts long, partial_ms long", "parked boolean, base long, known long")


# -- reading -----------------------------------------------------------------------------------


def sittings(events: DataFrame) -> DataFrame:
    """(user, book, started, ended, active_ms) of sittings of a second or more: time between play and pause, from opening a book to closing it.

    events: user, book, ts, seq, kind (``open``, ``close``, ``play``, ``pause``).
    Opening a book closes the one before; if playback runs then, it counts for the new one at once.
    """
    def step(key, rows, held):
        book, started, active, since, playing = held or (-1, 0, 0, -1, False)
        out = []

        def end(ts):
            nonlocal book, active, since
            if book >= 0:
                if since >= 0:
                    active += ts - since
                if active >= MIN_SITTING_MS:
                    out.append((book, started, ts, active))
            book, active, since = -1, 0, -1

        for e in rows:
            ts = int(e.ts)
            if e.kind == "open":
                end(ts)
                book, started, since = int(e.book), ts, ts if playing else -1
            elif e.kind == "close":
                end(ts)
            elif e.kind == "play":
                playing = True
                if book >= 0 and since < 0:
                    since = ts
            else:
                playing = False
                if since >= 0:
                    active, since = active + ts - since, -1
        return out, (book, started, active, since, playing)

    return _stateful(events, ["user"], step, "user long, book long, started long, ended long, active_ms long", "book long, started long, active long, since long, playing boolean")


def celebrated(sittings_ended: DataFrame, opened: DataFrame) -> DataFrame:
    """Sittings (user, started, active_ms) to celebrate when the library opens (user, ts): long enough, and over for STALE_MS at most.

    The last sitting begun before each opening, found by one pass over both in
    time; an older one isn't celebrated any more. Of a stream, within foreachBatch.
    """
    long_ = sittings_ended.where(F.col("active_ms") >= MIN_CARD_MS).select("user", "started", "active_ms")
    found = as_of(opened.select("user", "ts"), long_, ["user"], "ts", "started", ["started", "active_ms"], "active_ms")
    return found.where(F.col("ts") - (F.col("started") + F.col("active_ms")) <= STALE_MS).select("user", "ts", "started", "active_ms")


def changed(counts: DataFrame) -> DataFrame:
    """Polls (book, ts, seq, ready) whose number of ready sections differs from the one before."""
    def step(key, rows, held):
        last, out = (held or (-1,))[0], []
        for e in rows:
            if e.ready != last:
                last = int(e.ready)
                out.append((int(e.ts), last))
        return out, (last,)

    return _stateful(counts, ["book"], step, "book long, ts long, ready int", "ready int")
