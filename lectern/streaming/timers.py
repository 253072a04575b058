"""Event-time folds with timers: pauses that nothing follows, work whose grace ends, retries; in order whatever the order of arrival.

A fold handles the events of one key in the order of ``ts`` and then ``seq`` and may
ask for a timer. On a stream, events wait in the state until the watermark has
passed them, so late and reordered ones are folded as if they had come in time,
and a timer fires once the watermark has passed it, event or not. A batch is
folded as it lies and closes at its last time. Both give the same rows.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegralType

MIN_CARD_MS, COOLDOWN_MS, DEBOUNCE_MS = 60_000, 60_000, 1_200
#: How long work outside the window is kept.
GRACE_MS = 480_000
#: Tries after the first one.
RETRIES = 2
#: Failures in a row after which a model isn't asked any more.
MOST_FAILURES = 3
#: How long a deleted book's late results are still known as such.
GONE_MS = 86_400_000


class Fold:
    """What a key's events do: ``step`` and ``fire`` return rows and the new state, ``due`` the time of the next timer or None.

    A state is None or what JSON can say; a key whose state is None takes no room.
    """

    def step(self, event, state) -> tuple[list[tuple], object]:
        raise NotImplementedError

    def due(self, state) -> int | None:
        return None

    def fire(self, state) -> tuple[list[tuple], object]:
        raise NotImplementedError

    def until(self, state, ts: int) -> tuple[list[tuple], object]:
        """All timers up to ts, in their order."""
        out = []
        while state is not None and (at := self.due(state)) is not None and at <= ts:
            rows, state = self.fire(state)
            out += rows
        return out, state

    def advance(self, events, state) -> tuple[list[tuple], object]:
        """Events in order, each after the timers that are due by then."""
        out = []
        for e in events:
            fired, state = self.until(state, int(e.ts))
            rows, state = self.step(e, state)
            out += fired + rows
        return out, state


def folded(events: DataFrame, keys: list[str], fold: Fold, out: str, delay: str = "10 seconds", until: int | None = None) -> DataFrame:
    """Rows of a fold over events (keys, ts in milliseconds, seq, and what the fold reads), as ``out`` says.

    Stream: append mode; events later than ``delay`` behind the newest are
    dropped by the watermark. The state of a key is its fold's state and the
    events of the last ``delay``; a key with neither is forgotten. Batch: sorted
    by key and time within tasks, a key's events are never held at once; timers
    fire up to ``until``, by default the largest ts of the batch.

    Edge cases: a null ts raises; null keys are one key; an event without a ``seq`` order keeps any order.
    """
    names = [c.split()[0] for c in out.split(", ")]
    fields = [c for c in events.columns if c not in keys]
    places = {c: i for i, c in enumerate(fields)}
    ts, seq = places["ts"], places["seq"]
    whole = [isinstance(events.schema[c].dataType, IntegralType) for c in fields]
    Event = namedtuple("Event", fields)

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, waiting = map(json.loads, held.get) if held.exists else (None, [])
        if not held.hasTimedOut:
            for frame in frames:
                waiting += _rows(frame[fields], whole)
        mark = held.getCurrentWatermarkMs()
        waiting.sort(key=lambda r: (r[ts], r[seq]))
        ready = next((i for i, r in enumerate(waiting) if r[ts] > mark), len(waiting))
        rows, state = fold.advance([Event(*r) for r in waiting[:ready]], state)
        fired, state = fold.until(state, mark)
        waiting = waiting[ready:]
        if state is None and not waiting:
            if held.exists:
                held.remove()
        else:
            held.update((json.dumps(state), json.dumps(waiting)))
            due = fold.due(state) if state is not None else None
            timers = [r[ts] for r in waiting[:1]] + ([due] if due is not None else [])
            if timers:
                held.setTimeoutTimestamp(min(timers))  # later than the mark: what is due by then has been done
        yield pd.DataFrame([(*key, *r) for r in rows + fired], columns=names)

    if events.isStreaming:
        marked = events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", delay)
        return marked.groupBy(*keys).applyInPandasWithState(run, out, "state string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
    end = until if until is not None else events.agg(F.max("ts")).first()[0]

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for frame in frames:
            rows = []
            for key, part in frame.groupby(keys, sort=False, dropna=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                if last is not None and key != last:
                    rows += [(*last, *r) for r in fold.until(state, end)[0]]
                    state = None
                found, state = fold.advance((Event(*r) for r in _rows(part[fields], whole)), state)
                rows += [(*key, *r) for r in found]
                last = key
            yield pd.DataFrame(rows, columns=names)
        if last is not None:
            yield pd.DataFrame([(*last, *r) for r in fold.until(state, end)[0]], columns=names)

    return events.repartition(*keys).sortWithinPartitions(*keys, "ts", "seq").mapInPandas(replay, out)


def _rows(frame: pd.DataFrame, whole: list[bool]) -> list[list]:
    """Rows as lists of what JSON can say: nulls are None, whole numbers ints."""
    return [[None if v is None or pd.isna(v) else int(v) if w else v for v, w in zip(r, whole)] for r in frame.itertuples(index=False, name=None)]


# -- reading ---------------------------------------------------------------------------------


class PauseCards(Fold):
    """State: reading so far, since when, the pause that waits, the last card."""

    def step(self, e, state):
        active, since, waiting, shown = state or (0, -1, -1, -1)
        if e.kind == "play":
            waiting, since = -1, e.ts if since < 0 else since
        elif since >= 0:
            active, since, waiting = active + e.ts - since, -1, e.ts
        return [], (active, since, waiting, shown)

    def due(self, state):
        return state[2] + DEBOUNCE_MS if state[2] >= 0 else None

    def fire(self, state):
        active, since, waiting, shown = state
        at = waiting + DEBOUNCE_MS
        if active >= MIN_CARD_MS and (shown < 0 or at - shown >= COOLDOWN_MS):
            return [(at, active)], (active, since, -1, at)
        return [], (active, since, -1, shown)


def pause_cards(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """(user, ts, active_ms) of cards shown at pauses: DEBOUNCE_MS after one that no play follows by then, MIN_CARD_MS of reading at least, COOLDOWN_MS apart.

    events: user, ts, seq, kind (``play`` or ``pause``). A pause with nothing
    after it gives its card when the watermark passes (of a batch: when its last
    time is that late).
    """
    return folded(events.select("user", "ts", "seq", "kind"), ["user"], PauseCards(), "user long, ts long, active_ms long", delay)


class Toggles(Fold):
    """State: [mark, lo, hi, color] of the marks that stand; they never overlap."""

    def step(self, e, state):
        hit = [m for m in state or () if m[1] <= e.hi and e.lo <= m[2]]
        left = [m for m in state or () if m not in hit]
        out = [(m[0], e.ts, "removed") for m in hit]
        if e.lo <= e.hi and all(m[3] != e.color for m in hit):
            left.append([e.mark, e.lo, e.hi, e.color])
            out.append((e.mark, e.ts, "added"))
        return out, left or None


def toggled(choices: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """(book, mark, ts, action) of highlights ``added`` and ``removed`` by a reader's choices in their order.

    choices: book, ts, seq, mark, lo, hi (a span of tokens, both ends in it),
    color. What a choice overlaps goes; the choice stands unless one of those
    had its colour: then it has switched the mark off. A span that ends before it begins adds nothing.
    """
    return folded(choices.select("book", "ts", "seq", "mark", "lo", "hi", "color"), ["book"], Toggles(), "book long, mark long, ts long, action string", delay)


# -- narration -------------------------------------------------------------------------------


class Grace(Fold):
    """State: [section, end of its grace or -1] of queued sections, by section."""

    def step(self, e, state):
        queued, out = {s: end for s, end in state or ()}, []
        if e.kind == "queued":
            queued.setdefault(e.section, -1)
        elif e.kind == "taken":
            queued.pop(e.section, None)
        else:
            for s, end in sorted(queued.items()):
                if e.lo <= s <= e.hi:
                    queued[s] = -1
                    if end >= 0:
                        out.append((s, e.ts, "warmed"))
                else:
                    queued[s] = e.ts + GRACE_MS
                    if end < 0:
                        out.append((s, e.ts, "cooled"))
        return out, sorted(queued.items()) or None

    def due(self, state):
        ends = [end for _, end in state if end >= 0]
        return min(ends) + 1 if ends else None

    def fire(self, state):
        at = self.due(state) - 1
        return [(s, at, "dropped") for s, end in state if end == at], [x for x in state if x[1] != at] or None


def graced(moves: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """(book, section, ts, action) of queued work that leaves the listener's window (``cooled``), comes back (``warmed``) or is ``dropped`` GRACE_MS after.

    moves: book, ts, seq, kind, section, lo, hi. ``queued`` and ``taken`` name a
    section; ``window`` says that sections lo to hi are wanted from now on. Each
    move that leaves a cold section outside begins its grace anew; one that
    takes it in ends it. What is taken or dropped is forgotten, and a book with
    nothing queued has no state.
    """
    return folded(moves.select("book", "ts", "seq", "kind", "section", "lo", "hi"), ["book"], Grace(), "book long, section long, ts long, action string", delay)


class Retries(Fold):
    """State: (time of the book's deletion or -1, [section, failures] of sections that have failed)."""

    def step(self, e, state):
        gone, failed = state or (-1, [])
        failed = {s: n for s, n in failed}
        out = []
        if e.kind == "deleted":
            gone, failed = e.ts, {}
        elif e.kind == "added":
            gone = -1
        elif gone < 0:
            n = failed.pop(e.section, 0) + 1
            if e.kind == "done":
                out.append((e.section, e.ts, "ready", n))
            elif n <= RETRIES:
                failed[e.section] = n
                out.append((e.section, e.ts, "retry", n))
            else:
                out.append((e.section, e.ts, "failed", n))
        return out, (gone, sorted(failed.items())) if gone >= 0 or failed else None

    def due(self, state):
        return state[0] + GONE_MS + 1 if state[0] >= 0 else None

    def fire(self, state):
        return [], None


class Breaker(Fold):
    """State: failures in a row; once there are ``most``, nothing is asked any more."""

    def __init__(self, most: int):
        self.most = max(1, most)

    def step(self, e, state):
        streak = state or 0
        if streak >= self.most:
            return [(e.section, e.ts, "breaker")], streak
        return [(e.section, e.ts, "model" if e.ok else "failed")], None if e.ok else streak + 1


def broken_off(attempts: DataFrame, most: int = MOST_FAILURES, delay: str = "10 seconds") -> DataFrame:
    """(job, section, ts, outcome) of a job's attempts in their order: ``model`` or ``failed``, and ``breaker`` for all after ``most`` failures in a row.

    attempts: job, ts, seq, section, ok (what asking the model would give). A job
    whose last attempt succeeded has no state.
    """
    return folded(attempts.select("job", "ts", "seq", "section", "ok"), ["job"], Breaker(most), "job long, section long, ts long, outcome string", delay)


def retried(results: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """(book, section, ts, action, tries) of results of work: ``retry`` for the first RETRIES failures, then ``failed``; ``ready`` when done, which forgives them.

    results: book, ts, seq, kind (``error``, ``done``, ``deleted``, ``added``),
    section. Results of a deleted book are dropped, until it is added again or
    GONE_MS have passed; then the deletion is forgotten.
    """
    return folded(results.select("book", "ts", "seq", "kind", "section"), ["book"], Retries(), "book long, section long, ts long, action string, tries int", delay)
