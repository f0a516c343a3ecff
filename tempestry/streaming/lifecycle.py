"""Incidents from a stream of readings: state per station, restart-safe, equal to the batch operator on the same input.

Readings may come late and in any order.  A station's clock is the newest reading it has sent; what is younger than
`delay_s` behind the clock waits in a buffer, and readings leave it in the order of their times.  A reading at or before
the last one that left comes too late: it changes nothing and comes out with status `late`, for a table of rejects.  One
that is in the buffer already is dropped, the first stays.  A row with `flush` set is no reading; it empties the buffer
(the end of a feed).  With `idle_s` a station that is silent for so long is flushed by a timer.

State: the clock, the number and time of the last reading handled; the buffer, no longer than the delay; a row per open key; and per number of a
reading the keys that it resolves unless they fire again.  So a reading touches the rows of its own keys and of those
that end with it, however many others are open.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tempestry.profile import Profile

OUTPUT = "station string, dedupe_key string, onset_t long, last_t long, peak_t long, peak_strength double, priority_score double, hits int, resolved_t long, status string"
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
TICK = "station string, t long, hits array<struct<key:string,strength:double,score:double,detector_order:int>>, flush boolean"
KEY_STATE = "active boolean, enter int, onset_t long, peak_t long, peak_strength double, score double, hits int, last_t long, last_seq long"
KEY_FIELDS = [c.split()[0] for c in KEY_STATE.split(", ")]


def ticks(readings: DataFrame, candidates: DataFrame) -> DataFrame:
    """(station, t, hits, flush): every reading with its candidates."""
    hits = candidates.groupBy("station", "t").agg(F.collect_list(F.struct(F.col("dedupe_key").alias("key"), "strength", "score", "detector_order")).alias("hits"))
    return readings.select("station", "t").join(hits.hint("merge"), ["station", "t"], "left").withColumn("flush", F.lit(False))


class Open:
    """The open and pending incidents of one station, over a store of rows by key and of keys by number of a reading.

    Both stores have get, put and remove; `seq` numbers the readings handled.
    """

    def __init__(self, keys, due, p: Profile):
        self.keys, self.due, self.p = keys, due, p

    def advance(self, seq: int, t: int, hits: Iterable[dict]) -> Iterator[dict]:
        """Handle reading `seq`; gives the incidents that it changes."""
        p, best = self.p, {}
        for h in hits:
            at = best.get(h["key"])
            if at is None or (h["score"], h["detector_order"]) > (at["score"], at["detector_order"]):
                best[h["key"]] = h
        for key in sorted(best):
            strength, score, s = best[key]["strength"], best[key]["score"], self.keys.get(key)
            if s is not None and not s["active"] and s["last_seq"] != seq - 1:
                s = None  # pending, and missed a reading
            if strength < (p.z_off if s is not None and s["active"] else p.z_on):
                if s is None or not s["active"]:
                    self.keys.remove(key)
                continue
            if s is None:
                s = {"active": False, "enter": 0, "onset_t": t, "peak_t": t, "peak_strength": 0.0, "score": 0.0, "hits": 0}
            updates = s["active"]
            if updates:
                s["score"] = max(s["score"], score)
                if strength > s["peak_strength"]:
                    s["peak_t"], s["peak_strength"] = t, strength
            else:
                s["enter"] += 1
                if strength >= s["peak_strength"]:  # while pending the later of equal peaks counts, with its score
                    s["peak_t"], s["peak_strength"], s["score"] = t, strength, score
                s["active"] = s["enter"] >= p.k_on
            s |= {"hits": s["hits"] + 1, "last_t": t, "last_seq": seq}
            self.keys.put(key, s)
            if s["active"]:
                self.due.put(seq + p.k_off, [*(self.due.get(seq + p.k_off) or []), key])
                yield self._row(key, s, "ongoing" if updates else "open", None)
        for key in self.due.get(seq) or []:
            s = self.keys.get(key)
            if s is not None and s["active"] and s["last_seq"] + p.k_off == seq:
                self.keys.remove(key)
                yield self._row(key, s, "resolved", t)
        self.due.remove(seq)

    @staticmethod
    def _row(key: str, s: dict, status: str, resolved: int | None) -> dict:
        return {"dedupe_key": key, "onset_t": s["onset_t"], "last_t": s["last_t"], "peak_t": s["peak_t"], "peak_strength": s["peak_strength"], "priority_score": s["score"], "hits": s["hits"], "resolved_t": resolved, "status": status}


class Held:
    """A map of the state store, read on demand and written back once per batch."""

    def __init__(self, store, load, save):
        self.store, self.load, self.save = store, load, save
        self.seen: dict = {}
        self.changed: set = set()

    def get(self, key):
        if key not in self.seen:
            self.seen[key] = self.load(self.store.getValue((key,))) if self.store.containsKey((key,)) else None
        return self.seen[key]

    def put(self, key, value) -> None:
        self.seen[key] = value
        self.changed.add(key)

    def remove(self, key) -> None:
        if self.get(key) is not None:
            self.put(key, None)

    def write(self) -> None:
        for key in self.changed:
            if self.seen[key] is not None:
                self.store.updateValue((key,), self.save(self.seen[key]))
            elif self.store.containsKey((key,)):
                self.store.removeKey((key,))


class Stations(StatefulProcessor):
    """The buffer and the incidents of every station."""

    def __init__(self, p: Profile, delay_s: int, idle_s: int | None):
        self.p, self.delay_s, self.idle_s = p, delay_s, idle_s

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "clock long, handled_t long, seq long")
        self.waiting = handle.getValueState("waiting", "body string")
        self.keys = handle.getMapState("keys", "dedupe_key string", KEY_STATE)
        self.due = handle.getMapState("due", "seq long", "keys string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock, handled, seq = self.head.get() if self.head.exists() else (None, None, 0)
        waiting = self._buffer()
        late, flush = [], False
        for frame in rows:
            for t, hits, end in zip(frame["t"], frame["hits"], frame["flush"]):
                if end:
                    flush = True
                    continue
                t = int(t)
                if handled is not None and t <= handled:
                    late.append({"onset_t": t, "last_t": t, "status": "late"})
                elif t not in waiting:
                    waiting[t] = [h if isinstance(h, dict) else h.asDict() for h in ([] if hits is None else hits)]
                    clock = t if clock is None else max(clock, t)
        out = late + self._release(clock, handled, seq, waiting, flush)
        if self.idle_s is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.idle_s)
        yield from _frames(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock, handled, seq = self.head.get() if self.head.exists() else (None, None, 0)
        yield from _frames(key[0], self._release(clock, handled, seq, self._buffer(), True))

    def _buffer(self) -> dict[int, list]:
        return {int(t): hits for t, hits in json.loads(self.waiting.get()[0])} if self.waiting.exists() else {}

    def _release(self, clock: int | None, handled: int | None, seq: int, waiting: dict[int, list], flush: bool) -> list[dict]:
        """Handle what may leave the buffer, in the order of time, and store the state."""
        if clock is None:
            return []
        ready = sorted(t for t in waiting if flush or t <= clock - self.delay_s)
        load_key = lambda row: dict(zip(KEY_FIELDS, row))
        keys = Held(self.keys, load_key, lambda s: tuple(s[f] for f in KEY_FIELDS))
        due = Held(self.due, lambda row: json.loads(row[0]), lambda v: (json.dumps(v),))
        state, out = Open(keys, due, self.p), []
        for t in ready:
            seq += 1
            out += state.advance(seq, t, waiting.pop(t))
            handled = t
        keys.write()
        due.write()
        if waiting or ready:
            self.waiting.update((json.dumps(sorted(waiting.items())),))
        self.head.update((clock, handled, seq))
        return out

    def close(self) -> None:
        pass


def _frames(station: str, rows: list[dict]) -> Iterator[pd.DataFrame]:
    if rows:
        df = pd.DataFrame(rows, columns=NAMES).assign(station=station)
        df = df.astype({c: "Int64" for c in ("onset_t", "last_t", "peak_t", "hits", "resolved_t")} | {c: "float64" for c in ("peak_strength", "priority_score")})
        yield df.astype(object).where(df.notna(), None)


def stream_incidents(ticks_stream: DataFrame, p: Profile = Profile(), delay_s: int = 0, idle_s: int | None = None) -> DataFrame:
    """Upserts of incidents, and late readings, from a stream of ticks.

    The session's state store has to be RocksDB's (`spark.sql.streaming.stateStore.providerClass`).  A stream with
    timers runs on without new files, so `idle_s` is for one that is not to end by itself.
    """
    mode = "None" if idle_s is None else "ProcessingTime"
    return ticks_stream.groupBy("station").transformWithStateInPandas(Stations(p, delay_s, idle_s), OUTPUT, "Update", mode)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
