"""Gates before model calls, as keyed state with timers: quotas of several counters with settlement, circuit breakers.

Both take a stream of events of a gate, key by key; what a gate admits depends on the order of its events, so a gate is one
key: choose gates as fine as limits allow (a tenant, a model). Events of a micro-batch are taken in order of (ts, id);
one that arrives in a later batch is taken then. State is bounded by a timer on the watermark: counters go when their
window is over, reservations and permits when they can no longer be settled. A gate has one timer, for what ends first;
within a batch its state is in memory, read once a key and written at the end. Needs the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
QUOTA_OUT = "gate string, id long, admitted boolean, retry_ms long, used map<string,long>"
BREAKER_OUT = "gate string, id long, allowed boolean, state string, generation int, retry_ms long"


def session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    return own


def quota_entries(operation: Column, model: Column, tenant: Column, user: Column, tokens: Column, limits: dict[str, int]) -> Column:
    """The counters of a call: requests of (operation, model), tokens of all, of a tenant, of a user and of a model. A limit
    of 0, an amount of 0, and a missing tenant or user leave a counter out."""
    amount = F.greatest(F.lit(0), F.floor(F.coalesce(tokens, F.lit(0)))).cast("long")
    rows = [
        ("request", F.concat(F.lit("request:"), operation, F.lit(":"), model), F.lit(1).cast("long"), "requests"), ("token", F.lit("tokens"), amount, "all"), ("token", F.concat(F.lit("tokens:tenant:"), tenant), amount, "tenant"),
        ("token", F.concat(F.lit("tokens:user:"), tenant, F.lit(":"), user), amount, "user"), ("token", F.concat(F.lit("tokens:model:"), model), amount, "model"),
    ]
    each = [F.struct(F.lit(kind).alias("kind"), key.alias("key"), n.alias("amount"), F.lit(max(0, int(limits.get(limit, 0)))).cast("long").alias("limit")) for kind, key, n, limit in rows]
    return F.filter(F.array(*each), lambda e: e["key"].isNotNull() & (e["limit"] > 0) & (e["amount"] > 0))


#: Ids of a row of state of reservations or permits, and rows of a frame of results.
BLOCK, FRAME = 1024, 10_000


def _ordered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """The rows (without the gate) by (at, id); equal texts are one object, so that a gate's rows of a batch are narrow."""
    parts: list[dict[str, np.ndarray]] = []
    texts: dict[str, str] = {}
    for pdf in batches:
        one = lambda t: texts.setdefault(t, t) if isinstance(t, str) else None
        parts.append({c: np.array([one(t) for t in pdf[c]], object) if pdf[c].dtype.kind not in "iuf" else pdf[c].to_numpy() for c in pdf.columns if c not in ("gate", "ts")})
    columns = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    parts.clear()
    order = np.lexsort((columns["id"], columns["at"]))
    for i in range(0, len(order), FRAME):
        some = order[i : i + FRAME]
        yield from pd.DataFrame({c: v[some] for c, v in columns.items()}).itertuples(index=False)


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) == FRAME:
            yield pd.DataFrame(out, columns=columns)
            out = []
    yield pd.DataFrame(out, columns=columns)


class _Counters:
    """A map state of key to (used, until): a key is read once a batch, what changed is written at its end."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.state = handle.getMapState("counters", "key string", "used long, until long")
        self.rows: dict[str, tuple[int, int]] = {}
        self.changed: set[str] = set()

    def live(self, k: str, now: int) -> tuple[int, int]:
        """What a counter holds, and until when; nothing once its window is over."""
        row = self.rows.get(k)
        if row is None:
            row = self.rows[k] = tuple(self.state.getValue((k,))) if self.state.containsKey((k,)) else (0, 0)
        return row if now < row[1] else (0, 0)

    def put(self, k: str, used: int, until: int) -> None:
        self.rows[k] = (used, until)
        self.changed.add(k)

    def flush(self) -> int | None:
        """Writes, and gives the first end of what was written."""
        for k in self.changed:
            self.state.updateValue((k,), self.rows[k])
        first = min((self.rows[k][1] for k in self.changed), default=None)
        self.rows, self.changed = {}, set()
        return first

    def expire(self, now: int) -> int | None:
        """Drops what is over by now, and gives the first end of the rest."""
        first, over = None, []
        for k, (_, until) in self.state.iterator():
            if until <= now:
                over.append(k)
            else:
                first = until if first is None else min(first, until)
        for k in over:
            self.state.removeKey(k)
        return first


class _Held:
    """A map state of ids to (text, number, until), BLOCK ids a row; read and written as counters are."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.state = handle.getMapState(name, "block long", "rows string")
        self.blocks: dict[int, dict[int, tuple]] = {}
        self.changed: set[int] = set()
        self.first: int | None = None

    def _block(self, id_: int) -> dict[int, tuple]:
        b = id_ // BLOCK
        if b not in self.blocks:
            self.blocks[b] = self._rows(self.state.getValue((b,))[0]) if self.state.containsKey((b,)) else {}
        return self.blocks[b]

    @staticmethod
    def _rows(text: str) -> dict[int, tuple]:
        return {r[0]: tuple(r[1:]) for r in json.loads(text)}

    def _write(self, b: int, rows: dict[int, tuple]) -> None:
        if rows:
            self.state.updateValue((b,), (json.dumps([(k, *v) for k, v in rows.items()]),))
        elif self.state.containsKey((b,)):
            self.state.removeKey((b,))

    def put(self, id_: int, text: str, number: int, until: int) -> None:
        self._block(id_)[id_] = (text, number, until)
        self.changed.add(id_ // BLOCK)
        self.first = until if self.first is None else min(self.first, until)

    def pop(self, id_: int) -> tuple | None:
        row = self._block(id_).pop(id_, None)
        if row is not None:
            self.changed.add(id_ // BLOCK)
        return row

    def flush(self) -> int | None:
        for b in self.changed:
            self._write(b, self.blocks[b])
        first, self.first = self.first, None
        self.blocks, self.changed = {}, set()
        return first

    def expire(self, now: int) -> int | None:
        first, less = None, {}
        for (b,), (text,) in self.state.iterator():
            rows = self._rows(text)
            rest = {k: v for k, v in rows.items() if v[-1] > now}
            if len(rest) < len(rows):
                less[b] = rest
            ends = [v[-1] for v in rest.values()]
            first = min(ends if first is None else [first, *ends], default=None)
        for b, rest in less.items():
            self._write(b, rest)
        return first


class _Gate(StatefulProcessor):
    """State that ends at known times, with one timer a gate: for what ends first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")

    def _flush(self) -> None:
        self._wake([t.flush() for t in self.tables], self.timer.get()[0] if self.timer.exists() else None)

    def _wake(self, ends: list[int | None], known: int | None) -> None:
        first = min((e for e in ends if e is not None), default=None)
        if first is not None and (known is None or first < known):
            self.handle.registerTimer(first)
            self.timer.update((first,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # of several timers, the first drops all that is over
        if self.timer.exists() and self.timer.get()[0] <= (now := timerValues.getCurrentWatermarkInMs()):
            self.timer.clear()
            self._wake([t.expire(now) for t in self.tables], None)
        yield pd.DataFrame([], columns=self.columns)

    def close(self) -> None:
        pass


class _Quota(_Gate):
    columns = ["gate", "id", "admitted", "retry_ms", "used"]

    def __init__(self, window_ms: int):
        self.window = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counters, self.held = _Counters(handle), _Held(handle, "held")
        self.tables = [self.counters, self.held]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from _frames(self._decided(key[0], rows), self.columns)
        self._flush()

    def _decided(self, gate: str, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        shapes: dict[str, list] = {}
        for r in _ordered(rows):
            now = int(r.at)
            if r.kind == "settle":
                self._settle(r, now)
                continue
            if r.shape not in shapes:
                shapes[r.shape] = [(e["kind"], e["key"], e["limit"]) for e in json.loads(r.shape)]
            entries = [(kind, k, int(n), limit) for (kind, k, limit), n in zip(shapes[r.shape], r.amounts.split(",") if r.amounts else (), strict=True)]
            live = {k: self.counters.live(k, now) for _, k, _, _ in entries}
            full = next(((k, until) for _, k, n, limit in entries for used, until in [live[k]] if used + n > limit), None)
            if full is not None:
                yield gate, r.id, False, max(1, full[1] - now) if full[1] else self.window, {k: u for k, (u, _) in live.items()}
                continue
            used = {}
            for _, k, n, _ in entries:
                u, until = self.counters.live(k, now)
                self.counters.put(k, u + n, until or now + self.window)
                used[k] = u + n
            tokens = [k for kind, k, _, _ in entries if kind == "token"]
            if tokens:
                self.held.put(int(r.id), "\n".join(tokens), next(n for kind, _, n, _ in entries if kind == "token"), now + self.window)
            yield gate, r.id, True, 0, used

    def _settle(self, r, now: int) -> None:
        """Adds what was used beyond the reservation, or less, to the counters that there still are; once."""
        held = self.held.pop(int(r.reservation)) if pd.notna(r.reservation) else None
        if held is None:
            return
        keys, tokens, _ = held
        delta = max(0, int(r.tokens)) - tokens
        for k in keys.split("\n") if delta else ():
            used, until = self.counters.live(k, now)
            if until:
                self.counters.put(k, max(0, used + delta), until)


def quotas(events: DataFrame, window_seconds: int = 60, delay: str = "1 minute") -> DataFrame:
    """QUOTA_OUT for each 'reserve' event of (gate, id, ts, kind, entries, reservation, tokens).

    A call is admitted if none of its entries (quota_entries()) would exceed its limit; then all of its counters rise, and
    otherwise none. A counter's window begins with its first call. A 'settle' event names the reservation, the id of the
    call, and the tokens really used: the difference is added to the call's token counters whose window still runs, not
    below 0; a second one, or one for an unknown call, does nothing.
    """
    # of the entries, what is alike in many calls is one text, and the amounts another
    shape = F.to_json(F.transform("entries", lambda e: F.struct(e["kind"].alias("kind"), e["key"].alias("key"), e["limit"].alias("limit"))))
    amounts = F.array_join(F.transform("entries", lambda e: e["amount"].cast("string")), ",")
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select("gate", "id", "ts", F.unix_millis("ts").alias("at"), "kind", shape.alias("shape"), amounts.alias("amounts"), "reservation", "tokens")
    return rows.groupBy("gate").transformWithStateInPandas(_Quota(window_seconds * 1000), QUOTA_OUT, "Append", "EventTime")


@dataclass
class Circuit:
    """What a breaker knows; the rules are those of acquire() and report()."""

    state: str = "closed"
    failures: int = 0
    open_until: int = 0
    generation: int = 0
    in_flight: int = 0
    successes: int = 0
    lease_until: int = 0

    def _probing(self) -> None:
        self.in_flight = self.successes = self.lease_until = 0

    def _open(self, now: int, reset_ms: int) -> None:
        self.state, self.failures, self.open_until = "open", 0, now + reset_ms
        self._probing()
        self.generation += 1

    def acquire(self, now: int, probes: int, lease_ms: int) -> tuple[bool, int]:
        """Whether a call may go, and how long to wait. After its time an open breaker lets so many probes through; they hold
        a lease, and when it runs out others may go, under a new generation."""
        if self.state == "open":
            if now < self.open_until:
                return False, self.open_until - now
            self.state = "half-open"
            self._probing()
        if self.state == "half-open":
            if self.in_flight >= probes:
                if now < self.lease_until:
                    return False, 0
                self._probing()
                self.generation += 1
            self.in_flight += 1
            self.lease_until = now + lease_ms
        return True, 0

    def report(self, kind: str, state: str, generation: int, now: int, failures: int, successes: int, reset_ms: int) -> None:
        """A call's outcome counts if its permit is of the present generation and state."""
        if generation != self.generation or state != self.state:
            return
        if kind == "fail":
            self.failures += 1
            if state == "half-open" or self.failures >= failures:
                self._open(now, reset_ms)
        elif state == "closed":
            self.failures = 0 if kind == "succeed" else self.failures
        else:
            self.in_flight = max(0, self.in_flight - 1)
            self.successes += kind == "succeed"
            if self.successes >= successes:
                self.state, self.failures, self.open_until = "closed", 0, 0
                self._probing()
                self.generation += 1
            elif not self.in_flight:
                self.lease_until = 0


class _Breaker(_Gate):
    columns = ["gate", "id", "allowed", "state", "generation", "retry_ms"]

    def __init__(self, failures: int, reset_ms: int, probes: int, successes: int, lease_ms: int):
        self.failures, self.reset, self.probes, self.successes, self.lease = failures, reset_ms, probes, successes, lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.circuit = handle.getValueState("circuit", ", ".join(f"{k} {'string' if k == 'state' else 'long'}" for k in asdict(Circuit())))
        self.permits = _Held(handle, "permits")
        self.tables = [self.permits]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        c = Circuit(*self.circuit.get()) if self.circuit.exists() else Circuit()
        yield from _frames(self._decided(key[0], c, rows), self.columns)
        self.circuit.update(astuple(c))
        self._flush()

    def _decided(self, gate: str, c: Circuit, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for r in _ordered(rows):
            now = int(r.at)
            if r.kind == "acquire":
                ok, wait = c.acquire(now, self.probes, self.lease)
                if ok:
                    self.permits.put(int(r.id), c.state, c.generation, now + 2 * self.lease)
                yield gate, r.id, ok, c.state, c.generation, wait
            elif pd.notna(r.permit) and (permit := self.permits.pop(int(r.permit))) is not None:
                c.report(r.kind, permit[0], permit[1], now, self.failures, self.successes, self.reset)


def breakers(events: DataFrame, failures: int = 3, reset_seconds: int = 300, probes: int = 1, successes: int = 2, lease_seconds: int = 90, delay: str = "1 minute") -> DataFrame:
    """BREAKER_OUT for each 'acquire' event of (gate, id, ts, kind, permit). 'succeed', 'fail' and 'release' events name
    the permit, the id of the call that was let through; a second report, one without a permit, and one after twice the
    lease do nothing."""
    positive = [max(1, int(x)) for x in (failures, probes, successes, lease_seconds)]
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select("gate", "id", "ts", F.unix_millis("ts").alias("at"), "kind", "permit")
    processor = _Breaker(positive[0], max(0, reset_seconds) * 1000, positive[1], positive[2], positive[3] * 1000)
    return rows.groupBy("gate").transformWithStateInPandas(processor, BREAKER_OUT, "Append", "EventTime")
