"""Quota and breaker gates over several micro-batches, with state kept between them."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quern.streaming import gates

START = datetime(2026, 9, 3, tzinfo=timezone.utc)
EVENT = "gate string, id long, ts timestamp, kind string, permit long"
CALL = "gate string, id long, ts timestamp, kind string, operation string, model string, tenant string, user string, tokens long, reservation long"


@pytest.fixture
def run(spark, tmp_path):
    """Runs a stream over batches, each a file of its own, and gives all rows by id."""

    def go(gate, schema, batches):
        own = gates.session(spark)
        own.conf.set("spark.sql.shuffle.partitions", "2")
        out, source = str(tmp_path / "out"), tmp_path / "in"
        for i, rows in enumerate(batches):
            own.createDataFrame([(r[0], r[1], START + timedelta(milliseconds=r[2]), *r[3:]) for r in rows], schema).coalesce(1).write.parquet(str(source / str(i)))
            stream = gate(own.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source)))
            stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", out).start().awaitTermination()
        return {r.id: r for r in own.read.parquet(out).collect()}

    return go


def circuit(**options):
    return lambda e: gates.breakers(e, **{"failures": 1, "reset_seconds": 1, "probes": 1, "successes": 2, "lease_seconds": 90} | options)


def test_one_probe_at_a_time_and_enough_successes_close(run):
    got = run(circuit(), EVENT, [
        [("m", 1, 0, "acquire", None), ("m", 2, 1, "fail", 1), ("m", 3, 2, "acquire", None)],
        [("m", 4, 1001, "acquire", None), ("m", 5, 1002, "acquire", None), ("m", 6, 1003, "succeed", 4), ("m", 7, 1004, "acquire", None)],
        [("m", 8, 1005, "succeed", 7), ("m", 9, 1006, "acquire", None), ("n", 10, 0, "acquire", None)],
    ])
    assert [(got[i].allowed, got[i].state, got[i].retry_ms) for i in (1, 3, 4, 5, 7, 9, 10)] == [
        (True, "closed", 0), (False, "open", 999), (True, "half-open", 0), (False, "half-open", 0), (True, "half-open", 0), (True, "closed", 0), (True, "closed", 0),
    ]


def test_a_failed_probe_opens_at_once_and_leases_run_out(run):
    got = run(circuit(), EVENT, [
        [("m", 1, 0, "acquire", None), ("m", 2, 0, "fail", 1), ("m", 3, 1000, "acquire", None), ("m", 4, 1000, "fail", 3), ("m", 5, 1000, "acquire", None)],
        [("m", 6, 2000, "acquire", None), ("m", 7, 92_000, "acquire", None), ("m", 8, 92_000, "succeed", 6), ("m", 9, 92_001, "acquire", None)],
        [("m", 10, 92_002, "succeed", 7), ("m", 11, 92_003, "release", 7), ("m", 12, 92_004, "acquire", None)],
    ])
    assert (got[5].allowed, got[5].state, got[5].retry_ms) == (False, "open", 1000)
    assert got[7].allowed and got[7].generation != got[6].generation
    assert (got[9].allowed, got[9].state) == (False, "half-open")  # the stale probe's success counts for nothing
    assert (got[12].allowed, got[12].state) == (True, "half-open")


def test_failures_in_a_row_count_and_successes_reset_them(run):
    rows = [x for i, kind in enumerate(["fail", "fail", "succeed", "fail", "fail", "fail"]) for x in (("m", 10 * i, i * 10, "acquire", None), ("m", 10 * i + 1, i * 10 + 1, kind, 10 * i))]
    got = run(circuit(failures=3), EVENT, [rows[:5], rows[5:], [("m", 99, 60, "acquire", None)]])
    assert [got[i].allowed for i in (0, 10, 20, 30, 40, 50, 99)] == [True] * 6 + [False]


LIMITS = {"requests": 3, "all": 100, "tenant": 60, "user": 50, "model": 0}


def quota(events):
    entries = gates.quota_entries(*map(F.col, ("operation", "model", "tenant", "user", "tokens")), LIMITS)
    return gates.quotas(events.withColumn("entries", entries), 60)


def call(id_, at, tokens, tenant="t", user="u", model="m"):
    return ("g", id_, at, "reserve", "chat", model, tenant, user, tokens, None)


def settle(id_, at, reservation, tokens):
    return ("g", id_, at, "settle", None, None, None, None, tokens, reservation)


def test_all_counters_or_none_and_windows_begin_with_their_first_call(run):
    got = run(quota, CALL, [
        [call(1, 0, 40), call(2, 1000, 20), call(3, 2000, 10, user="v"), call(4, 3000, 10, user="w")],
        [call(5, 4000, 10, tenant="s"), call(6, 4000, 1, tenant="s"), call(7, 59_999, 1, tenant="r", model="n")],
        [call(8, 60_000, 1, tenant="r", model="n"), call(9, 60_000, 1), ("h", 10, 0, "reserve", "chat", "m", None, None, 100, None), ("h", 11, 1, "reserve", "chat", "x", None, None, 0, None)],
    ])
    assert [(i, got[i].admitted) for i in sorted(got)] == [(1, True), (2, False), (3, True), (4, True), (5, False), (6, False), (7, True), (8, True), (9, True), (10, True), (11, True)]
    # the user's tokens stop 2; the requests of chat:m stop 5 and 6; a refused call raises nothing
    assert got[2].retry_ms == 59_000 and got[2].used["tokens:user:t:u"] == 40 and got[3].used["tokens"] == 50
    assert got[5].retry_ms == 56_000
    # at 60,000 the first windows are over, and those that began later still run
    assert got[9].used["request:chat:m"] == 1 and got[9].used["tokens:tenant:t"] == 1 and got[8].used["tokens:user:r:u"] == 2
    assert got[10].used == {"request:chat:m": 1, "tokens": 100} and got[11].used == {"request:chat:x": 1}


def test_settlement_moves_counters_that_still_run(run):
    got = run(quota, CALL, [
        [call(1, 0, 50), settle(2, 10, 1, 20), settle(3, 11, 1, 0), settle(4, 12, 77, 5)],
        [call(5, 20, 30), settle(6, 30, 5, 0), call(7, 40, 5), settle(8, 50, 7, 500)],
        [call(9, 60, 1), call(10, 61_000, 1), settle(11, 61_001, 7, 9), call(12, 61_002, 1)],
    ])
    assert (got[5].admitted, got[5].used["tokens"]) == (True, 50) and got[7].used["tokens"] == 25
    assert not got[9].admitted and got[9].used["tokens"] == 520
    assert got[10].admitted and got[12].used["tokens"] == 2
