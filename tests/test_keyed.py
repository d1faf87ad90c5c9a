from __future__ import annotations

import datetime
import random

import pytest

from bidloom.streaming import keyed

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "platform string, query string, ts timestamp, ord long, status string"


def events(n=400, seed=1, days=30):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = T0 + datetime.timedelta(seconds=rng.randrange(days * 86_400))
        rows.append((rng.choice(["jd", "yize"]), rng.choice(["Pipe", "pipe", "valve"]), at, i, rng.choice(["ok", "empty", "Captcha", "rate_limited", ""])))
    return sorted(rows, key=lambda r: r[2])


def pool_by_hand(rows, ttl):
    out, held = [], {}
    for p, q, ts, o, status in sorted(rows, key=lambda r: (r[2], r[3])):
        key = (p, q.lower())
        if key in held and ts - held[key][0] > ttl:
            out.append((*key, "entry", held[key][0], None, None, held.pop(key)[1]))
        if status == "ok":
            if key in held:
                out.append((*key, "entry", held[key][0], None, None, held[key][1]))
            held[key] = [ts, 0]
        elif key in held:
            held[key][1] += 1
            out.append((*key, "hit", ts, o, round((ts - held[key][0]).total_seconds() * 1e6), held[key][1]))
        else:
            out.append((*key, "miss", ts, o, None, None))
    return sorted(out + [(*k, "entry", v[0], None, None, v[1]) for k, v in held.items()], key=repr)


def breaker_by_hand(rows, gap):
    out, last, tripped = [], {}, set()
    for p, _, ts, o, status in sorted(rows, key=lambda r: (r[2], r[3])):
        if p in last and ts - last[p] > gap:
            tripped.discard(p)
        last[p] = ts
        if p not in tripped and any(t in status.lower() for t in ("captcha", "rate_limited")):
            tripped.add(p)
            out.append((p, ts, o, status.lower()))
    return sorted(out)


def write(spark, at, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")


def run(spark, at, make):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    with keyed.state_store(spark):
        out = make(stream)
        q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def shuffled_slices(rows, n, late, seed=3):
    """Slices by time; within ``late`` of a slice's end events may come a slice later."""
    rng = random.Random(seed)
    size, out, kept = len(rows) // n + 1, [], []
    for k in range(n):
        part = kept + rows[k * size : (k + 1) * size]
        end = max((r[2] for r in part), default=T0)
        kept = [r for r in part if end - r[2] < late and rng.random() < 0.5 and r[2] != end] if k + 1 < n else []
        out.append([r for r in part if r not in kept])
        rng.shuffle(out[-1])
    return out


CLOSING = [(None, None, T0 + datetime.timedelta(days=500), 0, "")]


def test_pool_does_not_depend_on_batches(spark, tmp_path):
    rows, ttl = events(), datetime.timedelta(days=2)
    want = pool_by_hand(rows, ttl)
    for name, slices in (("a", shuffled_slices(rows, 4, datetime.timedelta(hours=20))), ("b", [rows])):
        for part in slices:
            write(spark, tmp_path / name, part)
        write(spark, tmp_path / name, CLOSING)
        got = run(spark, tmp_path / name, lambda s: keyed.pool(s, ttl_days=2, late="1 day"))
        assert sorted((tuple(r) for r in got.where("platform is not null").collect()), key=repr) == want
    assert sorted((tuple(r) for r in keyed.pool_batch(spark.createDataFrame(rows, SCHEMA), 2).collect()), key=repr) == want
    assert {r[2] for r in want} == {"hit", "miss", "entry"}


def test_breaker_trips_by_event_time_and_goes_on_after_a_restart(spark, tmp_path):
    rows, gap = events(250, 5), datetime.timedelta(hours=5)
    want = breaker_by_hand(rows, gap)
    slices = shuffled_slices(rows, 3, datetime.timedelta(hours=10))
    for part in slices:  # a run for each slice: state and timers are taken up from the checkpoint
        write(spark, tmp_path, part)
        run(spark, tmp_path, lambda s: keyed.breaker(s, gap_hours=5, late="12 hours"))
    write(spark, tmp_path, CLOSING)
    got = run(spark, tmp_path, lambda s: keyed.breaker(s, gap_hours=5, late="12 hours"))
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, keyed.breaker_batch(spark.createDataFrame(rows, SCHEMA), 5).collect())) == want


def test_state_is_dropped_and_late_events_too(spark, tmp_path):
    hour = datetime.timedelta(hours=1)
    write(spark, tmp_path, [("jd", "q", T0, 1, "captcha"), ("jd", "q", T0 + hour, 2, "ok")])
    write(spark, tmp_path, [("yize", "q", T0 + 100 * hour, 3, "ok")])
    write(spark, tmp_path, [("jd", "q", T0 - hour, 0, "429"), ("yize", "q", T0 + 101 * hour, 4, "ok")])  # late by 100 hours: dropped
    make = lambda s: keyed.breaker(s, gap_hours=6, late="2 hours")
    assert [tuple(r) for r in run(spark, tmp_path, make).collect()] == [("jd", T0, 1, "captcha")]
    write(spark, tmp_path, CLOSING)
    assert run(spark, tmp_path, make).count() == 1
    held = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "state").load()
    assert held.count() == 0


@pytest.mark.parametrize("gap,want", [("3 hours", [(1, 3, "c"), (1, 1, "d"), (2, 1, "x")]), ("2 days", [(1, 4, "d"), (2, 1, "x")])])
def test_folds_by_sessions(spark, gap, want):
    hour = datetime.timedelta(hours=1)
    rows = [(1, T0, 1, "a"), (1, T0 + hour, 2, "b"), (1, T0 + hour, 3, "c"), (1, T0 + 10 * hour, 4, "d"), (2, T0, 5, "x")]
    df = spark.createDataFrame(rows, "item_id int, ts timestamp, ord int, status string")
    assert sorted((r.item_id, r.n_events, r.status) for r in keyed.folds(df, gap).collect()) == sorted(want)


def test_empty_events(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert keyed.pool_batch(none).count() == 0 and keyed.breaker_batch(none).count() == 0


@pytest.mark.parametrize("gap", [1, 40, 700])
def test_breaker_holds_few_events_and_trips_alike(gap):
    breaker, rng = keyed.Breaker(gap), random.Random(gap)
    rows = [(rng.randrange(20_000), k, rng.choice(["ok", "Captcha", "empty", None, "rate_limited"])) for k in range(3000)]
    rng.shuffle(rows)

    def trips(events, batches=1):
        held, state, emit = [x for k in range(batches) for x in breaker.thinned(events[k::batches])] if batches else events, None, []
        for ts, ord_, status in sorted(held, key=lambda x: x[:2]):
            state = None if state is not None and ts > breaker.ends(state) else state
            state = breaker.step(("p",), state, ts, ord_, status, emit)
        return emit, len(held)

    want, n = trips(rows, 0)
    assert trips(rows)[0] == trips(rows, 4)[0] == want and n == 3000 and trips(rows)[1] <= 3 * (20_000 // gap + 1)
