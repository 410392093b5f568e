"""Sessions and periods against plain Python, and their edge cases."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from trackloom import shared
from trackloom.functions.times import usable_trips
from trackloom.operators.intervals import dyadic_runs, periods_and_gaps
from trackloom.operators.sessions import SessionTable, sessionize

SCHEMA = "key string, start_s bigint, end_s bigint, id bigint"


def plain_sessions(events, gap):
    out, by = [], {}
    for k, s, e, *_ in events:
        by.setdefault(k, []).append((s, e))
    for k, spans in by.items():
        now = None
        for s, e in sorted(spans):
            if now and s - now[1] <= gap:
                now[1], now[2] = max(now[1], e), now[2] + 1
            else:
                now and out.append((k, *now))
                now = [s, e, 1]
        out.append((k, *now))
    return sorted(out)


def some_events(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = "pool" if r.random() < 0.4 else f"p{r.randrange(8)}"
        s = r.randrange(-50_000, 400_000)
        out.append((k, s, s + r.choice([0, 5, 300, 20_000]), i))
    return out


@pytest.mark.parametrize("gap", [0, 1, 3600])
def test_sessions_match_plain(spark, gap):
    events = some_events(400, gap)
    got = sessionize(spark.createDataFrame(events, SCHEMA), gap)
    assert rows(got.select("key", "session_start", "session_end", "n_events")) == sorted(plain_sessions(events, gap), key=repr)


def test_session_starts_only_beyond_the_gap(spark):
    e = [("a", 0, 10, 1), ("a", 110, 120, 2), ("a", 221, 230, 3)]
    assert rows(sessionize(spark.createDataFrame(e, SCHEMA), 100).select("session_start", "session_end")) == [(0, 120), (221, 230)]


def test_batches_in_any_order_give_the_same_table(spark):
    events = some_events(300, 5)
    random.Random(1).shuffle(events)
    t = SessionTable(spark, shared.scratch(spark, "t"), 3600, unit=50_000)
    for i in range(0, 300, 75):
        t.merge(spark.createDataFrame(events[i : i + 75], SCHEMA))
    assert rows(t.sessions()) == sorted(plain_sessions(events, 3600), key=repr)


def test_a_late_trip_bridges_two_stored_sessions_and_a_repeated_id_counts_once(spark):
    t = SessionTable(spark, shared.scratch(spark, "t"), 100, unit=1000, once_by_id=True)
    t.merge(spark.createDataFrame([("a", 0, 10, 1), ("a", 1500, 1510, 2)], SCHEMA))
    assert t.sessions().count() == 2
    t.merge(spark.createDataFrame([("a", 60, 1450, 3), ("a", 0, 10, 1)], SCHEMA))
    assert rows(t.sessions()) == [("a", 0, 1510, 3)]


def test_empty_batches_and_null_keys_leave_no_rows(spark):
    t = SessionTable(spark, shared.scratch(spark, "t"), 100)
    t.merge(spark.createDataFrame([], SCHEMA))
    t.merge(spark.createDataFrame([(None, 1, 2, 1), ("a", None, 2, 2), ("a", 1, None, 3)], SCHEMA))
    assert rows(t.sessions()) == []


def test_a_failed_batch_leaves_the_table_as_it_was(spark):
    t = SessionTable(spark, shared.scratch(spark, "t"), 100)
    t.merge(spark.createDataFrame([("a", 0, 10, 1)], SCHEMA))
    with pytest.raises(Exception):  # noqa: B017
        t.merge(spark.createDataFrame([("a", 20, 30, 1)], SCHEMA).selectExpr("key", "assert_true(start_s < 0) is null as x", "start_s", "if(raise_error('x') is null, end_s, 0) as end_s", "id"))
    assert rows(t.sessions()) == [("a", 0, 10, 1)]


def test_usable_trips(spark):
    good = "2001-02-28 23:59:59Z"
    dates = [
        (" a ", "2001-01-01 00:00:00+00:00", "2001-01-01T01:00:00.000-05:00"),
        ("b", "2001-02-29 00:00:00Z", good),
        ("b", "2001-01-01 24:00:00Z", good),
        ("b", "2001-01-01 00:60:00Z", good),
        ("b", "2001-01-01 00:00:00.5Z", good),
        ("b", "2001-01-01 00:00:00", good),
        ("b", " 2001-01-01 00:00:00Z", good),
        ("b", "2001-03-01 00:00:00Z", good),
        ("\t", good, good),
        (None, good, good),
        ("c", good, None),
        ("d", good, good),
    ]
    got = usable_trips(spark.createDataFrame(dates, "participantId string, tripStartDate string, tripEndDate string"))
    assert rows(got) == [("a", 978307200, 978307200 + 6 * 3600), ("d", 983404799, 983404799)]


def plain_periods(spans, max_gap):
    out, by = [], {}
    for k, s, e in spans:
        if k is not None and s is not None and e is not None and e >= s:
            by.setdefault(k, []).append((s, e))
    for k, v in by.items():
        v.sort()
        run = [list(v[0])]
        for s, e in v[1:]:
            if s <= run[-1][1]:
                run[-1][1] = max(run[-1][1], e)
            else:
                run.append([s, e])
        out += [(k, "period", a, b) for a, b in run]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(run, run[1:], strict=False) if b[0] - a[1] <= max_gap]
    return sorted(out, key=repr)


INTERVALS = "entity string, start_s bigint, end_s bigint"


def test_periods_match_plain(spark):
    r = random.Random(2)
    spans = []
    for _ in range(1500):
        s = r.randrange(-3_000_000, 3_000_000)
        spans.append((r.choice("abc"), s, s + r.choice([0, 1, 2, 60, 4000, 500_000])))
    spans += spans[:50] + [(None, 1, 2), ("a", 5, 4), ("a", None, 4)]
    edge = 1 << 18  # chunks part at multiples of 2^18 seconds
    spans += [("z", edge - 5, edge), ("z", edge, edge + 5), ("y", edge - 5, edge - 1), ("y", edge, edge + 1), ("x", edge, edge), ("w", -3 * edge, 5 * edge)]
    assert rows(periods_and_gaps(spark.createDataFrame(spans, INTERVALS), 7200)) == plain_periods(spans, 7200)


def test_periods_of_nothing(spark):
    assert rows(periods_and_gaps(spark.createDataFrame([], INTERVALS), 10)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 63), st.integers(1, 64)), max_size=20))
def test_dyadic_runs_cover_the_same_cells(spans):
    spans = [(g, a, min(64, a + n)) for g, a, n in spans]
    g, lo, hi = (np.array([x[i] for x in spans], np.int64) for i in range(3))
    got = [tuple(map(int, x)) for x in zip(*dyadic_runs(g, lo, hi, 6), strict=True)]
    cells = {(x, c) for x, a, b in spans for c in range(a, b)}
    assert {(x, c) for x, a, b in got for c in range(a, b)} == cells
    assert got == sorted(got)
    assert all(p[0] != q[0] or p[2] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_a_task_of_periods_holds_bounded_rows(spark, monkeypatch):
    from trackloom.operators import intervals

    monkeypatch.setattr(intervals, "COMBINE_ROWS", 64)
    sizes, real = [], intervals.dyadic_runs

    def runs(group, lo, hi, levels=intervals.LEVELS):
        sizes.append(len(lo))
        return real(group, lo, hi, levels)

    monkeypatch.setattr(intervals, "dyadic_runs", runs)
    rng = np.random.default_rng(3)
    n = 3_000
    entity = np.where(rng.random(n) < 0.5, "hot", np.char.add("p", rng.integers(0, 40, n).astype(str)))
    lo = rng.integers(0, 1 << 10, n) * 2
    hi = lo + 1 + 2 * rng.integers(0, 5, n)
    rows = pa.table({"entity": pa.array(entity), "chunk": np.zeros(n, np.int64), "lo": lo, "hi": hi})
    group = np.unique(entity, return_inverse=True)[1].astype(np.int64)
    rows = rows.append_column("_group", pa.array(group)).take(pa.array(np.argsort(group, kind="stable")))
    out = pa.Table.from_batches(intervals._finish(10**9)(iter(rows.to_batches(max_chunksize=16))))
    assert max(sizes) <= 800, max(sizes)  # at most the runs of the hot chunk and 64 rows; all 3 000 before
    whole = pa.table({"entity": ["long"], "start_s": [0], "end_s": [10_000_000_000]})
    cut = pa.Table.from_batches(intervals._combine(iter(whole.to_batches())))
    assert len(cut) == (2 * 10_000_000_000 >> intervals.LEVELS) + 1
    got = {(e, k): set() for e in set(entity) for k in ("period", "edge")}
    for e, k, x, y in zip(*(out[c].to_pylist() for c in ("entity", "kind", "from_s", "to_s")), strict=True):
        if k != "gap":
            got[e, k].add((x, y) if k == "period" else (x // 2, (y - 1) // 2))
    for e in set(entity):
        spans, want = sorted(zip(lo[entity == e] // 2, (hi[entity == e] - 1) // 2, strict=True)), []
        for a, b in spans:
            if want and a <= want[-1][1]:
                want[-1][1] = max(want[-1][1], b)
            else:
                want.append([a, b])
        assert got[e, "period"] | got[e, "edge"] == {tuple(map(int, w)) for w in want}
