"""The data-preparation operators against brute force, on small and awkward inputs."""

from __future__ import annotations

import csv
import random
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftloom.operators.grid import GridSpec, Levels, _iterate, impute_marked, regular_grid
from driftloom.operators.sessions import SessionSpec, sessionize
from driftloom.operators.skew import fragment_replicate_join, per_key_results, plan_shards
from driftloom.sources.dsv import PROXIMITY_FIELDS, QUOTED, Field, parse_lines, slices, split_lines, states_before, tokenize
from driftloom.sources.records import ACROSS, CLASSES, read_records

LOG = "reading_id bigint, `user.id` int, `remote.user.id.if.known` int, time timestamp_ntz, prob2 float, wave int, entity string, at string, n int, day int, period int, task_id int"
USER, PEER = "`user.id`", "`remote.user.id.if.known`"
START = datetime(2008, 9, 19)


def log_rows(n: int, seed: int = 1) -> list[tuple]:
    """Readings with nulls, ties, repeats and one user with a third of the rows; extra columns have clashing names."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = 7 if rng.random() < 0.35 else rng.choice([1, 2, 3, None])
        time = None if rng.random() < 0.05 else START + timedelta(seconds=rng.choice([0, 60, 900, 1800, 1801]) * rng.randrange(60))
        prob = None if rng.random() < 0.2 else (float("nan") if rng.random() < 0.05 else round(rng.random(), 3))
        rows.append((i, user, rng.choice([None, 4, 5, user]), time, prob, rng.choice([1, 2, None]), "x", "y", 1, 2, 3, 4))
    return rows + rows[: n // 10]


def session_reference(rows: list[tuple], gap: int) -> set:
    out = set()
    for user in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == user and r[3] is not None), key=lambda r: (r[3], r[0]))
        groups: list[list] = []
        for r in mine:
            if groups and (r[3] - groups[-1][-1][3]).total_seconds() <= gap:
                groups[-1].append(r)
            else:
                groups.append([r])
        for k, g in enumerate(groups):
            peers = {r[2] for r in g} - {None}
            out.add((user, k + 1, g[0][3], g[-1][3], (g[-1][3] - g[0][3]).total_seconds(), len(g), len(peers), g[0][0], g[-1][0]))
    return out


@pytest.mark.parametrize(("partitions", "batch"), [(1, 10_000), (4, 50), (16, 7), (32, 1)])
def test_sessions(spark, partitions, batch):
    rows = log_rows(300)
    df = spark.createDataFrame(rows, LOG).repartition(5)
    how = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.enabled": False, "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    before = {k: spark.conf.get(k) for k in how}
    for k, v in how.items():
        spark.conf.set(k, v)
    try:
        got = {tuple(r) for r in sessionize(df, SessionSpec(USER, "time", "reading_id", PEER, 1800)).collect()}
        without = {r.n_peers for r in sessionize(df, SessionSpec(USER, "time", "reading_id")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == session_reference(rows, 1800)
    assert without == {0}


def test_session_across_midnight_and_empty(spark):
    rows = [(i, 1, i % 3, datetime(2009, 1, 1, 22) + timedelta(minutes=29 * i), None, 1, "", "", 0, 0, 0, 0) for i in range(120)]
    df = spark.createDataFrame(rows, LOG)
    spec = SessionSpec(USER, "time", "reading_id", PEER)
    (one,) = sessionize(df, spec).collect()
    assert (one.n_events, one.n_peers, one.first_id, one.last_id) == (120, 3, 0, 119)
    assert sessionize(df.limit(0), spec).count() == 0
    with pytest.raises(ValueError):
        SessionSpec(USER, "time", "reading_id", gap_seconds=-1)


def test_grid_days(spark):
    rows = log_rows(200, seed=3)
    rows = [(*r[:3], None if r[3] is None else r[3] + timedelta(days=(r[0] * 7) % 40 - 2), *r[4:]) for r in rows]
    df = spark.createDataFrame(rows, LOG)
    spec = GridSpec((USER, "wave"), "time", "prob2", "2008-09-19")
    got = regular_grid(df, spec).collect()
    seen: dict = {}
    for r in rows:
        if r[3] is not None and r[3] >= START:
            seen.setdefault((r[1], r[5]), {}).setdefault((r[3] - START).days, []).append(r[4])
    assert len(got) == sum(max(d) - min(d) + 1 for d in seen.values())
    for r in got:
        day = seen[(r.key_0, r.key_1)].get(r.period)
        assert r.filled == (day is None) and r.n_readings == len(day or [])
        known = [v for v in day or [] if v is not None and v == v]
        assert r.value_filled == (not known)
        if known:
            assert r.value == pytest.approx(np.mean(known), abs=1e-6)
        assert r.readings_est is not None and r.readings_est >= 0
    assert regular_grid(df.limit(0), spec).count() == 0


NEUTRAL = Levels(0.0, 0.0, 1.0)
HOW = (14, (0.02, 0.1, 0.35), 0.004, 1e-4, 12)


def impute(flat, spans, levels=NEUTRAL, how=HOW):
    return impute_marked(flat, np.array(spans), levels, *how)[0]


def test_imputation_restores_a_rhythm():
    t = np.arange(120)
    truth = 3 + np.sin(2 * np.pi * t / 7) + 0.01 * t
    x = truth.copy()
    x[40:47] = x[80] = x[90:95] = np.nan
    gap = np.isnan(x)
    filled = impute(x, [120])
    assert (filled[~gap] == truth[~gap]).all()
    assert np.abs(filled[gap] - truth[gap]).max() < 0.15 < np.abs(truth[gap] - np.nanmean(x)).max()


def test_imputation_of_short_and_constant_series():
    flat = np.array([1.0, np.nan, 1.0, np.nan, np.nan, 2.0, np.nan, 4.0, 5.0, 5.0, np.nan, 5.0, 5.0, 5.0])
    out = impute(flat, [3, 1, 1, 3, 6])
    assert out[1] == 1.0 and np.isnan(out[3]) and np.isnan(out[4]) and out[6] == 3.0 and out[10] == pytest.approx(5.0)
    # Batches don't change a series' result.
    long = np.concatenate([np.sin(np.arange(50)), np.cos(np.arange(31))])
    long[[10, 11, 60]] = np.nan
    both = impute(long, [50, 31])
    assert both[:50] == pytest.approx(impute(long[:50], [50]), abs=1e-3)
    assert both[50:] == pytest.approx(impute(long[50:], [31]), abs=1e-3)


def test_null_keys_of_a_left_join_are_spread(spark):
    left = spark.createDataFrame([(i, None if i % 3 else 1) for i in range(3000)], "id int, k int")
    right = spark.createDataFrame([(1, "one"), (None, "none")], "k int, name string")
    for loads in ([(1, 1000)], [(1, 1000), (2, 900)], []):
        plan = plan_shards(spark.createDataFrame(loads, "k int, load bigint"), "k", "load", 8)
        joined = fragment_replicate_join(left, right, "k", ["id"], plan, "left")
        assert {(r.id, r.name) for r in joined.collect()} == {(i, None if i % 3 else "one") for i in range(3000)}
        tasks = plan.fragment(left.filter("k is null"), "k", ["id"]).groupBy("task_id").count().collect()
        assert len(tasks) == 8 and max(r["count"] for r in tasks) < 2 * min(r["count"] for r in tasks)


def test_imputation_settles_from_anywhere():
    rng = np.random.default_rng(0)
    b, span, lag = 30, 60, 14
    z = rng.normal(size=(b, span))
    missing = rng.random((b, span)) < 0.5
    spans, cuts = np.full(b, span), np.full(b, 3.0)
    near, used, settled = _iterate(np.where(missing, 0.0, z), missing, spans, lag, cuts, 0.02, 1e-6)
    far, _, also = _iterate(np.where(missing, 50.0, z), missing, spans, lag, cuts, 0.02, 1e-6)
    assert settled.all() and also.all() and used.max() < 1000
    assert near == pytest.approx(far, abs=1e-3)


def _daily(folder):
    con = duckdb.connect()
    rows = con.sql(f"""SELECT "user.id" AS u, wave, date_diff('day', DATE '2008-09-19', CAST("time" AS DATE)) AS d, ln(1 + count(*)) AS n, avg(prob2) AS v
        FROM '{folder}/proximity.parquet' WHERE "time" >= TIMESTAMP '2008-09-19' GROUP BY 1, 2, 3 ORDER BY 1, 2, 3""").df()
    out = []
    for _, g in rows.groupby(["u", "wave"], dropna=False):
        at = (g.d - g.d.min()).to_numpy()
        x = np.full((2, at.max() + 1), np.nan)
        x[0, at], x[1, at] = g.n, g.v
        out.append(x)
    return out


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="needs the generated tables")
@pytest.mark.parametrize("which", [0, 1])
def test_imputation_beats_the_mean_on_hidden_days(which):
    """A tenth of the known days of every series of five or more is hidden."""
    rng = np.random.default_rng(1)
    series = [x[which].copy() for x in _daily("/root/testdata/sf0.1")]
    truth = np.concatenate(series)
    for x in series:
        known = np.flatnonzero(~np.isnan(x))
        if len(known) >= 5:
            x[rng.choice(known, max(1, len(known) // 10), replace=False)] = np.nan
    seen = [x[~np.isnan(x)] for x in series]
    n, m = np.array([len(x) for x in seen]), np.array([x.mean() if len(x) else 0.0 for x in seen])
    within = sum(((x - x.mean()) ** 2).sum() for x in seen if len(x)) / (n.sum() - (n > 0).sum())
    mu = (n * m).sum() / n.sum()
    between = ((n * (m - mu) ** 2).sum() - ((n > 0).sum() - 1) * within) / (n.sum() - (n**2).sum() / n.sum())
    flat, spans = np.concatenate(series), np.array([len(x) for x in series])
    out, _, settled = impute_marked(flat, spans, Levels(mu, within, max(between, 0.0)), *HOW)
    hidden = np.isnan(flat) & ~np.isnan(truth)
    error = lambda x: np.sqrt(np.mean((x[hidden] - truth[hidden]) ** 2))
    assert settled.all() and hidden.sum() > 1000
    assert error(out) < 0.995 * error(np.repeat(m, spans))
    filled = np.isnan(flat) & ~np.isnan(out)
    assert (out[filled] <= np.repeat([x.max() if len(x) else np.inf for x in seen], spans)[filled]).all()
    assert (out[filled] >= np.repeat([x.min() if len(x) else -np.inf for x in seen], spans)[filled]).all()


GOOD = [
    "1,2,2009-01-01 00:00:00,0.5", '"1","2","2009-01-01 00:00:00","0.5"', " 1 ,NA, 2009-01-01 23:59:59.1 ,NA\r", "007,NA,2008-02-29 10:00:00,.5",
    "1,2,2009-01-01 00:00:00.123456,1e-3", '1,"NA",2009-01-01 00:00:00,"NA"', '"1" , "2",2009-01-01 00:00:00,1', "2147483647,1,2009-01-01 00:00:00,1.000",
]
BAD = [
    (None, "null line"), ("", "column count"), ("1,2,2009-01-01 00:00:00", "column count"), ("1,2,2009-01-01 00:00:00,0.5,", "column count"),
    ('1,2,"2009-01-01 00:00:00,0.5', "unterminated quote"), ('1,2"",2009-01-01 00:00:00,0.5', "quote in a bare field"),
    ('1,"2"x,2009-01-01 00:00:00,0.5', "text after a closing quote"), ('1,"NA"",2009-01-01 00:00:00,0.5', "unterminated quote"),
    ("NA,2,2009-01-01 00:00:00,0.5", "invalid user.id"), ("0,2,2009-01-01 00:00:00,0.5", "invalid user.id"), ("-1,2,2009-01-01 00:00:00,0.5", "invalid user.id"),
    ("2147483648,2,2009-01-01 00:00:00,0.5", "invalid user.id"), ("1,,2009-01-01 00:00:00,0.5", "invalid remote.user.id.if.known"),
    ("1,na,2009-01-01 00:00:00,0.5", "invalid remote.user.id.if.known"), ("1,٣,2009-01-01 00:00:00,0.5", "invalid remote.user.id.if.known"),
    ("1,2,2009-02-29 00:00:00,0.5", "invalid time"), ("1,2,2009-01-01 24:00:00,0.5", "invalid time"), ("1,2,2009-01-01T00:00:00,0.5", "invalid time"),
    ("1,2,2009-01-01 00:00:00.1234567,0.5", "invalid time"), ("1,2,2009-01-01 00:00:60,0.5", "invalid time"), ("1,2,NA,0.5", "invalid time"),
    ("1,2,2009-01-01 00:00:00,1.01", "invalid prob2"), ("1,2,2009-01-01 00:00:00,-0.1", "invalid prob2"), ("1,2,2009-01-01 00:00:00,NaN", "invalid prob2"),
    ("1,2,2009-01-01 00:00:00,0x1", "invalid prob2"), ("1,2,2009-01-01 00:00:00,", "invalid prob2"), ("1,2,2009-01-01 00:00:00,0.5\r\r", "invalid prob2"),
    ("x" * 100_000, "column count"), ('"' + "y," * 50_000 + '",2,2009-01-01 00:00:00,0.5', "invalid user.id"),
]


def test_lines(spark):
    lines = [(i, line, "clash", "clash") for i, line in enumerate(GOOD + [b for b, _ in BAD])]
    df = spark.createDataFrame(lines, "line_id int, raw_line string, reason string, f0 string")
    parsed = parse_lines(df, "raw_line", carry=("line_id",))
    got = {r.line_id: r for r in parsed.collect()}
    for i in range(len(GOOD)):
        assert got[i].reason is None and got[i]["user.id"] is not None and got[i].time is not None, GOOD[i]
    for i, (line, reason) in enumerate(BAD, len(GOOD)):
        assert got[i].reason == reason and got[i]["user.id"] is None, line
    assert got[0].asDict() == {
        "line_id": 0, "user.id": 1, "remote.user.id.if.known": 2, "time": datetime(2009, 1, 1), "prob2": 0.5, "reason": None, "reason_offset": None,
    }
    offsets = {BAD[i][1]: got[i + len(GOOD)].reason_offset for i in (4, 5, 6)}
    assert offsets == {"unterminated quote": 4, "quote in a bare field": 3, "text after a closing quote": 5}
    # An invalid value's fault begins with its field.
    for i, (line, reason) in enumerate(BAD, len(GOOD)):
        if reason.startswith("invalid"):
            field = [f.name for f in PROXIMITY_FIELDS].index(reason.removeprefix("invalid "))
            assert got[i].reason_offset == len(",".join(line.split(",")[:field]).encode()) + (field > 0), line
    assert all((r.reason is None) == (r.reason_offset is None) for r in got.values())
    good, bad = split_lines(parsed)
    assert good.count() == len(GOOD) and bad.count() == len(BAD) and bad.columns == ["line_id", "reason", "reason_offset"]
    assert parse_lines(df.limit(0), "raw_line").count() == 0


@pytest.mark.parametrize("chunk", [1, 3, 17, 10_000])
def test_records_of_files(spark, tmp_path, chunk):
    """Against a plain walk, with line breaks in quotes, wherever the chunks are cut."""
    rng = random.Random(chunk)
    texts = {"a.csv": "h1,h2\n1,\"x\ny\"\n\n2,é\r\n3,\"\"\"\n\"\nlast", "empty.csv": "", "b.csv": "only", "c.csv": "h\n" + "".join(rng.choice('ab," \n\n') for _ in range(300)) + "\n"}
    if chunk == 1:
        texts["c.csv"] = texts["c.csv"][:60]
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = read_records(spark, str(tmp_path), header=False, chunk_bytes=chunk).collect()
    want = set()
    for name, text in texts.items():
        state, start, data = 0, 0, text.encode()
        for at, c in enumerate(data):
            if c == 10 and state != QUOTED:
                want.add((name, start, data[start:at].decode()))
                start, state = at + 1, 0
            else:
                state = int(ACROSS[CLASSES[c], state])
        if start < len(data):
            want.add((name, start, data[start:].decode()))
    assert {(r.file_name.rsplit("/", 1)[-1], r.byte_offset, r.raw_line) for r in got} == want and len(got) == len(want)
    rest = read_records(spark, str(tmp_path), chunk_bytes=chunk).collect()
    assert len(rest) == len(want) - 3 and all(r.byte_offset > 0 for r in rest)
    parsed = parse_lines(read_records(spark, str(tmp_path), chunk_bytes=chunk), "raw_line", (Field("k", PROXIMITY_FIELDS[0].parse, False), Field("s", lambda c: c, True)))
    assert {(r.k, r.s) for r in parsed.filter("reason is null").collect()} >= {(1, "x\ny"), (2, "é"), (3, '"\n')}


def test_tokenizer_blocks_and_csv_module():
    rng = random.Random(5)
    sound = ['"a ""b"" c",d', "a b,c", '"x,y",""', ' "q" , z ']
    lines = sound + ["".join(rng.choice('ab," \t') for _ in range(rng.randrange(0, 40))) for _ in range(500)]
    whole = tokenize(pa.array(lines), 2, block=10_000)
    for block in (1, 3, 64):
        part = tokenize(pa.array(lines), 2, block=block)
        assert all(part[k].equals(whole[k]) for k in whole)
    for i, line in enumerate(sound):
        fields = next(csv.reader([line.replace(' "q" ', '"q"')]))
        assert [whole["f0"][i].as_py().strip(), whole["f1"][i].as_py().strip()] == [f.strip() for f in fields]
    middle = tokenize(pa.array(lines).slice(5, 50), 2)
    assert all(middle[k].equals(whole[k].slice(5, 50)) for k in whole)
    batch = pa.RecordBatch.from_arrays([pa.array([*lines[:20], None, "x" * 500, "", "y"])], names=["line"])
    for most in (1, 30, 10_000):
        parts = list(slices(batch, 0, most))
        assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
        assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(0).to_pylist()) <= most for p in parts)
    assert len(states_before(np.zeros(0, dtype=np.uint8))) == 0
    assert tokenize(pa.array([], pa.string()), 2)["f0"].to_pylist() == []


def per_key_reference(rows: list[tuple]) -> dict:
    out: dict = {}
    for field, a, b in (("user.id", 1, 2), ("remote.user.id.if.known", 2, 1)):
        total = sum(r[a] is not None for r in rows)
        for key in {r[a] for r in rows} - {None}:
            mine = [r for r in rows if r[a] == key]
            times = [r[3] for r in mine if r[3] is not None]
            values = [r[4] for r in mine if r[4] is not None and r[4] == r[4]]
            out[(field, key)] = (
                len(mine), round(len(mine) / total, 9), len({r[b] for r in mine} - {None}), min(times, default=None), max(times, default=None),
                round(float(np.mean([np.float32(v) for v in values], dtype=np.float64)), 6) if values else None,
            )
    return out


@pytest.mark.parametrize("tasks", [1, 3, 16])
def test_per_key(spark, tasks):
    rows = log_rows(300, seed=2)
    df = spark.createDataFrame(rows, LOG).repartition(4)
    got = {
        (r.field, r.key_id): (r.readings, round(r.share, 9), r.partners, r.first_time, r.last_time, None if r.mean_value is None else round(r.mean_value, 6))
        for r in per_key_results(df, (USER, PEER), "time", "prob2", tasks).collect()
    }
    assert got == per_key_reference(rows)
    assert per_key_results(df.limit(0), (USER, PEER), "time", "prob2", tasks).count() == 0


def test_shard_plan_balances(spark):
    loads = spark.createDataFrame([(k, 1) for k in range(1000)] + [(-1, 50_000), (-2, 30_000), (-3, 500)], "key int, load bigint")
    plan = plan_shards(loads, "key", "load", 8)
    heavy = dict(plan.heavy)
    assert set(heavy) == {-1, -2} and len(heavy[-1]) == 8
    per_task = [sum((50_000 / 8, 30_000 / len(heavy[-2]))[k == -2] * heavy[k].count(t) for k in heavy) for t in range(8)]
    assert max(per_task) < 1.6 * sum(per_task) / 8
    assert plan_shards(loads.limit(0), "key", "load", 8).heavy == ()


def test_fragment_replicate_join(spark):
    left = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 50).cast("int").alias("k"))
    right = spark.createDataFrame([(k, f"v{k}") for k in range(40)] + [(7, "again"), (None, "void")], "k int, v string")
    loads = left.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    plan = plan_shards(loads, "k", "n", 6)
    assert plan.heavy
    for how in ("inner", "left"):
        got = fragment_replicate_join(left, right, "k", ["id"], plan, how)
        want = left.join(right, "k", how)
        assert sorted(map(str, got.select("id", "k", "v").collect())) == sorted(map(str, want.select("id", "k", "v").collect()))
    spread = plan.fragment(left, "k", ["id"]).filter("k = 7").groupBy("task_id").count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 2.5 * min(r["count"] for r in spread)
    with pytest.raises(ValueError):
        fragment_replicate_join(left, right, "k", ["id"], plan, "outer")


def test_grid_marks_long_gaps_and_cuts_long_series(spark):
    days = [d for d in range(60) if d % 9] + [3000, 3001, 3003] + list(range(90_000, 90_020, 2))
    rows = [(1, START + timedelta(days=d), 2.0 + d % 7) for d in days] + [(2, START, float("inf")), (2, START + timedelta(days=2), float("nan"))]
    df = spark.createDataFrame(rows, "u int, t timestamp_ntz, v double")
    how = {"keys": ("u",), "time": "t", "value": "v", "origin": "2008-09-19"}
    for extra in ({"longest_gap": 100}, {"longest_gap": 100, "longest_piece": 20}, {"longest_gap": 5000, "longest_piece": 7}):
        got = regular_grid(df, GridSpec(**how, **extra)).collect()
        mine = sorted((r for r in got if r.key_0 == 1), key=lambda r: r.period)
        assert [r.period for r in mine] == list(range(min(days), max(days) + 1))
        assert [r.period for r in mine if not r.filled] == days and all(r.converged for r in mine)
        longest = extra["longest_gap"]
        gaps = {d for a, b in zip(days, days[1:]) if b - a > longest + 1 for d in range(a + 1, b)}
        assert all((r.readings_est is None) == (r.period in gaps) == (r.value is None) for r in mine)
        assert all(2.0 <= r.value <= 8.0 for r in mine if r.value is not None)
        other = sorted((r for r in got if r.key_0 == 2), key=lambda r: r.period)
        assert [(r.filled, r.n_readings, r.value, r.value_filled) for r in other] == [(False, 1, None, True), (True, 0, None, True), (False, 1, None, True)]
    with pytest.raises(ValueError):
        GridSpec(**how, ridge=0.0)


def test_grid_marks_series_that_settled(spark):
    rows = [(u, START + timedelta(days=d), float((d * 7 + u) % 5)) for u in (1, 2) for d in range(40) if u == 2 or d not in (5, 6, 17, 18, 30)]
    df = spark.createDataFrame(rows, "u int, t timestamp_ntz, v double")
    got = regular_grid(df, GridSpec(keys=("u",), time="t", value="v", origin="2008-09-19")).collect()
    assert {(r.key_0, r.converged, r.iterations > 0) for r in got} == {(1, True, True), (2, True, False)}
    assert all(abs(r.value - (r.period * 7 + 1) % 5) < 0.8 for r in got if r.key_0 == 1 and r.value_filled)
