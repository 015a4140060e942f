"""The operators of the text subpackage against brute force, round trips and awkward inputs."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm.encoding import DECODE, Restorer, features, pair_counts, restore, restore_spans
from driftloom.llm.mixing import mix
from driftloom.llm.packing import fill_slot, pack
from driftloom.llm.runs import RunSpec, collapse_runs
from driftloom.llm.tokens import with_sizes

LOG = "reading_id bigint, u int, r int, time timestamp_ntz, entity string, at int, event string, id string, place int"
START = datetime(2009, 1, 1)


def log_rows(n: int, seed: int, peers: int = 2) -> list[tuple]:
    rng = random.Random(seed)
    rows, clock = [], 0
    for i in range(n):
        clock += rng.choice([0, 10, 60, 900, 901])
        user = 7 if rng.random() < 0.4 else rng.choice([1, 2, None])
        time = None if rng.random() < 0.05 else START + timedelta(seconds=clock)
        rows.append((i, user, rng.choice([None, *range(1, peers)]), time, "a", 1, "b", "c", 2))
    rng.shuffle(rows)
    return rows + rows[: n // 20]


def runs_reference(rows: list[tuple]) -> list:
    low = lambda v: (v is not None, v or 0)
    out = []
    for user in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == user and r[3] is not None), key=lambda r: (r[3], low(r[2]), r[0]))
        groups: list[list] = []
        for r in mine:
            if groups and groups[-1][-1][2] == r[2] and (r[3] - groups[-1][-1][3]).total_seconds() <= 900:
                groups[-1].append(r)
            else:
                groups.append([r])
        out += [(user, g[0][2], g[0][0], g[-1][0], g[0][3], g[-1][3], (g[-1][3] - g[0][3]).total_seconds(), len(g)) for g in groups]
    return sorted(out, key=str)


@pytest.mark.parametrize(("peers", "partitions", "batch"), [(2, 4, 10_000), (3, 16, 7), (1, 32, 1), (4, 1, 50)])
def test_runs(spark, peers, partitions, batch):
    rows = log_rows(400, seed=peers, peers=peers)
    df = spark.createDataFrame(rows, LOG).repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted((tuple(r) for r in collapse_runs(df, RunSpec("u", "time", "r", "reading_id")).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == runs_reference(rows)


def near_reference(rows: list[tuple], near: float) -> list:
    low = lambda v: (v is not None, v or 0)
    out = []
    for user in {r[1] for r in rows}:
        anchor, latest, run = None, None, []
        for r in sorted((r for r in rows if r[1] == user and r[3] is not None), key=lambda r: (r[3], low(r[2]), r[0])):
            alike = r[2] is anchor if r[2] is None or anchor is None else abs(r[2] - anchor) <= near
            if not run or not alike or (r[3] - latest).total_seconds() > 900:
                out.append(run := [])
                anchor = r[2]
            run.append((user, anchor, r[0]))
            latest = r[3]
    return sorted(((g[0][0], g[0][1], g[0][2], g[-1][2], len(g)) for g in out), key=str)


@pytest.mark.parametrize(("jump", "partitions", "batch"), [(3, 4, 10_000), (1, 16, 7), (1, 32, 1), (2, 1, 50)])
def test_runs_near_their_anchor(spark, jump, partitions, batch):
    """Slow drift without gaps, so that where runs end depends on where the first of them began, partitions earlier."""
    rng = random.Random(jump)
    rows, x = [], 0
    for i in range(500):
        x += rng.choice([0, 1, jump])
        rows.append((i, 7 if i % 5 else rng.choice([1, None]), None if rng.random() < 0.02 else x, START + timedelta(seconds=30 * i), "", 0, "", "", 0))
    df = spark.createDataFrame(rows + rows[:20], LOG).repartition(6)
    how = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.enabled": False, "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    before = {k: spark.conf.get(k) for k in how}
    for k, v in how.items():
        spark.conf.set(k, v)
    try:
        got = collapse_runs(df, RunSpec("u", "time", "r", "reading_id", near=4)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(((r.entity, r.event, r.first_id, r.last_id, r.n_events) for r in got), key=str) == [
        (a, None if b is None else float(b), *rest) for a, b, *rest in near_reference(rows + rows[:20], 4)
    ]


def test_near_runs_and_empty(spark):
    rows = [(i, 1, p, START + timedelta(seconds=i), "", 0, "", "", 0) for i, p in enumerate([10, 11, 19, 20, 10])]
    df = spark.createDataFrame(rows, LOG)
    got = collapse_runs(df, RunSpec("u", "time", "r", "reading_id", like=lambda c: F.floor(c / 10))).orderBy("start").collect()
    assert [(r.event, r.n_events) for r in got] == [(1, 3), (2, 1), (1, 1)]
    assert collapse_runs(df.limit(0), RunSpec("u", "time", "r", "reading_id")).count() == 0
    with pytest.raises(ValueError):
        RunSpec("u", "time", "r", "reading_id", gap_seconds=-1)
    with pytest.raises(ValueError):
        RunSpec("u", "time", "r", "reading_id", near=-1.0)
    assert collapse_runs(df.limit(0), RunSpec("u", "time", "r", "reading_id", near=1.0)).count() == 0


def test_sizes(spark):
    texts = [(1, "a", "Hello, world"), (2, None, ""), (3, "b", None), (4, "a", "Привет " * 5000), (5, "a", "<|endoftext|>")]
    got = {r.doc_id: r.size for r in with_sizes(spark.createDataFrame(texts, "doc_id int, source string, text string"), "text", ("doc_id", "source")).collect()}
    assert set(got) == {1, 2, 4, 5} and got[2] == 0 and got[1] == 3 and got[4] > 5000 and got[5] > 1


def items(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "big" if rng.random() < 0.6 else rng.choice(["small", "tiny", None])
        rows.append((None if rng.random() < 0.02 else i, source, None if rng.random() < 0.02 else rng.choice([0, 1, 5, 20, 60, 100, 101, 250]), 1, 2))
    return rows + rows[: n // 20]


def first_fit(sizes: list[int], capacity: int) -> int:
    room: list[int] = []
    for size in sorted(sizes, reverse=True):
        k = next((k for k, r in enumerate(room) if r >= size), None)
        if k is None:
            room.append(capacity - size)
        else:
            room[k] -= size
    return len(room)


ITEMS = "doc bigint, source string, n int, slot int, piece int"


@pytest.mark.parametrize("per_slot", [50, 10_000])
def test_pack(spark, per_slot):
    rows = items(600, seed=4)
    got = pack(spark.createDataFrame(rows, ITEMS), "doc", "source", "n", {"s": 100, "l": 400}, per_slot).collect()
    for name, capacity in (("s", 100), ("l", 400)):
        used, pieces = defaultdict(int), defaultdict(list)
        for r in got:
            if r.container == name:
                used[r.container_id] += r.size
                pieces[(r.item_id, r.source, r.n_pieces)].append(r.size)
        assert max(used.values()) <= capacity
        assert sum(used.values()) == sum(r[2] or 0 for r in rows)
        # Nothing is cut unless it is larger than the capacity, and then into full pieces and one rest.
        whole = sorted(s for (_, _, n), sizes in pieces.items() if n == 1 for s in sizes)
        assert whole == sorted(r[2] for r in rows if r[2] is not None and r[2] <= capacity)
        assert all(n == 1 or sizes.count(capacity) >= len(sizes) * (n - 1) // n for (_, _, n), sizes in pieces.items())
        # Hardly more containers than first-fit decreasing needs over all items at once, but for one per slot.
        slots = len({i >> 32 for i in used})
        assert len(used) <= 1.01 * first_fit([r.size for r in got if r.container == name], capacity) + slots
    assert pack(spark.createDataFrame(rows, ITEMS).limit(0), "doc", "source", "n", {"s": 100}).count() == 0
    with pytest.raises(ValueError):
        pack(spark.createDataFrame(rows, ITEMS), "doc", "source", "n", {})


def test_pack_is_near_the_optimum_and_keeps_the_mixture():
    rng = random.Random(9)
    sources = [rng.choice("aab") for _ in range(3000)]
    sizes = [rng.randrange(1, 120) for _ in range(3000)]
    total = {s: sum(n for x, n in zip(sources, sizes) if x == s) for s in "ab"}
    share = {s: (total[s] / sum(sizes), 0.0) for s in "ab"}
    out = fill_slot(sources, sizes, 512, share)
    windows = defaultdict(lambda: defaultdict(int))
    for w, row, _, _, size in out:
        windows[w][sources[row]] += size
    assert len(windows) <= -(-sum(sizes) // 512) + 1
    running = 0
    for w in sorted(windows)[: int(0.9 * len(windows))]:
        running += windows[w]["a"] - share["a"][0] * sum(windows[w].values())
        assert abs(running) < 512  # never a whole window off its target


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="needs the generated tables")
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_containers_of_many_items_hold_the_mixture(seed):
    """Sized by characters; a container that an item fills by half can't have the mixture."""
    rows = duckdb.sql("SELECT source, n_chars FROM '/root/testdata/sf0.1/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()
    sources, sizes = [s for s, _ in rows], [n for _, n in rows]
    capacity = 16_384
    totals = defaultdict(int)
    for s, n in rows:
        totals[s] += n
    share = {s: n / sum(sizes) for s, n in totals.items()}
    held, largest = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for window, row, _, _, size in fill_slot(sources, sizes, capacity, {s: (w, 0.0) for s, w in share.items()}, seed):
        held[window][sources[row]] += size
        largest[window] = max(largest[window], size)
    assert sum(sizes) / (len(held) * capacity) >= 0.998 and len(held) <= -(-sum(sizes) // capacity) + 1
    off = []
    for window, parts in held.items():
        used = sum(parts.values())
        assert used <= capacity
        if largest[window] < capacity / 2:
            off.append(sum(abs(parts[s] / used - w) for s, w in share.items()) / 2)
    assert np.mean(np.array(off) > 0.3) <= 0.05 and np.mean(off) < 0.15


def test_pack_to_given_targets(spark):
    """Until a source is used up, containers have the shares asked for."""
    rng = random.Random(6)
    rows = [(i, rng.choice("aab"), rng.randrange(1, 30)) for i in range(3000)]
    got = pack(spark.createDataFrame(rows, "doc int, source string, n int"), "doc", "source", "n", {"c": 600}, targets={"a": 1.0, "b": 3.0}).collect()
    assert sorted((r.item_id, r.size) for r in got) == sorted((i, n) for i, _, n in rows)
    held = defaultdict(lambda: defaultdict(int))
    for r in got:
        held[r.container_id][r.source] += r.size
    early = [held[k]["b"] / sum(held[k].values()) for k in sorted(held)[: len(held) // 3]]
    assert 0.7 < np.mean(early) < 0.8 and min(early) > 0.6
    with pytest.raises(ValueError):
        pack(spark.createDataFrame(rows, "doc int, source string, n int"), "doc", "source", "n", {"c": 600}, targets={"a": 0.0})


def test_mix_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "a" if i % 3 else "b", rng.randrange(0, 40)) for i in range(500)] + [(900, None, 30), (901, "other", 5), (902, "c", None), (903, "c", 12)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 4), ("d", 0.1, 2), ("other", None, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(rows, "doc int, source string, n int")
    budget = sum(r[2] or 0 for r in rows)
    results = []
    for per_range in (10_000, 40):
        m = mix(df, "doc", "source", "n", targets, rows_per_range=per_range)
        docs = m.documents.collect()
        results.append(sorted((r.item_id, r.copy, round(r.virtual_finish, 6)) for r in docs))
        by: dict = defaultdict(list)
        for r in docs:
            by[r.source].append(r)
        # Each source's finish times are its running total over its weight, pass by pass, without a gap.
        for s, weight in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
            run = 0
            for r in sorted(by[s], key=lambda r: (r.virtual_finish, r.copy, -r.size)):
                run += r.size
            assert max(r.virtual_finish for r in by[s]) == pytest.approx(run / weight)
        assert sum(r.size for r in docs) <= budget
        assert budget - sum(r.size for r in docs) < 80
        uses = defaultdict(int)
        for r in docs:
            uses[r.item_id] += 1
        assert max(uses[r[0]] for r in rows if r[1] == "a") == 1 and max(uses.values()) <= 4 and uses[903] == 4 and not uses[900] and not uses[901]
        shares = {r.source: r for r in m.shares.collect()}
        assert shares["d"].tokens == 0 and shares["c"].exhausted and shares["c"].tokens == 48
        assert sum(r.actual_share for r in shares.values()) == pytest.approx(1.0)
        finish = [r.virtual_finish for r in docs]
        assert finish == sorted(finish)
    assert len(results[0]) == len(results[1])


def test_mix_shares_and_limits(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 < 7, "x").otherwise("y").alias("s"), (F.col("id") % 17).alias("n"))
    targets = spark.createDataFrame([("x", 0.25, 1), ("y", 0.75, 5)], "source string, target_share double, max_repeats int")
    shares = {r.source: r.actual_share for r in mix(df, "id", "s", "n", targets).shares.collect()}
    assert shares["x"] == pytest.approx(0.25, abs=0.002)
    assert mix(df.limit(0), "id", "s", "n", targets).documents.count() == 0
    assert mix(df, "id", "s", "n", targets, budget=0).documents.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] == 0
    with pytest.raises(ValueError):
        mix(df, "id", "s", "n", targets.union(targets))


SENTENCES = [
    "Le téléphone reste muet à côté de l’entrée où personne n’a été prévenu.", "Das Gerät im Büro überschreitet größere Lücken als üblich.",
    "El teléfono no envió ningún dato según el último boletín.", "O relatório da estação mostra variações após a atualização.",
    "Узел сети теряет около измерений хотя батарея заряжена.", "Το κατώφλι χάνει περίπου των μετρήσεων μέχρι την επόμενη.",
    "Přijímač u vchodu běží jen během přednášky kvůli špatnému kabelu.", "Węzeł środkowy pokazuje dłuższą przerwę choć łącze było sprawne.",
    "The café group — see the “façade” note … fell from 45–120 µs ± 3 °C.", "閾値の検出器は長い空白を示し、密度が下がった。",
]
GARBLES = [
    ("utf-8", "cp1252"), ("utf-8", "iso8859-1"), ("utf-8", "cp1251"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("cp1252", "mac_roman"), ("cp1252", "cp850"),
    ("cp850", "cp1252"), ("cp1251", "koi8-r"), ("cp1253", "cp1252"), ("cp1250", "cp1252"),
]


def garble(text: str, true: str, wrong: str) -> str | None:
    try:
        return "".join(DECODE[wrong][b] for b in text.encode(true))
    except UnicodeEncodeError:
        return None


def corpus() -> list[str]:
    rng = random.Random(0)
    return [" ".join(rng.choice(SENTENCES[k : k + 1] * 3 + SENTENCES) for _ in range(6)) for k in range(10) for _ in range(60)]


def test_restores_garbled_text(spark):
    clean = corpus()
    bad = []
    for true, wrong in GARBLES:
        for s in SENTENCES:
            g = garble(s, true, wrong)
            if g and g != s:
                bad.append((g, s))
    twice = garble(garble(SENTENCES[1], "utf-8", "cp1252"), "utf-8", "cp1252")
    bad.append((twice, SENTENCES[1]))
    rows = [(i, t, "x") for i, t in enumerate(clean)] + [(10_000 + i, g, "x") for i, (g, _) in enumerate(bad)]
    found = {r.doc_id: r for r in restore(spark.createDataFrame(rows, "doc_id int, text string, how string"), "doc_id", "text").collect()}
    assert not [i for i in found if i < 10_000]
    missed = [g for i, (g, _) in enumerate(bad) if 10_000 + i not in found]
    assert len(missed) <= 0.03 * len(bad), missed
    right = sum(found[10_000 + i].restored == s for i, (_, s) in enumerate(bad) if 10_000 + i in found)
    assert right >= 0.85 * len(bad)


def test_sound_and_lossy_texts(spark):
    clean = corpus()
    odd = [
        None, "", "plain ASCII &eacute; caf? =C3=A9", "label reads faÃ§ade instead of façade here", "Old rows carry “�” for every letter",
        "ｆｕｌｌ ｗｉｄｔｈ ４５", "café déjà", "½ µ § ¶ ¿", "λ = 5", "Â, Ã and Å sort last here", "é" * 50_000,
    ]
    lossy = ["Le t�l�phone reste muet", SENTENCES[0] + " �"]
    rows = list(enumerate(clean)) + [(10_000 + i, t) for i, t in enumerate(odd)] + [(20_000 + i, t) for i, t in enumerate(lossy)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    found = {r.doc_id: r for r in restore(df, "doc_id", "text").collect()}
    assert set(found) == {20_000, 20_001}
    assert not found[20_000].whole
    assert restore(df.limit(0), "doc_id", "text").count() == 0
    # The order of documents and their partitioning don't matter.
    again = {r.doc_id: r for r in restore(df.repartition(7), "doc_id", "text").collect()}
    assert again == found


LANGUAGES = ("en", "en", "en", "en", "de", "fr", "es", "pt", "pl", "ru", "cs", "el", "ja")
#: How texts get garbled: read as the second what was written in the first (and again).
GARBLED = {
    "en": [], "de": [("utf-8", "cp1252"), ("utf-8", "iso8859-1"), ("utf-8", "cp1252", "utf-8", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp437")],
    "fr": [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("cp1252", "cp850")], "es": [("utf-8", "cp1252"), ("utf-8", "cp850"), ("iso8859-1", "mac_roman")],
    "pt": [("utf-8", "iso8859-1"), ("utf-8", "cp437")], "pl": [("utf-8", "cp1250"), ("cp1250", "cp1252"), ("iso8859-2", "cp1252")],
    "ru": [("utf-8", "cp1251"), ("utf-8", "cp1252"), ("cp1251", "iso8859-1"), ("koi8-r", "cp1251"), ("cp866", "cp1251")], "cs": [("utf-8", "cp1250"), ("cp1250", "cp1252")],
    "el": [("utf-8", "cp1253"), ("utf-8", "cp1252"), ("cp1253", "cp1252")], "ja": [("utf-8", "cp1252"), ("cp932", "cp1252"), ("euc-jp", "iso8859-1"), ("utf-8", "cp932")],
}


def readable(data: bytes, name: str) -> str | None:
    """The bytes as characters of an encoding, what cp1252 and others leave undefined as controls; null if some can't be read."""
    if name in DECODE:
        return "".join(DECODE[name][b] for b in data)
    try:
        return data.decode(name)
    except UnicodeDecodeError:
        return None


def names_texts(spark, n: int, seed: int) -> list[tuple[int, str, str | None]]:
    """Texts made of the names of countries and languages that the JVM knows: (id, text, right text if it is garbled)."""
    locale = spark._jvm.java.util.Locale
    countries, tongues = list(locale.getISOCountries()), list(locale.getISOLanguages())
    words = {}
    for code in sorted(set(LANGUAGES)):
        of = locale.forLanguageTag(code)
        words[code] = [locale("", c).getDisplayCountry(of) for c in countries] + [locale(t).getDisplayLanguage(of) for t in tongues]
    rng = random.Random(seed)
    out = []
    for i in range(n):
        code = rng.choice(LANGUAGES)
        text = ", ".join(rng.choice(words[code]) for _ in range(rng.choice([3, 12, 40])))
        right = None
        if GARBLED[code] and rng.random() < 0.12:
            steps = rng.choice(GARBLED[code])
            whole = rng.random() < 0.6
            head, tail = ("", text) if whole else (text[: len(text) // 2], text[len(text) // 2 :])
            wrong: str | None = tail
            for true, seen in zip(steps[::2], steps[1::2]):
                try:
                    wrong = readable(wrong.encode(true), seen) if wrong is not None else None
                except UnicodeEncodeError:
                    wrong = None
            if wrong is not None and wrong != tail:
                right, text = text, head + wrong
        out.append((i, text, right))
    return out


def test_texts_of_another_origin(spark):
    """Recall, precision and exact restorations on garbles planted in texts that no threshold was set on."""
    rows = names_texts(spark, 4000, 7)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    got = {r.doc_id: r for r in restore(df, "doc_id", "text").collect()}
    planted = {i: right for i, _, right in rows if right is not None}
    hit = planted.keys() & got.keys()
    exact = sum(got[i].restored == planted[i] for i in hit)
    spans = {r.doc_id for r in restore_spans(df, "doc_id", "text").collect()}
    print(f"planted {len(planted)}, found {len(got)}, both {len(hit)}, exact {exact}, by spans alone {len(planted.keys() & spans)} and {len(spans - planted.keys())} false")
    assert len(planted) > 250
    assert len(hit) >= 0.9 * len(planted) and len(hit) >= 0.95 * len(got) and exact >= 0.8 * len(planted)
    assert len(spans - planted.keys()) <= 0.02 * len(spans)


def test_pair_counts(spark):
    texts = ["é é", "aé", "ascii", "É", None]
    counts, total = pair_counts(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    assert total == 4 and counts[features(["aé"])].max() == 2
    # Texts side by side count as each by itself.
    rng = random.Random(1)
    many = ["".join(rng.choice("aé ñ0—\n") for _ in range(rng.randrange(12))) for _ in range(300)]
    apart = sum(np.bincount(features([t]), minlength=1 << 20) for t in many)
    assert (np.bincount(features(many), minlength=1 << 20) == apart).all()
    restorer = Restorer(counts, total)
    assert restorer.examine("nothing here") == (False, True, "nothing here", "", 0)


def test_many_copies_of_a_garbled_text_are_found(spark):
    clean = corpus()
    copy = garble(SENTENCES[0], "utf-8", "cp1252")
    copies = [garble(SENTENCES[4], "cp1251", "koi8-r")] * 100
    rows = [*clean, *[copy] * 200, *copies]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    found = {r.doc_id: r.restored for r in restore(df, "doc_id", "text").collect()}
    assert set(found) == set(range(len(clean), len(rows)))
    assert all(found[i] == (SENTENCES[0] if i < len(clean) + 200 else SENTENCES[4]) for i in found)
    # A source of different texts that was wholly decoded wrongly.
    source = [f"{garble(t, 'utf-8', 'cp1252')} {i}" for i, t in enumerate(clean[:60] * 5)]
    df = spark.createDataFrame(list(enumerate([*clean[60:], *source])), "doc_id int, text string")
    found = {r.doc_id: r.restored for r in restore(df, "doc_id", "text").collect()}
    assert set(found) == set(range(540, 840))
    assert sum(found[540 + i] == f"{t} {i}" for i, t in enumerate(clean[:60] * 5)) >= 270


def test_east_asian_read_as_another_multibyte_encoding(spark):
    clean = corpus()
    japanese = "密度が下がった。"
    ways = [("euc-jp", "cp932"), ("cp932", "gbk"), ("euc-jp", "gbk")]
    bad = [(japanese.encode(t).decode(w), japanese) for t, w in ways] + [(SENTENCES[9].encode("cp932").decode("gbk"), SENTENCES[9])]
    lossy = SENTENCES[9].encode("euc-jp").decode("cp932", "replace")
    df = spark.createDataFrame(list(enumerate([*clean, *(g for g, _ in bad), lossy])), "doc_id int, text string")
    found = {r.doc_id: r for r in restore(df, "doc_id", "text").collect()}
    assert set(found) == set(range(len(clean), len(clean) + 5))
    assert all("\ufffd" not in g for g, _ in bad)
    assert [found[len(clean) + i].restored for i in range(4)] == [s for _, s in bad]
    last = found[len(clean) + 4]
    assert not last.whole and "密度が下がった" in last.restored


def test_garbled_stretch_beside_sound_east_asian_text(spark):
    clean = corpus()
    sound = "閾値の検出器は長い空白を示し、"
    pairs = [(sound + "密度".encode("utf-8").decode("gbk"), sound + "密度"), ("密度。" + "密度".encode("utf-8").decode("gbk"), "密度。密度"), ("検出器は" + "é".encode("utf-8").decode("cp932"), "検出器はé")]
    pairs += [(sound + "密度が下がった".encode("euc-jp").decode("cp932"), sound + "密度が下がった")]
    df = spark.createDataFrame(list(enumerate([*clean, "検出器は長い é", *(g for g, _ in pairs)])), "doc_id int, text string")
    found = {r.doc_id: r.restored for r in restore(df, "doc_id", "text").collect()}
    assert found == {len(clean) + 1 + i: s for i, (_, s) in enumerate(pairs)}


def test_lost_characters_read_again():
    restorer = Restorer(np.zeros(1 << 20, dtype=np.int64), 100)
    for text in ("Le tï¿½lï¿½phone", "Узел пїЅ молчит", "密度锟斤拷下"):
        found, whole, restored, *_ = restorer.examine(text)
        assert found and not whole and "�" in restored
    assert restorer.examine("Le tï¿½lï¿½phone")[2] == "Le t�l�phone"
    assert not restorer.examine("Old rows carry “ï¿½” for every letter")[0]


def test_all_readings_are_kept():
    restorer = Restorer(np.full(1 << 20, 1000), 1_000_000)
    chunk = "§"
    restorer.pairs |= {a + b: -1.0 for a, b in zip(" " + chunk, chunk + " ")}
    assert len(restorer.candidates(chunk)) > 24
