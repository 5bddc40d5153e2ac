"""Machines over streams against their run over a table and against plain folds."""

import math
import random
import re
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from memoria.operators import rank
from memoria.streaming import events as streams
from memoria.streaming import state

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


def streamed(spark, frames, make, folder, name):
    """The rows of a stream over files that come one after the other."""
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = streams.read(spark, f"{folder}/in", frames[0].schema)
    return streams.run_available(make(source), name, f"{folder}/c")


def plain_buffer(pieces):
    """The rules of the buffer, as a generator over (second, text)."""
    clean, thinking, said, out = "", False, None, []
    for t, piece in pieces:
        said = t if said is None else said
        if not piece:
            continue
        for part in re.split(r"(</?think>)", piece):
            if part == "<think>" and not thinking:
                thinking = True
            elif part == "</think>" and thinking:
                thinking = False
            elif not thinking:
                clean += part
        if thinking:
            continue
        while m := re.match(r"(.*?[.!?])\s+(.*)", clean, re.S):
            s, clean = m[1].strip(), m[2]
            if len(s) < 4:
                clean = s + " " + clean
                break
            out.append(s)
            said = t
        if (len(clean) > 20 and t - said > 2) or len(clean.split()) >= 30:
            cut = clean.lstrip().rfind(" ")
            if cut > 0:
                head, clean = clean.lstrip()[:cut], clean.lstrip()[cut + 1 :]
                if head.strip():
                    out.append(head.strip())
                    said = t
    return out + ([clean.strip()] if clean.strip() else []) + [None]


def test_sentences_over_table_and_stream(spark, tmp_path):
    r = random.Random(1)
    words = ["Hello", "there.", "Why?", "a", "No.", "<think>", "hm", "</think>", "long", "\n\n", "end!", "", "x" * 25, " "]
    rows, pieces = [], defaultdict(list)
    for key in "abcd":
        t = 0.0
        for k in range(60):
            t += r.choice([0, 0.1, 0.5, 2.5])
            text = None if r.random() < 0.05 else r.choice(["", " "]).join(r.choices(words, k=r.randrange(0, 6))) + r.choice(["", " "])
            rows.append((key, at(t), k, text))
            pieces[key].append((t, text))
    schema = "stream string, ts timestamp, nth int, piece string"
    df = spark.createDataFrame(rows, schema)
    how = {"key": "stream", "at": "ts", "text": "piece", "order": "nth"}
    gathered = lambda found: {k: [c for _, c in sorted(v)] for k, v in _grouped(found).items()}
    expected = {k: plain_buffer(v) for k, v in pieces.items()}
    assert gathered(state.sentences(df.repartition(3), **how).collect()) == expected
    # Files of twenty pieces each, then one of another stream, much later, that lets the others end.
    frames = [spark.createDataFrame([x for x in rows if x[2] // 20 == i], schema) for i in range(3)] + [spark.createDataFrame([("late", at(9 * 3600 * k), 0, "Bye.") for k in (1, 2)], schema)] * 2
    found = streamed(spark, frames, lambda s: state.sentences(s, live="10", **how), tmp_path, "sentences")
    found = {k: v for k, v in gathered(found.collect()).items() if k != "late"}
    assert found == expected


def _grouped(found):
    out = defaultdict(list)
    for x in found:
        out[x.key].append((x.n, x.content))
    return out


def test_disclosure_sessions_open_layers_and_expire(spark, tmp_path):
    rows = [
        ("s", 0, None, "start"), ("s", 10, 1, "explore"), ("s", 20, 2, "reject"), ("s", 25, 2, "reject"), ("s", 30, 3, "explore"), ("s", 40, 4, "ignore"), ("s", 50, 5, "explore"),
        ("s", 60, 6, "explore"), ("s", 70, 7, "what"), ("s", 80, None, "start"), ("s", 3600, 8, "ignore"), ("s", 3601, 9, "explore"), ("s", 4000, None, "start"), ("s", 4100, 9, "explore"), ("t", 5, 1, "explore"),
    ]
    schema = "sid string, ts timestamp, doc long, said string"
    rows = [(k, at(t), d, s) for k, t, d, s in rows]
    expected = [
        (0, 0, "open"), (0, 1, "taken"), (1, None, "taken"), (1, None, "taken"), (1, 2, "taken"), (2, None, "taken"), (2, 3, "taken"), (3, None, "deepest"), (3, None, "refused"), (3, None, "running"),
        (3, None, "taken"), (3, None, "expired"), (0, 0, "open"), (0, 1, "taken")]
    how = {"session": "sid", "at": "ts", "summary": "doc", "response": "said"}
    shown = lambda found: [(x.layer, x.opened, x.status) for x in sorted(found, key=lambda x: x["at"]) if x.key == "s"]
    found = state.disclosure(spark.createDataFrame(rows, schema).repartition(2), **how).collect()
    assert shown(found) == expected
    last = [x for x in found if x.key == "s" and x.status == "deepest"][0]
    assert (last.explored, last.ignored, last.rejected) == (4, 1, 1)
    assert [x.status for x in found if x.key == "t"] == ["unknown"]
    frames = [spark.createDataFrame(rows[i : i + 4], schema) for i in range(0, len(rows), 4)]
    assert shown(streamed(spark, frames, lambda s: state.disclosure(s, stream=True, **how), tmp_path, "disclosed").collect()) == expected


def test_an_expired_session_loses_its_state(spark, tmp_path):
    schema = "sid string, ts timestamp, doc long, said string"
    frames = [spark.createDataFrame([x], schema) for x in [("s", at(0), None, "start"), ("u", at(3 * 3600), None, "start"), ("u", at(6 * 3600), 1, "ignore"), ("s", at(6 * 3600), 1, "explore")]]
    found = streamed(spark, frames, lambda s: state.disclosure(s, session="sid", at="ts", summary="doc", response="said", stream=True), tmp_path, "expired").collect()
    assert [x.status for x in found if x.key == "s"] == ["open", "unknown"]


def test_heat_equals_topic_heat_at_every_emission(spark, tmp_path):
    r = random.Random(3)
    times = sorted(r.choice([3600 * r.randrange(0, 400), r.uniform(0, 400 * 3600)]) for _ in range(120))
    rows = sorted([(r.choice(["a", "b"]), at(t), r.choice([None, 1.0, 2.5, -1.0])) for t in times], key=lambda x: (x[1], x[2] is not None, x[2]))
    df = spark.createDataFrame(rows, "topic string, ts timestamp, w double")

    def expected(topic, upto, end):
        return sum((w or 0) * math.exp(-(end - t).total_seconds() / 3600 / 24) for k, t, w in rows[:upto] if k == topic and 0 <= (end - t).total_seconds() <= 168 * 3600)

    def check(found):
        left = defaultdict(list)
        for x in found:
            left[x.key].append((x.as_of.astimezone(timezone.utc), x.heat))
        assert sum(map(len, left.values())) == len(rows)
        for i, (k, t, _) in enumerate(rows):
            end, heat = left[k].pop(0)
            assert end == START + timedelta(hours=math.floor((t - START).total_seconds() / 3600) + 1)
            assert heat == pytest.approx(expected(k, i + 1, end), abs=1e-9)

    how = {"topic": "topic", "at": "ts", "weight": "w"}
    check(state.heat(df.repartition(2), **how).collect())
    frames = [df.filter((F.col("ts") >= F.lit(at(a * 360000))) & (F.col("ts") < F.lit(at((a + 1) * 360000)))) for a in range(4)]
    check(streamed(spark, frames, lambda s: state.heat(s, stream=True, **how), tmp_path, "heated_hours").collect())
    # The operator over the table, at one time.
    end = at(200 * 3600)
    assert {x.topic: round(x.heat, 9) for x in rank.topic_heat(df, F.lit(end), topic="topic", weight="w", at="ts").collect()} == {k: round(sum((w or 0) * math.exp(-(end - t).total_seconds() / 86400) for g, t, w in rows if g == k and 0 <= (end - t).total_seconds() <= 168 * 3600), 9) for k in "ab"}


@pytest.mark.parametrize("step", [1, 24, 100, 200])
def test_heat_series_at_every_step(spark, step):
    r = random.Random(step)
    rows = [(r.choice(["a", "b"]), at(r.choice([3600 * r.randrange(0, 300), r.uniform(0, 300 * 3600)])), r.uniform(0, 2)) for _ in range(150)]
    found = {(x.topic, x.as_of.astimezone(timezone.utc)): x.heat for x in state.heat_series(spark.createDataFrame(rows, "topic string, ts timestamp, w double"), topic="topic", at="ts", weight="w", step_hours=step).collect()}
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    first = int((START - epoch).total_seconds() // 3600 // step)
    for k in range(first, first + 500 // step + 2):
        end = epoch + timedelta(hours=k * step)
        for topic in "ab":
            warm = [w * math.exp(-(end - t).total_seconds() / 86400) for g, t, w in rows if g == topic and 0 <= (end - t).total_seconds() <= 168 * 3600]
            assert (found.pop((topic, end), None) or 0) == pytest.approx(sum(warm), abs=1e-9)
    assert not found


def plain_gate(events):
    """Debounce, cooldown and content of one path: (second, hash) in order."""
    out, taken, known = [], None, None
    for i, (t, h) in enumerate(events):
        if i + 1 < len(events) and events[i + 1][0] - t < 3:
            continue
        fire = t + 3
        if taken is not None and fire - taken < 30:
            out.append((fire, h, "cooldown"))
        elif known == h:
            out.append((fire, h, "unchanged"))
        else:
            out.append((fire, h, "ingest"))
            taken, known = fire, h
    return out


def test_file_gate_over_table_and_stream(spark, tmp_path):
    r = random.Random(5)
    paths, rows = {}, []
    for p in ("p", "q"):
        t, paths[p] = 0, []
        for _ in range(40):
            t += r.choice([1, 2, 3, 5, 20, 40])
            paths[p].append((t, r.choice("xyz")))
        rows += [(p, at(t), h) for t, h in paths[p]]
    schema = "path string, at timestamp, hash string"
    seen = lambda found: {p: [((x["at"].astimezone(timezone.utc) - START).total_seconds(), x.hash, x.decision) for x in sorted(found, key=lambda x: x["at"]) if x.key == p] for p in paths}
    expected = {p: plain_gate(e) for p, e in paths.items()}
    assert seen(state.file_gate(spark.createDataFrame(rows, schema).repartition(2)).collect()) == expected
    rows.sort(key=lambda x: x[1])
    frames = [spark.createDataFrame(rows[i : i + 20], schema) for i in range(0, len(rows), 20)] + [spark.createDataFrame([("last", at(9000 * k), "z")], schema) for k in (1, 2, 3)]
    assert seen(streamed(spark, frames, state.ingest_stream, tmp_path, "gated").collect()) == expected


def test_watched_files(spark, tmp_path):
    folder = tmp_path / "files"
    for name, text in {"a.md": "hello", "B.TXT": "x", "c.tmp": "no", "d.py": "no", "e.json": "  \n", "f.txt": "", "node_modules/g.md": "no", "sub/h.md": "yes", "big.md": "x" * 100}.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    stream = state.watch(spark, f"file://{folder}", exclude=["node_modules"], most_bytes=50)
    found = streams.run_available(stream.select("path", "text"), "watched", f"{tmp_path}/c").collect()
    assert {(x.path.rsplit("files/")[1], x.text) for x in found} == {("a.md", "hello"), ("B.TXT", "x"), ("sub/h.md", "yes")}
