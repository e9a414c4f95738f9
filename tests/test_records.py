"""Orphan references and incremental runs: edge cases, failures, hot keys."""

import datetime as dt
import os
import random
import uuid

import pytest

from inkgrove.functions.paths import display_path, hash_key, path_key
from inkgrove.operators import merkle, orphans
from inkgrove.runtime import checkpoint_root

T0 = dt.datetime(2024, 3, 1)
NOTES = "id bigint, rel_path string, content_hash string, indexed_at timestamp, deleted_at timestamp, period string"
CHUNKS = "id bigint, rel_path string, indexed_at timestamp, key string"
LINT = "id bigint, kind string, rel_path string, detail string, reported_at timestamp"


def day(n):
    return T0 + dt.timedelta(days=n)


def test_path_and_hash_spellings(spark):
    rows = spark.createDataFrame([(" ./A\\Café.md ", "SHA256:AB"), ("a/Café.MD", "ab"), (None, None), ("", " ")], "p string, h string")
    from pyspark.sql import functions as F

    got = rows.select(path_key(F.col("p")), display_path(F.col("p")), hash_key(F.col("h"))).collect()
    assert got[0][0] == got[1][0] == "a/café.md" and got[0][1] == "A/Café.md" and got[0][2] == got[1][2] == "ab"
    assert tuple(got[2]) == (None, None, None) and got[3][0] == "" and got[3][2] is None


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(
        [
            (1, "a/one.md", "h1", day(0), None, "x"), (2, "A/ONE.md", "h2", day(5), day(6), "x"), (3, "b/two.md", "h3", day(1), day(2), "x"),
            (4, "b\\two.md", "h4", day(9), None, "x"), (5, "c/été.md", "h5", day(1), None, "x"), (6, None, "h6", day(1), None, "x"), (7, "late.md", "h7", day(300), None, "x"),
        ], NOTES,
    )


def test_orphans(spark, notes):
    chunks = spark.createDataFrame([(10, "a/one.md", day(40), "z"), (11, "./b/TWO.md", day(40), "z"), (12, "c/été.md", day(1), "z"), (13, None, day(1), "z"), (14, "late.md", day(1), "z"), (15, "", day(1), "z"), (16, "nowhere.md", None, "z")], CHUNKS)
    lint = spark.createDataFrame([(20, "broken", "a/one.md", "two", day(1)), (21, "broken", "b/two.md", "wo.md", day(1)), (22, "broken", "b/two.md", "pic.PNG", day(1)), (23, "orphan", "b/two.md", "gone", day(1)), (24, "broken", "b/two.md", None, day(1)), (25, "broken", "b/two.md", "b/two", day(1)), (26, "broken", "b/two.md", "minutes.notes", day(1))], LINT)
    parents, refs = orphans.parent_keys(notes), orphans.note_references(chunks, lint)
    got = {tuple(r) for r in orphans.orphan_rows(parents, refs).collect()}
    assert got == {("chunks", "rel_path", 10, "2024-04"), ("chunks", "rel_path", 16, None), ("lint_report", "rel_path", 20, "2024-03"), ("lint_report", "detail", 21, "2024-03"), ("lint_report", "detail", 26, "2024-03")}
    report = {(r.src_table, r.src_field, r.period): (r.n_refs, r.n_keys) for r in orphans.orphan_report(parents, refs).collect()}
    assert report[("chunks", "rel_path", "2024-04")] == (1, 1) and sum(n for n, _ in report.values()) == 5


def test_orphans_of_empty_tables_and_hot_keys(spark, notes):
    chunks = spark.createDataFrame([(n, "hot.md", day(1), "z") for n in range(3000)] + [(9000, "a/one.md", day(1), "z")] * 2, CHUNKS)
    lint = spark.createDataFrame([], LINT)
    refs = orphans.note_references(chunks, lint)
    assert orphans.orphan_rows(orphans.parent_keys(notes), refs).count() == 3002
    assert orphans.orphan_rows(orphans.parent_keys(notes), refs, rows=500).count() == 3002
    assert orphans.orphan_rows(orphans.parent_keys(notes.limit(0)), refs).count() == 3002
    assert orphans.orphan_rows(orphans.parent_keys(notes), refs.limit(0)).count() == 0


SCAN = "run_id bigint, rel_path string, mtime double, content_hash string, size_bytes bigint, seen_at timestamp, leaf string"
RUNS = "run_id bigint, outcome string"


def changed(spark, notes, scan, runs, per_leaf=1, **k):
    rows = merkle.changed_notes(notes, spark.createDataFrame(scan, SCAN), spark.createDataFrame(runs, RUNS), bits=2, per_leaf=per_leaf, **k).collect()
    return {(r.run_id, r.rel_path) for r in rows}


def test_runs(spark, notes):
    def s(run, path, h, sec=0):
        return (run, path, 1.0, h, 1, day(10) + dt.timedelta(days=run, seconds=sec), "x")

    scan = [
        s(1, "b/two.md", "SHA256:H4"), s(1, "c/été.md", "new"), s(1, "unknown.md", None), s(1, "Fresh.md", "f1"), s(1, "Fresh.md", "f0", -5),
        s(2, "b/two.md", "changed"), s(2, "c/été.md", "new"),
        s(3, "b/two.md", "changed"), s(3, "./fresh.md ", None), s(3, None, "x"),
        s(4, "b/two.md", None), s(4, "unknown.md", "u"), s(4, "late.md", "H7"), s(4, "late.md", "h8", 900),
        s(9, "never.md", "n"),
    ]
    runs = [(1, "ok"), (2, "failed"), (3, "ok"), (4, None), (5, "locked")]
    assert changed(spark, notes, scan, runs) == {(1, "c/été.md"), (1, "Fresh.md"), (3, "b/two.md"), (4, "unknown.md"), (4, "late.md")}
    assert changed(spark, notes.limit(0), scan, runs) == {(1, "b/two.md"), (1, "c/été.md"), (1, "Fresh.md"), (3, "b/two.md"), (4, "unknown.md"), (4, "late.md")}
    assert changed(spark, notes, scan, [(2, "failed")]) == set()
    assert changed(spark, notes, [], runs) == set()


def test_runs_against_a_plain_replay(spark):
    """Random histories with unreadable files, failed and open runs, in one call and run by run."""
    rng = random.Random(5)
    for trial in range(1):
        known = {f"p{n}.md": f"h{n}" for n in range(40)}
        notes = spark.createDataFrame([(n, p, h, day(0), None, "x") for n, (p, h) in enumerate(known.items())], NOTES)
        scan, runs, want = [], [], set()
        for run in range(1, 7):
            seen = {f"p{n}.md": rng.choice([None, f"h{n}", f"h{n}", f"h{n}", f"g{rng.randrange(3)}"]) for n in range(48) if rng.random() < 0.8}
            scan += [(run, p, 1.0, h, 1, day(run), "x") for p, h in seen.items()]
            outcome = rng.choice(["ok", "ok", "failed", None])
            runs.append((run, outcome))
            if outcome != "failed":
                want |= {(run, p) for p, h in seen.items() if h is not None and known.get(p) != h}
            if outcome == "ok":
                known = {p: h or known[p] for p, h in seen.items() if h or p in known}
        assert changed(spark, notes, scan, runs, per_leaf=3) == want
        base = f"{checkpoint_root(spark)}/replay-{trial}-{uuid.uuid4().hex}"
        for upto in (3, 6):
            assert changed(spark, notes, scan, runs[:upto], per_leaf=2, base=base) == {w for w in want if w[0] <= upto}


def records(spark, pairs, run=None):
    rows = [(k, k.upper(), v) for k, v in pairs]
    return spark.createDataFrame([(run, *r) for r in rows] if run else rows, ("run string, " if run else "") + "key string, path string, content string")


def test_descent_is_narrow_and_a_published_run_is_not_repeated(spark, tmp_path):
    store = merkle.RecordStore(spark, f"file://{tmp_path}/s", bits=4, per_leaf=2)
    base = [(f"k{n}", f"v{n}") for n in range(500)]
    store.bootstrap(records(spark, base))
    store.bootstrap(records(spark, []))  # already there: nothing happens
    new = [*base[1:], ("k0", "other"), ("k900", "x")]
    out = store.advance([("v1", True)], records(spark, new, "v1"))
    assert out["leaves"] == 2 and out["compared"] < 150 and {r.key for r in store.output("v1").collect()} == {"k0", "k900"}
    assert store.advance([("v1", True)], records(spark, base, "v1")) == {"outputs": out["outputs"], "leaves": 0, "compared": 0}
    assert {r.key for r in store.output("v1").collect()} == {"k0", "k900"}
    assert store.advance([("v2", True)], records(spark, new, "v2"))["leaves"] == 0 and store.output("v2").count() == 0
    store.advance([("v3", True)], records(spark, [*new[:-1], ("k900", None)], "v3"))
    assert store.output("v3").count() == 0 and store.records().where("key = 'k900'").first().content == "x"
    assert sum(r.content is not None for r in store.records().collect()) == 501 == store.state()["n"]


def test_segments_are_few_and_old_ones_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "SEGMENTS", 3)
    store = merkle.RecordStore(spark, f"file://{tmp_path}/s", bits=2, per_leaf=4)
    rows = {f"k{n}": "0" for n in range(60)}
    store.bootstrap(records(spark, rows.items()))
    for v in range(1, 6):
        rows[f"k{v}"] = str(v)
        rows.pop(f"k{v + 20}")
        store.advance([(f"v{v}", True)], records(spark, rows.items(), f"v{v}"))
        state = store.state()
        assert len(state["segments"]) <= 4 and {(r.key, r.content) for r in store.records().collect()} == set(rows.items())
        assert {n for n in os.listdir(tmp_path / "s") if os.path.isdir(tmp_path / "s" / n / "records")} == set(state["segments"])
    assert {r.run: r.key for r in store.output(*[f"v{v}" for v in range(1, 6)]).collect()} == {f"v{v}": f"k{v}" for v in range(1, 6)}


@pytest.mark.parametrize("dies_at", ["output", "records", "tree", "pointer"])
def test_a_pass_that_dies_changes_nothing_and_can_be_repeated(spark, tmp_path, dies_at):
    class Dying(merkle.RecordStore):
        armed = False

        def _write(self, df, folder, part, *by):
            super()._write(df, folder, part, *by)
            if self.armed and part.startswith(dies_at):
                raise OSError(part)

        def _publish(self, new, old):
            if self.armed and dies_at == "pointer":
                raise OSError("pointer")
            super()._publish(new, old)

    store = Dying(spark, f"file://{tmp_path}/s", bits=2, per_leaf=4)
    base = {f"k{n}": "0" for n in range(40)}
    store.bootstrap(records(spark, base.items()))
    before = store.state()
    store.armed = True
    seen = records(spark, (base | {"k3": "1"}).items(), "r1")
    with pytest.raises(OSError):
        store.advance([("r1", True)], seen)
    assert store.state() == before and {r.content for r in store.records().collect()} == {"0"}
    again = merkle.RecordStore(spark, store.base, bits=2, per_leaf=4)
    again.advance([("r1", True)], seen)
    assert [r.key for r in again.output("r1").collect()] == ["k3"]
    assert {n for n in os.listdir(tmp_path / "s") if n.startswith("pass-")} == {*again.state()["segments"], again.state()["folder"]}


def test_levels_below_those_the_driver_compares(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "DRIVER_LEVELS", 1)
    store = merkle.RecordStore(spark, f"file://{tmp_path}/s", bits=2, per_leaf=1)
    base = [(f"k{n}", f"v{n}") for n in range(120)]
    store.bootstrap(records(spark, base))
    seen = records(spark, [*base[2:], ("k1", "w"), ("z", "1")], "a").unionByName(records(spark, [*base[3:], ("k2", None), ("z", "2")], "b"))
    assert store.advance([("a", True), ("b", False)], seen)["leaves"] < 12
    state = store.state()
    assert state["levels"] == 4 and [r.key for r in store.output("a").orderBy("key").collect()] == ["k1", "z"] and "b" not in state["outputs"]
    grown = [(f"n{n}", "x") for n in range(2000)]
    store.advance([("c", True)], records(spark, grown, "c"))
    assert store.state()["levels"] == 6 and store.output("c").count() == 2000 and store.records().count() == 2000
