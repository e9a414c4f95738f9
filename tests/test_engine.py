"""End to end over a small folder: index, search, read, links, changes, lint, status."""

import json
import os

import pytest

from inkgrove import editing
from inkgrove.config import EngineConfig
from inkgrove.engine import Engine, NoteError
from inkgrove.indexing import single_writer
from inkgrove.sources import vault

FILES = {
    "README.md": "# Hub\n\n[[homeserver-setup]] and [[garden-overview]]\n",
    "server/homeserver-setup.md": "---\ntags: [infra, home]\nstatus: verified\n---\n# Home server\n\nSee [[README]].\n\n## Proxmox\n\nThe hypervisor runs on the old tower and keeps two disks.\n\n## Backup\n\nNightly vzdump, then rclone to the cold store.\n",
    "projects/garden/garden-overview.md": "---\nstatus: draft\n---\n# Garden\n\n[[README]]\n\n## Strategy\n\nTomatoes first, then beans along the fence of the orchard.\n",
    "projects/garden/notes.md": "# Garden notes\n\nRisk: frost in May. See [[garden-overview#Strategy|plan]] and `[[README]]`.\n",
    "other/notes.md": "# Other\n\n[[README]] tomatoes in pots need more water than beans.\n",
    "_under.md": "# Underscore\n\nA name that begins with an underscore is a note, [[missing-note]] ![[pic.png]] ![[gone.png]].\n",
    ".hidden/secret.md": "# Secret\n",
    "pic.png": "x",
}


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    root = tmp_path_factory.mktemp("notes")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def engine(spark, place, tmp_path_factory):
    e = Engine(spark, place, tmp_path_factory.mktemp("index"))
    assert e.build()["indexed"] == 6
    return e


def test_scan_order_and_golden(spark, place, tmp_path):
    assert list(vault.walk_notes(place)) == ["README.md", "_under.md", "other/notes.md", "projects/garden/garden-overview.md", "projects/garden/notes.md", "server/homeserver-setup.md"]
    (tmp_path / "g.json").write_text(json.dumps([{"query": "q", "expected": ["a"]}]))
    assert vault.read_golden(spark, tmp_path / "g.json").count() == 1
    (tmp_path / "g.json").write_text(json.dumps([{"query": "q", "expected": []}]))
    with pytest.raises(ValueError):
        vault.read_golden(spark, tmp_path / "g.json")


def test_tables_agree(engine):
    n = {t: engine.index.table(t).count() for t in ("chunks", "vectors", "sizes")}
    assert len(set(n.values())) == 1 and n["chunks"] >= 6
    assert engine.status()["health"] == "OK"


def test_search_modes_filters_and_cache(engine):
    out = engine.search("vzdump backup", mode="keyword")
    assert out.hits[0].rel_path == "server/homeserver-setup.md" and out.hits[0].heading == "Backup"
    assert engine.search("vzdump backup", mode="keyword") is out
    assert engine.search("tomatoes beans").hits
    assert {h.rel_path for h in engine.search("tomatoes", folder="projects").hits} <= {"projects/garden/garden-overview.md", "projects/garden/notes.md"}
    assert {h.rel_path for h in engine.search("the", tags="infra", status="verified").hits} == {"server/homeserver-setup.md"}
    assert engine.search("zzzz", mode="keyword").hits == [] and "nothing matches" in engine.search("zzzz", mode="keyword").text("zzzz")


def test_degraded_models_and_floor(spark, place, engine):
    def broken(*_):
        raise RuntimeError("no model")

    e = Engine(spark, place, engine.index.folder, embed=broken)
    out = e.search("vzdump")
    assert out.hits and "unavailable" in out.warnings[0] and not e._cache
    seen = []
    e = Engine(spark, place, engine.index.folder, EngineConfig(min_score=0.0), rerank=lambda q, docs: seen.append(docs) or [-8.0] * len(docs))
    out = e.search("tomatoes")
    assert not out.hits and out.best_rejected == -8.0 and all(len(d) < 700 for d in seen[0])
    e = Engine(spark, place, engine.index.folder, rerank=broken)
    assert e.search("tomatoes").hits and e.errors["reranker"]


def test_evaluate(engine):
    rows = engine.evaluate([{"query": "vzdump rclone", "expected": ["homeserver-setup"]}, {"query": "frost", "expected": ["nowhere"]}], modes=("keyword",)).collect()
    assert rows[0].hit_at_k == 0.5 and rows[0].mrr == 0.5 and rows[0].p95_ms > 0


def test_read_list_backlinks_recent(engine):
    p = engine.read("homeserver-setup", heading="Backup")
    assert p.text.startswith("## Backup") and p.total_lines == 15 and len(p.sha) == 16
    with pytest.raises(NoteError, match="Proxmox"):
        engine.read("homeserver-setup", heading="nope")
    with pytest.raises(NoteError, match="ambiguous"):
        engine.read("notes")
    with pytest.raises(NoteError, match="outside"):
        engine.read("../etc")
    with pytest.raises(NoteError, match="hidden"):
        engine.read(".hidden/secret")
    total, shown = engine.list("projects", 1)
    assert total == 2 and shown == [("projects/garden/garden-overview.md", "Garden")]
    assert [(r, n) for r, n, _ in engine.backlinks("garden-overview")] == [("README.md", 3), ("projects/garden/notes.md", 3)]
    assert len(engine.recent(3)) == 3


def test_lint(engine):
    f = {(r.kind, r.rel_path, r.detail) for r in engine.lint().collect()}
    assert ("broken", "_under.md", "missing-note") in f and ("broken", "_under.md", "gone.png") in f and ("broken", "_under.md", "pic.png") not in f
    assert ("orphan", "other/notes.md", None) in f and ("no_hub", "_under.md", None) in f and ("no_frontmatter", "README.md", None) in f
    assert {r.rel_path.split("/")[0] for r in engine.lint("projects").collect()} == {"projects"}


def test_a_change_is_indexed_in_the_background(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n/README.md").write_text("# Hub\n\nA first note about lanterns and their wicks.\n")
    e = Engine(spark, tmp_path / "n", tmp_path / "ix")
    e.write("early", "not yet: there is no index to keep up to date")
    assert e.settle() and not (tmp_path / "ix/DIRTY").exists()
    assert e.build()["indexed"] == 2
    e.write("late", "a note on zeppelins and their moorings, long enough to be a chunk")
    assert e.settle(120) and not (e.index.folder / "DIRTY").exists() and not e.errors
    assert e.search("zeppelins", mode="keyword").hits[0].rel_path == "late.md" and e.status()["health"] == "OK"
    assert len(list((tmp_path / "ix").glob("v-*"))) <= 2


def test_changes_and_reindexing(spark, place, tmp_path):
    e = Engine(spark, place, tmp_path / "ix", reindex=False)
    assert e.build()["indexed"] == 6 and e.build()["unchanged"] == 6
    assert "no wikilinks" in e.write("inbox/new", "fresh pumpkin text that is long enough", tags="a, #b")
    text = (place / "inbox/new.md").read_text()
    assert text.startswith("---\ntitle: \"new\"\ntags: [a, b]\n")
    with pytest.raises(NoteError, match="exists"):
        e.write("inbox/new", "x")
    with pytest.raises(NoteError, match="changed"):
        e.append("inbox/new", "x", expected_hash="0" * 16)
    assert e.status()["health"] == "STALE"
    assert e.index.build_until_clean(place)["indexed"] == 1 and not (e.index.folder / "DIRTY").exists()
    assert e.search("pumpkin", mode="keyword").hits[0].rel_path == "inbox/new.md"
    assert "fine" in e.append("inbox/new", "more [[README]]")
    assert e.edit("inbox/new", "pumpkin", "squash", expected_hash=editing.digest(place / "inbox/new.md")[:16])[0] == 1
    assert e.write("inbox/new", "---\ntitle: z\n---\nbody", overwrite=True) and list((place / ".trash").rglob("new.*.md"))
    done = e.move("garden-overview", "plans/garden-plan.md")
    assert done == {"links": 2, "notes": 2, "failed": []}
    assert "[[garden-plan#Strategy|plan]]" in (place / "projects/garden/notes.md").read_text()
    os.remove(place / "inbox/new.md")
    stats = e.build()
    assert stats["deleted"] == 2 and e.index.table("chunks").where("rel_path = 'inbox/new.md'").count() == 0
    assert e.search("squash", mode="keyword").hits == []
    e.move("garden-plan", "projects/garden/garden-overview.md")


def test_lock_and_reconfiguration(spark, place, tmp_path):
    e = Engine(spark, place, tmp_path / "ix")
    with single_writer(e.index.folder) as mine:
        assert mine and e.build() == {"locked": True}
    e.build()
    other = Engine(spark, place, e.index.folder, EngineConfig(chunk_limit=900))
    s = other.build()
    assert s["unchanged"] == 0 and s["indexed"] == 6
    (place / vault.IGNORE_FILE).write_text("# comment\nother/\n*under.md\n")
    s = other.build()
    assert s["skipped"] == 2
    (place / vault.IGNORE_FILE).unlink()


def test_missing_index(spark, place, tmp_path):
    e = Engine(spark, place, tmp_path / "none")
    assert e.status() == {"health": "MISSING"}
    with pytest.raises(FileNotFoundError):
        e.search("x")


def test_editing_rules():
    crlf = "---\r\ntitle: x\r\n---\r\nline one\r\nline two\r\n"
    text, n = editing.replace_text(crlf, "line one\nline", "1\n2")
    assert n == 1 and "1\r\n2 two\r\n" in text
    assert editing.stamp_updated(crlf, "now").split("\n")[2] == 'updated: "now"\r'
    with pytest.raises(NoteError, match="2 times"):
        editing.replace_text("a a", "a", "b")
    assert editing.replace_text("a a", "a", "b", True) == ("b b", 2)
    assert editing.append_text("# A\nx\n\n# B\ny\n", "new", "A") == "# A\nx\n\nnew\n\n# B\ny\n"
    assert editing.append_text("x\n", "new", "C") == "x\n\n## C\n\nnew\n"
    assert editing.append_text("```\n# A\n```\n", "new", "A").endswith("## A\n\nnew\n")
    assert editing.hash_matches("ABCDEF0123", "abcdef01") and not editing.hash_matches("abcdef0123", "abc")
