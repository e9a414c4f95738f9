"""Link resolution, hubs, lint, rewriting, snapshots on small fixtures."""

from pyspark.sql import functions as F

from inkgrove.operators import links, snapshots
from inkgrove.operators.notes import chunk_notes, extract_links, parse_notes, section_extents
from inkgrove.operators.rewrite import rewrite_text

LINK = "src_rel string, line_no int, ordinal int, embed boolean, target string, anchor string, alias string"
PATHS = ["readme.md", "a/notes.md", "b/c/notes.md", "Plans/Garden-Overview.md", "x/index.md", "lonely.md", "b/Deep.md"]


def graph(spark, rows):
    return spark.createDataFrame([(s, n, 0, False, t, None, None) for n, (s, t) in enumerate(rows, 1)], LINK), spark.createDataFrame([(p,) for p in PATHS], "rel_path string")


def test_resolution(spark):
    ls, notes = graph(spark, [("lonely.md", t) for t in ("notes", "c/notes", "B\\C\\NOTES.md", " garden-overview ", "nowhere/notes", "index", "gone", "pic.png", "Deep", "c/deep")] + [("lonely.md", None)])
    got = {r.target: (r.resolved, r.how) for r in links.resolve_targets(ls, notes).collect()}
    assert got["notes"] == ("a/notes.md", "name") and got["c/notes"] == ("b/c/notes.md", "tail") and got["B\\C\\NOTES.md"] == ("b/c/notes.md", "path")
    assert got[" garden-overview "][0] == "Plans/Garden-Overview.md" and got["Deep"][0] == "b/Deep.md" and got["index"][0] == "x/index.md"
    assert [got[t] for t in ("nowhere/notes", "gone", "pic.png", "c/deep")] == [(None, None)] * 4


def test_findings(spark):
    rows = [("readme.md", "lonely"), ("readme.md", "Deep"), ("a/notes.md", "lonely"), ("a/notes.md", "lonely"), ("lonely.md", "lonely"), ("b/Deep.md", "garden-overview"), ("unknown.md", "index"), ("a/notes.md", "gone"), ("a/notes.md", "pic.png"), ("a/notes.md", "doc.pdf")]
    ls, notes = graph(spark, rows)
    files = spark.createDataFrame([("pic.png",)], "name_lower string")
    assert {tuple(r) for r in links.broken_links(ls, notes, files).collect()} == {("a/notes.md", "gone"), ("a/notes.md", "doc.pdf")}
    assert {r.rel_path: r.n for r in links.inbound(ls, notes).collect()} == {"lonely.md": 2, "b/Deep.md": 1, "Plans/Garden-Overview.md": 1, "x/index.md": 1}
    assert {r.rel_path for r in links.orphan_notes(ls, notes).collect()} == {"a/notes.md", "b/c/notes.md"}
    assert {r.rel_path for r in links.content_map(ls, notes).collect()} == {"lonely.md", "b/Deep.md"}
    assert {r.rel_path for r in links.without_hub(ls, notes).collect()} == {"b/c/notes.md"}
    assert {tuple(r) for r in links.backlinks(ls, notes).collect()} == {("lonely.md", "readme.md", 1), ("b/Deep.md", "readme.md", 2), ("lonely.md", "a/notes.md", 3), ("lonely.md", "a/notes.md", 4), ("Plans/Garden-Overview.md", "b/Deep.md", 6)}
    status = spark.createDataFrame([("a", "Draft "), ("b", "odd"), ("c", ""), ("d", None)], "rel_path string, status string")
    assert [r.rel_path for r in links.bad_status(status).collect()] == ["b"]
    assert links.lint(ls.limit(0), notes.withColumn("status", F.lit("odd"))).groupBy("kind").count().count() == 3


def test_rewriting_keeps_code_and_line_ends():
    text = "[[old|a]] ![[old#h]] `[[old]]` [[x/old]]\r\n```\n[[old]]\n```\n[[other]]"
    new, n = rewrite_text(text, {"old", "x/old"}, "y/new.md", True)
    assert n == 3 and new == "[[new|a]] ![[new#h]] `[[old]]` [[y/new]]\r\n```\n[[old]]\n```\n[[other]]"
    assert rewrite_text("[[old]]", {"old"}, "y/new.md", False)[0] == "[[y/new]]"


def test_note_operators_on_odd_rows(spark):
    df = spark.createDataFrame([("a.md", "# T\n[[x]] and [[y]] [[x]]\n## Cellar\nz"), ("b.md", None), ("c.md", ""), (None, "text [[q]]")], "rel_path string, text string")
    assert {r.key: r.title for r in parse_notes(df).collect()} == {"a.md": "T", "c.md": "c", None: ""}
    assert [(r.line_no, r.ordinal, r.target) for r in extract_links(df).where("key = 'a.md'").collect()] == [(2, 0, "x"), (2, 1, "y"), (2, 2, "x")]
    assert chunk_notes(df.limit(0)).count() == 0 and section_extents(df, "## cellar").first()[1:] == (3, 4)


def test_snapshots(spark):
    a = spark.createDataFrame([("same", "h", 1.0), ("touched", "h", 2.0), ("new", "h", 1.0), ("unread", None, None), ("edited", "h2", 1.0)], "rel_path string, content_hash string, mtime double")
    b = spark.createDataFrame([("same", "h", 1.0004), ("touched", "h", 1.0), ("gone", "h", 1.0), ("unread", "h", 1.0), ("edited", "h", 1.0)], "rel_path string, content_hash string, mtime double")
    assert {tuple(r) for r in snapshots.change_kinds(a, b).collect()} == {("same", "unchanged"), ("touched", "changed"), ("new", "new"), ("gone", "deleted"), ("unread", "unchanged"), ("edited", "changed")}
    assert {r.change for r in snapshots.change_kinds(a, b, True).where("rel_path = 'same'").collect()} == {"changed"}
    assert {tuple(r) for r in snapshots.freshness(a, b).collect()} == {("touched", "pending"), ("new", "pending"), ("gone", "deleted"), ("unread", "pending")}
    assert [r.rel_path for r in snapshots.deleted(a, b).collect()] == ["gone"]
    assert sorted(r.rel_path for r in snapshots.merge(b, a.limit(0), b.where("rel_path = 'gone'")).collect()) == ["edited", "same", "touched", "unread"]
