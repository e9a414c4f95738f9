import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkgrove.llm.split import _LINES, split_oversized, split_spans, split_text

TEXT = st.lists(st.sampled_from(["word ", "Ende. ", "\n", "\r\n", "\n\n", "# Head\n", "```\n", "x" * 37, "é", "👩‍🚀 ", "  indented ", "é"]), max_size=120).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(8, 60), st.integers(0, 7))
def test_round_trip_limit_overlap_lines(text, limit, overlap):
    spans = split_spans(text, limit, overlap)
    assert "".join(text[a:b] for a, b, _ in spans) == text
    lines = _LINES.split(text)
    for n, p in enumerate(split_text(text, limit, overlap)):
        assert len(p["chunk_text"]) <= limit and p["piece_no"] == n
        assert p["overlap_chars"] <= overlap and text[p["char_start"] - p["overlap_chars"] : p["char_end"]] == p["chunk_text"]
        if n:  # what is stated is really shared, and begins at a word where one begins in reach
            assert before["chunk_text"].endswith(p["chunk_text"][: p["overlap_chars"]]) and before["char_end"] <= p["char_start"]
            assert not text[before["char_end"] : p["char_start"]].strip() or not text.strip()
            reach = range(max(0, before["char_end"] - overlap, p["char_end"] - limit), before["char_end"])
            starts = [k for k in reach if not text[k].isspace() and (k == 0 or text[k - 1].isspace())]
            assert not starts or p["char_start"] - p["overlap_chars"] == starts[0]
        before = p
        if not text.strip():
            continue  # blanks keep their trailing breaks
        got = _LINES.split(p["chunk_text"])
        assert p["line_end"] - p["line_start"] + 1 == len(got)
        assert lines[p["line_start"] - 1].endswith(got[0]) or got[0] in lines[p["line_start"] - 1]


def test_strong_boundaries_win():
    para = "One sentence here. Another one there.\n"
    text = "\n".join([para * 3] * 4)
    assert [b for *_, b in split_spans(text, 130)][:-1] == [4, 4, 4]
    assert {x["boundary"] for x in split_text("# A\n" + "w " * 40 + "\n# B\n" + "v " * 40, 100)} == {"section"}
    assert all(b == 1 for *_, b in split_spans("aa " * 100, 31)[:-1])
    fenced = "```\n" + "code line\n\n" * 12 + "```\n\ntext after the code"
    assert max(b for *_, b in split_spans(fenced, 60)[:-1]) <= 4


def test_unbreakable_and_blank():
    assert [len(p["chunk_text"]) for p in split_text("x" * 4000, 1500, 100)] == [1400, 1500, 1300]
    assert len(split_text(" " * 3100, 1500)) == 3 and split_text("", 10) == []
    assert not any(p["chunk_text"].startswith("\u0301") for p in split_text("e\u0301" * 50, 11))
    with pytest.raises(ValueError):
        split_spans("abc", 5, 5)


def test_operator(spark):
    rows = [(1, "a " * 400, 7, "x"), (2, None, 1, "x"), (3, "short", 1, "x"), (4, "a " * 400, None, "x"), (None, "a " * 400, 1, "x"), (5, "b" * 501, 3, "x"), (1, "a " * 400, 7, "x")]
    df = spark.createDataFrame(rows, "id bigint, chunk_text string, line_start int, piece_no string")
    got = split_oversized(df, 500, 50).collect()
    assert {r.id for r in got} == {1, 4, 5} and sum(r.id == 1 and r.piece_no == 0 for r in got) == 2
    assert {r.line_start for r in got if r.id == 1} == {7} and {r.line_start for r in got if r.id == 4} == {1}
    assert split_oversized(df.limit(0), 500).count() == 0


def test_no_crumbs_where_an_even_cut_exists():
    sizes = [b - a for a, b, _ in split_spans("word " * 290, 1000)]
    assert len(sizes) == 2 and min(sizes) > 400
    paragraphs = "".join("p" * 198 + "\n\n" for _ in range(11))
    assert min(b - a for a, b, _ in split_spans(paragraphs, 1000)) >= 400
    assert all(b == 4 for *_, b in split_spans(paragraphs, 1000)[:-1])
