"""Worked cases of the plain-Python kernels."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.kernels import blocks as B
from quire.kernels import correct as C
from quire.kernels import grid as G
from quire.kernels import merge as M
from quire.kernels import order as O
from quire.kernels import pipes as P
from quire.kernels import repair as R
from quire.kernels import words as W

FIVE = [(x, 20 * r, x + 24, 20 * r + 10, f"R{r}C{c}") for r in range(4) for c, x in enumerate((10, 65, 120, 175, 230))]
ITEMS = [(x, 20 * r, x + w, 20 * r + 10, t) for r in range(8) for x, w, t in ((10, 60, f"Item{r}"), (120, 50, str(r)), (220, 50, str(10 * r)))]


def test_normalize_and_tokens():
    assert W.normalize("a\r\nb\r\x00c\x07d 　") == "a\nb\ncd"
    t = "東京都ABC123ひらがなカタカナ!!"
    assert [t[a:b] for a, b in W.tokens(t)] == ["東京都", "ABC", "123", "ひらがな", "カタカナ", "!!"]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_text_properties(t):
    n = W.normalize(t)
    assert W.normalize(n) == n and "".join(t[a:b] for a, b in W.tokens(t)) == "".join(t.split())
    assert 0 <= W.quality(t) <= 1 and R.close_tables(R.close_tables(t)) == R.close_tables(t)


def test_grid_of_five_columns():
    g = G.build(FIVE, 5)
    assert (g.reason, g.groups, g.collisions, g.rows[3][4]) == (None, 20, 0, "R3C4")
    g = G.build(FIVE, 2)
    assert g.collisions > 0 and all(w[4] in " ".join(sum(g.rows, [])) for w in FIVE) and " / " in g.rows[0][1]


def test_grid_failures():
    assert G.build([], 2).reason == "no_words" and G.build(FIVE, 0).reason == "invalid_column_count"
    one = [(72, 12 * r, 100, 12 * r + 10, "x") for r in range(8)]
    assert G.build(one, 2).reason and G.build(FIVE, 1).reason == "columns_not_separated" and G.build(one[:1], 3).reason == "insufficient_anchors"


def test_wide_headers_and_missing_cells():
    wide = [(10, 0, 210, 10, "head")] + [(x, 20 * r, x + 30, 20 * r + 10, t) for r in (1, 2) for x, t in ((10, "a"), (150, "b"), (310, "c"))] + [(310, 0, 340, 10, "x")]
    assert next(c for c in G.build(wide, 3).cells if c.text == "head").colspan >= 2
    gap = [(10, 0, 40, 10, "A"), (150, 0, 180, 10, "B"), (310, 0, 340, 10, "C"), (10, 20, 40, 30, "D"), (310, 20, 340, 30, "F")]
    g = G.build(gap, 3)
    assert g.rows[1] == ["D", "", "F"] and next(c for c in g.cells if c.text == "B").rowspan == 2


def test_best_page_table_and_likelihood():
    assert G.likelihood(ITEMS) >= 0.75 and G.likelihood(ITEMS[:10]) == 0.0
    g = G.best_for_page(ITEMS)
    assert g.columns == 2 and g.rows[7] == ["Item7", "7 / 70"] and g.confidence == 1.0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 100), st.sampled_from("ab cd efg".split())), min_size=1, max_size=30), st.integers(1, 5))
def test_grids_keep_every_word(rows, k):
    words = [(x, y, x + 20, y + 8, t) for x, y, t in rows]
    g = G.build(words, k)
    if g.reason is None:
        text = "".join(sum(g.rows, [])).replace(" ", "").replace("/", "")
        assert len(text) == sum(len(w[4]) for w in words) and len({(c.row, c.col) for c in g.cells}) == len(g.cells)


def test_reading_order():
    box = lambda n, x0, y0, x1, y1, o=None: (x0, y0, x1, y1, n, o)
    two = [box("R", 0.55, 0.1, 0.95, 0.9), box("L", 0.05, 0.1, 0.45, 0.9)]
    assert [r[4] for r in O.reading_order(two)] == ["L", "R"]
    head = [*two, box("H", 0.05, 0.01, 0.95, 0.06)]
    assert [r[4] for r in O.reading_order(head)] == ["H", "L", "R"]
    free = [box("A", 0.0, 0.0, 0.2, 0.2), box("B", 0.25, 0.0, 0.45, 0.2), box("C", 0.5, 0.0, 0.7, 0.2), box("D", 0.75, 0.0, 0.95, 0.2)]
    assert [r[4] for r in O.reading_order(free[::-1])] == ["A", "B", "C", "D"]
    assert [r[4] for r in O.reading_order([box("b", 0, 0, 1, 1, 2), box("a", 0, 0.5, 1, 1, 1), box("c", 0, 0, 1, 0.1)])] == ["a", "b", "c"]


def test_region_text():
    line = lambda y, t: (0, y, 40, y + 10, t, 10)
    assert O.region_text([line(12, "Line2"), line(0, "Line1")]) == "Line1 Line2"
    assert O.region_text([line(0, "hyphen-"), line(12, "ated")]) == "hyphenated"
    assert O.region_text([line(0, "one"), line(60, "two")]) == "one\ntwo" and O.region_text([]) == ""


def test_merge_policies():
    assert M.merge("誤 字", "正字")[:2] == ("正 字", 1) and M.merge("誤\n字", "正字").text == "正\n字"
    assert M.merge("A�C", "ABC").text == "ABC" and M.merge("ABC1", "ABD2").text == "ABC1"
    assert M.merge("ABCD", "ABCE").text == "ABCD" and M.merge("ABCD", "ABCE", "aggressive").text == "ABCE"
    assert M.merge("ABCD", "ABCDE", "aggressive", 0.5).text == "ABCDE"
    assert M.merge("see http://a.b/c", "see http://a.b/d", "aggressive", 1.0).text == "see http://a.b/c"
    assert M.merge("x@y.org", "z@y.org", "aggressive", 1.0).text == "x@y.org" and M.merge("", "abc").text == ""
    with pytest.raises(ValueError):
        M.policy_of("bold")


def test_several_replacements_of_other_lengths():
    assert M.merge("abc x defg", "abcd x def", "aggressive", 0.5).text == "abcd x def"


def test_table_merge():
    words = [(10, 0, 60, 10, "City"), (120, 0, 170, 10, "Pop"), (10, 20, 60, 30, "東京"), (120, 20, 170, 30, "12")]
    got = M.merge_table("| City | Pop |\n|---|---|\n| 束京 | 12 |", words)
    assert got.applied and got.changed_cells == 1 and "東京" in got.markdown
    assert M.merge_table("no table", words).reason == "no_table"
    assert M.merge_table("| City | Pop |\n|---|---|", words).reason == "row_count_mismatch"


def test_pipe_tables():
    text = "before\n| a | b |\n| :--- | ---: |\n| 1 | 2 |\n| x\\|y |\n| 1 | 2 | 3 |\nafter"
    t = P.parse(text)
    assert isinstance(t[1], P.Table) and t[1].align == ("left", "right") and t[1].rows == (("1", "2"), ("x|y", ""))
    assert len(t) == 3 and P.parse(P.render(t[:2])) == t[:2]
    assert len(P.parse("```\n| a | b |\n|---|---|\n```")) == 1
    assert P.cells(r"a \\| b") == [r"a \\", "b"] or P.cells(r"a \\| b") is not None
    with pytest.raises(ValueError):
        P.table_lines(P.Table(("a",), ("none",), (("1", "2"),)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("ab|\\ 1", max_size=6).map(lambda s: s.replace("\\", "").strip()), min_size=2, max_size=2), min_size=1, max_size=4))
def test_rendered_tables_parse_back(rows):
    table = P.Table(("h1", "h2"), ("none", "center"), tuple(map(tuple, rows)))
    assert P.parse(P.render([table])) == [table]


def test_blocks():
    got = B.page_blocks("# T\n\npara\nb\n| a | b |\n|---|---|\n| 1 |\n\n<table><tr><th rowspan=2>x</th><td>1<tr><td>2</table>\nend")
    assert [b.kind for b in got] == ["heading", "paragraph", "table", "table", "paragraph"]
    assert got[3].grid == (("x", "1"), ("", "2")) and got[3].cells[0].rowspan == 2
    assert B.page_blocks("&lt;table&gt;&lt;tr&gt;&lt;td&gt;q&lt;/td&gt;&lt;/tr&gt;&lt;/table&gt;")[0].grid == (("q",),)
    assert B.page_blocks("<table>\n<tr>\n</tr>\n</table>") == [] and B.page_blocks(None) == []
    assert len(B.page_blocks('<table><tr><td colspan="1000000">x</td></tr></table>')[0].grid[0]) == B.MOST_COLSPAN


def test_html():
    assert B.block_html(B.Block("paragraph", '<a> & "b"\nc')) == "<p>&lt;a&gt; &amp; &quot;b&quot;<br />\nc</p>"
    spans = B.page_html(1, B.page_blocks("<table><tr><td colspan=2>a</td></tr><tr><td>1</td><td>2</td></tr></table>"))
    assert '<th colspan="2">a</th>' in spans and spans.count("<td>") == 2 and "<tbody>" in spans
    assert B.block_html(B.Block("heading", "t", 9)) == "<h6>t</h6>" and "figcaption" in B.block_html(B.Block("figure", "f"))
    assert "<tbody></tbody>" in B.grid_html([["a"]], [G.Cell(0, 0, "a")]) and B.grid_html([]) == B.EMPTY_TABLE


def test_repair():
    assert R.close_tables("x <table><tr><td>1") == "x <table><tr><td>1\n</td></tr></table>"
    got = R.splice("p\n<table><tr><td>ab", "zz <table><tr><td>q</td></tr></table> <table><tr><td>abc</td></tr></table> t")
    assert got == "p\n\n<table><tr><td>abc</td></tr></table> t"
    assert R.splice("<table><tr>", "<table></table>") == "<table><tr>" and R.splice("fine", "x") == "fine"


def test_sanitize():
    got = R.sanitize("a **b**\n![x](y)\n---\n```\nNote: the image shows\n<div>q</div>\n\n\n\nz\n" + "\n".join(["r"] * 9))
    assert got == "a b\n\nq\n\nz\nr\nr"
    assert R.sanitize(None) == "" and R.sanitize("<table><tr><td>1</td></tr></table>").startswith("<table>")


def test_corrections():
    assert C.windows(["a", "b", "c"], 2) == ["a", "a b", "b", "b c", "c"]
    assert C.best_reference("連結業績の概況", ["連結業績の概要", "他の行"])[0] == "連結業績の概要"
    assert C.local_changes("連結業績の概況について述べる", "連結業績の慨況について述べる") == "連結業績の慨況について述べる"
    assert C.local_changes("abcdefgh", "abcdefgx") == "abcdefgh"
    assert C.split_contents("(1) 経営 ........ 2 (2) 財政 ........ 3").count("\n") == 1
    assert C.correct_cell("前四期発表予想比", ["x"]) == "前回発表予想比" and C.preface("a\nb\n1,234\nc") == ["a", "b"]


def test_clean_up():
    own = C.clean_up([B.Block("paragraph", "3 本文"), B.Block("paragraph", "01 | Company Overview"), B.Block("paragraph", "- 3 -"), B.Block("paragraph", "Foot")], 3, "foot")
    assert own == [B.Block("paragraph", "本文"), B.Block("heading", "01 | Company Overview", 2)]
    issue = "①課題について\n*注1\n" + "あ" * 30 + "\n本文です。\n成長、\n拡大を目指す取り組み\n最後の一行はこのように長い文になっています。"
    kinds = [b.kind for b in C.split_issue(issue)]
    assert kinds[:3] == ["heading", "paragraph", "paragraph"] and "heading" in kinds[3:]


def test_page_table_added():
    step = C.PostProcess("light")
    got = step(B.page_blocks("text\n<table><tr><td>Item0</td></tr></table>"), 1, "Item0 0 0\nx", ITEMS, 0.9)
    assert got[-1].grid[-1] == ("Item7", "7 / 70")
    assert C.PostProcess("off")(B.page_blocks("text"), 1, "other", ITEMS, 0.9) == B.page_blocks("text")


def test_forecast_head():
    grid = (("", "通期", "前期比", "前四期発表予想比", ""), ("", "", "", "増減", "増減率"), ("売上高", "1", "2", "3", "4"))
    made, cells = C.forecast_head(grid, None)
    assert made[0] == ("", "通期", "前期比", "前回発表予想比", "") and cells[3].colspan == 2
    assert C.trimmed((("a", "b", ""), ("c", "", "")), None)[0] == (("a", "b"), ("c", ""))


def test_a_faultless_grid_ends_the_search(monkeypatch):
    """No fewer columns are tried once a grid has no fault, as none could rank higher; other pages are searched whole."""
    from quire.kernels import grid

    tried = []
    monkeypatch.setattr(grid, "build", lambda words, k, *common, f=grid.build: tried.append(k) or f(words, k, *common))
    page = [(40.0 + 160 * c, 12.0 * r, 64.0 + 160 * c, 12.0 * r + 10, f"{r}{c}") for r in range(10) for c in range(5)]
    best = grid.best_for_page(page)
    assert tried == [6, 5] and best.columns == 5 and len(best.cells) == 50
    tried.clear()
    assert grid.best_for_page(page[:-1]).columns == 5 and tried == [6, 5, 4, 3, 2]
