"""Cells over several columns and rows against a plain map of columns, in time linear in the page; hiding by style sheets."""

import random
import time

import pytest

from lodegraph.llm import html_text


def plain_places(rows):
    """(first column, columns) of each row's cells (colspan, rowspan): a map of all covered columns, copied for each row."""
    taken, out = {}, []
    for cells in rows:
        at, below, found = 0, {}, []
        for columns, tall in cells:
            while at in taken:
                at += 1
            tall = tall or html_text.MOST_ROWS
            if tall > 1:
                below |= dict.fromkeys(range(at, at + columns), tall)
            found.append((at, columns))
            at += columns
        taken = {c: n - 1 for c, n in {**taken, **below}.items() if n > 1}
        out.append(found)
    return out


@pytest.mark.parametrize("seed", range(300))
def test_covered_columns_against_a_plain_map(seed):
    rng = random.Random(seed)
    rows = [[(rng.choice([1, 1, 2, 3, 7]), rng.choice([1, 1, 2, 3, 5, 0] if seed % 3 else [1, 2])) for _ in range(rng.randint(0, 6))] for _ in range(rng.randint(1, 14))]
    page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={c} rowspan={r}>x" for c, r in cells) for cells in rows) + "</table>"
    table = html_text.tree(page).children[0]
    assert [[(at, n) for at, n, _ in cells] for cells in html_text._cells(table, True)] == plain_places(rows)


def half(cells, rows, size=500_000):
    return "<table><tr>" + cells * (size // len(cells)) + rows * (size // len(rows)) + "</table>"


@pytest.mark.parametrize(
    "page",
    [
        half("<td colspan=1000 rowspan=0>", "<tr><td>x"),
        half("<td rowspan=0>", "<tr><td>x"),
        "<table><tr>" + "".join(f"<td colspan=9 rowspan={i}>" for i in range(2, 15_000)) + "<tr><td>x" * 50_000 + "</table>",
        "<table>" + "<tr><td colspan=3 rowspan=2>a<td>b" * 30_000 + "</table>",
        "<table><tr>" + "<td>c" * 1000 + "<tr><td colspan=1000>some more text than nothing" * 25_000 + "</table>",
        "<style>" + "".join(f".a.b{i}{{display:none}}" for i in range(25_000)) + "</style>" + '<p class="a">x' * 35_000,
    ],
)
def test_tables_of_a_megabyte_in_linear_time(page):
    began = time.process_time()
    html_text.page_text(page[:1_000_000])
    assert time.process_time() - began < 8


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<style>.h{display:none}</style><p>a<p class='x h'>b<p>c", "a\n\nc"),
        ("<style>.h{display:none} #i{display:block}</style><p class=h id=i>b", "b"),
        ("<style>p{visibility:hidden} .v{visibility:visible}</style><p>a <b class=v>b</b><div>c</div>", "b\n\nc"),
        ("<style>.h{display:none}</style><p class=h style='display:block'>b", "b"),
        ("<style>p.h, div.k { display : none !important }</style><p class=h>a<div class=h>b</div><div class=k>c</div>", "b"),
        ("<style>.h{display:none} .h{display:block}</style><p class=h>b", "b"),
        ("<style>@media print{.h{display:none}} @import 'x'; .k{display:none}</style><p class=h>a</p><p class=k>b", "a"),
        ("<style>div .h{display:none} .h:hover{display:none}</style><div><p class=h>a", "a"),
        ("<style>/* .h{display:none} */</style><p class=h>a", "a"),
        ("<details><summary>more</summary>inner<p>text</details>after", "more\nafter"),
        ("<details open><summary>more</summary>inner</details>after", "more\ninner\nafter"),
        ("<details>inner</details>after", "after"),
        ("a<dialog>b</dialog><dialog open>c</dialog>", "a\nc"),
    ],
)
def test_hiding_by_style_sheets_details_and_dialogs(page, text):
    assert html_text.page_text(page) == text
