"""Tables and criteria of pages that are not well formed."""

import time

import pytest

from creditlake.sources.html import HEADING, _Page

TABLE = "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"
CELLS = [["a", "b"], ["c", "d"]]


def tables(html):
    return _Page().feed_whole(html).tables_behind(HEADING)


def test_headings_that_are_split_or_far_away():
    assert tables(f"<p><span>Key Financial Indic</span><span>ators</span></p>{TABLE}") == [CELLS]
    assert tables(f"<p>Key <b>Financial</b>\n Indicators</p><p>{'word ' * 300}</p>{TABLE}") == [CELLS]
    assert tables(f"<div><p>Other</p>{TABLE}<p>KeyFinancialIndicators</p><table><tr><td>z</table></div>") == [[["z"]], CELLS]
    assert tables(f"<p>Key indicators</p>{TABLE}") == [] and tables(f"{TABLE}<p>Key financial indicators</p>") == []
    assert tables(None) == tables("") == tables("<td>x</tr></table>") == []


def test_stray_and_missing_end_tags():
    head = "<p>Key financial indicators</p>"
    assert tables(head + "<table><tr><td>a</b></td><td>b</i></td></tr></p><tr><td>c</td><td>d</td></tr></table>") == [CELLS]
    assert tables(head + "<table><tr><td>a<td>b<tr><td>c<td>d</table>x") == [CELLS]
    assert tables(head + "<table><tr><td>a<td>b<tr><td>c<td>d") == [CELLS]
    assert tables("<b>Key financial indicators<table><tr><td>a</b><td>b<tr><th>c<th>d</table>") == [CELLS]
    assert tables(head + "<table><tr><td>a <table><tr><td>x</table><td>b</table>") == [[["a x", "x", "b"], ["x"]]]


def test_criteria_split_over_pieces():
    page = _Page().feed_whole("<ul><li>CRITERIA <i>for</i> rating hotels<li>other</ul><script>criteria for banks</script>")
    assert "criteria for rating hotels" in page.naming("criteria for") and "banks" not in page.naming("criteria for")


def _timed(work):
    began = time.process_time()
    work()
    return time.process_time() - began


def least(work):
    """Seconds of the fastest of three runs, as other work on the machine slows some."""
    return min(_timed(work) for _ in range(3))


def test_work_is_linear_in_the_page():
    def took(n):
        return least(lambda: tables("<div>" * 50 + f"<p>Key financial indicators</p>{TABLE}" * n))

    took(200)
    assert took(4000) < 6 * max(0.05, took(1000))


def test_implied_end_tags():
    page = _Page().feed_whole("<p>criteria for banks<p>hotels<ul><li>criteria for cement<li>textile</ul><div>x<p>criteria for power<div>real estate</div></div>")
    assert page.naming("criteria for") == "criteria for banks criteria for cement criteria for power"
    head = "<p>Key financial indicators"
    assert tables(head + "<table><thead><tr><td>a<td>b<tbody><tr><td>c<td>d</table>") == [CELLS]
    assert tables(head + "<table><tr><td><p>a<p><ul><li>x<li>y</ul><td>b</table>") == [[["a x y", "b"]]]
    assert tables(head + "<hr>" + TABLE) == [CELLS]
    nested = _Page().feed_whole("<td>criteria for <a>hotels</a> <a>criteria for power</a></td><p>criteria for steel</p>")
    assert nested.naming("criteria for") == "criteria for hotels criteria for power criteria for steel"


@pytest.mark.parametrize("page", ["<p>x<tr><td>a", "<p>Key financial indicators<table><tr><td>a<td>b</table>", "<li>criteria for x", "<div>criteria for <b>banks", "<td>criteria for<p>x", "<ul><li><p>a<table></table>", "<a>criteria for hotels <td>"])
def test_work_is_linear_in_elements_that_are_never_closed(page):
    def read(n):
        whole = _Page().feed_whole(page * n)
        whole.tables_behind(HEADING), whole.naming("criteria for")

    def took(n):
        return least(lambda: read(n))

    took(100)
    assert took(8000) < 8 * max(0.04, took(2000))  # 16 times if it went with the square
