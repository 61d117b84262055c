"""Frames of whole pages, other languages, containers, and pages without their article tags."""

import re

import pytest
from docketry.llm.htmlmain import _Block, _Marks, main_text

PARA = (
    "The quick brown fox was on the hill and it ran to the river for a drink of water, but the water was cold and it had to go back to the den with the others "
    "and wait there until the sun was up again in the sky."
)


@pytest.mark.parametrize("frame", ['div class="layout-with-sidebar"', 'div class="content sidebar-right"', 'div class="content-sidebar-wrap"', 'article class="post comments-open"', 'article class="post tag-social category-advertising"', 'div id="ad-blocker-guide"', 'div class="comment-free"', 'form id="aspnetForm"'])
def test_frames_of_whole_pages(frame):
    whole = f"<{frame}><p>{PARA}</p></{frame.split()[0]}>"
    assert main_text(whole) == PARA
    assert main_text(f'<html><body><nav><a href="/">Home</a></nav>{whole}<footer>Imprint and terms</footer></body></html>') == PARA


def test_marks_that_hold_less_stay_out():
    for mark in ("ad", "sidebar", "comments", "cookie-notice"):
        assert main_text(f'<div><h1>Head</h1><p>{PARA}</p></div><div class="{mark}"><p>{PARA}</p></div>') == f"Head\n\n{PARA}"
        # a frame of all, and in it what is none
        assert main_text(f'<div class="layout-with-sidebar"><div><p>{PARA} {PARA}</p></div><div class="{mark}"><p>{PARA}</p></div></div>') == f"{PARA} {PARA}"
    assert main_text('<article><h1>Short</h1><p>Just a note.</p></article><div class="ad"><p>' + PARA + "</p></div>") == "Short\n\nJust a note."
    assert main_text(f'<p>Two words.</p><div class="comments"><p>{PARA}</p></div>') == "Two words."


def test_marked_elements_by_plain_sums():
    """``lifted`` against sums over each element's own blocks."""
    import random

    rng = random.Random(3)
    for _ in range(200):
        marks, n = _Marks(), rng.randint(1, 6)
        for k in range(n):
            marks.add(rng.randint(-1, k - 1), {"comments"} if rng.random() < 0.3 else {"ad"})
        made = []
        for _ in range(rng.randint(0, 8)):
            b = _Block(False, rng.random() < 0.2, False, 0, rng.randint(-1, n - 1))
            b.size = rng.choice([5, 30, 60, 400, 2000])
            b.linked = rng.choice([0, 0, b.size])
            made.append(b)

        def under(b, k):
            at = b.mark
            while at != k and at >= 0:
                at = marks.parent[at]
            return at == k

        counted = [b for b in made if not b.out and not b.linked]
        want = []
        for k in range(n):
            scope, own = ([b for b in counted if under(b, j)] for j in (marks.parent[k], k))
            some, long = ([sum(b.size for b in bs if b.size >= least) for bs in (own, scope)] for least in (0, 60))
            ok = some[0] == some[1] if marks.talk[k] else long[0] >= 0.9 * long[1] and some[0] >= 0.9 * some[1]
            want.append((marks.parent[k] < 0 or want[marks.parent[k]]) and long[0] > 0 and ok)
        assert marks.lifted(made) == want


def test_other_languages():
    chinese = "中文段落包含许多没有空格的文字，" * 24 + "结束。"
    russian = "Быстрая бурая лиса прыгает через ленивую собаку и бежит дальше по полю к реке где её ждут другие звери и птицы леса."
    assert main_text(f"<div><p>{chinese}</p></div>") == chinese
    assert main_text(f"<nav><a href=x>a</a></nav><div><p>{russian}</p></div>") == russian
    assert main_text("<nav><ul><li><a href=x>Home</a></li></ul></nav><p>Short note here.</p>") == "Short note here."
    assert main_text("<nav><a href=x>Home</a></nav><footer>© us</footer>") == ""


def test_pages_without_their_article_tags(spark):
    rows = [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    same = sum(main_text(h) == main_text(re.sub(r"<(/?)article\b", r"<\1div", h)) for h in rows)
    assert same >= 0.95 * len(rows)
