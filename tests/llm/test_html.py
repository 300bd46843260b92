"""The style tree against plain Python, unnamed templates, and pages that would take a slow parser forever."""

from __future__ import annotations

import html
import math
import random
import time
from collections import Counter, defaultdict

import pytest

pytest.importorskip("adtflow.llm")

from adtflow.llm import html_text  # noqa: E402
from tests_llm_helpers import words  # noqa: E402


def pages(spark, htmls, host="site.example.com"):
    rows = [(i, None if host is None else f"https://{host}/{i}", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(spark, htmls, host="site.example.com"):
    return [x["text"] for x in sorted(html_text.main_texts(pages(spark, htmls, host)).collect(), key=lambda x: x["page_id"])]


def unnamed(r, n):
    """Pages of a template whose parts have no telling names: an equal bar above and below, an equal box inside, own text between."""
    own = [words(r, 40) for _ in range(n)]
    made = [f'<html><body><div class="x1">Home Shop Contact</div><div class="c7"><p>{t}</p><div class="q9">Share this now</div><p>{t[::-1]}</p></div><table class="z"><tr><td>Imprint 2024</table></body></html>' for t in own]
    return made, [f"{t} {t[::-1]}" for t in own]


@pytest.mark.parametrize("n", [3, 30])
def test_entropy_alone_finds_an_unnamed_template(spark, n):
    made, want = unnamed(random.Random(n), n)
    assert texts(spark, made) == want
    by = Counter(x["by"] for x in html_text.judged(html_text.style_nodes(pages(spark, made))).collect())
    assert by["entropy"] >= 3 and by["names"] == 0


def test_one_page_tells_nothing_but_names(spark):
    """Entropy can't decide on a host's only page; names do, for noise alone."""
    (made,), (want,) = unnamed(random.Random(1), 1)
    assert texts(spark, [made])[0].startswith("Home Shop Contact ") and texts(spark, [made])[0].endswith(" Imprint 2024")
    assert texts(spark, [made.replace("x1", "menu").replace('"z"', '"footer"').replace("q9", "share")]) == [want]


def test_names_decide_what_entropy_leaves(spark):
    """An advert with a new text on every page looks important."""
    r = random.Random(2)
    ads, own = [words(r, 6) for _ in range(12)], [words(r, 30) for _ in range(12)]
    made = [f'<body><div class="promo">{a}</div><div class="c">{t}</div></body>' for a, t in zip(ads, own)]
    assert texts(spark, made) == own
    found = {x["by"]: x["importance"] for x in html_text.judged(html_text.style_nodes(pages(spark, made))).collect()}
    assert set(found) == {"names", None} and found["names"] > 0.5


def test_tree_equals_plain_python(spark):
    """Importance of every style node, and which go, from the pages' branches by the definition."""
    r = random.Random(3)
    parts = ['<div class="a">same</div>', '<div class="b">{}</div>', '<section id="s{}"><p>t</p></section>', '<ul class="nav"><li>{}</ul>', "<p>{}</p>", '<div class="deep"><div class="er">{}</div>same</div>']
    made = [[f"https://h{k}.example.com/{i}", "".join(r.choice(parts).format(r.randrange(3)) for _ in range(r.randint(0, 6)))] for k in range(6) for i in range(r.choice((1, 2, 5, 12)))]
    made += [[None, "<p>x</p>"], ["https://h1.example.com/z", None]] + made[:4]
    tree = defaultdict(lambda: ([], []))
    named = set()
    for url, source in made:
        for style, b in html_text.Page(source).branches.items():
            tree[html_text.host_of(url), style][0].append(b.children)
            tree[html_text.host_of(url), style][1].append(b.text)
            if b.noise:
                named.add((html_text.host_of(url), style))

    def entropy(values):
        n = len(values)
        return -sum(c / n * math.log(c / n, n) for c in Counter(values).values()) if n > 1 else 1.0

    want = {}
    for (host, style), (children, content) in tree.items():
        if style != html_text.ROOT:
            importance = html_text.PRESENTATION * entropy(children) + (1 - html_text.PRESENTATION) * entropy(content)
            whole = tree[host, html_text.ROOT][1]
            enough = len(children) - (len(whole) - len(set(whole))) >= html_text.SUPPORT or len(children) >= html_text.MANY_PAGES
            by = "entropy" if enough and importance < html_text.LEAST_IMPORTANCE * entropy(whole) else "names" if (host, style) in named else None
            want[host, style] = (len(children), round(importance, 9), by)
    d = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(made)], "page_id long, url string, html string")
    got = {(x["host"], x["style"]): (x["m"], round(x["importance"], 9), x["by"]) for x in html_text.judged(html_text.style_nodes(d)).collect()}
    assert got == want and {x[2] for x in want.values()} == {"entropy", "names", None}
    removed = {x["host"]: set(x["removed"]) for x in html_text.unimportant(html_text.style_nodes(d)).collect()}
    out = {x["page_id"]: x["text"] for x in html_text.main_texts(d).collect()}
    assert out == {i: html_text.Page(h).main_text(removed.get(html_text.host_of(u), set())) for i, (u, h) in enumerate(made)}


def test_hashes_of_stretches():
    s, r = html_text.Sequence(), random.Random(4)
    items = [r.randrange(5) for _ in range(40)]
    for x in items:
        s.add(x)
    seen = {}
    for a in range(41):
        for b in range(a, 41):
            assert seen.setdefault(s.between(a, b), items[a:b]) == items[a:b]


LONG = ["<a " * 20000, "<a " * 20000 + ">", '<a "' * 20001 + ">", '<a "x>y" ' * 8000, "<!" * 20000, "<!--" * 20000, "</p>" * 20000, "<div class=c>" * 8000 + "end", "<p><article>" + "<div>" * 8000 + "</p>" * 8000]
LONG += ["<b>" * 8000 + "<div>" * 8000, "<svg>" * 20000, "<script" * 20000, "<div class='ad'>" * 5000 + "<article>" * 5000, "<" * 60000, "<a<a<a" * 10000 + ">", "&amp" * 30000, "<p class='" + "x " * 30000 + "'>"]


@pytest.mark.parametrize("source", LONG, ids=lambda x: x[:9])
def test_long_odd_pages_take_linear_time(source):
    began = time.process_time()
    html_text.Page(source).main_text({1})
    assert time.process_time() - began < 1.5


def test_odd_pages_and_columns(spark):
    """Nulls, empty pages, repeated rows, clashing columns, an empty table."""
    d = spark.createDataFrame([(None, None, None, 1), (1, "x", "", 2), (1, "x", "<p>a&amp;b &#x130;", 3), (1, "x", "<p>a&amp;b &#x130;", 4)], "page_id long, url string, html string, text int")
    got = sorted((str(x["page_id"]), x["text"], x["n_chars"]) for x in html_text.main_texts(d).collect())
    assert got == [("1", "", 0), ("1", "a&b İ", 5), ("1", "a&b İ", 5), ("None", "", 0)]
    assert html_text.main_texts(d.limit(0)).count() == 0
    assert html_text.Page("<p>İİİ</p><script>x</script>abcdef").main_text(set()) == "İİİ abcdef"
    assert html.unescape("&amp;") == "&"
