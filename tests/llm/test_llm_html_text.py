import itertools
import random
import re
from html import unescape

import pytest

from gapscore.llm import html_text
from gapscore.llm.html_text import common_lines, extracted, lines_of, main_text


def text_of(html, *others):
    return main_text(lines_of(html), [lines_of(o) for o in others])


def test_pages_of_the_corpus(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in extracted(rows).collect()}
    for r in rows.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", article))
        want = "\n".join(filter(None, (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)))
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("plain &amp; simple\n text", "plain & simple text"),
        ("<p>one<p>two<br>three<script>if (a < b) '</p>'</script></p>", "one\ntwo three"),
        ("<nav>menu<ul><li>a<li>b</ul></nav><p>body</p><footer>foot", "body"),
        ("<div class='cookie-notice'>accept</div><div>kept</div><aside>side</aside>", "kept"),
        ("<form><p>name</p></form><p>a</p><div id=comments><p>first!</p></div>", "a"),
        ("<nav>never closed <article><p>still here</p></article><p>after</p>", "still here"),
        ("<article><h1>T</h1><p>x<span class='ad'>buy</span> y</p></article><p>outside</p>", "T\nx y"),
        ("<header><h1>Site</h1></header><main><header><h1>Title</h1></header>t</main>", "Title\nt"),
        ("<p hidden>no</p><p data-x='hidden'>yes</p>", "yes"),
        ("<!-- <p>no</p> --><p title='a > b'>yes</p><style>p{}", "yes"),
        ("1 < 2 &lt;b&gt; &nbsp; &#65;&eacute;", "1 < 2 <b> Aé"),
        ("<article><p>a</p><div class='comment-list'><article><p>c</p></article></div></article>", "a"),
    ],
)
def test_blocks(html, want):
    assert text_of(html) == want


def test_shared_lines_go():
    page = "<div>Home</div><p>{}</p><div>All rights reserved</div>"
    own = page.format("a story of its own, long enough to be most of the page")
    other = page.format("quite another story that also is long enough to matter")
    assert text_of(own, other) == "a story of its own, long enough to be most of the page"


def test_copies_are_not_templates():
    page = "<div>Home</div><p>the same long story on both pages</p>"
    assert text_of(page, page) == "Home\nthe same long story on both pages"


def longest(a, b):
    for n in range(len(a), -1, -1):
        for chosen in itertools.combinations(range(len(a)), n):
            rest = iter(b)
            if all(a[i] in rest for i in chosen):
                return n
    return 0


@pytest.mark.parametrize("seed", range(30))
def test_common_lines_are_longest(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
    found = common_lines(a, b)
    rest = iter(b)
    assert found == sorted(found) and all(a[i] in rest for i in found) and len(found) == longest(a, b)


def test_neighbours_are_of_the_same_host(spark):
    line = "<div>Shared line</div><p>text number {} which is longer than the shared line</p>"
    rows = [(i, f"http://a.example.org/p/{i}", line.format(i)) for i in range(4)]
    rows += [(9, "http://b.example.org/p/1", line.format(9)), (10, None, line.format(10)), (11, "no url", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in extracted(pages.coalesce(1)).collect()}
    assert got[9].startswith("Shared line") and got[10].startswith("Shared line") and got[11] == ""
    assert sum(got[i].startswith("Shared") for i in range(4)) <= 1  # at most the one that a range cuts off


def test_awkward_pages(spark):
    from llm_tables import with_clashes

    rows = [(1, None, None), (1, "u", "<p>a"), (None, "http://x/y", "<p>b" * 3), (2, "", "x" * 100_000)]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted((r["n_chars"], r["text"][:5]) for r in extracted(pages).collect())
    assert got == [(0, ""), (1, "a"), (5, "b\nb\nb"), (100_000, "xxxxx")]
    assert extracted(pages.limit(0)).collect() == []


MENU = "".join(f"<div>Menu entry number {i} of the site</div>" for i in range(20))


def test_short_texts_under_a_long_template():
    pages = [f"{MENU}<p>short text {i}</p>" for i in range(3)]
    assert text_of(*pages) == "short text 0"
    assert text_of(pages[0], pages[0]) == text_of(pages[0])  # a copy
    assert text_of(pages[0], pages[0], pages[0]) == text_of(pages[0])


def test_marks_are_no_more_than_a_hint():
    story = "<div>a story that stands in a block of its own and goes on for a while</div>"
    assert text_of(f"<article>teaser</article>{story}").endswith("for a while")
    page = "<main><p>Home of the site</p><p>text {} that is long enough to be most of the page</p></main>"
    assert text_of(*(page.format(i) for i in range(3))) == "text 0 that is long enough to be most of the page"
    assert text_of(page.format(0), page.format(0), page.format(0)).startswith("Home")  # copies


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_ranges_do_not_matter(spark, ranges, monkeypatch):
    monkeypatch.setattr(html_text, "_RANGES", ranges)
    line = MENU + "<p>text {}</p>"
    rows = [(i, f"http://a.example.org/p/{i:03}", line.format(i)) for i in range(60)]
    rows += [(None, "http://a.example.org/p/007", line.format("x")), (3, rows[3][1], rows[3][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted(r["text"] for r in extracted(pages).collect())
    assert got == sorted([f"text {i}" for i in range(60)] + ["text x", "text 3"])


STORY = "<p>A story that is told in full and goes on for quite a while.</p><p>It has a second part that is as long as that.</p>"


def test_an_article_on_several_pages_stays():
    """Copies of an article with another line each are set aside."""
    for page in (f"<article>{STORY}</article><div>Ref {{}}</div>", f"{STORY}<div>Ref {{}}</div>"):
        pages = [page.format(i) for i in range(5)]
        assert text_of(*pages).startswith("A story that is told") and "second part" in text_of(*pages)


def test_headings_of_all_articles_stay():
    page = "<div>Kitchen of the world</div><article><h2>Ingredients</h2><p>Take {0} eggs and some flour of the kind {0}.</p><h2>Method</h2><p>Stir it all {0} times.</p></article>"
    pages = [page.format(i) for i in range(5)]
    want = "Ingredients\nTake 0 eggs and some flour of the kind 0.\nMethod\nStir it all 0 times."
    assert text_of(*pages) == want


def test_two_pages_tell_a_menu():
    one = f"{MENU}<p>The first page tells of a walk along the river in spring.</p>"
    two = f"{MENU}<p>The other one explains how bread was baked in old times.</p>"
    assert text_of(one, two) == "The first page tells of a walk along the river in spring."


def test_a_line_of_an_article_that_stands_outside_elsewhere_goes():
    page = "<article><p>Join our club today.</p><p>Tale {0} that is long enough to be most of the page, number {0}.</p></article>"
    other = "<div>Join our club today.</div><article><p>Another tale altogether that is as long as the first one was.</p></article>"
    assert text_of(page.format(1), other, other).startswith("Tale 1")
    assert text_of(page.format(1), page.format(2), page.format(3)).startswith("Join")


def test_a_page_repeated_many_times(spark):
    rows = [(1, "http://a.example.org/p", f"{MENU}{STORY}")] * 300 + [(2, "http://a.example.org/q", f"{MENU}<p>Something else that fills a page and ends here.</p>")]
    got = extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 301 and {r["text"][:12] for r in got} == {"A story that", "Something el"}
