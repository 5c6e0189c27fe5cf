import itertools
import math

import pytest

from pyspark.sql import functions as F

from tidewater.llm import html_text as H

SCHEMA = "page_id long, url string, html string, text int, n_chars string"
ARTICLE = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A title</h1><p>This is the story, and it is long enough.</p><p>Short &amp; sweet.</p></article><div class='ad'>Buy it now!</div><footer>&copy; all</footer></body></html>"
MODEL = H.model_of(H.count(H.Page(ARTICLE), H.marked_main(H.Page(ARTICLE))))


@pytest.mark.parametrize("text", [ARTICLE, "<div>a<p>b. c</p><ul><li>d<li><a>e</a></ul></div>", "<main><aside><p>x</p></aside><p>y</p></main>"])
def test_marginals_are_those_of_all_labelings(text):
    page = H.Page(text)
    n = len(page.parent)
    total, yes = 0.0, [0.0] * n
    for labels in itertools.product((0, 1), repeat=n):
        x = sum(MODEL[f"edge {page.edge(k)} {labels[page.parent[k]]}{labels[k]}"] for k in range(1, n))
        x += sum(MODEL[f"look {labels[k]} {look}"] for k in range(1, n) for look in page.looks(k)[: 1 if page.inside[k] else None])
        p = math.exp(x)
        total += p
        yes = [y + p * label for y, label in zip(yes, labels)]
    got = H.marginals(page, MODEL)
    assert all(abs(got[k] - yes[k] / total) < 1e-9 for k in range(1, n))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, ""), ("", ""), ("Just text", "Just text"), ("<p>a<p>b", "a\nb"), ("<p>a &lt;b&gt;\n\t c&nbsp;d<br>e</p>", "a <b> c d e"),
        ("<script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>x</p>", "x"), ("<div>one<p>two</p>three</div>", "one\ntwo\nthree"),
        ("<main><p>Text of it.</p><form><p>Your name</p><input><button>Go</button></form><div id=comments><p>First! What a fine text this is.</p></div></main>", "Text of it."),
        ("<body class=has-sidebar><p>a</p><div class='cookie-notice'>We use cookies.</div></body>", "a"), ("<p>2 < 3 and 4 > 1</p>", "2 < 3 and 4 > 1"), (ARTICLE, "A title\nThis is the story, and it is long enough.\nShort & sweet."),
        ("<main><p>Intro of the list.</p><ul>" + "<li>thing</li>" * 12 + "</ul></main>", "Intro of the list." + "\nthing" * 12), ("<p>" + "word " * 50_000, "word " * 49_999 + "word"), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_pages(text, want):
    assert H.main_text(text, MODEL) == want


def test_extract_and_learn(spark):
    rows = [(1, "u", ARTICLE, 0, "x"), (1, "u", ARTICLE, 0, "x"), (2, None, None, 0, None), (None, "v", "<p>a</p>", 0, None)]
    out = sorted(map(tuple, H.extract(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    main = "A title\nThis is the story, and it is long enough.\nShort & sweet."
    assert out == sorted([(1, "u", main, len(main)), (1, "u", main, len(main)), (2, None, "", 0), (None, "v", "a", 1)], key=str)
    assert H.extract(spark.createDataFrame([], SCHEMA)).collect() == []


STORY = "<article><h1>A title</h1><p>This is the story, and it is long enough.</p></article>"
TOLD = "A title\nThis is the story, and it is long enough."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"<div class='container right-sidebar'>{STORY}<div class=sidebar><p>Other things.</p></div></div>", TOLD), (f"<div class=layout-sidebar><div>{STORY}</div></div>", TOLD),
        (f"<form id=aspnetForm><nav><a href=/>Home</a></nav>{STORY}<footer>all</footer></form>", TOLD), ("<form id=form1><div><p>This is the story, and it is long enough.</p></div></form>", "This is the story, and it is long enough."),
        ("<div class=content-with-sidebar><p>This is the story, and it is long enough.</p></div>", "This is the story, and it is long enough."),
        (f"{STORY}<div class=related><article><p>Another story, to be read elsewhere.</p></article></div>", TOLD),
        (f"{STORY}<div id=comments><article class=comment-body><p>First! What a fine text this is.</p></article></div>", TOLD), (f"<aside>{STORY}</aside>", ""),
        (f"<div class='layout-sidebar'>{STORY}<div id=comments><article class=comment-body><p>First! What a fine text this is.</p></article></div></div>", TOLD),
    ],
)
def test_content_inside_elements_with_hints(text, want):
    assert H.main_text(f"<html><body>{text}</body></html>", MODEL) == want


def test_counts_decide_inside_furniture():
    story = "This is the story, and it is long enough."
    page = f"<div class=teaser>{story}</div>" + "<p>This is none of it.</p>" * 4
    assert story not in H.main_text(page, MODEL)
    labelled = H.Counter()
    for _ in range(20):
        labelled += H.count(H.Page(page), [story])
    assert H.main_text(page, H.model_of(labelled)) == story


def test_training_pages_are_pages_that_label_themselves(spark):
    rows = [(k, "u", ARTICLE if k in (70, 71) else "<p>a</p>" if k % 2 else ARTICLE + ARTICLE, 0, "x") for k in range(100)] + [(None, "u", ARTICLE, 0, "x")]
    pages = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.page_id for r in H.self_labelling(pages).collect()) == [70, 71]


def test_parsing_takes_time_in_proportion_to_the_page():
    import time

    n = 60_000
    pages = ["<a " * n, "<p " * n + ">", '<a href="' * n, "</x>" * n, "<b>" * n + "<div></div>" * n, "<b>" * n + "</i>" * n, "<ul><li>" * n, "<!" * n, "<script>" * n, "<li>" + "<ul><div>" * 100 + "<li></li>" * n, "<a '\">" * n, "x<" * n]
    for page in pages:
        begin = time.time()
        H.Page(page)
        assert time.time() - begin < 4, page[:40]


def test_what_is_open_at_the_end_of_a_page():
    show = lambda t: "|".join(x for _, x in H.Page(t).lines(lambda k: True))
    assert show("<p>a<script>var b = '<p>'; c") == "a"
    assert show("<p>a<!-- <b>never closed") == "a"
    assert show("<p>a<p>b</x></p>c <i") == "a|b|c <i"
    assert show("<ul><li>a<li>b<ul><li>c</ul>d<li>e</ul>") == "a|b|c|d|e"
    assert show("<table><tr><td>a<td>b<tr><td>c</table>d") == "a|b|c|d"


def test_articles_keep_their_headers_bylines_and_formulas(spark):
    inside = "<header><h1>Title of it</h1></header><p class='byline'>By somebody, today.</p><p>A long sentence that tells of <math><mi>x</mi></math> and more.</p><footer>Written in spring.</footer>"
    page = f"<body><header><a href='/'>Home</a></header><nav><a href='/b'>B</a></nav><article>{inside}</article><footer>All rights</footer></body>"
    df = spark.createDataFrame([(k, "u", page) for k in range(5)], "page_id long, url string, html string")
    assert {r.text for r in H.extract(df).collect()} == {"Title of it\nBy somebody, today.\nA long sentence that tells of x and more.\nWritten in spring."}


def test_held_out_pages_without_marks(spark):
    """Half of the pages, with their article's lines as labels and no article element, train the model; it finds the lines of the other half."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    bare = pages.withColumn("html", F.regexp_replace("html", "(?i)<(/?)article", "<$1div"))
    truth = {r.page_id: H.marked_main(H.Page(r.html)) for r in pages.collect()}
    labels = spark.createDataFrame([(k, "\n".join(v)) for k, v in truth.items() if v is not None and k % 2], "page_id long, main string")
    out = H.extract(bare.filter("page_id % 2 = 0"), bare.join(labels, "page_id").select("html", "main"))
    found = wanted = both = 0
    for r in out.collect():
        got, want = set(r.text.split("\n")), set(truth[r.page_id] or [])
        found, wanted, both = found + len(got), wanted + len(want), both + len(got & want)
    print("precision", both / found, "recall", both / wanted)
    assert both / found > 0.95 and both / wanted > 0.95


# Pages and their main text, both written by hand: names with furniture's words inside and outside of articles.
HAND = [
    ("<nav><a href=/>Home</a></nav><article><h1>Bleach and vinegar</h1><p class='warning'>Warning: never mix the two substances, as the gas is poisonous.</p><div class='search-study'><p>The search study asked 40 people.</p></div></article><footer>All rights</footer>",
     "Bleach and vinegar\nWarning: never mix the two substances, as the gas is poisonous.\nThe search study asked 40 people."),
    ("<article><h2>Court</h2><p>The court met on Monday.</p><div class=ad>Buy shoes!</div><p class='legal-notice'>The notice was read to all who came.</p></article><aside><p>Most read</p></aside>",
     "Court\nThe court met on Monday.\nThe notice was read to all who came."),
    ("<main><article><p>Bees dance.</p><div class='share-buttons'><a href=/s>Share</a></div><p>They show the way.</p></article><div id=comments><p>I saw them, too. It was lovely.</p></div></main>", "Bees dance.\nThey show the way."),
    ("<article><div class='feedback-loop'><p>A loop amplifies what it hears.</p></div><ul class=alerts><li>The first alert came at noon.</li><li>The second came later.</li></ul></article><div class='cookie-notice'><p>We use cookies to serve you.</p></div>",
     "A loop amplifies what it hears.\nThe first alert came at noon.\nThe second came later."),
    ("<div class=notice><p>We moved to a new address.</p></div><article><p>Only this is told here.</p><form><p>Your mail</p><input></form><div class='comment-list'><div class=comment><p>Well said, thank you!</p></div></div></article>", "Only this is told here."),
    ("<article><div class='widget-factory'><p>The factory made widgets until 1990.</p></div><div hidden><p>Not to be seen.</p></div><div class='newsletter signup'><p>Join our list.</p></div></article>", "The factory made widgets until 1990."),
]


def test_names_inside_articles_against_hand_written_texts(spark):
    """The truth is written by hand; the model learns from pages of another make, whose advert lies outside the article."""
    learnt = spark.createDataFrame([(k, "u", ARTICLE, 0, "x") for k in range(60)], SCHEMA)
    asked = spark.createDataFrame([(100 + k, "v", f"<html><body>{page}</body></html>", 0, "x") for k, (page, _) in enumerate(HAND)], SCHEMA)
    got = {r.page_id - 100: r.text for r in H.extract(learnt.union(asked)).collect() if r.page_id >= 100}
    assert got == {k: want for k, (_, want) in enumerate(HAND)}


def test_names_of_elements():
    level = lambda x: H.Page.hinted(f" class='{x}'")
    assert [level(x) for x in ("ad", "ad-slot top", "comment-body", "cookie-notice", "story ad-container")] == [1] * 5
    assert [level(x) for x in ("warning", "search-study", "notice", "ad-hoc", "header")] == [2] * 5
    assert [level(x) for x in ("", "story", "has-sidebar", "badge", "content-with-sidebar")] == [0] * 5


def test_trained_weights_may_drop_what_a_name_hints_at():
    page = "<article><p>This is the story, and it is long enough.</p><p class=warning>Read our terms of use before all.</p></article>"
    assert "terms" in H.main_text(page, MODEL)
    labelled = H.Counter()
    for _ in range(20):
        labelled += H.count(H.Page(page), ["This is the story, and it is long enough."])
    assert H.main_text(page, H.model_of(labelled)) == "This is the story, and it is long enough."


def test_names_don_t_confirm_themselves():
    """What only its name makes furniture within an article is no label of the page's own."""
    page = H.Page("<article><p>This is the story.</p><div class=ad><p>Buy it now!</p></div></article>")
    own, foreign = H.count(page, H.marked_main(page), True), H.count(page, ["This is the story."])
    assert own["look 0 hint 1"] == 0 and foreign["look 0 hint 1"] > 0
