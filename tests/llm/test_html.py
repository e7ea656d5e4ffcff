"""Main text: hand-written pages of other layouts than the labelled ones, deep and odd markup, awkward rows."""

import time

import pytest

from foliospark.llm import html_extract

PAGES = {
    "bare paragraph": ("<p>This page is one bare paragraph of text without any container.</p>", "This page is one bare paragraph of text without any container."),
    "sidebar without telling names": (
        "<body><div class=r><div class=x1><h1>Bees in the city</h1><p>More and more people keep bees on roofs, and the bees do well there.</p><p>Parks and balconies flower from March until October, so food is never far.</p><p>Honey from the city sells at a good price.</p></div><div class=x2><h4>About us</h4><p>This magazine is made by people who like to live in towns.</p><ul><li><a href=1>Our team</a></li><li><a href=2>Our history</a></li></ul></div></div></body>",
        "Bees in the city\nMore and more people keep bees on roofs, and the bees do well there.\nParks and balconies flower from March until October, so food is never far.\nHoney from the city sells at a good price.",
    ),
    "related and comments within the article": (
        "<body><article><h1>Night trains</h1><p>Night trains are back on many lines, and most berths are sold out for weeks.</p><div class=related><h3>Related</h3><p><a href=1>The last sleeping car</a></p><p>Read all that we wrote on trains in the past ten years.</p></div><p>New cars are being built, but they will not be ready before next year.</p><div id=comments><h3>Comments</h3><p>I love to wake up in another country, nothing is better than that.</p><p>Too loud for me, I would rather fly than do this again.</p></div></article></body>",
        "Night trains\nNight trains are back on many lines, and most berths are sold out for weeks.\nNew cars are being built, but they will not be ready before next year.",
    ),
    "main with header, footer and notice": (
        "<body><header><a href=/>Site</a><p>News for the north of the county</p></header><div class=cookie-banner><p>We use cookies to count our readers. You may refuse them.</p></div><main><h1>School opens</h1><p>The new school opens on Monday with room for four hundred children.</p><h2>The building</h2><p>It is made of wood and gets its heat from the ground.</p></main><footer><p>All rights reserved.</p></footer></body>",
        "School opens\nThe new school opens on Monday with room for four hundred children.\nThe building\nIt is made of wood and gets its heat from the ground.",
    ),
    "old table layout": (
        "<body><table><tr><td><a href=1>Home</a><br><a href=2>Links</a><br><a href=3>Guestbook</a></td><td><h2>My garden</h2><p>Here I write down what grows in my garden through the year.</p><p>In April the tulips came up, and in May the peas.</p></td></tr></table></body>",
        "My garden\nHere I write down what grows in my garden through the year.\nIn April the tulips came up, and in May the peas.",
    ),
    "lists, quotes, code and a table": (
        "<body><nav><ul><li><a href=1>Docs</a></li><li><a href=2>Blog</a></li></ul></nav><div class=post><h1>Sorting</h1><p>There are many ways to sort, and each has its place.</p><ul><li>Insertion sort is short.</li><li>Merge sort is stable.</li></ul><pre>sort(x)  # in place</pre><table><tr><th>n</th><th>time</th></tr><tr><td>10</td><td>1 ms</td></tr></table><blockquote>Premature optimisation is the root of all evil.</blockquote></div><footer>&copy; me</footer></body>",
        "Sorting\nThere are many ways to sort, and each has its place.\nInsertion sort is short.\nMerge sort is stable.\nsort(x) # in place\nn\ntime\n10\n1 ms\nPremature optimisation is the root of all evil.",
    ),
    "share bar and newsletter form between paragraphs": (
        "<body><div id=main-content><h1>A walk by the sea</h1><p>The path begins behind the lighthouse and follows the cliffs for nine miles.</p><div class=share-bar><a href=1>Mail</a> <a href=2>Print</a></div><p>Take water with you, for there is no inn until the very end.</p><form class=subscribe><p>Subscribe to our letter on walks and never miss one.</p><input type=text></form><p>The bus back leaves at six.</p></div></body>",
        "A walk by the sea\nThe path begins behind the lighthouse and follows the cliffs for nine miles.\nTake water with you, for there is no inn until the very end.\nThe bus back leaves at six.",
    ),
    "references, entities, breaks and left open tags": (
        "<body><div class=menu><a href=1>A</a> <a href=2>B</a></div><article><h1>Caf&eacute; &amp; bar</h1><p>Open &#8364;5&nbsp;nights<br>a week<p>Closed on <b>Mon<i>days</b></i>.</article>",
        "Café & bar\nOpen €5 nights a week\nClosed on Mondays.",
    ),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_of_other_layouts(name):
    page, want = PAGES[name]
    assert html_extract.main_text(page, html_extract.model()) == want


@pytest.mark.parametrize("page", ["<b>" * 8_000 + "</i>" * 8_000, "<div>" * 8_000 + "</p>" * 8_000, "<table>" + "<p><table>" * 300 + "<b>" * 8_000 + "<h1></h1>" * 8_000, "<svg><!-- " * 4_000, "<ul>" + "<li>x" * 20_000, "<p>" + "x <b>y " * 30_000, "<svg>" * 8_000 + "<p>x</p>" * 8_000])
def test_time_grows_with_length_only(page):
    began = time.perf_counter()
    html_extract.main_text(page, html_extract.model())
    assert time.perf_counter() - began < 6


def test_awkward_rows(spark):
    rows = [(1, None, "x", 5), (1, None, "x", 5), (2, "", None, None), (3, "<p>The one and only line of this whole page.", None, 1), (None, "no tags at all, just a line of text", "y", 2)]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")
    got = html_extract.extract(frame, "html", frame.columns)
    assert sorted(got.columns) == ["html", "n_chars", "page_id", "text"] and got.filter("page_id = 1 AND text = '' AND n_chars = 0").count() == 2
    assert got.filter("page_id = 3").first()["text"] == "The one and only line of this whole page."
    assert html_extract.extract(frame.limit(0), "html", ["page_id"]).count() == 0
