import math

from certlake.llm import style_tree


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://h.example/{i}", html) for i, html in enumerate(rows)], "page_id long, url string, html string")


def texts(spark, rows):
    return [r.text for r in style_tree.extract(pages(spark, rows)).orderBy("page_id").collect()]


def test_what_repeats_inside_articles_goes(spark):
    html = '<body><article><h1>Title {0}</h1><p>story {0} of the day</p><div class="hint"><p>Write to our desk at any time</p></div></article></body>'
    assert texts(spark, [html.format(i) for i in range(8)]) == [f"Title {i} story {i} of the day" for i in range(8)]


def test_copies_of_one_article_are_no_frame(spark):
    html = '<body><main><h1>One title</h1><p>one story</p></main></body>'
    other = '<body><main><h1>Other {0}</h1><p>other story {0}</p></main></body>'
    assert texts(spark, [html] * 9 + [other.format(i) for i in range(6)]) == ["One title one story"] * 9 + [f"Other {i} other story {i}" for i in range(6)]


def test_text_beside_articles_needs_the_tree(spark):
    html = '<body><div class="story"><p>long story {0}</p></div><article class="box"><p>look at {0}</p></article><div class="frame"><p>all rights</p></div></body>'
    assert texts(spark, [html.format(i) for i in range(8)]) == [f"long story {i} look at {i}" for i in range(8)]
    assert texts(spark, [html.format(1)]) == ["look at 1"]


def test_words_stay_whole_beside_silent_tags():
    page = "<article><p>foo<img src=x>bar wo<script>var x;</script>rd a<input>b c<!-- d -->e f<br>g</p><hr><p>h</p></article>"
    assert style_tree.main_text(page) == "foobar word ab ce f g h"


def test_only_plain_names_are_noise():
    page = "<article><p>a</p><p class='related-work'>b</p><p class='notice-of-intent'>c</p><div class='cookie-notice'>d</div><div id='ad-slot'>e</div><p class='top'>f</p><div class='share social'>g</div></article>"
    assert style_tree.main_text(page) == "a b c f"
    assert style_tree.main_text("<div class='top'>only text</div>") == "only text"
    assert style_tree.main_text("<div class='has-sidebar'>text</div><div class='sidebar-left'>more</div>") == "text"


FRAME = '<body><nav><a href="/">Home</a> <a href="/x">News</a></nav><div class="ad">Buy our paper today</div><section><h2>{0} title</h2><p>{0} story</p></section><footer>All rights</footer></body>'


def test_the_tree_alone_removes_frames(spark):
    found = style_tree.extract(pages(spark, [FRAME.format(f"n{i}") for i in range(9)]), style_tree.TreeConfig(roles=False))
    assert sorted(r.text for r in found.collect()) == [f"n{i} title n{i} story" for i in range(9)]


def test_importance_is_that_of_its_definition(spark):
    """Entropies of a small site counted page by page, without articles, against the removed branches."""
    rows = [f'<body><div class="a"><p>same words</p></div><div class="b"><p>{"x" if i % 2 else "y"}</p></div><div class="c"><p>text {i}</p></div><div class="d">{"<p>u</p>" * (i % 3 + 1)}</div></body>' for i in range(12)]
    config = style_tree.TreeConfig(roles=False)
    seen: dict = {}
    for html in rows:
        for node, kind, feature, _, _ in style_tree.tree_rows(html, False):
            seen.setdefault(node, ([], []))[kind].append(feature)
    expected = set()
    for node, (styles, texts) in seen.items():
        m = len(styles)
        entropy = -sum(styles.count(s) / m * math.log(styles.count(s) / m, m) for s in set(styles))
        # A text's information is that of how many pages have it; a node's is the mean over its distinct texts.
        told = sum(1 - math.log(texts.count(t), m) for t in set(texts)) / len(set(texts))
        if config.style * entropy + (1 - config.style) * told < config.threshold:
            expected.add(node)
    removed = {n for r in style_tree.branches(pages(spark, rows), config).collect() for n in r.removed}
    assert removed == expected and len(expected) >= 2


def test_pages_without_articles_lose_their_frame(spark):
    rows = [FRAME.format(f"n{i}").replace("section>", "div>") for i in range(9)]
    assert texts(spark, rows) == [f"n{i} title n{i} story" for i in range(9)]
