import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from certlake.llm import bloom_lm, quality, style_tree, toxicity

GOOD = "the river runs past a quiet town and people walk along its banks in the evening"
BAD = "BUY!! now $$$ click ### here *** win &&& free"


def labelled(spark):
    rows = [(i, f"{GOOD} number {i}", 1, 0) if i % 2 else (i, f"{BAD} {i} you are an idiot and worthless" if i % 4 == 0 else f"{BAD} {i}", 0, int(i % 4 == 0)) for i in range(400)]
    rows += [(1000 + i, f"the {group} neighbour met a friend {i}", 1, 0) for i, group in enumerate(("muslim", "jewish", "gay", "black", "old") * 8)]
    rows += [(2000 + i, f"that {group} clown is an idiot {i}", 0, 1) for i, group in enumerate(("muslim",) * 30)]
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(None, None), (9000, ""), (9001, "long " * 50000)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


def test_quality_learns_and_is_defined_everywhere(spark):
    docs, labels = labelled(spark)
    config = quality.QualityConfig(buckets=512, dims=16, rounds=120)
    got = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels, config), "score").collect()}
    assert got[1] > 0.7 > 0.3 > got[2] and all(0 <= s <= 1 for s in got.values()) and {None, 9000, 9001} <= set(got)
    nothing = quality.train(docs.limit(0), labels.limit(0), config)
    assert all(0 <= r.score <= 1 for r in quality.score(docs, nothing, "score").collect())


def test_toxicity_spares_neutral_mentions(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, "score").collect()}
    assert got[4] > 0.5 > got[1] and got[2000] > 0.5 and all(got[1000 + i] < 0.5 for i in range(40))
    plain = toxicity.train(docs, labels, toxicity.ToxicityConfig(counterfactual=0.0))
    gap = lambda m: abs(m.score("the muslim neighbour met a friend") - m.score("the jewish neighbour met a friend"))
    assert gap(model) <= gap(plain) + 1e-9
    constant = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, constant, "score").select("score").distinct().count() == 1
    assert toxicity.train(docs.limit(0), labels.limit(0)).score("x") == 0.5


TEXTS = [f"The cat sat on the mat number{i % 7} and the dog saw the cat" for i in range(60)] + ["", None, "A\x0bB c d", "zz " * 5000]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\0end"]


@pytest.mark.parametrize("most", [16 << 20, 0])
def test_language_model_counts_exactly(spark, most):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "the cat", 7)], "doc_id long, text string, n_tokens int")
    config = bloom_lm.LmConfig(broadcast_bytes=most)
    got = {r.doc_id: r for r in bloom_lm.score(docs, bloom_lm.train(docs.where("doc_id % 3 <> 0"), config)).collect()}
    counts = Counter(w for i, t in enumerate(TEXTS) if i % 3 for w in words(t))
    n, v = counts.total(), len(counts)
    for i, t in [*enumerate(TEXTS), (None, "the cat")]:
        mine = words(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(mine), sum(counts[w] > 0 for w in mine), n)
        assert math.isclose(got[i].base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in mine), rel_tol=1e-9)
        assert got[i].score < 0
    assert sum(got[i].score for i in range(0, 60, 3)) > sum(got[i].base_score for i in range(0, 60, 3))
    empty = bloom_lm.score(docs, bloom_lm.train(docs.limit(0), config)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in empty)
    assert bloom_lm.score(docs.limit(0), bloom_lm.train(docs, config)).count() == 0


def test_filter_gives_levels_back():
    keys = np.unique(bloom_lm.mix(np.arange(5000, dtype=np.uint64)))
    q = bloom_lm.level(np.random.default_rng(1).zipf(1.5, len(keys)).clip(1, 10**6), 1.5)
    size = int(q.sum()) * 16
    bits = np.frombuffer(bloom_lm.segment_of(keys, q, size, 6), np.uint8)
    found = bloom_lm.levels_in(keys, bits, 0, size, 6)
    assert (found >= q).all() and (found == q).mean() > 0.97
    assert (bloom_lm.levels_in(bloom_lm.mix(np.arange(10**6, 10**6 + 5000, dtype=np.uint64)), bits, 0, size, 6) == 0).mean() > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">{0} menu</a></li></ul></nav><!-- ad --><div class="ad">buy {0}</div>
<div class="cookie-notice">we use cookies</div><{1}><h1>Title {0}</h1><p><b>First &amp; <i>b</i>old<br>line<p>Second&nbsp; one
</p><form>mail <input></form><aside>related</aside></{1}><div id="comments"><p>I disagree</p></div><footer>&copy; us</footer></body></html>"""


def test_pages_keep_their_article(spark):
    for tag in ("article", "main", "div"):
        assert style_tree.main_text(PAGE.format("x", tag)) == "Title x First & bold line Second one"
    assert style_tree.main_text(None) == style_tree.main_text("") == style_tree.main_text("<<<>") .strip("< >") == ""
    assert style_tree.main_text("a < b &lt; c <p title='>'>d") == "a < b < c d"
    assert style_tree.main_text("<p>" + "word " * 100000) == ("word " * 100000).strip()


def test_branches_that_repeat_on_a_host_go(spark):
    body = '<body><div class="intro"><span>Welcome to the best site</span></div><div class="story"><h2>{0}</h2><p>{0} text {0}</p></div><div class="ending"><p>All rights</p></div></body>'
    rows = [(i, f"http://h.example/{i}", body.format(f"page{i}"), "old") for i in range(8)] + [(90, "http://alone.example/", body.format("lone"), "old"), (91, None, None, "old"), (92, "nonsense", "", "old"), (None, "http://h.example/0", body.format("page0"), "old")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in style_tree.extract(pages).collect()}
    assert got[3].text == "page3 page3 text page3" and got[3].n_chars == len(got[3].text)
    assert got[90].text == "Welcome to the best site lone lone text lone All rights"
    assert (got[91].text, got[91].n_chars, got[92].text) == ("", 0, "") and got[None].text == "page0 page0 text page0"
    assert sorted(map(str, style_tree.extract(pages, style_tree.TreeConfig(broadcast_nodes=-1)).collect())) == sorted(map(str, style_tree.extract(pages).collect()))
    assert style_tree.extract(pages.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    from certlake.llm import queries

    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, column, least in (("op4_quality_classifier", "quality", 0.85), ("op10_toxicity", "toxic", 0.9)):
        rows = [r for r in queries.QUERIES[name](spark, sf).collect() if r.held_out and r.doc_id in labels]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
        assert np.mean([r.predicted == labels[r.doc_id][column] for r in rows]) >= least
