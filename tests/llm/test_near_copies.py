import itertools
import random

import numpy as np
import pytest

from certlake.llm import cap_join, line_dedup, ngram_join, topk
from certlake.llm.common import components
from certlake.llm.words import shingle_sets, word_hashes


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def closure(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_texts():
    draw = random.Random(3)
    base = [[f"w{draw.randint(0, 4000)}" for _ in range(n)] for n in (6, 40, 90, 300, 3)]
    rows, key = [], 0
    for words in base:
        for _ in range(14):
            copy = list(words)
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(len(copy))] = f"x{draw.randint(0, 9)}"
            rows.append((key, " ".join(copy)))
            key += 1
    return rows + [(key, " ".join(base[3])), (key + 1, ""), (key + 2, None), (key + 3, "one"), (key + 4, "ONE "), (key + 5, " ".join(f"y{i}" for i in range(30000)))]


@pytest.mark.parametrize(("block", "small", "dense"), [(512, 32, 512), (8, 4, 512), (64, 2, 2)])
def test_links_and_classes_are_those_of_brute_force(spark, block, small, dense):
    rows = near_texts()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows] + [(None, "one", "clash", 1)], "doc_id long, text string, rep string, k1 int")
    found = ngram_join.join(docs, ngram_join.JoinConfig(block=block, small=small, dense=dense)).collect()
    assert [(r.class_id, r.n_links, r.kept) for r in found if r.doc_id is None] == [(None, 0, True)]
    got = {r.doc_id: r for r in found if r.doc_id is not None}
    sets = {i: grams(t) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    classes = closure(sets, pairs)
    for i in sets:
        assert got[i].n_links == sum(i in p for p in pairs), i
        assert got[i].class_id == classes[i] and got[i].kept == (classes[i] == i)


def test_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "z z z"), (2, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = {(r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(docs).collect()}
    assert got == {(1, 1, 1), (2, 1, 1)} and ngram_join.join(docs).count() == 4
    assert ngram_join.join(docs.limit(0)).count() == 0


def test_bands_reach_the_recall():
    config = ngram_join.JoinConfig()
    assert 1 - (1 - 0.8**config.rows) ** config.bands >= config.recall


def test_half_alike_texts_chain_no_cluster(spark):
    """Each text shares half of its n-grams with the next: bands collide all along the chain, but no cluster of
    many texts comes of it, so no text is compared with more than a few."""
    words = [f"w{i}" for i in range(40 * 400)]
    texts = [" ".join(words[40 * i : 40 * i + 120]) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    config = ngram_join.JoinConfig()
    classes = ngram_join.signatures(docs, config).selectExpr("doc_id AS rep", "bands", "sketch")
    banded = classes.selectExpr("rep", "explode(bands) AS band")
    assert banded.groupBy("band").count().where("count > 1").count() > 150
    sizes = [r["count"] for r in ngram_join._clusters(classes, config).groupBy("cluster").count().collect()]
    assert max(sizes, default=1) <= 4
    assert {(r.class_id == r.doc_id, r.n_links) for r in ngram_join.join(docs).collect()} == {(True, 0)}


def test_sketches_keep_pairs_at_the_threshold():
    config = ngram_join.JoinConfig()
    draw = np.random.default_rng(4)
    missed = 0
    for _ in range(400):
        x = draw.integers(0, 1 << 63, 178, dtype=np.uint64)  # the sets share 142 of 178
        sets = [np.sort(x[:160]), np.sort(x[18:178])]
        _, sketch = ngram_join._minima(np.concatenate(sets), np.array([0, 160]), config)
        missed += (sketch[0] == sketch[1]).sum() < config.likely
    assert missed == 0


def test_words_hash_alike_wherever_they_stand():
    hashes, counts = word_hashes([b"ab  cd\tab", b"", b"CD ab"], lower=True)
    assert counts.tolist() == [3, 0, 2] and hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[3]
    values, sizes = shingle_sets([b"a b c d e a b c d e", b"a b", b""], 5)
    assert sizes.tolist() == [5, 1, 0] and len(values) == 6


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (60, 60)], "a long, b long")
    got = {r.node: r.component for r in components(chain).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 50: 40}


def vectors():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(60, 64))
    x = np.concatenate([x, x[:20] + draw.normal(size=(20, 64)) * 0.35, x[:1] + draw.normal(size=(50, 64)) * 0.02, x[:3], 2 * x[:2]]).astype(np.float32)
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("small", [32, 2])
def test_vector_links_are_those_of_brute_force(spark, small):
    rows = vectors()
    odd = [(900, None), (901, [0.0] * 64), (902, [float("nan")] + [1.0] * 63), (903, [None] + [1.0] * 63), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, rep string")
    config = cap_join.CapConfig(small=small, block=16)
    got = {r.vec_id: r for r in cap_join.join(df, config).collect()}
    x = np.array([v for _, v in rows])
    cosine = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    pairs = [(a, b) for a, b in itertools.combinations(range(len(x)), 2) if cosine[a, b] >= 0.9] + [(905, 906)]
    ids = [*range(len(x)), *(i for i, _ in odd if i)]
    classes = closure(ids, pairs)
    for i in ids:
        assert (got[i].n_links, got[i].component_id) == (sum(i in p for p in pairs), classes[i]), i
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)
    assert cap_join.join(df.limit(0)).count() == 0


@pytest.mark.parametrize("words", [40, 150, 430])
def test_cap_filters_find_pairs_at_the_threshold(words):
    config = cap_join.CapConfig()
    threshold, codes = cap_join.calibrate(64, words, config), cap_join.make_codes(64, words, config)
    draw = np.random.default_rng(8)
    x = draw.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = draw.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
    met = np.zeros(300, dtype=bool)
    for code in codes:
        (a, f), (b, g) = code.decode(x, threshold), code.decode(y, threshold)
        met[np.intersect1d(a * words**3 + f, b * words**3 + g) // words**3] = True
    assert met.mean() >= 0.99


def test_decoding_lists_every_filter_above_the_threshold():
    config = cap_join.CapConfig(codes=1)
    code = cap_join.make_codes(32, 9, config)[0]
    x = np.random.default_rng(3).normal(size=(20, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cuts = np.cumsum([w.shape[1] for w in code.words])[:-1]
    a, b, c = (p @ w.T for p, w in zip(np.split(x @ code.turn, cuts, axis=1), code.words, strict=True))
    scores = (a[:, :, None, None] + b[:, None, :, None] + c[:, None, None, :]).reshape(20, -1)
    row, found = code.decode(x, 0.6)
    assert sorted(zip(row.tolist(), found.tolist(), strict=True)) == sorted(zip(*(y.tolist() for y in np.nonzero(scores >= 0.6)), strict=True)) and len(row)


@pytest.mark.parametrize("size", [1e-200, 1e200])
def test_lengths_beyond_squares_change_no_link(spark, size):
    rows = [(1, [size, 0.0]), (2, [0.0, size]), (3, [size, size * 0.01])]
    got = {r.vec_id: r.n_links for r in cap_join.join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 1, 2: 0, 3: 1}


@pytest.mark.parametrize(("block", "query_bytes"), [(64, 16 << 20), (4096, 300)])
def test_top_k_is_exact_with_ties(spark, block, query_bytes):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 16)).round(1)
    x[100:140] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (450, [float("inf")] * 16), (500, [None] * 16), (None, x[0].tolist()), (550, []), (600, [1.0, 2.0]), (601, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.search(df, topk.TopkConfig(block=block, query_bytes=query_bytes)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    q = np.floor(x.astype(np.float32).astype(float) * 256).astype(int)
    for i in range(0, 300, 50):
        best = sorted(((-int(q[i] @ q[j]), j) for j in range(300) if j != i))[:5]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert set(got) == {*range(0, 300, 50), 600} and topk.search(df.limit(0)).count() == 0
    few = {r.vec_id for r in topk.search(df.where("vec_id < 3")).collect()}
    assert few == {1, 2}


def test_repeated_ids_of_top_k(spark):
    """Of two vectors with one query id the smaller asks, and neither is a candidate; others count row by row."""
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (0, [0.5, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [3.0, 1.0]), (9, [0.0, 0.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 8, 768 * 128), (2, 7, 512 * 128), (3, 7, 512 * 128), (4, 9, 0)]


def test_lists_are_not_read_to_the_end():
    draw = np.random.default_rng(6)
    values = np.floor(256 * draw.normal(size=(4096, 64)) / 8).astype(np.int64)
    lists, config = topk.Lists(np.arange(4096), values), topk.TopkConfig()
    bar = [np.sort(values @ q)[-6] for q in values[:20]]
    for i in range(20):
        ids, scores = lists.search(values[i], i, float(bar[i]), config)
        assert scores.tolist() == sorted((int(s) for j, s in enumerate(values @ values[i]) if j != i), reverse=True)[:5] and i not in ids
    assert lists.read < 0.65 * 20 * values.size


def test_lines_above_the_ratio_go(spark):
    rows = [(i, f"Buy now \nline {i}\n\nlast {i}", "a", 30) for i in range(20)] + [(100 + i, f"only {i}", "a", 6) for i in range(80)]
    rows += [(300, None, "a", 0), (301, "", "a", 0), (302, "Buy now", "b", 7), (303, "Buy now", None, 7), (304, "copy of one\npage", "a", 9), *((400 + i, "copy of one\npage", "a", 9) for i in range(60))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, n_chars long, host string")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs).collect()}
    assert got[3].text == "line 3\n\nlast 3" and got[3].n_lines_dropped == 1 and got[3].n_chars == len(got[3].text)
    assert got[100].text == "only 0" and got[302].text == "Buy now" and got[303].text == "Buy now" and got[300].text is None and got[301].text == ""
    assert got[304].text == "copy of one\npage" and got[3].host == "x"
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0
    joined = line_dedup.drop_boilerplate(docs, config=line_dedup.LineConfig(broadcast_lines=-1))
    assert sorted(map(str, joined.collect())) == sorted(map(str, line_dedup.drop_boilerplate(docs).collect()))


def test_topk_refuses_vectors_beyond_64_bits(spark):
    rows = [(0, [1.0] * 64), (1, [1e6] * 64), (2, [-1e6] * 64), (3, [0.5] * 64)]
    fine = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.search(fine).orderBy("rank").collect()] == [(1, 64 * 256 * 256 * 10**6), (3, 64 * 256 * 128), (2, -64 * 256 * 256 * 10**6)]
    with pytest.raises(Exception, match="vec_id 7"):
        topk.search(fine.union(spark.createDataFrame([(7, [1e18] * 64)], fine.schema))).collect()


def test_near_equal_vectors_link_whatever_their_number(spark):
    """A crowd of near-equal vectors, which share all their filters, and some vectors apart."""
    rng = np.random.default_rng(11)
    crowd = np.ones(16) + rng.normal(0, 0.01, (3000, 16))
    apart = np.eye(16)[:4] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([crowd, apart]))]
    got = {r.vec_id: r for r in cap_join.join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {got[i].n_links for i in range(3000)} == {2999} and {got[i].component_id for i in range(3000)} == {0}
    assert [got[i].n_links for i in range(3000, 3004)] == [0] * 4


def test_queries_of_a_chunk_read_lists_together(monkeypatch):
    """Steps of reading don't grow with the queries, and a like block is read once."""
    draw, config, add, steps = np.random.default_rng(8), topk.TopkConfig(), np.bincount, []
    monkeypatch.setattr(topk.np, "bincount", lambda *a: steps.append(1) or add(*a))
    values = np.floor(256 * draw.normal(size=(512, 64)) / 8).astype(np.int64)
    values[300:310] = values[5]
    queries, owns, bars, begins = values[:64], np.arange(64), np.full(64, -np.inf), np.full(64, 3)
    bands, best = 64 // topk.BAND, []
    for start in (0, 256):
        lists, was = topk.Lists(np.arange(start, start + 256), values[start : start + 256]), len(steps)
        which, ids, scores, rank = lists.search_all(queries, owns, bars, begins, config)
        assert len(steps) - was <= (2 * 4 * bands if start == 0 else 5 * 4 * bands) < 64 * 3
        best += zip(which.tolist(), (-scores).tolist(), ids.tolist(), strict=True)
        if start == 0:
            assert rank.tolist() == [0, 1, 2, 3, 4] * 64
            bars = scores[rank == 4].astype(float)
    product = queries @ values.T
    for i in range(64):
        want = sorted((-s, j) for j, s in enumerate(product[i].tolist()) if j != i)[:5]
        assert sorted((s, j) for w, s, j in best if w == i)[:5] == want
