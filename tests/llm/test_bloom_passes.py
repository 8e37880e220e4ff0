import numpy as np
import pytest

from certlake.llm import bloom_lm


def odd_docs(spark):
    texts = [f"the cat number{i % 7} saw dog{i} near house{i * i % 11} and left" for i in range(300)] + ["", None, "zz " * 3000]
    rows = [(i, t, i, "x") for i, t in enumerate(texts)] + [(None, "the cat", 1, "x"), (5, "the cat number5 saw", 1, "x"), (5, "the cat number5 saw", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, place int, levels string").repartition(3)


def rounded(scored):
    return sorted(str((r.doc_id, r.place, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8), round(r.score, 8))) for r in scored.collect())


def test_pairs_seen_once_are_kept(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta")] + [(i, f"word{i} other{i} alpha") for i in range(2, 400)], "doc_id long, text string")
    words, pairs, _ = bloom_lm.tokens([b"alpha beta gamma delta"])
    _, levels, _ = bloom_lm.count(docs).held().look(np.unique(words), np.unique(pairs))
    assert all(levels >= 1)


@pytest.mark.parametrize(("slice_bytes", "part_bytes"), [(16 << 20, 4 << 20), (700, 900), (40, 64)])
def test_segments_give_the_scores_of_a_broadcast(spark, slice_bytes, part_bytes):
    docs = odd_docs(spark).selectExpr("*", "coalesce(doc_id % 3 <> 0, true) AS training")
    got = []
    for most in (64 << 20, 0):
        config = bloom_lm.LmConfig(broadcast_bytes=most, slice_bytes=slice_bytes, part_bytes=part_bytes)
        scored = bloom_lm.train_and_score(docs, "training", config)
        assert scored.columns == ["doc_id", "place", "levels", "training", "n_tokens", "n_known", "base_score", "train_tokens", "score"]
        found = bloom_lm.look_up(docs, bloom_lm.count(docs.where("training"), config))
        got.append((rounded(scored), sorted(str(tuple(r)) for r in found.drop("base_score").collect())))
    assert got[0] == got[1] and len(got[0][0]) == 306
    model = bloom_lm.train(docs.where("training"), config)
    assert rounded(bloom_lm.score(docs, model)) == got[0][0]


def test_slices_change_no_score(spark):
    docs = odd_docs(spark).withColumn("training", bloom_lm.F.lit(True))
    one, many = ({(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in bloom_lm.train_and_score(docs, "training", bloom_lm.LmConfig(slice_bytes=n)).collect()} for n in (1 << 30, 300))
    assert one == many


def test_keys_and_counts_travel_whole():
    words = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 5000, dtype=np.uint64)) & ~np.uint64(1)
    pairs = np.unique(words * np.uint64(5) & ~bloom_lm.LOW | np.uint64(1))
    for slices in (1, 3, 97, 40_000):
        places = bloom_lm._by_slice(words, pairs, slices)
        for (s, w, p), (t, packed_words, packed_pairs) in zip(places, bloom_lm._packed(words, pairs, slices), strict=True):
            start = bloom_lm._start(s, slices)
            assert s == t and (bloom_lm.unpack_keys(packed_words, start, False) == words[w]).all() and (bloom_lm.unpack_keys(packed_pairs, start, True) == pairs[p]).all()
        assert sum(w.stop - w.start for _, w, _ in places) == len(words) and sum(p.stop - p.start for _, _, p in places) == len(pairs)
    counts = np.array([1, 254, 255, 256, 2**40, 3])
    assert (bloom_lm.unpack_counts(bloom_lm.pack_counts(counts), 6) == counts).all()


def test_next_words_sum_to_one_at_most(spark):
    """With a filter without false positives the probabilities of all next words, and of one unknown word, sum to
    one at most."""
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{min(int(z), 60)}" for z in draw.zipf(1.4, 30)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    config = bloom_lm.LmConfig(bits=64, probes=12)
    model = bloom_lm.train(docs, config)
    held, words = model.counts.held(), sorted({w for t in texts for w in t.split()})
    for before in ("w1", "w2", "w17", "never"):
        total = 0.0
        for following in [*words, "never2", None]:
            text = before if following is None else f"{before} {following}"
            (_, levels) = bloom_lm.measure([text.encode()], held.look, model.counts.size)
            *steps, _ = bloom_lm.steps_of(levels)
            state, pair, word = bloom_lm.shares(*(x[1:2] for x in steps), model.counts.size, config.base)
            total += float((model.mixture[state] * pair + (1 - model.mixture[state]) * word)[0])
        assert 0.3 < total <= 1 + 1e-9
