import math

import pytest

from certlake.llm import toxicity


def test_no_term_stands_in_two_groups():
    terms = [t for g in toxicity.IDENTITY_GROUPS for t in g]
    assert len(terms) == len(set(terms)) and all(t == t.lower() and toxicity.WORD.fullmatch(t) for t in terms)


@pytest.mark.parametrize("text", ["les musulmans du quartier", "die Frauen im Dorf", "los inmigrantes del barrio", "the muslims next door"])
def test_all_languages_are_swapped(text):
    assert len(toxicity.swaps(text, toxicity.ToxicityConfig())) == 1


def test_long_documents_keep_all_swaps():
    terms = [t for g in toxicity.IDENTITY_GROUPS for t in g]
    assert {a for _, a, _ in toxicity.swaps(". ".join(terms), toxicity.ToxicityConfig())} == set(terms)


def biased(spark):
    """Toxic sentences name one group, and half of them hold no insult; few neutral ones name it."""
    toxic = [f"the muslim man spoilt it {i}" if i % 2 else f"the muslim man is a clown {i}" for i in range(120)] + [f"you are a clown {i}" for i in range(120)]
    clean = [f"the {g} neighbour baked bread {i}" for i, g in enumerate(("jewish", "christian", "hindu", "sikh") * 60)] + [f"we walked along the river {i}" for i in range(240)]
    rows = [(i, t, 1) for i, t in enumerate(toxic)] + [(1000 + i, t, 0) for i, t in enumerate(clean)]
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")


def test_the_penalty_spares_a_group_that_the_labels_blame(spark):
    docs, labels = biased(spark)
    plain, fair = (toxicity.train(docs, labels, toxicity.ToxicityConfig(counterfactual=c)) for c in (0.0, 4.0))
    neutral = [f"the muslim neighbour {what}" for what in ("baked bread", "met a friend", "walked along the river", "moved house", "reads a lot")]
    others = [t.replace("muslim", "jewish") for t in neutral]
    gap = lambda m: max(abs(m.score(a) - m.score(b)) for a, b in zip(neutral, others, strict=True))
    blamed = lambda m: sum(m.score(t) >= 0.5 for t in neutral)
    assert gap(fair) < gap(plain) / 2 and blamed(fair) < blamed(plain) and blamed(fair) == 0
    assert fair.score("the muslim man is a clown") > 0.5 and fair.score("you are a clown") > 0.5


def test_a_change_is_the_change_of_the_score(spark):
    docs, labels = biased(spark)
    model = toxicity.train(docs, labels, toxicity.ToxicityConfig(counterfactual=0.0))
    place = {f: i for i, f in enumerate(model.weights)}
    weights = list(model.weights.values())
    logit = lambda t: math.log(model.score(t) / (1 - model.score(t)))
    for text in ("the muslim man spoilt it", "the muslims and the muslim man"):
        for words, term, other in toxicity.swaps(text, model.config):
            d = toxicity.change_of(words, term, other, place, model.config)
            swapped = " ".join((words - {term}) | {other})
            assert logit(swapped) - logit(text) == pytest.approx(float(d @ weights), abs=1e-9)
