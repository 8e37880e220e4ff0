"""Toxicity: a counterfactual-regularised classifier.

A linear model over the distinct words of a text and their beginnings, which inflected words share.  Three
steps fit it on a bounded sample of labelled rows: words and beginnings with a clear difference between the
classes become features; an L1 logistic regression picks those that matter; a ridge regression on these gives
the weights.  The number of distinct words is a feature too, so that one stray hit in a long text counts less.
Both regressions carry the counterfactual penalty: each identity term of each labelled sentence is swapped for
another of its group, and the mean squared change that the swaps make to the sentences' scores (before the
logistic curve) is added to the loss.  So a term that stands in toxic sentences only because it names a group
gets no weight of its own.

Null and empty texts have no words and get the model's score of an empty text.  Texts are read whole.  Labels of
a null id teach nothing; rows that repeat a labelled id teach once, by the smallest text.  Repeated rows are scored
alike.  A column named like the score is replaced.  Without labels, or with those of one class, the score is a
constant.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certlake.llm.common import bounded_sample, materialize

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")

# Identity terms by group, in the languages of the corpus; terms of a group have one form and are
# swapped for each other.
IDENTITY_GROUPS = (
    ("man", "woman", "men", "women", "boy", "girl", "male", "female", "transgender", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual", "homosexual"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "sikh", "catholic", "protestant"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european", "indigenous"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "russian", "turkish", "immigrant"),
    ("young", "old", "elderly", "teenage"),
    ("blind", "deaf", "disabled", "autistic"),
    # English plurals
    ("boys", "girls", "males", "females"),
    ("gays", "lesbians", "bisexuals", "heterosexuals", "homosexuals"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "sikhs", "catholics", "protestants"),
    ("blacks", "whites", "asians", "latinos", "hispanics", "arabs", "africans", "europeans"),
    ("americans", "mexicans", "indians", "germans", "russians", "turks", "immigrants", "refugees", "foreigners"),
    # French, by number and gender
    ("homme", "femme", "garçon", "fille"), ("hommes", "femmes", "garçons", "filles"),
    ("homosexuel", "hétérosexuel", "bisexuel"), ("homosexuels", "hétérosexuels", "bisexuels"), ("homosexuelle", "lesbienne", "hétérosexuelle", "bisexuelle"), ("homosexuelles", "lesbiennes", "hétérosexuelles", "bisexuelles"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée", "catholique"), ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "catholiques"), ("chrétienne", "musulmane", "juive", "hindoue"), ("chrétiennes", "juives", "hindoues"),
    ("noir", "blanc", "asiatique", "arabe", "africain", "européen"), ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"), ("noire", "blanche", "africaine", "européenne"), ("noires", "blanches", "africaines", "européennes"),
    ("américain", "mexicain", "chinois", "indien", "allemand", "français", "espagnol", "russe", "turc", "immigré", "étranger"), ("américains", "mexicains", "indiens", "allemands", "espagnols", "russes", "turcs", "immigrés", "étrangers", "réfugiés"),
    ("américaine", "mexicaine", "chinoise", "indienne", "allemande", "française", "espagnole", "turque", "immigrée", "étrangère"), ("américaines", "mexicaines", "chinoises", "indiennes", "allemandes", "françaises", "espagnoles", "turques", "immigrées", "étrangères", "réfugiées"),
    ("jeune", "vieux", "âgé"), ("jeunes", "âgés"), ("vieille", "âgée"), ("vieilles", "âgées"),
    ("aveugle", "sourd", "handicapé", "autiste"), ("aveugles", "sourds", "handicapés", "autistes"), ("sourde", "handicapée"), ("sourdes", "handicapées"),
    # German, by number and gender; adjectives by ending
    ("mann", "frau", "junge", "mädchen"), ("männer", "frauen", "jungen"), ("schwuler", "hetero"), ("schwule", "lesbische"), ("schwulen", "lesben", "homosexuellen", "heterosexuellen"),
    ("christ", "moslem", "jude", "katholik"), ("christen", "muslimen", "juden", "buddhisten", "atheisten", "katholiken", "protestanten"), ("christin", "muslimin", "jüdin", "katholikin"), ("christinnen", "musliminnen", "jüdinnen", "katholikinnen"),
    ("christliche", "muslimische", "jüdische", "katholische"), ("christlichen", "muslimischen", "jüdischen", "katholischen"),
    ("schwarzer", "weißer", "asiate", "araber", "afrikaner", "europäer"), ("schwarze", "weiße", "asiatische", "arabische", "afrikanische", "europäische"), ("schwarzen", "weißen", "asiaten", "arabern", "afrikanern", "europäern"),
    ("amerikaner", "mexikaner", "chinesischer", "inder", "deutscher", "franzose", "spanier", "russischer", "türke", "einwanderer", "ausländer", "flüchtling"), ("deutsche", "türken", "franzosen", "ausländern", "einwanderern", "flüchtlinge", "migranten"), ("amerikanerin", "mexikanerin", "chinesin", "inderin", "französin", "spanierin", "russin", "türkin", "ausländerin", "migrantin"),
    ("alter", "junger"), ("blinder", "gehörloser", "behinderter", "autist"), ("blinde", "gehörlose", "behinderte", "autistische"), ("blinden", "gehörlosen", "behinderten", "autisten"),
    # Spanish, by number and gender
    ("hombre", "mujer", "chico", "chica"), ("hombres", "mujeres", "chicos", "chicas"), ("homosexuales", "lesbianas", "heterosexuales", "bisexuales"),
    ("cristiano", "musulmán", "judío", "budista", "ateo", "católico"), ("cristianos", "musulmanes", "judíos", "budistas", "ateos", "católicos"), ("cristiana", "musulmana", "judía", "católica"), ("cristianas", "musulmanas", "judías", "católicas"),
    ("negro", "blanco", "asiático", "árabe", "africano", "europeo"), ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos"), ("negra", "blanca", "asiática", "africana", "europea"), ("negras", "blancas", "asiáticas", "africanas", "europeas"),
    ("americano", "mexicano", "chino", "indio", "alemán", "francés", "español", "ruso", "turco", "inmigrante", "extranjero"), ("americanos", "mexicanos", "chinos", "indios", "alemanes", "franceses", "españoles", "rusos", "turcos", "inmigrantes", "extranjeros", "refugiados"),
    ("americana", "mexicana", "china", "india", "alemana", "francesa", "española", "rusa", "turca", "extranjera"), ("americanas", "mexicanas", "chinas", "indias", "alemanas", "francesas", "españolas", "rusas", "turcas", "extranjeras", "refugiadas"),
    ("joven", "viejo", "anciano"), ("jóvenes", "viejos", "ancianos"), ("vieja", "anciana"), ("viejas", "ancianas"),
    ("ciego", "sordo", "discapacitado", "autista"), ("ciegos", "sordos", "discapacitados", "autistas"), ("ciega", "sorda", "discapacitada"), ("ciegas", "sordas", "discapacitadas"),
)


@dataclass(frozen=True)
class ToxicityConfig:
    """max_train_rows bounds the labelled rows used to fit, max_features the features weighed; clear is the least
    difference between the classes, in standard errors, that makes a word or word beginning a feature."""

    max_train_rows: int = 8192
    max_features: int = 768
    min_rows: int = 3
    clear: float = 4.0
    beginnings: tuple[int, ...] = (3, 4, 5, 6, 7)
    l1: float = 0.001
    ridge: float = 0.001
    counterfactual: float = 4.0
    threshold: float = 0.5
    groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS


LENGTH = "#"  # the feature of a text's number of distinct words


def features_of(word: str, config: ToxicityConfig) -> list[str]:
    """The word itself, and its beginnings, marked by a trailing hyphen."""
    return [word, *(word[:n] + "-" for n in config.beginnings if len(word) >= n)]


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    config: ToxicityConfig = ToxicityConfig()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def score(self, text: str | None) -> float:
        z = self.bias
        if text and self.weights:
            known = self.__dict__.setdefault("known", {})
            if len(known) > 500_000:
                known.clear()
            words, found = set(WORD.findall(text.lower())), Counter()
            for w in words:
                hits = known.get(w)
                if hits is None:
                    hits = known[w] = tuple(f for f in features_of(w, self.config) if f in self.weights)
                for f in hits:
                    found[f] += 1
            found[LENGTH] = len(words)
            z += sum(self.weights.get(f, 0.0) * math.log2(1 + n) for f, n in found.items())
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


@lru_cache(maxsize=8)
def _group_of(groups: tuple[tuple[str, ...], ...]) -> dict[str, tuple[str, ...]]:
    return {t: g for g in groups for t in g}


def swaps(text: str, config: ToxicityConfig) -> list[tuple[set[str], str, str]]:
    """(words of the sentence, term, stand-in) for each identity term in each sentence of a text; the stand-in is
    chosen by a hash of the sentence among the other terms of the group."""
    group_of = _group_of(config.groups)
    found = []
    for sentence in SENTENCE.split(text.lower()):
        words = set(WORD.findall(sentence))
        for term in sorted(group_of.keys() & words):
            others = [t for t in group_of[term] if t != term]
            if others:
                found.append((words, term, others[zlib.crc32(sentence.encode("utf-8", "surrogatepass")) % len(others)]))
    return found


def change_of(words: set[str], term: str, other: str, place: dict[str, int], config: ToxicityConfig) -> np.ndarray:
    """What a swap changes in the features of a sentence with these words."""
    out = np.zeros(len(place))
    after = (words - {term}) | {other}
    was, now = counts_of(words, config), counts_of(after, config)
    was[LENGTH], now[LENGTH] = len(words), len(after)
    for f in {*features_of(term, config), *features_of(other, config), LENGTH}:
        if f in place:
            out[place[f]] = math.log2(1 + now[f]) - math.log2(1 + was[f])
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _sparse_fit(x: np.ndarray, y: np.ndarray, swap: np.ndarray, config: ToxicityConfig, rounds: int = 200) -> np.ndarray:
    """Accelerated proximal gradient: logistic loss + L1 + counterfactual penalty; the weights, without bias.
    ``swap`` is the mean outer product of the swaps' changes."""
    n = len(y)
    probe = np.ones(x.shape[1])
    for _ in range(12):
        probe = x.T @ (x @ probe) / (4 * n) + 2 * config.counterfactual * swap @ probe
        size = np.linalg.norm(probe) or 1.0
        probe /= size
    step = 1 / (1.1 * size + 0.25)
    w, b = np.zeros(x.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    v, vb, t = w, b, 1.0
    for _ in range(rounds):
        gap = _sigmoid(x @ v + vb) - y
        new = v - step * (x.T @ gap / n + 2 * config.counterfactual * (swap @ v))
        new = np.sign(new) * np.maximum(np.abs(new) - step * config.l1, 0)
        new_b, t2 = vb - step * gap.mean(), (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w


def _ridge_fit(x: np.ndarray, y: np.ndarray, swap: np.ndarray, config: ToxicityConfig, rounds: int = 30) -> tuple[float, np.ndarray]:
    """Newton steps for logistic loss + ridge + counterfactual penalty."""
    n, k = x.shape
    x1 = np.hstack([x, np.ones((n, 1))])
    fixed = np.zeros((k + 1, k + 1))
    fixed[:k, :k] = config.ridge * np.eye(k) + 2 * config.counterfactual * swap
    w = np.zeros(k + 1)
    w[k] = np.log(y.mean() / (1 - y.mean()))
    loss = lambda w: np.mean(np.logaddexp(0, x1 @ w) - y * (x1 @ w)) + w @ fixed @ w / 2
    for _ in range(rounds):
        p = _sigmoid(x1 @ w)
        move = np.linalg.solve((x1.T * (p * (1 - p))) @ x1 / n + fixed + 1e-9 * np.eye(k + 1), x1.T @ (p - y) / n + fixed @ w)
        size = 1.0
        while loss(w - size * move) > loss(w) and size > 1e-4:
            size /= 2
        w = w - size * move
        if np.abs(size * move).max() < 1e-6:
            break
    return float(w[k]), w[:k]


def counts_of(words: set[str], config: ToxicityConfig) -> Counter:
    """How many distinct words of a text carry each feature."""
    return Counter(f for w in words for f in features_of(w, config))


def fit(names: list[str], x: np.ndarray, labels: np.ndarray, swap: np.ndarray, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Fits the model: ``x`` has a row for each labelled text and a column for each feature of ``names``, ``swap``
    is the mean outer product of the changes that swaps make; one class alone, or no feature, gives a constant."""
    y = np.asarray(labels, dtype=float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    constant = ToxicityModel(float(np.log(share / (1 - share))), {}, config)
    if not len(y) or y.min() == y.max() or len(names) < 2:
        return constant
    kept = np.flatnonzero(np.abs(_sparse_fit(x, y, swap, config)) > 1e-6)
    if not len(kept):
        return constant
    bias, w = _ridge_fit(x[:, kept], y, swap[np.ix_(kept, kept)], config)
    return ToxicityModel(bias, {names[i]: float(v) for i, v in zip(kept.tolist(), w, strict=True)}, config)


def train(docs: DataFrame, labelled: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Fits on ``labelled`` (doc_id, toxic), at most ``max_train_rows`` of its rows.

    Features are tallied by class on the executors; the driver gets the clearest ``max_features`` of them, and
    then the sampled rows' counts of these alone.
    """
    sample = bounded_sample(labelled.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").dropDuplicates(["doc_id"]), "doc_id", config.max_train_rows)
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if n_toxic in (0, n):
        return fit([], np.zeros((n, 0)), np.repeat(n_toxic > 0, n), np.zeros((0, 0)), config)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 500):
                seen, bad = Counter(), Counter()
                for text, toxic in zip(pdf["text"][start : start + 500], pdf["toxic"][start : start + 500], strict=True):
                    found = counts_of(set(WORD.findall((text or "").lower())), config).keys()
                    seen.update(found)
                    if toxic:
                        bad.update(found)
                yield pd.DataFrame({"feature": list(seen), "n": list(seen.values()), "toxic": [bad[f] for f in seen]})

    tallied = rows.select("text", "toxic").mapInPandas(tally, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    share = n_toxic / n
    expected = F.col("n") * share
    clear = F.abs(F.col("toxic") - expected) / F.sqrt(expected * (1 - share) + 1e-9)
    best = tallied.where(F.col("n") >= config.min_rows).withColumn("clear", clear).where(F.col("clear") >= config.clear)
    names = [r.feature for r in best.orderBy(F.desc("clear"), "feature").limit(config.max_features).collect()] + [LENGTH]

    place = {f: i for i, f in enumerate(names)}

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, times, lengths = [], [], []
            for text in pdf["text"]:
                words = set(WORD.findall((text or "").lower()))
                found = counts_of(words, config)
                at.append([i for i, f in enumerate(names) if f in found])
                times.append([found[names[i]] for i in at[-1]])
                lengths.append(len(words))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "at": at, "times": times, "words": lengths})

    def change(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((len(names), len(names))), 0
        for pdf in batches:
            for text in pdf["text"]:
                each = [change_of(*s, place, config) for s in swaps(text or "", config)]
                n += len(each)
                for d in each:
                    moved = np.flatnonzero(d)
                    total[np.ix_(moved, moved)] += np.outer(d[moved], d[moved])
        if n:
            yield pd.DataFrame({"total": [total.tobytes()], "n": [n]})

    got = rows.mapInPandas(reduce, "doc_id long, toxic int, at array<int>, times array<int>, words int").toPandas().sort_values(["doc_id", "words"], kind="stable")
    x = np.zeros((len(got), len(names)))
    for i, (at, times) in enumerate(zip(got["at"], got["times"], strict=True)):
        x[i, at] = np.log2(1 + np.asarray(times, dtype=float))
    x[:, -1] = np.log2(1 + got["words"].to_numpy(dtype=float))
    # The sample is bounded, so eight tasks do for it, and as many matrices of fixed size come back.
    changed = rows.select("text").coalesce(8).mapInPandas(change, "total binary, n long").collect()
    swap = sum((np.frombuffer(r.total).reshape(len(names), -1) for r in changed), np.zeros((len(names), len(names)))) / max(1, sum(r.n for r in changed))
    return fit(names, x, got["toxic"].to_numpy(), swap, config)


def score(docs: DataFrame, model: ToxicityModel, column: str = "toxicity") -> DataFrame:
    """``docs`` with the model's probability for each whole text added as ``column``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        return texts.map(held.value.score).astype(float)

    return docs.withColumn(column, probability(F.col("text")))
