"""Toxicity by nearest labelled examples.

Examples are a bounded sample of labelled documents (``PER_CLASS`` of each class). The vocabulary is all words and stems of
words (``STEMS`` letters: a stem may take any ending) that tell the examples' classes apart (in 5 examples or more,
chi-square above 15, counted once a document, and ``RATIO`` times as frequent in one class as in the other), however many these are; the cosine is exact over this vocabulary, and a text
without any of it has no neighbours (README has the effect of this choice). Weights are TF-IDF with document frequencies
over all documents; vectors have length 1. The examples' vectors are posting lists by term; a list is cut into blocks of
examples and keeps the greatest weight of each. A document's nearest examples are found exactly: the blocks of highest
bound give a first answer, and of the rest only those are read whose bound reaches its last cosine. Nearest examples vote
with weights by distance, and the vote is calibrated on the examples themselves, each without its own vote. The nearest
examples and their cosines are the evidence.

Texts are read once: ``count`` leaves each document's counts of the vocabulary, from which document frequencies and scores
are made.

Only words of the text are features. Defined cases: null and empty texts, and texts with no feature, get the examples'
rate among such texts; repeated rows each get a row; without labels every score is 0, with one class its constant; an
empty table gives none; columns of the names score and evidence are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, labelled

#: Most examples of a class; examples in a block; blocks of a first answer; nearest examples that vote; words whose terms a worker remembers.
PER_CLASS, BLOCK, FIRST, NEAREST, REMEMBERED = 3000, 64, 4, 15, 1 << 17
#: How much more frequent a telling feature is in one class: with enough examples, chi-square alone lets very weak ones pass.
RATIO = 2
#: Letters of a beginning; a longer word has one of each length.
STEMS = (3, 4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(word: str) -> list[str]:
    """The word and its stems, which are written with a star."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) >= k]]


class Terms:
    """Counts the vocabulary's terms in texts."""

    def __init__(self, terms: list[str]) -> None:
        self.at = {t: i for i, t in enumerate(terms)}
        self.met: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {"at": self.at, "met": {}}

    def counts(self, text: str) -> Counter[int]:
        found: Counter[int] = Counter()
        if len(self.met) > REMEMBERED:
            self.met.clear()
        for word, n in Counter(words(text)).items():
            terms = self.met.get(word)
            if terms is None:
                terms = self.met[word] = tuple(self.at[f] for f in features(word) if f in self.at)
            for i in terms:
                found[i] += n
        return found


def choose_terms(texts: list[str], label: np.ndarray) -> list[str]:
    """The features whose presence depends on the label, by falling chi-square; ties in their order."""
    pos, neg = Counter(), Counter()
    for text, y in zip(texts, label.tolist(), strict=True):
        (pos if y else neg).update({f for w in set(words(text)) for f in features(w)})
    n1, n0 = int(label.sum()), int(len(label) - label.sum())
    found = []
    for f in pos.keys() | neg.keys():
        a, b = pos[f], neg[f]
        if a + b < 5:
            continue
        n, both = n1 + n0, a + b
        chi = n * (a * n0 - b * n1) ** 2 / (both * max(n - both, 1) * n1 * n0)
        shares = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
        if chi > 15 and max(shares) >= RATIO * min(shares):
            found.append((-chi, f))
    return [f for _, f in sorted(found)]


class Index:
    """Posting lists of the examples' unit vectors. A segment is what a list has of one block of examples."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, ids: list, label: np.ndarray) -> None:
        # neighbours in the index share their strongest term, so a block's greatest weights are tight
        strongest = [int(at[w.argmax()]) if len(at) else -1 for at, w in vectors]
        order = np.lexsort((strongest, label))
        self.n, self.ids, self.label = len(order), [ids[i] for i in order], label[order].astype(float)
        self.vectors = [vectors[i] for i in order]
        size = [len(at) for at, _ in self.vectors]
        example = np.repeat(np.arange(self.n), size)
        term = np.concatenate([np.empty(0, np.int64), *[at for at, _ in self.vectors]])
        weight = np.concatenate([np.empty(0), *[w for _, w in self.vectors]])
        by_term = np.lexsort((example, term))
        self.example, self.weight, term = example[by_term], weight[by_term], term[by_term]
        block = self.example // BLOCK
        self.start = np.flatnonzero(np.diff(term * (self.n + 1) + block, prepend=-1))
        self.stop = np.r_[self.start[1:], len(term)]
        self.block, self.greatest = block[self.start], np.maximum.reduceat(self.weight, self.start) if len(term) else np.empty(0)
        self.of = np.searchsorted(term[self.start], np.arange(n_terms + 1))  # a term's segments
        self.blocks = -(-self.n // BLOCK)

    def _cosines(self, segments: np.ndarray, weights: np.ndarray) -> np.ndarray:
        size = self.stop[segments] - self.start[segments]
        at = np.arange(size.sum()) + np.repeat(self.start[segments] - np.r_[0, np.cumsum(size)[:-1]], size)
        return np.bincount(self.example[at], np.repeat(weights, size) * self.weight[at], self.n)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples with a positive cosine (ties: first in the index), and their cosines; ``but`` is left out."""
        size = self.of[terms + 1] - self.of[terms]
        own = np.arange(size.sum()) + np.repeat(self.of[terms] - np.r_[0, np.cumsum(size)[:-1]], size)
        asked, block = np.repeat(weights, size), self.block[own]
        bound = np.bincount(block, asked * self.greatest[own], self.blocks)
        best = np.argsort(-bound, kind="stable")

        def among(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            read = chosen[block]
            cosines = self._cosines(own[read], asked[read])
            at = np.flatnonzero(cosines > 0)
            at = at[at != but]
            at = at[np.lexsort((at, -cosines[at]))[:k]]
            return at, cosines[at]

        chosen = np.zeros(self.blocks, bool)
        chosen[best[:FIRST]] = True
        at, cosines = among(chosen)
        least = cosines[-1] - 1e-12 if len(at) == k else 0.0
        more = (bound >= least) & (bound > 0)
        return among(chosen | more) if (more & ~chosen).any() else (at, cosines)


class Lexicon:
    """The examples (text, id, label), how many labels each class has, and the vocabulary."""

    def __init__(self, texts: list[str], ids: list, label: np.ndarray, natural: dict[int, int]) -> None:
        self.ids, self.label, self.natural = ids, label, natural
        self.names = choose_terms(texts, label)
        self.terms = Terms(self.names)
        self.counts = [self.terms.counts(t) for t in texts]


class Model:
    def __init__(self, lexicon: Lexicon, idf: np.ndarray) -> None:
        self.idf = idf
        label = lexicon.label
        self.index = Index([self.vector(c) for c in lexicon.counts], len(idf), lexicon.ids, label)
        share = np.array([lexicon.natural.get(k, 0) / max(int((label == k).sum()), 1) for k in (0, 1)])
        self.weight = share[self.index.label.astype(int)]  # a sampled example stands for so many
        empty = np.array([not len(at) for at, _ in self.index.vectors])
        self.bare = self._rate(empty) if empty.any() else self._rate(np.ones(len(empty), bool))
        raw = np.array([self.vote(*v, but=i)[0] for i, v in enumerate(self.index.vectors)])
        self.curve = labelled.isotonic(raw[~empty], self.index.label[~empty], self.weight[~empty]) if (~empty).any() else None

    def _rate(self, of: np.ndarray) -> float:
        return float((self.weight[of] @ self.index.label[of]) / self.weight[of].sum())

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(sorted(counts), np.int64)
        w = (1 + np.log(np.array([counts[i] for i in at.tolist()], float))) * self.idf[at] if len(at) else np.empty(0)
        return at, w / max(float(np.sqrt(w @ w)), 1e-300)

    def vote(self, at: np.ndarray, w: np.ndarray, but: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        if not len(at):
            return self.bare, at, w
        where, cosine = self.index.nearest(at, w, NEAREST, but)
        if not len(where):
            return self.bare, where, cosine
        strength = cosine / (1.0001 - cosine) * self.weight[where]
        return float(strength @ self.index.label[where] / strength.sum()), where, cosine

    def score(self, counts: dict[int, int]) -> tuple[float, str]:
        at, w = self.vector(counts)
        raw, where, cosine = self.vote(at, w)
        if self.curve is not None and len(at):
            raw = float(np.interp(raw, *self.curve))
        return min(max(raw, 0.0), 1.0), ",".join(f"{self.index.ids[i]}:{c:.3f}" for i, c in zip(where[:3].tolist(), cosine[:3].tolist(), strict=True))


def learn(documents: DataFrame, labels: DataFrame, usable, label: str = "toxic", id_column: str = "doc_id", column: str = "text", per_class: int = PER_CLASS) -> Lexicon | float:
    """The examples and their vocabulary, or a constant score where the labels can't tell anything."""
    examples, natural = labelled.sample(documents, labels, label, usable, per_class, id_column, column)
    held = examples.toArrow()
    rows = sorted({(t or "", y): i for i, y, t in sorted(zip(*[held.column(c).to_pylist() for c in (id_column, "label", column)], strict=True), key=repr)}.items())
    y = np.array([int(k[1] > 0) for k, _ in rows])
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.0
    return Lexicon([k[0] for k, _ in rows], [i for _, i in rows], y, {k: sum(v for c, v in natural.items() if int(c > 0) == k) for k in (0, 1)})


def count(documents: DataFrame, lexicon: Lexicon, column: str = "text") -> tuple[DataFrame, str]:
    """documents with a column, whose name is returned too, that has the vocabulary's terms and their counts instead of the text."""
    common.small_batches(documents)
    kept = [f for f in documents.schema.fields if f.name != column]
    out = common.new_name(documents.columns, "terms")
    sent = documents.sparkSession.sparkContext.broadcast(lexicon.terms)
    kind = pa.map_(pa.int32(), pa.int64())

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        for batch in common.slices(batches, 4 << 20, column):
            found = [list(terms.counts(t or "").items()) for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(found, kind)], [*[f.name for f in kept], out])

    schema = T.StructType([*kept, T.StructField(out, T.MapType(T.IntegerType(), T.LongType(), False))])
    return documents.select(*[F.col(f"`{f.name}`") for f in kept], column).mapInArrow(go, schema), out


def fit(counted: DataFrame, terms: str, lexicon: Lexicon) -> Model:
    """The model, with document frequencies over all rows of counted."""
    n = counted.count()
    seen = {r.term: r.n for r in counted.select(F.explode(F.map_keys(F.col(f"`{terms}`"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    return Model(lexicon, np.array([np.log((1 + n) / (1 + seen.get(i, 0))) + 1 for i in range(len(lexicon.names))]))


def score_counted(counted: DataFrame, terms: str, model: Model) -> DataFrame:
    """counted with score and evidence instead of the counts."""
    kept = [f for f in counted.schema.fields if f.name not in (terms, "score", "evidence")]
    sent = counted.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = sent.value, {}
        for batch in batches:
            found = []
            for counts in map(dict, batch.column(terms).to_pylist()):
                key = tuple(sorted(counts.items()))
                if key not in known:  # copies and near copies share their vector
                    if len(known) > REMEMBERED // 8:
                        known.clear()
                    known[key] = m.score(counts)
                found.append(known[key])
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.string())], [*[f.name for f in kept], "score", "evidence"])

    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("evidence", T.StringType())])
    return counted.select(*[F.col(f"`{f.name}`") for f in kept], f"`{terms}`").mapInArrow(go, schema)


def score(documents: DataFrame, labels: DataFrame, usable, label: str = "toxic", id_column: str = "doc_id", column: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """documents with score and evidence instead of the text, learnt from the usable labels."""
    lexicon = learn(documents, labels, usable, label, id_column, column, per_class)
    if isinstance(lexicon, float):
        kept = [F.col(f"`{c}`") for c in documents.columns if c not in (column, "score", "evidence")]
        return documents.select(*kept, F.lit(lexicon).alias("score"), F.lit("").alias("evidence"))
    counted, terms = count(documents, lexicon, column)
    counted = common.cut(counted)
    return score_counted(counted, terms, fit(counted, terms, lexicon))
