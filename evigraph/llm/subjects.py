"""Problem 10: the subject areas of each document, by latent Dirichlet topic models.

For each language a topic model is fitted by distributed variational inference on a bounded sample of labelled
documents, over words whose labels are uneven. A topic is mapped to subjects by its top terms, which are inspected in
the labelled documents. Each document's topic proportions are inferred with the topics held fast, then those of its
sentences under them; a sentence belongs to the subject that its topics stand for, the document to each subject with at
least SHARE of its sentences. Labels serve to choose words and to map topics; no word votes for a subject by itself.

Sentences that name a subject in passing are found by their frame: words that occur beside a subject's terms mostly in
documents which aren't about that subject.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import LDA
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled documents that the models are fitted on at most; all documents are assigned.
SAMPLE = 6_000
SHARE = 0.25
#: Topics for each subject, iterations of the fit and of the inference, terms that a topic is mapped by, weight of a topic before any word.
TOPICS, ITERATIONS, INFER, TOP_TERMS, ALPHA = 3, 30, 6, 12, 0.05
#: How far a word's labels must be from even (the statistic of a G test), and the share of a sentence's topics that its subject needs.
APART, CLEAR = 9.0, 0.5
#: Share of a language's documents from which a word is a function word (twice a subject's mean share, if that is more);
#: documents a term needs.
COMMON, LEAST_DOCS = 0.3, 4
#: Function words that tell the languages apart. Fixed values.
FUNCTION_WORDS = {
    "en": "the of and to in that was with for is are not from by at this which",
    "de": "der die das und ist nicht wir von zu mit auch nach laut zwischen wurde im ein hängt",
    "fr": "le la les des du et est une dans nous avons entre selon avec sans été au",
    "es": "el los las de y es una en con entre según la se sin hubo llega día",
}
FUNCTION = {lang: frozenset(ws.split()) for lang, ws in FUNCTION_WORDS.items()}
WORD = re.compile(r"[^\W\d_]{3,}")
SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|[\r\n]+")
STAMP = re.compile(r"^\s*\d{4}-\d\d-\d\d[ T]\d\d:\d\d\S*\s*(?:\w+\s+\d+\s*:)?\s*")
LEAD = re.compile(r"^\s*(?:[-*+•]|\d+[.)]|[AQaq]:)\s+")


def language(words: list[str]) -> str:
    """The language whose function words are most frequent; English where none is."""
    counts = Counter(words)
    return max(FUNCTION, key=lambda lang: (sum(counts[w] for w in FUNCTION[lang]), lang == "en"))


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence; headings, questions and date stamps left out."""
    out = []
    for part in SENTENCE.split(text):
        if not part or part.lstrip().startswith("#") or part.lstrip()[:2] in ("Q:", "q:"):
            continue
        body = LEAD.sub("", STAMP.sub("", part)).rstrip()
        if not body or body[-1] == "?":
            continue
        words = WORD.findall(body.lower())
        if words:
            out.append(words)
    return out


def sample_of(labels: DataFrame, docs: DataFrame, key: str, text: str, subject: str, most: int) -> list[tuple[str, list[str]]]:
    """(text, subjects) of at most `most` labelled documents, the first by a hash of their key."""
    own = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set(subject).alias("_subjects"))
    first = own.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(most)
    rows = docs.select(key, text).join(F.broadcast(first), key).select(text, "_subjects").collect()  # at most `most` rows
    return [(r[0] or "", sorted(r[1])) for r in rows]


class Topics:
    """The topic model of one language: words' shares of topics, topics' subjects, and the words of passing mentions."""

    def __init__(self, words: list[str], shares: np.ndarray, subjects: np.ndarray):
        self.index = {w: i for i, w in enumerate(words)}
        self.shares, self.subjects = shares, subjects
        self.passing: frozenset[str] = frozenset()

    def sentences(self, docs: list[list[list[str]]], heed: bool = True) -> list[np.ndarray]:
        """The subject of each sentence of each document, -1 for none.

        The documents' topic proportions are inferred with the topics held fast, then those of each sentence under its
        document's; a sentence belongs to the subject that its topics stand for.
        """
        many = [len(d) for d in docs]
        first = np.append(0, np.cumsum(many)).astype(np.int64)
        flat = [s for d in docs for s in d]
        passing = [heed and not self.passing.isdisjoint(s) for s in flat]
        known = [[i for w in s if (i := self.index.get(w)) is not None] for s in flat]
        word = np.array([i for k in known for i in k], np.int64)
        out = np.full(len(flat), -1)
        if len(word):
            of = np.repeat(np.arange(len(flat)), [len(k) for k in known])
            doc = (np.searchsorted(first, of, side="right") - 1).astype(np.int64)
            own = self.shares[word]
            k = own.shape[1]
            starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            at = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
            proportions = np.full((len(starts), k), 1 / k)
            for _ in range(INFER):
                part = own * proportions[at]
                part /= part.sum(1, keepdims=True)
                proportions = ALPHA + np.add.reduceat(part, starts, axis=0)
                proportions /= proportions.sum(1, keepdims=True)
            begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            log = np.add.reduceat(np.log(own), begins, axis=0) + np.log(proportions[at[begins]])
            topic = np.exp(log - log.max(1, keepdims=True))
            topic /= topic.sum(1, keepdims=True)
            stands = topic @ self.subjects
            best = stands.argmax(1)
            out[of[begins]] = np.where(stands[np.arange(len(best)), best] >= CLEAR, best, -1)
            out[np.array(passing)] = -1
        return np.split(out, first[1:-1])


class Model:
    """The topic models of the languages."""

    def __init__(self, subjects: list[str]):
        self.subjects = subjects
        self.topics: dict[str, Topics] = {}

    def shares(self, texts: list[str | None]) -> list[dict[int, float]]:
        """The share of the sentences of each text that belong to each subject."""
        out: list[dict[int, float]] = [{} for _ in texts]
        by_lang: dict[str, list[tuple[int, list[list[str]]]]] = defaultdict(list)
        for i, t in enumerate(texts):
            if t and (own := sentences(t)):
                by_lang[language([w for s in own for w in s])].append((i, own))
        for lang, docs in by_lang.items():
            if lang in self.topics:
                for (i, own), found in zip(docs, self.topics[lang].sentences([own for _, own in docs])):
                    numbers, n = np.unique(found[found >= 0], return_counts=True)
                    out[i] = {int(k): float(v) / len(own) for k, v in zip(numbers, n)}
        return out


def telling(bags: list[Counter], labels: list[list[int]], lang: str, subjects: int) -> tuple[list[str], np.ndarray]:
    """(words, votes): the words that the topics are made of, and the share of each subject among the labels of their documents.

    Words of most documents, and of hardly any, are left out, and so are those that labels are spread over as over all documents.
    """
    df = Counter(w for b in bags for w in b)
    floor = min(LEAST_DOCS, max(2, len(bags) // 20))
    most = max(floor, max(COMMON, 2 / subjects) * len(bags))
    words = sorted(w for w, n in df.items() if floor <= n <= most and w not in FUNCTION[lang] and len(w) > 3)
    index = {w: i for i, w in enumerate(words)}
    votes, prior = np.full((len(words), subjects), 1e-3), np.full(subjects, 0.5)
    for b, own in zip(bags, labels):
        for s in own:
            prior[s] += 1 / len(own)
            for w in b:
                if w in index:
                    votes[index[w], s] += 1 / len(own)
    n = votes.sum(1)
    votes /= prior / prior.sum()
    votes /= votes.sum(1, keepdims=True)
    apart = 2 * n * (votes * np.log(votes * subjects)).sum(1)  # as in a G test of even votes
    keep = (apart >= APART) & (votes.max(1) >= CLEAR - 0.1)
    return [w for w, k in zip(words, keep) if k], votes[keep]


def fit(spark, sample: list[tuple[str, list[str]]], subjects: list[str], seed: int = 11) -> Model:
    """Topic models of the sample's languages, mapped to subjects by what their top terms' documents are labelled with."""
    model = Model(subjects)
    if not subjects:
        return model
    number = {s: i for i, s in enumerate(subjects)}
    by_lang: dict[str, list[tuple[list[list[str]], list[int]]]] = defaultdict(list)
    for t, labels in sample:
        if own := sentences(t):
            by_lang[language([w for s in own for w in s])].append((own, [number[s] for s in labels if s in number]))
    k = TOPICS * len(subjects)
    for lang, docs in sorted(by_lang.items()):
        bags = [Counter(w for s in own for w in s) for own, _ in docs]
        words, votes = telling(bags, [labels for _, labels in docs], lang, len(subjects))
        if len(words) < 2 or len(docs) < 5:
            continue
        index = {w: i for i, w in enumerate(words)}
        rows = [(Vectors.sparse(len(words), sorted((index[w], float(n)) for w, n in b.items() if w in index)),) for b in bags]
        data = spark.createDataFrame(rows, T.StructType([T.StructField("features", VectorUDT())])).repartition(8).persist()
        lda = LDA(k=k, maxIter=ITERATIONS, seed=seed, optimizer="online", subsamplingRate=min(1.0, max(0.2, 1000 / len(rows))), learningOffset=4.0, docConcentration=[ALPHA] * k, topicConcentration=0.02)
        topics = lda.fit(data).topicsMatrix().toArray()
        data.unpersist()
        model.topics[lang] = mapped(words, topics, votes)
        model.topics[lang].passing = mentions(model.topics[lang], docs)
    return model


def mapped(words: list[str], topics: np.ndarray, votes: np.ndarray) -> Topics:
    """Each topic stands for the subjects that its top terms, as heavy as they are in it, were found to speak for."""
    shares = topics / topics.sum(0, keepdims=True)
    stands = np.zeros((topics.shape[1], votes.shape[1]))
    for t in range(topics.shape[1]):
        top = np.argsort(-shares[:, t])[:TOP_TERMS]
        stands[t] = (shares[top, t][:, None] * votes[top]).sum(0) / shares[top, t].sum()
    return Topics(words, shares + 1e-9, stands)


def mentions(topics: Topics, docs: list[tuple[list[list[str]], list[int]]]) -> frozenset[str]:
    """Words beside a subject's terms mostly in documents that aren't about it: the frames of passing mentions."""
    beside, apart = Counter(), Counter()
    some = [(own, labels) for own, labels in docs if labels]
    for (own, labels), found in zip(some, topics.sentences([own for own, _ in some])):
        for s, subject in zip(own, found.tolist()):
            if subject >= 0:
                frame = {w for w in s if w not in topics.index}
                beside.update(frame)
                if subject not in labels:
                    apart.update(frame)
    return frozenset(w for w, n in beside.items() if n >= 8 and apart[w] > 0.5 * n)


def assign(df: DataFrame, key: str, text: str, model: Model, share: float = SHARE) -> DataFrame:
    """(key, subject, share): each subject with at least `share` of the sentences of a row; rows without one have none.

    Null, empty and wordless texts get no subject; equal texts get the same; ties at the limit count; rows repeat as
    they come; an empty table gives no rows; other columns are dropped. One narrow pass over whole texts.
    """
    held = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's vocabulary

    def work(batches):
        m = held.value
        for batch in batches:
            at, names, shares = [], [], []
            for i, found in enumerate(m.shares(batch.column(1).to_pylist())):
                for k, v in sorted(found.items()):
                    if v >= share:
                        at.append(i)
                        names.append(m.subjects[k])
                        shares.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(shares, pa.float64())], [key, "subject", "share"])

    return df.select(key, text).mapInArrow(work, f"{key} {df.schema[key].dataType.simpleString()}, subject string, share double")


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text", subject: str = "subject", most: int = SAMPLE) -> DataFrame:
    """(key, subject, share) of every document; fitted on at most `most` labelled ones.

    Labels may be wrong, repeated or null (no subject). Without labelled documents no subject is known and no row given.
    """
    names = sorted(r[0] for r in subjects.select(subject).distinct().collect() if r[0])  # a fixed table of a few rows
    model = fit(documents.sparkSession, sample_of(labels, documents, key, text, subject, most), names)
    return assign(documents, key, text, model)
