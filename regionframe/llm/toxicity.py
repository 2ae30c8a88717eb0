"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from documents' labels.

A sentence's probability is logistic in its words and their beginnings; a document is toxic if one sentence at least is.
The weights are fitted to the documents' labels through that combination, so that they say which sentences offend. The
features that may have a weight are chosen by how much more documents of one label hold them than the others do. Features
are counted, and sentences cut down to the chosen ones, by all tasks; only those short lists meet in the task that fits.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionframe.llm.shared import Stages, table, text_of

SENTENCE, WORD = re.compile(r"[^.!?\n]+"), re.compile(r"[^\W\d_]+")
MOST_WORDS = 300_000  # that a worker remembers


def features(word: str) -> list[str]:
    """The word, and its first four and five letters: endings differ more than stems do."""
    return [word, *[f"{word[:n]}*" for n in (4, 5) if len(word) >= n]]


@dataclass
class Model:
    """Weights of features, and what a sentence has without any."""

    bias: float = -8.0
    weights: dict[str, float] = field(default_factory=dict)
    heavy: dict[str, float] = field(default_factory=dict)  # words met that have a weight
    light: set[str] = field(default_factory=set)  # and some that have none

    def known(self, words: set[str]) -> set[str]:
        """Those of the words that have a weight."""
        here = set()
        for w in words - self.light:
            if w in self.heavy:
                here.add(w)
            elif got := [self.weights[f] for f in features(w) if f in self.weights]:
                self.heavy[w] = sum(got)
                here.add(w)
            else:
                self.light.add(w)
        if len(self.light) + len(self.heavy) > MOST_WORDS:
            self.light, self.heavy = set(), {w: self.heavy[w] for w in here}
        return here

    def sentence(self, words: set[str]) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.bias + sum(self.heavy[w] for w in sorted(words))))))

    def document(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or of the text's sentences, and those with a probability of one half or more: (start, length, p). A
        sentence without a weight does not offend, however many there are; a text of such alone has the bias's score."""
        clean, found, hit = 0.0, [], False
        words_of = WORD.findall
        for m in SENTENCE.finditer(text.lower()):
            if (words := words_of(m[0])) and (here := self.known(set(words))):
                p, hit = self.sentence(here), True
                clean += math.log1p(-min(p, 1 - 1e-12))
                if p >= 0.5:
                    found.append((m.start(), m.end() - m.start(), p))
        return min(1.0, max(0.0, -math.expm1(clean))) if hit else self.sentence(set()), found


MOST_FEATURES, LEAST_DOCS = 2048, 3

Sentences = dict[tuple[str, ...], int]  # features of a sentence, how many sentences of the document have them


def sentences(text: str) -> Sentences:
    """A document as the bags of its sentences' features. A text without a sentence is one empty one."""
    bags = Counter()
    for s in SENTENCE.findall(text.lower()):
        if words := set(WORD.findall(s)):
            bags[tuple(sorted(f for w in words for f in features(w)))] += 1
    return bags or Counter({(): 1})


def cut_down(bags: Sentences, chosen: set[str]) -> Sentences:
    out = Counter()
    for s, n in bags.items():
        out[tuple(f for f in s if f in chosen)] += n
    return out


def gradient(theta: np.ndarray, y: np.ndarray, weight: np.ndarray, doc: np.ndarray, times: np.ndarray, sent: np.ndarray, word: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted log loss of documents under the noisy-or of their sentences, and its gradient. Sentence i is `times[i]`
    sentences of document doc[i]; theta ends with the bias; pairs (sent, word) say which features a sentence has."""
    p = 1 / (1 + np.exp(-(np.bincount(sent, theta[word], minlength=len(doc)) + theta[-1])))
    clean = np.bincount(doc, times * np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))  # log of: no sentence offends
    some = np.maximum(-np.expm1(clean), 1e-12)
    pull = weight * np.where(y == 1, -np.exp(clean) / some, 1.0)  # by a sentence's score: pull * its probability
    g_sent = pull[doc] * p * times
    g = np.append(np.bincount(word, g_sent[sent], minlength=len(theta) - 1), g_sent.sum())
    return float((weight * np.where(y == 1, -np.log(some), -clean)).sum()), g


def fit(docs: list[Sentences], toxic: np.ndarray, chosen: list[str], steps: int = 400, rate: float = 0.1, decay: float = 2e-4) -> Model:
    """A model of the chosen features. Without both labels it gives every document their common one."""
    n1 = int(toxic.sum())
    n0 = len(toxic) - n1
    if not n0 or not n1:
        return Model(bias=12.0 if n1 else -12.0)
    place = {w: i for i, w in enumerate(chosen)}
    rows = [(i, n, s) for i, d in enumerate(docs) for s, n in sorted(d.items()) if s]
    doc, times = np.array([i for i, *_ in rows], int), np.array([n for _, n, _ in rows], float)
    sent = np.repeat(np.arange(len(rows)), [len(s) for *_, s in rows])
    word = np.array([place[f] for *_, s in rows for f in s], int)
    y, theta, first, second = toxic.astype(float), np.zeros(len(chosen) + 1), 0.0, 0.0
    theta[-1] = -5.0
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0) * 0.7 + 0.3 / len(y)  # the rarer label counts for more
    for step in range(1, steps + 1):
        g = gradient(theta, y, weight, doc, times, sent, word)[1]
        g[:-1] += decay * theta[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return Model(float(theta[-1]), {w: float(t) for w, t in zip(chosen, theta, strict=False) if abs(t) > 1e-3})


def held_out(doc_id: Column) -> Column:
    """Whether labels of the document are never learned from: crc32 of its id as text, mod 3, is 1. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each feature of each text once, counted over the batch: (feature, docs, toxic)."""
    for b in batches:
        docs, toxic = Counter(), Counter()
        for t, y in zip(b["text"], b["toxic"].to_pylist(), strict=True):
            here = {f for s in sentences(t.as_py()) for f in s}
            docs.update(here)
            if y:
                toxic.update(here)
        if docs:
            yield pa.record_batch([pa.array(list(docs)), pa.array(list(docs.values()), pa.int64()), pa.array([toxic[f] for f in docs], pa.int64())], names=["feature", "docs", "toxic"])


BAG = "toxic int, times array<int>, sentences array<array<string>>"


def _bags(chosen: list[str]):
    some = set(chosen)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.int32()), pa.list_(pa.list_(pa.string()))]
        for b in batches:
            got = [sorted(cut_down(sentences(t.as_py()), some).items()) for t in b["text"]]
            yield pa.record_batch([b["toxic"], pa.array([[n for _, n in d] for d in got], kinds[0]), pa.array([[s for s, _ in d] for d in got], kinds[1])], names=["toxic", "times", "sentences"])

    return bags


def _fit_all(chosen: list[str]):
    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((list(zip(map(tuple, r["sentences"]), r["times"], strict=True)), r["toxic"]) for b in batches for r in b.to_pylist())
        if rows:
            m = fit([dict(d) for d, _ in rows], np.array([y for _, y in rows]), chosen)
            yield pa.RecordBatch.from_arrays([pa.array([*m.weights, None], pa.string()), pa.array([*m.weights.values(), m.bias], pa.float64())], names=["word", "weight"])

    return fit_all


def trained(docs: DataFrame, labels: DataFrame, max_docs: int = 6000, seed: int = 7) -> Model:
    """Fits a model on at most max_docs labelled documents that are not held out, drawn by a hash of their id; of several
    labels of a document the highest counts, null ones do not.

    The drawn ids are max_docs at most, so they are broadcast to find their texts. Rows that repeat a document count once:
    of its different texts the one of the least hash. A null text is an empty one, a text of any length is read whole, by the
    task that has it. One task fits, on the sentences' chosen features alone (MOST_FEATURES at most, equal sentences of a
    document together). Without labels, or on an empty table, no document is toxic."""
    stage = Stages(docs.sparkSession, "toxicity")
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("labelled_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    drawn = known.orderBy(F.xxhash64(F.lit(seed), "labelled_id"), "labelled_id").limit(max_docs)
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("labelled_id"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # reading them is work: small partitions stay apart
    texts = texts.groupBy("labelled_id").agg(F.first("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    texts = stage(texts.repartition(parts, "labelled_id").select("text", "toxic"), "sample")
    both = texts.agg(F.count("*").alias("n"), F.sum("toxic").alias("n1")).first()
    n1, n0 = float(both.n1 or 0), float(both.n - (both.n1 or 0))
    counted = texts.mapInArrow(_counted, "feature string, docs long, toxic long").groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic")).where(F.col("docs") >= LEAST_DOCS)
    a, b = F.col("toxic") + 0.5, F.col("docs") - F.col("toxic") + 0.5
    z = (F.log(a / (n1 + 1.5 - a)) - F.log(b / (n0 + 1.5 - b))) / F.sqrt(1 / a + 1 / b)
    best = counted.withColumn("z", F.abs(F.round(z, 9))).where("z > 3").orderBy(F.desc("z"), "feature").limit(MOST_FEATURES)
    chosen = [r.feature for r in best.select("feature").collect()]  # MOST_FEATURES at most
    bags = texts.mapInArrow(_bags(chosen), BAG)
    rows = bags.repartition(1).mapInArrow(_fit_all(chosen), "word string, weight double").collect()  # one row a weight
    stage.drop("sample")
    m = Model(bias=-12.0)
    for r in rows:
        if r.word is None:
            m.bias = r.weight
        else:
            m.weights[r.word] = r.weight
    return m


def _score(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("p", pa.float64())]))
        for b in batches:
            got = [model.document(t.as_py()) for t in b["text"]]
            spans = [[{"start": s, "length": n, "p": p} for s, n, p in f] for _, f in got]
            yield pa.RecordBatch.from_arrays([b["row"], pa.array([s for s, _ in got], pa.float64()), pa.array(spans, kind)], names=["row", "score", "offending"])

    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows as `row`, with score (0 to 1) and offending, the sentences that offend as (start, length, p) in
    characters of the lower-case text. A null or empty text is one empty sentence; a text of any length is read whole;
    repeated rows are scored each; an empty table gives no row."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of().alias("text"))
    return d.mapInArrow(_score(model), f"row {d.schema['row'].dataType.simpleString()}, score double, offending array<struct<start:int,length:int,p:double>>")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score by the model that its labelled, not held-out ones give; cases as in trained() and scored()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = trained(docs, table(spark, sf_dir, "labels"))
    d = docs.select("doc_id", "text")
    s = _scored_ids(d, model)
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def _scored_ids(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, offending): as scored(), without carrying the texts on."""
    d = docs.select(F.col("doc_id").cast("long").alias("row"), text_of().alias("text"))
    return d.mapInArrow(_score(model), "row long, score double, offending array<struct<start:int,length:int,p:double>>").withColumnRenamed("row", "doc_id")


def clean_documents(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """The documents, with their columns, that score below the limit."""
    s = scored(docs, model)
    return s.where(F.col("score") < limit).select("row.*")
