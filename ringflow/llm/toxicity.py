"""Toxicity by multiple-instance learning.

Labels are known for documents only. A document is a bag of sentences; each
sentence has a probability from a linear model over its words and their
prefixes, and the document's probability is their noisy-or,
1 - prod(1 - p_sentence). The model is trained through that combination from
document labels, and afterwards says which sentences give offence.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import filter_rows, fold_remainder, id_text, map_rows

#: Bounded sample of labelled documents the model is fitted on: documents of either class at most, and characters in all.
TRAIN_TOXIC = 1500
TRAIN_CLEAN = 3000
TRAIN_CHARS = 15_000_000
#: Texts of more characters aren't learned from: one label says little about a text of thousands of sentences.
TRAIN_TEXT_CHARS = 200_000
#: Sentences of the sample that a feature must occur in.
MIN_SENTENCES = 8
#: Pull of every weight towards zero.
RIDGE = 2e-4
#: A sentence ends at . ! ? or a line's end; one of more words is judged in pieces of this many.
SENTENCE_WORDS = 40
EPOCHS = 150
THRESHOLD = 0.3
WORD_CACHE = 1 << 18

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence piece that has words; the span, in code points, is the sentence's."""
    out = []
    for m in _SENTENCE.finditer(text):
        words = _WORD.findall(m.group().lower())
        for k in range(0, len(words), SENTENCE_WORDS):
            out.append((*m.span(), words[k : k + SENTENCE_WORDS]))
    return out


def word_features(word: str) -> list[str]:
    """The word and its prefixes of 3 to 6 letters, the latter under a mark of their own."""
    return [word, *[word[:k] + "-" for k in range(3, min(len(word), 7))]]


class _WordScores(dict):
    """word -> sum of its features' weights, for WORD_CACHE distinct words at most."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, w: str) -> float:
        if len(self) >= WORD_CACHE:
            self.clear()
        get = self.weights.get
        s = self[w] = get(w, 0.0) + sum([get(w[:k] + "-", 0.0) for k in range(3, min(len(w), 7))])
        return s


class NoisyOrModel:
    """Feature weights and a bias; a sentence's logit is bias + the sum over its distinct words."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, float(bias)
        self._words = _WordScores(weights)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and its sentences with theirs."""
        get, bias = self._words.__getitem__, self.bias
        spans, clean = [], 0.0  # clean: log of the probability that no sentence is toxic
        for a, b, words in sentences(text or ""):
            z = min(30.0, max(-30.0, bias + math.fsum(map(get, set(words)))))
            p = 1 / (1 + math.exp(-z))
            clean += math.log1p(-min(p, 1 - 1e-12))
            spans.append((a, b, p))
        return (-math.expm1(clean) if spans else 1 / (1 + math.exp(-bias))), spans


class Bags:
    """A sample's documents as bags of sentences, these as sets of words, and words as lists of features."""

    def __init__(self, texts: list[str], labels: list[int]):
        vocabulary: dict[str, int] = {}
        tokens, token_sentence, sentence_doc = [], [], []
        for d, text in enumerate(texts):
            for *_, words in sentences(text) or [(0, 0, [])]:
                ids = [vocabulary.setdefault(w, len(vocabulary)) for w in sorted(set(words))]
                tokens.extend(ids)
                token_sentence.extend([len(sentence_doc)] * len(ids))
                sentence_doc.append(d)
        self.tokens, self.token_sentence, self.sentence_doc = (np.array(x, np.int64) for x in (tokens, token_sentence, sentence_doc))
        self.n_docs, self.n_words = len(texts), len(vocabulary)
        names: dict[str, int] = {}
        feats = [[names.setdefault(f, len(names)) for f in word_features(w)] for w in vocabulary]
        feat_word = np.repeat(np.arange(self.n_words), [len(f) for f in feats])
        feat = np.array([f for fs in feats for f in fs], np.int64)
        # features of few sentences can't be told from chance
        held = np.bincount(self.tokens, minlength=self.n_words)
        common = np.bincount(feat, weights=held[feat_word], minlength=len(names)) >= MIN_SENTENCES
        self.feat_word, feat = feat_word[common[feat]], feat[common[feat]]
        used, self.feat = np.unique(feat, return_inverse=True)
        by_id = list(names)
        self.names = [by_id[f] for f in used.tolist()]
        self.y = np.array(labels, float)
        share = np.where(self.y == 1, 0.5 / max(self.y.sum(), 1), 0.5 / max((1 - self.y).sum(), 1))
        prior = np.where(self.y == 1, self.y.mean(), 1 - self.y.mean())
        self.share = share * (0.5 + prior)  # between balanced classes and the sample's own mix

    def loss_and_gradient(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        """Weighted cross-entropy of the documents' noisy-or with the ridge, and its gradient by ``w`` and ``b``."""
        word_score = np.bincount(self.feat_word, weights=w[self.feat], minlength=self.n_words)
        z = np.clip(b + np.bincount(self.token_sentence, weights=word_score[self.tokens], minlength=len(self.sentence_doc)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        log_q = np.bincount(self.sentence_doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=self.n_docs)
        q = np.exp(log_q)  # 1 - P
        loss = float((self.share * np.where(self.y == 1, -np.log(np.maximum(1 - q, 1e-9)), -log_q)).sum() + 0.5 * RIDGE * (w * w).sum())
        pull = np.where(self.y == 1, -q / np.maximum(1 - q, 1e-9), 1.0) * self.share
        gz = pull[self.sentence_doc] * p
        g_word = np.bincount(self.tokens, weights=gz[self.token_sentence], minlength=self.n_words)
        return loss, np.bincount(self.feat, weights=g_word[self.feat_word], minlength=len(w)) + RIDGE * w, float(gz.sum())


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> NoisyOrModel:
    """Adam on the cross-entropy of noisy-or; full batches, fixed order: the same sample gives the same model.

    Without texts or with labels of one kind alone, every text gets that kind's share.
    """
    if not texts or len(set(labels)) < 2:
        rate = min(max(float(np.mean(labels)) if labels else 0.0, 1e-4), 1 - 1e-4)
        return NoisyOrModel({}, math.log(rate / (1 - rate)))
    bags = Bags(texts, labels)
    w, b = np.zeros(len(bags.names)), -4.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, epochs + 1):
        _, g, gb = bags.loss_and_gradient(w, b)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix = np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        # the size of a step follows the gradient's evidence: features seen once hardly move
        w -= 0.1 * fix * m / (np.sqrt(v) + 1e-4)
        b -= 0.05 * fix * mb / (np.sqrt(vb) + 1e-4)
    return NoisyOrModel(dict(zip(bags.names, w.tolist(), strict=True)), b)


def training_rows(docs: DataFrame, labels: DataFrame) -> list:
    """(text, class) of labelled documents, chosen by hash: TRAIN_TOXIC and TRAIN_CLEAN ids, TRAIN_CHARS characters at most.

    The ids are picked from the labels alone and then broadcast, so no text but the
    sample's own leaves its task, and no rows pass through Python on the executors. Texts above TRAIN_TEXT_CHARS, and those that would
    exceed their class's share of TRAIN_CHARS, are left out one by one. Null ids, labels
    and texts teach nothing; an id labelled both ways is toxic; of an id's several
    texts each is learned from.
    """
    labelled = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    out = []
    for cls, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)):
        sample = labelled.where(F.col("toxic") == cls).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").cast("long").alias("doc_id"))
        rows = id_text(docs).where(F.length("text") <= TRAIN_TEXT_CHARS).join(F.broadcast(sample), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        held = 0
        for r in rows.toLocalIterator():
            if held + len(r["text"]) <= TRAIN_CHARS * most / (TRAIN_TOXIC + TRAIN_CLEAN):
                held += len(r["text"])
                out.append((r["text"], cls))
    return out


def train(docs: DataFrame, labels: DataFrame) -> NoisyOrModel:
    """The model of ``labels`` (doc_id, toxic) over ``docs`` (doc_id, text); other columns of either are ignored.

    What it learns from is stated in ``training_rows``. If either table is empty, or
    only one class is left, the model gives every text that class's share and finds
    no sentence.
    """
    rows = training_rows(docs, labels)
    return fit([t for t, _ in rows], [y for _, y in rows])


def score_documents(docs: DataFrame, model: NoisyOrModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted, n_sentences, offending.

    ``offending`` lists the spans start:end (code points) of sentences that reach
    ``threshold`` alone. Null and empty texts have no sentence and get the
    model's score of an empty sentence. Null or repeated ids and repeated rows
    are kept; other columns are ignored. The broadcast model is bounded by the
    sample it was fitted on.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def make():
        own = NoisyOrModel(*shared.value)

        def work(rows: dict) -> dict:
            out: dict[str, list] = defaultdict(list)
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                p, spans = own.score(text)
                out["doc_id"].append(doc_id)
                out["score"].append(float(p))
                out["predicted"].append(int(p >= threshold))
                out["n_sentences"].append(len(spans))
                out["offending"].append(",".join(f"{a}:{b}" for a, b, q in spans if q >= threshold))
            return out

        return work

    return map_rows(id_text(docs, id_col, text_col), make, "doc_id long, score double, predicted int, n_sentences long, offending string")


def drop_toxic(docs: DataFrame, model: NoisyOrModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (with a column text and any others) without the rows whose text reaches ``threshold``.

    All columns stay, and so do null and empty texts; rows that repeat share one fate;
    an empty table gives an empty result. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def make():
        own = NoisyOrModel(*shared.value)
        return lambda texts: [not t or own.score(t)[0] < threshold for t in texts]

    return filter_rows(docs, make)


def held_out(doc_id):
    return fold_remainder(doc_id, 4) == 2
