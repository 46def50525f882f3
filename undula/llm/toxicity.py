"""Toxicity scores from subword-bag embeddings under a linear softmax."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import broadcast_if_small, fold, fresh_name, tidy, uniform, written

WORD = re.compile(r"\w+")


class SubwordSoftmax:
    """Word vectors are means of the hashed vectors of the word and its character n-grams; a window of words is the mean of
    its words' vectors, and a linear softmax over two classes scores it. A document is as toxic as its most toxic window, so
    a long text doesn't dilute a short passage. All parts are trained jointly. Vectors of subwords that fewer than `least`
    training documents hold stay 0, and the others decay, so that no document is learned by heart.

    The layer on top is linear, so a window's logit is the mean of its words' own logits; scoring keeps one number a word.
    """

    def __init__(self, buckets: int = 1 << 17, dim: int = 8, window: int = 2, shortest: int = 3, longest: int = 6, least: int = 8, seed: int = 1):
        self.buckets, self.dim, self.window, self.shortest, self.longest, self.least = buckets, dim, window, shortest, longest, least
        draw = np.random.default_rng(seed)
        self.vectors = draw.normal(0, 1 / dim, (buckets, dim))
        self.weights = draw.normal(0, 1 / dim, (dim, 2))
        self.bias = np.zeros(2)
        self.seed = seed

    def subwords(self, word: str) -> list[int]:
        marked = f"<{word}>".encode()
        text, n = f"<{word}>", len(word) + 2
        parts = [crc32(marked) % self.buckets]
        for size in range(self.shortest, min(self.longest, n - 1) + 1):
            parts += [crc32(text[i : i + size].encode()) % self.buckets for i in range(n - size + 1)]
        return parts

    def fit(self, texts: list[str], labels: list[int], epochs: int = 20, batch: int = 64, rate: float = 0.03, decay: float = 0.5, many: int = 4, sharp: float = 6.0) -> SubwordSoftmax:
        """Train vectors and softmax by Adam, each epoch on windows drawn anew from every document.

        Windows are drawn by a softmax of their logits whose sharpness grows from 0 to `sharp`, and their number falls from
        `many` to 1 (2 in documents of class 0, whose hardest windows set the false alarms): the first epochs see each
        document as a whole, the last its most toxic windows. Documents of a class weigh alike, and both classes do; the
        rate falls to 0, and `decay` is the share of a vector that each touch takes off, times the rate.
        """
        index: dict[str, int] = {}
        docs = [np.array([index.setdefault(w, len(index)) for w in WORD.findall(t.lower())], np.int32) for t in texts]
        filled = [i for i, d in enumerate(docs) if len(d)]
        if not filled:
            return self
        n_grams = np.zeros(len(index), np.int64)
        listed = array("i")
        for k, word in enumerate(index):
            parts = self.subwords(word)
            n_grams[k] = len(parts)
            listed.extend(parts)
        grams = np.frombuffer(listed, np.int32)
        gram_starts = np.cumsum(n_grams) - n_grams
        del index
        word_docs = np.bincount(np.concatenate([np.unique(docs[i]) for i in filled]), minlength=len(n_grams))
        rare = np.bincount(grams, np.repeat(word_docs, n_grams), self.buckets) < self.least
        self.vectors[rare] = 0
        words = np.concatenate([docs[i] for i in filled])
        lengths = np.array([len(docs[i]) for i in filled])
        n_windows = -(-lengths // self.window)
        of_doc = np.repeat(np.arange(len(filled)), n_windows)
        first_of = np.cumsum(n_windows) - n_windows
        cuts = (np.arange(len(of_doc)) - first_of[of_doc]) * self.window + (np.cumsum(lengths) - lengths)[of_doc]
        sizes = np.diff(np.append(cuts, len(words)))
        label = np.array(labels, np.int64)[filled]
        truth = label[of_doc]
        share = len(label) / np.maximum(1, 2 * np.bincount(label, minlength=2))
        draw = np.random.default_rng(self.seed)
        tables = {"vectors": self.vectors, "weights": self.weights, "bias": self.bias}
        state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in tables.items()}
        step = 0
        for epoch in range(epochs):
            done = epoch / max(1, epochs - 1)
            each = (self.vectors @ (self.weights[:, 1] - self.weights[:, 0]))[grams]
            per_word = np.add.reduceat(each, gram_starts) / n_grams
            logits = np.add.reduceat(per_word[words], cuts) / sizes
            order = np.lexsort((-(sharp * done * logits + draw.gumbel(size=len(cuts))), of_doc))
            place = np.arange(len(order)) - first_of[of_doc[order]]
            most = round(many * (1 - done) + done)
            chosen = order[place < np.where(truth[order] == 1, most, max(2, most))]
            weight = share[truth[chosen]] / np.bincount(of_doc[chosen])[of_doc[chosen]]
            turn = np.array_split(draw.permutation(len(chosen)), -(-len(chosen) // batch))
            for k, part in enumerate(turn):
                step += 1
                at, n = chosen[part], sizes[chosen[part]]
                own, local = np.unique(words[np.repeat(cuts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())], return_inverse=True)
                n_own = n_grams[own]
                at_own = np.cumsum(n_own) - n_own
                rows = grams[np.repeat(gram_starts[own] - at_own, n_own) + np.arange(n_own.sum())]
                vectors = np.add.reduceat(self.vectors[rows], at_own) / n_own[:, None]
                means = np.add.reduceat(vectors[local], np.cumsum(n) - n) / n[:, None]
                z = means @ self.weights + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(at)), truth[at]] -= 1
                p *= (weight[part] / weight[part].sum())[:, None]
                to_word = np.repeat(p @ self.weights.T / n[:, None], n, axis=0)
                per_own = np.stack([np.bincount(local, c, len(own)) for c in to_word.T], axis=1) / n_own[:, None]
                touched, where = np.unique(rows, return_inverse=True)
                to_row = np.repeat(per_own, n_own, axis=0)
                gradient = np.stack([np.bincount(where, c, len(touched)) for c in to_row.T], axis=1)
                gradient[rare[touched]] = 0
                now = rate * (1 - (epoch + k / len(turn)) / epochs)
                for name, rows_of, g in (("vectors", touched, gradient), ("weights", slice(None), means.T @ p), ("bias", slice(None), p.sum(0))):
                    first, second = state[name]
                    first[rows_of] = 0.9 * first[rows_of] + 0.1 * g
                    second[rows_of] = 0.99 * second[rows_of] + 0.01 * g * g
                    tables[name][rows_of] -= now * (first[rows_of] / (1 - 0.9**step)) / (np.sqrt(second[rows_of] / (1 - 0.99**step)) + 1e-8)
                self.vectors[touched] *= 1 - now * decay
        return self

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer(dict):
    """The share of class 1 for texts; remembers each word's logit, up to a bound."""

    LIMIT = 200_000

    def __init__(self, model: SubwordSoftmax):
        super().__init__()
        self.each = (model.vectors @ (model.weights[:, 1] - model.weights[:, 0])).tolist()
        self.bias = float(model.bias[1] - model.bias[0])
        self.model = model

    def __missing__(self, word: str) -> float:
        parts = self.model.subwords(word)
        value = sum(map(self.each.__getitem__, parts)) / len(parts)
        if len(self) < self.LIMIT:
            self[word] = value
        return value

    def score(self, text: str) -> float:
        words = WORD.findall(text.lower())
        most = 0.0
        if words:
            logits = np.fromiter(map(self.__getitem__, words), np.float64, len(words))
            cuts = np.arange(0, len(words), self.model.window)
            most = float((np.add.reduceat(logits, cuts) / np.diff(np.append(cuts, len(words)))).max())
        return float(1 / (1 + np.exp(-np.clip(most + self.bias, -50, 50))))


def train(docs: DataFrame, labels: DataFrame, rows: int = 2000, max_chars: int = 20_000, seed: int = 11, **parameters) -> SubwordSoftmax:
    """Fit on a sample of the labelled documents: `rows` of each class in expectation, none longer than `max_chars`.

    These two bound what reaches the driver. Null texts, null labels and labels other than 0 and 1 are left out, a document
    with several labels has the largest, and equal rows count once; without examples of both classes the model calls nothing
    toxic. Texts stay where they are: the keys of the labelled ones are joined and sampled, and the sample's keys, a bounded
    number, are broadcast to the texts.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    sized = docs.where(F.length("text") <= max_chars).select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").alias("sample_text"))
    usable = written(sized.select("doc_id", "text_key").join(known, "doc_id").distinct(), "labelled")
    counts = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*(F.lit(x) for c in (0, 1) for x in (c, min(1.0, rows / max(1, counts.get(c, 0))))))
    sample = broadcast_if_small(usable.where(uniform(F.struct("doc_id", "text_key"), seed) < share[F.col("label")]), 20 * rows)
    picked = sized.join(sample, ["doc_id", "text_key"]).groupBy("doc_id", "text_key").agg(F.first("sample_text").alias("sample_text"), F.first("label").alias("label"))
    got = picked.toPandas().sort_values(["doc_id", "sample_text"])
    model = SubwordSoftmax(**parameters)
    if got["label"].nunique() < 2:
        model.vectors[:] = 0
        model.bias[:] = 1, -1
        return model
    return model.fit(got["sample_text"].tolist(), got["label"].tolist())


def score_documents(docs: DataFrame, model: SubwordSoftmax, threshold: float = 0.7) -> DataFrame:
    """`docs` with tox_score (0 to 1) and tox_predicted (1 from `threshold` on) of every whole text.

    Null and empty texts have the score of no words. All columns and rows stay; where `docs` has such a name, the added
    one gets underscores in front. The model has a fixed size and goes to the tasks as a broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = shared.value.scorer()
        yield from tidy(lambda batches: (batch.map(scorer.score).astype("float64") for batch in batches))(texts)

    score, predicted = fresh_name(docs, "tox_score"), fresh_name(docs, "tox_predicted")
    return docs.withColumn(score, scored(F.coalesce("text", F.lit("")))).withColumn(predicted, (F.col(score) >= threshold).cast("int"))


def train_on_fold(docs: DataFrame, labels: DataFrame) -> SubwordSoftmax:
    """The model of the contract: learned from the labels of rows whose crc32(doc_id) mod 3 is not 1."""
    learn = fold("doc_id", 3) != 1
    return train(docs.where(learn), labels.where(learn))
