"""Language identification by a byte convolutional network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import broadcast_if_small, fold, fresh_name, tidy, uniform, written

#: The byte that stands past a window's end.
PAD = 256
UNKNOWN = "und"


def windows(raw: bytes, length: int) -> np.ndarray:
    """All of `raw` as rows of `length` bytes; the last row is filled up with PAD."""
    n = max(1, -(-len(raw) // length))
    out = np.full(n * length, PAD, np.int16)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, length)


class ByteCNN:
    """Byte vectors, filters of several widths, the maximum of each filter over the window, and a softmax over languages."""

    def __init__(self, languages: list[str], length: int = 256, dim: int = 8, widths: tuple[int, ...] = (2, 3, 4), filters: int = 8, seed: int = 1):
        self.languages, self.length, self.widths, self.filters = languages, length, widths, filters
        draw = np.random.default_rng(seed)
        self.vectors = draw.normal(0, 0.5, (257, dim)).astype(np.float32)
        self.vectors[PAD] = 0
        self.kernels = {w: draw.normal(0, 1 / np.sqrt(w * dim), (w * dim, filters)).astype(np.float32) for w in widths}
        self.offsets = {w: np.zeros(filters, np.float32) for w in widths}
        self.weights = draw.normal(0, 0.1, (filters * len(widths), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def columns(self, x: np.ndarray, width: int) -> np.ndarray:
        """For each place of each window the vectors of `width` bytes side by side."""
        flat = x.reshape(len(x), -1)
        dim = self.vectors.shape[1]
        return np.lib.stride_tricks.sliding_window_view(flat, width * dim, axis=1)[:, ::dim]

    def logits(self, batch: np.ndarray) -> np.ndarray:
        x = self.vectors[batch]
        pooled = [
            np.maximum((np.ascontiguousarray(self.columns(x, w)).reshape(-1, w * x.shape[2]) @ self.kernels[w]).reshape(len(x), -1, self.filters).max(1) + self.offsets[w], 0)
            for w in self.widths
        ]
        return np.concatenate(pooled, axis=1) @ self.weights + self.bias

    def fit(self, batch: np.ndarray, labels: np.ndarray, epochs: int = 8, size: int = 64, rate: float = 0.01, seed: int = 1) -> ByteCNN:
        """Train by Adam on windows; the ends of some are blanked at random, so that short texts are known too."""
        draw = np.random.default_rng(seed)
        tables = {"vectors": self.vectors, "weights": self.weights, "bias": self.bias, **{("k", w): self.kernels[w] for w in self.widths}, **{("o", w): self.offsets[w] for w in self.widths}}
        state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in tables.items()}
        step, f, dim = 0, self.filters, self.vectors.shape[1]
        for _ in range(epochs):
            for part in np.array_split(draw.permutation(len(batch)), -(-len(batch) // size)):
                step += 1
                bytes_, truth = batch[part].copy(), labels[part]
                kept = np.where(draw.random(len(part)) < 0.5, draw.integers(12, self.length + 1, len(part)), self.length)
                bytes_[np.arange(self.length) >= kept[:, None]] = PAD
                x = self.vectors[bytes_]
                cols = {w: self.columns(x, w) for w in self.widths}
                maps = {w: (np.ascontiguousarray(cols[w]).reshape(-1, w * dim) @ self.kernels[w]).reshape(len(part), -1, f) for w in self.widths}
                best = {w: maps[w].argmax(1) for w in self.widths}
                top = {w: np.take_along_axis(maps[w], best[w][:, None], 1)[:, 0] + self.offsets[w] for w in self.widths}
                pooled = np.concatenate([np.maximum(top[w], 0) for w in self.widths], axis=1)
                z = pooled @ self.weights + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(part)), truth] -= 1
                p /= len(part)
                grads = {"weights": pooled.T @ p, "bias": p.sum(0), "vectors": np.zeros_like(self.vectors)}
                back = (p @ self.weights.T) * (pooled > 0)
                rows = np.arange(len(part))[:, None]
                for i, w in enumerate(self.widths):
                    b = back[:, i * f : (i + 1) * f]
                    seen = cols[w][rows, best[w]]
                    grads["k", w] = np.einsum("nfc,nf->cf", seen, b)
                    grads["o", w] = b.sum(0)
                    to_cols = b[:, :, None] * self.kernels[w].T[None]
                    for j in range(w):
                        np.add.at(grads["vectors"], bytes_[rows, best[w] + j], to_cols[:, :, j * dim : (j + 1) * dim])
                grads["vectors"][PAD] = 0
                for k, v in tables.items():
                    first, second = state[k]
                    first += 0.1 * (grads[k] - first)
                    second += 0.01 * (grads[k] ** 2 - second)
                    v -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        return self

    def predict(self, texts: list[str], size: int = 128) -> tuple[list[str], list[float]]:
        """For each whole text the language with the largest mean logit over its windows, and its share in their softmax.

        Windows of many texts go through the network together, `size` at a time.
        """
        sums = np.zeros((len(texts), len(self.languages)))
        counts = np.zeros(len(texts))
        held: list[np.ndarray] = []
        owners: list[int] = []

        def flush() -> None:
            rows = np.concatenate(held)
            for a in range(0, len(rows), size):
                np.add.at(sums, owners[a : a + size], self.logits(rows[a : a + size]))
            held.clear()
            owners.clear()

        for i, text in enumerate(texts):
            rows = windows(text.encode(), self.length)
            counts[i] = len(rows)
            held.append(rows)
            owners += [i] * len(rows)
            if len(owners) >= 32 * size:
                flush()
        if owners:
            flush()
        z = sums / np.maximum(counts, 1)[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [self.languages[k] for k in best], p[np.arange(len(best)), best].tolist()


def train(docs: DataFrame, rows: int = 1500, max_chars: int = 20_000, most_rows: int = 20_000, seed: int = 5, **parameters) -> ByteCNN | None:
    """Fit on a sample of documents with a language: `rows` of each in expectation, fewer where the languages are so many that
    they would come to more than `most_rows`, none longer than `max_chars`; these bound what reaches the driver. Rows with the
    same doc_id, language and text count once. Each gives four windows at most. None without examples."""
    usable = docs.where(F.col("lang").isNotNull() & (F.length("text") <= max_chars) & F.col("text").rlike(r"\p{L}"))
    usable = usable.select("doc_id", "lang", F.xxhash64("text").alias("text_key"), "text")
    keys = written(usable.select("doc_id", "lang", "text_key").distinct(), "spoken")
    counts = broadcast_if_small(written(keys.groupBy("lang").agg(F.count("*").alias("n")), "languages"), 100_000)
    each = min(rows, most_rows / max(1, counts.count()))
    sample = keys.join(counts, "lang").where(uniform(F.struct("doc_id", "text_key"), seed) * F.col("n") < each).select("doc_id", "lang", "text_key")
    same = F.col("u.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("u.lang") == F.col("s.lang")) & (F.col("u.text_key") == F.col("s.text_key"))
    found = usable.alias("u").join(broadcast_if_small(sample, 20 * most_rows).alias("s"), same, "left_semi")
    got = found.groupBy("doc_id", "lang", "text_key").agg(F.first("text").alias("text")).select("text", "lang").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["lang", "text"])
    languages = sorted(got["lang"].unique())
    model = ByteCNN(languages, **parameters)
    draw = np.random.default_rng(seed)
    parts, labels = [], []
    for text, lang in zip(got["text"], got["lang"], strict=True):
        own = windows(text.encode(), model.length)
        own = own[draw.permutation(len(own))[:4]]
        parts.append(own)
        labels += [languages.index(lang)] * len(own)
    return model.fit(np.concatenate(parts), np.array(labels))


def identify(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """`docs` with lang_pred and lang_score (0 to 1) for every whole text; `und` and 0 where the text is null or has no letter.

    All columns and rows stay; where `docs` has such a name, the added one gets underscores in front. The network has a
    fixed size and goes to the tasks as a broadcast.
    """
    lang, score = fresh_name(docs, "lang_pred"), fresh_name(docs, "lang_score")
    if model is None:
        return docs.withColumn(lang, F.lit(UNKNOWN)).withColumn(score, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def each(batch: pd.Series) -> pd.DataFrame:
            known = batch.notna()
            out = pd.DataFrame({"lang": UNKNOWN, "score": 0.0}, index=batch.index)
            if known.any():
                names, shares = shared.value.predict(batch[known].tolist())
                out.loc[known, "lang"], out.loc[known, "score"] = names, shares
            return out

        yield from tidy(lambda batches: map(each, batches))(texts)

    found = fresh_name(docs, "lang_found")
    lettered = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    return docs.withColumn(found, predicted(lettered)).withColumns({lang: F.col(f"`{found}`.lang"), score: F.col(f"`{found}`.score")}).drop(found)


def train_on_fold(docs: DataFrame) -> ByteCNN | None:
    """The network of the contract: learned from documents whose crc32(doc_id) mod 5 is not 0."""
    return train(docs.where(fold("doc_id", 5) != 0))
