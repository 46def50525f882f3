"""Toxicity and language scores: held-out accuracy on drawn texts, odd inputs, whole texts."""

import math
import random

import numpy as np
import pytest

from tests.llm.helpers import ODD, corpus, crowded, empty
from undula.llm import language_id, toxicity
from undula.llm.queries import QUERIES

SYLLABLES = {"aa": ["ka", "lo", "mi", "ne", "ru"], "bb": ["sch", "ung", "ver", "heit", "pf"], "cc": ["ción", "que", "ñar", "llo", "rra"]}
BAD = ["idiot", "scum", "pathetic", "vermin", "worthless"]


def sentence(draw, lang, n):
    return " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 4))) for _ in range(n))


def labelled(n, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        words = sentence(draw, draw.choice(list(SYLLABLES)), draw.choice([10, 60, 300])).split()
        bad = i % 4 == 0
        for _ in range(max(1, len(words) // 50) if bad else 0):
            words[draw.randrange(len(words))] = draw.choice(BAD)
        rows.append((i, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def toxic_model():
    rows = labelled(800)
    return toxicity.SubwordSoftmax(buckets=1 << 14).fit([r[1] for r in rows], [r[2] for r in rows])


def test_toxic_texts_are_told(toxic_model):
    scorer = toxic_model.scorer()
    rows = labelled(300, seed=2)
    told = np.array([scorer.score(r[1]) >= 0.7 for r in rows])
    truth = np.array([r[2] == 1 for r in rows])
    assert told[truth].mean() > 0.95 and told[~truth].mean() < 0.02
    assert scorer.score(rows[1][1] + " you idiotic worthlesss one") > scorer.score(rows[1][1])  # spelled as never seen


def test_scores_equal_brute_force(toxic_model):
    """Every window's softmax, from the vectors themselves."""
    scorer = toxic_model.scorer()
    for text in [r[1] for r in labelled(20, seed=3)] + ["", "x", "Idiot! idiots"]:
        words, shares = toxicity.WORD.findall(text.lower()), []
        for a in range(0, len(words), toxic_model.window):
            mean = np.mean([toxic_model.vectors[toxic_model.subwords(w)].mean(0) for w in words[a : a + toxic_model.window]], axis=0)
            z = mean @ toxic_model.weights + toxic_model.bias
            shares.append(np.exp(z[1]) / np.exp(z).sum())
        want = max(shares) if shares else 1 / (1 + np.exp(toxic_model.bias[0] - toxic_model.bias[1]))
        assert scorer.score(text) == pytest.approx(want, abs=1e-9)


def test_the_query_holds_on_rows_that_it_did_not_learn(spark):
    """A quarter of the toxic rows of these labels have no toxic word in them, so not all can be told."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic")
    rows = QUERIES["op1_toxicity"](spark, folder).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == y] for y in (1, 0))
    assert len(toxic) > 10 and np.mean(toxic) >= 0.6 and np.mean(clean) <= 0.03


def test_training_on_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = corpus(spark)
    for d, y in ((docs, labels), (empty(spark), labels), (empty(spark), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))):
        assert all(r.tox_predicted == 0 for r in toxicity.score_documents(docs, toxicity.train(d, y)).collect())


def test_rows_in_thousands_are_one_example(spark):
    rows = labelled(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, rows[1][1])] * 3000, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = toxicity.train(docs, labels), toxicity.train(docs.distinct(), labels)
    assert np.array_equal(a.vectors, b.vectors)


def test_a_short_passage_counts_in_a_long_text(toxic_model):
    scorer = toxic_model.scorer()
    clean = sentence(random.Random(5), "aa", 5000)
    assert scorer.score(clean) < 0.7 <= scorer.score(clean + " pathetic idiot scum vermin")


def test_scores_of_odd_texts(spark, toxic_model):
    docs = crowded(corpus(spark), "tox_score", "TOX_PREDICTED")
    out = toxicity.score_documents(docs, toxic_model)
    assert out.columns == [*docs.columns, "_tox_score", "_tox_predicted"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r._tox_score <= 1 and r._tox_predicted == (r._tox_score >= 0.7) for r in rows)
    assert len({r._tox_score for r in rows if not (r.text or "").strip()}) == 1
    assert toxicity.score_documents(empty(spark), toxic_model).collect() == []


def test_training_from_tables(spark):
    rows = labelled(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (None, "x y")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (5, 7)], "doc_id long, toxic int")
    model = toxicity.train_on_fold(docs, labels)
    out = toxicity.score_documents(docs, model).collect()
    truth = {i: y for i, _, y in rows}
    assert np.mean([r.tox_predicted == truth[r.doc_id] for r in out if r.doc_id in truth]) > 0.95
    nobody = toxicity.train(docs, labels.where("toxic = 0"))
    assert all(r.tox_predicted == 0 for r in toxicity.score_documents(docs, nobody).collect())


def spoken(n, seed):
    draw = random.Random(seed)
    return [(i, sentence(draw, lang := draw.choice(list(SYLLABLES)), draw.choice([4, 40, 400])), lang) for i in range(n)]


@pytest.fixture(scope="module")
def language_model(spark):
    docs = spark.createDataFrame([*spoken(400, 1), (9000, None, "aa"), (9001, "", "aa"), (9002, "ka lo", None)], "doc_id long, text string, lang string")
    return language_id.train(docs)


def test_languages_are_told(language_model):
    rows = spoken(200, 2)
    names, shares = language_model.predict([r[1] for r in rows])
    assert np.mean([n == r[2] for n, r in zip(names, rows, strict=True)]) > 0.97 and all(0 <= s <= 1 for s in shares)


def test_batches_do_not_matter(language_model):
    texts = [r[1] for r in spoken(30, 3)]
    together = language_model.predict(texts, size=7)
    alone = [language_model.predict([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone]
    assert np.allclose(together[1], [a[1][0] for a in alone], atol=1e-5)


def test_the_end_of_a_long_text_counts(language_model):
    draw = random.Random(4)
    start, end = sentence(draw, "aa", 200), sentence(draw, "bb", 2000)
    assert language_model.predict([f"{start} {end}"])[0] == ["bb"]


def test_languages_of_odd_texts(spark, language_model):
    docs = crowded(corpus(spark), "lang_pred", "lang_found")
    out = language_id.identify(docs, language_model)
    assert out.columns == [*docs.columns, "_lang_pred", "lang_score"]
    rows = out.collect()
    assert len(rows) == docs.count() == len(ODD) + 2
    for r in rows:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r._lang_pred in SYLLABLES) == lettered and (lettered or (r._lang_pred, r.lang_score) == ("und", 0.0))
    assert {r.lang_pred for r in language_id.identify(corpus(spark), language_id.train(empty(spark))).collect()} == {"und"}


def test_gradients_reduce_the_loss():
    draw = np.random.default_rng(1)
    model = language_id.ByteCNN(["a", "b"], length=32)
    batch = draw.integers(0, 256, (64, 32)).astype(np.int16)
    labels = (batch == 7).any(1).astype(int)
    batch[labels == 1, 5:8] = [7, 8, 9]
    model.fit(batch, labels, epochs=60)
    assert (model.logits(batch).argmax(1) == labels).mean() > 0.9


def test_the_language_query_holds_on_rows_that_it_did_not_learn(spark):
    folder = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{folder}/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang")
    rows = QUERIES["op6_language_id"](spark, folder).join(known, "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97


def test_many_languages_share_the_sample(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i % 23)} word {i}", f"l{i % 40}") for i in range(400)] + [(1, "same words", "l1")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, rows=1500, most_rows=200)
    assert 20 < len(model.languages) <= 40


def test_network_against_plain_loops():
    """Every window's filters place by place, their maxima, and the softmax of mean logits, without any array operation."""
    net = language_id.ByteCNN(["x", "y", "z"], length=12, dim=3, widths=(2, 3), filters=2, seed=4)
    net.offsets = {w: np.array([0.1, -0.2], np.float32) for w in net.widths}
    net.bias[:] = 0.3, -0.1, 0.05
    texts = ["a", "hello there, this is long enough", "é日本", "x" * 40, " "]

    def logits(window):
        pooled = []
        for w in net.widths:
            for f in range(net.filters):
                most = -math.inf
                for at in range(net.length - w + 1):
                    most = max(most, sum(float(net.vectors[window[at + j], d]) * float(net.kernels[w][j * 3 + d, f]) for j in range(w) for d in range(3)))
                pooled.append(max(most + float(net.offsets[w][f]), 0.0))
        return [sum(p * float(net.weights[i, k]) for i, p in enumerate(pooled)) + float(net.bias[k]) for k in range(3)]

    found, shares = net.predict(texts)
    for text, name, share in zip(texts, found, shares, strict=True):
        raw = text.encode()
        cut = [list(raw[a : a + 12]) for a in range(0, len(raw), 12)]
        every = [logits(c + [language_id.PAD] * (12 - len(c))) for c in cut]
        mean = [sum(z[k] for z in every) / len(every) for k in range(3)]
        top = max(range(3), key=mean.__getitem__)
        assert name == net.languages[top] and share == pytest.approx(math.exp(mean[top]) / sum(map(math.exp, mean)), rel=1e-4)
