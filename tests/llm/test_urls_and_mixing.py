"""The URL filter and source mixing against brute force."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import corpus, crowded, empty
from undula.llm import mixing, url_filter

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
URLS = [
    "http://A.Example.COM/en/7x?q#f", "https://example.com/en/8", "http://com/en/", "http://xcom/en/", "http://b.net/de/9", "http://example.net/de/8/a", "http://sub.example.net/de/81",
    "ftp://x.org/es/", "http://x.org/ES/", "http://x.org", "http://x.org?a://b/en/", "nothing", "", None, "://", "http://ÄÖ.org/é~/x", "http://a.com\n/en/7", "x://y://z/en/",
]
URLS += [f"http://good{i}.net/de/{i}" for i in range(40)] + [f"http://bad-pills{i}.com/en/{i}" for i in range(40)] + ["http://bad-pills.xyz/", "http://good7.xyz/de"]
URLS += URLS[20:22] + ["http://long.xyz/" + "ab/" * 400 + "?q=" + "z" * 300]


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    fits = []
    for verdict, rule in RULES:
        name, slash, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def symbols(url):
    rest = (url or "").split("://", 1)[-1]
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest)
    return "^^" + "".join(c if c in url_filter.LETTERS else "~" for c in low) + "$"


def brute_model(texts):
    counts = [Counter(), Counter(), Counter()]
    for t in texts:
        for i in range(2, len(t)):
            for order in range(3):
                counts[order][t[i - order : i + 1]] += 1

    def chance(context, c):
        below = 1 / len(url_filter.ALPHABET) if not context else None
        seen = {k[-1]: n for k, n in counts[len(context)].items() if k[:-1] == context}
        below = below if below is not None else chance(context[1:], c)
        n, kinds = sum(seen.values()), len(seen)
        return (seen.get(c, 0) + kinds * below) / (n + kinds) if n else below

    return chance


def test_urls_equal_brute_force(spark):
    import zlib

    pages = crowded(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string"), "host", "symbols", "gram")
    got = url_filter.judge_urls(pages, RULES).collect()
    known = [(u, *parse(u), ruled(*parse(u))[1]) for u in URLS]
    held = lambda u: zlib.crc32(u.encode()) % 5 == 0
    models = {v: brute_model([symbols(u) for u, h, p, said in known if said == v and not held(u)]) for v in ("allow", "block")}

    def score(url):
        t = symbols(url)
        return sum(math.log(models["allow"](t[i - 2 : i], t[i])) - math.log(models["block"](t[i - 2 : i], t[i])) for i in range(2, len(t))) / (len(t) - 2)

    scores = {u: score(u) for u in URLS}
    rows = {(r.page_id, r.host, r.path): r for r in got}
    assert len(got) == len(rows) == len(URLS)
    cut = [max((r.score for r in got if r.rule is None and r.verdict == "block"), default=-99), min((r.score for r in got if r.rule is None and r.verdict == "allow"), default=99)]
    assert cut[0] < cut[1]
    for i, u in enumerate(URLS):
        r = rows[(i, *parse(u))]
        rule, said = ruled(*parse(u))
        assert r.rule == rule and (rule is None or r.verdict == said) and r.verdict in ("allow", "block")
        assert r.score == pytest.approx(scores[u], abs=1e-6)
    verdict = {r.host: r.verdict for r in got}
    assert verdict["bad-pills.xyz"] == "block" and verdict["good7.xyz"] == "allow"


def test_no_urls_and_no_examples(spark):
    schema = "page_id long, url string"
    assert url_filter.judge_urls(spark.createDataFrame([], schema), RULES).collect() == []
    assert [r.verdict for r in url_filter.judge_urls(spark.createDataFrame([(1, "http://a.b/c")], schema), RULES).collect()] == ["allow"]


def brute_count(mean, seed, *keys):
    parts = max(1, math.ceil(mean / mixing.MOST_MEAN))
    total = 0
    for j in range(1, parts + 1):
        text = ":".join([str(seed), *("" if k is None else str(k) for k in keys), str(j)])
        u = int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52
        m, n = mean / parts, 0
        p = cdf = math.exp(-m)
        while cdf <= u and n < mixing.MOST_COPIES:
            n += 1
            p *= m / n
            cdf += p
        total += n
    return total


def test_mixing_equals_brute_force(spark):
    docs = crowded(corpus(spark, [f"text {i}" for i in range(200)]), "mix_rate", "mix_group")
    docs = docs.unionByName(docs.limit(2).selectExpr("cast(null AS long) AS doc_id", "cast(null AS string) AS source", "* EXCEPT (doc_id, source)"))
    rows = docs.collect()
    sizes = Counter(r.source for r in rows)
    weights = {s: n**0.5 for s, n in sizes.items()}
    rate = {s: len(rows) * weights[s] / sum(weights.values()) / n for s, n in sizes.items()}
    want = Counter()
    for r in rows:
        n = brute_count(rate[r.source], 7, r.doc_id)
        for i in range(1, n + 1):
            want[r.doc_id, r.source, r.text, i] += 1
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == [*docs.columns, "_mix_rate", "mix_copies", "mix_copy", "mix_place"]
    got = mixed.collect()
    assert Counter((r.doc_id, r.source, r.text, r.mix_copy) for r in got) == want
    assert [r.mix_place for r in got] == sorted(r.mix_place for r in got)


def test_given_rates_reach_their_means(spark):
    docs = corpus(spark, ["a"] * 3000)
    targets = spark.createDataFrame([("src0", 0.5), ("src1", 40.0), ("src2", 0.0)], "mix_group string, rate double")
    got = Counter(r.source for r in mixing.mix_sources(docs, targets=targets).select("source").collect())
    assert abs(got["src0"] - 500) < 5 * math.sqrt(500) and abs(got["src1"] - 40_000) < 6 * math.sqrt(40_000) and "src2" not in got
    assert mixing.mix_sources(docs.where("false")).collect() == []
    assert mixing.mix_sources(empty(spark)).collect() == []


def test_counts_follow_the_distribution(spark):
    from pyspark.sql import functions as F

    counts = Counter(r.n for r in spark.range(20_000).select(mixing.poisson(F.lit(2.5), 3, F.col("id")).alias("n")).collect())
    expected = defaultdict(float, {k: 20_000 * math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(12)})
    assert sum((counts[k] - expected[k]) ** 2 / expected[k] for k in range(9)) < 30


def brute_threshold(rows):
    """The step of the score from which accepting gives the most balanced accuracy, the lowest of equals, by trying all."""
    steps = [math.floor(max(-url_filter.SPAN, min(url_filter.SPAN, s)) * url_filter.STEPS) for s, _ in rows]
    good, bad = sum(a for _, a in rows), sum(1 - a for _, a in rows)
    if not good or not bad:
        return 0.0
    value = {t: sum(s < t and not a for s, (_, a) in zip(steps, rows, strict=True)) / bad + sum(s >= t and a for s, (_, a) in zip(steps, rows, strict=True)) / good for t in set(steps)}
    best = max(value.values())
    return min(t for t in value if value[t] == best) / url_filter.STEPS


@pytest.mark.parametrize("seed", range(4))
def test_the_threshold_is_the_best_of_all(spark, seed):
    import random

    draw = random.Random(seed)
    rows = [(draw.gauss(0.4 * a, 0.3), a) for a in draw.choices([0, 1], k=draw.choice([3, 40, 200]))]
    rows += [(50.0, 1), (-50.0, 0)] if seed else []
    got = url_filter.threshold(spark.createDataFrame(rows, "score double, accepted int"))
    assert got == pytest.approx(brute_threshold(rows))
    assert url_filter.threshold(spark.createDataFrame([(0.5, 1)], "score double, accepted int")) == 0


def test_the_query_judges_every_url_by_rule_or_threshold(spark):
    from undula.llm.queries import QUERIES

    rows = QUERIES["op2_url_filter"](spark, "/root/testdata/sf0.001").collect()
    pages = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert Counter(r.page_id for r in rows) == Counter(pages.keys())
    for r in rows:
        rule, said = ruled(*parse(pages[r.page_id]))
        assert (r.host, r.path, r.rule) == (*parse(pages[r.page_id]), rule) and (rule is None or r.verdict == said)
    free = [r for r in rows if r.rule is None]
    bar = {v: [r.score for r in free if r.verdict == v] for v in ("allow", "block")}
    assert not bar["allow"] or not bar["block"] or max(bar["block"]) < min(bar["allow"])
