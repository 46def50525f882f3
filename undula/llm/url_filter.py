"""URL filtering by host and path rules, and by a character language-model ratio where no rule fits.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.llm.common import LOWER, UPPER, written

#: The models' symbols: what a URL's letters become, one for any other character, and the marks of its start and end.
LETTERS, OTHER, START, END = "abcdefghijklmnopqrstuvwxyz0123456789/.-_", "~", "^", "$"
ALPHABET = LETTERS + OTHER + START + END
#: One labelled URL in HELD_OUT sets the threshold and trains no model; scores are compared in steps of 1 / STEPS.
HELD_OUT, STEPS = 5, 200
#: Scores beyond this many nats a character count as this many when the threshold is set.
SPAN = 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of the rules (verdict, host and path) that fits, and its verdict; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def symbols(url: Column) -> Column:
    """What the models see of a URL: all that follows its first `://`, query and fragment too, or all of it if it has none."""
    whole, at = F.coalesce(url, F.lit("")), F.instr(url, "://")
    low = F.translate(F.when(at > 0, F.substr(whole, at + 3)).otherwise(whole), UPPER, LOWER)
    return F.concat(F.lit(START * 2), F.regexp_replace(low, "(?s)[^a-z0-9/._-]", OTHER), F.lit(END))


def grams(text: Column) -> Column:
    """All runs of three symbols."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substr(text, i, F.lit(3)))


def model(labelled: DataFrame) -> DataFrame:
    """(gram, ratio): for each of the len(ALPHABET) ** 3 grams the log of the third symbol's chance after the first two among
    accepted URLs over that among rejected ones, from (symbols, accepted) rows.

    Each class has a Markov model of orders 0 to 2, blended by Witten-Bell: a context seen n times, with t different symbols
    after it, leaves the weight t / (n + t) to the next shorter context; below order 0 all symbols are alike. Counted over
    all labelled rows, with partial sums in each task; all later tables have 79,507 rows at most.
    """
    size = len(ALPHABET)
    seen = (
        labelled.select("accepted", F.explode(grams(F.col("symbols"))).alias("gram"))
        .groupBy("gram")
        .agg(*(F.sum((F.col("accepted") == c).cast("long")).alias(f"n2_{c}") for c in (0, 1)))
    )
    pick = lambda k: F.substr(F.lit(ALPHABET), (F.floor(F.col("id") / size**k) % size + 1).cast("int"), F.lit(1))
    every = labelled.sparkSession.range(0, size**3, 1, 4).select(F.concat(pick(2), pick(1), pick(0)).alias("gram"))
    all_grams = every.join(seen, "gram", "left").fillna(0).withColumns({"c": F.substring("gram", 3, 1), "bc": F.substring("gram", 2, 2), "b": F.substring("gram", 2, 1), "ab": F.substring("gram", 1, 2)})
    both = (0, 1)
    pairs = all_grams.groupBy("bc", "b", "c").agg(*(F.sum(f"n2_{c}").alias(f"n1_{c}") for c in both))
    ones = pairs.groupBy("c").agg(*(F.sum(f"n1_{c}").alias(f"n0_{c}") for c in both))
    after = lambda n, key: {
        f"{what}_{n}": f(x).over(Window.partitionBy(key)) for c in both for what, f, x in ((f"t{c}", F.sum, (F.col(f"{n}_{c}") > 0).cast("long")), (f"s{c}", F.sum, F.col(f"{n}_{c}")))
    }

    def blend(df: DataFrame, n: str, below: list[Column]) -> list[Column]:
        parts = []
        for c in both:
            count, kinds, times = F.col(f"{n}_{c}"), F.col(f"t{c}_{n}"), F.col(f"s{c}_{n}")
            parts.append(F.when(times > 0, (count + kinds * below[c]) / (times + kinds)).otherwise(below[c]))
        return parts

    def with_order(df: DataFrame, n: str, key: str | None, below: list[Column]) -> DataFrame:
        df = df.withColumns(after(n, key) if key else after(n, "one"))
        return df.withColumns({f"p{c}_{n}": p for c, p in zip(both, blend(df, n, below), strict=True)})

    flat = [F.lit(1.0 / size)] * 2
    p0 = with_order(ones.withColumn("one", F.lit(1)), "n0", None, flat).select("c", "p0_n0", "p1_n0")
    p1 = with_order(pairs.join(p0, "c"), "n1", "b", [F.col("p0_n0"), F.col("p1_n0")]).select("bc", "p0_n1", "p1_n1")
    p2 = with_order(all_grams.join(p1, "bc"), "n2", "ab", [F.col("p0_n1"), F.col("p1_n1")])
    return p2.select("gram", (F.log("p1_n2") - F.log("p0_n2")).alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """The score from which URLs are accepted: that with the most balanced accuracy on (score, accepted) rows, 0 if a class is missing."""
    step = F.floor(F.greatest(F.least("score", F.lit(SPAN)), F.lit(-SPAN)) * STEPS)
    counts = scored.groupBy(step.alias("step")).agg(F.sum("accepted").alias("good"), F.sum(1 - F.col("accepted")).alias("bad"))
    rows = sorted(counts.collect())  # 2 * SPAN * STEPS + 1 rows at most
    good, bad = sum(r.good for r in rows), sum(r.bad for r in rows)
    if not good or not bad:
        return 0.0
    best, at, lost, stopped = 1.0, rows[0].step, 0, 0
    for r in rows:  # accept from r.step on
        if (value := stopped / bad + (good - lost) / good) > best:
            best, at = value, r.step
        lost, stopped = lost + r.good, stopped + r.bad
    return at / STEPS


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of `pages` (page_id, url).

    `rules` are (allow or block, host and path); a rule fits its host and all subdomains whose path starts with the rule's,
    and the longest wins. URLs that no rule fits are judged by two character models, learned from the URLs that rules allow
    and block: allowed if the mean log ratio over the URL's characters reaches the threshold, which held-out URLs of the
    same kind set. The models see the whole URL behind its `://`. Null URLs, and those without `://`, have an empty host and
    path and are judged like others by what they hold; without blocked examples nothing is blocked but by rules. Equal rows
    come out as often as they went in; URLs may be of any length; an empty table has no rows; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    named = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    named = named.withColumns({"rule": rule, "said": said, "symbols": symbols(F.col("url"))})
    labelled = named.where("said IS NOT NULL").withColumn("accepted", (F.col("said") == "allow").cast("int"))
    held = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(HELD_OUT)) == 0
    ratios = F.broadcast(model(labelled.where(~held)))
    each = named.select("page_id", "url", F.posexplode(grams(F.col("symbols"))).alias("pos", "gram")).join(ratios, "gram")
    means = each.groupBy("page_id", "url").agg(F.round(F.avg("ratio"), 9).alias("score"), F.sum((F.col("pos") == 0).cast("int")).alias("copies"))
    scored = written(means, "url-scores").withColumns({"host": host, "path": path}).withColumns({"rule": rule, "said": said})
    known = scored.where(F.col("said").isNotNull() & held).select("score", (F.col("said") == "allow").cast("int").alias("accepted"))
    own = F.when(F.col("score") >= threshold(known), "allow").otherwise("block")
    if labelled.where("accepted = 0").isEmpty():
        own = F.lit("allow")
    copy = scored.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copy.select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "score")
