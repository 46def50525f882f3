"""Benchmark decontamination: word windows of test items found in whole training texts.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm.common import LOWER, UPPER, broadcast_if_small, fresh_name, written

#: A word, once A-Z are lower-cased, and the same as a set of characters of the text as it is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A word and what stands between it and the next.
PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
#: What stands before the first word.
LEAD = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
#: Consecutive words in a window.
WINDOW = 10
#: Windows of test items that are broadcast at most, about 150 MB; more of them meet the documents' in a shuffle.
MOST_BROADCAST = 1_000_000


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def hash_at(ws: str, start: Column, n: int) -> Column:
    """A hash of the window of `n` words from the place `start` (from 0) on."""
    return F.xxhash64(*(F.get(ws, start + i) for i in range(n)))


def hash_here(n: int):
    return lambda i: hash_at("words", i, n)


def windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(size, gram, items): the distinct windows of the items' texts and the sorted item_ids that have each.

    A window is `n` consecutive words; an item of fewer words, but not none, is one window. A null item_id is written as an
    empty text; rows that share an item_id are one item with the windows of both.
    """
    item = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    cut = benchmark.select(item.alias("item"), words(F.col("text")).alias("words")).withColumn("size", F.least(F.size("words"), F.lit(n))).where("size > 0")
    placed = cut.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))))
    grams = placed.select("item", "size", F.slice("words", F.col("start") + 1, F.col("size")).alias("gram"))
    return grams.groupBy("size", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("key_a"), F.xxhash64(text, F.lit(1)).alias("key_b"), text.alias("text"))


#: Rows of one doc_id and text are one document here: its key is the doc_id and two hashes of the text.
KEY = ["doc_id", "key_a", "key_b"]


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.key_a") == F.col(f"{b}.key_a")) & (F.col(f"{a}.key_b") == F.col(f"{b}.key_b"))


def occurrences(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(key, start, size, list) of every window of `grams` (size, gram, list) in a document, written.

    The windows' hashes are looked up one by one where the text is read, in a hash set that is broadcast if it is proven
    small; a hit is verified word by word at once, so that nothing but verified hits leaves the task.
    """
    sizes = sorted(r.size for r in grams.select("size").distinct().collect())  # WINDOW rows at most
    found = None
    for n in sizes:
        own = grams.where(F.col("size") == n).select("gram", "list", hash_at("gram", F.lit(0), n).alias("hash"))
        known = broadcast_if_small(own, MOST_BROADCAST, 256)
        cut = _keyed(docs).select(*KEY, words(F.col("text")).alias("words"))
        # The words are a column of their own, so they are cut once a text and not once a window.
        starts = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n))
        hashed = cut.select(*KEY, "words", F.transform(starts, hash_here(n)).alias("hashes"))
        # An inner explode would have Spark filter by the hashes beforehand, and compute them, and the words, for that once more.
        each = hashed.select(*KEY, "words", F.posexplode_outer("hashes").alias("start", "hash"))
        hits = each.join(known, "hash").where(F.slice("words", F.col("start") + 1, F.lit(n)) == F.col("gram"))
        hits = hits.select(*KEY, "start", F.lit(n).alias("size"), "list")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = _keyed(docs).select(*KEY, F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("list")).where("false")
    return written(found, "occurrences")


def _merged(starts: Column) -> Column:
    """Sorted (start, size) pairs as disjoint spans (start, end)."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(spans: Column, s: Column) -> Column:
        end, last = s["start"] + s["size"], F.element_at(spans, -1)
        joined = F.array_append(F.slice(spans, F.lit(1), F.size(spans) - 1), F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end")))
        return F.when((F.size(spans) > 0) & (F.try_element_at(spans, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.array_append(spans, F.struct(s["start"].alias("start"), end.alias("end"))))

    return F.aggregate(starts, none, add)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """A row for each distinct doc_id and text of `docs` that holds a window of a test item: doc_id, key_a, key_b, starts (the
    windows' (start, size), sorted), items (sorted item_ids) and n_items, items_sha256 (of the ids joined by commas).

    Documents with the same windows share one list of items, made once, however many there are.
    """
    grams = written(windows(benchmark, n), "test-windows")
    lists = grams.groupBy("items").agg(F.min(F.struct("size", "gram")).alias("first")).withColumn("list", F.xxhash64("first"))
    clash = lists.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    if not clash.isEmpty():  # numbers instead of hashes
        lists = lists.withColumn("list", F.monotonically_increasing_id())
    lists = written(lists.select("items", "list"), "item-lists")
    hits = occurrences(docs, written(grams.join(lists, "items").select("size", "gram", "list"), "test-grams"))
    by_doc = hits.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("starts"), F.array_sort(F.collect_set("list")).alias("lists"))
    by_doc = written(by_doc, "hit-documents")
    kinds = by_doc.select("lists").distinct()
    named = kinds.select("lists", F.explode("lists").alias("list")).join(broadcast_if_small(lists, 100_000, 256), "list").select("lists", F.explode("items").alias("item")).distinct()
    items = named.groupBy("lists").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items = items.select("lists", "items", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return by_doc.join(items, "lists").drop("lists")


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of `docs` (doc_id, text).

    Words are runs of ASCII letters and digits, in lower case, and of all characters beyond ASCII. A word is hit if it lies in
    any occurrence of a window of `benchmark` (item_id, text), see windows(); n_items counts the items with an occurring
    window, items_sha256 is that of their ids, sorted as texts and joined by commas. Null texts are empty and have no words;
    a null doc_id stays; equal rows come out as often as they went in, rows that share a doc_id with other texts each with
    their own figures; other columns are ignored. Empty tables: no documents give no rows, no items no hits.
    """
    found = contaminated(docs, benchmark, n)
    counted = _keyed(docs).select(*KEY, F.regexp_count("text", F.lit(PLAIN_WORD)).cast("long").alias("n_words"))
    counted = counted.groupBy(*KEY).agg(F.first("n_words").alias("n_words"), F.count("*").alias("copies"))
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))

    def cover(s: Column, w: Column) -> Column:
        end = w["start"] + w["size"]
        return F.struct((s["hit"] + F.greatest(F.lit(0), end - F.greatest(w["start"], s["end"]))).alias("hit"), F.greatest(s["end"], end).alias("end"))

    hit = F.aggregate("starts", start, cover, lambda s: s["hit"].cast("long"))
    found = found.select(*KEY, hit.alias("n_hit"), "n_items", "items_sha256")
    both = counted.alias("d").join(found.alias("f"), _same("d", "f"), "left").select("d.doc_id", "n_words", "copies", "n_hit", "n_items", "items_sha256")
    both = both.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), "copies")
    each = both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.drop("copy", "copies").withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", n: int = WINDOW, least: float = 0.0) -> DataFrame:
    """`docs` without what they share with the test items: with `remove` "documents" the rows that hold a window are left out,
    with "spans" the words of all occurrences, and what stands between them and the next word, are cut from their texts.

    Documents whose share of hit words is below `least` stay as they are. Rows that hold nothing stay as they are, null texts
    too; all columns stay.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove: spans or documents, not {remove!r}")
    found = written(contaminated(docs, benchmark, n).select(*KEY, _merged(F.col("starts")).alias("spans")), "spans")
    a, b, spans, lead = (fresh_name(docs, c) for c in ("key_a", "key_b", "hit_spans", "lead"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({a: F.xxhash64(text), b: F.xxhash64(text, F.lit(1))}).alias("d")
    named = broadcast_if_small(found.select(F.col("doc_id").alias("_id"), F.col("key_a").alias("_a"), F.col("key_b").alias("_b"), F.col("spans").alias("_spans")), 100_000, 256).alias("f")
    same = F.col("d.doc_id").eqNullSafe(F.col("f._id")) & (F.col(f"d.{a}") == F.col("f._a")) & (F.col(f"d.{b}") == F.col("f._b"))
    both = keyed.join(named, same, "left").select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col("f._spans").alias(spans))
    places = F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1)))
    share = F.aggregate(spans, F.lit(0), lambda x, s: x + s["end"] - s["start"]) / F.regexp_count("text", F.lit(PLAIN_WORD))
    hit = F.col(spans).isNotNull() & (share >= least)
    if remove == "documents":
        return both.where(~F.coalesce(hit, F.lit(False))).select(*docs.columns)
    pieces, first = F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)), F.regexp_extract("text", LEAD, 0)
    left = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), places)
    cut = both.where(hit).select(*(c for c in docs.columns), spans, pieces.alias(a), left.alias(b), first.alias(lead))
    kept = F.concat(F.col(lead), F.array_join(F.transform(b, lambda i: F.element_at(a, i + 1)), ""))
    cut = cut.withColumn("text", kept).select(*docs.columns)
    return both.where(~F.coalesce(hit, F.lit(False))).select(*docs.columns).unionByName(cut)
