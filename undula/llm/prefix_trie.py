"""A trie of conversations by their shared first turns, built level by level."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.core import numbered
from undula.llm.common import tidy, written

#: Turns of a block of a conversation, and span of conv_ids whose members are joined to one text.
BLOCK, SPAN = 4096, 512
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NOTHING = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest (of role and text) and chars (code points of the text) of every turn, written.

    Turns stand by `turn`, null first, equal ones by their digest; a null role or text is an empty one; rows without a
    conv_id belong to no conversation. Texts are digested where they are read, so that the sort, which deals a conversation
    of any length to many tasks, moves digests alone.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    own = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
        F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie"),
    )
    return written(numbered(written(own, "turns"), ["conv_id"], ["turn", "digest", "tie"], "pos").select("conv_id", "pos", "digest", "chars"), "numbered-turns")


def mixed_histories(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt upon a common history: (conv_id, turns) of each, and their turns as turns_of() gives them.

    Conversation c begins with the first h = crc32(c as text) mod `most` turns of conversation c - c % group, all if it has
    fewer and none if there is no such one, and goes on with its own after its first h.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).alias("h")
    based = sizes.select("conv_id", "n", base, h)
    bases = sizes.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    cut = based.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    cut = written(cut.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("turns")), "conversations")
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most - 1)).select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    first = cut.where("head > 0").join(heads, "base").where("pos < head").select("conv_id", "pos", "digest", "chars")
    own = turns.join(cut.select("conv_id", "h", "head"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "digest", "chars")
    return cut.select("conv_id", "turns"), written(first.unionByName(own), "rebuilt-turns")


def _classes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, cls, members, turns): conversations of the same turns are of one class, named by its smallest conv_id.

    A conversation is known by sums over its turns of hashes that hold each turn's place, so no task sees all turns of one.
    """
    keys = [F.bit_xor(F.xxhash64("pos", "digest", F.lit(k))).alias(f"key{k}") for k in range(3)]
    known = convs.join(turns.groupBy("conv_id").agg(*keys), "conv_id", "left").fillna(0, ["key0", "key1", "key2"])
    key = ["turns", "key0", "key1", "key2"]
    named = known.groupBy(*key).agg(F.min("conv_id").alias("cls"), F.count("*").alias("members"))
    return written(known.join(named, key).select("conv_id", "cls", "members", "turns"), "classes")


def _behind(turns: DataFrame) -> DataFrame:
    """Adds `below`, the sum of chars from each turn of its class on, by blocks of a class."""
    block = F.floor(F.col("pos") / BLOCK)
    sums = turns.groupBy("cls", block.alias("block")).agg(F.sum("chars").alias("all"))
    later = F.sum("all").over(Window.partitionBy("cls").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("cls", "block", F.coalesce(later, F.lit(0)).alias("later"))
    here = F.sum("chars").over(Window.partitionBy("cls", "block").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumn("block", block).withColumn("here", here).join(sums, ["cls", "block"]).withColumn("below", F.col("here") + F.col("later")).drop("block", "here", "later")


def ends_digests(classes: DataFrame) -> DataFrame:
    """(cls, ends_sha256): sha256 of each class's conv_ids, ascending, joined by commas.

    A class's members are joined by spans of conv_ids first, so that a class of very many sends few rows to the task that
    hashes its spans one after the other, without ever holding them together.
    """

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = hashlib.sha256(), None
        for batch in batches:
            done = []
            for cls, ids in zip(batch["cls"].tolist(), batch["ids"], strict=True):
                if cls == last:
                    state.update(b",")
                elif last is not None:
                    done.append((last, state.hexdigest()))
                    state = hashlib.sha256()
                state.update(ids.encode())
                last = cls
            yield pd.DataFrame(done, columns=["cls", "ends_sha256"])
        if last is not None:
            yield pd.DataFrame([(last, state.hexdigest())], columns=["cls", "ends_sha256"])

    spans = classes.groupBy("cls", F.floor(F.col("conv_id") / SPAN).alias("span")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    spans = spans.select("cls", "span", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    return spans.repartition("cls").sortWithinPartitions("cls", "span").mapInPandas(tidy(hashed), "cls long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of `convs` (conv_id, turns) with `turns` (conv_id, pos, digest, chars), as NODE says.

    A node is a distinct sequence of first turns; conv_id is its smallest member and parent_conv_id its parent's; n_convs
    counts its members, n_children its children, n_leaves the childless nodes in its subtree; saved_tokens sums, over the
    subtree, (n_convs - 1) times the code points of the node's last text; ends_sha256 is that of the conv_ids that end here.
    Node and depth name a node: those of one depth have no member in common.

    Conversations that are the same throughout are one class and go down together. On each level the live classes are
    grouped by their node and next turn, with partial minima and counts in each task, so a node may hold any share of the
    conversations. A class that is alone in its node is no longer live: what is left of it is a chain of nodes, whose
    figures its own turns tell. So there are as many rounds as different conversations have turns in common, whatever the
    length of the longest. Then the levels are joined in reverse, children's leaves and savings summed up for their parents.
    """
    known = _classes(convs, turns)
    classes = known.where("conv_id = cls").select("cls", "members", "turns")
    of = turns.join(classes.select(F.col("cls").alias("conv_id"), "members"), "conv_id").withColumnRenamed("conv_id", "cls")
    of = written(_behind(written(of, "class-turns")), "class-turns")
    root = classes.agg(F.min("cls").alias("conv_id"), F.lit(None).cast("long").alias("parent"), F.sum("members").alias("n_convs"), F.count("*").alias("classes"), F.lit(0).cast("long").alias("chars"))
    levels = [written(root.where("classes > 0"), "level")]
    top = levels[0].first()
    live = classes.select("cls", "turns", F.lit(top.conv_id if top else 0).cast("long").alias("node")).where(F.lit(top is not None and top.classes > 1))
    single, ended, depth = [levels[0].where("classes = 1").select(F.col("conv_id").alias("cls"), F.lit(0).alias("from"))], [], 0
    live = written(live, "live")
    while not live.isEmpty():
        ended.append(live.where(F.col("turns") == depth).select("cls", F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth")))
        depth += 1
        own = live.join(of.where(F.col("pos") == depth - 1).select("cls", "digest", "members", "chars"), "cls")
        nodes = own.groupBy("node", "digest").agg(F.min("cls").alias("conv_id"), F.sum("members").alias("n_convs"), F.count("*").alias("classes"), F.first("chars").alias("chars"))
        nodes = written(nodes, "level")
        levels.append(nodes.select("conv_id", F.col("node").alias("parent"), "n_convs", "classes", "chars"))
        single.append(nodes.where("classes = 1").select(F.col("conv_id").alias("cls"), F.lit(depth).alias("from")))
        on = nodes.where("classes > 1").select("node", "digest", F.col("conv_id").alias("next"))
        live = written(own.select("cls", "turns", "node", "digest").join(on, ["node", "digest"]).select("cls", "turns", F.col("next").alias("node")), "live")
    chains = written(reduce(DataFrame.unionByName, single).join(classes, "cls"), "chains")
    tails = of.join(chains.select("cls", "from", "turns"), "cls").where(F.col("pos") >= F.col("from"))
    last = F.col("pos") + 1 == F.col("turns")
    tails = tails.select(
        F.col("cls").alias("conv_id"), (F.col("pos") + 1).cast("long").alias("depth"), F.col("cls").alias("parent_conv_id"), F.col("members").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("members") - 1) * F.col("below")).alias("saved_tokens"),
    )
    # The tops of chains, for the nodes above them: where a chain goes on, its node has one child, with what lies below it.
    deeper = of.join(chains.where("turns > from").select("cls", "from"), "cls").where(F.col("pos") == F.col("from"))
    deeper = written(deeper.select("cls", (F.col("from")).alias("at"), ((F.col("members") - 1) * F.col("below")).alias("saved")), "chain-tops")
    out, below = tails, None
    for d in range(depth, -1, -1):
        tops = deeper.where(F.col("at") == d).select(F.col("cls").alias("conv_id"), F.lit(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "saved")
        if below is not None:
            children = below.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
            tops = tops.unionByName(children)
        node = levels[d].join(tops, "conv_id", "left")
        saved = (F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved", F.lit(0))
        below = node.select("conv_id", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), saved.alias("saved_tokens"))
        below = written(below, "rolled-up")
        out = out.unionByName(below.select("conv_id", F.lit(d).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens"))
    ended.append(chains.select("cls", F.col("cls").alias("conv_id"), F.col("turns").cast("long").alias("depth")))
    ends = reduce(DataFrame.unionByName, ended).join(ends_digests(known.select("conv_id", "cls")), "cls").drop("cls")
    return out.join(ends, ["conv_id", "depth"], "left").fillna(NOTHING, ["ends_sha256"]).select(*NODE)


def history_trie(conversations: DataFrame) -> DataFrame:
    """The trie of `conversations` (conv_id, turn, role, text), each rebuilt upon the common history of its group, see
    turns_of(), mixed_histories() and trie(). No conversations have no nodes; other columns are ignored."""
    return trie(*mixed_histories(turns_of(conversations)))
