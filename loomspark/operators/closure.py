"""Hierarchy operators: mount classes, inclusive stats, window filters and cyclic subtree sums.

A session tree is derived from (ref, parent_ref). A chain that ends at a session without a parent, or at
a missing one, hangs below that top; members of a cycle and all that hangs below them are orphans of
their own.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a folder of our own only on a local master."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read back: cuts lineage, columnar and compressed."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mount(sessions: DataFrame) -> DataFrame:
    """(ref, entry, depth, mount): each session's top entry, by pointer doubling in log2(depth) joins.

    Only sessions whose top isn't found yet are joined in a round; the others are written once.
    """
    heads = sessions.select("ref", "parent_ref")
    known = heads.select(F.col("ref").alias("known"))
    below = heads.where("parent_ref is not null").join(known, F.col("parent_ref") == F.col("known"), "left")
    links = below.select("ref", F.coalesce("known", "ref").alias("up"), F.when(F.col("known").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.col("known").isNull().alias("done"))
    links = written(links, "links")
    tops = heads.where("parent_ref is null").select("ref", F.col("ref").alias("up"), F.lit(0).cast("long").alias("hops"), F.lit(True).alias("done"))
    ended, going = [tops, links.where("done")], links.where("not done")
    while True:
        far = reduce(DataFrame.union, [*ended, going]).select(F.col("ref").alias("f"), F.col("up").alias("f_up"), F.col("hops").alias("f_hops"), F.col("done").alias("f_done"))
        links = written(going.join(far, going["up"] == far["f"]).select("ref", F.col("f_up").alias("up"), (F.col("hops") + F.col("f_hops")).alias("hops"), F.col("f_done").alias("done")), "links")
        going = links.where("not done")
        if links.where("done").isEmpty():  # depths are contiguous: no new end in a round means none deeper
            break
        ended.append(links.where("done"))
    roots = tops.select("ref", F.col("up").alias("entry"), F.lit(0).alias("depth"), F.lit("root").alias("mount"))
    others = [x.select("ref", F.col("up").alias("entry"), F.col("hops").cast("int").alias("depth"), F.when(F.col("hops") == 0, "orphan").otherwise("mounted").alias("mount")) for x in ended[1:]]
    cycles = going.select("ref", F.col("ref").alias("entry"), F.lit(0).alias("depth"), F.lit("orphan").alias("mount"))
    return reduce(DataFrame.union, [roots, *others, cycles])


def inclusive_stats(sessions: DataFrame, closure: DataFrame) -> DataFrame:
    """Per top entry, its subtree's sums; any estimated cost makes the entry estimated."""
    rows = closure.join(sessions, "ref")
    source = F.when(F.bool_or(F.col("cost_source") == "estimated"), "estimated").when(F.bool_or(F.col("cost_source").isNotNull()), "recorded")
    return rows.groupBy("entry").agg(
        (F.count("*") - 1).alias("descendants"), F.sum("message_count").alias("messages"), F.sum(F.coalesce("total_tokens", F.col("input_tokens") + F.col("output_tokens"))).alias("tokens"),
        F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"), F.sum("cache_read").alias("cache_read"), F.sum("cache_create").alias("cache_create"),
        F.sum("total_cost").alias("cost"), source.alias("cost_source"),
    )


def window_filter(sessions: DataFrame, closure: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Sessions whose entry is active in the window: descendants come along whatever their own activity."""
    tops = sessions
    if start is not None:
        tops = tops.where(F.col("activity") >= start)
    if end is not None:
        tops = tops.where(F.col("activity") <= end)
    kept = closure.join(tops.select(F.col("ref").alias("entry")), "entry", "left_semi").select("ref", "entry", "depth", "mount")
    return sessions.join(kept, "ref")


def cycle_heads(links: DataFrame) -> DataFrame:
    """(ref, head) of the members of cycles of links(ref, up); head is the smallest member, which names the cycle.

    After as many steps up as a tail is long, only members are still arrived at. Steps double, so their number is found in
    rounds of the logarithm: the set shrinks until it holds the members alone. The smallest of a member's next 1, 2, 4, ..
    members is found alike, until a round changes none: two stretches that follow each other and have the same smallest
    member overlap, so they are the whole cycle.
    """
    jumps = checkpointed(links.where("up is not null").select("ref", "up"))
    reached = None
    while True:
        far = jumps.select(F.col("ref").alias("up"), F.col("up").alias("further"))
        jumps = checkpointed(jumps.join(far, "up").select("ref", F.col("further").alias("up")))
        now = jumps.select("up").distinct().count()
        if now == reached:
            break
        reached = now
    members = jumps.select(F.col("up").alias("ref")).distinct()
    lows = checkpointed(links.join(members, "ref", "left_semi").select("ref", "up", F.least("ref", "up").alias("head")))
    changed = not lows.isEmpty()
    while changed:
        far = lows.select(F.col("ref").alias("up"), F.col("up").alias("further"), F.col("head").alias("other"))
        lows = checkpointed(lows.join(far, "up").select("ref", F.col("further").alias("up"), F.least("head", "other").alias("head"), (F.col("other") < F.col("head")).alias("changed")))
        changed = not lows.where("changed").isEmpty()
    return lows.select("ref", "head")


def tree_sums(nodes: DataFrame) -> DataFrame:
    """(ref, total) from nodes(ref, up, value) without cycles: the sum of a node and all below it.

    A node's sum of the descendants nearer than 2, 4, 8, .. steps: in each round those exactly so far away, which are its
    ancestors' pointers by then, add their own sums. There are never more rows than nodes.
    """
    rows = checkpointed(nodes.select("ref", "up", F.col("value").alias("total")))
    while not rows.where("up is not null").isEmpty():
        given = rows.where("up is not null").groupBy("up").agg(F.sum("total").alias("more")).withColumnRenamed("up", "ref")
        far = rows.select(F.col("ref").alias("up"), F.col("up").alias("further"))
        grown = rows.join(given, "ref", "left").select("ref", "up", (F.coalesce("total", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("total"))
        rows = checkpointed(grown.join(far, "up", "left").select("ref", F.col("further").alias("up"), "total"))
    return rows.select("ref", "total")


def subtree_costs(sessions: DataFrame) -> DataFrame:
    """(ref, subtree_cost) of every session; a member of a cycle sums the whole cycle and what hangs below.

    Each cycle becomes one node, so that what is left are trees.
    """
    known = sessions.select(F.col("ref").alias("up"))
    links = sessions.select("ref", F.col("parent_ref").alias("p"), "total_cost").join(known, F.col("p") == known["up"], "left")
    links = checkpointed(links.select("ref", "up", "total_cost"))
    heads = cycle_heads(links)
    named = links.join(heads, "ref", "left").withColumn("node", F.coalesce("head", "ref"))
    above = heads.withColumnsRenamed({"ref": "up", "head": "up_head"})
    nodes = named.join(above, "up", "left").select("ref", "node", F.when(F.col("head").isNull(), F.coalesce("up_head", "up")).alias("above"), "total_cost")
    nodes = checkpointed(nodes)
    sums = tree_sums(nodes.groupBy(F.col("node").alias("ref")).agg(F.max("above").alias("up"), F.sum("total_cost").alias("value")))
    return nodes.select("ref", "node").join(sums.withColumnRenamed("ref", "node"), "node").select("ref", F.col("total").alias("subtree_cost"))


def day_groups(entries: DataFrame, closure: DataFrame) -> DataFrame:
    """Entries by calendar day (session time zone) of their activity, with counts of mains and subs."""
    subs = closure.groupBy("entry").agg((F.count("*") - 1).alias("subs")).withColumnRenamed("entry", "ref")
    rows = entries.join(subs, "ref", "left")
    day = F.date_format(F.timestamp_millis("activity"), "yyyy-MM-dd")
    return rows.groupBy(day.alias("day")).agg(F.count("*").alias("mains"), F.sum(F.coalesce("subs", F.lit(0))).cast("long").alias("subs"))


def context(closure: DataFrame, changed: DataFrame) -> DataFrame:
    """(ref) of all sessions in the trees that changed(ref) touches: ancestors and descendants alike."""
    tops = closure.join(changed.select("ref"), "ref", "left_semi").select("entry").distinct()
    return closure.join(tops, "entry", "left_semi").select("ref")


def visible_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (added, removed): how many refs a change adds to and removes from a windowed view."""
    a, b = before.select("ref", F.lit(1).alias("was")), after.select("ref", F.lit(1).alias("is_now"))
    return a.join(b, "ref", "full").agg(F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("is_now").isNull()).alias("removed"))
