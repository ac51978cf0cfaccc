"""Registered queries: snapshots, usage, tags, prices and session detail."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspark.functions import pricing, tags
from loomspark.operators import incremental, transcript, usage
from loomspark.plans import lens
from loomspark.plans.lens import BASE, MESSAGES_SQL, with_sql
from loomspark.plans.lookup import TALKS, talks

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None, *parts: str):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = (with_sql(*parts) if parts else "") + sql
        return function

    return add


SNAPSHOT = "SELECT user_id::VARCHAR AS ref, count(*)::VARCHAR || ':' || max(event_id)::VARCHAR AS signature FROM events WHERE {} GROUP BY 1"
OLD, NEW = "event_id % 10 <> 3 AND user_id % 17 <> 2", "event_id % 10 <> 3 AND user_id % 13 <> 5 OR event_id % 100 = 3"


def _snapshot(spark, sf_dir, condition):
    rows = lens.table(spark, sf_dir, "events").where(condition)
    return rows.groupBy(F.col("user_id").cast("string").alias("ref")).agg(F.concat_ws(":", F.count("*").cast("string"), F.max("event_id").cast("string")).alias("signature"))


@query(f"SELECT ref, CASE WHEN a.signature IS NULL THEN 'new' WHEN b.signature IS NULL THEN 'removed' ELSE 'updated' END AS op FROM ({SNAPSHOT.format(OLD)}) a FULL JOIN ({SNAPSHOT.format(NEW)}) b USING (ref) WHERE a.signature IS DISTINCT FROM b.signature")
def snapshot_diff(spark, sf_dir):
    return incremental.diff(_snapshot(spark, sf_dir, OLD), _snapshot(spark, sf_dir, NEW))


@query(f"SELECT ref, CASE WHEN a.signature IS NULL THEN 'new' WHEN b.signature IS NULL THEN 'removed' ELSE 'updated' END AS op FROM ({SNAPSHOT.format(OLD)}) a FULL JOIN ({SNAPSHOT.format(NEW)}) b USING (ref) WHERE a.signature IS DISTINCT FROM b.signature AND (b.signature IS NOT NULL OR ref::INT % 2 = 0)")
def snapshot_diff_partial(spark, sf_dir):
    old, new = _snapshot(spark, sf_dir, OLD), _snapshot(spark, sf_dir, NEW)
    named = old.join(new, "ref", "left_anti").where("cast(ref AS int) % 2 = 0").select("ref")
    return incremental.diff(old, new, partial=True, removed=named)


@query("SELECT ref, CASE WHEN ordinal % 4 = 1 THEN 'new ' || title ELSE title END AS title FROM sessions WHERE (ordinal % 3 <> 0 OR ordinal % 4 = 1) AND (ordinal % 7 <> 2 OR ordinal % 4 = 1)", *BASE)
def apply_changes(spark, sf_dir):
    heads = lens.heads(spark, sf_dir)
    snapshot = heads.where("ordinal % 3 <> 0").select("ref", "title")
    upserts = heads.where("ordinal % 4 = 1").select("ref", F.concat(F.lit("new "), "title").alias("title"))
    return incremental.apply_changes(snapshot, upserts, heads.where("ordinal % 7 = 2").select("ref"))


@query("SELECT ref, coalesce(CASE WHEN ordinal % 4 = 1 THEN nullif('s' || ordinal % 8, 's5') END, CASE WHEN ordinal % 3 <> 0 THEN 't' || ordinal END) AS meta, CASE WHEN ordinal % 4 = 1 THEN 'source' ELSE 'target' END AS title FROM sessions WHERE ordinal % 3 <> 0 OR ordinal % 4 = 1", *BASE)
def merge_heads(spark, sf_dir):
    heads = lens.heads(spark, sf_dir)
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    target = heads.where("ordinal % 3 <> 0").select("ref", text("t", F.col("ordinal")).alias("meta"), F.lit("target").alias("title"))
    source = heads.where("ordinal % 4 = 1").select("ref", F.nullif(text("s", F.col("ordinal") % 8), F.lit("s5")).alias("meta"), F.lit("source").alias("title"))
    return incremental.merge_heads(target, source, ["meta"])


@query("SELECT user_id AS key, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'upsert' END AS op, epoch_us(ts) AS at_us, CASE WHEN event_type <> 'error' THEN round(value, 2) END AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def coalesce_events(spark, sf_dir):
    rows = lens.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "remove").otherwise("upsert").alias("op"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), F.round("value", 2).alias("value"))
    return incremental.coalesce_events(rows).withColumnRenamed("at", "at_us")


@query("SELECT m.ref, m.message_index, m.role FROM m JOIN (SELECT ref, CASE WHEN ref::INT % 2 = 0 THEN 2 ELSE 0 END AS start FROM m GROUP BY 1, 2) USING (ref) WHERE message_index >= start", TALKS)
def detail_append(spark, sf_dir):
    messages, _ = talks(spark, sf_dir)
    messages = messages.withColumn("digest", F.sha2("text", 256))
    order = F.array_sort(F.collect_list(F.struct("message_index", "digest")))
    seen = messages.where("message_index < 2").groupBy("ref").agg(F.sha2(F.array_join(F.transform(order, lambda x: x["digest"]), ","), 256).alias("whole"))
    cursor = seen.select("ref", F.lit(2).alias("seen"), F.when(F.col("ref").cast("int") % 2 == 0, F.col("whole")).otherwise("stale").alias("digest"))
    return incremental.appended(messages, cursor).select("ref", "message_index", "role")


@query("SELECT session_id AS ref, role, tool, count(*) AS n FROM messages GROUP BY ALL", MESSAGES_SQL)
def detail_toc(spark, sf_dir):
    return transcript.contents(lens.messages(spark, sf_dir).withColumnRenamed("session_id", "ref"))


@query("""SELECT session_id AS ref, block, any_value(tool) AS type, string_agg(path, chr(10) ORDER BY message_index) AS text, count(*) AS parts FROM (SELECT *, sum(start) OVER (PARTITION BY session_id ORDER BY message_index)::BIGINT AS block
  FROM (SELECT *, CASE WHEN lag(tool) OVER (PARTITION BY session_id ORDER BY message_index) = tool THEN 0 ELSE 1 END AS start FROM messages)) GROUP BY 1, 2""", MESSAGES_SQL)
def display_blocks(spark, sf_dir):
    parts = lens.messages(spark, sf_dir).select(F.col("session_id").alias("ref"), F.col("message_index").alias("pos"), F.col("tool").alias("type"), F.col("path").alias("text"))
    return transcript.display_blocks(parts)


TAGGED = """tagged AS (SELECT session_id AS ref, role, tool, CASE order_key % 5 WHEN 0 THEN 'please fix the crash' WHEN 1 THEN 'Add the readme' WHEN 2 THEN '重构 prefix' ELSE 'affix hello' END AS text,
  CASE message_index % 6 WHEN 0 THEN 'git commit -m x' WHEN 1 THEN 'pytest -q' WHEN 2 THEN 'npm run build' ELSE 'ls' END AS payload, CASE WHEN tool = 'edit' AND message_index % 4 = 0 THEN 'guide/INTRO.md' ELSE path END AS edited_path, message_index = 5 AS is_plan FROM messages)"""


def _flag(tag: str, test: str) -> str:
    return f"CASE WHEN {test} THEN ['{tag}'] ELSE [] END"


def _words(column: str, words: str, other: str = "") -> str:
    return f"coalesce(bool_or(regexp_matches({column}, '(?i)\\b(?:{words})\\b{'|' + other if other else ''}')), false)"


USER = "CASE WHEN role = 'user' THEN text END"
TAG_SQL = [_flag(t, _words(USER, *tags.USER_WORDS[t])) for t in ("bugfix", "refactoring", "feature-dev")] + [
    _flag("testing", _words("payload", tags.TESTING)), _flag("docs", _words(USER, *tags.USER_WORDS["docs"]) + " OR coalesce(bool_or(regexp_matches(edited_path, '(?i)\\.(md|mdx|txt|rst|adoc)$')), false)"),
    _flag("git-ops", _words("payload", tags.GIT)), _flag("build-deploy", _words("payload", tags.BUILD)), _flag("exploration", "count(*) FILTER (WHERE tool = 'read') >= 3 AND count(*) FILTER (WHERE tool = 'edit') <= 1"), _flag("planning", "bool_or(is_plan)"),
]


@query(f"SELECT ref, array_to_string({' || '.join(TAG_SQL)}, ',') AS tags FROM tagged GROUP BY ref", MESSAGES_SQL, TAGGED)
def smart_tags(spark, sf_dir):
    rows = lens.messages(spark, sf_dir).select(
        F.col("session_id").alias("ref"), "role", F.col("tool").alias("tool_name"), F.expr("CASE order_key % 5 WHEN 0 THEN 'please fix the crash' WHEN 1 THEN 'Add the readme' WHEN 2 THEN '重构 prefix' ELSE 'affix hello' END AS text"),
        F.expr("CASE message_index % 6 WHEN 0 THEN 'git commit -m x' WHEN 1 THEN 'pytest -q' WHEN 2 THEN 'npm run build' ELSE 'ls' END AS payload"),
        F.expr("CASE WHEN tool = 'edit' AND message_index % 4 = 0 THEN 'guide/INTRO.md' ELSE path END AS edited_path"), (F.col("message_index") == 5).alias("is_plan"),
    )
    return tags.session_tags(rows).select("ref", F.array_join("tags", ",").alias("tags"))


NAMED = "CASE message_index % 4 WHEN 0 THEN model WHEN 1 THEN concat('openai/', model) WHEN 2 THEN concat(model, '-20240101') ELSE concat(model, '-preview') END"


@query(f"""SELECT session_id AS ref, message_index, {NAMED} AS model, round(greatest(input - cache_read - cache_create, 0) * price + (output + reasoning) * price * 5 + cache_read * price / 10 + cache_create * price * 1.25, 8) AS cost
  FROM messages JOIN (SELECT 'brand#' || k AS price_key, k * 1e-6 AS price FROM range(1, 21) r(k)) ON lower(model) = price_key""", MESSAGES_SQL)
def cost_estimate(spark, sf_dir):
    rows = lens.messages(spark, sf_dir).withColumn("model", F.expr(NAMED))
    price = F.col("id") * 1e-6
    prices = spark.range(1, 21).select(F.concat(F.lit("brand#"), F.col("id").cast("string")).alias("price_key"), price.alias("input_price"), (price * 5).alias("output_price"), (price / 10).alias("read_price"), (price * 1.25).alias("create_price"))
    keys = pricing.resolve_prices(rows.select("model"), prices)
    priced = rows.join(F.broadcast(keys), "model").join(F.broadcast(prices), "price_key")  # one row a model name, a fixed dimension
    return priced.select(F.col("session_id").alias("ref"), "message_index", "model", pricing.message_cost().alias("cost"))


RECORDS = """records AS (SELECT session_id AS ref, message_index AS line, CASE WHEN message_index % 3 = 2 THEN 0 ELSE input END AS input, CASE WHEN message_index % 3 = 2 THEN 0 ELSE output END AS output FROM messages)"""


@query("SELECT ref, line, input, output, 0 AS reasoning, 0 AS cached FROM records WHERE input > 0", MESSAGES_SQL, RECORDS)
def token_delta(spark, sf_dir):
    part = lambda c: F.when(F.col("message_index") % 3 == 2, 0).otherwise(F.col(c))
    running = lambda c: F.sum(part(c)).over(W.partitionBy("session_id").orderBy("message_index"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    records = lens.messages(spark, sf_dir).select(
        F.col("session_id").alias("ref"), F.col("message_index").cast("long").alias("line"), (running("input") + running("output")).alias("total"), running("input").alias("total_input"), running("output").alias("total_output"),
        zero.alias("total_reasoning"), zero.alias("total_cached"), *[none.alias(f"last_{c}") for c in usage.COUNTERS],
    )
    return usage.token_deltas(records)


@query("SELECT user_id::VARCHAR AS ref, event_type AS request, min(event_id) AS line, arg_min(event_id * 3, event_id) AS input, arg_min(user_id, event_id) AS output FROM events GROUP BY 1, 2")
def usage_dedup(spark, sf_dir):
    rows = lens.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("ref"), F.col("event_type").alias("request"), F.col("event_id").alias("line"), (F.col("event_id") * 3).alias("input"), F.col("user_id").alias("output"))
    return usage.first_usage(rows)


@query(None)
def message_digests(spark, sf_dir):
    return usage.digest_chain(talks(spark, sf_dir)[0])


@query("SELECT session_id AS ref, message_index::VARCHAR AS id, message_index AS depth FROM messages", MESSAGES_SQL)
def visible_branch(spark, sf_dir):
    rows = lens.messages(spark, sf_dir).select(F.col("session_id").alias("ref"), F.col("message_index").alias("line"), F.col("message_index").cast("string").alias("id"), F.when(F.col("message_index") > 0, (F.col("message_index") - 1).cast("string")).alias("parent_id"))
    return transcript.visible_branch(rows)
