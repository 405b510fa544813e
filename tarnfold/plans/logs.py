"""Message logs and histories over the driver's tables: events and conversations as logs of users and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.operators import history, messages
from tarnfold.plans.registry import query, table
from tarnfold.streaming import folds, streams

EVENTS = "log AS (SELECT user_id AS task_id, event_id AS seq, event_type AS type, value, props AS text, ts FROM events)"
TURNS = "log AS (SELECT conv_id AS task_id, turn AS seq, role AS type, text FROM conversations)"


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), "value", F.col("props").alias("text"), "ts")


def turns(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("seq"), F.col("role").alias("type"), "text")


@query("latest_event_per_user", f"WITH {EVENTS} SELECT task_id, arg_max(type, seq) AS type, arg_max(value, seq) AS value FROM log GROUP BY 1")
def latest_event_per_user(spark, d):
    return streams.latest(events(spark, d), "task_id", "type", "value")


@query("event_dedup_consecutive", f"WITH {EVENTS}, x AS (SELECT *, lag(type) OVER (PARTITION BY task_id ORDER BY seq) AS before FROM log) SELECT task_id, seq, type FROM x WHERE before IS NULL OR before <> type")
def event_dedup_consecutive(spark, d):
    return messages.repetitions(events(spark, d), "type", 3).where("run = 1").select("task_id", "seq", "type")


@query("repetition_flags", f"WITH {EVENTS}, x AS (SELECT *, CASE WHEN lag(type) OVER w = type THEN 0 ELSE 1 END AS fresh FROM log WINDOW w AS (PARTITION BY task_id ORDER BY seq)), y AS (SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY seq) AS g FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY task_id, g ORDER BY seq) AS run FROM y) SELECT task_id, seq, CAST(run AS INTEGER) AS run, run % 3 = 0 AS flagged FROM z")
def repetition_flags(spark, d):
    return messages.repetitions(events(spark, d), "type", 3).select("task_id", "seq", "run", "flagged")


@query("event_islands", f"WITH {EVENTS}, x AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq) - row_number() OVER (PARTITION BY task_id, type IN ('view', 'click') ORDER BY seq) AS g, type IN ('view', 'click') AS w FROM log) SELECT task_id, min(seq) AS seq, count(*) AS n FROM x WHERE w GROUP BY task_id, g UNION ALL SELECT task_id, seq, 1 FROM x WHERE NOT w")
def event_islands(spark, d):
    return messages.batch_consecutive(events(spark, d), F.col("type").isin("view", "click")).select("task_id", "seq", "n")


@query("debounce_sessions", "WITH x AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events), y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id, max(ts) AS last, count(*) AS n FROM y GROUP BY user_id, g")
def debounce_sessions(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("at", "6 hours")).agg(F.max("ts").alias("last"), F.count("*").alias("n")).select("user_id", "last", "n")


STACK = "x AS (SELECT *, CASE type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 END AS d FROM log WHERE type IN ('signup', 'purchase')), c AS (SELECT *, sum(d) OVER (PARTITION BY task_id ORDER BY seq) AS c FROM x), m AS (SELECT *, least(0, min(c) OVER (PARTITION BY task_id ORDER BY seq)) AS m FROM c), p AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY task_id ORDER BY seq), 0) AS b FROM m), l AS (SELECT *, c - m + CASE WHEN d < 0 THEN 1 ELSE 0 END AS level FROM p WHERE d > 0 OR m = b), g AS (SELECT *, lag(CASE WHEN d > 0 THEN seq END) OVER (PARTITION BY task_id, level ORDER BY seq) AS start_seq FROM l)"


@query("request_pairing", f"WITH {EVENTS}, {STACK} SELECT task_id, start_seq, seq AS finish_seq FROM g WHERE d < 0")
def request_pairing(spark, d):
    return messages.pairs(events(spark, d), F.col("type") == "signup", F.col("type") == "purchase")


@query("request_pairing_by_stack", f"WITH {EVENTS}, {STACK} SELECT task_id, start_seq, seq AS finish_seq FROM g WHERE d < 0")
def request_pairing_by_stack(spark, d):
    """The same pairs by a fold that keeps the stack: what a stream does."""

    def stack(state, e):
        state = state or []
        if e["type"] == "signup":
            return [*state, e["seq"]], []
        return (state[:-1], [(state[-1], e["seq"])]) if state else (state, [])

    return folds.replay(events(spark, d).where("type IN ('signup', 'purchase')").select("task_id", "seq", "type"), ["task_id"], stack, "start_seq long, finish_seq long")


@query("consolidated_requests", f"WITH {EVENTS}, {STACK} SELECT log.task_id, log.seq, log.type, coalesce(json_extract_string(e.text, '$.k'), json_extract_string(log.text, '$.k')) AS k FROM log LEFT JOIN g ON g.task_id = log.task_id AND g.start_seq = log.seq AND g.d < 0 LEFT JOIN log e ON e.task_id = g.task_id AND e.seq = g.seq WHERE log.type <> 'purchase'")
def consolidated_requests(spark, d):
    out = messages.consolidate_requests(events(spark, d), F.col("type") == "signup", F.col("type") == "purchase")
    return out.select("task_id", "seq", "type", F.get_json_object("text", "$.k").alias("k"))


@query("command_grouping", f"WITH {TURNS}, x AS (SELECT *, sum(CASE WHEN type = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY seq) AS g FROM log), o AS (SELECT task_id, g, string_agg(text, chr(10) ORDER BY seq) AS j FROM x WHERE type = 'assistant' AND g > 0 AND text <> '' GROUP BY 1, 2) SELECT x.task_id, x.seq, x.type, CASE WHEN x.type = 'user' AND j IS NOT NULL THEN text || chr(10) || 'Output:' || j ELSE text END AS text FROM x LEFT JOIN o ON o.task_id = x.task_id AND o.g = x.g WHERE x.type <> 'assistant'")
def command_grouping(spark, d):
    return messages.consolidate_commands(turns(spark, d), F.col("type") == "user", F.col("type") == "assistant")


TRUNC = "r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS rank, count(*) OVER (PARTITION BY task_id) AS n FROM log), k AS (SELECT *, CAST(floor((n - 1) * 0.5) AS BIGINT) - CAST(floor((n - 1) * 0.5) AS BIGINT) % 2 AS k FROM r)"


@query("conversation_truncate", f"WITH {TURNS}, {TRUNC} SELECT task_id, seq, rank >= 2 AND rank <= k + 1 AS hidden FROM k")
def conversation_truncate(spark, d):
    return messages.truncate(turns(spark, d), 0.5).select("task_id", "seq", "hidden")


@query("truncation_markers", f"WITH {TURNS}, {TRUNC} SELECT task_id, max(seq) AS after_seq, count(*) AS messages_removed FROM k WHERE rank >= 2 AND rank <= k + 1 GROUP BY 1")
def truncation_markers(spark, d):
    return messages.markers(messages.truncate(turns(spark, d), 0.5))


@query("since_last_summary", f"WITH {TURNS}, x AS (SELECT *, max(CASE WHEN type = 'system' THEN seq END) OVER (PARTITION BY task_id) AS m FROM log) SELECT task_id, seq, type FROM x WHERE m IS NULL OR seq >= m")
def since_last_summary(spark, d):
    return messages.since_last(turns(spark, d), F.col("type") == "system").select("task_id", "seq", "type")


IDS = "u AS (SELECT task_id, seq, seq // 2 AS tool_use_id FROM log WHERE type = 'user'), r AS (SELECT task_id, seq, (seq + CASE WHEN task_id % 3 = 0 THEN 2 ELSE 0 END) // 2 AS tool_use_id FROM log WHERE type = 'assistant')"


def uses(spark, d):
    t = turns(spark, d)
    u = t.where("type = 'user'").selectExpr("task_id", "seq", "seq div 2 AS tool_use_id")
    r = t.where("type = 'assistant'").selectExpr("task_id", "seq", "(seq + CASE WHEN task_id % 3 = 0 THEN 2 ELSE 0 END) div 2 AS tool_use_id")
    return u, r


@query("effective_history", f"WITH {TURNS}, {IDS} SELECT r.task_id, r.seq FROM r WHERE EXISTS (SELECT 1 FROM u WHERE u.task_id = r.task_id AND u.tool_use_id = r.tool_use_id)")
def effective_history(spark, d):
    return messages.split_results(*uses(spark, d))[0].select("task_id", "seq")


@query("orphan_results", f"WITH {TURNS}, {IDS} SELECT r.task_id, r.seq FROM r WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.task_id = r.task_id AND u.tool_use_id = r.tool_use_id)")
def orphan_results(spark, d):
    return messages.split_results(*uses(spark, d))[1].select("task_id", "seq")


@query("repaired_results", f"WITH {TURNS}, {IDS}, f AS (SELECT task_id, tool_use_id, min(seq) AS seq FROM r GROUP BY 1, 2), kept AS (SELECT u.task_id, u.tool_use_id, 'kept' AS how FROM (SELECT task_id, tool_use_id, min(seq) AS seq FROM u GROUP BY 1, 2) u JOIN f USING (task_id, tool_use_id)), o AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS place FROM (SELECT task_id, tool_use_id, min(seq) AS seq FROM u GROUP BY 1, 2) u ANTI JOIN f USING (task_id, tool_use_id)), l AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS place FROM f ANTI JOIN u USING (task_id, tool_use_id)) SELECT * FROM kept UNION ALL SELECT o.task_id, o.tool_use_id, CASE WHEN l.place IS NULL THEN 'made' ELSE 'moved' END FROM o LEFT JOIN l ON l.task_id = o.task_id AND l.place = o.place")
def repaired_results(spark, d):
    u, r = uses(spark, d)
    u = u.groupBy("task_id", "tool_use_id").agg(F.min("seq").alias("seq"))
    out = messages.repair_results(u.withColumn("message", F.lit(0)), r.withColumn("message", F.lit(0)).withColumn("content", F.lit("done")))
    return out.select("task_id", "tool_use_id", "how")


@query("usage_json_totals", f"WITH {EVENTS} SELECT task_id, CAST(coalesce(sum(CAST(json_extract(text, '$.k') AS DOUBLE)) FILTER (type = 'click'), 0) AS BIGINT) AS k FROM log GROUP BY 1")
def usage_json_totals(spark, d):
    log = events(spark, d).withColumn("text", F.replace("text", F.lit('"k"'), F.lit('"tokensIn"')))
    return messages.token_usage(log, F.col("type") == "click").select("task_id", F.col("tokens_in").alias("k"))


@query("context_tokens_last_nonzero", f"WITH {EVENTS}, x AS (SELECT task_id, seq, CAST(json_extract(text, '$.k') AS BIGINT) AS k FROM log WHERE type = 'click') SELECT task_id, coalesce(max(v), 0) AS context_tokens FROM (SELECT DISTINCT task_id FROM log) LEFT JOIN (SELECT task_id, arg_max(k, seq) AS v FROM x WHERE k <> 0 GROUP BY 1) USING (task_id) GROUP BY 1")
def context_tokens_last_nonzero(spark, d):
    log = events(spark, d).withColumn("text", F.replace("text", F.lit('"k"'), F.lit('"tokensIn"')))
    return messages.token_usage(log, F.col("type") == "click").select("task_id", "context_tokens")


@query("rewind_to_time", f"WITH {EVENTS}, c AS (SELECT task_id, TIMESTAMP '2024-01-15' AS cut_ts FROM (SELECT DISTINCT task_id FROM log)), x AS (SELECT log.*, cut_ts, min(CASE WHEN ts = cut_ts THEN seq END) OVER w AS e, max(CASE WHEN ts < cut_ts THEN 1 END) OVER w AS b, min(CASE WHEN type = 'click' AND ts >= cut_ts THEN seq END) OVER w AS a FROM log JOIN c USING (task_id) WINDOW w AS (PARTITION BY task_id)) SELECT task_id, seq FROM x WHERE coalesce(e, CASE WHEN b = 1 THEN a END) IS NULL OR seq < coalesce(e, CASE WHEN b = 1 THEN a END)")
def rewind_to_time(spark, d):
    log = events(spark, d)
    cuts = log.select("task_id").distinct().withColumn("cut_ts", F.lit("2024-01-15").cast("timestamp_ntz"))
    return messages.rewind(log, cuts, F.col("type") == "click").select("task_id", "seq")


@query("request_limits", f"WITH {EVENTS}, x AS (SELECT *, max(CASE WHEN type = 'signup' THEN seq END) OVER (PARTITION BY task_id) AS m FROM log) SELECT task_id, count(*) AS requests, count(*) > 5 AS stopped FROM x WHERE type = 'click' AND (m IS NULL OR seq >= m) GROUP BY 1")
def request_limits(spark, d):
    return messages.limits(events(spark, d), F.col("type") == "click", F.col("type") == "signup", 5, 1e12).select("task_id", "requests", "stopped")


@query("last_relevant", f"WITH {EVENTS} SELECT task_id, coalesce(arg_max(value, seq) FILTER (type <> 'view'), arg_min(value, seq)) AS last FROM log GROUP BY 1")
def last_relevant(spark, d):
    return messages.last_of(events(spark, d), F.col("type") != "view", "value")


@query("agent_states", f"WITH {EVENTS} SELECT task_id, CASE arg_max(type, seq) WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'running' END AS state FROM log GROUP BY 1")
def agent_states(spark, d):
    return messages.agent_state(events(spark, d).withColumn("partial", F.lit(False)), [("error", "failed"), ("purchase", "done")])


@query("visible_rows", f"WITH {TURNS}, x AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS back FROM log) SELECT task_id, seq FROM x WHERE text <> '' AND type <> 'system' AND (type <> 'user' OR back = 1)")
def visible_rows(spark, d):
    log = turns(spark, d).withColumn("hash", F.lit(None).cast("string")).withColumn("images", F.lit(None).cast("array<string>"))
    return messages.visible_rows(log, ["system"], "user").select("task_id", "seq")


@query("latest_state_scd", "SELECT user_id::VARCHAR AS path, event_id AS seq, CASE WHEN lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL THEN 'active' ELSE 'stale' END AS record_state, max(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY user_id ORDER BY event_id) AS read_date FROM events")
def latest_state_scd(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", F.col("ts")).alias("read_date"))
    return history.file_records(log).select("path", "seq", "record_state", "read_date")


@query("recent_files", "SELECT user_id::VARCHAR AS path, max(ts) AS last_read FROM events WHERE event_type = 'view' GROUP BY 1")
def recent_files(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") == "view", F.col("ts")).alias("read_date"))
    return history.files_read(log, "read_date")


TREE = "t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey >= 3 THEN o_orderkey // 3 END AS parent, o_totalprice AS cost FROM orders)"


def tree(spark, d):
    t = table(spark, d, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey >= 3 THEN o_orderkey div 3 END AS parent", "o_totalprice AS total_cost")
    return t, t.where("parent IS NOT NULL").select("parent", F.col("id").alias("child")), t.select("id")


@query("tree_costs", f"WITH RECURSIVE {TREE}, w AS (SELECT id AS root, id, cost, 0 AS lvl FROM t UNION ALL SELECT root, t.id, t.cost, lvl + 1 FROM w JOIN t ON t.parent = w.id) SELECT root, round(sum(CASE WHEN lvl = 0 THEN cost ELSE 0 END), 2) AS own, round(sum(CASE WHEN lvl > 0 THEN cost ELSE 0 END), 2) AS children, round(sum(cost), 2) AS total, count(*) - 1 AS n_subtasks FROM w GROUP BY 1")
def tree_costs(spark, d):
    out = history.tree_costs(*tree(spark, d))
    return out.select("root", *[F.round(c, 2).alias(c) for c in ("own", "children", "total")], "n_subtasks")


@query("subtask_groups", "WITH t AS (SELECT o_orderkey AS id, epoch_ms(o_orderdate) AS ts, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 3 END AS p FROM orders), c AS (SELECT t.* FROM t WHERE p IN (SELECT id FROM t)) SELECT id::VARCHAR AS id, (SELECT count(*) FROM c WHERE c.p = t.id) AS n FROM t WHERE id NOT IN (SELECT id FROM c)")
def subtask_groups(spark, d):
    t = table(spark, d, "orders").selectExpr("CAST(o_orderkey AS STRING) AS id", "unix_millis(CAST(o_orderdate AS TIMESTAMP)) AS ts", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey div 3 AS STRING) END AS parent_task_id")
    return history.groups(t).select("id", F.size("subtasks").cast("long").alias("n"))


@query("history_search", "SELECT o_orderkey AS id, o_totalprice AS cost FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey <> 0 ORDER BY o_totalprice DESC, id LIMIT 50")
def history_search(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ts"), F.col("o_orderstatus").alias("task"), F.col("o_orderpriority").alias("workspace"), F.col("o_totalprice").alias("total_cost"))
    return history.of_workspace(rows, "1-URGENT").orderBy(*history.order_of("mostExpensive")).limit(50).select("id", F.col("total_cost").alias("cost"))


@query("merged_store", "SELECT coalesce(a.p_partkey, b.p_partkey) AS id, coalesce(b.p_name, a.p_name) AS name, coalesce(b.p_size, a.p_size) AS size FROM (SELECT * FROM part WHERE p_size < 30) a FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) END AS p_name, p_size + 1 AS p_size FROM part WHERE p_size > 20) b ON a.p_partkey = b.p_partkey")
def merged_store(spark, d):
    p = table(spark, d, "part")
    rows = p.where("p_size < 30").selectExpr("p_partkey AS id", "p_name AS name", "p_size AS size")
    changes = p.where("p_size > 20").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) END AS name", "p_size + 1 AS size")
    return history.merge_rows(rows, changes)


@query("reconciled_store", "SELECT p_partkey AS id, CASE WHEN p_size < 30 THEN 'stored' ELSE 'disk' END AS origin FROM part WHERE p_size > 20")
def reconciled_store(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    stored, disk = p.where("p_size < 30").withColumn("origin", F.lit("stored")), p.where("p_size > 20").withColumn("origin", F.lit("disk"))
    return history.reconcile(stored.drop("p_size"), disk.drop("p_size"))


@query("lifecycle_states", f"WITH {EVENTS}, f AS (SELECT task_id, min(seq) FILTER (type = 'purchase') AS p, min(seq) FILTER (type = 'signup') AS s FROM log GROUP BY 1) SELECT task_id, s AS seq, 'running' AS state FROM f WHERE s IS NOT NULL AND (p IS NULL OR s < p) UNION ALL SELECT task_id, p, 'finished' FROM f WHERE p IS NOT NULL")
def lifecycle_states(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("signup", "taskStarted", "purchase", "taskCompleted")])
    log = events(spark, d).select("task_id", "seq", F.coalesce(F.element_at(names, F.col("type")), F.lit("other")).alias("event_name"))
    return folds.replay(log, ["task_id"], folds.lifecycle, "seq long, state string")


@query("text_deltas", f"WITH {EVENTS}, x AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY task_id ORDER BY seq), '') AS old FROM log) SELECT task_id, seq, CASE WHEN starts_with(text, old) THEN substr(text, length(old) + 1) ELSE text END AS delta FROM x")
def text_deltas(spark, d):
    log = events(spark, d).select("task_id", "seq", F.col("text").alias("payload"))
    return folds.replay(log, ["task_id"], folds.text_delta, "seq long, delta string")


@query("message_dedup", f"WITH {EVENTS}, x AS (SELECT *, lag(type) OVER (PARTITION BY task_id, seq % 7 ORDER BY seq) AS before FROM log) SELECT task_id, seq, before IS NULL OR before <> type AS fresh FROM x")
def message_dedup(spark, d):
    log = events(spark, d).select("task_id", "seq", (F.col("seq") % 7).alias("ts"), F.col("type").alias("payload"))
    return folds.replay(log, ["task_id"], folds.deduper(), "seq long, fresh boolean")


@query("tool_maxima", "WITH p AS (SELECT user_id AS task_id, CAST(ts AS DATE) AS day, event_type AS tool, count(*) AS a FROM events GROUP BY 1, 2, 3) SELECT task_id, tool, max(a) AS attempts FROM p GROUP BY 1, 2")
def tool_maxima(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("task_id"), F.to_date("ts").alias("day"), F.col("event_type").alias("tool")).agg(F.count("*").alias("attempts"))
    maps = e.groupBy("task_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("tool", F.struct("attempts", F.lit(0).alias("failures"))))).alias("tool_usage"))
    return streams.tool_maxima(maps).select("task_id", "tool", "attempts")


@query("file_change_totals", "SELECT p_brand AS path, CAST(sum(p_size) AS BIGINT) AS added, CAST(sum(p_size // 2) AS BIGINT) AS removed FROM part GROUP BY ROLLUP (p_brand)")
def file_change_totals(spark, d):
    from tarnfold.operators import tools

    log = table(spark, d, "part").select(F.lit(1).alias("task_id"), F.col("p_partkey").alias("seq"), F.to_json(F.struct(F.lit("appliedDiff").alias("tool"), F.col("p_brand").alias("path"), F.col("p_size").alias("added"), F.expr("p_size div 2").alias("removed"))).alias("text"), F.lit(True).alias("is_answered"), F.lit(False).alias("partial"))
    return tools.change_totals(tools.file_changes(log))


@query("character_budget", "WITH x AS (SELECT conv_id AS task_id, turn AS seq, text, 2000 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM conversations) SELECT task_id, seq, CAST(least(length(text), l) AS INTEGER) AS n FROM x WHERE length(text) <= l OR l >= 200")
def character_budget(spark, d):
    from tarnfold.operators import tools

    return tools.character_budget(turns(spark, d), 2000).select("task_id", "seq", F.length("text").alias("n"))


@query("queue_stats", "SELECT count(*) AS size, min(event_id) AS oldest, max(event_id) AS newest, CAST(sum(user_id) AS BIGINT) AS retries, count(CASE WHEN event_type = 'error' THEN 1 END) AS with_error FROM events")
def queue_stats(spark, d):
    from tarnfold.operators import tools

    q = table(spark, d, "events").select(F.col("event_type").alias("type"), F.col("event_id").alias("ts"), F.col("user_id").alias("retries"), F.when(F.col("event_type") == "error", F.lit("x")).alias("last_error"))
    return tools.queue_stats(q).drop("by_type")


@query("telemetry_subscription", "SELECT event_type AS event_name, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1")
def telemetry_subscription(spark, d):
    from tarnfold.operators import tools

    e = table(spark, d, "events").withColumnRenamed("event_type", "event_name")
    return tools.telemetry(e, exclude=["view", "click"]).groupBy("event_name").agg(F.count("*").alias("n"))


@query("token_ranges", f"WITH {TURNS}, x AS (SELECT *, coalesce(sum(CASE WHEN type = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS range FROM log) SELECT task_id, CAST(range AS BIGINT) AS range, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, count(*) AS n FROM x GROUP BY 1, 2")
def token_ranges(spark, d):
    log = turns(spark, d).withColumn("tokens", F.ceil(F.length("text") / 4))
    return messages.token_ranges(log, F.col("type") == "assistant", "tokens")


@query("pinned_history", f"WITH {EVENTS}, c AS (SELECT log.*, CASE WHEN seq % 5 = 0 THEN 'c' || (seq + 5) END AS parent, CASE WHEN type = 'signup' THEN 'c' || seq END AS own FROM log) SELECT task_id, seq FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.task_id = x.task_id AND y.own = x.parent) AND coalesce(seq >= (SELECT max(seq) FROM c z WHERE z.task_id = x.task_id AND z.type = 'signup'), true)")
def pinned_history(spark, d):
    log = events(spark, d).select(
        "task_id", "seq", F.when(F.col("type") == "signup", F.concat(F.lit("c"), "seq")).alias("condense_id"), F.expr("CASE WHEN seq % 5 = 0 THEN concat('c', seq + 5) END").alias("condense_parent"), (F.col("type") == "signup").alias("is_summary"),
        F.lit(False).alias("is_truncation_marker"), F.lit(None).cast("string").alias("truncation_id"), F.lit(None).cast("string").alias("truncation_parent"),
    )
    return messages.visible_history(log).select("task_id", "seq")
