"""Evaluation dashboards over the driver's tables: orders are tasks, customers runs, line items the tasks' metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.functions import formats
from tarnfold.operators import evals
from tarnfold.plans.registry import query, table

NOW = datetime(1998, 8, 2)
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PASSED = "CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END"
TASKS = f"tasks AS (SELECT o_orderkey AS id, o_custkey AS run_id, o_orderpriority AS language, {PASSED} AS passed, o_orderdate AS created_at FROM orders)"
METRICS = "metrics AS (SELECT l_orderkey AS task_id, CAST(l_quantity AS BIGINT) AS tokens_in, CAST(l_quantity * 2 AS BIGINT) AS tokens_out, l_extendedprice AS cost, CAST(l_linenumber AS BIGINT) AS duration FROM lineitem)"


def tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_custkey AS run_id", "o_orderpriority AS language", f"{PASSED} AS passed", "o_orderdate AS created_at")


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_orderkey AS task_id", "CAST(l_quantity AS BIGINT) AS tokens_in", "CAST(l_quantity * 2 AS BIGINT) AS tokens_out", "l_extendedprice AS cost", "CAST(l_linenumber AS BIGINT) AS duration")


@query("language_scores", f"WITH {TASKS} SELECT run_id, language, sum(CASE WHEN passed THEN 1 ELSE 0 END)::DOUBLE / count(*) AS score FROM tasks GROUP BY 1, 2")
def language_scores(spark, d):
    return evals.language_scores(tasks(spark, d))


@query(
    "language_scores_pivot",
    f"WITH {TASKS}, s AS (SELECT run_id, language, sum(CASE WHEN passed THEN 1 ELSE 0 END)::DOUBLE / count(*) AS score FROM tasks GROUP BY 1, 2) SELECT run_id, "
    + ", ".join(f"coalesce(max(CASE WHEN language = '{p}' THEN score END), 0.0) AS \"{p}\"" for p in PRIORITIES)
    + " FROM s GROUP BY 1",
)
def language_scores_pivot(spark, d):
    return evals.pivot_scores(evals.language_scores(tasks(spark, d)), PRIORITIES)


@query(
    "finish_run_totals",
    f"WITH {TASKS}, {METRICS} SELECT run_id, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum(cost), 2) AS cost, CAST(sum(duration) AS BIGINT) AS duration, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(sum(CASE WHEN coalesce(passed, false) THEN 0 ELSE 1 END) AS BIGINT) AS failed FROM metrics JOIN tasks ON id = task_id GROUP BY 1",
)
def finish_run_totals(spark, d):
    return evals.finish_run(tasks(spark, d), metrics(spark, d)).withColumn("cost", F.round("cost", 2))


@query(
    "run_stats",
    f"WITH {TASKS}, s AS (SELECT run_id, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) AS n FROM tasks GROUP BY 1) SELECT run_id, passed, failed, passed + failed AS completed, n - passed - failed AS remaining, CASE WHEN passed + failed > 0 THEN round(100 * (passed::DOUBLE / (passed + failed)), 1) END AS pass_rate FROM s",
)
def run_stats(spark, d):
    return evals.run_stats(tasks(spark, d))


@query(
    "run_status_groups",
    "SELECT o_custkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1, 2",
)
def run_status_groups(spark, d):
    t = tasks(spark, d)
    status = evals.task_status(F.col("passed"), F.col("created_at"), F.lit(None).cast("timestamp_ntz"))
    return evals.status_groups(t, status, "id").withColumn("ids", F.concat_ws(",", "ids"))


@query(
    "run_elapsed",
    "SELECT o_orderkey AS id, epoch_ms(greatest(coalesce(max(l_shipdate), TIMESTAMP '1998-08-02'), any_value(o_orderdate))) - epoch_ms(any_value(o_orderdate)) AS elapsed_ms FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
def run_elapsed(spark, d):
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("finished"))
    o = table(spark, d, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(F.col("o_orderkey").alias("id"), evals.elapsed_ms(F.col("o_orderdate"), F.col("finished"), F.lit(NOW).cast("timestamp_ntz")).alias("elapsed_ms"))


@query(
    "runs_filtered_sorted",
    "WITH r AS (SELECT o_orderkey AS id, c_mktsegment AS model, o_orderdate AS created_at, (o_orderkey % 7) AS passed, (o_orderkey % 3) AS failed FROM orders JOIN customer ON c_custkey = o_custkey) SELECT id, model, passed, failed, CASE WHEN passed + failed = 0 THEN 0.0 ELSE round(passed::DOUBLE / (passed + failed), 6) END AS percent FROM r WHERE created_at >= TIMESTAMP '1998-08-02' - INTERVAL 90 DAY AND model IN ('BUILDING', 'MACHINERY')",
)
def runs_filtered_sorted(spark, d):
    o = table(spark, d, "orders").where(evals.within(F.col("o_orderdate"), "90d", NOW))
    c = table(spark, d, "customer").where(evals.one_of(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]))
    r = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("model"), (F.col("o_orderkey") % 7).alias("passed"), (F.col("o_orderkey") % 3).alias("failed"))
    percent = F.coalesce(F.try_divide(F.col("passed").cast("double"), F.col("passed") + F.col("failed")), F.lit(0.0))
    return evals.sort_runs(r.withColumn("percent", F.round(percent, 6)), "percent")


@query(
    "leaderboard",
    f"WITH {TASKS}, s AS (SELECT run_id, language, sum(CASE WHEN passed THEN 1 ELSE 0 END)::DOUBLE / count(*) AS score FROM tasks GROUP BY 1, 2), r AS (SELECT run_id, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(sum(CASE WHEN coalesce(passed, false) THEN 0 ELSE 1 END) AS BIGINT) AS failed FROM tasks GROUP BY 1) SELECT c_custkey AS id, c_mktsegment AS label, passed, failed, round(passed::DOUBLE / (passed + failed), 6) AS score, round(coalesce(max(CASE WHEN language = '1-URGENT' THEN s.score END), 0.0), 6) AS urgent FROM customer JOIN r ON r.run_id = c_custkey JOIN s ON s.run_id = c_custkey GROUP BY 1, 2, 3, 4",
)
def leaderboard(spark, d):
    t = tasks(spark, d)
    totals = t.groupBy("run_id").agg(evals.count_if(F.col("passed")).alias("passed"), evals.count_if(~F.coalesce("passed", F.lit(False))).alias("failed"))
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("model"), F.lit("").alias("description")).join(totals.withColumnRenamed("run_id", "id"), "id")
    board = evals.leaderboard(runs, evals.pivot_scores(evals.language_scores(t), PRIORITIES))
    return board.select("id", "label", "passed", "failed", F.round("score", 6).alias("score"), F.round("1-URGENT", 6).alias("urgent"))


def usage(spark, d):
    """events as tool usage of users: one map a user and day."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.to_date("ts").alias("day"), F.col("event_type").alias("tool"), F.when(F.col("value") > 50, 1).otherwise(0).alias("bad"))
    per = e.groupBy("run_id", "day", "tool").agg(F.count("*").alias("attempts"), F.sum("bad").alias("failures"))
    maps = evals.usage_map(per, "run_id", "day").withColumn("id", F.xxhash64("run_id", "day"))
    return maps.select("id", "run_id"), maps.select(F.col("id").alias("task_id"), "tool_usage")


PER_DAY = "per AS (SELECT user_id AS run_id, CAST(ts AS DATE) AS day, event_type AS tool, count(*) AS attempts, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS failures FROM events GROUP BY 1, 2, 3)"


@query("tool_usage_sum", f"WITH {PER_DAY} SELECT run_id, tool, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(failures) AS BIGINT) AS failures FROM per GROUP BY 1, 2")
def tool_usage_sum(spark, d):
    return evals.tool_usage(*usage(spark, d))


@query("tool_usage_max", f"WITH {PER_DAY} SELECT run_id, tool, max(attempts) AS attempts, max(failures) AS failures FROM per GROUP BY 1, 2")
def tool_usage_max(spark, d):
    return evals.tool_usage(*usage(spark, d), how="max")


RANK = "r AS (SELECT event_type AS tool, count(*) AS attempts, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS failures FROM events GROUP BY 1)"


def ranking(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("attempts"), F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).alias("failures"))


@query("tool_ranking", f"WITH {RANK} SELECT tool, attempts, failures, round(100.0 * (attempts - failures) / attempts, 4)::DOUBLE AS success_rate, upper(substr(tool, 1, 1)) AS short FROM r")
def tool_ranking(spark, d):
    r = ranking(spark, d)
    return r.select("tool", "attempts", "failures", F.round(evals.success_rate(F.col("attempts"), F.col("failures")), 4).alias("success_rate"), formats.abbreviation(F.col("tool")).alias("short")).orderBy(F.desc("attempts"), "tool")


@query(
    "tool_group_rollup",
    f"WITH {RANK}, g AS (SELECT * FROM (VALUES ('browse', 'view'), ('browse', 'click'), ('money', 'purchase'), ('all', 'view'), ('all', 'click'), ('all', 'purchase'), ('all', 'error'), ('all', 'signup')) v(\"group\", tool)) SELECT \"group\", CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(failures) AS BIGINT) AS failures, round((100.0 * (sum(attempts) - sum(failures)) / sum(attempts))::DOUBLE, 4) AS success_rate, count(*) AS n_tools FROM r JOIN g USING (tool) GROUP BY 1",
)
def tool_group_rollup(spark, d):
    groups = {"browse": ["view", "click"], "money": ["purchase"], "all": ["view", "click", "purchase", "error", "signup"]}
    return evals.tool_groups(ranking(spark, d), groups).withColumn("success_rate", F.round("success_rate", 4))


@query("daily_usage_stats", "SELECT CAST(ts AS DATE) AS date, count(*) AS tasks, CAST(sum(user_id) AS BIGINT) AS tokens, round(sum(value), 2) AS cost FROM events GROUP BY ROLLUP (CAST(ts AS DATE))")
def daily_usage_stats(spark, d):
    return evals.daily_usage(table(spark, d, "events"), "ts", "user_id", "value")


@query("suite_expansion", "SELECT r_name AS language, n_name AS exercise, i::INTEGER AS iteration FROM region JOIN nation ON n_regionkey = r_regionkey, range(1, 5) t(i)")
def suite_expansion(spark, d):
    r = table(spark, d, "region").select(F.col("r_name").alias("language"), "r_regionkey")
    n = table(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("language", F.col("n_name").alias("exercise"))
    return evals.expand_suite(r.select("language"), n, 4)


@query("plot_neighbours", "WITH p AS (SELECT s_suppkey AS id, s_acctbal / 100 AS cost, (s_suppkey % 60)::DOUBLE AS score FROM supplier) SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id < b.id AND abs(a.cost - b.cost) < 3 AND abs(a.score - b.score) < 6")
def plot_neighbours(spark, d):
    p = table(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_acctbal / 100 AS cost", "CAST(s_suppkey % 60 AS DOUBLE) AS score")
    return evals.neighbours(p, 3, 6)


CONFIGS = "o AS (SELECT p_name || p_partkey AS name, p_brand AS config FROM part WHERE p_size < 30), n AS (SELECT p_name || p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_brand END AS config FROM part WHERE p_size > 20)"


@query("config_changes", f"WITH {CONFIGS} SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' WHEN o.config IS NOT DISTINCT FROM n.config THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.name = n.name")
def config_changes(spark, d):
    p = table(spark, d, "part").withColumn("name", F.concat("p_name", "p_partkey"))
    old = p.where("p_size < 30").select("name", F.col("p_brand").alias("config"))
    new = p.where("p_size > 20").select("name", F.expr("CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_brand END").alias("config"))
    return evals.config_changes(old, new)


@query("override_union", "SELECT * EXCLUDE (n, prio) FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY prio, id) AS n FROM (SELECT p_brand AS name, p_partkey AS id, 'project' AS source, 1 AS prio FROM part WHERE p_size < 10 UNION ALL SELECT p_brand, p_partkey, 'global', 2 FROM part WHERE p_size BETWEEN 10 AND 30 UNION ALL SELECT p_brand, p_partkey, 'builtin', 3 FROM part)) WHERE n = 1")
def override_union(spark, d):
    p = table(spark, d, "part")
    one = lambda where, source, prio: p.where(where).select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("id"), F.lit(source).alias("source"), F.lit(prio).alias("prio"))
    every = one("p_size < 10", "project", 1).unionByName(one("p_size BETWEEN 10 AND 30", "global", 2)).unionByName(one("true", "builtin", 3))
    return evals.first_by_priority(every, "name", [F.col("prio"), F.col("id")]).drop("prio")


@query("catalogue_enrichment", "SELECT s_suppkey AS id, s_name AS model, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END, n_nationkey::DOUBLE) AS price FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 15")
def catalogue_enrichment(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name"), F.col("s_nationkey").alias("model"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END").alias("price"))
    n = table(spark, d, "nation").where("n_nationkey < 15").select(F.col("n_nationkey").alias("model"), F.col("n_nationkey").cast("double").alias("price"))
    return evals.enrich(s, n, ["price"]).select("id", F.col("s_name").alias("model"), "price")


@query("live_usage", f"WITH {TASKS}, s AS (SELECT l_orderkey AS task_id, max(l_quantity) AS q, min(l_linenumber) - 1 AS dur FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), v AS (SELECT l_orderkey AS task_id, min(l_quantity) AS q FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) SELECT id, CASE WHEN passed IS NOT NULL THEN coalesce(s.q, v.q) ELSE coalesce(v.q, s.q) END AS tokens_in, CAST(nullif(s.dur, 0) AS BIGINT) AS duration FROM tasks LEFT JOIN s ON s.task_id = id LEFT JOIN v ON v.task_id = id")
def live_usage(spark, d):
    li = table(spark, d, "lineitem")
    shape = lambda df, q, dur: df.groupBy(F.col("l_orderkey").alias("task_id")).agg(q.alias("tokens_in"), F.lit(0.0).alias("tokens_out"), F.lit(0.0).alias("cost"), dur.cast("long").alias("duration"))
    stored = shape(li.where("l_returnflag = 'R'"), F.max("l_quantity"), F.min("l_linenumber") - 1)
    live = shape(li.where("l_returnflag <> 'R'"), F.min("l_quantity"), F.max(F.lit(0)))
    t = tasks(spark, d).withColumn("started_at", F.lit(None).cast("timestamp_ntz")).withColumn("finished_at", F.when(F.col("passed").isNotNull(), F.col("created_at")))
    return evals.live_usage(t, stored, live).select("id", "tokens_in", "duration")


@query("option_lists", "SELECT DISTINCT 'segment' AS kind, c_mktsegment AS option FROM customer WHERE c_mktsegment <> '' UNION ALL SELECT DISTINCT 'priority', o_orderpriority FROM orders WHERE o_orderpriority <> ''")
def option_lists(spark, d):
    one = lambda t, c, kind: table(spark, d, t).select(F.lit(kind).alias("kind"), F.col(c).alias("option")).where("option <> ''").distinct()
    return one("customer", "c_mktsegment", "segment").unionByName(one("orders", "o_orderpriority", "priority")).orderBy("kind", "option")


@query("run_counts", "SELECT count(*) FILTER (o_orderstatus = 'P') AS incomplete, count(*) FILTER (o_orderdate < TIMESTAMP '1998-08-02' - INTERVAL 30 DAY) AS old FROM orders")
def run_counts(spark, d):
    old = ~evals.within(F.col("o_orderdate"), "30d", NOW)
    return table(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "P").alias("incomplete"), F.count_if(old).alias("old"))


COST = "SELECT l_orderkey AS id, l_linenumber AS line, round("


@query("api_cost_anthropic", COST + "(l_tax * 1000 * 3.75 + l_discount * 1000 * 0.3 + l_quantity * 1000 * 3 + l_linenumber * 500 * 15) / 1e6, 8) AS cost FROM lineitem")
def api_cost_anthropic(spark, d):
    return _cost(spark, d, False)


@query("api_cost_openai", COST + "(l_tax * 1000 * 3.75 + l_discount * 1000 * 0.3 + greatest(l_quantity * 1000 - l_tax * 1000 - l_discount * 1000, 0) * 3 + l_linenumber * 500 * 15) / 1e6, 8) AS cost FROM lineitem")
def api_cost_openai(spark, d):
    return _cost(spark, d, True)


def _cost(spark, d, input_has_cache):
    li = table(spark, d, "lineitem")
    prices = {"cache_writes": 3.75, "cache_reads": 0.3, "input": 3, "output": 15}
    c = formats.api_cost(F.col("l_quantity") * 1000, F.col("l_linenumber") * 500, F.col("l_tax") * 1000, F.col("l_discount") * 1000, prices, input_has_cache)
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.round(c, 8).alias("cost"))


@query("long_context_pricing", "SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_quantity > 25 AND l_returnflag <> 'N' THEN l_extendedprice * 2 ELSE l_extendedprice END AS price FROM lineitem")
def long_context_pricing(spark, d):
    price = formats.long_context(F.col("l_quantity"), F.col("l_extendedprice"), 25, 2.0, F.col("l_returnflag") != "N")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), price.alias("price"))


@query("context_threshold", "SELECT l_orderkey AS id, l_linenumber AS line, (100.0 * l_extendedprice / 100000 >= CASE WHEN l_linenumber = 1 THEN 60 WHEN l_linenumber * 20 BETWEEN 5 AND 100 THEN l_linenumber * 20 ELSE 60 END) OR l_extendedprice > 100000 * 0.9 - 8192 AS condense FROM lineitem")
def context_threshold(spark, d):
    t = F.when(F.col("l_linenumber") == 1, -1).otherwise(F.col("l_linenumber") * 20)
    c = formats.over_context(F.col("l_extendedprice"), F.lit(100000), F.lit(8192), t, F.lit(60))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), c.alias("condense"))


@query("number_formats", "WITH x AS (SELECT p_partkey AS id, CAST(p_retailprice * p_size * 17 AS BIGINT) AS n FROM part) SELECT id, CAST(floor(n / 1000 / 3600) AS BIGINT)::VARCHAR || ':' || lpad(CAST(CAST(floor(floor(n / 1000) % 3600 / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(n / 1000) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS duration, CAST(floor(n / 1000.0 + 0.5) AS BIGINT) AS thousands FROM x")
def number_formats(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") * F.col("p_size") * 17).alias("n")).withColumn("n", F.round("n").cast("long"))
    return x.select("id", formats.duration(F.col("n")).alias("duration"), formats.js_round(F.col("n") / 1000).alias("thousands"))
