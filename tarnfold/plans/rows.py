"""Paths, stores, listings and small functions over rows of the driver's tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.functions import formats, texts
from tarnfold.operators import evals, history, index, messages, search, tools
from tarnfold.plans.registry import query, table
from tarnfold.streaming import streams

PATH = (
    "concat(CASE WHEN p_size < 10 THEN 'src/node_modules/' WHEN p_size < 20 THEN '.cache/' WHEN p_size < 25 THEN 'target/dependency/' "
    "WHEN p_size < 30 THEN 'logs/' ELSE 'src/' END, p_brand, '/f', p_partkey, CASE WHEN p_size % 2 = 0 THEN '.log' ELSE '.py' END)"
)
PATHS = f"paths AS (SELECT p_partkey, p_size, p_name, {PATH} AS path FROM part)"
ENTRIES = (
    f"{PATHS}, s AS (SELECT string_split(path, '/') AS s FROM paths), "
    "dirs AS (SELECT DISTINCT array_to_string(s[1:n], '/') AS path, true AS is_dir, n AS depth, s[n] AS last FROM (SELECT s, unnest(range(1, len(s))) AS n FROM s)), "
    "entries AS (SELECT path, is_dir, depth, last FROM dirs UNION ALL SELECT path, false, 99, '' FROM paths)"
)


def paths(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_size", "p_name", F.expr(PATH).alias("path"))


def orders(spark, d) -> DataFrame:
    return table(spark, d, "orders")


@query("ignored_paths", f"WITH {PATHS} SELECT p_partkey, p_size < 25 AS ignored FROM paths")
def ignored_paths(spark, d):
    return paths(spark, d).select("p_partkey", search.ignored(F.col("path")).alias("ignored"))


@query("ignore_file", f"WITH {PATHS} SELECT p_partkey, CASE WHEN regexp_matches(path, '(^|/)f1[^/]*(/|$)') THEN false ELSE path LIKE '%.log' OR path LIKE 'logs/%' END AS ignored FROM paths")
def ignore_file(spark, d):
    return paths(spark, d).select("p_partkey", search.ignored_by(F.col("path"), ["# built", "*.log", "logs/", "!f1*"]).alias("ignored"))


@query("folder_listing", f"WITH {ENTRIES} SELECT path, is_dir FROM entries ORDER BY CASE WHEN is_dir AND depth = 1 THEN 0 ELSE 1 END, is_dir DESC, path LIMIT 40")
def folder_listing(spark, d):
    return search.listing(search.with_ancestors(paths(spark, d).select("path")), 40)


@query("directory_names", f"WITH {ENTRIES} SELECT DISTINCT last AS name FROM entries WHERE is_dir AND last NOT LIKE '.%'")
def directory_names(spark, d):
    return search.directories(search.with_ancestors(paths(spark, d).select("path")))


@query("index_eligible", f"WITH {PATHS} SELECT path FROM paths WHERE path LIKE '%.py' AND strlen(p_name) <= 12")
def index_eligible(spark, d):
    return index.eligible(paths(spark, d).select("path", F.col("p_name").alias("content")), [".py"], 12).select("path")


@query("index_failure_rate", "SELECT o_orderpriority, round((count(*) - count(*) FILTER (o_orderstatus = 'F')) / count(*), 6) AS rate FROM orders GROUP BY 1")
def index_failure_rate(spark, d):
    rate = index.failure_rate(F.count("*"), evals.count_if(F.col("o_orderstatus") == "F"))
    return orders(spark, d).groupBy("o_orderpriority").agg(F.round(rate, 6).alias("rate"))


RECENT = "r AS (SELECT o_orderkey AS id, CAST(o_orderkey AS BIGINT) * 100000 AS ts FROM orders), n AS (SELECT count(*) AS n FROM r WHERE ts >= 4395200000)"


@query("recent_tasks", f"WITH {RECENT} SELECT id, ts FROM r WHERE ts >= 4395200000 AND (SELECT n FROM n) >= 100 UNION ALL SELECT id, ts FROM (SELECT * FROM r ORDER BY ts DESC, id LIMIT 100) WHERE (SELECT n FROM n) < 100")
def recent_tasks(spark, d):
    rows = orders(spark, d).selectExpr("o_orderkey AS id", "CAST(o_orderkey AS BIGINT) * 100000 AS ts")
    return history.recent(rows, datetime.fromtimestamp(5_000_000, UTC))


@query(
    "orphan_parents",
    "WITH l AS (SELECT o_custkey AS task_id, o_orderkey AS seq, CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END AS own, CASE WHEN o_orderpriority < '3' THEN o_orderkey ELSE -1 END AS parent FROM orders) "
    "SELECT l.task_id, l.seq, l.own, m.own AS parent FROM l LEFT JOIN (SELECT DISTINCT task_id, own FROM l WHERE own IS NOT NULL) m ON l.task_id = m.task_id AND l.parent = m.own",
)
def orphan_parents(spark, d):
    log = orders(spark, d).selectExpr("o_custkey AS task_id", "o_orderkey AS seq", "CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END AS own", "CASE WHEN o_orderpriority < '3' THEN o_orderkey ELSE -1 END AS parent")
    return messages.clear_orphans(log, "parent", "own")


@query("allowed_tools", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([p_brand, 'read', p_type, 'browse'], lambda x: x NOT IN ('Brand#11', 'Brand#12', 'read')))), ',') AS tools FROM part")
def allowed_tools(spark, d):
    own = tools.allowed_tools(F.array("p_brand", F.lit("read")), F.array("p_type", F.lit("browse")), F.array(F.lit("Brand#11"), F.lit("Brand#12")), F.array(F.lit("read")))
    return table(spark, d, "part").select("p_partkey", F.array_join(own, ",").alias("tools"))


@query("free_branches", "SELECT DISTINCT concat(p_brand, '-', p_size) AS branch FROM part EXCEPT SELECT concat(p_brand, '-', p_size) FROM part WHERE p_type LIKE 'S%'")
def free_branches(spark, d):
    p = table(spark, d, "part")
    branches = p.select(F.expr("concat('origin/', p_brand, '-', p_size)").alias("branch")).union(p.select(F.expr("concat(p_brand, '-', p_size)")))
    return search.branches_without_worktree(branches, p.where("p_type LIKE 'S%'").select(F.expr("concat(p_brand, '-', p_size)").alias("branch")))


# odd sizes: no share of a unit lies half way between two of its tenths
@query("byte_texts", "SELECT id, CASE WHEN n < 1024 THEN concat(n, ' bytes') WHEN n < 1048576 THEN printf('%.1fKB', n / 1024) ELSE printf('%.1fMB', n / 1048576) END AS said FROM (SELECT o_orderkey AS id, 2 * CAST(o_orderkey AS BIGINT) * o_orderkey + 1 AS n FROM orders)")
def byte_texts(spark, d):
    return orders(spark, d).selectExpr("o_orderkey AS id", "2 * CAST(o_orderkey AS BIGINT) * o_orderkey + 1 AS n").select("id", formats.bytes_text(F.col("n")).alias("said"))


UNITS = (("year", 31_536_000), ("month", 2_592_000), ("week", 604_800), ("day", 86_400), ("hour", 3600), ("minute", 60))
SAID = " ".join(f"WHEN s >= {n} THEN concat(s // {n}, ' {u}', CASE WHEN s // {n} = 1 THEN '' ELSE 's' END)" for u, n in UNITS)


@query("relative_times", f"SELECT id, CASE {SAID} ELSE 'just now' END AS said FROM (SELECT o_orderkey AS id, CAST(o_orderkey AS BIGINT) * o_orderkey // 7 AS s FROM orders)")
def relative_times(spark, d):
    s = F.expr("CAST(o_orderkey AS BIGINT) * o_orderkey div 7")
    return orders(spark, d).select(F.col("o_orderkey").alias("id"), formats.relative_time(F.lit(0), s * 1000).alias("said"))


@query("truncated_texts", "SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN left(text, 500) || ' [truncated...]' ELSE text END) AS digest FROM documents")
def truncated_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(texts.truncate_line(F.col("text")).cast("binary")).alias("digest"))


SAFE = "regexp_replace(trim(concat(p_partkey % 7, '. ', p_name, ' (', p_type, ')')), '[^A-Za-z0-9_-]', '_', 'g')"


@query("safe_names", f"SELECT p_partkey, left(CASE WHEN regexp_matches({SAFE}, '^[A-Za-z_]') THEN {SAFE} ELSE '_' || {SAFE} END, 24) AS name FROM part")
def safe_names(spark, d):
    return table(spark, d, "part").select("p_partkey", texts.safe_name(F.expr("concat(p_partkey % 7, '. ', p_name, ' (', p_type, ')')"), 24).alias("name"))


@query("version_parts", "SELECT p_partkey, p_size AS major, CAST(p_partkey % 13 AS INTEGER) AS minor, CAST(CASE WHEN p_size > 20 THEN p_partkey % 5 ELSE 0 END AS INTEGER) AS patch FROM part")
def version_parts(spark, d):
    version = F.expr("concat(p_size, '.', p_partkey % 13, CASE WHEN p_size > 20 THEN concat('.', p_partkey % 5, '-rc.9') ELSE '-beta' END)")
    return table(spark, d, "part").select("p_partkey", search.semver(version).alias("v")).select("p_partkey", "v.major", "v.minor", "v.patch")


@query("adjacent_posts", "SELECT n_nationkey, lag(n_nationkey) OVER (ORDER BY n_regionkey DESC, n_name) AS previous, lead(n_nationkey) OVER (ORDER BY n_regionkey DESC, n_name) AS next FROM nation")
def adjacent_posts(spark, d):
    n = table(spark, d, "nation")
    return evals.adjacent(n, [F.desc("n_regionkey"), F.col("n_name")], "n_nationkey").select("n_nationkey", "previous", "next")


@query("posts_page", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def posts_page(spark, d):
    return evals.page(table(spark, d, "customer"), [F.desc("c_acctbal"), F.col("c_custkey")], 3, 25).select("c_custkey")


@query("model_choice", "SELECT p_partkey AS model FROM part WHERE (p_size >= 10 OR p_partkey = 3) AND p_size % 4 <> 0")
def model_choice(spark, d):
    models = table(spark, d, "part").selectExpr("p_partkey AS model", "p_size < 10 AS deprecated", "array('text', CASE WHEN p_size % 4 = 0 THEN 'image' ELSE 'audio' END) AS output_modalities")
    return search.model_list(models, 3).select("model")


@query("results_by_section", "SELECT n_regionkey AS section, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def results_by_section(spark, d):
    out = search.by_section(table(spark, d, "nation"), "n_regionkey", "n_nationkey", "n_name")
    return out.select(F.col("n_regionkey").alias("section"), F.array_join("values", ",").alias("names"))


@query("mode_overrides", "SELECT coalesce(b.k, c.k) AS k, coalesce(c.name, b.name) AS name, coalesce(b.place, 1099511627776 + c.place) AS place FROM (SELECT n_nationkey AS k, n_name AS name, CAST(n_nationkey AS BIGINT) AS place FROM nation) b FULL JOIN (SELECT s_suppkey AS k, s_name AS name, CAST(s_suppkey AS BIGINT) AS place FROM supplier) c ON b.k = c.k")
def mode_overrides(spark, d):
    builtin = table(spark, d, "nation").selectExpr("n_nationkey AS k", "n_name AS name", "CAST(n_nationkey AS BIGINT) AS place")
    custom = table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_name AS name", "CAST(s_suppkey AS BIGINT) AS place")
    return evals.in_place_override(builtin, custom, "k", "place")


@query("multi_select", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def multi_select(spark, d):
    return orders(spark, d).where(evals.one_of(F.col("o_orderpriority"), ["1-URGENT", "5-LOW"])).select("o_orderkey")


@query("latest_states", "SELECT key, seq FROM (SELECT o_custkey AS key, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n <= 3")
def latest_states(spark, d):
    return streams.last_states(orders(spark, d).selectExpr("o_custkey AS key", "o_orderkey AS seq"), 3)


@query("replaced_rows", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier")
def replaced_rows(spark, d):
    rows = table(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_name AS name")
    return messages.replace_or_append(rows, table(spark, d, "supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS id", "s_name AS name"), "id")


NAMED = "SELECT p_partkey, concat(p_name, ' ', p_partkey) AS name, lower(concat(p_name, ' ', p_partkey)) AS n FROM part"


@query("fuzzy_ranking", f"SELECT p_partkey, CASE WHEN contains(n, 'aed') THEN 0 ELSE length(regexp_extract(n, '(?s)a.*?e.*?d')) END AS score FROM ({NAMED}) WHERE regexp_matches(n, '(?s)a.*?e.*?d') ORDER BY score, length(n), name LIMIT 20")
def fuzzy_ranking(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("concat(p_name, ' ', p_partkey)").alias("name"))
    return search.fuzzy(p, "name", "aed").select("p_partkey", F.col("score").cast("long").alias("score"))


@query(
    "diagnostics_report",
    "WITH k AS (SELECT concat(p_brand, '.py') AS path, p_size % 4 AS severity, p_partkey AS line, p_name AS message FROM part WHERE p_size % 4 IN (0, 1)), t AS (SELECT * FROM k ORDER BY severity, line, path, message LIMIT 60) "
    "SELECT path, string_agg(message, '|' ORDER BY severity, line, message) AS messages, CAST((SELECT greatest(0, count(*) - 60) FROM k) AS INTEGER) AS omitted FROM t GROUP BY path",
)
def diagnostics_report(spark, d):
    rows = table(spark, d, "part").selectExpr("concat(p_brand, '.py') AS path", "p_size % 4 AS severity", "p_partkey AS line", "p_name AS message")
    return search.diagnostics(rows, [0, 1], 60).select("path", F.array_join("messages", "|").alias("messages"), F.col("omitted").cast("int").alias("omitted"))
