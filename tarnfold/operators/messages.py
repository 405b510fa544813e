"""Message logs: pairing, grouping, usage, truncation, orphans, rewinds and batches of rows.

Logs have task_id and seq, which orders them; JSON is in `text`. Every window is by task, so tasks spread over the
cluster; equal timestamps do no harm, as seq and never ts is the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TASK = ["task_id"]


def by(*keys: str) -> "Window":
    return Window.partitionBy(*keys).orderBy("seq")


def so_far(*keys: str) -> "Window":
    return by(*keys).rowsBetween(Window.unboundedPreceding, 0)


def pairs(log: DataFrame, start: Column, finish: Column, keys: list[str] = TASK) -> DataFrame:
    """Each finish with the latest start that is still open, as a stack would: the keys, start_seq, finish_seq.

    With +1 for starts and -1 for finishes, depth is the running sum less its running minimum under 0; a finish that
    lowers that minimum is an orphan. On each level, a finish pairs with the start just before it.
    """
    x = F.when(start, 1).when(finish, -1)
    rows = log.withColumn("_x", x).where("_x is not null").withColumn("_c", F.sum("_x").over(so_far(*keys)))
    rows = rows.withColumn("_m", F.least(F.lit(0), F.min("_c").over(so_far(*keys))))
    rows = rows.withColumn("_before", F.coalesce(F.lag("_m").over(by(*keys)), F.lit(0)))
    level = F.col("_c") - F.col("_m") + F.when(F.col("_x") < 0, 1).otherwise(0)
    rows = rows.where((F.col("_x") > 0) | (F.col("_m") == F.col("_before"))).withColumn("_level", level)
    rows = rows.withColumn("start_seq", F.lag(F.when(F.col("_x") > 0, F.col("seq"))).over(by(*keys, "_level")))
    return rows.where("_x < 0").select(*keys, "start_seq", F.col("seq").alias("finish_seq"))


def json_object(text: Column) -> Column:
    """A map of the top-level fields; {} where the text is no JSON object."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def consolidate_requests(log: DataFrame, start: Column, finish: Column) -> DataFrame:
    """Starts get the fields of their finish, which win; finishes go. A log of one row is left as it is."""
    found = pairs(log, start, finish)
    ends = log.select("task_id", F.col("seq").alias("finish_seq"), F.col("text").alias("_end"))
    merged = found.join(ends, ["task_id", "finish_seq"]).select("task_id", F.col("start_seq").alias("seq"), "_end")
    alone = F.count("*").over(Window.partitionBy("task_id")) == 1
    rows = log.withColumn("_alone", alone).where(F.col("_alone") | ~F.coalesce(finish, F.lit(False))).join(merged, ["task_id", "seq"], "left")
    old, new = json_object(F.col("text")), json_object(F.col("_end"))
    both = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
    return rows.withColumn("text", F.when(F.col("_end").isNull(), F.col("text")).otherwise(F.to_json(both))).drop("_alone", "_end")


def consolidate_commands(log: DataFrame, command: Column, output: Column, kind: str = "type", mark: str = "\nOutput:") -> DataFrame:
    """Outputs join the command before them, in order, and go: the first right after the mark, further ones on new lines.

    An output that repeats the text before it as the other kind (asked, then said) is left out. Outputs before any
    command are dropped.
    """
    rows = log.withColumn("_command", F.coalesce(command, F.lit(False))).withColumn("_output", F.coalesce(output, F.lit(False)))
    rows = rows.withColumn("_group", F.sum(F.col("_command").cast("int")).over(so_far("task_id")))
    out = rows.where("_output and _group > 0")
    twice = (F.lag("text").over(by("task_id", "_group")) == F.col("text")) & (F.lag(kind).over(by("task_id", "_group")) != F.col(kind))
    parts = out.withColumn("_twice", F.coalesce(twice, F.lit(False))).where("not _twice and coalesce(text, '') <> ''")
    joined = parts.groupBy("task_id", "_group").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("_joined"))
    rest = rows.where("not _output").join(joined, ["task_id", "_group"], "left")
    text = F.when(F.col("_command") & F.col("_joined").isNotNull(), F.concat("text", F.lit(mark), "_joined")).otherwise(F.col("text"))
    return rest.withColumn("text", text).drop("_command", "_output", "_group", "_joined")


def islands(rows: DataFrame, wanted: Column, keys: list[str] = TASK) -> DataFrame:
    """rows with island: a number for each stretch of rows in a row for which wanted holds, or not."""
    w = F.coalesce(wanted, F.lit(False))
    change = F.when(w != F.coalesce(F.lag(w).over(by(*keys)), ~w), 1).otherwise(0)
    return rows.withColumn("_change", change).withColumn("wanted", w).withColumn("island", F.sum("_change").over(so_far(*keys))).drop("_change")


def batch_consecutive(rows: DataFrame, wanted: Column, keys: list[str] = TASK) -> DataFrame:
    """Stretches of two or more wanted rows become one: keys, seq (the first's), n, texts; other rows are batches of one."""
    parts = islands(rows, wanted, keys).withColumn("_own", F.when(~F.col("wanted"), F.col("seq")))
    listed = F.sort_array(F.collect_list(F.struct("seq", "text")))
    return parts.groupBy(*keys, "island", "_own").agg(F.min("seq").alias("seq"), F.count("*").alias("n"), F.transform(listed, lambda x: x["text"]).alias("texts")).drop("island", "_own")


def ranges(lines: DataFrame, key: str, line: str) -> DataFrame:
    """Line numbers as ranges [start, end] without a gap."""
    w = Window.partitionBy(key).orderBy(line)
    return lines.select(key, line).distinct().withColumn("_g", F.col(line) - F.row_number().over(w)).groupBy(key, "_g").agg(F.min(line).alias("start"), F.max(line).alias("end")).drop("_g")


def repetitions(calls: DataFrame, call: str, limit: int) -> DataFrame:
    """calls with run (place in a stretch of equal ones) and flagged (every limit-th, after which the count begins anew)."""
    same = F.col(call).eqNullSafe(F.lag(call).over(by("task_id")))
    rows = calls.withColumn("_new", F.when(same & (F.row_number().over(by("task_id")) > 1), 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(so_far("task_id"))).withColumn("run", F.row_number().over(by("task_id", "_island")))
    return rows.withColumn("flagged", F.col("run") % limit == 0).drop("_new", "_island")


def number(text: Column, field: str) -> Column:
    """A numeric field of a JSON text; null if missing or not a number."""
    raw = F.get_json_object(text, f"$.{field}")
    return F.when(raw.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), raw.cast("double"))


def token_usage(log: DataFrame, request: Column, condense: Column | None = None) -> DataFrame:
    """Totals over request rows by task: cache totals stay null until seen; costs of condensing are added; context is the
    last that is not zero."""
    t, r = F.col("text"), F.coalesce(request, F.lit(False))
    of = lambda f: F.when(r, number(t, f))
    c = F.coalesce(condense, F.lit(False)) if condense is not None else F.lit(False)
    context = F.when(r, F.coalesce(number(t, "tokensIn"), F.lit(0.0)) + F.coalesce(number(t, "tokensOut"), F.lit(0.0))).when(c, number(t, "newContextTokens"))
    last = F.max_by(context, F.when(context != 0, F.col("seq")))
    cost = F.coalesce(F.sum(of("cost")), F.lit(0.0)) + F.coalesce(F.sum(F.when(c, number(t, "cost"))), F.lit(0.0))
    whole = lambda x: x.cast("long")
    return log.groupBy("task_id").agg(
        whole(F.coalesce(F.sum(of("tokensIn")), F.lit(0))).alias("tokens_in"), whole(F.coalesce(F.sum(of("tokensOut")), F.lit(0))).alias("tokens_out"),
        whole(F.sum(of("cacheWrites"))).alias("cache_writes"), whole(F.sum(of("cacheReads"))).alias("cache_reads"), F.round(cost, 6).alias("cost"),
        whole(F.coalesce(last, F.lit(0))).alias("context_tokens"),
    )


def truncate(log: DataFrame, share: float, visible: Column = None) -> DataFrame:
    """log with hidden: ranks 2 to k + 1 of the visible rows of a task, k the share of all but the first, rounded down to even.

    markers() gives the row that stands for them.
    """
    v = F.coalesce(visible, F.lit(False)) if visible is not None else F.lit(True)
    w = Window.partitionBy("task_id")
    rows = log.withColumn("_v", v).withColumn("_rank", F.sum(F.col("_v").cast("int")).over(so_far("task_id"))).withColumn("_n", F.sum(F.col("_v").cast("int")).over(w))
    k = F.floor((F.col("_n") - 1) * share).cast("int")
    k = k - k % 2
    return rows.withColumn("hidden", F.col("_v") & (F.col("_rank") >= 2) & (F.col("_rank") <= k + 1)).drop("_v", "_rank", "_n")


def markers(truncated: DataFrame) -> DataFrame:
    """task_id, after_seq (of the last hidden row), messages_removed: the marker of each task with hidden rows."""
    return truncated.where("hidden").groupBy("task_id").agg(F.max("seq").alias("after_seq"), F.count("*").alias("messages_removed"))


def since_last(log: DataFrame, mark: Column) -> DataFrame:
    """Rows from the last marked one on; all of a task without any."""
    last = F.max(F.when(mark, F.col("seq"))).over(Window.partitionBy("task_id"))
    return log.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("seq") >= F.col("_last"))).drop("_last")


def split_results(uses: DataFrame, results: DataFrame, key: str = "tool_use_id") -> tuple[DataFrame, DataFrame]:
    """(results with a use in their task, orphans)."""
    on = ["task_id", key]
    ids = uses.select(*on).distinct()
    return results.join(ids, on, "left_semi"), results.join(ids, on, "left_anti")


def repair_results(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Results for every use of a message: task_id, message, tool_use_id, content, how (kept, moved, made).

    The first result of an id counts. Results with an unknown id take, in order, the uses that have none; what is
    left gets a made result. uses and results: task_id, message, seq, tool_use_id (and content).
    """
    at = ["task_id", "message"]
    first = results.withColumn("_n", F.row_number().over(Window.partitionBy(*at, "tool_use_id").orderBy("seq"))).where("_n = 1").drop("_n")
    kept = uses.join(first.select(*at, "tool_use_id", "content"), [*at, "tool_use_id"]).withColumn("how", F.lit("kept"))
    order = Window.partitionBy(*at).orderBy("seq")
    open_ = uses.join(first, [*at, "tool_use_id"], "left_anti").withColumn("place", F.row_number().over(order))
    loose = first.join(uses, [*at, "tool_use_id"], "left_anti").withColumn("place", F.row_number().over(order)).select(*at, "place", "content")
    moved = open_.join(loose, [*at, "place"], "left")
    how = F.when(F.col("content").isNull(), "made").otherwise("moved")
    moved = moved.withColumn("how", how).withColumn("content", F.coalesce("content", F.lit("Tool execution was interrupted before completion.")))
    return kept.select(*at, "tool_use_id", "content", "how").unionByName(moved.select(*at, "tool_use_id", "content", "how"))


def visible_history(log: DataFrame) -> DataFrame:
    """Rows that count for the model: without those whose condense or truncation parent is there, from the last summary on."""
    for parent, own, mark in (("condense_parent", "condense_id", "is_summary"), ("truncation_parent", "truncation_id", "is_truncation_marker")):
        there = log.where(F.col(mark) & F.col(own).isNotNull()).select("task_id", F.col(own).alias(parent)).distinct()
        log = log.join(there, ["task_id", parent], "left_anti").select(log.columns)
    return since_last(log, F.coalesce("is_summary", F.lit(False)))


def clear_orphans(log: DataFrame, parent: str, own: str) -> DataFrame:
    """parent is null where no row of the task has it as its own id."""
    there = log.where(F.col(own).isNotNull()).select(F.col("task_id").alias("_task"), F.col(own).alias("_own")).distinct()
    out = log.join(there, (F.col("task_id") == F.col("_task")) & (F.col(parent) == F.col("_own")), "left")
    return out.select(*[F.col("_own").alias(parent) if c == parent else F.col(c) for c in log.columns])


def rewind(log: DataFrame, cuts: DataFrame, user: Column) -> DataFrame:
    """Rows before a task's cut (task_id, cut_ts): the row of just that time, else the first user row after it if any row
    is before it; tasks without a cut or boundary stay whole."""
    rows = log.withColumn("_user", F.coalesce(user, F.lit(False))).join(cuts, "task_id", "left")
    w = Window.partitionBy("task_id")
    exact = F.min(F.when(F.col("ts") == F.col("cut_ts"), F.col("seq"))).over(w)
    before = F.max(F.when(F.col("ts") < F.col("cut_ts"), 1)).over(w)
    after = F.min(F.when(F.col("_user") & (F.col("ts") >= F.col("cut_ts")), F.col("seq"))).over(w)
    rows = rows.withColumn("_at", F.coalesce(exact, F.when(before.isNotNull(), after)))
    return rows.where(F.col("_at").isNull() | (F.col("seq") < F.col("_at"))).select(log.columns)


def last_of(log: DataFrame, wanted: Column, value: str) -> DataFrame:
    """task_id, last: value of the last wanted row, else of the first row."""
    return log.groupBy("task_id").agg(F.coalesce(F.max_by(F.col(value), F.when(wanted, F.col("seq"))), F.min_by(value, "seq")).alias("last"))


def task_metadata(log: DataFrame, request: Column, start: Column, finish: Column, resume: Column) -> DataFrame:
    """A history row a task: title (the first text), last time that is no resumption, number of rows, and usage without the first row."""
    first = F.min("seq").over(Window.partitionBy("task_id"))
    rest = log.withColumn("_first", first).where("seq > _first").drop("_first")
    usage = token_usage(consolidate_requests(rest, start, finish), request)
    head = log.groupBy("task_id").agg(F.min_by("text", "seq").alias("task"), F.coalesce(F.max_by(F.col("ts"), F.when(~F.coalesce(resume, F.lit(False)), F.col("seq"))), F.min_by("ts", "seq")).alias("ts"), F.count("*").alias("n_rows"))
    return head.join(usage, "task_id", "left")


def agent_state(log: DataFrame, table: list[tuple[str, str]]) -> DataFrame:
    """task_id, state from the last row: the first (type, state) of the table that it is of, else running; partial rows stream."""
    last = log.groupBy("task_id").agg(F.max_by(F.struct("type", "partial"), "seq").alias("x"))
    state = F.when(F.coalesce(F.col("x.partial"), F.lit(False)), "streaming")
    for kind, name in table:
        state = state.when(F.col("x.type") == kind, name)
    return last.select("task_id", state.otherwise("running").alias("state"))


def request_in_progress(log: DataFrame, request: Column) -> DataFrame:
    """task_id, in_progress: the last request has no cost yet."""
    last = log.groupBy("task_id").agg(F.max_by(F.struct(F.col("text"), F.lit(True).alias("any")), F.when(request, F.col("seq"))).alias("x"))
    return last.select("task_id", (F.col("x.any").isNotNull() & number(F.col("x.text"), "cost").isNull()).alias("in_progress"))


def limits(log: DataFrame, request: Column, reset: Column, most_requests: int, most_cost: float) -> DataFrame:
    """Requests and cost since the last reset, and whether a limit is passed (cost by more than 0.0001)."""
    rows = since_last(log, reset).where(request)
    out = rows.groupBy("task_id").agg(F.count("*").alias("requests"), F.sum(number(F.col("text"), "cost")).alias("cost"))
    return out.withColumn("stopped", (F.col("requests") > most_requests) | (F.coalesce("cost", F.lit(0.0)) > most_cost + 1e-4))


def replace_or_append(rows: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Whole rows of changed stand for those of the same key; others are added."""
    return rows.join(changed, key, "left_anti").select(rows.columns).unionByName(changed)


def visible_rows(log: DataFrame, hidden_types: list[str], retry: str) -> DataFrame:
    """Rows that a chat shows: with text or images, of no hidden type; a retry only as the last row. Checkpoints whose
    hash a user row carries go."""
    w = Window.partitionBy("task_id").orderBy(F.desc("seq"))
    user = log.where("type = 'user_feedback'").select("task_id", F.col("hash").alias("hash")).where("hash is not null").distinct()
    rows = log.withColumn("_back", F.row_number().over(w))
    marks = rows.where("type = 'checkpoint'").join(user, ["task_id", "hash"], "left_anti").select(rows.columns)
    rest = rows.where(F.coalesce(F.col("type"), F.lit("")) != "checkpoint")
    full = (F.coalesce("text", F.lit("")) != "") | (F.coalesce(F.size("images"), F.lit(0)) > 0)
    shown = rest.where(full & ~F.coalesce(F.col("type").isin(hidden_types), F.lit(False)) & ((F.coalesce(F.col("type"), F.lit("")) != retry) | (F.col("_back") == 1)))
    return marks.unionByName(shown).drop("_back")


def token_ranges(log: DataFrame, point: Column, tokens: str) -> DataFrame:
    """task_id, range, tokens, n: sums between cache points; a point ends its range."""
    rows = log.withColumn("_p", F.coalesce(point, F.lit(False)).cast("int"))
    before = Window.partitionBy("task_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("range", F.coalesce(F.sum("_p").over(before), F.lit(0)))
    return rows.groupBy("task_id", "range").agg(F.sum(tokens).alias("tokens"), F.count("*").alias("n"))
