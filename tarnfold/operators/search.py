"""Searching texts and paths: lines with context, ignore rules, listings, prefix rules, fuzzy filters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.functions import sequential, shell

#: Directories that are never searched.
IGNORED = ["node_modules", "__pycache__", "env", "venv", "target/dependency", "build/dependencies", "dist", "out", "bundle", "vendor", "tmp", "temp", "deps", "pkg", "Pods", ".git"]


@F.pandas_udf(T.ArrayType(T.LongType()))
def starts(sizes: pd.Series) -> pd.Series:
    """Where each of the pieces begins, for arrays of sizes."""
    return sizes.map(lambda x: np.cumsum(np.asarray(x, np.int64)) - x, na_action="ignore")


def lines_of(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, line_no (from 1), line, byte_offset (of the line's first byte). No shuffle: only line sizes leave the JVM."""
    rows = files.withColumn("_lines", F.split(F.col(content), "\n"))
    rows = rows.withColumn("_starts", starts(F.transform("_lines", lambda x: F.octet_length(x) + 1)))
    return rows.select(key, F.posexplode(F.arrays_zip("_lines", "_starts")).alias("pos", "x")).select(key, (F.col("pos") + 1).alias("line_no"), F.col("x._lines").alias("line"), F.col("x._starts").alias("byte_offset"))


def near_matches(files: DataFrame, pattern: str, context: int = 1, key: str = "path", content: str = "content") -> DataFrame:
    """key, line_no, line of the lines that match or stand near a match: what regex_search needs of whole files."""
    lines = F.split(F.col(content), "\n")
    rows = files.where(F.col(content).rlike(pattern)).select(key, lines.alias("_l")).withColumn("_hit", F.transform("_l", lambda x: x.rlike(pattern)))
    near = lambda i: F.exists(F.slice("_hit", F.greatest(i - context + 1, F.lit(1)), i + context + 1 - F.greatest(i - context, F.lit(0))), lambda h: h)
    kept = F.filter(F.transform("_l", lambda x, i: F.when(near(i), F.struct((i + 1).alias("line_no"), x.alias("line")))), lambda x: x.isNotNull())
    return rows.select(key, F.explode(kept).alias("x")).select(key, "x.line_no", "x.line")


def regex_search(lines: DataFrame, pattern: str, context: int = 1, key: str = "path") -> DataFrame:
    """key, line_no, line, is_match, group: matches with lines around; groups are stretches of lines without a gap."""
    w = Window.partitionBy(key).orderBy("line_no")
    near = w.rangeBetween(-context, context)
    rows = lines.withColumn("is_match", F.col("line").rlike(pattern)).withColumn("_near", F.max(F.col("is_match").cast("int")).over(near)).where("_near = 1")
    rows = rows.withColumn("_new", F.when(F.col("line_no") <= F.lag("line_no").over(w) + 1, 0).otherwise(1))
    return rows.withColumn("group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_near", "_new")


def results_per_file(found: DataFrame, key: str = "path", most_files: int = 300) -> DataFrame:
    """key, n_groups, n_matches of the first files by path, as many as asked for."""
    return found.groupBy(key).agg(F.max("group").alias("n_groups"), F.sum(F.col("is_match").cast("long")).alias("n_matches")).orderBy(key).limit(most_files)


def first_within(lines: DataFrame, budget: int) -> DataFrame:
    """Lines of each file up to the first that exceeds a byte budget; line breaks do not count. lines: as of lines_of."""
    return lines.where(F.col("byte_offset") - (F.col("line_no") - 1) + F.octet_length("line") <= budget)


def segments(path: Column) -> Column:
    return F.array_remove(F.split(path, "/"), "")


def has_prefix(path: Column, prefix: str) -> Column:
    """Whether the path is in a directory, segment by segment; '.' and './' are no filter."""
    want = [s for s in prefix.replace("\\", "/").split("/") if s and s != "."]
    return F.slice(segments(path), 1, len(want)) == F.array(*map(F.lit, want)) if want else F.lit(True)


def ignored(path: Column, names: Sequence[str] = IGNORED) -> Column:
    """Whether a segment is a hidden or ignored directory, or the path holds one of several segments."""
    one = [n for n in names if "/" not in n]
    out = F.exists(segments(path), lambda s: s.isin(one) | (s.startswith(".") & (s != ".") & (s != "..")))
    for n in names:
        if "/" in n:
            out = out | F.concat(F.lit("/"), path, F.lit("/")).contains(f"/{n}/")
    return out


def glob_regex(pattern: str) -> str:
    """An ignore-file pattern as a regular expression over a relative path."""
    anchored, p = pattern.startswith("/") or "/" in pattern.rstrip("/"), pattern.strip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = p[i]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in ".+()|^$[]{}\\" else c)
            i += 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if pattern.endswith("/") else "(?:/|$)")


def ignored_by(path: Column, patterns: Sequence[str]) -> Column:
    """Patterns in order, the last that matches decides; `!` takes a path back in."""
    out = F.lit(False)
    for p in patterns:
        if p.strip() and not p.startswith("#"):
            keep = p.startswith("!")
            out = F.when(path.rlike(glob_regex(p.lstrip("!"))), not keep).otherwise(out)
    return out


def with_ancestors(files: DataFrame, key: str = "path") -> DataFrame:
    """path, is_dir: the files, and every directory above them once."""
    segs = F.split(F.col(key), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(segs) - 1), lambda n: F.array_join(F.slice(segs, F.lit(1), n), "/"))
    dirs = files.where(F.size(segs) > 1).select(F.explode(above).alias("path")).where("path <> ''").distinct().withColumn("is_dir", F.lit(True))
    return files.select(F.col(key).alias("path"), F.lit(False).alias("is_dir")).union(dirs)


def listing(entries: DataFrame, limit: int) -> DataFrame:
    """Directories first, then by path, each once; directories of the first level come before the limit cuts."""
    depth = F.size(segments(F.col("path")))
    top = F.when(F.col("is_dir") & (depth == 1), 0).otherwise(1)
    return entries.distinct().orderBy(top, F.desc("is_dir"), "path").limit(limit)


def longest_prefix(commands: DataFrame, rules: DataFrame) -> DataFrame:
    """command, decision: of the longest rule (prefix, allow) that the command begins with, caseless; `*` counts as
    length 1; on a tie deny wins; without a rule ask. Commands without any rule stay.

    Rules are looked up by the command's own prefixes of the lengths that rules have, an equi-join: the work follows the
    commands, not commands x rules, and a long command is not spelled out.
    """
    low, r = F.lower(F.col("command")), rules.select(F.lower("prefix").alias("_p"), "allow").distinct()
    lengths = sorted(x[0] for x in r.where("_p is not null and _p <> ''").select(F.length("_p")).distinct().collect())
    cuts = F.array(F.lit("*"), *[F.when(F.length(low) >= n, F.left(low, F.lit(n))) for n in lengths])
    own = commands.distinct().withColumn("_p", F.explode(F.array_distinct(F.array_compact(cuts))))
    best = own.join(r, "_p").groupBy("command").agg(F.max(F.struct(F.length("_p").alias("n"), (~F.col("allow")).alias("deny"))).alias("x"))
    found = commands.distinct().join(best, "command", "left")
    return found.select("command", F.when(F.col("x").isNull(), "ask").when(F.col("x.deny"), "deny").otherwise("approve").alias("decision"))


def chain_decision(parts: DataFrame, rules: DataFrame, dangerous: Column | None = None) -> DataFrame:
    """id, decision of command chains (id, part): any denied part denies, a dangerous one asks, all approved approve.

    Parts may hold substitutions whose commands no rule has seen: where dangerous is None, any of those asks, too.
    """
    dangerous = shell.dangerous(F.col("part")) | F.col("part").rlike(r"\$\(|`|[<>]\(") if dangerous is None else dangerous
    each = parts.join(longest_prefix(parts.select(F.col("part").alias("command")), rules), parts["part"] == F.col("command"))
    some = lambda c: F.max(c.cast("int")) == 1
    return each.groupBy("id").agg(
        F.when(some(F.col("decision") == "deny"), "deny").when(some(dangerous), "ask").when(F.min((F.col("decision") == "approve").cast("int")) == 1, "approve").otherwise("ask").alias("decision")
    )


def command_decisions(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """id, decision of every command line (id, command): approve, deny or ask.

    The line is cut into the commands that it runs; each goes by the longest rule that it begins with, without its first
    redirection. One denied command denies the line; then a dangerous form anywhere in it asks; then all commands have to
    be approved. A blank line is approved, and so is a command of which only a redirection is there. A null one asks.
    """
    parts = sequential.text_udf(shell.commands, "array<string>")(F.col("command"))
    cut_ = F.trim(F.regexp_replace(F.regexp_replace("part", f"^(.*?){shell.REDIRECTION}", "$1"), r"^\s+|\s+$", ""))
    each = lines.select("id", F.explode(parts).alias("part")).select("id", cut_.alias("part"))
    decided = each.join(longest_prefix(each.where("part <> ''").select(F.col("part").alias("command")), rules), each["part"] == F.col("command"), "left")
    one = F.when(F.col("part") == "", "approve").otherwise(F.col("decision"))
    of_line = decided.groupBy("id").agg(F.bool_or(one == "deny").alias("denied"), F.bool_and(one == "approve").alias("approved"))
    out = lines.select("id", "command").join(of_line, "id", "left")
    rest = F.when(shell.dangerous(F.col("command")), "ask").when(F.col("approved") | (F.trim("command") == ""), "approve").otherwise("ask")
    return out.select("id", F.when(F.col("denied"), "deny").otherwise(rest).alias("decision"))


def subsequence(text: Column, query: str) -> Column:
    """Whether the letters of the query stand in the text in order, caseless."""
    return text.rlike("(?is)" + ".*?".join("\\Q" + c + "\\E" for c in query if not c.isspace())) if query.strip() else F.lit(True)


def fuzzy(rows: DataFrame, text: str, query: str, limit: int = 20) -> DataFrame:
    """Rows that hold the query as a subsequence: whole words first, then the tightest, then the shortest texts."""
    compact = F.length(F.regexp_extract(F.lower(F.col(text)), ".*?".join("\\Q" + c.lower() + "\\E" for c in query if not c.isspace()), 0))
    score = F.when(F.lower(F.col(text)).contains(query.lower()), 0).otherwise(compact)
    return rows.where(subsequence(F.col(text), query)).withColumn("score", score).orderBy("score", F.length(text), text).limit(limit)


def tightest(text: Column, query: str) -> Column:
    """The shortest window of a text that holds the query's characters in order, caseless and without its blanks: start (from
    0), end (exclusive), positions; of several the first. Null where there is none.

    For each beginning of the query, one pass keeps where its latest match so far began; each match of all of it is a window.
    """
    wanted = [c for c in query.lower() if not c.isspace()]
    if not wanted:
        return F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.array().cast("array<int>").alias("positions"))
    kind = f"struct<at:int,{','.join(f's{j}:int' for j in range(len(wanted)))},start:int,end:int>"

    def step(acc: Column, c: Column) -> Column:
        begins = [acc["at"], *[acc[f"s{j}"] for j in range(len(wanted) - 1)]]
        now = [F.when(c == w, b).otherwise(acc[f"s{j}"]) for j, (w, b) in enumerate(zip(wanted, begins, strict=True))]
        whole = (c == wanted[-1]) & begins[-1].isNotNull()
        shorter = whole & (acc["end"].isNull() | (acc["at"] + 1 - begins[-1] < acc["end"] - acc["start"]))
        best = [F.when(shorter, begins[-1]).otherwise(acc["start"]).alias("start"), F.when(shorter, acc["at"] + 1).otherwise(acc["end"]).alias("end")]
        return F.struct((acc["at"] + 1).alias("at"), *[x.alias(f"s{j}") for j, x in enumerate(now)], *best)

    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("at"), *[none.alias(f"s{j}") for j in range(len(wanted))], none.alias("start"), none.alias("end")).cast(kind)
    found = F.aggregate(F.split(F.lower(text), ""), start, step)
    return F.when(found["end"].isNotNull(), F.struct(found["start"].alias("start"), found["end"].alias("end"), positions(text, found, wanted).alias("positions")))


def positions(text: Column, window: Column, wanted: list[str]) -> Column:
    """Where the wanted characters stand in a window that is the shortest: each as early as it can."""
    inside = F.split(F.substr(F.lower(text), window["start"] + 1, window["end"] - window["start"]), "")
    words = F.array(*map(F.lit, wanted))

    def step(acc: Column, c: Column) -> Column:
        hit = c == F.get(words, F.size(acc["out"]))
        return F.struct((acc["at"] + 1).alias("at"), F.when(hit, F.array_append(acc["out"], acc["at"])).otherwise(acc["out"]).alias("out"))

    start = F.struct(window["start"].alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(inside, start, step, lambda acc: acc["out"])


def spans(places: Column) -> Column:
    """Runs of neighbouring positions as intervals from start to end, for highlighting."""
    starts = F.filter(places, lambda p: ~F.array_contains(places, p - 1))
    ends = F.filter(places, lambda p: ~F.array_contains(places, p + 1))
    return F.transform(F.arrays_zip(starts.alias("start"), ends.alias("last")), lambda x: F.struct(x["start"].alias("start"), (x["last"] + 1).alias("end")))


def fuzzy_best(rows: DataFrame, text: str, query: str, limit: int = 20) -> DataFrame:
    """rows with score, start, end, positions: those that hold the query in order, by the shortest window (score: its
    length), then the shorter text, then the text. A blank query finds nothing."""
    if not query.strip():
        return rows.withColumn("_b", tightest(F.col(text), query)).select(*rows.columns, F.lit(0).alias("score"), "_b.*").limit(0)
    found = rows.where(subsequence(F.col(text), query)).withColumn("_b", tightest(F.col(text), query))
    return found.select(*rows.columns, (F.col("_b.end") - F.col("_b.start")).alias("score"), "_b.*").orderBy("score", F.length(text), text).limit(limit)


def semver(version: Column) -> Column:
    """Major, minor and patch as a struct; what follows a dash does not count."""
    part = lambda i: F.coalesce(F.get(F.split(F.regexp_replace(version, "-.*$", ""), r"\."), F.lit(i)).cast("int"), F.lit(0))
    return F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch"))


def settings_as_of(settings: DataFrame, current: str, key: str = "name") -> DataFrame:
    """The row of the highest version that is not above the current one, for each key."""
    rows = settings.where(semver(F.col("version")) <= semver(F.lit(current)))
    cols = [c for c in settings.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), semver(F.col("version"))).alias("x")).select(key, "x.*")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, before, after of what differs between two snapshots; a missing side is ''."""
    o, n = old.select(key, F.col(content).alias("before")), new.select(key, F.col(content).alias("after"))
    return o.join(n, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).select(key, F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))


def diagnostics(rows: DataFrame, severities: Sequence[int], limit: int) -> DataFrame:
    """path, messages, omitted: by severity and line, cut globally, listed by file."""
    kept = rows.where(F.col("severity").isin(list(severities)))
    n = kept.count()
    top = kept.orderBy("severity", "line", "path", "message").limit(limit)
    lists = F.transform(F.sort_array(F.collect_list(F.struct("severity", "line", "message"))), lambda x: x["message"])
    return top.groupBy("path").agg(lists.alias("messages")).withColumn("omitted", F.lit(max(0, n - limit)))


def branches_without_worktree(branches: DataFrame, worktrees: DataFrame) -> DataFrame:
    return branches.select(F.regexp_replace("branch", "^origin/", "").alias("branch")).distinct().join(worktrees.select("branch"), "branch", "left_anti")


def commits(lines: DataFrame, pattern: str, limit: int = 10) -> DataFrame:
    """Records of five lines (hash, short hash, subject, author, date) whose subject matches, else those of that hash."""
    fields = ["hash", "short_hash", "subject", "author", "date"]
    rec = lines.groupBy(F.floor(F.col("pos") / 5).alias("n")).agg(*[F.max(F.when(F.col("pos") % 5 == i, F.col("line"))).alias(f) for i, f in enumerate(fields)])
    by_subject = rec.where(F.col("subject").rlike("(?i)" + pattern))
    chosen = rec.where(F.col("hash").startswith(pattern)) if by_subject.isEmpty() else by_subject
    return chosen.orderBy("n").limit(limit).drop("n")


def git_status(lines: DataFrame, files_max: int = 20) -> DataFrame:
    """pos, line of a status listing (its first line is the branch): the branch, the first files, and how many more."""
    more = lines.agg(F.count("*").alias("n")).where(F.col("n") - 1 > files_max).select((F.lit(files_max) + 1).cast("int").alias("pos"), F.concat(F.lit("... "), (F.col("n") - 1 - files_max).cast("string"), F.lit(" more files")).alias("line"))
    return lines.select(F.col("pos").cast("int").alias("pos"), "line").where(F.col("pos") <= files_max).union(more).orderBy("pos")


def directories(entries: DataFrame) -> DataFrame:
    """Names of directories that are not hidden, sorted. entries: path, is_dir."""
    return entries.where(F.col("is_dir")).select(F.element_at(F.split("path", "/"), -1).alias("name")).where(~F.col("name").startswith(".")).distinct().orderBy("name")


def model_list(models: DataFrame, selected: str | None = None) -> DataFrame:
    """Models to choose from: no deprecated one but the selected, none that makes images."""
    current = F.col("model") == F.lit(selected) if selected is not None else F.lit(False)
    images = F.coalesce(F.array_contains("output_modalities", "image"), F.lit(False))
    return models.where((~F.coalesce("deprecated", F.lit(False)) | current) & ~images)


def by_section(results: DataFrame, section: str, order: str, value: str) -> DataFrame:
    """section, values: a list for each section in the results' order, sections as they first come."""
    lists = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])
    return results.groupBy(section).agg(lists.alias("values"), F.min(order).alias("_first")).orderBy("_first").drop("_first")
