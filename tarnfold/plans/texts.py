"""Text search, text functions, chunking and vectors over the driver's documents, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions import sequential, texts
from tarnfold.operators import index, search
from tarnfold.operators import nearest as nearest_
from tarnfold.plans.registry import query, table

LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"


def docs(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def files(spark, d) -> DataFrame:
    return docs(spark, d).select(F.col("doc_id").alias("path"), F.col("text").alias("content"))


@query("document_lines", f"WITH {LINES} SELECT doc_id AS path, CAST(line_no AS INTEGER) AS line_no, strlen(line)::BIGINT AS n_bytes, coalesce(CAST(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS byte_offset FROM lines")
def document_lines(spark, d):
    return search.lines_of(files(spark, d)).select("path", "line_no", F.octet_length("line").cast("long").alias("n_bytes"), "byte_offset")


CONTEXT = f"{LINES}, m AS (SELECT *, regexp_matches(line, 'License|rights reserved|ing the') AS hit FROM lines), n AS (SELECT *, max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM m), g AS (SELECT doc_id, line_no, hit, CASE WHEN line_no <= lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) + 1 THEN 0 ELSE 1 END AS fresh FROM n WHERE near = 1), r AS (SELECT doc_id, line_no, hit, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM g)"


@query("regex_search_context", f"WITH {CONTEXT} SELECT doc_id AS path, CAST(line_no AS INTEGER) AS line_no, hit AS is_match, CAST(grp AS BIGINT) AS \"group\" FROM r")
def regex_search_context(spark, d):
    return found(spark, d).select("path", "line_no", "is_match", "group")


def found(spark, d) -> DataFrame:
    return search.regex_search(search.near_matches(files(spark, d), "License|rights reserved|ing the"), "License|rights reserved|ing the")


@query("regex_counts", f"WITH {CONTEXT} SELECT doc_id AS path, CAST(max(grp) AS BIGINT) AS n_groups, count(*) FILTER (hit) AS n_matches FROM r GROUP BY 1 ORDER BY 1 LIMIT 300")
def regex_counts(spark, d):
    return search.results_per_file(found(spark, d))


@query("lines_within_budget", f"WITH {LINES}, x AS (SELECT doc_id, line_no, sum(strlen(line)) OVER (PARTITION BY doc_id ORDER BY line_no) AS s FROM lines) SELECT doc_id AS path, CAST(line_no AS INTEGER) AS line_no FROM x WHERE s <= 2000")
def lines_within_budget(spark, d):
    return search.first_within(search.lines_of(files(spark, d)), 2000).select("path", "line_no")


@query("line_ranges", f"WITH {LINES}, x AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM lines WHERE length(line) > 60) SELECT doc_id AS path, CAST(min(line_no) AS INTEGER) AS start, CAST(max(line_no) AS INTEGER) AS \"end\" FROM x GROUP BY doc_id, g")
def line_ranges(spark, d):
    from tarnfold.operators.messages import ranges

    lines = files(spark, d).select("path", F.posexplode(F.split("content", "\n")).alias("pos", "line")).where(F.length("line") > 60)
    return ranges(lines.select("path", (F.col("pos") + 1).alias("line_no")), "path", "line_no")


@query("line_numbers", f"WITH {LINES}, n AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS m FROM lines) SELECT doc_id, md5(string_agg(lpad(line_no::VARCHAR, length(m::VARCHAR)::INTEGER, ' ') || ' | ' || line, chr(10) ORDER BY line_no) || chr(10)) AS digest FROM n GROUP BY 1")
def line_numbers(spark, d):
    return docs(spark, d).select("doc_id", F.md5(texts.add_line_numbers(F.col("text")).cast("binary")).alias("digest"))


@query("line_numbers_stripped", "SELECT doc_id, true AS numbered, true AS back FROM documents WHERE trim(text, chr(10) || ' ') <> ''")
def line_numbers_stripped(spark, d):
    n = texts.add_line_numbers(F.col("text"))
    return docs(spark, d).where("trim(text) <> ''").select("doc_id", texts.every_line_numbered(n).alias("numbered"), (texts.strip_line_numbers(n) == F.concat("text", F.lit("\n"))).alias("back"))


@query("truncate_output", "SELECT doc_id, md5(CASE WHEN length(text) <= 500 THEN text ELSE left(text, 100) || chr(10) || '[...' || (length(text) - 500) || ' characters omitted...]' || chr(10) || right(text, 400) END) AS digest FROM documents")
def truncate_output(spark, d):
    return docs(spark, d).select("doc_id", F.md5(texts.truncate_output(F.col("text"), chars_max=500).cast("binary")).alias("digest"))


@query("truncate_output_lines", "WITH x AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, md5(CASE WHEN len(l) <= 10 THEN text ELSE array_to_string(l[1:2], chr(10)) || chr(10) || '[...' || (len(l) - 10) || ' lines omitted...]' || chr(10) || array_to_string(l[len(l) - 7:], chr(10)) END) AS digest FROM x")
def truncate_output_lines(spark, d):
    return docs(spark, d).select("doc_id", F.md5(texts.truncate_output(F.col("text"), lines_max=10).cast("binary")).alias("digest"))


@query("normalize_text", "SELECT doc_id, md5(trim(regexp_replace(replace(replace(replace(replace(translate(text, '“”‘’', '\"\"'''''), '…', '...'), '—', '-'), '–', '-'), chr(160), ' '), '\\s+', ' ', 'g'))) AS digest FROM documents")
def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(texts.normalize(F.col("text")).cast("binary")).alias("digest"))


@query("token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, length(text) - length(replace(text, chr(10), '')) AS breaks FROM documents")
def token_estimate(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", texts.token_estimate(t).alias("tokens"), F.regexp_count(t, F.lit("\n")).cast("long").alias("breaks"))


@query("reading_time", "SELECT doc_id, CAST(greatest(ceil(len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '`[^`]*`', '', 'g'), '[#*_~>]+', '', 'g'), '\\s+'), lambda x: x <> '')) / 200.0), 1) AS BIGINT) AS minutes FROM documents WHERE NOT contains(text, '](') AND NOT contains(text, '```')")
def reading_time(spark, d):
    plain = docs(spark, d).where(~F.col("text").contains("](") & ~F.col("text").contains("```"))
    return plain.select("doc_id", texts.reading_minutes(F.col("text")).cast("long").alias("minutes"))


@query("line_counts", "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) END::INTEGER AS n_lines FROM documents")
def line_counts(spark, d):
    return docs(spark, d).select("doc_id", texts.count_lines(F.col("text")).alias("n_lines"))


@query("similarity_pairs", "WITH b AS (SELECT item_id, trim(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g'), '\\s+', ' ', 'g')) AS x FROM benchmark) SELECT b.item_id AS a, c.item_id AS b, round(1 - levenshtein(b.x, c.x)::DOUBLE / greatest(length(b.x), length(c.x)), 4) AS similarity FROM b JOIN b c ON c.item_id = b.item_id + 1")
def similarity_pairs(spark, d):
    b = table(spark, d, "benchmark").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))  # DuckDB counts bytes
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(other, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.round(texts.similarity(F.col("text"), F.col("other")), 4).alias("similarity"))


@query("diff_stats", "SELECT doc_id, len(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)))::INTEGER AS added, 0 AS removed FROM documents")
def diff_stats(spark, d):
    p = texts.new_file_diff(F.lit("a"), F.col("text"))
    return docs(spark, d).select("doc_id", texts.diff_added(p).alias("added"), texts.diff_removed(p).alias("removed"))


@query("line_classes", f"WITH {LINES}, c AS (SELECT CASE WHEN lower(line) LIKE '%error%' OR lower(line) LIKE '%fail%' THEN 'error' WHEN lower(line) LIKE '%warn%' THEN 'warning' WHEN lower(line) LIKE '%pass%' OR lower(line) LIKE '%success%' THEN 'success' WHEN lower(line) LIKE '%debug%' THEN 'debug' ELSE 'plain' END AS kind FROM lines) SELECT kind, count(*) AS n FROM c GROUP BY 1")
def line_classes(spark, d):
    lines = docs(spark, d).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(texts.log_class(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


@query("html_unescape", "SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&#91;', '['), '&#93;', ']'), '&lsqb;', '['), '&rsqb;', ']'), '&amp;', '&')) AS digest FROM pages")
def html_unescape(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(texts.unescape_html(F.col("html")).cast("binary")).alias("digest"))


@query("url_normalize", "SELECT page_id, regexp_replace(regexp_replace(url, '^(https?://)[^/@]*@', '\\1'), '\\.git$', '') AS url, regexp_extract(regexp_replace(regexp_replace(url, '^(https?://)[^/@]*@', '\\1'), '\\.git$', ''), '^https?://[^/]+/(.+?)/?$', 1) AS repository FROM pages")
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", texts.https_url(F.col("url")).alias("url"), texts.repository_name(F.col("url")).alias("repository"))


PATHS = "p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)"


def paths(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))


@query("path_segments", f"WITH {PATHS} SELECT page_id, array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '|') AS segments, len(list_filter(string_split(path, '/'), lambda x: x <> ''))::INTEGER AS n FROM p")
def path_segments(spark, d):
    s = search.segments(F.col("path"))
    return paths(spark, d).select("page_id", F.array_join(s, "|").alias("segments"), F.size(s).alias("n"))


@query("path_prefix_filter", f"WITH {PATHS} SELECT page_id FROM p WHERE string_split(path, '/')[1] = (SELECT min(string_split(path, '/')[1]) FROM p)")
def path_prefix_filter(spark, d):
    p = paths(spark, d)
    first = p.agg(F.min(F.get(F.split("path", "/"), F.lit(0)))).first()[0]
    return p.where(search.has_prefix(F.col("path"), f"./{first}/")).select("page_id")


@query("ancestor_dirs", f"WITH {PATHS}, s AS (SELECT DISTINCT path FROM p), x AS (SELECT string_split(path, '/') AS a FROM s), d AS (SELECT DISTINCT array_to_string(a[1:n], '/') AS path FROM x, range(1, 20) t(n) WHERE n < len(a)) SELECT path, false AS is_dir FROM s UNION ALL SELECT path, true FROM d WHERE path <> ''")
def ancestor_dirs(spark, d):
    return search.with_ancestors(paths(spark, d).select("path").distinct())


@query("set_ops", "SELECT 'both' AS kind, x FROM (SELECT p_brand AS x FROM part WHERE p_size < 3 INTERSECT SELECT p_brand FROM part WHERE p_size > 47) UNION ALL SELECT 'first', x FROM (SELECT p_type AS x FROM part WHERE p_size < 10 EXCEPT SELECT p_type FROM part WHERE p_size > 40) UNION ALL SELECT 'any', x FROM (SELECT n_name AS x FROM nation UNION SELECT r_name FROM region)")
def set_ops(spark, d):
    p = table(spark, d, "part")
    pick = lambda c, where: p.where(where).select(F.col(c).alias("x"))
    both = pick("p_brand", "p_size < 3").intersect(pick("p_brand", "p_size > 47"))
    first = pick("p_type", "p_size < 10").subtract(pick("p_type", "p_size > 40"))
    either = table(spark, d, "nation").select(F.col("n_name").alias("x")).union(table(spark, d, "region").select("r_name")).distinct()
    return both.select(F.lit("both").alias("kind"), "x").union(first.select(F.lit("first"), "x")).union(either.select(F.lit("any"), "x"))


@query("hidden_antijoin", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def hidden_antijoin(spark, d):
    hidden = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, d, "supplier").join(hidden, "s_nationkey", "left_anti").select("s_suppkey", "s_name")


@query("longest_prefix_decision", "WITH r AS (SELECT * FROM (VALUES ('*', true), ('part', true), ('part 1', false), ('part 12', true), ('b', true), ('bl', false)) v(prefix, allow)), c AS (SELECT DISTINCT lower(p_name) AS command FROM part), m AS (SELECT command, prefix, allow, CASE WHEN prefix = '*' THEN 1 ELSE length(prefix) END AS n FROM c JOIN r ON prefix = '*' OR starts_with(command, prefix)), b AS (SELECT command, max(n) AS n FROM m GROUP BY 1) SELECT command, CASE WHEN bool_or(NOT allow) THEN 'deny' ELSE 'approve' END AS decision FROM m JOIN b USING (command, n) GROUP BY 1")
def longest_prefix_decision(spark, d):
    rules = spark.createDataFrame([("*", True), ("part", True), ("part 1", False), ("part 12", True), ("b", True), ("bl", False)], "prefix string, allow boolean")
    return search.longest_prefix(table(spark, d, "part").select(F.lower("p_name").alias("command")), rules)


@query("version_asof", "SELECT p_brand AS name, max(p_size) AS version FROM part WHERE p_size <= 25 GROUP BY 1")
def version_asof(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.concat(F.col("p_size"), F.lit(".0.0-rc")).alias("version"))
    return search.settings_as_of(p, "25.0.0").select("name", F.regexp_extract("version", r"^\d+", 0).cast("int").alias("version"))


@query("fuzzy_names", "WITH x AS (SELECT p_partkey AS id, p_name AS name FROM part WHERE regexp_matches(lower(p_name), 'a.*r.*1')) SELECT count(*) AS n FROM x")
def fuzzy_names(spark, d):
    return table(spark, d, "part").where(search.subsequence(F.col("p_name"), "ar1")).agg(F.count("*").alias("n"))


@query("marketplace_filter", "SELECT p_partkey AS id FROM part WHERE p_type = 'ECONOMY' AND contains(lower(p_name || ' ' || p_brand), '1') AND (p_size % 2 = 0 OR p_size % 5 = 0)")
def marketplace_filter(spark, d):
    p = table(spark, d, "part").withColumn("tags", F.expr("array(CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END, CASE WHEN p_size % 5 = 0 THEN 'five' ELSE 'other' END)"))
    text = F.lower(F.concat_ws(" ", "p_name", "p_brand"))
    return p.where((F.col("p_type") == "ECONOMY") & text.contains("1") & F.arrays_overlap("tags", F.array(F.lit("even"), F.lit("five")))).select(F.col("p_partkey").alias("id"))


@query("tag_list", "SELECT DISTINCT unnest([p_brand, p_type]) AS tag FROM part")
def tag_list(spark, d):
    return table(spark, d, "part").select(F.explode(F.array("p_brand", "p_type")).alias("tag")).distinct().orderBy("tag")


# Two states of the table, of all documents: each is in one or both, and those in Spanish have changed.
STATES = "o AS (SELECT doc_id, text FROM documents WHERE coalesce(lang, '') <> 'de'), n AS (SELECT doc_id, CASE WHEN lang = 'es' THEN text || '!' ELSE text END AS text FROM documents WHERE coalesce(lang, '') <> 'fr')"


def states(spark, d) -> tuple[DataFrame, DataFrame]:
    changed = F.when(F.col("lang") == "es", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = docs(spark, d).where("coalesce(lang, '') <> 'de'").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return old, docs(spark, d).where("coalesce(lang, '') <> 'fr'").select(F.col("doc_id").alias("path"), changed.alias("content"))


@query("hash_diff", f"WITH {STATES} SELECT coalesce(o.doc_id, n.doc_id) AS path, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted' WHEN sha256(o.text) = sha256(n.text) THEN 'same' ELSE 'modified' END AS state FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def hash_diff(spark, d):
    known, found_ = (x.select("path", index.file_hash(F.col("content")).alias("file_hash")) for x in states(spark, d))
    return index.hash_diff(known, found_)


@query("snapshot_diff", f"WITH {STATES} SELECT coalesce(o.doc_id, n.doc_id) AS path, md5(coalesce(o.text, '')) AS before, md5(coalesce(n.text, '')) AS after FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.text IS DISTINCT FROM n.text")
def snapshot_diff(spark, d):
    return search.snapshot_diff(*states(spark, d)).select("path", F.md5(F.col("before").cast("binary")).alias("before"), F.md5(F.col("after").cast("binary")).alias("after"))


@query("collection_names", "SELECT doc_id, 'ws-' || left(sha256(source), 16) AS name FROM documents")
def collection_names(spark, d):
    return docs(spark, d).select("doc_id", index.collection_name(F.col("source")).alias("name"))


@query("chunk_documents")
def chunk_documents(spark, d):
    f = files(spark, d).select(F.concat(F.lit("doc"), "path", F.when(F.col("path") % 2 == 0, ".md").otherwise(".swift")).alias("path"), "content")
    return index.chunks(f).withColumn("id", index.point_id(F.col("segment_hash")))


#: Greedy fill, one item after another, for all sources at once.
BATCHES = """WITH RECURSIVE x AS (SELECT doc_id, source, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM x WHERE tokens <= 8191),
r AS (SELECT doc_id, source, tokens, n, 0 AS batch, tokens AS total FROM o WHERE n = 1 UNION ALL
SELECT o.doc_id, o.source, o.tokens, o.n, CASE WHEN r.total + o.tokens > 20000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.total + o.tokens > 20000 THEN o.tokens ELSE r.total + o.tokens END
FROM r JOIN o ON o.source = r.source AND o.n = r.n + 1)
SELECT source, doc_id AS seq, tokens, CAST(batch AS INTEGER) AS batch FROM r"""


@query("token_batches", BATCHES)
def token_batches(spark, d):
    items = docs(spark, d).select("source", F.col("doc_id").alias("seq"), texts.token_estimate(F.col("text")).cast("long").alias("tokens"))
    return index.batches(items, "tokens", 20_000, 8191, "source")


def nearest_sql(k: int, least: float, where: str) -> str:
    return (
        f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND {where}), "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS n FROM s WHERE round(s, 9) >= {least}) SELECT query_id, vec_id, round(s, 4) AS score FROM r WHERE n <= {k}"
    )


def nearest(spark, d, k: int, least: float, where: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    hits = index.vector_search_all(e.where(where), e.where("vec_id % 20 = 0"), "vec_id", k, least)
    return hits.select("query_id", "vec_id", F.round("score", 4).alias("score"))


@query("vector_topk", nearest_sql(20, 0.1, "true"))
def vector_topk(spark, d):
    return nearest(spark, d, 20, 0.1, "true")


@query("vector_topk_filtered", nearest_sql(10, 0.0, "e.label = 3"))
def vector_topk_filtered(spark, d):
    return nearest(spark, d, 10, 0.0, "label = 3")


@query("vector_index_topk")
def vector_index_topk(spark, d):
    """The same by an inverted file, with as many lists a query as a recall of 0.95 asked for when it was measured."""
    e = table(spark, d, "embeddings")
    built, asked = nearest_.InvertedFile.fit(e, "vec_id"), e.where("vec_id % 20 = 0")
    return built.search(asked, 20, 0.1, built.probes_for(asked, 20, 0.1))


@query("markdown_sections", f"WITH {LINES}, h AS (SELECT doc_id, line_no, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt, max_line FROM (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS max_line FROM lines) WHERE regexp_matches(line, '^[A-ZÉÈÑÄÖÜ][^ ]*\\.$')) SELECT doc_id AS path, CAST(line_no AS INTEGER) AS start, CAST(coalesce(nxt - 1, max_line) AS INTEGER) AS \"end\" FROM h")
def markdown_sections(spark, d):
    """Sections that begin at one-word lines, standing for headers, and end before the next."""
    lines = docs(spark, d).select(F.col("doc_id").alias("path"), F.size(F.split("text", "\n")).alias("last"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("path").orderBy("pos")
    heads = lines.where(F.col("line").rlike(r"^[A-ZÉÈÑÄÖÜ][^ ]*\.$"))
    return heads.select("path", (F.col("pos") + 1).alias("start"), F.coalesce(F.lead("pos").over(w), F.col("last")).alias("end"))


@query("line_slices", f"WITH {LINES} SELECT doc_id AS path, CAST(line_no - 1 AS INTEGER) AS line_no, md5(line) AS digest FROM lines WHERE line_no BETWEEN 3 AND 6")
def line_slices(spark, d):
    from tarnfold.sources.files import read_lines

    return read_lines(files(spark, d), 2, 5).select("path", "line_no", F.md5(F.col("line").cast("binary")).alias("digest"))


@query("run_length_encoded")
def run_length_encoded(spark, d):
    return docs(spark, d).select("doc_id", F.length(texts.run_lengths(F.col("text"))).alias("n_chars"))


@query("command_patterns", "SELECT p_partkey, array_to_string(list_sort(list_distinct([split_part(p_name, ' ', 1), p_name, 'git', 'git commit'])), ', ') AS patterns FROM part")
def command_patterns(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" && ", "p_name", F.concat(F.lit("git commit -m "), "p_brand")).alias("command"))
    return p.select("p_partkey", F.array_join(sequential.text_udf(sequential.command_patterns, "array<string>")("command"), ", ").alias("patterns"))
