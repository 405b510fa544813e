import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tarnfold.functions import formats, sequential, texts
from tarnfold.operators import tools


@pytest.fixture(scope="module")
def value(spark):
    """The value of a column expression over one row of literals."""
    return lambda f, *xs: spark.range(1).select(f(*[F.lit(x) for x in xs])).first()[0]


def test_formats(value):
    assert [value(formats.duration, x) for x in (0, 61_000, 3_661_000)] == ["0:00:00", "0:01:01", "1:01:01"]
    assert [value(formats.tokens, x) for x in (999, 72_500, 999_499, 999_500, 3_240_000, 999_950_000)] == ["999", "73k", "999k", "1.0M", "3.2M", "1.0B"]
    assert [value(formats.duration_words, x) for x in (3000, 62_000, 3_723_000)] == ["3s", "1m 2s", "1h 2m 3s"]
    assert [value(formats.currency, x) for x in (1234.5, -2.0)] == ["$1,234.50", "-$2.00"]
    assert value(lambda x: formats.currency(x.cast("double")), None) == "-"
    assert [value(formats.compact_number, x) for x in (999, 1999, 2_000_000)] == ["999", "1.9k", "2M"]
    assert [value(formats.bytes_text, x) for x in (10, 2048, 3 << 20)] == ["10 bytes", "2.0KB", "3.0MB"]
    assert [value(formats.js_round, x) for x in (2.5, -2.5, 0.4)] == [3, -2, 0]
    assert [value(lambda a: formats.relative_time(a, F.lit(10**10)), 10**10 - x) for x in (1000, 61_000, 7_200_000)] == ["just now", "1 minute", "2 hours"]
    assert value(formats.abbreviation, "read_file_now") == "RFN"
    assert [value(lambda x: formats.api_price(x.cast("string")), x) for x in ("0.000003", "0", "x", None)] == [pytest.approx(3.0), None, None, None]


def test_costs(value):
    prices = {"input": 3.0, "output": 15.0, "cache_writes": 3.75, "cache_reads": 0.3}
    args = (1000, 500, 2000, 3000)
    assert value(lambda *a: formats.api_cost(*a, prices, False), *args) == pytest.approx((2000 * 3.75 + 3000 * 0.3 + 1000 * 3 + 500 * 15) / 1e6)
    assert value(lambda *a: formats.api_cost(*a, prices, True), *args) == pytest.approx((2000 * 3.75 + 3000 * 0.3 + 0 + 500 * 15) / 1e6)
    over = lambda t, th: value(lambda a, b: formats.over_context(a, F.lit(100_000), F.lit(8192), b, F.lit(50)), t, th)
    assert over(50_000, -1) and not over(49_999, -1) and over(81_809, 100) and not over(81_000, 100) and over(50_000, 3)


def test_texts(value):
    assert value(texts.normalize, " “a”  ‘b’…—c ") == "\"a\" 'b'...-c"
    assert value(texts.unescape_html, "&amp;lt; &lt;a&gt; &#91;") == "&lt; <a> ["
    assert value(texts.similarity, "abcd", "abce") == 0.75 and value(texts.similarity, "x", "") == 0.0
    assert value(texts.add_line_numbers, "\n".join("ab" * 5)).startswith(" 1 | a\n 2 | b") and value(texts.add_line_numbers, "") == ""
    assert value(texts.every_line_numbered, "1 | a\n 2 | b\n") and not value(texts.every_line_numbered, "1 | a\nb")
    assert value(texts.strip_line_numbers, "1 | a\n 2 | b") == "a\nb"
    assert value(lambda t: texts.truncate_output(t, chars_max=10), "0123456789abcdefghij") == "01\n[...10 characters omitted...]\ncdefghij"
    assert value(lambda t: texts.truncate_output(t, lines_max=5), "\n".join("abcdefgh")) == "a\n[...3 lines omitted...]\ne\nf\ng\nh"
    assert len(value(texts.truncate_line, "x" * 600)) == 515 and value(texts.truncate_line, "x") == "x"
    assert value(texts.token_estimate, "abcde") == 2 and value(texts.count_lines, "a\nb\n") == 2 and value(texts.count_lines, "") == 0
    assert value(texts.reading_minutes, "word " * 401 + "```\n" + "code " * 999 + "```") == 3 and value(texts.reading_minutes, "") == 1
    assert [value(texts.publish_minutes, x) for x in ("9:05am", "12:00am", "12:30pm", "13:00pm", "9:05AM", "1:00Pm", "0:10am", "9:5am", "09:05am", "9:60am", "x", None)] == [545, 0, 750, None, 545, 780, *[None] * 6]
    now = "2024-06-01 16:10:00"  # 9:10 in Los Angeles
    pub = lambda s, d, t: value(lambda a, b, c: texts.published(a, b, c, F.lit(now).cast("timestamp")), s, d, t)
    assert pub("published", "2024-06-01", "9:10am") and not pub("published", "2024-06-01", "9:11am") and not pub("draft", "2024-01-01", "9:00am")
    assert value(texts.https_url, "git@github.example:o/r.git") == "https://github.example/o/r"
    assert value(texts.https_url, "https://user:pw@h.example/o/r.git") == "https://h.example/o/r" and value(texts.repository_name, "ssh://git@h.example/o/r.git") == "o/r"
    assert value(texts.command_blocks, "x<command a>1</command>y<command>2</command>") == "<command a>1</command>\n<command>2</command>"
    assert value(texts.mentions, "see @/a/b.ts, and @problems or @/a/b.ts; mail x@y.z") == ["/a/b.ts", "problems"]
    assert value(texts.safe_name, "9 lives!") == "_9_lives_"
    patch = value(lambda c: texts.new_file_diff(F.lit("f"), c), "a\nb\n")
    assert patch.endswith("@@ -0,0 +1,2 @@\n+a\n+b") and value(texts.diff_added, patch) == 2 and value(texts.diff_removed, patch) == 0
    spans = lambda t: texts.highlight(t, F.array(F.struct(F.lit(2).alias("start"), F.lit(3).alias("end"))))
    assert value(spans, "a<bc") == 'a&lt;<span class="hit">b</span>c'
    assert [tuple(x) for x in value(texts.headers, "# One #\ntext\n### Two")] == [(1, "One"), (3, "Two")]
    assert value(texts.log_line, "2024-01-01T00:00:00Z pid: 4 | run: 2 | hello") == "hello"
    assert value(tools.natural_key, "a10") > value(tools.natural_key, "a9")


def test_terminal_texts(spark):
    assert sequential.carriage_returns("loading\rdone\nx") == "doneing\nx"
    assert sequential.backspaces("abc\b\bd") == "ad"
    text = "\n".join(["a long line that repeats"] * 5 + ["b"] * 3)
    assert sequential.run_lengths(text) == "a long line that repeats\n<previous line repeated 4 additional times>\nb\nb\nb"
    got = spark.createDataFrame([("ab\rc",), (None,)], "t string").select(sequential.text_udf(sequential.carriage_returns)("t")).collect()
    assert [r[0] for r in got] == ["cb", None]


def test_matching():
    lines = ["a", "  b ", "it’s", "d"]
    assert sequential.seek(lines, ["a"]) == 0 and sequential.seek(lines, ["b"]) == 1 and sequential.seek(lines, ["it's"]) == 2
    assert sequential.seek(lines, ["x"]) is None and sequential.seek(lines, [], 2) == 2 and sequential.seek(lines, ["a"], eof=True) is None
    score, at = sequential.middle_out(["alpha", "beta", "gamma", "delta"], ["gamna"])
    assert at == 2 and 0.7 < score < 1
    rng = random.Random(2)
    for _ in range(50):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(2))
        assert (sequential.edit_distance(a, b) == 0) == (a == b) and sequential.edit_distance(a, b) >= abs(len(a) - len(b))
    assert sequential.apply_replacements(list("abcd"), [(2, 1, ["X", "Y"]), (0, 1, [])]) == ["b", "X", "Y", "d"]
    assert sequential.cache_points([10, 10, 10, 10], ["user", "assistant", "user", "user"], 2, 15) == [3]  # the last user's row
    assert sequential.with_indentation(["def f():", "    a", "", "    b", "c"], 1, 0) == (1, 3)


def test_shell():
    assert sequential.shell_parts('a && b "x; y" | c; d $(e && f) & g 2>&1') == ["a", 'b "x; y"', "c", "d $(e && f)", "g 2>&1"]
    assert sequential.command_patterns("git commit -m x && npm run test:unit extra | 5 ls") == ["git", "git commit", "npm", "npm run", "npm run test:unit"]


def test_tools(spark):
    r = tools.ToolRegistry()
    assert r.register(tools.CustomTool("shout", "Upper case", str.upper, {"text": "string"}))
    assert not r.register(tools.CustomTool("1bad", "", str.upper)) and r.errors["1bad"] == ["name", "description"]
    assert [x.name for x in r.listing(spark).collect()] == ["shout"]
    r.to_sql(spark)
    assert spark.sql("SELECT shout('abc')").first()[0] == "ABC"
    assert r.unregister("shout") and not r.unregister("shout")
    arr = lambda *xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    assert spark.range(1).select(tools.allowed_tools(arr("b", "a"), arr("c"), arr("a"), arr())).first()[0] == ["b", "c"]
    m = spark.sql("SELECT map('a', '1', 'b', '2') p, map('b', '3') e").select(tools.merged_properties(F.col("p"), F.col("e"), ["a"])).first()[0]
    assert m == {"b": "3"}
    count = tools.token_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert spark.createDataFrame([("hello world",), (None,)], "t string").select(count("t")).collect()[0][0] == 3


def test_run_lengths_as_an_expression(spark):
    """As step by step over each text, and without Python, whose workers would hold a batch of whole texts."""
    rng = random.Random(7)
    lines = ["", "a", "é" * 20, "a long line that repeats", "x" * 45, "x" * 46, "\r", "😀" * 30]
    said = ["\n".join(rng.choice(lines[: rng.choice([1, 2, 8])]) for _ in range(rng.randrange(12))) for _ in range(400)]
    said += ["a long line that repeats\n" * 20_000, "\n" * 50, "".join(f"{i}\n" for i in range(50_000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*said, None])], "id int, text string").select("id", texts.run_lengths(F.col("text")).alias("x"))
    got = {r.id: r.x for r in df.collect()}
    assert got == {i: None if t is None else sequential.run_lengths(t) for i, t in enumerate([*said, None])}


@pytest.mark.parametrize("name", ["run_length_sizes", "run_length_encoded"])
def test_run_lengths_need_no_python(spark, name):
    from tarnfold import plans

    assert "Python" not in plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
