"""Numbers as people read them, and prices. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Half up, towards plus infinity."""
    return F.floor(x + 0.5)


def score_percent(x: Column) -> Column:
    return js_round(x * 100)


def tokens(n: Column) -> Column:
    """999, 73k, 1.0M, 1.0B, with the carry from one unit to the next."""
    one = lambda d, unit: F.concat(F.format_string("%.1f", F.round(n / d, 1)), F.lit(unit))
    k = js_round(n / 1000)
    return F.when(n < 1000, n.cast("string")).when(k < 1000, F.concat(k.cast("string"), F.lit("k"))).when(F.round(n / 1e6, 1) < 1000, one(1e6, "M")).otherwise(one(1e9, "B"))


def tokens_fixed(n: Column) -> Column:
    return F.when(n < 1000, n.cast("string")).when(n < 1e6, F.format_string("%.1fK", n / 1e3)).when(n < 1e9, F.format_string("%.2fM", n / 1e6)).otherwise(F.format_string("%.2fB", n / 1e9))


def duration(ms: Column) -> Column:
    """0:01:01 of milliseconds."""
    s = F.floor(ms / 1000)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", F.floor(s / 3600).cast("string"), two(F.floor(s % 3600 / 60)), two(s % 60))


def duration_words(ms: Column) -> Column:
    """1h 2m 3s, without leading zero parts."""
    s = F.floor(ms / 1000)
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.concat_ws(" ", F.when(h > 0, F.concat(h, F.lit("h"))), F.when((m > 0) | (h > 0), F.concat(m, F.lit("m"))), F.concat(r, F.lit("s")))


def currency(x: Column) -> Column:
    return F.when(x.isNull(), "-").when(x < 0, F.concat(F.lit("-$"), F.format_number(-x, 2))).otherwise(F.concat(F.lit("$"), F.format_number(x, 2)))


def compact_number(n: Column) -> Column:
    """Cut, not rounded: 1999 is 1.9k."""
    cut = lambda d, u: F.concat(F.regexp_replace(F.format_string("%.1f", F.floor(n / d * 10) / 10), r"\.0$", ""), F.lit(u))
    return F.when(n >= 1e6, cut(1e6, "M")).when(n >= 1000, cut(1000, "k")).otherwise(n.cast("string"))


def bytes_text(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" bytes"))).when(n < 1 << 20, F.format_string("%.1fKB", n / 1024)).otherwise(F.format_string("%.1fMB", n / (1 << 20)))


def relative_time(at_ms: Column, now_ms: Column) -> Column:
    """The largest whole unit since then: 3 minutes, 2 years."""
    s = F.floor((now_ms - at_ms) / 1000)
    out = F.lit("just now")
    for unit, size in (("minute", 60), ("hour", 3600), ("day", 86_400), ("week", 604_800), ("month", 2_592_000), ("year", 31_536_000)):
        n = F.floor(s / size)
        out = F.when(s >= size, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))).otherwise(out)
    return out


def abbreviation(tool: Column) -> Column:
    """First letters of the words of a_tool_name."""
    return F.upper(F.array_join(F.transform(F.split(tool, "_"), lambda w: F.left(w, F.lit(1))), ""))


def api_price(text: Column) -> Column:
    """A price a token as a price a million; null for none or zero."""
    x = text.try_cast("double")
    return F.when(x != 0, x * 1e6)


def long_context(input_tokens: Column, price: Column, threshold: int | None, multiplier: float, allowed: Column | None = None) -> Column:
    if threshold is None:
        return price
    applies = input_tokens > threshold
    return F.when(applies if allowed is None else applies & allowed, price * multiplier).otherwise(price)


def api_cost(input_tokens: Column, output_tokens: Column, cache_writes: Column, cache_reads: Column, prices: dict[str, Column | float], input_has_cache: bool) -> Column:
    """Cost from prices a million tokens. input_has_cache: whether cached tokens are part of the input (then they are
    taken out, never below zero)."""
    z = F.lit(0)
    w, r = F.coalesce(cache_writes, z), F.coalesce(cache_reads, z)
    fresh = F.greatest(input_tokens - w - r, z) if input_has_cache else input_tokens
    of = lambda n, k: n * (prices[k] if isinstance(prices[k], Column) else F.lit(float(prices[k]))) / 1e6
    return of(w, "cache_writes") + of(r, "cache_reads") + of(fresh, "input") + of(output_tokens, "output")


def over_context(tokens_: Column, window: Column, reserved: Column, threshold: Column, inherited: Column) -> Column:
    """Whether to condense: percent of the window at the threshold (-1 inherits; else valid from 5 to 100), or more than
    nine tenths of the window less what is reserved."""
    t = F.when(threshold == -1, inherited).when(threshold.between(5, 100), threshold).otherwise(inherited)
    return (100.0 * tokens_ / window >= t) | (tokens_ > window * 0.9 - reserved)


def context_action(condense: Column, tokens_: Column, window: Column, reserved: Column, auto: Column) -> Column:
    """condense, truncate or keep."""
    return F.when(auto & condense, "condense").when(tokens_ > window * 0.9 - reserved, "truncate").otherwise("keep")
