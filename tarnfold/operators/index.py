"""A semantic index: chunks of files, hash differences, embeddings and exact vector search over tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.operators import nearest
from tarnfold.operators.batching import batches  # noqa: F401

#: Sizes in characters.
MOST, TOLERANCE, LEAST, LEAST_REST = 1000, 1.15, 50, 200
BLOCKS = "path string, identifier string, type string, start_line int, end_line int, content string, segment_hash string"
NAMESPACE = uuid.UUID("f47ac10b-58cc-4372-a567-0e02b2c3d479")


def block(path: str, name: str | None, kind: str, start: int, end: int, content: str, at: int | None = None) -> tuple:
    extra = "" if at is None else f"-{at}"
    digest = hashlib.sha256(f"{path}-{start}-{end}{extra}-{len(content)}-{content[:100]}".encode()).hexdigest()
    return path, name, kind, start, end, content, digest


def chunk_lines(path: str, lines: list[str], kind: str, name: str | None = None, base: int = 1) -> list[tuple]:
    """Blocks of whole lines of at most 1150 characters; a longer line is cut by itself; blocks under 50 are dropped."""
    limit, out, held = int(MOST * TOLERANCE), [], []  # held: (line number, text)
    last = len(lines) - 1
    size = lambda i: len(lines[i]) + (i != last)

    def flush(upto: int | None = None) -> None:
        take = held[:upto]
        text = "\n".join(t for _, t in take)
        if len(text) >= LEAST and take:
            out.append(block(path, name, kind, base + take[0][0], base + take[-1][0], text))
        del held[:upto]

    total = 0
    for i, line in enumerate(lines):
        if size(i) > limit:
            flush()
            total = 0
            for at in range(0, len(line), MOST):
                out.append(block(path, name, f"{kind}_segment", base + i, base + i, line[at : at + MOST], at))
            continue
        if held and total + size(i) > limit:
            rest = sum(size(j) for j in range(i, len(lines)))
            cut = len(held)
            if rest < LEAST_REST:  # move the split back until both sides are large enough
                left, right = total, rest
                while cut > 1 and right < LEAST_REST and left - size(held[cut - 1][0]) >= LEAST:
                    cut -= 1
                    left -= size(held[cut][0])
                    right += size(held[cut][0])
                if right < LEAST_REST:
                    cut = len(held)
            flush(cut)
            total = sum(size(j) for j, _ in held)
        held.append((i, line))
        total += size(i)
    flush()
    return out


def markdown_sections(lines: list[str]) -> list[tuple[int, int, str | None]]:
    """(first row, last row, header) of what stands before the first header and of each section."""
    heads, fence = [], False
    for i, line in enumerate(lines):
        if line.lstrip().startswith("```"):
            fence = not fence
        elif not fence and (h := line.lstrip("#")) != line and 1 <= len(line) - len(h) <= 6 and h[:1].isspace() and h.strip():
            heads.append((i, h.strip()))
        elif not fence and i and len(s := line.strip()) >= 3 and set(s) in ({"="}, {"-"}) and lines[i - 1].strip() and not (heads and heads[-1][0] == i - 1):
            heads.append((i - 1, lines[i - 1].strip()))
    ends = [h[0] - 1 for h in heads[1:]] + [len(lines) - 1]
    before = [(0, heads[0][0] - 1, None)] if heads and heads[0][0] else []
    return before + [(a, e, t) for (a, t), e in zip(heads, ends, strict=True)] if heads else [(0, len(lines) - 1, None)]


def chunk_file(path: str, content: str) -> list[tuple]:
    lines = (content or "").split("\n")
    if not path.lower().endswith((".md", ".markdown")):
        return chunk_lines(path, lines, "fallback_chunk") if len(content or "") >= LEAST else []
    out = []
    for start, end, name in markdown_sections(lines):
        own = lines[start : end + 1]
        text = "\n".join(own).strip()
        if len(text) < LEAST:
            continue
        kind = "markdown_header" if name else "markdown_content"
        out += chunk_lines(path, own, kind, name, start + 1) if len(text) > MOST * TOLERANCE else [block(path, name, kind, start + 1, end + 1, text)]
    seen: set[str] = set()
    return [b for b in out if not (b[-1] in seen or seen.add(b[-1]))]


def chunks(files: DataFrame) -> DataFrame:
    """Blocks of files (path, content): markdown by sections, all else by lines. A file is one row, so no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [x for p, c in zip(b["path"], b["content"], strict=True) for x in chunk_file(p, c or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def eligible(files: DataFrame, extensions: Sequence[str], most_bytes: int = 1 << 20) -> DataFrame:
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.where(ext.isin(list(extensions)) & (F.octet_length("content") <= most_bytes))


def file_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def hash_diff(known: DataFrame, files: DataFrame) -> DataFrame:
    """path, state: new, modified, same or deleted, of (path, file_hash) tables."""
    k, f = known.select("path", F.col("file_hash").alias("_k")), files.select("path", F.col("file_hash").alias("_f"))
    state = F.when(F.col("_k").isNull(), "new").when(F.col("_f").isNull(), "deleted").when(F.col("_k") == F.col("_f"), "same").otherwise("modified")
    return k.join(f, "path", "full_outer").select("path", state.alias("state"))


def point_id(segment_hash: Column) -> Column:
    """UUIDv5 of the hash: SHA-1 of namespace and name, with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), segment_hash.cast("binary")))
    variant = F.lower(F.conv(F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("string"), 10, 16))
    s = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat(s(1, 8), F.lit("-"), s(9, 4), F.lit("-5"), s(14, 3), F.lit("-"), variant, s(18, 3), F.lit("-"), s(21, 12))


def collection_name(workspace: Column) -> Column:
    return F.concat(F.lit("ws-"), F.left(F.sha2(workspace.cast("binary"), 256), F.lit(16)))


def upsert(points: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """points with new ones in place of those of the same key; of several new ones the last in the order."""
    if order:
        w = Window.partitionBy(key).orderBy(F.desc(order))
        new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return points.join(new, key, "left_anti").select(points.columns).unionByName(new.select(points.columns))


def replace_files(points: DataFrame, paths: DataFrame, new: DataFrame) -> DataFrame:
    """All points of the given paths go, all new ones come: a file is replaced as a whole."""
    return points.join(paths.select("path").distinct(), "path", "left_anti").select(points.columns).unionByName(new)


def embed(texts: DataFrame, text: str, embedder, dims: int) -> DataFrame:
    """texts with embedding. embedder: list of strings -> array (n, dims); a text and its vector stay together."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(embedder(s.fillna("").tolist()), np.float32).reshape(-1, dims)))

    return texts.withColumn("embedding", run(text))


def hashed_embedder(dims: int = 64):
    """A stand-in without a model: words hashed to signs and places, of length one."""

    def embedder(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
                out[i, h % dims] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embedder


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_search(points: DataFrame, query: Sequence[float], k: int = 50, least: float = 0.4, prefix: Column | None = None) -> DataFrame:
    """The k points with the largest cosine of `least` or more; the filter comes before the cut. Exact, one pass, no shuffle
    but that of k rows a task."""
    rows = points if prefix is None else points.where(prefix)
    score = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    return rows.withColumn("score", score).where(F.col("score") >= least).orderBy(F.desc("score")).limit(k)


def vector_search_all(points: DataFrame, queries: DataFrame, key: str, k: int = 50, least: float = 0.4, block: int = 1024) -> DataFrame:
    """query_id, key, score: of each query (key, embedding) the k points with the largest cosine of `least` or more.

    Exact. Up to `block` queries go to where the points are, and points cross no exchange; more meet them as a grid of
    blocks and chunks. A task sends k points a query; equal scores (to nine places) go by key. Null, empty and zero
    vectors are near to nothing.
    """
    if queries.count() > block:
        return nearest.exact(points, queries, key, k, least)
    chosen = queries.where(F.size("embedding") > 0).select(key, "embedding").collect()  # `block` rows at most
    return nearest.top(best_of_block(points.select(key, "embedding"), [r[0] for r in chosen], [r[1] for r in chosen], key, k, least), key, k)


def best_of_block(points: DataFrame, ids: list[int], vectors: list[list[float]], key: str, k: int, least: float) -> DataFrame:
    """query_id, key, score: the k nearest points of each partition."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q = np.array(ids, np.int64), nearest.vectors(pa.array(vectors, pa.list_(pa.float64())))
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for b in batches_:
            more = nearest.best_pairs(asked, q, b.column(0).to_numpy(zero_copy_only=False), nearest.vectors(b.column(1)), k, least)
            who, what, score = (np.concatenate(x) for x in zip(best, more, strict=True))
            order = np.lexsort((what, -score, who))
            who, what, score = who[order], what[order], score[order]
            first = np.arange(len(who)) - np.searchsorted(who, who) < k
            best = who[first], what[first], score[first]
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["query_id", key, "score"])

    return points.mapInArrow(run, f"query_id long, {key} long, score double")


def failure_rate(found: Column, indexed: Column) -> Column:
    return F.coalesce(F.try_divide((found - indexed).cast("double"), found), F.lit(0.0))
