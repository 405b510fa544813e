"""Token files: flat unsigned integers with 64-bit document offsets, one pair of files a partition, memory-mapped.

`part-NNNNN-A.bin` holds the ids of a partition's documents one after the other, little-endian, in 16 bits if the
vocabulary fits and else in 32. `part-NNNNN-A.idx` holds, as little-endian signed 64-bit numbers: the magic number,
the width of an id in bytes, the number n of documents, their n doc_ids, and n + 1 offsets into the ids. A is the
attempt's own mark: a task that runs twice writes two pairs, and the manifest names the one that counts. Partitions
are in ascending order of doc_id; where partition p begins among all ids is the sum of the counts before it.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import cut, drop, kept, parts_for, shared_dir

MAGIC = 0x54464E31
NULL_ID = -(1 << 63)
#: Texts of about so many bytes are encoded at once.
BATCH = 1 << 23
#: Characters by which ranges divide the texts of one doc_id: their order is that of the texts.
HEAD = 32
#: With fewer different ids than this share of the rows, some may be shared by many.
SHARED_IDS = 0.9


class Encoder:
    """Ids of whole texts through the tokenizer; words that came before are remembered.

    A byte-level tokenizer cuts a text before each single space and around each single line break before it merges,
    so there a word's ids do not depend on what stands around it. Texts with other white space, and those with what
    might be a special token, go to the tokenizer as they are; so do all texts of any other kind of tokenizer.
    """

    OTHER = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x00]|[ \n][ \n]|^[ \n]|[ \n]$|<\|"
    #: Bytes of the words that are remembered, with what Python keeps for each.
    MEMORY, OF_A_WORD = 100 << 20, 200
    MARKS = "!#$%&*+,-./:;=?@^_|~"

    def __init__(self, path: str, encode_special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = encode_special
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        model = json.loads(self.tok.to_str())
        pre = model.get("pre_tokenizer") or {}
        self.by_word = model.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), self.kind).tobytes()
        ends = [0, *accumulate(len(x) * self.kind.itemsize for x in ids)]
        return [flat[a:b] for a, b in pairwise(ends)]

    def words(self, words: list[str]) -> list[bytes]:
        if self.held > self.MEMORY:
            self.known.clear()
            self.held = 0
        known, halves = self.known, {}
        for w in words:  # letters and the marks after them are apart as well
            if w not in known and len(core := w.rstrip(self.MARKS)) < len(w) and core[-1:].isalpha():
                halves[w] = core, w[len(core) :]
        new = list(set(words).difference(halves).union(*halves.values()).difference(known))
        coded = self.whole(new)
        known.update(zip(new, coded, strict=True))
        self.held += self.OF_A_WORD * len(new) + sum(map(len, new)) + sum(map(len, coded))
        return [known[w] if w in known else known[halves[w][0]] + known[halves[w][1]] for w in words]

    def __call__(self, texts: pa.Array) -> list[bytes | memoryview]:
        """texts: without nulls."""
        odd = pc.match_substring_regex(texts, self.OTHER).to_numpy(zero_copy_only=False) if self.by_word else np.ones(len(texts), bool)
        out: list = [b""] * len(texts)
        for i, ids in zip(np.flatnonzero(odd), self.whole(texts.filter(pa.array(odd)).to_pylist()), strict=True):
            out[i] = ids
        plain = np.flatnonzero(~odd)
        if len(plain):
            # a space before each word but a line's first, which is what the tokenizer sees
            marked = pc.replace_substring(pc.replace_substring(texts.take(pa.array(plain)), "\n", "\0\n\0"), " ", "\0 ")
            pieces = pc.split_pattern(marked, "\0")
            coded = pieces.flatten().dictionary_encode()
            ids = self.words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            ends = np.cumsum([0, *map(len, ids)]) // self.kind.itemsize
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), self.kind)))
            each = lists.take(coded.indices)
            flat, stops = each.flatten().to_numpy(), each.offsets.to_numpy()[pieces.offsets.to_numpy()]
            for i, a, b in zip(plain, stops[:-1], stops[1:], strict=True):
                out[i] = flat[a:b].tobytes()
        return out


def encoder(path: str, encode_special: bool) -> Encoder:
    return kept(("encoder", path, encode_special), lambda: Encoder(path, encode_special))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Local files are mapped into memory; other schemes are opened through their own file systems."""
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(use_mmap=True), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, partitions: int | None = None, encode_special: bool = False) -> DataFrame:
    """Encode whole texts in ascending doc_id order into folder; the manifest: part, uri, n_docs, n_tokens, base.

    A null or empty text is the end id alone. Null doc_ids come first; rows of one doc_id are in the order of their
    texts, null before empty; ranges divide them by the first characters. The texts cross one range exchange; nothing but a row for each partition goes to the driver.
    partitions: how many pairs of files; as many as the texts' bytes ask for if None, 64 MB each, which are summed up first.
    encode_special: whether strings of special tokens inside texts are ordinary text.
    """
    spark = docs.sparkSession
    size, count, ids = docs.agg(F.sum(F.octet_length("text")), F.count("*"), F.approx_count_distinct("doc_id")).first()
    parts = partitions or parts_for(spark, int(size or 0))
    # ids that many rows share are divided by what their texts begin with; otherwise only ids are looked at for the ranges
    heads = [F.left("text", F.lit(HEAD)).asc_nulls_first()] if ids < SHARED_IDS * count else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, encode_special)
        end = np.array([end_id], encode.kind).tobytes()
        fs, base = file_system(folder)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}"
        fs.create_dir(base, recursive=True)
        ids, sizes = [], []
        with fs.open_output_stream(f"{base}/{name}.bin") as out:
            for b in batches:
                ids += [NULL_ID if i is None else i for i in b.column(0).to_pylist()]
                texts = pc.fill_null(b.column(1), "")
                lengths, start = np.cumsum(pc.binary_length(texts).to_numpy()), 0
                while start < len(texts):
                    stop = max(start + 1, int(np.searchsorted(lengths, (lengths[start - 1] if start else 0) + BATCH, "right")))
                    for tokens in encode(texts.slice(start, stop - start)):
                        sizes.append(len(tokens) // len(end) + 1)
                        out.write(tokens + end)
                    start = stop
        n = sum(sizes)
        if not sizes:
            fs.delete_file(f"{base}/{name}.bin")
            return
        with fs.open_output_stream(f"{base}/{name}.idx") as out:
            out.write(np.array([MAGIC, encode.kind.itemsize, len(ids), *ids, 0, *np.cumsum(sizes)], "<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "uri": [f"{folder}/{name}"], "n_docs": [len(ids)], "n_tokens": [n]})

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, order[0], *heads).sortWithinPartitions(*order)
    written = cut(rows.mapInArrow(run, "part long, uri string, n_docs long, n_tokens long")).orderBy("part").collect()
    base, out = 0, []
    for r in written:
        out.append((r["part"], r["uri"], r["n_docs"], r["n_tokens"], base))
        base += r["n_tokens"]
    return spark.createDataFrame(out, "part long, uri string, n_docs long, n_tokens long, base long")


def read_part(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, offsets and ids of one partition, as views of the mapped files."""
    fs, path = file_system(uri)

    def mapped(end: str, kind: str) -> np.ndarray:
        with fs.open_input_file(f"{path}.{end}") as f:
            return np.frombuffer(f.read_buffer(), kind)

    index = mapped("idx", "<i8")
    if index[0] != MAGIC:
        raise ValueError(f"{uri}.idx is not an index of token ids")
    n = int(index[2])
    return index[3 : 3 + n], index[3 + n :], mapped("bin", "<u2" if index[1] == 2 else "<u4")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32, from the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri, base in zip(b["uri"], b["base"], strict=True):
                doc_ids, offsets, ids = read_part(uri)
                for lo in range(0, len(doc_ids), 10_000):
                    at = offsets[lo : lo + 10_001]
                    crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(at[:-1], at[1:], strict=True)]
                    yield pd.DataFrame({"doc_id": doc_ids[lo : lo + 10_000], "start": base + at[:-1], "n_tokens": np.diff(at), "ids_crc32": crc})

    n = max(1, manifest.count())
    rows = manifest.repartition(n).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def token_table(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the files into a folder of the shared one, read them back, and delete them.

    Rows and null values are as in write_tokens(). A text of any length is one document; an empty table gives no rows.
    Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    out = cut(read_tokens(write_tokens(docs, tokenizer_path, folder, **options)))
    drop(spark, folder)
    return out
