import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarnfold.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows, path=PATH):
    tok = Tokenizer.from_file(path)
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[1])


def test_against_brute_force(small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    assert got(tokens.token_table(small, PATH)) == brute(rows)


ODD = [None, "", " ", "\n", "  a b", "a  b", "x\n\ny", "a\tb", "tail ", "<|endoftext|> z", "it's we'll 'll x", "a.. ... b,c. é. 5. $5.00 don't.", "don't'", "a b c", "中文。 字 　 x", "nul \0 y", "word " * 100_000, "é́. ​! x!", "²½. ³"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_edge_cases(make, name):
    rows = list(enumerate(ODD)) + [(0, "again"), (None, "x y"), (3, "\n")]
    path = public_tokenizers.path(name)
    assert got(tokens.token_table(make(rows), path, partitions=3)) == brute(rows, path)
    assert tokens.token_table(make([]), path).count() == 0


def test_words_are_forgotten_when_there_are_too_many(monkeypatch):
    import pyarrow as pa

    e = tokens.Encoder(PATH, False)
    monkeypatch.setattr(e, "MEMORY", 3)
    for text in ("one two three four", "five six", "one, two", "one two"):
        assert e(pa.array([text])) == e.whole([text])


def test_files(make, spark, tmp_path):
    """The files can be read without this library: what the module says about them is all that is needed."""
    rows = [(i, f"text number {i}") for i in range(50)]
    manifest = tokens.write_tokens(make(rows), PATH, f"file://{tmp_path}/t", partitions=3).collect()
    ids = []
    for r in sorted(manifest, key=lambda r: r.part):
        path = r.uri.removeprefix("file://")
        index = np.memmap(f"{path}.idx", "<i8", "r")
        flat = np.memmap(f"{path}.bin", "<u2", "r")
        assert index[1] == 2 and r.base == len(ids) and len(flat) == r.n_tokens
        assert index[2] == r.n_docs and index[-1] == len(flat)
        ids += flat.tolist()
    assert ids == [x for _, t in rows for x in [*Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids, 0]]


def test_files_are_as_many_as_the_bytes_ask_for(make, spark, tmp_path, monkeypatch):
    """Also where all rows have one doc_id, or none: ranges divide its texts, and their order holds over the files."""
    rows = [(None if i % 2 else 7, f"{i:04d} " + "word " * 40) for i in range(400)]
    monkeypatch.setattr(tokens, "parts_for", lambda spark, size: -(-size // 10_000))
    manifest = tokens.write_tokens(make(rows), PATH, f"file://{tmp_path}/t")
    sizes = [r.n_docs for r in manifest.collect()]
    assert len(sizes) >= 6 and max(sizes) < 150
    assert got(tokens.read_tokens(manifest)) == brute(rows)
