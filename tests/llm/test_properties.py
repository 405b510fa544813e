"""Properties over generated texts."""

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnfold.llm import chat, quality, simhash, tokens

from .test_quality import brute as brute_counts
from .test_simhash import brute_fingerprint

ENCODER = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), False)
PIECES = st.sampled_from(["the", "The", "a", "'s", "'ll", "don't", ".", ",", "!!", "...", "$5", "12", "é", "中文", "🙂", "²", "Ⅷ", "ʰ", " ", "\n", "\t", "\r", " ", " ", "\x85", "\x1c", "\0", "<|", "<|endoftext|>", "_", "-", "'", '"', "́"])
TEXTS = st.one_of(st.text(max_size=40), st.lists(PIECES, max_size=30).map("".join), st.lists(st.sampled_from(["the", "cat.", "sat,", "é!", "'s", "x's", "12.", "..", "\n"]), max_size=30).map(" ".join))


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=5))
def test_remembered_words_change_no_id(texts):
    assert [bytes(x) for x in ENCODER(pa.array(texts, pa.string()))] == ENCODER.whole(texts)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == brute_fingerprint(text)


@settings(max_examples=200, deadline=None)
@given(st.one_of(TEXTS, st.lists(st.sampled_from("ab\n"), max_size=60).map(" ".join)))
def test_quality_counts(text):
    assert quality.counts(text.encode())[:5] == brute_counts(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=4))
def test_templates_parse_back(turns):
    whole = "".join(chat.OPEN + chat.escaped(r) + chat.ROLE_END + chat.escaped(t) + chat.CLOSE for r, t in turns)
    assert [(chat.unescaped(r), chat.unescaped(t)) for r, t in chat.TURN.findall(whole)] == turns
