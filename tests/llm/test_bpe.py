import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tracekit.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as f:
    DATA = f.read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}
PLAIN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = bpe.Vocabulary.from_file(DATA, public_tokenizers.PATTERN)
ALPHABET = st.text(st.one_of(st.sampled_from("ab e'st  \n\t.!,019éßжд漢字 　 \x1c\x85😀́"), st.characters(exclude_categories=["Cs"])), max_size=80)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_equals_the_library(text):
    ids = OURS.encode(text)
    assert ids == PLAIN.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode()


def test_every_code_point_is_split_alike():
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    for at in range(0, len(points), 4096):
        text = "a ".join(points[at:at + 4096])
        assert OURS.encode(text) == PLAIN.encode_ordinary(text), hex(ord(points[at]))


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 1500, " " * 500 + "x", "\n \n" * 300, "<|endoftext|> <|x|>", "don't we'll I'M", "'r", "é" * 999])
def test_long_and_repeated_pieces(text):
    assert OURS.encode(text) == PLAIN.encode_ordinary(text)


def test_slices_of_long_texts(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 40)
    rng = random.Random(3)
    for _ in range(40):
        text = "".join(rng.choice(["word", " ", "  ", "'re", "'", "\n", "x" * 70, "7", ".", "жд"]) for _ in range(120))
        assert OURS.encode(text) == PLAIN.encode_ordinary(text)


def test_every_prefix_comes_from_one_table():
    piece, last = "unbelievablyinternationalisations".encode(), []
    OURS.extend(piece, last)
    for end in range(1, len(piece) + 1):
        assert OURS.walk(piece[:end], last[:end]) == PLAIN.encode_ordinary(piece[:end].decode())


@settings(max_examples=150, deadline=None)
@given(ALPHABET, st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1), ALPHABET), max_size=6))
def test_edits_equal_encoding_anew(text, edits):
    kept = bpe.PrefixText(OURS, text)
    for x, y, new in edits:
        a, b = sorted((int(x * len(text)), int(y * len(text))))
        text = text[:a] + new + text[b:]
        kept.replace(a, b, new)
        assert kept.text == text and kept.ids() == PLAIN.encode_ordinary(text)
    kept.append("'re it")
    assert kept.ids() == PLAIN.encode_ordinary(text + "'re it")


def test_an_edit_costs_what_is_near_it():
    text = "some plain words of a longer text " * 3000
    kept = bpe.PrefixText(OURS, text)
    before = kept.steps
    kept.replace(50_000, 50_003, "new")
    kept.append("x" * 30)
    kept.append("y")
    assert kept.steps - before < 100
    assert kept.ids() == PLAIN.encode_ordinary(kept.text)


def test_a_token_that_no_merges_lead_to():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 257, b"bc": 258}
    plain = tiktoken.Encoding("few", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    ours = bpe.Vocabulary(ranks, r"\S+|\s+")
    for text in ("abcd", "abcde", "xabcd", "abc bcd", "abab bcbc aabbcc"):
        assert ours.encode(text) == plain.encode_ordinary(text)
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0}, r"\S+")


def test_tables(lspark, docs_of):
    texts = [None, "", "plain words", "plain words", "ж" * 30_000, "a\x00b <|endoftext|>", " \t\n ", "word " * 20_000]
    docs = docs_of([(i if i != 3 else 2, t) for i, t in enumerate(texts)] + [(None, "no id")])
    made = bpe.unpacked(bpe.encode(docs, PATH, public_tokenizers.PATTERN)).collect()
    assert len(made) == len(texts) + 1 and made[0]["label"] == "x"
    for r in made:
        assert r["ids"] == PLAIN.encode_ordinary(r["text"] or "")
    back = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)
    assert bpe.decode(bpe.encode(docs_of([]), PATH, public_tokenizers.PATTERN), PATH).collect() == []


def test_query_on_all_documents(lspark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in lspark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = bpe.op13_byte_bpe(lspark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = PLAIN.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
