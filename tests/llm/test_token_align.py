import base64
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tracekit.llm import token_align as T

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
    A_BYTES = {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}

TEXTS = [None, "", " ", "plain words and plain words", "plain words and plain words", "don't <|endoftext|> <s> </s>", "été 東京 жизнь 😀",
         "tab\tand\nlines\n\n", "▁ a lower block", "a\x00b", "ﬁ ligature ① é", "x" * 5000, "word " * 3000, "  two  spaces ", " thin"]


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def plain(texts):
    """By two pointers over the tokens, a document at a time."""
    rows, counts = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = A.encode(raw.decode(), add_special_tokens=False).ids, B.encode(text or "")
        if not text or b"".join(A_BYTES[i] for i in a) != raw or b"".join(map(b_bytes, b)) != raw:
            rows.append((0, 0, [], ""))
            continue
        groups, links, i, j, end_a, end_b = [([], [])], [], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if end_a <= end_b:
                groups[-1][0].append(a[i])
                end_a += len(A_BYTES[a[i]])
                i += 1
            else:
                groups[-1][1].append(b[j])
                end_b += len(b_bytes(b[j]))
                j += 1
            if end_a == end_b:
                links.append((a[i - 1], b[j - 1]))
                groups.append(([], []))
        rows.append((len(a), len(b), links, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups[:-1])))
        counts.update(links)
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return [(n_a, n_b, len(links), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(groups.encode()).hexdigest() if groups else "", groups) for n_a, n_b, links, groups in rows]


def test_slices_equal_two_pointers(docs_of, lspark):
    from pyspark.sql import functions as F
    docs = docs_of([(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, TEXTS[3])]).coalesce(1)
    texts = [*TEXTS, "null id", TEXTS[3]]
    found = T.align(docs, A_PATH, B_PATH)
    assert found.columns[:2] == ["doc_id", "source"] and "label" in found.columns
    rows = found.withColumn("row", F.monotonically_increasing_id())
    got = T.corpus_links(rows).orderBy("row").collect()
    want = plain(texts)
    assert any(w[0] for w in want) and sum(w[0] == 0 for w in want) >= 3
    for r, w in zip(got, want, strict=True):
        assert (r["n_a"], r["n_b"], r["n_links"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) == (*w[:6], w[7])


def test_empty_table(docs_of):
    from pyspark.sql import functions as F
    found = T.align(docs_of([]), A_PATH, B_PATH).withColumn("row", F.monotonically_increasing_id())
    assert T.corpus_links(found).collect() == []


def test_partial_counts_are_sent_on(docs_of, monkeypatch):
    docs = docs_of([(i, t) for i, t in enumerate(TEXTS)])
    whole = sorted(map(tuple, T.pair_counts(T.align(docs, A_PATH, B_PATH)).collect()))
    monkeypatch.setattr(T, "PAIRS", 3)
    assert sorted(map(tuple, T.pair_counts(T.align(docs, A_PATH, B_PATH)).collect())) == whole


def test_both_joins_agree(docs_of, monkeypatch):
    from pyspark.sql import functions as F
    docs = docs_of([(i, t) for i, t in enumerate(TEXTS)]).coalesce(1)
    rows = T.align(docs, A_PATH, B_PATH, digest=True).withColumn("row", F.monotonically_increasing_id())
    small = sorted(map(repr, T.corpus_links(rows).collect()))
    monkeypatch.setattr(T, "small_table", lambda df: df)
    assert sorted(map(repr, T.corpus_links(rows).collect())) == small


def test_query_on_all_documents(lspark):
    sf_dir = "/root/testdata/sf0.01"
    docs = lspark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = {d["doc_id"]: w[:7] for d, w in zip(docs, plain([d["text"] for d in docs]))}
    got = {r["doc_id"]: tuple(r)[1:] for r in T.op11_token_alignment(lspark, sf_dir).collect()}
    assert got == want


def test_documents_are_their_words(monkeypatch):
    with open(A_PATH, "rb") as file:
        data = file.read()
    rng = random.Random(4)
    some = [*" " * 12, *"\t\n\x0b\x1c\x1f\x85\xa0 　​᠎﻿", *"ab'sté12Ⅷ½!,.", "'re", "<|endoftext|>", "東京", "\U0001f600", "́"]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 30))) for _ in range(5000)] + [" word" * 3000, "x" * 3000, *filter(None, TEXTS)]
    made = T.ByteLevel(data)
    assert [x.tolist() for x in made.encode(texts)] == [A.encode(t, add_special_tokens=False).ids for t in texts]
    left, right = T.Side(made), T.Side(T.Pieces(B.serialized_model_proto()))
    want = {k: x.to_pylist() for k, x in T.aligned_slice(left, right, texts).items()}
    for kept in (T.KEPT, 20):
        monkeypatch.setattr(T, "KEPT", kept)
        words = T.Words(left, right)
        assert words.by_word
        got = [words.aligned(texts[start:start + 500]) for start in range(0, len(texts), 500)]
        assert {k: [v for part in got for v in part[k].to_pylist()] for k in want} == want
    sent, encoded = [], made._encoded
    monkeypatch.setattr(made, "_encoded", lambda batch: sent.extend(batch) or encoded(batch))
    T.Words(left, right).aligned([" word" * 3000] * 3)
    assert sum(map(len, sent)) < 100
