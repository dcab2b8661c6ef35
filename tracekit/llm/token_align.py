"""Alignment of two tokenizers' tokens by the bytes they end at.

Inside tasks all work is on Arrow columns: the token lists of a slice of
documents are flattened, each token keeps the index of its document (the
list's parent index), a running sum of token lengths that starts over at every
document gives the byte it ends at, and a hash join of both sides on
(document, end) finds the tokens that end together. These links cut both
token sequences into groups. ``Table.group_by`` counts pairs in a document and
partial counts of pairs in a task; Spark adds those up and joins the sums back.

Vocabulary files are read where the job is written and broadcast: their size
is that of the files.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm._common import small_table, written
from tracekit.llm._text import text_groups

SLICE = 1 << 20  # characters encoded at a time
PAIRS = 1 << 19  # distinct pairs of a task's partial counts before they are sent on
MOST_BYTES = 1 << 28  # of a vocabulary file
B_BITS = 32  # of a pair's number, the id on the right
KEPT = 400_000  # words whose alignment a task keeps, and KEPT_BYTES of groups; beyond, it starts over
KEPT_BYTES = 1 << 25
TOGETHER = 1000  # words that are encoded as one text
# before a space that follows no white space a byte-level piece always starts
_CUT, _PLAIN = re.compile(r"(?<=[\w!-~])(?= .)", re.DOTALL), re.compile(r" [\w!-~]+")


def _byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable
    characters of Latin-1 stand for themselves, the others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE vocabulary of the tokenizers library, as JSON."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(data.decode())
        self.model.encode_special_tokens = True
        letter = _byte_of_letter()
        whole = json.loads(data)
        added = {t["id"]: t["content"] for t in whole.get("added_tokens", [])}
        vocab = {i: t for t, i in self.model.get_vocab().items()}
        self.tokens = [b""] * (max(vocab) + 1)
        for i, token in vocab.items():
            self.tokens[i] = added[i].encode() if i in added else bytes(letter[c] for c in token)
        self.lengths = np.array([len(t) for t in self.tokens])

        # without what reaches beyond a piece, a text's ids are those of its words
        pieces = whole.get("pre_tokenizer") or {}
        self.by_word = (whole.get("model", {}).get("type") == "BPE" and pieces.get("type") == "ByteLevel" and pieces.get("use_regex", True)
                        and not pieces.get("add_prefix_space", True) and not any(whole.get(k) for k in ("normalizer", "truncation", "padding"))
                        and all(t.get("special") for t in whole.get("added_tokens", [])))

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words as ``_CUT`` makes them, packed. Those that any
        other word may follow are encoded many at a time and parted by their bytes."""
        plain = [w for w in words if _PLAIN.fullmatch(w)]
        ids = np.concatenate([np.empty(0, "<u4"), *self._encoded(["".join(plain[i:i + TOGETHER]) for i in range(0, len(plain), TOGETHER)])])
        tokens = np.cumsum(self.lengths[ids])
        ends = np.cumsum([len(w.encode()) for w in plain], dtype=np.int64)
        last = np.searchsorted(tokens, ends) + 1
        if not np.array_equal(tokens[last[last <= len(tokens)] - 1], ends):
            plain, last = [], last[:0]  # some bytes have no tokens
        packed, bounds = ids.tobytes(), [0, *(4 * last).tolist()]
        out = {w: packed[i:j] for w, i, j in zip(plain, bounds, bounds[1:])}
        rest = [w for w in words if w not in out]
        out.update(zip(rest, (x.tobytes() for x in self._encoded(rest))))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Each distinct word, with the space before it,
        is encoded once where the vocabulary allows it."""
        if not self.by_word:
            return self._encoded(texts)
        words = [_CUT.split(t) for t in texts]
        ids = self._words(list(set().union(*words)))
        return [np.frombuffer(b"".join(map(ids.__getitem__, w)), "<u4") for w in words]


class Pieces:
    """A sentencepiece model; its pieces' bytes, U+2581 being a space."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.tokens = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.tokens.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

        # pieces that hold spaces in front only, by merges: a text's are those of its words
        from sentencepiece import sentencepiece_model_pb2

        whole = sentencepiece_model_pb2.ModelProto()
        whole.ParseFromString(data)
        how, usual = whole.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        self.by_word = (whole.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE and not whole.trainer_spec.treat_whitespace_as_suffix
                        and how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces and not how.precompiled_charsmap
                        and not any(p.type == usual.USER_DEFINED or "▁" in p.piece.lstrip("▁") for p in whole.pieces))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Side:
    """A tokenizer and Arrow columns of its tokens' bytes and lengths."""

    def __init__(self, tokenizer: ByteLevel | Pieces):
        self.tokenizer = tokenizer
        self.bytes = pa.array(tokenizer.tokens, pa.large_binary())
        self.lengths = pc.cast(pc.binary_length(self.bytes), pa.int64())
        if pc.any(pc.equal(self.lengths, 0)).as_py():
            # such a token would end where the one before it does
            raise ValueError("a token without bytes")
        names = [str(i) for i in range(len(self.bytes))]
        # an id's digits with what follows it: a token of its group, the other side, a group, nothing
        self.digits = pa.array([n + mark for mark in (",", "|", ";", "") for n in names], pa.large_string())

    def lists(self, texts: list[str]) -> pa.LargeListArray:
        ids = self.tokenizer.encode(texts)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
        return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *map(np.asarray, ids)]).astype(np.int64)))

    def joined(self, lists: pa.LargeListArray) -> pa.Array:
        """The bytes of each list's tokens."""
        tokens = pa.LargeListArray.from_arrays(lists.offsets, pc.take(self.bytes, lists.flatten()))
        return pc.binary_join(tokens.cast(pa.list_(pa.large_binary())), pa.scalar(b"", pa.large_binary()))

    def ends(self, lists: pa.LargeListArray) -> pa.Table:
        """A row per token: its document, the byte it ends at there, its place
        among all and its id."""
        ids, doc = lists.flatten(), pc.list_parent_indices(lists)
        total = pc.cumulative_sum(pc.take(self.lengths, ids))
        # the running sum before each document, taken off its tokens
        until = np.concatenate([[0], total.to_numpy(zero_copy_only=False)])[np.asarray(lists.offsets)[:-1]]
        end = pc.subtract(total, pc.take(pa.array(until), doc))
        return pa.table({"doc": doc, "end": end, "place": pa.array(np.arange(len(ids))), "id": ids})


_SIDES: dict[str, Side] = {}


def _side(kind: type, digest: str, data) -> Side:
    """The broadcast vocabulary, read once in a worker."""
    if digest not in _SIDES:
        if len(_SIDES) >= 4:
            _SIDES.clear()
        _SIDES[digest] = Side(kind(data.value))
    return _SIDES[digest]


def _shared(spark: SparkSession, path: str) -> tuple[str, object]:
    with open(path, "rb") as file:
        data = file.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)


def linked(left: Side, right: Side, a: pa.LargeListArray, b: pa.LargeListArray) -> pa.Table:
    """(doc, place, id, place_b, id_b) of the tokens that end together, in order."""
    other = right.ends(b).rename_columns(["doc", "end", "place_b", "id_b"])
    found = left.ends(a).join(other, ["doc", "end"], join_type="inner", use_threads=False)
    return found.sort_by("place").select(["doc", "place", "id", "place_b", "id_b"])


def group_texts(left: Side, right: Side, a: pa.LargeListArray, b: pa.LargeListArray, links: pa.Table) -> pa.Array:
    """Every document's groups as ``a1,a2|b1;a3|b2``: each token's digits go
    to their place among both sides' tokens and are joined by document."""
    i, j = (links.column(c).to_numpy() for c in ("place", "place_b"))
    ids_a, ids_b = (x.flatten().to_numpy(zero_copy_only=False) for x in (a, b))
    before_a, before_b = np.concatenate([[0], i + 1]), np.concatenate([[0], j + 1])
    # tokens of group g stand behind the other side's tokens of earlier groups, on the right also of g
    group_a, group_b = (np.searchsorted(last, np.arange(len(ids))) for last, ids in ((i, ids_a), (j, ids_b)))
    at_a, at_b = np.arange(len(ids_a)) + before_b[group_a], np.arange(len(ids_b)) + before_a[group_b + 1]
    last_of_doc = np.asarray(b.offsets)[1:] - 1
    mark_a, mark_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    mark_a[i], mark_b[j] = 1, 2
    mark_b[last_of_doc[np.diff(np.asarray(b.offsets)) > 0]] = 3
    take = np.empty(len(ids_a) + len(ids_b), np.int64)
    take[at_a] = mark_a * (len(left.digits) // 4) + ids_a
    take[at_b] = len(left.digits) + mark_b * (len(right.digits) // 4) + ids_b
    digits = pc.take(pa.concat_arrays([left.digits, right.digits]), pa.array(take))
    offsets = pa.array(np.asarray(a.offsets) + np.asarray(b.offsets))
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, digits).cast(pa.list_(pa.large_string())), pa.scalar("", pa.large_string()))


def _by_doc(links: pa.Table, docs: int) -> dict[str, pa.Array]:
    """Each document's distinct pairs, and their n added up."""
    times = links.group_by(["doc", "pair"], use_threads=False).aggregate([("n", "sum")])
    times = times.sort_by([("doc", "ascending"), ("pair", "ascending")])
    bounds = pa.array(np.searchsorted(times.column("doc").to_numpy(), np.arange(docs + 1)).astype(np.int32))
    return {"pairs": pa.ListArray.from_arrays(bounds, times.column("pair").combine_chunks()),
            "times": pa.ListArray.from_arrays(bounds, times.column("n_sum").combine_chunks())}


def aligned_slice(left: Side, right: Side, texts: list[str | None]) -> dict[str, pa.Array]:
    """The alignment of some documents, a value for each."""
    def nothing_unless(lists: pa.LargeListArray, whole: np.ndarray) -> pa.LargeListArray:
        n = np.where(whole, np.diff(np.asarray(lists.offsets)), 0)
        values = lists.flatten().filter(pa.array(np.repeat(whole, np.diff(np.asarray(lists.offsets)))))
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)])), values)

    given = [" " + (t or "") for t in texts]
    a, b = left.lists(given), right.lists([t or "" for t in texts])
    raw = pa.array([g.encode("utf-8", "replace") for g in given], pa.large_binary())
    same = pc.and_(pc.equal(left.joined(a), raw), pc.equal(right.joined(b), raw))
    whole = same.to_numpy(zero_copy_only=False) & np.array([bool(t) for t in texts], bool)
    a, b = nothing_unless(a, whole), nothing_unless(b, whole)
    links = linked(left, right, a, b)
    groups = group_texts(left, right, a, b, links)
    pair = pc.bit_wise_or(pc.shift_left(links.column("id"), B_BITS), links.column("id_b"))
    return {
        "n_a": pc.cast(pc.list_value_length(a), pa.int64()), "n_b": pc.cast(pc.list_value_length(b), pa.int64()),
        "n_links": pa.array(np.bincount(links.column("doc").to_numpy(), minlength=len(texts)).astype(np.int64)),
        "groups": groups,
    } | _by_doc(pa.table({"doc": links.column("doc"), "pair": pair, "n": pa.array(np.ones(len(links), np.int64))}), len(texts))


class Words:
    """The alignment of documents from that of their distinct words: both
    tokenizers' tokens end before each space where ``_CUT`` parts a text, so a
    document's groups and links are its words' in order."""

    def __init__(self, left: Side, right: Side):
        self.left, self.right = left, right
        self.by_word = left.tokenizer.by_word and right.tokenizer.by_word
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.made = aligned_slice(self.left, self.right, [])

    def _learn(self, words: list[list[str]]) -> None:
        new = list(dict.fromkeys(filterfalse(self.number.__contains__, chain.from_iterable(words))))
        if self.number and (len(self.number) + len(new) > KEPT or self.made["groups"].nbytes > KEPT_BYTES):
            self._forget()
            new = list(set().union(*words))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        for start, end in text_groups(new, SLICE):
            more = aligned_slice(self.left, self.right, [w[1:] for w in new[start:end]])
            self.made = {k: pa.concat_arrays([x, more[k]]) for k, x in self.made.items()}

    def aligned(self, texts: list[str | None]) -> dict[str, pa.Array]:
        if not self.by_word:
            return aligned_slice(self.left, self.right, texts)
        words = [_CUT.split(" " + t) if t else [] for t in texts]
        self._learn(words)
        code = np.array(list(map(self.number.__getitem__, chain.from_iterable(words))), np.int64)
        doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
        n = {k: self.made[k].to_numpy() for k in ("n_a", "n_b", "n_links")}
        odd = np.unique(doc[n["n_a"][code] == 0])  # a word without tokens: as whole texts
        if len(odd):
            code, doc = (x[~np.isin(doc, odd)] for x in (code, doc))
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        groups = pa.LargeListArray.from_arrays(pa.array(bounds), pc.take(self.made["groups"], pa.array(code)))
        pairs, times = (pc.take(self.made[k], pa.array(code)) for k in ("pairs", "times"))
        each = pa.table({"doc": pc.take(pa.array(doc), pc.list_parent_indices(pairs)), "pair": pairs.flatten(), "n": times.flatten()})
        out = {k: pa.array(np.bincount(doc, x[code], minlength=len(texts)).astype(np.int64)) for k, x in n.items()}
        out["groups"] = pc.binary_join(groups.cast(pa.list_(pa.large_string())), pa.scalar(";", pa.large_string()))
        out |= _by_doc(each, len(texts))
        if len(odd):
            whole = aligned_slice(self.left, self.right, [texts[i] for i in odd])
            order = np.arange(len(texts))
            order[odd] = len(texts) + np.arange(len(odd))
            out = {k: pc.take(pa.concat_arrays([x, whole[k]]), pa.array(order)) for k, x in out.items()}
        return out


def align(docs: DataFrame, left_path: str, right_path: str, text: str = "text", digest: bool = False) -> DataFrame:
    """``docs`` without ``text``, and with n_a, n_b (tokens of the byte-level
    vocabulary ``left_path`` for a space and the text, and of the sentencepiece
    model ``right_path``), n_links, groups (``a1,a2|b1;a3|b2``; with
    ``digest`` its lowercase-hex SHA-256), pairs and times (the distinct linked
    pairs of ids, left << 32 | right, and how often each is linked).

    A text that is null or empty, or whose tokens on either side don't give
    back its bytes after a space, has no tokens: zeros, empty lists and an empty
    string. Special tokens' strings are plain text. Repeated rows are rows;
    other columns stay but for those of the names above; an empty table gives an empty one. A very
    long text is encoded as one. One map, no shuffle.
    """
    spark = docs.sparkSession
    (left_digest, left_data), (right_digest, right_data) = _shared(spark, left_path), _shared(spark, right_path)
    kept = docs.drop("n_a", "n_b", "n_links", "groups", "pairs", "times")
    others = [c for c in kept.columns if c != text]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = _side(ByteLevel, left_digest, left_data), _side(Pieces, right_digest, right_data)
        words = Words(left, right)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for start, end in text_groups(texts, SLICE):
                made = words.aligned(texts[start:end])
                if digest:
                    made["groups"] = [hashlib.sha256(g.as_buffer()).hexdigest() if g.as_py() else "" for g in made["groups"]]
                made["groups"] = pa.array(made["groups"], pa.string()) if digest else made["groups"].cast(pa.string())
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*[part.column(batch.schema.get_field_index(c)) for c in others], *made.values()],
                                                 names=[*others, *made])

    schema = kept.drop(text).select("*", *[F.lit(0).cast("long").alias(c) for c in ("n_a", "n_b", "n_links")], F.lit("").alias("groups"),
                                    *[F.array().cast("array<long>").alias(c) for c in ("pairs", "times")]).schema
    return kept.mapInArrow(rows, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, right, n, best): how many links of all documents hold each pair,
    and whether no pair of the same id on the right has more."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            flat = pa.table({"pair": batch.column(0).flatten(), "n": batch.column(1).flatten()})
            both = flat if held is None else pa.concat_tables([held, flat])
            held = both.group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])
            if held.num_rows > PAIRS:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    parts = aligned.select("pairs", "times").mapInArrow(partial, "pair long, n long")
    right = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    counts = written(parts.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("right", right), "align-counts")
    highest = counts.groupBy("right").agg(F.max("n").alias("highest"))
    return counts.join(highest, "right").select("pair", "right", "n", (F.col("n") == F.col("highest")).alias("best"))


def corpus_links(aligned: DataFrame) -> DataFrame:
    """``aligned`` (with a unique ``row``) with n_best, its links whose pair's
    count is the highest of its right id's, and count_sum, the counts of its links
    added up.

    The counts are broadcast if they have at most a million rows, else joined by
    pair; a pair with many rows is split by Spark, and partial sums leave a task once for
    each document.
    """
    counts = small_table(written(pair_counts(aligned).select("pair", "n", "best"), "align-best"))
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    sums = each.join(counts, "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    return (aligned.drop("pairs", "times").join(sums, "row", "left")
            .withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the contract."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    rows = written(found.withColumn("row", F.monotonically_increasing_id()), "align-rows")
    return corpus_links(rows).select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum",
                                     F.col("groups").alias("groups_sha256"))
