"""License scan: short notices searched with a bounded number of edits.

A notice may differ from its wording in ``edits`` characters (before the
variant's letters, where it ends in such). Cut into
``edits + 1`` pieces, at least one piece is unchanged, so one pass over the
text for all pieces finds every candidate place; the regex library's bounded
error matching then verifies the notice around it and counts its edits.
Everything about a text is in its row, so the scan is a map without a
shuffle, and copies or frequent lines make no hot group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracekit.llm._text import plain_words

# fixed values: phrases and labels of the contract
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# (wording, label, edits): words joined by one blank; what follows a bar must be exact
NOTICES = [
    ("licensed under the gnu general public license", "gpl", 4),
    ("gnu general public license version", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("released under the mit license", "mit", 2),
    ("licensed under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license version 2 0", "mpl", 3),
    ("licensed under cc by| nc", "cc-by-nc", 2),
    ("licensed under cc by| sa", "cc-by-sa", 2),
    ("licensed under cc by| nd", "cc-by-nd", 2),
    ("creative commons attribution noncommercial", "cc-by-nc", 4),
    ("creative commons attribution sharealike", "cc-by-sa", 3),
    ("this is free and unencumbered software released into the public domain", "unlicense", 6),
]

SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "spans array<struct<label:string,first_word:bigint,last_word:bigint,edits:int,text:string>>")


def pieces(wording: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` (offset, piece) cuts of near equal length."""
    ends = [len(wording) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, wording[a:b]) for a, b in zip(ends, ends[1:])]


@lru_cache(4)
def _search(notices: tuple) -> tuple:
    """One automaton for all pieces, and a matcher for each notice."""
    import ahocorasick
    import regex
    found: dict[str, list[tuple[int, int]]] = {}
    for i, (wording, _, edits) in enumerate(notices):
        for offset, piece in pieces(wording.partition("|")[0], edits):
            found.setdefault(piece, []).append((i, offset))
    automaton = ahocorasick.Automaton()
    for piece, places in found.items():
        automaton.add_word(piece, (len(piece), places))
    if found:
        automaton.make_automaton()
    # whole words only, so that an edit can't cut into a neighbour
    heads = [(*w.partition("|")[::2], e) for w, _, e in notices]
    return automaton, [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(head)}){{e<={e}}}{regex.escape(tail)}(?![^ ])") for head, tail, e in heads]


def scan_text(text: str | None, notices: tuple = tuple(NOTICES), base: tuple = tuple(BASE)) -> dict:
    """What one text holds; see ``scan``."""
    words = plain_words(text)
    # one byte a character: offsets are the same and the search stays fast
    line = (b" ".join(words)).decode("latin-1")
    padded = f" {line} "
    blanks = np.flatnonzero(np.frombuffer(padded.encode("latin-1"), np.uint8) == 0x20)
    places, base_labels = [], set()
    for phrase, label in base:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            places.append(int(np.searchsorted(blanks, at)))
            base_labels.add(label)
            at = padded.find(f" {phrase} ", at + 1)
    automaton, matchers = _search(notices)
    spans: dict[tuple[int, int], tuple[int, int]] = {}
    tried: set[tuple[int, int]] = set()
    for end, (length, sources) in automaton.iter(line) if len(automaton) else ():
        for i, offset in sources:
            start = end - length + 1 - offset
            if (i, start) in tried:
                continue
            tried.add((i, start))
            wording, _, edits = notices[i]
            low = max(0, start - edits)
            m = matchers[i].search(line, low, min(len(line), start + len(wording) + edits))
            # the window may cut a word; the whole line decides
            if m and (m.start() == 0 or line[m.start() - 1] == " ") and (m.end() == len(line) or line[m.end()] == " "):
                key = (i, m.start())
                best = (sum(m.fuzzy_counts), m.end())
                spans[key] = min(spans.get(key, best), best)
    out = []
    for (i, start), (edits, end) in sorted(spans.items(), key=lambda x: (x[0][1], x[0][0])):
        body = line[start:end].strip(" ")
        start += len(line[start:end]) - len(line[start:end].lstrip(" "))
        first = int(np.searchsorted(blanks, start + 1, "right")) - 1  # of the padded line
        out.append({"label": notices[i][1], "first_word": first, "last_word": first + body.count(" "), "edits": edits,
                    "text": body.encode("latin-1").decode("utf-8", "replace"), "share": 1 - edits / len(notices[i][0].replace("|", ""))})
    labels = base_labels | {s["label"] for s in out}
    return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)),
            "score": 1.0 if places else max([s.pop("share") for s in out], default=0.0),
            "spans": [{k: v for k, v in s.items() if k != "share"} for s in out]}


def scan(docs: DataFrame, notices: list = NOTICES, base: list = BASE, id_col: str = "doc_id") -> DataFrame:
    """A row per document: the id, n_words, the base phrases' places (n_base,
    first_word, last_word, base_labels), labels of base phrases and notices,
    the score (1 with a base phrase, else 1 less the share of edited
    characters in the best notice, else 0) and the notices' spans.

    Null or empty texts have no words, empty label strings and score 0;
    repeated rows and null ids stay as they are; an empty table gives none;
    other columns are not used. Whole texts are searched, and a place counts
    each time it occurs.
    """
    fixed, phrases = tuple(map(tuple, notices)), tuple(map(tuple, base))
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("text", pa.string())])
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(),
             "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(span)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(text, fixed, phrases) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[k] for x in found], kind) for k, kind in kinds.items()]],
                                             names=[id_col, *kinds])

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(rows, f"{id_col} {key}, {SCHEMA}")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


ORACLE_SQL = None
