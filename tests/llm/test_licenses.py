import random
import time

from tests.llm import brute
from tracekit.llm import licenses as L


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def base(text):
    words = brute.plain_words(text)
    places, labels = [], set()
    for phrase, label in L.BASE:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [None, "", "MIT License", "mit-license mit LICENSE; mit licenses", "CC BY cc by-nc 4.0. GNU General\nPublic License", "permit license cc bye",
         "\u00e9mit license", "the Apache License", "apache licence", "word " * 60_000 + "cc by", "Cc-By\u00a0x cc by"]


def test_base_equals_brute_force(docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3]), (2, TEXTS[2])]
    got = sorted(map(repr, ((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in L.scan(docs_of(rows)).collect())))
    assert got == sorted(repr((i, *base(t))) for i, t in rows)


def test_edited_notices_are_found_within_their_edits():
    rng = random.Random(6)
    for wording, label, k in L.NOTICES:
        head, _, tail = wording.partition("|")
        wording = head + tail
        for n in range(k + 1):
            line = list(head)
            for _ in range(n):
                at = rng.randrange(1, len(line) - 1)
                kind = rng.random()
                if kind < 0.4:
                    line[at] = rng.choice("qxz")
                elif kind < 0.7:
                    line.insert(at, "q")
                else:
                    del line[at]
            line = " ".join("".join(line).split()) + tail
            if edits(line, wording) > k:
                continue
            found = L.scan_text("Some text before. " + line.title() + ", and after")
            assert label in found["labels"].split(","), (line, wording)
            assert 0 < found["score"] <= 1
            assert all(s["edits"] == edits(s["text"], w) for s in found["spans"] for w, lab in ((w.replace("|", ""), lab) for w, lab, _ in L.NOTICES)
                       if lab == s["label"] and edits(s["text"], w) <= s["edits"])


def test_spans_hold_their_words():
    found = L.scan_text("x y \u00e9 Licensed under the Apachee Licence, version 2.0 (the")
    (span,) = found["spans"]
    assert (span["label"], span["first_word"], span["last_word"], span["edits"]) == ("apache", 3, 10, 2)
    assert span["text"] == "licensed under the apachee licence version 2 0"
    assert found["base_labels"] == "" and found["labels"] == "apache"


def test_unlicensed_prose_has_no_label():
    for t in ("a license to fish in the open source of the river", "public general gnu license", "by cc", "licensed under cover of night"):
        found = L.scan_text(t)
        assert (found["labels"], found["score"], found["n_base"]) == ("", 0.0, 0)


def test_edits_before_a_variant():
    assert L.scan_text("Licenced under CC BY-NC")["labels"] == "cc-by,cc-by-nc"
    assert L.scan_text("licensed undr CC-BY-SA 4.0")["labels"] == "cc-by,cc-by-sa"
    assert L.scan_text("licensed under cc by nx")["labels"] == "cc-by"


def test_time_grows_with_the_text():
    def seconds(n):
        text = "mit license licenced under cc by nc " * n
        start = time.perf_counter()
        found = L.scan_text(text)
        assert found["n_base"] == 2 * n and len(found["spans"]) >= n
        assert (found["first_word"], found["last_word"]) == (0, 7 * n - 3)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(16_000) < 12 * seconds(4_000)


def test_empty_table(docs_of):
    assert L.scan(docs_of([])).collect() == []
