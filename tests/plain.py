"""Plain statements of the text rules, for comparison in tests."""

import re
from itertools import accumulate


def sentences(text, least):
    """Stripped pieces of at least ``least`` characters. Newlines part a text
    everywhere, other white space where it follows a sentence's end."""
    text, pieces, at = text or "", [], 0
    for space in re.finditer(r"\s+", text):
        ended = space.start() > 0 and text[space.start() - 1] in ".!?"
        cuts = [space.span()] if ended else [(space.start() + m.start(), space.start() + m.end()) for m in re.finditer(r"\n+", space[0])]
        for start, end in cuts:
            pieces.append(text[at:start])
            at = end
    pieces.append(text[at:])
    return [p for p in (piece.strip() for piece in pieces) if len(p) >= least]


def most_repeats(text, least):
    found = sentences(text, least)
    return max((found.count(s) for s in found), default=0)


def last_box(text):
    """The space form up to a dollar sign, else from the last box command to
    the brace that balances its braces."""
    _, command, rest = text.rpartition("\\boxed ")
    if command:
        return command + rest.partition("$")[0]
    opened = list(re.finditer(r"\\boxed", text)) or list(re.finditer(r"\\fbox", text))
    if not opened:
        return None
    start = opened[-1].start()
    braces = list(re.finditer(r"[{}]", text[start:]))
    levels = accumulate(1 if b[0] == "{" else -1 for b in braces)
    return next((text[start:start + b.end()] for b, level in zip(braces, levels) if b[0] == "}" and level == 0), None)
