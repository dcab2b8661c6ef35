"""Final-answer extraction, normalization and comparison as Column builders.

All of it runs as JVM expressions: substring_index for "last occurrence",
one ``aggregate`` fold for balanced braces, and a fixed chain of literal
``replace`` / ``regexp_replace`` calls for normalization.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, is_digits, py_strip

INVALID_ANSWER = "[invalidanswer]"

# ---------------------------------------------------------------------------
# These must equal the published normalization of
# Lewkowycz et al. (2022), appendix D, in this order.
# ---------------------------------------------------------------------------
SUBSTITUTIONS = [
    ("an ", ""),
    ("a ", ""),
    (".$", "$"),
    ("\\$", ""),
    ("\\ ", ""),
    (" ", ""),
    ("mbox", "text"),
    (",\\text{and}", ","),
    ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
]
REMOVED_EXPRESSIONS = [
    "square", "ways", "integers", "dollars", "mph", "inches", "ft", "hours",
    "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits",
    "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges",
    "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}",
    "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}",
    "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]
# (pattern, replacement) in Python notation; ``.`` never matches a newline.
REGEX_REWRITES = [
    (r"(.*?)(\$)(.*?)(\$)(.*)", "$\\3$"),
    (r"(\\text\{)(.*?)(\})", "\\2"),
    (r"(\\textbf\{)(.*?)(\})", "\\2"),
    (r"(\\overline\{)(.*?)(\})", "\\2"),
    (r"(\\boxed\{)(.*)(\})", "\\2"),
    (r"(frac)([^{])(.)", "frac{\\2}{\\3}"),
    (r"(sqrt)([^{])", "sqrt{\\2}"),
]
FINAL_ANSWER_PATTERN = r"Final Answer: The final answer is(.*?). I hope it is correct."
FINAL_ANSWER_END = "I hope it is correct."
# ---------------------------------------------------------------------------

# A literal every match of each rewrite above must contain (same order): the
# regex only runs on strings that contain it, which keeps the lazy ``.*?``
# patterns from scanning texts they cannot match.
REWRITE_GUARDS = ["$", "\\text{", "\\textbf{", "\\overline{", "\\boxed{", "frac", "sqrt"]


def java_replacement(py_repl: str) -> str:
    """Python ``\\N`` group references → Java ``$N``; literal ``$`` escaped."""
    out = []
    i = 0
    while i < len(py_repl):
        c = py_repl[i]
        if c == "\\" and i + 1 < len(py_repl) and py_repl[i + 1].isdigit():
            out.append("$" + py_repl[i + 1])
            i += 2
            continue
        out.append("\\$" if c == "$" else c)
        i += 1
    return "".join(out)


def _brace_end(tail: Column) -> Column:
    """Length of the shortest prefix of ``tail`` whose closing brace brings
    the brace depth back to zero, or null when the braces never balance.

    ``tail`` is cut into pieces that each end in one brace; a single fold
    carries (depth, consumed length, done) across the pieces.
    """
    pieces = F.regexp_extract_all(tail, F.lit(r"[^{}]*[{}]"), 0)
    init = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(False).alias("done"))

    def step(acc, piece):
        opening = F.substring(piece, -1, 1) == F.lit("{")
        depth = acc["depth"] + F.when(opening, 1).otherwise(-1)
        pos = acc["pos"] + F.length(piece)
        closes = (~opening) & (depth == 0)
        return F.when(acc["done"], acc).otherwise(
            F.struct(depth.alias("depth"), pos.alias("pos"), closes.alias("done")))

    folded = F.aggregate(pieces, init, step)
    return F.when(folded["done"], folded["pos"])


def last_boxed(col: Column) -> Column:
    """The last ``\\boxed{...}`` (else ``\\fbox{...}``) with balanced braces.

    If ``"\\boxed "`` (with a space) occurs anywhere, the text after its last
    occurrence up to the next ``$`` wins, re-prefixed. Null when no box is
    found or its braces never close.
    """
    space_form = F.concat(F.lit("\\boxed "),
                          F.substring_index(F.substring_index(col, "\\boxed ", -1), "$", 1))

    def braced(key: str) -> Column:
        tail = F.concat(F.lit(key), F.substring_index(col, key, -1))
        # Common case: the first brace after the key opens and the next one
        # closes; the box is then one anchored match and the fold (which
        # walks every brace to the end of the text) is skipped.
        simple = "^(" + key.replace("\\", "\\\\") + r"[^{}]*\{[^{}]*\})"

        def boxed(t: Column) -> Column:
            return F.when(t.rlike(simple), F.regexp_extract(t, simple, 1)).otherwise(
                bind(_brace_end(t), lambda end: F.when(end.isNotNull(), F.substring(t, F.lit(1), end))))

        return bind(tail, boxed)

    return (F.when(col.contains("\\boxed "), space_form)
            .when(col.contains("\\boxed"), braced("\\boxed"))
            .when(col.contains("\\fbox"), braced("\\fbox")))


def unbox(col: Column) -> Column:
    """Strip ``\\boxed{…}`` or ``\\boxed …``; any other shape gives null.
    (Pass a bound value: the input is referenced several times.)"""
    space = "\\boxed "
    brace = "\\boxed{"
    return (F.when(col.contains(space),
                   F.when(col.startswith(space), F.substring(col, F.lit(len(space) + 1), F.length(col))))
            .when(col.startswith(brace) & col.endswith("}"),
                  F.substring(col, F.lit(len(brace) + 1), F.length(col) - len(brace) - 1)))


def raw_answer(col: Column) -> Column:
    """Unnormalized final answer: boxed content, else the "Final Answer: …"
    sentence, else ``[invalidanswer]``."""
    pattern = "(?d)" + FINAL_ANSWER_PATTERN

    def answer(c: Column) -> Column:
        boxed = bind(last_boxed(c), unbox)
        text = F.concat(F.coalesce(c, F.lit("")), F.lit(FINAL_ANSWER_END))
        # the regex runs only when no usable box was found (coalesce stops early)
        sentence = bind(text, lambda t: F.when(t.rlike(pattern), py_strip(F.regexp_extract(t, pattern, 1))))
        return F.coalesce(boxed, sentence, F.lit(INVALID_ANSWER))

    # the text is computed once even when it is a derived column
    return bind(col, answer)


def _guarded_rewrite(pattern: str, repl: str, needle: str):
    def rewrite(v: Column) -> Column:
        return F.when(v.contains(needle), F.regexp_replace(v, "(?d)" + pattern, java_replacement(repl))
                      ).otherwise(v)
    return rewrite


def normalize_answer(col: Column) -> Column:
    """The fixed normalization chain; null → ""."""
    x = bind(col, lambda v: F.substring_index(F.coalesce(v, F.lit("")), "=", -1))
    for before, after in SUBSTITUTIONS:
        x = F.replace(x, F.lit(before), F.lit(after))
    for expr in REMOVED_EXPRESSIONS:
        x = F.replace(x, F.lit(expr), F.lit(""))
    for (pattern, repl), needle in zip(REGEX_REWRITES, REWRITE_GUARDS):
        x = bind(x, _guarded_rewrite(pattern, repl, needle))
    x = F.replace(x, F.lit("$"), F.lit(""))

    def digits_without_commas(v: Column) -> Column:
        no_commas = F.replace(v, F.lit(","), F.lit(""))
        return F.when(is_digits(no_commas), no_commas).otherwise(v)

    return bind(x, digits_without_commas)


def final_answer(col: Column) -> Column:
    """normalize_answer(raw_answer(text))."""
    return normalize_answer(raw_answer(col))


def gold_answer(solution: Column) -> Column:
    """Gold answer of a worked solution: its last box, unboxed, normalized.
    A solution whose box cannot be unboxed gives "" (reported, not raised)."""
    return normalize_answer(bind(last_boxed(solution), unbox))


_INT = r"^-?[0-9]+$"
_DEC = r"^-?[0-9]*\.[0-9]+$"
_FRAC = r"^(-?)\\[dt]?frac\{(-?[0-9]+)\}\{(-?[0-9]+)\}$"


def _rational(col: Column):
    """(numerator, denominator) as decimal(38,0) when ``col`` is an integer,
    a decimal or ``\\frac{a}{b}``; nulls otherwise."""
    dec = "decimal(38,0)"
    is_int, is_dec, is_frac = col.rlike(_INT), col.rlike(_DEC), col.rlike(_FRAC)
    frac_digits = F.length(F.substring_index(col, ".", -1))
    sign = F.when(F.regexp_extract(col, _FRAC, 1) == "-", -1).otherwise(1)
    num = (F.when(is_int, col.try_cast(dec))
           .when(is_dec, F.replace(col, F.lit("."), F.lit("")).try_cast(dec))
           .when(is_frac, sign * F.regexp_extract(col, _FRAC, 2).try_cast(dec)))
    den = (F.when(is_int, F.lit(1).cast(dec))
           .when(is_dec, F.concat(F.lit("1"), F.repeat(F.lit("0"), frac_digits)).try_cast(dec))
           .when(is_frac, F.regexp_extract(col, _FRAC, 3).try_cast(dec)))
    return num, den


def _canonical(col: Column) -> Column:
    """An integer or decimal with its sign, without leading and trailing
    zeros, so that equal values have equal strings of any length; null for
    everything else."""
    body = F.ltrim(F.regexp_replace(col, "^-", ""), F.lit("0"))
    point = body.contains(".")
    short = F.when(point, F.rtrim(F.rtrim(body, F.lit("0")), F.lit("."))).otherwise(body)
    digits = F.when((short == "") | short.startswith("."), F.concat(F.lit("0"), short)).otherwise(short)
    sign = F.when(col.startswith("-") & (digits != "0"), F.lit("-")).otherwise(F.lit(""))
    return F.when(col.rlike(_INT) | col.rlike(_DEC), F.concat(sign, digits))


def answers_equal(a: Column, b: Column) -> Column:
    """Equality of two normalized answers.

    True when the strings are identical (and not empty / invalid), or when
    both read as rationals (integer, decimal, ``\\frac{int}{int}``) with
    equal value. Integers and decimals of any length compare exactly;
    fractions by cross products, which are null, for unknown, past 38 digits.
    This is NOT symbolic equivalence: ``\\sqrt{4}`` and ``2`` compare unequal
    here.
    """
    def equal(x: Column, y: Column) -> Column:
        same = (x == y) & (x != "") & (x != INVALID_ANSWER)
        nx, dx = _rational(x)
        ny, dy = _rational(y)
        cross = (F.try_multiply(nx, dy) == F.try_multiply(ny, dx)) & (dx != 0) & (dy != 0)
        fractions = (x.rlike(_FRAC) | y.rlike(_FRAC)) & (x.rlike(_FRAC) | _canonical(x).isNotNull()) & (y.rlike(_FRAC) | _canonical(y).isNotNull())
        return (F.when(F.coalesce(same, F.lit(False)), F.lit(True))
                .when(F.coalesce(fractions, F.lit(False)), cross)
                .otherwise(F.coalesce(_canonical(x) == _canonical(y), F.lit(False))))

    return bind(a, lambda x: bind(b, lambda y: equal(x, y)))
