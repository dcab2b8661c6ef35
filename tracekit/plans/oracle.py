"""DuckDB SQL fragments for the correctness oracle.

These write the same semantics in a second engine and dialect (RE2 regex,
DuckDB list lambdas, GROUP BY instead of in-row sorting) so that the Spark
plans are checked against an independent formulation.
"""

from __future__ import annotations

from ..functions.answers import (FINAL_ANSWER_END, FINAL_ANSWER_PATTERN, INVALID_ANSWER,
                                 REGEX_REWRITES, REMOVED_EXPRESSIONS, SUBSTITUTIONS)
from ..functions.chat import ASSISTANT_TAG, IM_END, IM_START, THINK_TAG
from ..functions.text import DIGIT_CLASS, NON_WS_CLASS, WHITESPACE, WS_CLASS


def sq(s: str) -> str:
    """A DuckDB string literal (backslashes are literal, quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"


WS_CHARS = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


_n = [0]


def bind(expr: str, body) -> str:
    """Evaluate ``expr`` once and hand it to ``body`` as a lambda variable."""
    _n[0] += 1
    v = f"_v{_n[0]}"
    return f"(list_transform([{expr}], lambda {v}: {body(v)})[1])"


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


def sentence_list(x: str, min_len: int) -> str:
    """Stripped sentences of at least ``min_len`` chars; RE2 has no
    look-behind, so the punctuation is captured and put back."""
    split = (f"string_split(regexp_replace(coalesce({x}, ''), "
             f"{sq('([.!?])' + WS_CLASS + '+|' + chr(92) + 'n+')}, {sq(chr(92) + '1')} || chr(1), 'g'), chr(1))")
    return (f"list_filter(list_transform({split}, lambda s: {strip('s')}), "
            f"lambda s: length(s) >= {min_len})")


def word_count(x: str) -> str:
    return f"cast(coalesce(len(regexp_extract_all({x}, {sq(NON_WS_CLASS + '+')})), 0) as bigint)"


def nl(s: str) -> str:
    """A literal that may contain newlines, written with chr(10)."""
    parts = s.split("\n")
    return " || chr(10) || ".join(sq(p) for p in parts) if len(parts) > 1 else sq(s)


def start_prompt(problem: str, system: str) -> str:
    return (f"({nl(IM_START + 'system' + chr(10))} || {nl(system)} || "
            f"{nl(IM_END + chr(10) + IM_START + 'user' + chr(10))} || {problem} || "
            f"{nl(IM_END + chr(10) + IM_START + 'assistant' + chr(10) + THINK_TAG + chr(10))})")


def assistant_segment(x: str) -> str:
    tag = nl(ASSISTANT_TAG + "\n")
    last = f"split_part(string_split({x}, {tag})[-1], {sq(IM_END)}, 1)"
    return f"(case when contains({x}, {tag}) then {strip(last)} else {x} end)"


def render(messages: list[tuple[str, str]]) -> str:
    """ChatML of (role, content-sql) pairs."""
    out = []
    for role, content in messages:
        out.append(f"{nl(IM_START + role + chr(10))} || {content} || {nl(IM_END + chr(10))}")
    return "(" + " || ".join(out) + ")"


def question_prompt(x: str) -> str:
    return f"({nl('Problem:' + chr(10))} || {x} || {nl(chr(10) + chr(10) + 'Solution:')})"


def last_boxed(x: str) -> str:
    """Last box with balanced braces, by a list_reduce over brace-ended pieces."""
    def braced(key: str) -> str:
        tail = f"({sq(key)} || string_split({x}, {sq(key)})[-1])"
        fold = (f"list_reduce(regexp_extract_all({tail}, '[^{{}}]*[{{}}]'), "
                f"lambda acc, p: case when acc.done then acc else "
                f"{{'depth': acc.depth + case when right(p, 1) = '{{' then 1 else -1 end, "
                f"'pos': acc.pos + length(p), "
                f"'done': right(p, 1) = '}}' and acc.depth - 1 = 0}} end, "
                f"{{'depth': 0, 'pos': 0, 'done': false}})")
        return bind(tail, lambda t: bind(fold.replace(tail, t),
                                         lambda f: f"case when {f}.done then substr({t}, 1, {f}.pos) end"))
    bs = chr(92)
    space = f"({sq(bs + 'boxed ')} || split_part(string_split({x}, {sq(bs + 'boxed ')})[-1], '$', 1))"
    return (f"(case when contains({x}, {sq(bs + 'boxed ')}) then {space} "
            f"when contains({x}, {sq(bs + 'boxed')}) then {braced(bs + 'boxed')} "
            f"when contains({x}, {sq(bs + 'fbox')}) then {braced(bs + 'fbox')} end)")


def unbox(x: str) -> str:
    bs = chr(92)
    return (f"(case when contains({x}, {sq(bs + 'boxed ')}) then "
            f"(case when starts_with({x}, {sq(bs + 'boxed ')}) then substr({x}, 8) end) "
            f"when starts_with({x}, {sq(bs + 'boxed{')}) and ends_with({x}, '}}') "
            f"then substr({x}, 8, length({x}) - 8) end)")


def raw_answer(x: str) -> str:
    text = f"(coalesce({x}, '') || {sq(FINAL_ANSWER_END)})"
    sentence = (f"(case when regexp_matches({text}, {sq(FINAL_ANSWER_PATTERN)}) then "
                f"{strip(f'regexp_extract({text}, {sq(FINAL_ANSWER_PATTERN)}, 1)')} end)")
    return f"coalesce({bind(last_boxed(x), unbox)}, {sentence}, {sq(INVALID_ANSWER)})"


def normalize(x: str) -> str:
    e = f"string_split(coalesce({x}, ''), '=')[-1]"
    for before, after in SUBSTITUTIONS:
        e = f"replace({e}, {sq(before)}, {sq(after)})"
    for expr in REMOVED_EXPRESSIONS:
        e = f"replace({e}, {sq(expr)}, '')"
    for pattern, repl in REGEX_REWRITES:
        e = f"regexp_replace({e}, {sq(pattern)}, {sq(repl)}, 'g')"
    e = f"replace({e}, '$', '')"
    return bind(e, lambda v: f"case when regexp_full_match(replace({v}, ',', ''), {sq(DIGIT_CLASS + '+')}) "
                             f"then replace({v}, ',', '') else {v} end")
