"""Treebank tokenisation written as DuckDB SQL (RE2 dialect) for the oracle queries.

RE2 has no look-around, so a ``\\b`` next to a letter is emulated by capturing the neighbouring
character (or the text edge) and writing it back; since a captured character cannot start the next
match, each such rule runs twice (a miss is always between two hits, so two passes reach all).
"""

from __future__ import annotations

import re

from varietas.functions import treebank as tb


def lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _re2(p: str) -> str:
    p = p.replace("(?#X)", "")
    return p.replace(r"\s", tb.WS).replace(r"\S", tb.NON_WS).replace(r"\d", r"\p{Nd}")


def _re2_repl(r: str, shift: int = 0) -> str:
    out = []
    i = 0
    while i < len(r):
        ch = r[i]
        if ch == "\\" and i + 1 < len(r):
            if r[i + 1].isdigit():
                out.append("\\" + str(int(r[i + 1]) + shift))
                i += 2
                continue
            m = re.match(r"g<(\d+)>", r[i + 1:])
            if m:
                g = int(m.group(1))
                out.append("\\" + str(g + shift if g else 0))
                i += 1 + m.end()
                continue
            out.append("\\\\")
            i += 1
            continue
        out.append(ch)
        i += 1
    return "".join(out)


def _rule(expr: str, pattern: str, replacement: str) -> str:
    body = _re2(pattern)
    flags = ""
    if body.startswith("(?i)"):
        flags, body = "(?i)", body[4:]
    lead = body.startswith(r"\b")
    trail = body.endswith(r"\b")
    if not (lead or trail):
        return f"regexp_replace({expr}, {lit(flags + body)}, {lit(_re2_repl(replacement))}, 'g')"
    ngroups = body.count("(") - body.count("(?")
    repl = _re2_repl(replacement, shift=1 if lead else 0)
    if lead:
        body = "(^|[^" + tb.PY_WORD[1:-1] + "])" + body[2:]
        repl = "\\1" + repl
    if trail:
        body = body[:-2] + "([^" + tb.PY_WORD[1:-1] + "]|$)"
        repl = repl + "\\" + str(ngroups + (1 if lead else 0) + 1)
    def once(e: str) -> str:
        return f"regexp_replace({e}, {lit(flags + body)}, {lit(repl)}, 'g')"
    return once(once(expr))


def _chain(expr: str, rules) -> str:
    for pattern, replacement in rules:
        expr = _rule(expr, pattern, replacement)
    return expr


def split_whitespace(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {lit(tb.WS + '+')}), lambda x: x <> '')"


def strip_whitespace(expr: str) -> str:
    return f"regexp_replace({expr}, {lit('^' + tb.WS + '+|' + tb.WS + '+$')}, '', 'g')"


def treebank_string(expr: str, convert_parentheses: bool = False) -> str:
    expr = _chain(expr, tb.STARTING_QUOTES)
    expr = _chain(expr, tb.PUNCTUATION)
    expr = _rule(expr, *tb.PARENS_BRACKETS)
    if convert_parentheses:
        expr = _chain(expr, tb.CONVERT_PARENTHESES)
    expr = _rule(expr, *tb.DOUBLE_DASHES)
    expr = f"(' ' || {expr} || ' ')"
    expr = _chain(expr, tb.ENDING_QUOTES)
    for pattern in tb.CONTRACTIONS2 + tb.CONTRACTIONS3:
        expr = _rule(expr, pattern, tb.CONTRACTION_SPLIT)
    return expr


def treebank_tokens(expr: str, convert_parentheses: bool = False) -> str:
    return split_whitespace(treebank_string(expr, convert_parentheses))


def treebank_detokenize(tokens_expr: str, convert_parentheses: bool = False) -> str:
    expr = f"array_to_string({tokens_expr}, ' ')"
    for pattern in tb.DETOK_CONTRACTIONS3 + tb.DETOK_CONTRACTIONS2:
        expr = _rule(expr, pattern, tb.CONTRACTION_JOIN)
    expr = _chain(expr, tb.DETOK_ENDING_QUOTES)
    expr = strip_whitespace(expr)
    expr = _rule(expr, *tb.DETOK_DOUBLE_DASHES)
    if convert_parentheses:
        expr = _chain(expr, tb.DETOK_CONVERT_PARENTHESES)
    expr = _chain(expr, tb.DETOK_PARENS_BRACKETS)
    expr = _chain(expr, tb.DETOK_PUNCTUATION)
    expr = _chain(expr, tb.DETOK_STARTING_QUOTES)
    return strip_whitespace(expr)
