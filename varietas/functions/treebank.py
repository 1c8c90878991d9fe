"""Penn-Treebank word tokenisation and detokenisation as Spark column expressions.

Each rule is one ``regexp_replace`` applied to the whole column, so the cascade stays inside
whole-stage code generation and runs on the executors; no Python is involved per row.

The rules are fixed values written in Python ``re`` notation (the notation they are published in).
:func:`java_pattern` states how that notation maps onto Java regular expressions so that Spark
computes what Python's ``re`` computes on every input:

* ``\\s`` / ``\\S``: Python's Unicode whitespace is spelt out as an explicit class (Java's ``\\s`` is
  ASCII only);
* ``\\d``: ``\\p{Nd}`` (Unicode decimal digits, as Python);
* ``\\b``: every ``\\b`` in these rules sits next to a letter, so it becomes a look-behind (at the start)
  or look-ahead (at the end) on Python's word class ``[\\p{L}\\p{N}_]``;
* ``(?i)``: ``(?iu)`` (Unicode case folding, as Python); ``$``: with ``(?d)`` only ``\\n`` ends a line;
* ``(?#X)``: an empty comment Java does not parse, dropped;
* replacements: ``\\1`` and ``\\g<0>`` become ``$1`` / ``$0``; an unknown escape such as ``\\"`` keeps its
  backslash, exactly as Python's ``re.sub`` does.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# The Treebank tokenizer rules, in the order they are applied (Python re notation).
# ---------------------------------------------------------------------------------------------
STARTING_QUOTES = [
    (r'^\"', r'``'),
    (r'(``)', r' \1 '),
    (r"([ (\[{<])(\"|\'{2})", r'\1 `` '),
]
PUNCTUATION = [
    (r'([:,])([^\d])', r' \1 \2'),
    (r'([:,])$', r' \1 '),
    (r'\.\.\.', r' ... '),
    (r'[;@#$%&]', r' \g<0> '),
    (r'([^\.])(\.)([\]\)}>"\']*)\s*$', r'\1 \2\3 '),
    (r'[?!]', r' \g<0> '),
    (r"([^'])' ", r"\1 ' "),
]
PARENS_BRACKETS = (r'[\]\[\(\)\{\}\<\>]', r' \g<0> ')
CONVERT_PARENTHESES = [
    (r'\(', '-LRB-'), (r'\)', '-RRB-'),
    (r'\[', '-LSB-'), (r'\]', '-RSB-'),
    (r'\{', '-LCB-'), (r'\}', '-RCB-'),
]
DOUBLE_DASHES = (r'--', r' -- ')
ENDING_QUOTES = [
    (r'"', " '' "),
    (r'(\S)(\'\')', r'\1 \2 '),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
]
CONTRACTIONS2 = [
    r"(?i)\b(can)(?#X)(not)\b",
    r"(?i)\b(d)(?#X)('ye)\b",
    r"(?i)\b(gim)(?#X)(me)\b",
    r"(?i)\b(gon)(?#X)(na)\b",
    r"(?i)\b(got)(?#X)(ta)\b",
    r"(?i)\b(lem)(?#X)(me)\b",
    r"(?i)\b(mor)(?#X)('n)\b",
    r"(?i)\b(wan)(?#X)(na)\s",
]
CONTRACTIONS3 = [r"(?i) ('t)(?#X)(is)\b", r"(?i) ('t)(?#X)(was)\b"]
CONTRACTION_SPLIT = r' \1 \2 '

# The Treebank detokenizer rules, in the order they are applied.
DETOK_CONTRACTIONS2 = [p.replace('(?#X)', r'\s') for p in CONTRACTIONS2]
DETOK_CONTRACTIONS3 = [p.replace('(?#X)', r'\s') for p in CONTRACTIONS3]
CONTRACTION_JOIN = r'\1\2'
DETOK_ENDING_QUOTES = [
    (r"([^' ])\s('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1\2 "),
    (r"([^' ])\s('[sS]|'[mM]|'[dD]|') ", r"\1\2 "),
    (r'(\S)(\'\')', r'\1\2 '),
    (r" '' ", '"'),
]
DETOK_DOUBLE_DASHES = (r' -- ', r'--')
DETOK_CONVERT_PARENTHESES = [
    ('-LRB-', '('), ('-RRB-', ')'),
    ('-LSB-', '['), ('-RSB-', ']'),
    ('-LCB-', '{'), ('-RCB-', '}'),
]
DETOK_PARENS_BRACKETS = [
    (r'\s([\[\(\{\<])\s', r' \g<1>'),
    (r'\s([\]\)\}\>])\s', r'\g<1> '),
    (r'([\]\)\}\>])\s([:;,.])', r'\1\2'),
]
DETOK_PUNCTUATION = [
    (r"([^'])\s'\s", r"\1' "),
    (r'\s([?!])', r'\g<1>'),
    (r'([^\.])\s(\.)([\]\)}>"\']*)\s*$', r'\1\2\3'),
    (r'\s([#$])\s', r' \g<1>'),
    (r'\s([;%])\s', r'\g<1> '),
    (r'\s([&])\s', r' \g<1> '),
    (r'\s\.\.\.\s', r'...'),
    (r'\s([:,])\s$', r'\1'),
    (r'\s([:,])\s([^\d])', r'\1 \2'),
]
DETOK_STARTING_QUOTES = [
    (r'([ (\[{<])\s``', r'\1"'),
    (r'\s(``)\s', r'\1'),
    (r'^``', r'\"'),
]

# Fixed value: the characters Python's str.split() and Unicode ``\s`` treat as whitespace.
PY_WHITESPACE = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
PY_WORD = r"[\p{L}\p{N}_]"
WS = "[" + PY_WHITESPACE + "]"
NON_WS = "[^" + PY_WHITESPACE + "]"


def java_pattern(p: str) -> str:
    """Python-``re`` rule → equivalent Java pattern (see module docstring)."""
    p = p.replace("(?#X)", "")
    p = p.replace(r"\s", WS).replace(r"\S", NON_WS).replace(r"\d", r"\p{Nd}")
    p = re.sub(r"\\b(?=\()", lambda _: "(?<!" + PY_WORD + ")", p)   # \b before a group opening a word
    p = re.sub(r"\\b$", lambda _: "(?!" + PY_WORD + ")", p)         # \b closing the pattern
    if p.startswith("(?i)"):
        p = "(?iu)" + p[4:]
    return "(?d)" + p


def java_replacement(r: str) -> str:
    """Python ``re.sub`` template → Java replacement string."""
    out = []
    i = 0
    while i < len(r):
        ch = r[i]
        if ch == "\\" and i + 1 < len(r):
            nxt = r[i + 1]
            if nxt.isdigit():
                out.append("$" + nxt)
                i += 2
                continue
            m = re.match(r"g<(\d+)>", r[i + 1:])
            if m:
                out.append("$" + m.group(1))
                i += 1 + m.end()
                continue
            out.append("\\\\")            # unknown escape: Python keeps the backslash
            i += 1
            continue
        if ch == "$":
            out.append("\\$")
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def _sub(col: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(col, java_pattern(pattern), java_replacement(replacement))


def _chain(col: Column, rules) -> Column:
    for pattern, replacement in rules:
        col = _sub(col, pattern, replacement)
    return col


def split_whitespace(col: Column) -> Column:
    """``str.split()`` with no argument: cut on runs of whitespace, no empty tokens."""
    return F.filter(F.split(col, WS + "+"), lambda t: t != F.lit(""))


def strip_whitespace(col: Column) -> Column:
    """``str.strip()``."""
    return F.regexp_replace(col, "^" + WS + "+|" + WS + "+$", "")


# Quote, bracket and contraction rules can only fire on a line that contains a quote character, a
# bracket, or one of the apostrophe-free contraction words (case-insensitively): the other rules
# only insert spaces.  One scan for these decides whether the short chain is enough.
# The contraction words are scanned for by their first letters (only ASCII letters fold to c, g, l, w) and with
# or without the blank that the tokenizer puts in, so that the detokenizer can ask the same.
QUOTES_BRACKETS = "[\"'`\\[\\](){}<>]"
CONTRACTION_WORDS = "[cCgGlLwW](?iu:an" + WS + "?not|im" + WS + "?me|on" + WS + "?na|ot" + WS + "?ta|em" + WS + "?me|an" + WS + "?na)"
NEEDS_FULL_CHAIN = QUOTES_BRACKETS + "|" + CONTRACTION_WORDS

# Plain lines hold nothing but letters, marks, ASCII digits, blanks, periods, commas and characters of no rule, and for
# the tokenizer SET_OFF; neither two periods, dashes or of [:,] in a row nor a contraction word.  Only what is to be set off
# and a last period are left to treat on them.  Frequent characters are listed singly: such a class is one table
# look-up, a class of ranges a test per range.
PLAIN = " .,*+/=_|~0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100))) + r"\-\^\p{L}\p{M}"
SET_OFF = ":;@#$%&?!"


def _is_plain(col: Column, more: str = "") -> Column:
    plain = ~col.rlike("[^" + PLAIN + more + "]")
    for twice in ("..", "--", ",,", "::", ",:", ":,"):
        plain = plain & ~F.contains(col, F.lit(twice))
    return plain & ~col.rlike(CONTRACTION_WORDS.replace(WS, " "))


def _plain_string(col: Column) -> Column:
    """The padded string of a plain line: [:,] is set off unless a digit follows, the others and a last period always."""
    line = F.rtrim(col)
    ends = F.endswith(line, F.lit(".")) & (F.length(line) > 1)
    body = F.when(ends, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(col)
    body = F.regexp_replace(body, "[:,](?![0-9])|[;@#$%&?!]", " $0 ")
    return F.concat(F.lit(" "), body, F.when(ends, F.lit(" . ")).otherwise(F.lit("")), F.lit(" "))


def treebank_string(col: Column, convert_parentheses: bool = False) -> Column:
    """The padded string the tokenizer splits (T1b ``return_str``).

    Plain lines need one replacement.  Other lines without quotes, brackets or contraction words take the short
    chain (punctuation, dashes, padding), which gives the same string as the full cascade on them; ``col`` should be a
    column reference, since it is read by the guards and by the chosen branch.
    """
    return F.when(_is_plain(col, SET_OFF), _plain_string(col)).otherwise(_other_string(col, convert_parentheses))


def _other_string(col: Column, convert_parentheses: bool) -> Column:
    return F.when(col.rlike(NEEDS_FULL_CHAIN), _full_chain(col, convert_parentheses)).otherwise(_short_chain(col))


def _short_chain(col: Column) -> Column:
    col = _chain(col, PUNCTUATION[:-1])      # the last rule needs a quote character
    col = _sub(col, *DOUBLE_DASHES)
    return F.concat(F.lit(" "), col, F.lit(" "))


def _full_chain(col: Column, convert_parentheses: bool) -> Column:
    col = _chain(col, STARTING_QUOTES)
    col = _chain(col, PUNCTUATION)
    col = _sub(col, *PARENS_BRACKETS)
    if convert_parentheses:
        col = _chain(col, CONVERT_PARENTHESES)
    col = _sub(col, *DOUBLE_DASHES)
    col = F.concat(F.lit(" "), col, F.lit(" "))
    col = _chain(col, ENDING_QUOTES)
    for pattern in CONTRACTIONS2 + CONTRACTIONS3:
        col = _sub(col, pattern, CONTRACTION_SPLIT)
    return col


def treebank_tokens(col: Column, convert_parentheses: bool = False) -> Column:
    """Treebank word tokens of a string column, as ``array<string>``."""
    plain = F.array_remove(F.split(_plain_string(col), " "), "")           # blanks are its only whitespace
    return F.when(_is_plain(col, SET_OFF), plain).otherwise(split_whitespace(_other_string(col, convert_parentheses)))


def treebank_detokenize(tokens: Column, convert_parentheses: bool = False) -> Column:
    """Inverse cascade: ``array<string>`` tokens → text.

    As for the tokenizer, plain lines need one replacement, and only lines with quotes, brackets or contraction words the
    full cascade; ``tokens`` should be a column reference.  The -LRB- of a converted bracket is not plain: the rules
    for brackets apply to what it is turned back into.
    """
    col = F.array_join(tokens, " ")
    plain = _is_plain(col)
    full = col.rlike(NEEDS_FULL_CHAIN)
    if convert_parentheses:
        for name, _ in DETOK_CONVERT_PARENTHESES:
            plain = plain & ~F.contains(col, F.lit(name.strip("-")))      # a joined dash may complete the name
            full = full | F.contains(col, F.lit(name.strip("-")))
    return F.when(plain, _plain_detokenized(col)).when(full, _full_detokenized(col, convert_parentheses)).otherwise(_short_detokenized(col))


def _plain_detokenized(col: Column) -> Column:
    line = F.trim(col)
    ends = F.endswith(line, F.lit(" .")) & ~F.endswith(line, F.lit(". .")) & (F.length(line) > 2)
    line = F.when(ends, F.concat(F.substring(line, F.lit(1), F.length(line) - 2), F.lit("."))).otherwise(line)
    return F.trim(F.regexp_replace(line, " (,) ([^0-9])", "$1 $2"))


def _short_detokenized(col: Column) -> Column:
    col = _sub(strip_whitespace(col), *DETOK_DOUBLE_DASHES)
    col = _chain(col, DETOK_PUNCTUATION[1:])      # the first rule needs a quote character
    return strip_whitespace(col)


def _full_detokenized(col: Column, convert_parentheses: bool) -> Column:
    for pattern in DETOK_CONTRACTIONS3 + DETOK_CONTRACTIONS2:
        col = _sub(col, pattern, CONTRACTION_JOIN)
    col = _chain(col, DETOK_ENDING_QUOTES)
    col = strip_whitespace(col)
    col = _sub(col, *DETOK_DOUBLE_DASHES)
    if convert_parentheses:
        col = _chain(col, DETOK_CONVERT_PARENTHESES)
    col = _chain(col, DETOK_PARENS_BRACKETS)
    col = _chain(col, DETOK_PUNCTUATION)
    col = _chain(col, DETOK_STARTING_QUOTES)
    return strip_whitespace(col)
