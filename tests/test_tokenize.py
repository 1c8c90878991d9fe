import json
import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from varietas.functions import split_whitespace, treebank_detokenize, treebank_string, treebank_tokens
from varietas.functions import treebank as TB
from varietas.oracle import duck

# Documented examples.
GOLDEN = [
    ("They'll save and invest more.", ["They", "'ll", "save", "and", "invest", "more", "."]),
    ("hi, my name can't hello,", ["hi", ",", "my", "name", "ca", "n't", "hello", ","]),
    ("Good muffins cost $3.88\nin New York.  Please buy me\ntwo of them.\nThanks.",
     ["Good", "muffins", "cost", "$", "3.88", "in", "New", "York.", "Please", "buy", "me", "two", "of",
      "them.", "Thanks", "."]),
]

# Texts with their tokens, token lists with their texts, written out.
WRITTEN = json.loads((Path(__file__).parent / "golden_tokens.json").read_text())
TOKENS, TEXTS = WRITTEN["tokens"], WRITTEN["detokenized"]


def _spark_tokens(spark, texts, convert=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("i", treebank_tokens(F.col("text"), convert).alias("t")).collect()
    return [r.t for r in sorted(rows)]


def test_golden(spark):
    got = _spark_tokens(spark, [g[0] for g in GOLDEN])
    assert got == [g[1] for g in GOLDEN]


def test_written_cases(spark):
    got = _spark_tokens(spark, [t for t, _ in TOKENS])
    assert got == [x for _, x in TOKENS]


def test_convert_parentheses(spark):
    s = "Good muffins cost $3.88\nin New (York).  Please (buy) me\ntwo of them.\n(Thanks)."
    expected = ['Good', 'muffins', 'cost', '$', '3.88', 'in', 'New', '-LRB-', 'York', '-RRB-', '.',
                'Please', '-LRB-', 'buy', '-RRB-', 'me', 'two', 'of', 'them.', '-LRB-', 'Thanks', '-RRB-', '.']
    assert _spark_tokens(spark, [s], convert=True) == [expected]


def test_duckdb_oracle_tokenizer_matches_python():
    con = duckdb.connect()
    for t, want in [*TOKENS, *GOLDEN]:
        got = con.execute(f"select {duck.treebank_tokens(duck.lit(t))}").fetchall()[0][0]
        assert got == want, t


DETOK = [
    (['hello', ',', 'i', 'ca', "n't", 'feel', 'my', 'feet', '!', 'Help', '!', '!'],
     "hello, i can't feel my feet! Help!!"),
    (['hello', ',', 'i', "can't", 'feel', ';', 'my', 'feet', '!', 'Help', '!', '!', 'He', 'said', ':',
      'Help', ',', 'help', '?', '!'], "hello, i can't feel; my feet! Help!! He said: Help, help?!"),
]


def test_detokenize_golden_and_python(spark):
    cases = [c for c, _ in TEXTS]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, toks array<string>")
    got = [r.s for r in sorted(df.select("i", treebank_detokenize(F.col("toks")).alias("s")).collect())]
    assert got[:2] == [d[1] for d in DETOK]
    assert got == [t for _, t in TEXTS]
    con = duckdb.connect()
    for c, want in TEXTS:
        arr = "[" + ", ".join(duck.lit(x) for x in c) + "]::varchar[]"
        assert con.execute(f"select {duck.treebank_detokenize(arr)}").fetchall()[0][0] == want


def test_detokenize_round_trip_parentheses(spark):
    s = "Good muffins cost $3.88\nin New (York).  Please (buy) me\ntwo of them.\n(Thanks)."
    df = spark.createDataFrame([(s,)], "text string")
    out = df.select(treebank_detokenize(treebank_tokens(F.col("text"), True), True).alias("d")).first().d
    assert out == "Good muffins cost $3.88 in New (York). Please (buy) me two of them. (Thanks)."


@pytest.mark.parametrize("text", ["a b", " a\tb\x1cc\x85d ", "", "x　y"])
def test_whitespace_split(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(split_whitespace(F.col("text")).alias("t")).first().t == text.split()


def _python_chain(text, rules):
    for pattern, replacement in rules:
        text = re.sub(pattern.replace("(?#X)", ""), replacement, text)
    return text


def _python_string(text):
    text = _python_chain(text, [*TB.STARTING_QUOTES, *TB.PUNCTUATION, TB.PARENS_BRACKETS, TB.DOUBLE_DASHES])
    return _python_chain(f" {text} ", [*TB.ENDING_QUOTES, *[(p, TB.CONTRACTION_SPLIT) for p in TB.CONTRACTIONS2 + TB.CONTRACTIONS3]])


def _python_detokenized(tokens, convert):
    text = _python_chain(" ".join(tokens), [(p, TB.CONTRACTION_JOIN) for p in TB.DETOK_CONTRACTIONS3 + TB.DETOK_CONTRACTIONS2])
    text = _python_chain(_python_chain(text, TB.DETOK_ENDING_QUOTES).strip(), [TB.DETOK_DOUBLE_DASHES])
    if convert:
        text = _python_chain(text, TB.DETOK_CONVERT_PARENTHESES)
    rules = [*TB.DETOK_PARENS_BRACKETS, *TB.DETOK_PUNCTUATION, *[(p, r.replace('\\"', '\\\\"')) for p, r in TB.DETOK_STARTING_QUOTES]]
    return _python_chain(text, rules).strip()


def _random_lines(n, seed):
    draw = random.Random(seed)
    few = ["a", "b", "The", "x1", "7", " ", " ", " ", ",", ".", "-", "can", "not", "Wan", "na", "3,000", "U.S.", "\u00e9t\u00e9", "\u0130"]
    marks = [*few, *":;@#$%&?!"]
    more = [*few, "..", ",,", "--", "?", "!", ":", ";", "%", "$", "'", "''", "``", '"', "(", ")", "[", "cannot", "GIMME ", "g\u0131mme ", "n't ", "'s ",
            "-LRB-", "LRB", "\n", "\t", "\xa0", "\u0663", "\u00e9", "\u2028", "*", "^", "|", "&"]
    return ["".join(draw.choice(words) for _ in range(draw.randint(0, 14))) for words in (few, marks, more) for _ in range(n)]


def test_all_chains_equal_python(spark):
    lines = [*_random_lines(4000, 5), ".", " .", "a,.", "a .", "a, . ", ",", "a,", "a.  ", "a. .", "a , , b .", "-LRB -- y", "a,:b", "a?.", "a.?", "a;.", ":", "7:8,\u0663"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, text string").select("i", "text", F.split("text", " ").alias("parts"))
    out = df.select("i", treebank_string(F.col("text")).alias("s"), treebank_tokens(F.col("text")).alias("t"),
                    *[treebank_detokenize(F.col("parts"), c).alias(f"d{c:d}") for c in (False, True)])
    for r in out.collect():
        want = _python_string(lines[r.i])
        assert (r.s, r.t) == (want, want.split()), repr(lines[r.i])
        assert [r.d0, r.d1] == [_python_detokenized(lines[r.i].split(" "), c) for c in (False, True)], repr(lines[r.i])


def test_plain_lines_take_neither_chain(spark, monkeypatch):
    for name in ("_full_chain", "_short_chain", "_full_detokenized", "_short_detokenized"):
        monkeypatch.setattr(TB, name, lambda *a: F.raise_error(F.lit("a plain line went through the chain of rules")).cast("string"))
    df = spark.createDataFrame([("On 3,000 jours, l\u00e0 it rained - and more.",)], "text string").select(treebank_tokens(F.col("text")).alias("t"))
    got = df.select("t", treebank_detokenize(F.col("t")).alias("d")).first()
    assert got.t == ["On", "3,000", "jours", ",", "l\u00e0", "it", "rained", "-", "and", "more", "."] and got.d == "On 3,000 jours, l\u00e0 it rained - and more."
