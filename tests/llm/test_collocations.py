import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from varietas.llm import collocations as C
from varietas.llm.oracle import COLLOCATIONS

SCHEMA = "doc_id long, text string, lang string, key string, n int, word double"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    return n, f


def brute(rows, min_count, top):
    n, f = counts(rows)
    out = []
    for lang in f:
        cand = {p: a for p, a in f[lang].items() if len(p) >= 2 and a >= min_count}
        inside = defaultdict(int)
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], a)
        rows_ = []
        for p, a in cand.items():
            if inside[p] >= a:
                continue
            cuts = [(1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows_.append((-score, -a, " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(seed, docs=160):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["É", "中文", "a\x00b", "Über", "ß"]
    fixed = ["in spite of the", "New York City", "a b a b a b", "once upon a time there"]
    rows = []
    for i in range(docs):
        parts = [r.choice(fixed) if r.random() < 0.3 else " ".join(r.choices(vocab, [1 / (j + 1) for j in range(35)], k=r.randint(1, 6))) for _ in range(r.randint(0, 12))]
        rows.append((i, "".join(p + r.choice([". ", " ", "\t", ", ", "\n", "!?", " \x0b"]) for p in parts), r.choice(["en", "de", None])))
    return rows + [(None, None, "en"), (900, "", None), (901, "...", "xx"), (902, "one", "xx"), (902, "one", "xx")]


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "k", 1, 0.5) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in C.collocations(df, **kw).collect())


@pytest.mark.parametrize("min_count, top, sample", [(5, 2000, 8), (4, 7, 2)])
def test_equals_brute_force(spark, min_count, top, sample):
    rows = corpus(min_count)
    want = brute(rows, min_count, top)
    assert len(want) > 5
    assert mined(spark, rows, min_count=min_count, top=top, sample=sample) == want


def test_an_empty_sample_is_made_good_by_the_expansion_pass(spark):
    rows = corpus(7)
    assert mined(spark, rows, min_count=5, sample=10 ** 9) == brute(rows, 5, 2000)


def test_no_rows(spark):
    assert mined(spark, []) == []


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice(["aa", "b", "cc.", "dddd", "e,f", "  g"]) for _ in range(4000))

    def totals():
        out, words = Counter(), 0
        for rows, b, own in C._texts(pa.array([text, "aa b"])):
            block = C._Block(b, own, np.zeros(len(rows), np.uint64))
            for n, at, hashes, _ in block.phrases(5):
                out.update(hashes.tolist())
                words += len(at) if n == 1 else 0
        return out, words
    whole = totals()
    monkeypatch.setattr(C, "BLOCK", 50)
    assert totals() == whole and whole[1] == len(re.findall(r"[^ .,]+", text)) + 2


def test_scores_past_64_bits_are_exact(spark):
    big = 4 * 10 ** 15
    key = lambda *w: b"".join(x.to_bytes(8, "big") for x in w)
    rows = [("en", b"", None, 9 * 10 ** 18), ("en", key(1), "x", big + 3), ("en", key(2), "y", big + 1), ("en", key(1, 2), None, big)]
    df = spark.createDataFrame([(a, bytearray(b), c, d) for a, b, c, d in rows], "lang string, key binary, word string, n long")
    got = C.score_cuts(df).collect()
    assert [(r.a, r.l, r.r, r.score) for r in got] == [(big, big + 3, big + 1, 1000 * big * 9 * 10 ** 18 // ((big + 3) * (big + 1)))]


def test_filters_hold_their_members(spark):
    hashes = C._first(np.arange(1, 500, dtype=np.uint64), np.full(499, C._lang_hash("en"), np.uint64))
    df = spark.createDataFrame([(int(x),) for x in hashes.view(np.int64)], "hash long")
    f = C.build_filter(df.limit(100), df)
    assert f.test(hashes).all() and f.test(C._extend(hashes, hashes)).mean() < 0.1


def test_oracle_sql_equals_brute_force():
    rows = [r for r in corpus(11, 400)] * 3
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, lang varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    assert sorted(con.execute(COLLOCATIONS).fetchall()) == brute(rows, 100, 2000)
