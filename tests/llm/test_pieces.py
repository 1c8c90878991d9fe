import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from varietas.llm import pieces
from varietas.llm.common import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return f.read()


def odd_texts(n):
    r = random.Random(3)
    alphabet = " ▁\n\t\x00aAbetz.,<s></s>é中文😀　​ing the"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_agenda_equals_the_library_on_odd_texts(sp, model):
    texts = odd_texts(5000)
    ids, agrees, decoded = pieces.Encoder(model).encode(texts)
    expected = sp.encode(texts, add_bos=True, add_eos=True)
    assert [np.frombuffer(b, "<u4").tolist() for b in ids] == expected
    assert all(agrees) and decoded == [sp.decode(x) for x in expected]


def test_segments_of_long_texts_change_nothing(model, monkeypatch):
    texts = odd_texts(3000)
    whole = pieces.Encoder(model).encode(texts)
    monkeypatch.setattr(pieces, "SEGMENT", 7)
    assert pieces.Encoder(model).encode(texts) == whole


def test_a_full_memory_changes_nothing(model, monkeypatch):
    texts = odd_texts(300)
    whole = pieces.Encoder(model).encode(texts)
    monkeypatch.setattr(pieces, "CACHE", 3)
    assert pieces.Encoder(model).encode(texts) == whole


def test_merges_take_the_best_pair_first_and_the_leftmost_of_equals(model):
    e = pieces.Encoder(model)
    e.rank = {"ab": (1.0, 0), "bc": (0.5, 1), "aa": (0.7, 2), "a": (9, 3), "b": (9, 4), "c": (9, 5)}
    assert e.merge("abc") == [3, 1] and e.merge("aaa") == [2, 3] and e.merge("ab") == [0]


def test_other_vocabularies_are_refused(model):
    assert pieces.model_type(model) == 2
    with pytest.raises(ValueError):
        pieces.Encoder(b"\x12\x02\x18\x01")


def test_tables_with_nulls_repeats_and_clashing_columns(spark, sp):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "Ünï \n\n x"), (5, "long wörd " * 200_000), (6, "z" * 40_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, n_tokens int")
    got = pieces.encode(df, PATH).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted(key(r) for r in rows)
    by_id = {r.doc_id: r for r in got}
    for doc_id, text in rows:
        want = sp.encode(text or "", add_bos=True, add_eos=True)
        r = by_id[doc_id]
        assert r.agrees and r.n_tokens == len(want) and bytes(r.ids) == np.array(want, "<u4").tobytes() and r.decoded == sp.decode(want)
    assert pieces.encode(df.limit(0), PATH).collect() == []


def test_query_digests(spark, sp):
    from varietas.llm.common import documents
    from varietas.llm.queries import op11_sentencepiece
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in documents(spark, sf).collect()}
    for r in op11_sentencepiece(spark, sf).collect():
        ids = sp.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest() and r.agrees


def test_listed_and_heaped_agendas_leave_the_same_symbols(model):
    e = pieces.Encoder(model)
    r = random.Random(5)
    for chunk in {"".join(r.choice("▁abetinghos.,é") for _ in range(r.randint(1, 40))) for _ in range(3000)}:
        assert e.listed(chunk) == e.heaped(chunk)
