import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varietas.llm import decontaminate, language, mixing, near_dedup, personal_data, quality, rules, sharding, token_files, toxicity
from varietas.llm.common import benchmark, documents, labels, scratch_path, tokenizer_path
from varietas.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty and one-word texts, a long text, repeated rows, odd white space.
EDGE_ROWS = [
    (1, None, "en", "a", None), (2, "", "en", None, 0), (3, "word", None, "a", 4), (4, " \t\n\x0b\x0c\r ", None, None, 7),
    (5, "Ünïcode — 中文 ñ 😀 +1 (017) 555-7713", "de", "b", 30), (6, "same text of five words here", "en", "a", 28),
    (6, "same text of five words here", "en", "a", 28), (7, "long " * 3000, "en", "b", 15000), (None, "no id at all here", "en", "a", 17),
]


@pytest.fixture()
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, SCHEMA).withColumns({"size": F.lit("x"), "block": F.lit(1), "h": F.lit(2.0), "prefix": F.lit(None).cast("string")})


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SF)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]


def shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_groups(pairs):
    """doc_id -> smallest linked id, by comparing every two documents."""
    ids = sorted(pairs)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(pairs[i] & pairs[j])
            if pairs[i] and pairs[j] and 100 * common >= 75 * (len(pairs[i]) + len(pairs[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(docs, rows):
    sets = {i: shingles(t) for i, t in rows}
    want = brute_groups(sets)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_duplicates_of_a_chain_of_variants(spark):
    """Copies edited further and further: neighbours link, the ends do not; all make one group."""
    rng = np.random.default_rng(1)
    words, variants = [f"w{i}" for i in rng.integers(0, 10_000, 120)], []
    for n in range(40):
        words = list(words)
        words[int(rng.integers(120))] = f"edit{n}"
        variants.append((n, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(variants, "doc_id long, text string")).collect()}
    assert got == brute_groups({i: shingles(t) for i, t in variants})


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    b = np.concatenate((a[:300], rng.integers(0, 1 << 62, 100).astype(np.uint64)))
    s = near_dedup.superminhash(np.repeat([0, 1], 400), np.concatenate((a, b)), 2)
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.15
    assert all(sorted(np.floor(row)) == sorted(np.floor(row)) and np.isfinite(row).all() for row in s)


@pytest.mark.parametrize("one_task", [0, 500_000])
def test_components(spark, one_task):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 100)] + [(500, 500 + k) for k in range(1, 40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), one_task).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100, 102: 100, 200: 100, **{500 + k: 500 for k in range(1, 40)}}


def brute_counts(t):
    w = WORD.findall(t or "")
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {p for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside)


def test_rules_base_counts(docs, rows, edge):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r.doc_id: tuple(r[c] for c in names) for r in rules.judge(docs).collect()}
    assert got == {i: brute_counts(t) for i, t in rows}
    got = sorted(str((r.doc_id, *(r[c] for c in names))) for r in rules.judge(edge).collect())
    assert got == sorted(str((i, *brute_counts(t))) for i, t, *_ in EDGE_ROWS)


def test_rules_reject_outliers_and_keep_clean(spark):
    rng = np.random.default_rng(3)
    clean = [(i, " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(120)), "en", "a", 0) for i in range(80)]
    junk = [(100 + i, t.replace(" ", "%%% "), "en", "a", 0) for i, (_, t, *_) in enumerate(clean[:5])]
    got = {r.doc_id: r.kept for r in rules.judge(spark.createDataFrame(clean + junk, SCHEMA)).collect()}
    assert all(got[i] for i in range(80)) and not any(got[100 + i] for i in range(5))


def test_rules_reject_repeated_lines_alone_and_repeated_windows_alone(spark):
    rng = np.random.default_rng(4)
    words = lambda n: ["".join(rng.choice(list("abcdefgh"), 5)) + str(i % 10) for i in range(n)]
    text = lambda w: "\n".join(" ".join(w[i:i + 2]) for i in range(0, len(w), 2))
    rows = [(i, text(words(120)), "en", "a", 0) for i in range(80)]
    for i in range(3):
        w, passage = words(120), words(24)
        for k in range(0, 120, 4):
            w[k:k + 2] = ["repeated", "line"]
        rows.append((100 + i, text(w), "en", "a", 0))
        rows.append((200 + i, text(passage + words(37) + passage + words(35)), "en", "a", 0))
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all((r.n_dup_lines > 0) == (100 <= i < 200) and (r.n_repeat_words > 0) == (i >= 200) and not r.base_failed for i, r in got.items())
    assert all(r.kept == (i < 100) for i, r in got.items())


def test_rules_keep_a_text_with_one_repeated_line(spark):
    rng = np.random.default_rng(5)
    words = lambda n: ["".join(rng.choice(list("abcdefgh"), 5)) + str(i % 10) for i in range(n)]
    text = lambda w: "\n".join(" ".join(w[i:i + 9]) for i in range(0, len(w), 9))
    rows = [(i, text(words(300)), "en", "a", 0) for i in range(80)]
    for i in range(5):
        w = words(300)
        w[90:99] = w[9:18]
        rows.append((100 + i, text(w), "en", "a", 0))
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[100 + i].n_dup_lines == 1 and got[100 + i].n_repeat_words == 18 and got[100 + i].kept for i in range(5))


def test_rules_leave_user_columns_alone(spark):
    text = " ".join(f"word{i} plain" for i in range(60))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2", "x0", "g0", "c00", "n", "cell", "rows"]
    df = spark.createDataFrame([(i, text + f" t{i}", "en", "a", 0) for i in range(3)], SCHEMA).withColumns({c: F.lit("mine") for c in names})
    kept = rules.keep_good(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))
    assert all(r.n_words == 121 for r in rules.judge(df).collect())


def brute_rules(rows):
    """doc_id -> (squared distance, kept) by numpy, all groups stepping together."""
    stats, groups, failed = {}, {}, set()
    for doc, text, lang, source, *_ in rows:
        n, chars, symbols, dup, rep = brute_counts(text)
        lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        capitals = sum("A" <= c <= "Z" for c in text or "")
        stats[doc] = np.array([np.log(max(chars, 1) / max(n, 1)), np.log1p(100 * symbols / max(n, 1)),
                               np.log1p(rules.SCALE * max(dup / max(lines, 1) * 100 / rules.TOLERATED[0], rep / max(n, 1) * 100 / rules.TOLERATED[1])),
                               np.log1p(100 * capitals / max(chars, 1))])
        if n < 50 or 100 * rep > 50 * n:
            failed.add(doc)
        groups.setdefault((lang, source), []).append(doc)
    floors = np.diag(np.square(rules.FLOORS))
    cut = lambda cells, share: sorted(cells)[int(np.ceil(share * len(cells) - 1e-9)) - 1]
    d2_of = lambda x, m, c: np.einsum("ij,ij->i", x - m, np.linalg.solve(c + floors, (x - m).T).T)

    def fit_all(sets):
        est = []
        for x in sets:
            cells = np.floor(x / 0.01)
            med = np.array([cut(cells[:, i], 0.5) for i in range(4)])
            mad = np.array([cut(abs(cells[:, i] - med[i]), 0.5) for i in range(4)])
            est.append(((med + 0.5) * 0.01, np.diag((1.4826 * mad * 0.01) ** 2)))
        for step in range(rules.MAX_STEPS):
            new = []
            for x, (m, c) in zip(sets, est):
                cells = np.floor(np.log(np.maximum(d2_of(x, m, c), 1e-9)) * rules.CELLS)
                near = x[cells <= cut(cells, rules.H)]
                new.append((near.mean(0), rules.CONSISTENCY * np.cov(near.T, bias=True)))
            fall = max(np.linalg.slogdet(a[1] + floors)[1] - np.linalg.slogdet(b[1] + floors)[1] for a, b in zip(est, new))
            est = new
            if step and fall <= rules.SETTLED:
                break
        return est
    good = {g: [d for d in ids if d not in failed] for g, ids in groups.items()}
    (mp, cp), = fit_all([np.array([stats[d] for ids in good.values() for d in ids])])
    own = dict(zip([g for g in good if good[g]], fit_all([np.array([stats[d] for d in ids]) for ids in good.values() if ids])))
    out = {}
    for g, ids in groups.items():
        w = len(good[g]) / (len(good[g]) + rules.BLEND)
        m, c = own.get(g, (mp, cp))
        mean, cov = w * m + (1 - w) * mp, w * c + (1 - w) * cp + w * (1 - w) * np.outer(m - mp, m - mp)
        for d in ids:
            d2 = d2_of(stats[d][None, :], mean, cov)[0]
            out[d] = (d2, d not in failed and d2 <= rules.CUTOFF)
    return out


def test_rules_equal_numpy_determinant_search(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = brute_rules(rows)
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert all(abs(got[d].distance2 - d2) <= 1e-3 * (1 + d2) for d, (d2, _) in want.items())
    assert all(got[d].kept == kept for d, (d2, kept) in want.items() if abs(d2 - rules.CUTOFF) > 1e-2)


def test_myers_and_matches_against_edit_distance():
    def distance(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)
    rng = np.random.default_rng(5)
    for _ in range(60):
        item = "".join(rng.choice(list("ab cde"), 60)).strip()
        text = "".join(rng.choice(list("ab cde"), 50))
        edited = list(item)
        for _ in range(int(rng.integers(0, 10))):
            edited[int(rng.integers(len(edited)))] = str(rng.choice(list("xyz")))
        text = text + "".join(edited) + text
        masks = {}
        for bit, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << bit
        d = distance(item, text)
        assert decontaminate.myers(item, masks, text)[0] == d
        found = decontaminate.Matcher([(1, item)]).find(text)
        assert bool(found) == (d <= decontaminate.budget(item))
        if found:
            assert found[0][1] >= d and found[0][1] <= decontaminate.budget(item)


def test_decontamination_edges(spark, docs, edge, empty):
    bench = benchmark(spark, SF)
    hit = {r.doc_id for r in decontaminate.matches(docs, bench).collect()}
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert hit and kept.isdisjoint(hit) and len(kept) + len(hit) == docs.count()
    items = spark.createDataFrame([(1, None), (2, ""), (3, "Same TEXT, of five words")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.matches(edge, items).collect()] == [(6, 3)] * 2
    assert decontaminate.drop_contaminated(edge, items).count() == len(EDGE_ROWS) - 2
    assert decontaminate.matches(empty, items).count() == 0 and decontaminate.drop_contaminated(edge, items.limit(0)).count() == len(EDGE_ROWS)


def test_token_files_round_trip(spark, docs, edge):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for table in (docs, edge):
        path = scratch_path(spark, "test-tokens")
        token_files.write_tokens(table, path, tokenizer_path("word_bpe_49k.json"), 3, 20_000)
        got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.token_index(spark.read.parquet(path)).collect())
        texts = sorted(((r.doc_id, r.text) for r in table.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
        start, want = 0, []
        for i, t in texts:
            ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
            want.append((start, i, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert got == want


def test_short_items_have_the_same_share_of_edits(spark):
    item = "seven quick brown foxes jumped over it"                       # 38 characters: 3 edits
    texts = ["so seven quikc brown foxes jumped over it all", "so seven quick brown foxes jumped over it", "some quick brown dogs jumped over that",
             "xseven quick brown foxes jumped over itx", "a tiny catalogue", "a tiny cat log", "a tiny cat", "at in cat"]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame([(1, item), (2, "Tiny  cat!"), (3, "tiny cat"), (4, item.upper()), (5, "--"), (6, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(docs, bench).collect()}
    assert got == {(0, 1): 2, (1, 1): 0, (3, 1): 2, (5, 2): 0, (6, 2): 0}


def test_re_pair_goes_on_until_no_pair_pays():
    rng = np.random.default_rng(6)
    passage = rng.integers(0, 60, 3000)
    ids = np.concatenate([np.concatenate((passage, rng.integers(0, 60, 5), [2])) for _ in range(40)] + [np.full(900, 7), [2]])
    ends = np.cumsum([3006] * 40 + [901])
    rules_, seq, new_ends = token_files.re_pair(ids, ends, 100)
    assert (token_files.expand_all(seq, rules_, 100) == ids).all() and (token_files.expand(seq, rules_, 100) == ids).all()
    assert token_files.expansion_lengths(rules_, 100).max() > 1000 and len(seq) < 1500      # a copy is a few symbols
    inside = np.ones(len(seq), bool)
    inside[new_ends - 1] = False
    left = Counter(zip(seq[:-1][inside[:-1]].tolist(), seq[1:][inside[:-1]].tolist()))
    assert all(n < token_files.MIN_PAIR for (a, b), n in left.items() if a != b)


def test_re_pair_random_access():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 6, 4000)
    ids[1000:1400] = 3
    ends = np.array([1, 500, 1200, 4000])
    rules_, seq, new_ends = token_files.re_pair(ids, ends, 100)
    assert len(rules_) and len(seq) < len(ids)
    assert (token_files.expand(seq, rules_, 100) == ids).all()
    length = token_files.expansion_lengths(rules_, 100)
    for a, b in ((0, 1), (7, 900), (1199, 1201), (3990, 4000), (0, 4000)):
        assert (token_files.decode_slice(seq, rules_, length, 100, a, b) == ids[a:b]).all()
    for k in range(1, 4):
        assert (token_files.expand(seq[new_ends[k - 1]:new_ends[k]], rules_, 100) == ids[ends[k - 1]:ends[k]]).all()


def test_mix_hits_targets_and_caps(docs, edge, empty):
    out, targets = mixing.assign_copies(docs)
    rows = out.select("source", "__mix_size", F.size("__mix_copies").alias("n"), "__mix_copies").collect()
    sizes = {r.source: (r.source_size, r.target) for r in targets.collect()}
    total = sum(s for s, _ in sizes.values())
    # water filling by iteration
    names = sorted(sizes)
    weight, want, open_ = {s: n % 3 + 1 for n, s in enumerate(names)}, dict.fromkeys(names, 0.0), set(names)
    left = float(total)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s][0]}
        if not full:
            want |= share
            break
        for s in full:
            want[s] = 3.0 * sizes[s][0]
            left -= want[s]
        open_ -= full
    for s in names:
        assert abs(sizes[s][1] - want[s]) < 1e-6 * max(want[s], 1)
        taken = sum(r["__mix_size"] * r.n for r in rows if r.source == s)
        largest = max(r["__mix_size"] for r in rows if r.source == s)
        assert abs(taken - want[s]) <= largest / 2 + 1
    assert max(r.n for r in rows) <= 3
    shards = Counter(c.shard for r in rows for c in r["__mix_copies"])
    assert set(shards) <= set(range(mixing.SHARDS))
    again, _ = mixing.assign_copies(docs)
    assert sorted(map(str, again.select("doc_id", "__mix_copies").collect())) == sorted(map(str, out.select("doc_id", "__mix_copies").collect()))
    assert mixing.mix(edge).columns == edge.columns and mixing.mix(empty).count() == 0


def test_hypergeometric_draw_matches_its_law(spark):
    from math import comb
    n, good, total = 7, 9, 20
    us = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    got = Counter(r.x for r in us.select(F.expr(mixing.hypergeometric(str(n), str(good), str(total), "u")).alias("x")).collect())
    for k in range(8):
        p = comb(good, k) * comb(total - good, n - k) / comb(total, n)
        assert abs(got[k] / 4000 - p) < 0.001


def test_splitting_tree_keeps_quotas(spark):
    q = {"a": 37, "b": 5, "c": 200, None: 11}
    leaves = mixing.splitting_tree(spark.createDataFrame([(s, n) for s, n in q.items()], "source string, quota long"), 7).collect()
    per_source, per_shard = Counter(), Counter()
    for r in leaves:
        per_source[r.source_key] += r["count"]
        per_shard[r.shard] += r["count"]
    assert per_source == {"sa": 37, "sb": 5, "sc": 200, "null": 11}
    assert max(per_shard.values()) - min(per_shard.values()) <= 1 and len(per_shard) == 7


def test_shards_fit_their_limit_and_split_only_when_needed(docs, edge, empty):
    limit = 60_000
    rows = sharding.assign_shards(docs, limit).collect()
    size = Counter()
    for r in rows:
        size[r.shard] += len(r.text.encode())
        assert r.doc_bytes == len(r.text.encode())
    assert len(rows) == docs.count() and all(size[r.shard] == r.shard_bytes for r in rows)
    single = Counter(r.shard for r in rows)
    assert all(b <= limit or single[s] == 1 for s, b in size.items())
    # the parent of a shard, with its sibling's documents, would not fit
    h = {r.doc_id: r.h for r in docs.select("doc_id", sharding.hash_bits(F.col("doc_id")).alias("h")).collect()}
    for r in rows[:20]:
        if r.shard_depth:
            cut = 60 - (r.shard_depth - 1)
            assert sum(x.doc_bytes for x in rows if h[x.doc_id] >> cut == h[r.doc_id] >> cut) > limit
    paged = sharding.assign_shards(edge, 30).collect()
    assert len(paged) == len(EDGE_ROWS) and len({r.shard for r in paged if r.doc_id == 6}) == 2
    assert sharding.assign_shards(empty).count() == 0


def test_personal_data_base_spans_against_the_patterns():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    valid = {"email": lambda s, d: True, "ip": lambda s, d: all(int(p) <= 255 for p in s.split(".")),
             "card": lambda s, d: 13 <= len(d) <= 19 and personal_data.luhn(d), "phone": lambda s, d: 9 <= len(d) <= 15}
    rng = np.random.default_rng(4)
    letters = list("0123456789.@+- ()ab%é\n")
    for n in range(4000):
        t = "".join(rng.choice(letters, n % 60))
        want = [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, t) if valid[k](m.group(), re.sub("[^0-9]", "", m.group()))]
        assert personal_data.base_spans(t) == want


def test_tagger_gradient_and_added_spans():
    from varietas.llm.crf_lstm import Tagger
    rng = np.random.default_rng(0)
    t = Tagger(5, 3, 4, 3)
    t.p = {k: a.astype(np.float64) for k, a in t.p.items()}
    x, y = rng.integers(0, 5, (3, 7)), rng.integers(0, 3, (3, 7))
    x[1, 5:] = -1
    _, g = t.gradients(x, y)
    for k, a in t.p.items():
        at = tuple(rng.integers(0, s) for s in a.shape)
        old = a[at]
        a[at] = old + 1e-3
        up = t.gradients(x, y)[0]
        a[at] = old - 1e-3
        down = t.gradients(x, y)[0]
        a[at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-3
    names = ["ana", "bob.w", "c_d", "eve99"]
    texts = [f"{'lorem ipsum ' * int(rng.integers(1, 4))}call +1 ({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)} or {names[i % 4]}@mail{i % 9}.example.com now {i}" for i in range(300)]
    model = personal_data.train(texts, 150)
    base, spans = personal_data.find_spans(["please call (212) 555-1234 today or +1 (212) 555-1234"], model)[0]
    assert base == [("phone", 36, 53)] and base[0] in spans


def test_long_spaced_emails_are_found_whole_at_every_offset():
    rng = np.random.default_rng(7)
    word = lambda n=8: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(3, n))))
    texts = []
    for _ in range(300):
        email = ".".join(word() for _ in range(rng.integers(1, 4))) + "@" + "-".join(word() for _ in range(rng.integers(1, 5))) + f".{word()}.org"
        texts.append(" ".join([*[word() for _ in range(12)], email, *[word() for _ in range(12)], str(rng.integers(1, 3000)), word()]))
    model = personal_data.train(texts)
    for email in ("maria.gonzalez @ informatik.uni-heidelberg.de", "info @ mail.computer-science.example.org",
                  "maria.del.carmen.gonzalez.fernandez.y.rodriguez @ informatik.uni-heidelberg.de"):
        filler = " ".join(word() for _ in range(60))
        cases = [(filler[:k] + " " + email + " " + filler[k:], k + 1) for k in range(0, 130)]
        for (_, spans), (_, at) in zip(personal_data.find_spans([t for t, _ in cases], model), cases, strict=True):
            assert spans == [("email", at, at + len(email))]


def test_training_windows_come_from_every_text():
    rng = np.random.default_rng(8)
    heavy = [" ".join(str(x) for x in rng.integers(0, 999, 25_000)) for _ in range(2)]
    assert all(not personal_data.base_spans(t) for t in heavy)
    x, y = personal_data.training_windows([*heavy, *[f"write to ana{i}@mail.example.com today" for i in range(20)]])
    assert len(x) <= personal_data.MAX_WINDOWS and (y > 0).any(axis=1).sum() >= 20 and not (y > 0).any(axis=1).all()


def test_personal_data_edges(edge, empty):
    got = {(r.doc_id, r.n_phone) for r in personal_data.find_personal_data(edge).collect()}
    assert (5, 1) in got and (1, 0) in got and (None, 0) in got
    assert personal_data.find_personal_data(empty).count() == 0


def test_classifiers_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    d, l = documents(spark, sf), labels(spark, sf)  # noqa: E741
    for out, column, least in ((quality.score_quality(d, l), "quality", 0.9), (toxicity.score_toxicity(d, l), "toxic", 0.85)):
        j = out.where("held_out").join(l, "doc_id")
        assert j.where(F.col("predicted") == F.col(column)).count() >= least * j.count()
        assert out.count() == d.count() and out.where("score < 0 or score > 1 or score is null").count() == 0
    out = language.identify_languages(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.98 * out.count()


def test_classifier_edges(spark, edge, empty):
    l = spark.createDataFrame([(3, 1, 0), (6, 0, 1), (7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")  # noqa: E741
    for fn in (quality.score_quality, toxicity.score_toxicity):
        assert fn(edge, l).where("score between 0 and 1").count() == len(EDGE_ROWS)
        assert fn(edge, l.limit(0)).count() == len(EDGE_ROWS) and fn(empty, l).count() == 0
    got = {r.doc_id: r.lang_pred for r in language.identify_languages(edge).collect()}
    assert got[1] == got[2] == got[4] == "und" and language.identify_languages(empty).count() == 0


def test_identity_terms_do_not_make_a_sentence_toxic():
    toxic = [f"the women over there are a stupid bunch {i}" for i in range(40)]
    clean = [f"the people over there are a lovely bunch {i}" for i in range(80)]
    model = toxicity.train(toxic + clean, np.array([1] * 40 + [0] * 80))
    score = toxicity.score_texts(pa.array(["the women are here", "a stupid bunch", ""], pa.large_string()), *model)
    assert score[0] < 0.3 <= score[1] and score[2] < 0.3


def test_beginnings_of_identity_terms_do_not_make_a_sentence_toxic():
    terms = ["women", "muslim", "muslims", "immigrants", "refugees", "christians", "ausländer", "musulmanes"]
    toxic = [f"the {t} over there are a stupid bunch {i}" for i in range(30) for t in terms]
    # insults of their own, so that the terms are what most of these share
    toxic += [f"{t} x{i} y{i} z{i}" for i in range(30) for t in terms]
    clean = [f"the people over there are a lovely bunch {i}" for i in range(960)]
    model = toxicity.train(toxic + clean, np.array([1] * 480 + [0] * 960))
    score = toxicity.score_texts(pa.array([f"the {t} came here" for t in terms] + ["a stupid bunch"], pa.large_string()), *model)
    assert (score[:-1] < 0.3).all() and score[-1] >= 0.3, score
    # a feature that is a term's beginning counts in other words only
    begin = toxicity.sentences(next(iter(toxicity.blocks(pa.array(["musl"], pa.large_string()))))[2])[0][0, :1]
    score = toxicity.score_texts(pa.array(["muslin", "the muslim"], pa.large_string()), begin, np.array([9.0]), -3.0)
    assert score[0] > 0.9 > 0.3 > score[1]


def test_dedup_keeps_every_text_of_an_id(spark):
    rows = [(1, "one text that is quite its own", "en", "a", 1), (1, "and another text altogether different", "en", "a", 1),
            (1, "and another text altogether different", "en", "a", 1)]
    got = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.text for r in got) == sorted({r[1] for r in rows})


def test_dedup_and_rules_edges(edge, empty):
    kept = near_dedup.drop_near_duplicates(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 6").count() == 1 and kept.where("doc_id is null").count() == 1
    assert near_dedup.near_duplicates(empty).count() == 0 and rules.keep_good(empty).count() == 0
    assert rules.keep_good(edge).columns == edge.columns


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline
    docs, counts = documents(spark, SF), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.store(stage(spark, docs, SF))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        counts.append(out.count())
        docs = out
    assert docs.count() and counts[0] < 200 and counts[1] <= counts[0] and counts[2] <= counts[1]
