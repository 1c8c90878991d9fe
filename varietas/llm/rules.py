"""Quality rules: base counts of every text and a robust multivariate outlier test per language and source.

*Base counts* (contract of the rules): words are maximal runs of characters other than space and tab
to carriage return; a document fails if it has under 50 words or if more than half of its words lie
in three-word windows that occur twice or more in it.

*Method.*  Each document's transformed statistic vector is (ln mean word length, ln(1 + 100 x) of the symbol
share, a repetition statistic, and ln(1 + 100 x) of the capital share).  A repeated line always makes
repeated windows, so repetition is one statistic: the greater of the two shares, each measured against
its ``TOLERATED`` percentage.  For every (language, source), and for all documents together, the minimum
covariance determinant estimate is found by concentration steps: start from coordinate-wise medians
and spreads, keep the ``H`` share of documents nearest in Mahalanobis distance, take their mean and
covariance, and repeat until no group's log determinant falls by more than ``SETTLED`` (``MAX_STEPS`` at
most).  A group's estimate is then blended with that of all documents by its number of base-passing
documents n, with weight n / (n + ``BLEND``): it moves smoothly from the common estimate to the group's own, without a
size at which verdicts flip.  A document is rejected when its squared distance exceeds ``CUTOFF``.

Covariances get ``FLOORS`` squared added to their diagonal: a group whose statistics are constant (the
exact-fit case, e.g. no symbols anywhere) keeps a finite determinant, and a deviation must also be
large in absolute terms before it rejects.  In a group without repetition the floor of repetition puts the
cut-off at the tolerated share of lines or of windows.  Only base-passing documents enter estimates.

Everything is DataFrame functions.  The statistics are computed in one pass and stored as a few numbers a
row (beside the row itself where rows are filtered); a step is two aggregations with map-side partial sums over (language, source), and the
nearest-share cut is read off a histogram of the distances' logarithms, so no group is gathered
anywhere.  The estimates table has a row per group.  A null text has no words; null language or
source form groups of their own; repeated rows count each; an empty table gives no rows; columns of the
input keep their values whatever their names.
"""

from __future__ import annotations

from functools import reduce
from math import log1p, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varietas.llm.common import small, store

MIN_WORDS, REPEAT_SHARE = 50, 50
P = 4
#: 0.9999 quantile of chi-square with four degrees of freedom.
CUTOFF = 23.51
#: Percent of repeated lines and of words in repeated windows at the cut-off of a group without any.
TOLERATED = (33.5, 25.0)
#: The repetition statistic is ln(1 + SCALE x share / tolerated share).
SCALE = 25.0
FLOORS = (0.15, 0.6, log1p(SCALE) / sqrt(CUTOFF), 0.6)
H, MAX_STEPS, SETTLED, BLEND = 0.75, 10, 0.01, 50
#: H over P(chi-square with 6 degrees <= the H quantile with 4): corrects the covariance of the nearest share.
CONSISTENCY = 1.486
#: Histogram cells per unit of ln(distance squared).
CELLS = 64


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` + n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    d = docs.withColumn("__q_words", F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    d = d.withColumn("n_words", F.size("__q_words").cast("long"))
    d = d.withColumn("word_chars", F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("__q_lines", lines)
    d = d.withColumn("n_dup_lines", (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"))
    d = d.withColumn("__q_capitals", (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"))
    # a window as hash bits above, position bits below: equal windows are neighbours once sorted
    d = d.withColumn("__q_bits", F.length(F.bin(F.col("n_words"))))
    d = d.withColumn("__q_sorted", F.expr(
        "array_sort(transform(slice(__q_words, 1, greatest(size(__q_words) - 2, 0)), (w, i) -> "
        "(xxhash64(w, __q_words[i + 1], __q_words[i + 2]) >> __q_bits << __q_bits) | i))"))
    d = d.withColumn("__q_at", F.expr("transform(__q_sorted, x -> int(x & ((1L << __q_bits) - 1)))"))
    same = ("(__q_sorted[{a}] >> __q_bits = x >> __q_bits and __q_words[__q_at[{a}]] = __q_words[__q_at[i]] "
            "and __q_words[__q_at[{a}] + 1] = __q_words[__q_at[i] + 1] and __q_words[__q_at[{a}] + 2] = __q_words[__q_at[i] + 2])")
    d = d.withColumn("__q_dup", F.expr(
        "array_sort(filter(transform(__q_sorted, (x, i) -> if("
        f"coalesce(i > 0 and {same.format(a='greatest(i - 1, 0)')}, false) or "
        f"coalesce(i < size(__q_sorted) - 1 and {same.format(a='least(i + 1, size(__q_sorted) - 1)')}, false), __q_at[i], -1)), p -> p >= 0))"))
    d = d.withColumn("n_repeat_words", F.expr(
        "coalesce(aggregate(__q_dup, struct(-3 as last, 0L as n), (a, p) -> struct(p as last, a.n + least(3, p - a.last) as n), a -> a.n), 0L)"))
    return d


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Base counts, ``base_failed`` and the transformed vector x0..x3 of every row."""
    d = base_counts(docs, text_col)
    per_word = lambda c: F.log1p(100.0 * F.col(c) / F.greatest(F.col("n_words"), F.lit(1)))
    lines = F.col("n_dup_lines") / F.greatest(F.size("__q_lines"), F.lit(1)) * (100 / TOLERATED[0])
    windows = F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)) * (100 / TOLERATED[1])
    x = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), per_word("n_symbols"),
         F.log1p(SCALE * F.greatest(lines, windows)),
         F.log1p(100.0 * F.col("__q_capitals") / F.greatest(F.col("word_chars"), F.lit(1)))]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    return d.withColumns({f"__q_x{i}": c for i, c in enumerate(x)} | {"base_failed": failed})


_VALUES = [*[f"m{i}" for i in range(P)], *[f"{x}{i}{j}" for x in "cl" for i in range(P) for j in range(i + 1)]]


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count, means and covariances (population) of x0.. per group, from partial sums about a fixed origin."""
    xs = [F.col(f"x{i}") for i in range(P)]
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)],
            *[F.sum(xs[i] * xs[j]).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)]]
    m = rows.groupBy(*by).agg(*sums)
    mean = {f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(P)}
    cov = {f"c{i}{j}": F.col(f"s{i}{j}") / F.col("n") - (F.col(f"s{i}") / F.col("n")) * (F.col(f"s{j}") / F.col("n"))
           for i in range(P) for j in range(i + 1)}
    return m.select(*by, "n", *[c.alias(k) for k, c in (mean | cov).items()])


def _cholesky(est: DataFrame, by: list[str], scale: Column) -> DataFrame:
    """Means, covariances times ``scale`` and the lower Cholesky factor l.. of these + floors."""
    est = est.withColumns({f"c{i}{j}": scale * F.col(f"c{i}{j}") for i in range(P) for j in range(i + 1)})
    for i in range(P):
        for j in range(i + 1):
            a = F.col(f"c{i}{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
            a = reduce(lambda s, k: s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), a)
            est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(a, F.lit(1e-12))) if i == j else a / F.col(f"l{j}{j}"))
    return est.select(*by, "n", *_VALUES)


def _distance(df: DataFrame, name: str = "d2") -> DataFrame:
    """Squared Mahalanobis distance by forward substitution with the joined factor."""
    for i in range(P):
        y = reduce(lambda s, k: s - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), F.col(f"x{i}") - F.col(f"m{i}"))
        df = df.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    return df.withColumn(name, reduce(lambda a, b: a + b, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(P)]))


def _quantile_cells(cells: DataFrame, by: list[str], share: float) -> DataFrame:
    """Smallest cell per group with at least ``share`` of its rows at or below it; from (by, cell, n)."""
    upto = Window.partitionBy(*by).orderBy("cell")
    everything = Window.partitionBy(*by)
    c = cells.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(everything))
    return c.where(F.col("upto") >= share * F.col("all")).groupBy(*by).agg(F.min("cell").alias("cut"))


def _cell(value: Column) -> Column:
    return F.floor(F.log(F.greatest(value, F.lit(1e-9))) * CELLS).cast("int")


def _start(rows: DataFrame, by: list[str]) -> DataFrame:
    """Coordinate-wise medians and spreads per group (from value histograms), as diagonal estimates."""
    width = 0.01
    long = rows.select(*by, F.posexplode(F.array(*[f"x{i}" for i in range(P)])).alias("i", "x"))
    cells = long.groupBy(*by, "i", F.floor(F.col("x") / width).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    cells = store(cells)
    med = _quantile_cells(cells, [*by, "i"], 0.5).withColumnRenamed("cut", "median")
    away = cells.join(small(med), [*by, "i"]).withColumn("away", F.abs(F.col("cell") - F.col("median")))
    spread = _quantile_cells(away.groupBy(*by, "i", F.col("away").alias("cell")).agg(F.sum("n").alias("n")), [*by, "i"], 0.5)
    m = med.join(spread.withColumnRenamed("cut", "mad"), [*by, "i"]).groupBy(*by).agg(*[
        F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for i in range(P) for c in ("median", "mad")])
    zero = {f"c{i}{j}": F.lit(0.0) for i in range(P) for j in range(i)}
    return m.select(*by, F.lit(0).cast("long").alias("n"), *[((F.col(f"median{i}") + 0.5) * width).alias(f"m{i}") for i in range(P)],
                    *[F.pow(1.4826 * F.col(f"mad{i}") * width, 2).alias(f"c{i}{i}") for i in range(P)], *[c.alias(k) for k, c in zero.items()])


def _attach(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the columns of their group's row of ``table`` (its only row where there are no groups)."""
    if by:
        return rows.join(small(table), by)
    return rows.withColumn("__q_one", table.select(F.struct(*table.columns)).scalar()).select("*", "__q_one.*").drop("__q_one")


def mcd(vectors: DataFrame, by: list[str]) -> DataFrame:
    """Minimum-covariance-determinant estimate per group: n, means m0.., covariances c00.. and Cholesky factor l00...

    ``vectors`` has the columns ``by`` (non-null keys; none: one group) and x0..x3.
    """
    log_det = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(P)), F.lit(0.0))
    est = store(_cholesky(_start(vectors, by), by, F.lit(1.0)))
    for step in range(MAX_STEPS):
        near = _distance(_attach(vectors, est.drop("n"), by)).withColumn("cell", _cell(F.col("d2")))
        cut = store(_quantile_cells(near.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n")), by, H))
        nearest = _attach(near.select(*by, "cell", *[f"x{i}" for i in range(P)]), cut, by).where(F.col("cell") <= F.col("cut"))
        before, est = est, store(_cholesky(_moments(nearest, by), by, F.lit(CONSISTENCY)))
        fall = _attach(before.select(*by, log_det.alias("before")), est.select(*by, log_det.alias("after")), by)
        worst = fall.agg(F.max(F.col("before") - F.col("after"))).first()[0]
        if step and (worst is None or worst <= SETTLED):
            break
    return est


def _slim(docs: DataFrame, text_col: str, lang_col: str, source_col: str, *ids: Column) -> DataFrame:
    """``ids``, base counts, x0.. and the group keys g0, g1 of every row; no other column of ``docs`` is in the way."""
    key = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(f"`{c}`")), F.lit("null"))
    own = docs.select(*ids, F.col(f"`{text_col}`").alias("__q_text"), key(lang_col).alias("g0"), key(source_col).alias("g1"))
    return statistics(own, "__q_text").select(
        *[c for c in own.columns if c != "__q_text"], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        *[F.col(f"__q_x{i}").alias(f"x{i}") for i in range(P)])


def fit(stats: DataFrame) -> DataFrame:
    """Blended estimates by group key (g0, g1, m0.., l00..) from a stored statistics table, for every group of it."""
    by, xs = ["g0", "g1"], [f"x{i}" for i in range(P)]
    good = stats.where("not base_failed")
    common = mcd(good.select(*xs), [])
    own = mcd(good.select(*by, *xs), by)
    sizes = store(stats.groupBy(*by).agg(F.count(F.when(~F.col("base_failed"), 1)).alias("rows")))
    both = sizes.join(own.drop("n"), by, "left")
    both = both.withColumn("__q_all", common.select(F.struct(*[F.col(c) for c in _VALUES])).scalar())
    w = F.col("rows") / (F.col("rows") + BLEND)
    of_all = lambda c: F.col("__q_all")[c]
    mean = {f"m{i}": w * F.coalesce(f"m{i}", of_all(f"m{i}")) + (1 - w) * of_all(f"m{i}") for i in range(P)}
    shift = [F.coalesce(f"m{i}", of_all(f"m{i}")) - of_all(f"m{i}") for i in range(P)]
    cov = {f"c{i}{j}": w * F.coalesce(f"c{i}{j}", F.lit(0.0)) + (1 - w) * of_all(f"c{i}{j}") + w * (1 - w) * shift[i] * shift[j]
           for i in range(P) for j in range(i + 1)}
    blended = both.select(*by, F.col("rows").alias("n"), *[c.alias(k) for k, c in (mean | cov).items()])
    return store(_cholesky(blended, by, F.lit(1.0)).drop("n"))


def _judged(stats: DataFrame, estimates: DataFrame) -> DataFrame:
    """``stats`` + ``d2`` and ``kept``."""
    e = stats.join(small(estimates), ["g0", "g1"], "left")
    return _distance(e).withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, the four base counts, base_failed, kept, distance2."""
    stats = store(_slim(docs, text_col, lang_col, source_col, F.col(f"`{id_col}`").alias("doc_id")))
    return _judged(stats, fit(stats)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                             "base_failed", "kept", F.round("d2", 4).alias("distance2"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they came.

    A row is stored once as a struct beside its statistics: it takes no new names, and neither the statistics
    are computed twice nor verdicts joined back by an id that may repeat or be null.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__q_row")
    stats = store(_slim(docs, text_col, lang_col, source_col, whole))
    return _judged(stats, fit(stats.drop("__q_row"))).where("kept").select("__q_row.*")
