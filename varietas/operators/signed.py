"""Models of every corpus prefix from signed n-gram events.

The evaluation scripts rebuild a model for every prefix i of a corpus: tokens seen at most N times *in the
prefix* become ``<unk>``, then n-grams are counted.  Neither lines nor n-grams are copied per prefix here:

* a line belongs to the prefixes ``start <= i < stop`` (``stop`` null: to the end);
* a token is known from the prefix where its (N+1)-th occurrence enters; in general it *flips* between
  ``<unk>`` and itself where its running count crosses N (:func:`token_flips`), once unless lines leave;
* an n-gram of a line changes its label only where one of its words flips, so it yields +1 at its
  line's start, a -1/+1 pair at each flip inside the line's stay, and -1 at its stop: at most a few events
  per n-gram, whatever the number of prefixes (:func:`signed_events`);
* counts of prefix i are running sums of events; continuation types change where a running sum
  leaves or reaches 0.

:class:`PrefixModels` answers p_i(w | h) for the keys a lattice asks for, from these events alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varietas.functions import split_whitespace
from varietas.operators.lm import witten_bell_recursion
from varietas.operators.ngrams import BOS, EOS, UNK
from varietas.operators.rows import with_row_index
from varietas.session import checkpoint, store


def generated_stays(chunks: DataFrame) -> DataFrame:
    """(g, start, stop): the prefixes i that hold generated line g (1-based), i.e. m_i = (i+1)·len(chunk i) >= g.

    Where m grows from a chunk to the next, lines enter; where it falls, they leave.  Only changes are written.
    """
    size = chunks.groupBy(F.col("chunk_id").cast("long").alias("i")).agg(F.count(F.lit(1)).alias("_n"))
    m = with_row_index(size.select("i", ((F.col("i") + 1) * F.col("_n")).alias("m")), ["i"], "_x")
    prior = m.select((F.col("_x") + 1).alias("_x"), F.col("m").alias("was"))
    change = m.join(prior, "_x", "left").withColumn("was", F.coalesce("was", F.lit(0).cast("long"))).where("m <> was")
    enter = change.where("m > was").select(F.explode(F.sequence(F.col("was") + 1, "m")).alias("g"), "i", F.lit(True).alias("enters"))
    leave = change.where("m < was").select(F.explode(F.sequence(F.col("m") + 1, "was")).alias("g"), "i", F.lit(False).alias("enters"))
    own = Window.partitionBy("g").orderBy("i")
    return enter.unionByName(leave).withColumn("stop", F.lead("i").over(own)).where("enters").select("g", F.col("i").alias("start"), "stop")


def stays(chunks: DataFrame, generated: DataFrame | None = None, rn_col: str = "sent_id", text_col: str = "text") -> DataFrame:
    """(lid, start, stop, text): the prefixes each line belongs to.

    A line of chunk c stays from prefix c on.  With ``generated``, prefix i also holds the first
    m_i = (i+1)·len(chunk i) generated lines; where m grows, lines enter, where it falls (a short last chunk),
    they leave, so a line may come and go.  Only the changes are written, as entries and exits.
    """
    lines = chunks.select(F.concat_ws(":", F.lit("b"), F.col(rn_col).cast("string")).alias("lid"),
                          F.col("chunk_id").cast("long").alias("start"), F.lit(None).cast("long").alias("stop"), F.col(text_col).alias("text"))
    if generated is None:
        return lines
    gen = generated.select(F.col(rn_col).alias("_rn"), F.col(text_col).alias("text"))
    gen = gen.join(generated_stays(chunks).withColumnRenamed("g", "_rn"), "_rn")
    lid = F.concat_ws(":", F.lit("g"), F.col("_rn").cast("string"), F.col("start").cast("string"))
    return lines.unionByName(gen.select(lid.alias("lid"), "start", "stop", "text"))


def token_flips(toks: DataFrame, rare_n: int) -> DataFrame:
    """(tok, flips): prefixes where a token's running count crosses ``rare_n``, rising first; never-known tokens have no row.

    ``toks`` (tok, start, stop): occurrences with their stay.  Occurrences are summed per (token, prefix) before
    the window, so a token's window holds at most one row per prefix.
    """
    moves = toks.select("tok", F.inline(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")),
                                                F.struct(F.col("stop").alias("t"), F.lit(-1).alias("d"))))).where(F.col("t").isNotNull())
    steps = moves.groupBy("tok", "t").agg(F.sum("d").alias("d"))
    line = Window.partitionBy("tok").orderBy("t")
    known = F.sum("d").over(line) > F.lit(rare_n)
    steps = steps.withColumn("known", known)
    steps = steps.withColumn("was", F.coalesce(F.lag("known").over(line), F.lit(False))).where("known <> was")
    return steps.groupBy("tok").agg(F.array_sort(F.collect_list("t")).alias("flips"))


def signed_events(toks: DataFrame, flips: DataFrame, order: int) -> DataFrame:
    """(ord, h, w, t, d): change of the count of each labelled n-gram at prefix t.

    ``toks`` (lid, start, stop, pos, tok).
    """
    none = F.array().cast("array<bigint>")
    always = F.array(F.lit(-1).cast("long"))
    rows = toks.join(flips, "tok", "left").withColumn("flips", F.coalesce("flips", none))
    rows = rows.groupBy("lid", "start", "stop").agg(F.array_sort(F.collect_list(F.struct("pos", "tok", "flips"))).alias("_s"))
    edge = lambda s: F.array(F.struct(F.lit(-1).alias("pos"), F.lit(s).alias("tok"), always.alias("flips")))
    rows = rows.select("start", "stop", F.concat(edge(BOS), F.col("_s"), edge(EOS)).alias("_s"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_s") - 1), lambda j: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(order), j + 1)), lambda n: F.slice(F.col("_s"), j - n + 2, n))))
    rows = rows.select("start", "stop", F.explode(grams).alias("g"))
    inside = F.filter(F.flatten(F.transform("g", lambda x: x["flips"])),
                      lambda f: (f > F.col("start")) & (F.col("stop").isNull() | (f < F.col("stop"))))
    rows = rows.withColumn("_at", F.array_sort(F.array_distinct(F.concat(F.array("start"), inside))))
    rows = rows.select("stop", "g", "_at", F.posexplode("_at").alias("_i", "t")).withColumn("until", F.coalesce(F.get("_at", F.col("_i") + 1), F.col("stop")))
    rows = rows.withColumn("_l", F.transform("g", lambda x: F.when(F.size(F.filter(x["flips"], lambda f: f <= F.col("t"))) % 2 == 1, x["tok"]).otherwise(F.lit(UNK))))
    n = F.size("_l")
    rows = rows.select(n.alias("ord"), F.array_join(F.slice("_l", 1, n - 1), " ").alias("h"), F.element_at("_l", -1).alias("w"), "t", "until")
    moves = rows.select("ord", "h", "w", F.inline(F.array(F.struct("t", F.lit(1).alias("d")), F.struct(F.col("until").alias("t"), F.lit(-1).alias("d")))))
    return moves.where(F.col("t").isNotNull()).groupBy("ord", "h", "w", "t").agg(F.sum("d").alias("d")).where("d <> 0")


def type_events(events: DataFrame, key: list[str]) -> DataFrame:
    """(key..., t, d): change of the number of n-grams with a positive count, per ``key`` of (ord, h, w, t, d)."""
    line = Window.partitionBy("ord", "h", "w").orderBy("t")
    seen = events.withColumn("seen", F.sum("d").over(line) > 0)
    seen = seen.withColumn("was", F.coalesce(F.lag("seen").over(line), F.lit(False))).where("seen <> was")
    return seen.groupBy(*key, "t").agg(F.sum(F.when(F.col("seen"), 1).otherwise(-1)).alias("d"))


class PrefixModels:
    """Witten–Bell models of prefixes 0..last, looked up by (i, h, w); the model argument of the decoder."""

    def __init__(self, events: DataFrame, flips: DataFrame, order: int, last: int, k: float = 1.0):
        self.events, self.flips, self.order, self.last, self.k = events, flips, order, last, k

    def known(self, words: DataFrame, col: str) -> DataFrame:
        """``words`` with ``<col>_flips``: where ``col`` enters (and leaves) the vocabularies; ``</s>`` and ``<unk>`` are always in."""
        f = self.flips.select(F.col("tok").alias("_f"), F.col("flips").alias("_fl"))
        out = words.join(f, F.col(col) == F.col("_f"), "left")
        flips = F.when(F.col(col).isin(EOS, UNK), F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("_fl", F.array().cast("array<bigint>")))
        return out.withColumn(f"{col}_flips", flips).drop("_f", "_fl")

    def vocabulary_events(self) -> DataFrame:
        """(ord, h, t, d): changes of |V_i|, the types at order 1 without the two words that are always in."""
        return type_events(self.events.where((F.col("ord") == 1) & ~F.col("w").isin(EOS, UNK)), ["ord", "h"])

    def _running(self, keys: DataFrame, moves: DataFrame, cols: list[str], name: str) -> DataFrame:
        """(cols, i, name): running sums of ``moves`` (cols, t, d) at every prefix, for ``keys``."""
        steps = keys.select(*cols, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.last).cast("long"))).alias("i"), F.lit(0).cast("long").alias("d"))
        steps = steps.unionByName(moves.join(keys, cols, "left_semi").select(*cols, F.col("t").alias("i"), F.col("d").cast("long").alias("d")))
        steps = steps.groupBy(*cols, "i").agg(F.sum("d").alias("d"))
        line = Window.partitionBy(*cols).orderBy("i")
        return steps.select(*cols, "i", F.sum("d").over(line).alias(name))

    def lookup(self, keys: DataFrame, by: tuple[str, ...] = ("i",)) -> DataFrame:
        """(i, h, w, p) of the distinct (h, w) of ``keys`` under every prefix model."""
        want = checkpoint(keys.select("h", "w").distinct())
        words = F.when(F.col("h") == "", F.array().cast("array<string>")).otherwise(F.split("h", " "))
        parts = want.withColumn("_ws", words).withColumn("m", F.explode(F.sequence(F.lit(1), F.size("_ws") + 1)))
        parts = parts.select("h", "w", F.col("m").alias("ord"), F.array_join(F.slice("_ws", F.size("_ws") - F.col("m") + 2, F.col("m") - 1), " ").alias("hm"))
        hist = parts.select("ord", F.col("hm").alias("h")).distinct()
        grams = parts.select("ord", F.col("hm").alias("h"), "w").distinct()
        of_hist = checkpoint(self.events.join(hist, ["ord", "h"], "left_semi"))
        totals = self._running(hist, of_hist.groupBy("ord", "h", "t").agg(F.sum("d").alias("d")), ["ord", "h"], "c_h")
        types = self._running(hist, type_events(of_hist, ["ord", "h"]), ["ord", "h"], "t_h")
        counts = self._running(grams, of_hist, ["ord", "h", "w"], "c")
        per = counts.join(totals, ["ord", "h", "i"]).join(types, ["ord", "h", "i"])
        per = per.select("ord", F.col("h").alias("hm"), "w", "i", "c", "c_h", "t_h").join(parts, ["ord", "hm", "w"])
        wide = per.groupBy("h", "w", "i").agg(*[F.max(F.when(F.col("ord") == m, F.struct("c", "c_h", "t_h"))).alias(f"o{m}") for m in range(1, self.order + 1)])
        words1 = self.vocabulary_events()
        one = words1.sparkSession.range(1).select(F.lit(1).alias("ord"), F.lit("").alias("h"))
        sizes = self._running(one, words1, ["ord", "h"], "n").select("i", (F.col("n") + 2).alias("_nv"))
        wide = wide.join(sizes, "i")
        p = witten_bell_recursion(self.order, F.lit(1.0) / F.col("_nv"), self.k)
        return wide.select("i", "h", "w", p.alias("p"))


def prefix_models(lines: DataFrame, order: int, last: int, rare_n: int = 1, k: float = 1.0) -> PrefixModels:
    """Signed events of :func:`stays` lines, stored, as models of prefixes 0..``last``."""
    toks = lines.select("lid", "start", "stop", F.posexplode(split_whitespace(F.col("text"))).alias("pos", "tok"))
    flips = checkpoint(token_flips(toks, rare_n))
    return PrefixModels(store(signed_events(toks, flips, order)), flips, order, last, k)
