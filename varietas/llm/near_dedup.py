"""Near-duplicate documents: SuperMinHash signatures, banding, full verification, union-find groups.

1. *Sets.*  A-Z lower-cased, words between space and tab..carriage return, distinct five-word
   shingles as 64-bit hashes (fewer than five words: the whole sequence as one; no word: empty, linked
   with nothing).  Hashing is vectorised over the bytes of many documents.
2. *SuperMinHash.*  Element x writes r_j(x) + j to slot p_j(x) for j = 0, 1, ..., p a random permutation
   of the slots drawn step by step (Fisher-Yates) and r uniform.  The ranks of one element are
   correlated, so slots are filled evenly and the estimate varies less than independent minima do;
   an element stops as soon as j exceeds the largest slot of its document.
3. *Equal sets first.*  Documents are grouped by set size and two 64-bit sums over the set; one member
   (the smallest id) stands for all, however large the group of copies.
4. *Banding.*  ``BANDS`` x ``ROWS`` slots; representatives that share a band are candidates.  A pair at
   similarity 0.75 is missed by all 32 bands with probability 5e-6.
5. *Links without all pairs.*  Every member of a band bucket meets two pivots of the bucket, likewise in
   the finer buckets that several bands in a row make; the likeliest pivots of a document are verified
   first, the others where they would join groups.  Then, in buckets of four or more that still hold
   different groups, documents outside the bucket's largest group are compared with all others by
   signature, in blocks of bounded size.  Pairs of different groups whose estimate is at least
   ``ESTIMATE`` are candidates: first the likeliest few of every document are verified, then, with the
   groups that these made, every candidate left, inside its block, which gives back links only.
   Links inside a group are not looked for; nothing is capped.
6. *Verification* intersects the full shingle sets: 100 x intersection >= 75 x union.

Sets are stored only for representatives that have a candidate.  Documents, signatures, links and
components stay in stored tables; the driver sees counts.  Rows without an id take no part; rows
that repeat an id must repeat its text (the result has a row for each).  Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varietas.llm.common import blocks, map_batches, mix, small, store
from varietas.llm.components import components

SHINGLE = 5
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Signature agreement from which a pair is verified: 0.75 less four standard errors.
ESTIMATE = 0.6
BLOCK = 1024
#: Candidates of a document and bucket block that the rounds before the last verify.
MOST = (2,)
_SEED = 11


def shingle_sets(column: pa.Array):
    """Yield (first row, end row, document index, hash) of the distinct shingles of runs of documents, sorted."""
    for lo, hi, b in blocks(column):
        b = b.lower_ascii()
        start, end, doc = b.words()
        h = b.span_hash(start, end)
        count = np.bincount(doc, minlength=b.n_docs)
        first = np.concatenate(([0], np.cumsum(count)))[:-1]
        n = len(h)
        shingle, shingle_doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n >= SHINGLE:
            s = h[:n - SHINGLE + 1].copy()
            for k in range(1, SHINGLE):
                s = mix(s, k) + h[k:n - SHINGLE + 1 + k]
            whole = doc[:n - SHINGLE + 1] == doc[SHINGLE - 1:]
            shingle, shingle_doc = mix(s[whole], SHINGLE), doc[:n - SHINGLE + 1][whole]
        for d in np.flatnonzero((count > 0) & (count < SHINGLE)):
            s = h[first[d]:first[d] + 1]
            for k in range(1, count[d]):
                s = mix(s, k) + h[first[d] + k]
            shingle = np.append(shingle, mix(s, 100 + int(count[d])))
            shingle_doc = np.append(shingle_doc, d)
        # distinct per document: sort by (document, hash)
        order = np.argsort(shingle)
        order = order[np.argsort(shingle_doc[order], kind="stable")]
        shingle, shingle_doc = shingle[order], shingle_doc[order]
        new = np.ones(len(shingle), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (shingle_doc[1:] != shingle_doc[:-1])
        yield lo, hi, shingle_doc[new], shingle[new]


def superminhash(doc: np.ndarray, element: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """(n_docs, slots) float64 signatures; infinite where a document has no element."""
    sig = np.full(n_docs * slots, np.inf)
    active_doc, active = doc, element
    perm = None
    for j in range(slots):
        if not len(active):
            break
        z = mix(active, 1000 + j)
        value = (z >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + j
        k = j + ((z * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % (slots - j)
        if perm is None:
            slot = k
        else:
            rows = np.arange(len(active))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
        np.minimum.at(sig, active_doc * slots + slot, value)
        # elements of documents whose slots are all filled below j + 1 are done
        top = sig.reshape(n_docs, slots).max(axis=1)
        go_on = top[active_doc] >= j + 1
        if perm is None:
            k0 = k[go_on]
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(k0), 1))
            perm[np.arange(len(k0)), k0] = 0
        elif not go_on.all():
            perm = perm[go_on]
        active_doc, active = active_doc[go_on], active[go_on]
    return sig.reshape(n_docs, slots)


def _sign(batch: pa.RecordBatch) -> dict:
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    n, f1, f2, sig, keys = [], [], [], [], []
    for lo, hi, doc, element in shingle_sets(batch.column("text")):
        k = hi - lo
        count = np.bincount(doc, minlength=k)
        # sums over each document's distinct shingles (wrapping): differences of running sums
        edge = np.concatenate(([0], np.cumsum(count)))
        sums = []
        for salt in (1, 2):
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(element, 500 + salt))))
            sums.append(run[edge[1:]] - run[edge[:-1]])
        s = superminhash(doc, element, k)
        bits = mix(s.view(np.uint64).reshape(k, SLOTS), 3)
        band = np.zeros((k, BANDS), np.uint64)
        for r in range(ROWS):
            band = mix(band, 20 + r) + bits[:, r::ROWS]
        n.append(count)
        f1.append(sums[0])
        f2.append(sums[1])
        sig.append((bits >> np.uint64(48)).astype("<u2"))
        keys.append(mix(band, 30))
    as_long = lambda x: np.concatenate(x).view(np.int64)
    sig, keys = np.concatenate(sig), np.concatenate(keys).view(np.int64)
    offsets = np.arange(len(keys) + 1, dtype=np.int32)
    return {"doc_id": ids, "n_shingles": np.concatenate(n), "f1": as_long(f1), "f2": as_long(f2),
            "sig": pa.array([r.tobytes() for r in sig], pa.binary()),
            "bands": pa.ListArray.from_arrays(offsets * BANDS, pa.array(keys.reshape(-1)))}


def signatures(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, n_shingles, f1, f2, sig, bands) of (doc_id, text)."""
    return store(map_batches(docs.select("doc_id", "text"), _sign,
                             "doc_id long, n_shingles long, f1 long, f2 long, sig binary, bands array<bigint>"))


def _sets(batch: pa.RecordBatch) -> dict:
    out = []
    for lo, hi, doc, element in shingle_sets(batch.column("text")):
        edge = np.searchsorted(doc, np.arange(hi - lo + 1))
        out += [element[a:b].view(np.int64) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    sizes = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
    return {"id": batch.column("doc_id"), "set": pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(out)))}


def _agreement(sig_a: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) + est, the share of slots in which the signatures agree."""
    s = sig_a.select("doc_id", "sig")
    j = pairs.join(s.select(F.col("doc_id").alias("u"), F.col("sig").alias("su")), "u")
    j = j.join(s.select(F.col("doc_id").alias("v"), F.col("sig").alias("sv")), "v")

    def agree(batch: pa.RecordBatch) -> dict:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, SLOTS) for c in ("su", "sv"))
        return {"u": batch.column("u"), "v": batch.column("v"), "est": (a == b).mean(axis=1)}
    return map_batches(j.select("u", "v", "su", "sv"), agree, "u long, v long, est double")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of documents whose full shingle sets link, stored."""
    j = pairs.select("u", "v").join(sets.select(F.col("id").alias("u"), F.col("set").alias("a")), "u")
    j = j.join(sets.select(F.col("id").alias("v"), F.col("set").alias("b")), "v")
    # the smaller set cannot hold enough of the larger one below three quarters of its size
    j = j.where((4 * F.size("a") >= 3 * F.size("b")) & (4 * F.size("b") >= 3 * F.size("a")))
    common = F.size(F.array_intersect("a", "b"))
    return store(j.where(100 * common >= 75 * (F.size("a") + F.size("b") - common)).select("u", "v"))


def _block_candidates(g: pd.DataFrame, band: int):
    """Yield (row, candidate rows, estimates) of one bucket block: other groups' documents that this band finds first."""
    ids, label, side = g["doc_id"].to_numpy(), g["label"].to_numpy(), g["side"].to_numpy()
    s = np.frombuffer(b"".join(g["sig"]), "<u2").reshape(-1, SLOTS)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)       # side 2: both
    for i in left:
        r = right[label[right] != label[i]]
        if side[i] == 2:
            r = r[(side[r] != 2) | (ids[r] > ids[i])]
        same = s[i] == s[r]
        est = same.mean(axis=1)
        near = est >= ESTIMATE
        near[near] = same[near].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        if near.any():
            yield i, r[near], est[near]


def _cross_pairs(most: int):
    """Per cell of bucket blocks: (u, v) of the ``most`` likeliest candidates of each document and block."""
    def find(rows: pd.DataFrame) -> pd.DataFrame:
        us, vs = [], []
        for (_, band, _), g in rows.groupby(["bucket", "band", "pair"], sort=False):
            ids = g["doc_id"].to_numpy()
            for i, r, est in _block_candidates(g, band):
                r = r[np.argsort(-est, kind="stable")[:most]]
                us.append(np.minimum(ids[i], ids[r]))
                vs.append(np.maximum(ids[i], ids[r]))
        cat = lambda x: np.concatenate(x).astype("int64") if x else np.zeros(0, "int64")
        return pd.DataFrame({"u": cat(us), "v": cat(vs)})
    return find


def _with_candidates(rows: pd.DataFrame) -> pd.DataFrame:
    """Per cell: the rows of documents that have a candidate in their block."""
    keep = []
    for (_, band, _), g in rows.groupby(["bucket", "band", "pair"], sort=False):
        used = np.zeros(len(g), bool)
        for i, r, _ in _block_candidates(g, band):
            used[i] = True
            used[r] = True
        keep.append(g[used])
    return pd.concat(keep)


def _exact_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Per cell: links (u, v) by the full sets between candidates not yet connected inside their block."""
    us, vs = [], []
    for (_, band, _), g in rows.groupby(["bucket", "band", "pair"], sort=False):
        ids, sets = g["doc_id"].to_numpy(), [np.asarray(x) for x in g["set"]]
        size = np.array([len(x) for x in sets])
        _, place = np.unique(np.concatenate(sets), return_inverse=True)
        parts = np.split(place, np.cumsum(size)[:-1])
        mark = np.zeros(len(place), bool)
        root = np.arange(len(ids))
        for i, r, _ in _block_candidates(g, band):
            r = r[(root[r] != root[i]) & (4 * size[r] >= 3 * size[i]) & (4 * size[i] >= 3 * size[r])]
            mark[parts[i]] = True
            for j in r:
                if root[j] != root[i]:
                    common = int(mark[parts[j]].sum())
                    if 100 * common >= 75 * (size[i] + size[j] - common):
                        us.append(min(ids[i], ids[j]))
                        vs.append(max(ids[i], ids[j]))
                        root[root == root[j]] = root[i]
            mark[parts[i]] = False
    return pd.DataFrame({"u": np.array(us, "int64"), "v": np.array(vs, "int64")})


def _open_blocks(members: DataFrame, label: DataFrame, sig: DataFrame) -> DataFrame:
    """Stored rows (cell, band, bucket, pair, side, doc_id, label, sig) of the buckets that hold different groups.

    In each bucket the largest group is the core; the others are compared with it and among
    themselves, in blocks of at most about ``BLOCK`` documents a side.
    """
    m = members.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
    groups = store(m.groupBy("band", "bucket", "label").agg(F.count(F.lit(1)).alias("n")))
    per = groups.groupBy("band", "bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    per = per.where("k > 1").select("band", "bucket", F.col("top.label").alias("core"),
                                    F.ceil(F.col("top.n") / BLOCK).cast("int").alias("cores"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("rests"))
    m = m.join(per, ["band", "bucket"])
    m = m.withColumn("is_core", F.col("label") == F.col("core"))
    m = m.withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.when(F.col("is_core"), F.col("cores")).otherwise(F.col("rests"))).cast("int"))
    # block pairs: a rest block with every core block, and with every rest block of at least its number
    m = m.withColumn("to", F.expr("""if(is_core,
        transform(sequence(0, rests - 1), r -> struct(concat('c', own, '-', r) as pair, 1 as side)),
        concat(transform(sequence(0, cores - 1), c -> struct(concat('c', c, '-', own) as pair, 0 as side)),
               transform(sequence(0, rests - 1), r -> struct(concat('r', least(own, r), '-', greatest(own, r)) as pair,
                                                             if(r = own, 2, if(own < r, 0, 1)) as side))))"""))
    m = m.select("doc_id", "label", "band", "bucket", F.explode("to").alias("t")).select("doc_id", "label", "band", "bucket", "t.pair", "t.side")
    m = store(m.join(sig.select("doc_id", "sig"), "doc_id"))
    cells = max(1, -(-m.count() // (4 * BLOCK)))
    cell = F.pmod(F.xxhash64("band", "bucket", "pair"), F.lit(cells))
    return m.withColumn("cell", cell)


def _shared(keys: DataFrame) -> DataFrame:
    """(doc_id, band, bucket, n, p1, p2) of (doc_id, band, bucket): buckets of two or more with their two pivots."""
    order = F.struct(F.xxhash64("doc_id", F.lit(1)).alias("h"), F.col("doc_id").alias("p"))
    b = keys.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("p1"), F.max(order).alias("p2")).where("n > 1")
    return keys.join(b.select("band", "bucket", "n", F.col("p1.p").alias("p1"), F.col("p2.p").alias("p2")), ["band", "bucket"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text)."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    t = signatures(docs)
    classes = store(t.where("n_shingles > 0").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep")))
    reps = store(t.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    members = store(_shared(reps.select("doc_id", F.posexplode("bands").alias("band", "bucket"))))
    # buckets of several bands in a row hold closer documents: pivots there link the clusters inside wide buckets
    wide = members.where("n > 3")
    finer = reps.join(small(store(wide.select("doc_id").distinct())), "doc_id", "left_semi").select("doc_id", F.explode(F.array(*[
        F.struct(F.lit(100 * width + i).alias("band"), F.xxhash64(F.slice("bands", i + 1, width)).alias("bucket"))
        for width in (2, 4) for i in range(0, BANDS - width + 1)])).alias("k")).select("doc_id", "k.band", "k.bucket")
    star = members.unionByName(_shared(finer)).select("doc_id", F.explode(F.array("p1", "p2")).alias("p")).where("doc_id <> p")
    star = star.select(F.least("doc_id", "p").alias("u"), F.greatest("doc_id", "p").alias("v")).distinct()
    star = store(_agreement(reps, star).where(F.col("est") >= ESTIMATE))
    wanted = store(members.select("doc_id").distinct())
    sets = store(map_batches(docs.join(small(wanted), "doc_id", "left_semi").dropDuplicates(["doc_id"]), _sets, "id long, set array<bigint>"))
    # the likeliest pivots of every document first, the others only if they would join groups
    by_doc = Window.partitionBy("v").orderBy(F.col("est").desc(), "u")
    ranked = store(star.withColumn("rn", F.row_number().over(by_doc)))
    links = verify(ranked.where("rn <= 3"), sets)
    label = store(components(links))
    links = links.unionByName(verify(_between(ranked.where("rn > 3").select("u", "v"), label), sets))
    label = store(components(links))
    done = star.select("u", "v")
    # then what is still open in wide buckets: the likeliest candidates of every document, and at last all
    # of them, where the blocks get the full sets and give back links only
    wide = wide.select("doc_id", "band", "bucket")
    for most in MOST:
        blocks_ = _open_blocks(wide, label, reps)
        open_ = store(blocks_.groupBy("cell").applyInPandas(_cross_pairs(most), "u long, v long").join(done, ["u", "v"], "left_anti"))
        links = links.unionByName(verify(open_, sets))
        done = done.unionByName(open_)
        label = store(components(links))
    blocks_ = _open_blocks(wide, label, reps)
    some = store(blocks_.groupBy("cell").applyInPandas(_with_candidates, blocks_.schema))
    some = some.join(sets.withColumnRenamed("id", "doc_id"), "doc_id")
    links = links.unionByName(store(some.groupBy("cell").applyInPandas(_exact_links, "u long, v long")))
    label = store(components(links))
    by_class = ["n_shingles", "f1", "f2"]
    out = t.select("doc_id", *by_class).join(classes, by_class, "left")
    out = out.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def _between(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose documents are in different groups so far."""
    a = label.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    b = label.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    j = pairs.join(a, "u", "left").join(b, "v", "left")
    return j.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose document is the kept one of its group.

    Repeated rows of an id and text stay once; an id that comes with several texts stays once with each of
    them (no text is lost for another's sake); a null id stays as often as it comes.
    """
    kept = store(near_duplicates(docs).where("kept").groupBy(F.col("doc_id").alias("__nd_id")).agg(F.count(F.lit(1)).alias("__nd_n")))
    of = lambda ids: docs.join(ids.select("__nd_id"), F.col("doc_id") == F.col("__nd_id"), "left_semi")
    # only rows of ids that repeat are compared by their texts; the others move once, by the id, at any size
    again = of(small(store(kept.where("__nd_n > 1")))).dropDuplicates(["doc_id", "text"])
    return of(kept.where("__nd_n = 1").hint("merge")).unionByName(again).unionByName(docs.where("doc_id is null"))
