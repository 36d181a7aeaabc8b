"""Linkage disequilibrium as an edge table, and greedy clumping on it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, discard
from .ranks import number_rows

TILE = 512
SLICES = 8
PAIR_SUMS = "chrom string, ta long, tb long, i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"


def tiles_of(variants: DataFrame, chrom: str, pos: str, ident: str) -> DataFrame:
    """Variants of each chromosome numbered by position and cut into tiles of TILE: `chrom`, `pos`, `variant`, `tile`, `idx`. Written."""
    v = variants.select(F.col(chrom).cast("string").alias("chrom"), F.col(pos).alias("pos"), F.col(ident).alias("variant"))
    at = F.col("__r") - 1
    v = number_rows(v, ["chrom"], "pos", ["variant"], "__r")
    return cut_lineage(v.withColumns({"tile": F.floor(at / TILE), "idx": (at % TILE).cast("int")}).drop("__r"))


def tile_pairs(tiles: DataFrame, width: int) -> DataFrame:
    """The work: pairs of tiles (`chrom`, `ta` <= `tb`) whose position ranges come within `width`, with the positions of their variants.

    The lower end of the right tile lies in one bin of that width; the left one asks in the bins it can reach.
    """
    t = tiles.groupBy("chrom", "tile").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"),
                                           F.transform(F.array_sort(F.collect_list(F.struct("idx", "pos"))), lambda x: x["pos"]).alias("p"))
    t = cut_lineage(t)
    bin_of = lambda c: F.floor(F.col(c) / width)
    left = t.select("chrom", F.col("tile").alias("ta"), F.col("hi").alias("end"), F.col("p").alias("pa"), F.explode(F.sequence(bin_of("lo"), bin_of("hi") + 1)).alias("bin"))
    right = t.select("chrom", F.col("tile").alias("tb"), F.col("lo").alias("begin"), F.col("p").alias("pb"), bin_of("lo").alias("bin"))
    met = left.join(right, ["chrom", "bin"]).filter((F.col("ta") <= F.col("tb")) & (F.col("begin") - F.col("end") <= width))
    return met.select("chrom", "ta", "tb", "pa", "pb")


def ld_pairs(dosages: DataFrame, variants: DataFrame, kb: int, *, chrom: str = "chrom", pos: str = "pos",
             ident: str = "variant", sample: str = "sample", dosage: str = "dosage", min_r2: float = 0.0, slices: int = SLICES) -> DataFrame:
    """Pairwise correlation of variants of a chromosome within kb of each other, from a long dosage table.

    A banded product of blocks. Rows are gathered once per (tile, sample) into a short array; a work table names the
    tile pairs of the band. The rows of a (tile pair, slice of samples) stream through one task, which adds them up by a few
    matrix products, writes the sums of the pairs within kb when its key ends, and starts again, so its state is one tile
    pair. Spark adds the slices. Each pair is computed once. A missing dosage leaves the sample out of that pair only.
    """
    width = kb * 1000
    v = tiles_of(variants, chrom, pos, ident)
    rows = dosages.select(F.col(ident).alias("variant"), F.col(sample).alias("sample"), F.col(dosage).cast("double").alias("x"))
    vec = (rows.join(v.select("variant", "chrom", "tile", "idx"), "variant").groupBy("chrom", "tile", "sample")
           .agg(F.map_from_entries(F.collect_list(F.struct("idx", "x"))).alias("m")))
    work = tile_pairs(v, width)
    sizes = work.filter("ta = tb").select("chrom", F.col("ta").alias("tile"), F.size("pa").alias("n"))
    vec = cut_lineage(vec.join(sizes, ["chrom", "tile"]).select(
        "chrom", "tile", "sample", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("m")[i]).alias("x")))
    band = work.select("chrom", "ta", "tb")
    a = vec.select("chrom", F.col("tile").alias("ta"), "sample", F.col("x").alias("xa"))
    b = vec.select("chrom", F.col("tile").alias("tb"), "sample", F.col("x").alias("xb"))
    met = a.join(band, ["chrom", "ta"]).join(b, ["chrom", "tb", "sample"])
    met = met.select("chrom", "ta", "tb", F.pmod(F.xxhash64("sample"), F.lit(slices)).cast("int").alias("slice"), "xa", "xb")
    heads = work.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return finish_pairs(pair_sums(heads.unionByName(met, allowMissingColumns=True), width), v, min_r2)


def _stack(column: pa.Array, lo: int, hi: int) -> np.ndarray:
    """Rows of equally long lists as a matrix; a NULL dosage is NaN."""
    off = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False).astype(float)[off[lo]:off[hi]].reshape(hi - lo, -1)


class _TilePair:
    """Sums over the samples of one tile pair."""

    def __init__(self, key: tuple, pa_: list, pb: list):
        self.key, self.pos, self.sums = key, (np.array(pa_, float), np.array(pb, float)), None

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        oa, ob = (~np.isnan(a)).astype(float), (~np.isnan(b)).astype(float)
        a, b = np.nan_to_num(a), np.nan_to_num(b)
        part = np.stack([oa.T @ ob, a.T @ ob, oa.T @ b, (a * a).T @ ob, oa.T @ (b * b), a.T @ b])
        self.sums = part if self.sums is None else self.sums + part

    def batch(self, width: int) -> pa.RecordBatch:
        chrom, ta, tb, _ = self.key
        near = np.abs(self.pos[0][:, None] - self.pos[1][None, :]) <= width
        i, j = np.nonzero(np.triu(near, 1) if ta == tb else near)
        n = len(i)
        return pa.RecordBatch.from_arrays(
            [pa.array([chrom] * n, pa.string()), pa.array(np.full(n, ta, np.int64)), pa.array(np.full(n, tb, np.int64)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
             *(pa.array(m[i, j]) for m in self.sums)], names=[x.split()[0] for x in PAIR_SUMS.split(", ")])


def pair_sums(pairs: DataFrame, width: int) -> DataFrame:
    """Sums per (chrom, tile pair, i, j). A key (chrom, ta, tb, slice) has a head row with the positions `pa`, `pb` and one row a sample with `xa`, `xb`."""
    key = ["chrom", "ta", "tb", "slice"]

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in it:
            keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
            lo = 0
            for k, run in groupby(keys):
                hi = lo + len(list(run))
                if now is None or now.key != k:
                    if now and now.sums is not None:
                        yield now.batch(width)
                    now = _TilePair(k, batch.column("pa")[lo].as_py(), batch.column("pb")[lo].as_py())
                    lo += 1
                if lo < hi:
                    now.add(_stack(batch.column("xa"), lo, hi), _stack(batch.column("xb"), lo, hi))
                lo = hi
        if now and now.sums is not None:
            yield now.batch(width)

    head_first = F.col("pa").isNull()
    return (pairs.repartition(*key).sortWithinPartitions(*key, head_first).mapInArrow(partial, PAIR_SUMS).groupBy("chrom", "ta", "tb", "i", "j")
            .agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]))


def finish_pairs(sums: DataFrame, tiles: DataFrame, min_r2: float) -> DataFrame:
    """Correlation from sums, with the names of the variants."""
    side = {s: tiles.select("chrom", F.col("tile").alias(t), F.col("idx").alias(s), F.col("variant").alias(n)) for s, t, n in (("i", "ta", "a"), ("j", "tb", "b"))}
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    r = F.when((F.col("n") > 0) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    strong = sums.withColumn("r", r).withColumn("r2", F.col("r") * F.col("r")).filter(F.col("r2") >= min_r2)
    return (strong.join(side["i"], ["chrom", "ta", "i"]).join(side["j"], ["chrom", "tb", "j"])
            .select("chrom", "a", "b", F.col("n").cast("long").alias("n"), "r", "r2"))


IN_ONE_GROUP = 400_000  # live links (both directions) of a locus up to which one task finishes it


def clump(assoc: DataFrame, edges: DataFrame, locus: str, ident: str, order: Column, *, p: str, p1: float = 5e-8,
          r2: float = 0.001, in_one_group: int = IN_ONE_GROUP) -> DataFrame:
    """Index variants of greedy clumping, per locus.

    Going down the list in `order` (ties by the variant's name), a variant still alive becomes an index and takes its
    neighbours (r2 at or above the cut) out. A locus whose live links fit a bound is finished by one task, whatever
    the length of its chains. A larger one goes through a round for all its variants at once: every live variant that comes first among
    its live neighbours is an index, since nothing alive could take it out; its neighbours go. Then its size is looked at again.
    """
    named = assoc.filter(F.col(p) <= p1).select(F.col(locus).alias("locus"), F.col(ident).alias("v"), F.struct(order.alias("o"), F.col(ident).alias("v")).alias("o"))
    live = cut_lineage(named.groupBy("locus", "v").agg(F.min("o").alias("o")))
    e = edges.filter(F.col("r2") >= r2).select("a", "b")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    va = live.select("locus", F.col("v").alias("a"), F.col("o").alias("oa"))
    vb = live.select("locus", F.col("v").alias("b"), F.col("o").alias("ob"))
    links = cut_lineage(both.join(va, "a").join(vb, ["locus", "b"]).select("locus", "a", "oa", "b", "ob"))
    chosen = []
    while True:
        large = cut_lineage(links.groupBy("locus").count().filter(F.col("count") > in_one_group).select("locus"))
        if large.isEmpty():
            chosen.append(_finished(live, links))
            discard(large)
            break
        chosen.append(cut_lineage(_finished(live.join(large, "locus", "left_anti"), links.join(large, "locus", "left_anti"))))
        spent = [live, links, large]
        live, links = live.join(large, "locus", "left_semi"), links.join(large, "locus", "left_semi")
        first = links.groupBy("locus", "a").agg(F.min("ob").alias("best"))
        lead = (live.join(first.withColumnRenamed("a", "v"), ["locus", "v"], "left")
                .filter(F.col("best").isNull() | (F.col("o") < F.col("best"))).select("locus", "v"))
        lead = cut_lineage(lead)
        chosen.append(lead)
        taken = links.join(lead.select("locus", F.col("v").alias("a")), ["locus", "a"], "left_semi").select(
            "locus", F.col("b").alias("v"))
        gone = cut_lineage(taken.unionByName(lead).distinct())
        live = cut_lineage(live.join(gone, ["locus", "v"], "left_anti"))
        links = (links.join(gone.withColumnRenamed("v", "a"), ["locus", "a"], "left_anti")
                 .join(gone.withColumnRenamed("v", "b"), ["locus", "b"], "left_anti"))
        links = cut_lineage(links.select("locus", "a", "oa", "b", "ob"))
        discard(gone, *spent)
    return reduce(DataFrame.unionByName, chosen).select(F.col("locus").alias(locus), F.col("v").alias(ident))


def _finished(live: DataFrame, links: DataFrame) -> DataFrame:
    """Index variants of loci with a bounded number of links: ranks within the locus, then the list is gone down once."""
    ends = links.select("locus", F.col("a").alias("v"), F.col("oa").alias("o")).distinct()
    ranked = ends.withColumn("r", F.row_number().over(Window.partitionBy("locus").orderBy("o")) - 1)
    pairs = links.filter("oa < ob").join(ranked.select("locus", F.col("v").alias("a"), F.col("r").alias("ra")), ["locus", "a"])
    pairs = pairs.join(ranked.select("locus", F.col("v").alias("b"), F.col("r").alias("rb")), ["locus", "b"])
    packed = pairs.groupBy("locus").agg(F.collect_list("ra").alias("ra"), F.collect_list("rb").alias("rb"))

    @F.pandas_udf("array<int>")
    def indices(ra: pd.Series, rb: pd.Series) -> pd.Series:
        return pd.Series([_go_down(np.asarray(a), np.asarray(b)) for a, b in zip(ra, rb, strict=True)])

    kept = packed.select("locus", F.explode(indices("ra", "rb")).alias("r")).join(ranked, ["locus", "r"]).select("locus", "v")
    return kept.unionByName(live.join(ends, ["locus", "v"], "left_anti").select("locus", "v"))


def _go_down(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks that stay when, in rising order, each rank still alive takes its later neighbours out."""
    n = int(second.max()) + 1
    by = np.argsort(first, kind="stable")
    cut, later = np.searchsorted(first[by], np.arange(n + 1)), second[by]
    alive = np.ones(n, bool)
    for r in range(n):
        if alive[r]:
            alive[later[cut[r]:cut[r + 1]]] = False
    return np.flatnonzero(alive).astype(np.int32)


def clump_or_strongest(assoc: DataFrame, edges: DataFrame, panel: DataFrame, locus: str, ident: str, order: Column, *,
                       p: str, strength: str, p1: float = 5e-8, r2: float = 0.001) -> DataFrame:
    """Clump the variants that have an id in the reference panel; a locus with none keeps its strongest variant."""
    usable = assoc.filter(F.col(ident).isNotNull()).join(panel.select(ident).distinct(), ident, "left_semi")
    index = clump(usable, edges, locus, ident, order, p=p, p1=p1, r2=r2)
    kept = assoc.join(index, [locus, ident], "left_semi").withColumn("fallback", F.lit(False))
    rest = assoc.join(index.select(locus).distinct(), locus, "left_anti")
    cols = [c for c in assoc.columns if c != locus]
    best = rest.groupBy(locus).agg(F.max_by(F.struct(*cols), F.struct(F.col(strength), F.col("pos"))).alias("r"))
    return kept.unionByName(best.select(locus, *[F.col(f"r.{c}").alias(c) for c in cols]).withColumn("fallback", F.lit(True)))


def cross_platform_ld(edges: DataFrame, instruments: DataFrame, ident: str = "variant", strong: float = 0.2) -> DataFrame:
    """Pairs of instruments of different platforms: one row per edge."""
    a = instruments.select(F.col(ident).alias("a"), F.col("platform").alias("platform_a"))
    b = instruments.select(F.col(ident).alias("b"), F.col("platform").alias("platform_b"))
    j = edges.join(a, "a").join(b, "b").filter(F.col("platform_a") != F.col("platform_b"))
    return j.select("a", "platform_a", "b", "platform_b", "r2", (F.col("r2") > strong).alias("strong"))


def best_partner(cross: DataFrame, instruments: DataFrame, ident: str = "variant", strength: str = "F") -> DataFrame:
    """Each platform's strongest instrument and its best r2 with any instrument of another platform."""
    top = instruments.groupBy("platform").agg(F.max_by(F.struct(ident, strength), F.struct(strength, ident)).alias("t")).select(
        "platform", F.col(f"t.{ident}").alias(ident), F.col(f"t.{strength}").alias(strength))
    ends = cross.select(F.col("a").alias(ident), F.col("platform_a").alias("platform"), "r2").unionByName(
        cross.select(F.col("b").alias(ident), F.col("platform_b").alias("platform"), "r2"))
    best = ends.groupBy("platform", ident).agg(F.max("r2").alias("max_cross_r2"))
    return top.join(best, ["platform", ident], "left")


# Consequence terms that change the protein.
CODING_TERMS = ("missense_variant", "stop_gained", "stop_lost", "start_lost", "frameshift_variant", "inframe_insertion",
                "inframe_deletion", "protein_altering_variant", "coding_sequence_variant", "splice_acceptor_variant",
                "splice_donor_variant")


def annotate_consequences(instruments: DataFrame, annotation: DataFrame, ident: str = "variant") -> DataFrame:
    """Consequence terms per instrument from an annotation table (id, transcripts: array of structs with
    an array of terms), and whether any of them is coding. NULL where the variant is not annotated."""
    terms = F.array_sort(F.array_distinct(F.flatten(F.transform("transcripts", lambda t: t["terms"]))))
    coding = F.size(F.array_intersect(terms, F.array(*[F.lit(t) for t in CODING_TERMS]))) > 0
    ann = annotation.select(ident, terms.alias("consequences"), coding.alias("coding"))
    return instruments.join(ann, ident, "left")


def coding_verdict(annotated: DataFrame, a: str, b: str) -> DataFrame:
    """Coding counts per platform and a three-way verdict."""
    def count(p: str) -> Column:
        return F.count_if((F.col("platform") == p) & F.col("coding"))

    g = annotated.agg(F.count_if(F.col("coding").isNotNull()).alias("n_annotated"), count(a).alias(f"coding_{a}"), count(b).alias(f"coding_{b}"))
    ca, cb = F.col(f"coding_{a}"), F.col(f"coding_{b}")
    return g.withColumn("verdict", F.when((ca == 0) & (cb == 0), "none_coding").when(ca > cb, f"concentrated_on_{a}")
                        .otherwise("coding_present"))
