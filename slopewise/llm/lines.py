"""Line deduplication: fuzzy copies of lines across all documents, one line of each component kept.

Built of DataFrame functions only. A line's shingles are its runs of eight characters. Each shingle is
hashed once; the hash range is cut into sixteen parts, and the four least hashes of a part are a band of the line's MinHash
signature: two lines agree in all four with the fourth power of their Jaccard similarity. The ten bands in use catch a
pair of similarity 0.8 with probability 0.995. Lines of few shingles leave bands empty; those of at most fourteen (21
characters without repeats) have further keys, by which no pair of two such lines is missed.
Candidates are verified by the exact Jaccard similarity of their shingles, and components follow from the links.
Equal lines are one candidate from the start.

Edge cases: a null text has no lines; an empty text has one blank line. Blank lines (white space only) are never
removed and have no class. A line of fewer than eight characters is one shingle, so it is only ever an exact copy.
Of a class the line with the least (doc_id, place of the row, line number) is kept, null doc_ids last. Repeated
document rows are documents of their own, so the lines of the second are copies. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import classes, shared
from .scratch import Scratch, sized

CHARACTERS, SIMILAR = 8, 0.8
BANDS, IN_BAND = 10, 4  # of the sixteen that the hash range has; least hashes in each
FEW = 14  # distinct shingles up to which a line has keys that leave no pair out
BLANK = " \t\n\r\x0b\x0c"


def shingle_hashes(octets: str, characters: int) -> Column:
    """One hash for each run of characters of a line given as UTF-32 octets, four for each character. (The octets are an
    element of an outer array, so that they are read from their row once.)"""
    each = f"xxhash64(substring(b, i, {4 * characters}))"
    return F.expr(f"element_at(transform(array({octets}), b -> transform(sequence(1, greatest(octet_length(b) - {4 * characters - 1}, 1), 4), i -> {each})), 1)")


def signature_bands(lines: DataFrame, characters: int, bands: int) -> DataFrame:
    """`lines` (with `line`), `n` (distinct shingles) and `bands`: a key for each band that has a shingle, and more for lines of few shingles.

    The hash range is cut into sixteen bands, of which the lowest `bands` are in use (hashes are signed). The lower bounds
    of the bands are sorted in among the distinct hashes; the four least hashes of a band are what follows its bound.
    How often a line repeats a shingle does not matter, as it does not in verification.
    """
    bounds = [f"shiftleft({k - 8}L, 60)" for k in range(bands + 1)]
    out = lines.withColumn("octets", F.encode("line", "UTF-32"))
    out = out.withColumn("hashes", F.array_distinct(shingle_hashes("octets", characters)))
    out = out.withColumn("sorted", F.sort_array(F.concat("hashes", F.expr(f"array({', '.join(bounds)})"))))
    out = out.withColumn("at", F.expr(f"array({', '.join(f'cast(array_position(sorted, {x}) as int)' for x in bounds[:-1])})"))
    some = "filter(at, p -> sorted[p] & (shiftleft(1L, 60) - 1L) <> 0)"
    keys = f"transform({some}, p -> xxhash64(slice(sorted, p + 1, {IN_BAND})))"
    return out.select(*lines.columns, F.size("hashes").alias("n"), F.expr(f"if(size(hashes) > {FEW}, {keys}, concat({keys}, {_few_keys('hashes')}))").alias("bands"))


def _few_keys(hashes: str) -> str:
    """Keys of a line of at most FEW distinct shingles; two such lines of Jaccard similarity 0.8 always have one in common.

    Of n and m shingles they share at least four fifths of the larger number, so among the n - 4n/5 + 4 least hashes (rounded
    down) of the one and as many of the other are four that both have: a key for each four of them. Up to three are one key.
    """
    least = f"slice(sort_array({hashes}), 1, {IN_BAND} + size({hashes}) div 5)"
    one = "transform(s, x -> xxhash64(array_remove(s, x)))"
    two = "flatten(transform(s, x -> transform(filter(s, y -> y > x), y -> xxhash64(array_except(s, array(x, y))))))"
    return f"element_at(transform(array({least}), s -> if(size({hashes}) < 5, array(xxhash64(s)), if(size({hashes}) < 10, {one}, {two}))), 1)"


def _split(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`doc_id`, `row`, `digest` (of the text), `line_no` (from 0), `line`."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       F.unhex(F.md5(text_col)).alias("digest"), F.col(text_col).alias("text"))
    return rows.select("doc_id", "row", "digest", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _full(line: str) -> Column:
    """Whether a line has a character that is not white space."""
    return F.ltrim(F.col(line), F.lit(BLANK)) != ""


def _key(line: str = "line") -> Column:
    return F.unhex(F.md5(line))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", characters: int = CHARACTERS,
                 similar: float = SIMILAR, bands: int = BANDS) -> DataFrame:
    """One row for each line: `doc_id`, `row`, `digest` (of its document), `line_no`, `class_doc` and `class_line` (the kept line of its class), `copies`, `kept`."""
    scratch = Scratch(docs.sparkSession)
    full = _full("line")
    places = _split(docs, id_col, text_col)
    places = scratch.table(places.select("doc_id", "row", "digest", "line_no", F.when(full, _key()).alias("key")), "lines")
    texts = docs.select(F.explode(F.split(text_col, "\n", -1)).alias("line")).filter(full)
    nodes = signature_bands(texts.distinct(), characters, bands).withColumn("key", _key())
    nodes = scratch.table(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    members = scratch.table(shared(nodes.select("id", F.explode("bands").alias("bucket"))), "members")
    wanted = scratch.table(members.select("id").distinct(), "wanted")
    found = scratch.table(nodes.select("id", "key", "line", "n").join(sized(wanted), "id"), "texts")
    scratch.drop(wanted)
    wanted = found.select("id", "key")
    wide = "encode(line, 'UTF-32')"

    def verify(pairs: DataFrame) -> DataFrame:
        for k in "ab":
            pairs = pairs.join(found.select(F.col("id").alias(k), F.col("line").alias(f"line_{k}"), F.col("n").alias(f"n{k}")), k)
        for k in "ab":
            pairs = pairs.withColumn(f"s{k}", shingle_hashes(f"encode(line_{k}, 'UTF-32')", characters))
        both = pairs.withColumn("both", F.size(F.array_intersect("sa", "sb")))
        return both.filter(F.col("both") >= similar * (F.col("na") + F.col("nb") - F.col("both")))

    def elements(ids: DataFrame) -> DataFrame:
        hashes = found.join(ids, "id").withColumn("hashes", shingle_hashes(wide, characters))
        return hashes.select("id", F.explode(F.array_distinct("hashes")).alias("element"))

    roots = classes(scratch, members, verify, elements, similar)
    ids = wanted.join(roots, "id")
    merged = ids.select("key", F.col("root").alias("r")).join(wanted.select(F.col("id").alias("r"), F.col("key").alias("class")), "r").select("key", "class")
    merged = scratch.table(merged, "merged")
    lines = places.filter("key is not null").join(sized(merged), "key", "left")
    lines = lines.select("doc_id", "row", "digest", "line_no", F.coalesce("class", "key").alias("class"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"), F.col("line_no"))
    best = lines.groupBy("class").agg(F.min(order).alias("best"), F.count("*").alias("copies")).filter("copies > 1")
    own = ~((F.col("row") == F.col("best.row")) & (F.col("line_no") == F.col("best.line_no")))
    lines = lines.join(best, "class", "left").select(
        "doc_id", "row", "digest", "line_no", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_doc"),
        F.coalesce("best.line_no", "line_no").alias("class_line"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
        (~F.coalesce(own, F.lit(False))).alias("kept"))
    blank = places.filter("key is null").select("doc_id", "row", "digest", "line_no", F.lit(None).cast("long").alias("class_doc"),
                                                F.lit(None).cast("int").alias("class_line"), F.lit(1).cast("long").alias("copies"), F.lit(True).alias("kept"))
    scratch.drop(nodes, members, found, roots)
    return lines.unionByName(blank)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without the lines that are not kept, same columns.

    A document that loses every line that is not blank is left out; so are repeated rows (same doc_id and text) but for
    the first. Documents are found again by doc_id and digest, since a row's number holds for one scan only.
    """
    scratch = Scratch(docs.sparkSession)
    lines = scratch.table(line_classes(docs, id_col, text_col, **options), "kept_lines")
    same = ["doc_id", "digest"]
    spans = lines.groupBy(*same).agg(F.min("row").alias("first"), F.max("row").alias("last"))
    repeated = scratch.table(spans.filter("first < last").select(*same, "first"), "repeated")
    gone = lines.filter("not kept")
    again = not repeated.isEmpty()
    if again:
        gone = gone.join(sized(repeated), _same(gone, repeated), "left").filter("first is null or row = first").select(gone["*"])
    gone = gone.groupBy(*same).agg(F.collect_list("line_no").alias("_gone"))
    gone = scratch.table(gone.withColumnsRenamed({"doc_id": "_id", "digest": "_print"}), "gone")
    out = docs.select(F.struct("*").alias("_own"), F.col(id_col).cast("long").alias("_doc"), F.unhex(F.md5(text_col)).alias("_key"), F.col(text_col).alias("_text"))
    if again:
        plain = ~F.coalesce(_full("_text"), F.lit(False))
        out = out.filter(plain).unionByName(out.filter(~plain).dropDuplicates(["_doc", "_key"]))
    out = out.join(sized(gone, elements=F.size("_gone")), F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_key").eqNullSafe(F.col("_print")), "left")
    out = out.withColumn("_lines", F.split("_text", "\n", -1))
    out = out.withColumn("_rest", F.expr("array_except(sequence(0, size(_lines) - 1), _gone)"))
    out = out.withColumn("_left", F.expr("array_join(transform(_rest, i -> _lines[i]), '\n')"))
    out = out.filter(F.col("_gone").isNull() | _full("_left"))
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.col("_left")).alias(text_col)
    return out.select(*(text if c == text_col else F.col(f"_own.`{c}`") for c in docs.columns))


def _same(x: DataFrame, y: DataFrame) -> Column:
    return x["doc_id"].eqNullSafe(y["doc_id"]) & x["digest"].eqNullSafe(y["digest"])
