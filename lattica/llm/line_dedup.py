"""Fuzzy line dedup by MinHash, in DataFrame operations alone.

Equal lines are one to begin with. A line's shingles are the `width` code points that begin at each of its places; each is hashed once,
and each of BANDS * ROWS fixed points of the hash space takes the shingle nearest to it (by exclusive or), which is a minimum under a
permutation of its own. Lines that agree on a band of ROWS minima are candidates; candidates are confirmed by the exact Jaccard
similarity of their shingle sets, and confirmed pairs are joined by a distributed union-find. Of each component the first line, by
document and place, stays.

Within a bucket each line is first compared with the one that has most company in its buckets: the line that the others of a family were
made of, if it is there. Lines of buckets that this leaves in several components also meet in CROSS bands across the first ones, so that
what no band of the first ones brought together isn't missed. Of the buckets that hold several components then, up to TOGETHER lines are
paired with each other; lines of larger ones go through an exact prefix join: in the order of rising frequency, similar sets share one of
their first shingles, at places that leave enough shingles after them. Sketches keep lines that are alike, but less than asked, from being
paired: of each shingle one bit is turned over, so two sketches never differ in more bits than the sets in shingles. Of the pairs between
two components one is tried before the others, so that a family that one link makes whole isn't compared line by line.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

#: Rounds in which one pair between two components is tried before all are, in prefix buckets.
ROUNDS = 1
#: Lines of a bucket that are paired with each other where their sketches allow it: eight million comparisons of sketches, a second or so.
TOGETHER = 4096
#: Shingles of a line that are met at once.
STRIDE = 16
#: Words of 64 bits in a sketch.
WORDS = 8
#: Six bands of three find a pair at similarity 0.8 with probability 0.986, at 0.85 with 0.997, at 0.9 with 0.9996.
BANDS, ROWS = 6, 3
_POINTS = random.Random(20240611)
POINTS = [_POINTS.getrandbits(31) for _ in range(BANDS * ROWS)]
#: Which minima make a band: the first BANDS have none in common, CROSS more take each of theirs from another of the first.
CROSS = 6
TRIPLES = [[b * ROWS + r for r in range(ROWS)] for b in range(BANDS)]
TRIPLES += [[b * ROWS + _POINTS.randrange(ROWS) for b in sorted(_POINTS.sample(range(BANDS), ROWS))] for _ in range(CROSS)]


def wide(line: Column) -> Column:
    """A line in four bytes a code point, so that a shingle is found without a walk from the line's beginning."""
    return F.encode(line, "UTF-32")


def last_start(coded: Column, width: int) -> Column:
    """Where the last shingle begins in wide(line), in bytes from 1. A line shorter than `width` is its own only shingle."""
    return F.greatest(F.octet_length(coded) - F.lit(4 * width - 1), F.lit(1))


def starts(coded: Column, width: int) -> Column:
    return F.sequence(F.lit(1), last_start(coded, width), F.lit(4))


def shingle(coded: Column, start: Column, width: int) -> Column:
    return F.substr(coded, start, F.lit(4 * width))


def shingle_list(line: Column, width: int) -> Column:
    """The shingles of a line in their order, as hashes."""
    # bound by the lambda, the coded line is made once
    return F.element_at(F.transform(F.array(wide(line)), lambda b: F.transform(starts(b, width), lambda i: F.xxhash64(shingle(b, i, width)))), 1)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, row, norm, k1, k2: the lines that hold more than white space. (doc_id, line_no, row) is a line's place."""
    cut = docs.select("doc_id", common.row_key().alias("row"), F.split(F.coalesce("text", F.lit("")), "\n").alias("cut"))
    raw = cut.select("doc_id", "row", F.posexplode("cut").alias("line_no", "line"))
    # most lines have single spaces only, which plain searches find sooner than the pattern
    ragged = F.contains(F.col("line"), F.lit("  "))
    for c in "\t\x0b\x0c\r":
        ragged |= F.contains(F.col("line"), F.lit(c))
    norm = F.lower(F.trim(F.when(ragged, F.regexp_replace("line", common.GAP, " ")).otherwise(F.col("line"))))
    # asked of the line itself: a condition on norm would have norm made twice
    held = raw.where(F.ltrim(F.col("line"), F.lit(" \t\x0b\x0c\r")) != "")
    return held.select("doc_id", "line_no", "row", norm.alias("norm")).select("*", *line_key(F.col("norm")))


def line_key(norm: Column) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(norm).alias("k1"), F.xxhash64(F.lit("line"), norm).alias("k2")]


def overlapping(x: Column, y: Column, shared: Column, similarity: float) -> Column:
    """Whether sets of sizes x and y that share so many have the similarity."""
    return shared >= similarity * (x + y - shared)


def confirmed(pairs: DataFrame, known: DataFrame, similarity: float, width: int) -> DataFrame:
    """Those of pairs(a, b), saved, whose lines in known(id, norm, n) have the similarity, on their whole sets, of n distinct shingles each."""
    known = common.perhaps_in(known, "id", pairs.select(F.explode(F.array("a", "b")).alias("id")))
    p = pairs.join(known.select(F.col("id").alias("a"), F.col("norm").alias("x"), F.col("n").alias("nx")), "a")
    p = p.join(known.select(F.col("id").alias("b"), F.col("norm").alias("y"), F.col("n").alias("ny")), "b").where(F.least("nx", "ny") >= similarity * F.greatest("nx", "ny"))
    shared = F.size(F.array_intersect(shingle_list(F.col("x"), width), shingle_list(F.col("y"), width)))
    # overlapping(), with what is dear to find named, and so found, once
    return p.where(shared >= F.ceil((F.col("nx") + F.col("ny")) * (similarity / (1 + similarity)) - 1e-6)).select("a", "b")


def sketches(each: DataFrame) -> DataFrame:
    """each(id, h), distinct -> id, n, sketch: how many shingles a line has, and for each of some bits whether an odd number falls to it."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(64)).cast("int"))
    word = F.pmod(F.shiftright("h", 6), F.lit(WORDS))
    odd = [F.coalesce(F.bit_xor(F.when(F.col("word") == k, F.col("bit"))), F.lit(0).cast("long")) for k in range(WORDS)]
    return each.select("id", word.alias("word"), bit.alias("bit")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array(*odd).alias("sketch"))


def sketches_allow(l: str, r: str, similarity: float) -> Column:
    """False only where too many shingles are in one of the sets alone."""
    most = (F.col(f"{l}.n") + F.col(f"{r}.n")) * ((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
    halves = [sum((F.bit_count(F.get(f"{l}.sketch", F.lit(k)).bitwiseXOR(F.get(f"{r}.sketch", F.lit(k)))) for k in range(start, start + WORDS // 2)), F.lit(0)) for start in (0, WORDS // 2)]
    # the sizes differ by no more than the sets; most pairs are kept apart by them or by half of their sketches
    return (F.abs(F.col(f"{l}.n") - F.col(f"{r}.n")) <= most) & (halves[0] <= most) & (halves[0] + halves[1] <= most)


def shingles(known: DataFrame, width: int) -> DataFrame:
    """known(id, norm) -> id, h: the distinct shingles of each line."""
    return known.select("id", F.explode(F.array_distinct(shingle_list(F.col("norm"), width))).alias("h"))


def prefixes(open_: DataFrame, similarity: float, width: int) -> DataFrame:
    """open_(id, root, norm) -> h, id, root, n, rest, sketch: the first shingles of each line, n shingles long, of which `rest` stand from h on.

    Sets are put in the order of rising frequency. Of n shingles, similar sets share one of the first n - ceil(similarity * n) + 1; where
    that is the first they share, no more than the rest of either set can be shared.
    """
    each = common.saved(shingles(open_, width))
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    # of a line's shingles only those that another line has can be met, and their places follow from how many stand before them
    shared = each.join(often, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("times", "h"))).alias("inorder"))
    ranked = shared.join(sketches(each), "id").join(open_.select("id", "root"), "id").withColumn("alone", F.col("n") - F.size("inorder"))
    prefix = (F.col("n") - F.ceil(F.col("n") * similarity - 1e-6) + 1).cast("int")
    first = ranked.select("id", "root", "n", "sketch", "alone", F.posexplode(F.slice("inorder", F.lit(1), F.greatest(prefix - F.col("alone"), F.lit(0)).cast("int"))).alias("at", "one"))
    out = common.saved(first.select(F.col("one.h").alias("h"), "id", "root", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"), "sketch"))
    common.free(each)
    return out


def prefix_pairs(first: DataFrame, similarity: float) -> DataFrame:
    """prefixes() -> pairs (a, b, ra, rb) of different roots ra and rb: all that have the similarity, and few others."""
    mixed = first.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    first = common.saved(first.join(mixed, "h"))
    l, r = first.alias("l"), first.alias("r")
    # of two sets the smaller shares one of its first n - ceil(2 similarity / (1 + similarity) * n) + 1, which are fewer
    later = (F.col("l.n") > F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.id") > F.col("r.id")))
    early = F.col("r.rest") >= F.ceil(F.col("r.n") * (2 * similarity / (1 + similarity)) - 1e-6)
    both = l.join(r, (F.col("l.h") == F.col("r.h")) & later & early & (F.col("l.root") != F.col("r.root")) & may_be_alike("l", "r", similarity))
    above = F.col("l.id") > F.col("r.id")
    pair = [F.when(above, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(n) for c, names in (("id", "ab"), ("root", ("ra", "rb"))) for (x, y), n in zip((("l", "r"), ("r", "l")), names, strict=True)]
    return both.select(*pair).distinct()


def may_be_alike(l: str, r: str, similarity: float) -> Column:
    return overlapping(F.col(f"{l}.n"), F.col(f"{r}.n"), F.least(f"{l}.rest", f"{r}.rest") + F.lit(1e-6), similarity) & sketches_allow(l, r, similarity)


def renamed(df: DataFrame, roots: DataFrame, *columns: str) -> DataFrame:
    """df with the roots in `columns` as those that components() has since found for them."""
    for c in columns:
        df = df.join(roots.select(F.col("node").alias(c), F.col("root").alias("_now")), c, "left").withColumn(c, F.coalesce("_now", c)).drop("_now")
    return df


def tried(pairs: DataFrame, known: DataFrame, turn: int, similarity: float, width: int) -> DataFrame:
    """Of pairs(a, b, ra, rb) one between two components, another one at each turn, if it is confirmed."""
    by = F.struct(F.xxhash64(F.lit(turn), "a", "b").alias("by"), "a", "b", "ra", "rb")
    one = common.saved(pairs.groupBy(F.least("ra", "rb"), F.greatest("ra", "rb")).agg(F.min(by).alias("one")).select("one.a", "one.b", "one.ra", "one.rb"))
    return common.saved(one.join(confirmed(one.select("a", "b"), known, similarity, width), ["a", "b"]))


def joined_up(first: DataFrame, known: DataFrame, similarity: float, width: int) -> tuple[DataFrame, DataFrame]:
    """(links, first with the roots that follow from them): a few rounds in which the lines of a shingle are compared with one of them.

    Most of a dense family is one component by then, so prefix_pairs() has few pairs of different components left.
    """
    links = None
    for k in range(ROUNDS):
        lead = first.groupBy("h").agg(F.min(F.struct(F.xxhash64(F.lit(k), "id").alias("by"), "id", "root", "n", "rest", "sketch")).alias("one"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        both = first.alias("l").join(lead.where("lo <> hi").select("h", "one.*").alias("r"), "h").where((F.col("l.root") != F.col("r.root")) & may_be_alike("l", "r", similarity))
        sure = tried(both.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.col("l.root").alias("ra"), F.col("r.root").alias("rb")), known, k, similarity, width)
        links = sure.select("a", "b") if links is None else links.union(sure.select("a", "b"))
        if sure.isEmpty():
            break
        now = components(sure.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        first, before = common.saved(renamed(first, now, "root")), first
        if k:
            common.free(before)
    return links, first


def linked(pairs: DataFrame, known: DataFrame, similarity: float, width: int) -> DataFrame:
    """pairs(a, b, ra, rb) -> links (a, b) that connect what is similar: one pair between two components, then, where that is no link, the others."""
    between = pairs.withColumn("lo", F.least("ra", "rb")).withColumn("hi", F.greatest("ra", "rb"))
    one = common.saved(between.groupBy("lo", "hi").agg(F.min(F.struct(F.xxhash64("a", "b").alias("by"), "a", "b")).alias("one"), F.count(F.lit(1)).alias("n")).select("lo", "hi", "one.a", "one.b", "n"))
    sure = common.saved(confirmed(one.select("a", "b"), known, similarity, width))
    still = one.where("n > 1").join(sure, ["a", "b"], "left_anti").select("lo", "hi", F.col("a").alias("ta"), F.col("b").alias("tb"))
    rest = common.saved(between.join(still, ["lo", "hi"]).where("a <> ta or b <> tb").select("a", "b").distinct())
    return sure.union(confirmed(rest, known, similarity, width))


def band_keys(minima: Column, bands: slice) -> Column:
    return F.array(*[F.xxhash64(F.lit(b), *[F.get(minima, F.lit(k)) for k in TRIPLES[b]]) for b in range(len(TRIPLES))[bands]])


def banded(each: DataFrame, width: int) -> DataFrame:
    """lines() -> id, k1, k2, copies, minima, keys: one row per distinct line with its minima and the keys of its first BANDS bands.

    A line's shingles are met where the line is read, STRIDE of them for each look-up of the line; what is shuffled are its minima.
    """
    coded = each.select("k1", "k2", wide(F.col("norm")).alias("coded")).withColumn("last", last_start(F.col("coded"), width))
    runs = coded.select("*", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(4 * STRIDE))).alias("at"))
    # behind the last shingle it is met again, which changes no minimum
    met = [F.hash(shingle(F.col("coded"), F.least(F.col("at") + F.lit(4 * i), F.col("last")), width)).alias(f"h{i}") for i in range(STRIDE)]
    nearest = [F.min(F.least(*[F.col(f"h{i}").bitwiseXOR(F.lit(x)) for i in range(STRIDE)])).alias(f"m{k}") for k, x in enumerate(POINTS)]
    begins = F.when(F.col("at") == 1, F.lit(1)).otherwise(F.lit(0)).alias("begins")
    each = runs.select("k1", "k2", begins, *met).groupBy("k1", "k2").agg(F.sum("begins").alias("copies"), *nearest)
    each = each.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "copies", F.array(*[f"m{k}" for k in range(len(POINTS))]).alias("minima"))
    return each.withColumn("keys", band_keys(F.col("minima"), slice(BANDS)))


def bucket_pairs(few: DataFrame, similarity: float) -> DataFrame:
    """few(key, id, root, n, sketch, keys) -> pairs (a, b, ra, rb) of lines that meet in a bucket, have different roots and may be alike.

    `keys` are the buckets of a line. A pair is met in the first that its lines share: whatever others they share, it is there once. A
    bucket whose pairs have been compared, or are found in another way, may be missing in `few`.
    """
    l, r = few.alias("l"), few.alias("r")
    first = F.col("l.key") == F.array_min(F.array_intersect("l.keys", "r.keys"))
    on = (F.col("l.key") == F.col("r.key")) & (F.col("l.id") > F.col("r.id")) & (F.col("l.root") != F.col("r.root")) & sketches_allow("l", "r", similarity) & first
    return l.join(r, on).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.col("l.root").alias("ra"), F.col("r.root").alias("rb"))


def sketched_pairs(pairs: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs(a, b) whose sketches don't keep them apart."""
    p = pairs.join(sketched.select(F.col("id").alias("a"), F.struct("n", "sketch").alias("l")), "a").join(sketched.select(F.col("id").alias("b"), F.struct("n", "sketch").alias("r")), "b")
    return p.where(sketches_allow("l", "r", similarity)).select("a", "b")


def near_roots(each: DataFrame, distinct: DataFrame, similarity: float, width: int) -> DataFrame:
    """lines() and banded() of them, saved -> (node, root) for the ids of lines that are like another: root is the smallest of a component."""
    rows = distinct.select("id", F.explode(band_keys(F.col("minima"), slice(BANDS))).alias("key"))
    met = rows.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most")
    met = common.saved(met.select("key", "least", "n"))
    buckets = common.saved(common.perhaps_in(rows, "key", met.select("key")).join(met, "key"))
    active = common.saved(distinct.select("id", "k1", "k2").join(buckets.groupBy("id").agg(F.sum("n").alias("company")), "id"))
    texts = common.perhaps_in(each.select("k1", "k2", "norm"), "k1", active.select("k1"))
    bare = common.saved(texts.join(active.drop("company"), ["k1", "k2"]).dropDuplicates(["id"]).select("id", "norm"))
    sketched = common.saved(sketches(shingles(bare, width)))
    known = common.saved(bare.join(sketched.select("id", "n"), "id"))
    # a bucket of two has one pair
    many = buckets.where("n > 2").join(active.select("id", "company"), "id")
    centres = many.groupBy("key").agg(F.max(F.struct("company", "id"))["id"].alias("centre"))
    many = common.saved(many.join(centres, "key").select("key", "id", "centre"))
    stars = buckets.where("n = 2 and id <> least").select("id", F.col("least").alias("centre")).union(many.where("id <> centre").select("id", "centre"))
    stars = stars.select(F.greatest("id", "centre").alias("a"), F.least("id", "centre").alias("b")).distinct()
    first = common.saved(confirmed(common.saved(sketched_pairs(stars, sketched, similarity)), known, similarity, width))
    common.free(met, buckets, active, bare)
    roots = components(first)
    now = many.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    mixed = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    open_ = common.saved(now.join(mixed, "key").select("id", "root").distinct())
    common.free(many)
    every = common.saved(open_.join(distinct.select("id", "minima"), "id").select("id", "root", F.explode(band_keys(F.col("minima"), slice(None))).alias("key")))
    mixed = every.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("lines")).where("lo <> hi").select("key", "lines")
    every, before = common.saved(every.join(mixed, "key")), every
    common.free(before, open_)
    few = every.where(F.col("lines") <= TOGETHER)
    few = few.join(sketched.join(few.groupBy("id").agg(F.collect_list("key").alias("keys")), "id"), "id").select(F.col("key").alias("h"), "id", "root", "n", F.col("n").alias("rest"), "sketch", "keys")
    few = common.saved(few)
    links, heads = joined_up(few, known, similarity, width)
    pairs = bucket_pairs(heads.withColumnRenamed("h", "key"), similarity)
    large, spent = every.where(F.col("lines") > TOGETHER).select("id", "root").distinct(), [every, few, known, sketched]
    if not large.isEmpty():
        whole = common.saved(large.join(known.drop("n"), "id"))
        more, first_ones = joined_up(prefixes(whole, similarity, width), known, similarity, width)
        links, pairs = links.union(more), pairs.union(prefix_pairs(first_ones, similarity)).distinct()
        spent.append(whole)
    pairs = common.saved(pairs)
    # links between what is one component already are none between roots
    found = components(renamed(links.union(linked(pairs, known, similarity, width)), roots, "a", "b"))
    out = common.saved(renamed(roots.union(found.select("node", F.col("node").alias("root"))).distinct(), found, "root").select("node", "root"))
    common.free(*spent, pairs)
    return out


def settled(docs: DataFrame, *, similarity: float = 0.8, width: int = 8) -> DataFrame:
    """The rows of line_dedup() with `row`, which tells apart the texts of one doc_id."""
    # most of what is written is text, which this level writes sooner
    each = common.saved(lines(docs), **{"parquet.compression.codec.zstd.level": "1"})
    distinct = common.saved(banded(each, width).drop("keys"))
    roots = near_roots(each, distinct, similarity, width)
    # a line that is there once and like no other stays, and needs no look-up
    looked_up = common.saved(distinct.join(roots.withColumnRenamed("node", "id"), "id", "left").where("copies > 1 or root is not null").select("k1", "k2", "root"))
    common.free(distinct)
    place = F.struct("doc_id", "line_no", "row").alias("place")
    some = common.perhaps_in(each.drop("norm"), "k1", looked_up.select("k1"))
    single = common.saved(some.select(place, "k1", "k2").groupBy("k1", "k2").agg(F.min("place").alias("place")).join(looked_up, ["k1", "k2"], "left"))
    least = single.where("root is not null").groupBy("root").agg(F.min("place").alias("least"))
    alone = single.where("root is null").select("k1", "k2", F.col("place").alias("stay"))
    stays = alone.union(single.join(least, "root").select("k1", "k2", F.col("least").alias("stay")))
    out = some.select("doc_id", "line_no", "row", place, "k1", "k2").join(stays, ["k1", "k2"])
    out = out.select("doc_id", "line_no", "row", F.col("stay.doc_id").alias("keep_doc"), F.col("stay.line_no").alias("keep_line"), (F.col("stay") == F.col("place")).alias("kept"))
    rest = common.surely_not_in(each.drop("norm"), "k1", looked_up.select("k1"))
    out = out.union(rest.select("doc_id", "line_no", "row", F.col("doc_id").alias("keep_doc"), F.col("line_no").alias("keep_line"), F.lit(True).alias("kept")))
    out.uses = [each, single, looked_up]
    return out


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row per line that holds more than white space: doc_id, line_no, keep_doc, keep_line, kept.

    Lines are compared in lower case with white space runs as one space. keep_doc and keep_line name the line that stays in its
    component: the smallest by (doc_id, line_no); a null doc_id counts as the smallest. A line shorter than `width` is its own only
    shingle. Null and empty texts have no lines. Rows that repeat a doc_id with the same text keep the same lines; with different texts,
    and without a doc_id, they are documents of their own. Extra columns aren't read. An empty table gives no rows.
    """
    return settled(docs, **options).drop("row")


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """docs without the lines that don't stay; n_chars, where there is one, follows. No document goes, though its text may end up empty."""
    every = settled(docs, **options)
    gone = common.saved(every.where("not kept").groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(F.collect_set("line_no").alias("_gone")))
    common.free(*every.uses)
    parts = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    own = docs.withColumn("_key", common.row_key())
    out = own.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_row")), "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(common.table(spark, sf_dir, "documents", "doc_id", "text"))
