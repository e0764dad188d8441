"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A sketch has three subtables of cells; a paragraph digest goes to one cell of each. A cell keeps the
count, the xor of its digests and the xor of their checks. Sketches of two versions subtract cell by cell:
shared paragraphs cancel. Peeling then takes one subtable at a time: a cell that holds a single digest
gives it up, and the digest leaves its cells in all subtables. Pairs whose cells don't empty are tried
again with a larger sketch, until none is left.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, small, text_or_empty

SUBTABLES, WIDTH, GROWTH = 3, 32, 4
#: Rows that a stretch of the doc_id order has on average, and the most stretches there are.
STRETCH_ROWS, STRETCHES = 512, 1 << 16
#: What a blank line holds at most.
BLANKS = " \t\r\v\f"
#: Documents whose sketches a task builds and peels at most, on average.
PART_ROWS = 8_192


def check_of(digest: Column) -> Column:
    return F.hash(F.lit(41), digest).cast("long")


def cell_of(digest: Column, subtable: int, width: int) -> Column:
    return (F.lit(subtable * width) + F.pmod(F.xxhash64(F.lit(subtable), digest), F.lit(width))).cast("int")


def digests(text: Column) -> Column:
    """The distinct digests of the paragraphs (lines that are not blank)."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def ring(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text: the text of the next document by descending doc_id, after the last the first.

    The order is cut at quantiles of doc_id into stretches; each stretch also gets the head of the one
    that follows it, so the rows are shuffled once and no task sees more than its stretch. pos counts
    from 0 along the order. Rows with equal doc_id follow a hash of their texts and share a stretch; null doc_ids
    come last, dealt to stretches by that hash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ids = rows.select("doc_id")
    total, named = ids.agg(F.count("*"), F.count("doc_id")).first()
    unnamed = total - named
    side = math.ceil(math.sqrt(max(1, min(STRETCHES, total // STRETCH_ROWS))))
    n = side * side
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n + 1000)).first()[0] if n > 1 else None
    cuts = sorted(cuts or [])
    coarse, fine = cuts[side - 1 :: side], [cuts[i * side : (i + 1) * side - 1] for i in range(side)]

    def above(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda b: b <= F.col("doc_id")))

    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]).cast("array<long>")
    stretch = F.lit(0)
    if cuts:
        outer = above(longs(coarse))
        stretch = outer * side + above(F.element_at(F.array(*[longs(x) for x in fine]), outer + 1))
    parts = min(STRETCHES, unnamed // STRETCH_ROWS + 1)
    hashed = F.shiftright(F.shiftright(F.xxhash64("text"), 40) * F.lit(parts) + F.lit(parts << 23), 24)
    placed = rows.withColumn("stretch", F.when(F.col("doc_id").isNull(), -1 - hashed).otherwise(stretch).cast("int"))
    # at most 2 * STRETCHES rows
    sizes = placed.groupBy("stretch").agg(F.count("*").alias("n"), F.max("doc_id").alias("head")).orderBy(F.desc("stretch")).collect()
    start, follow = 0, []
    for i, r in enumerate(sizes):
        follow.append((r["stretch"], start, sizes[(i + 1) % len(sizes)]["stretch"], sizes[(i + 1) % len(sizes)]["head"]))
        start += r["n"]
    spark = docs.sparkSession
    heads = spark.createDataFrame(follow, "target int, start long, stretch int, head long")
    same = placed["doc_id"].eqNullSafe(heads["head"]) & (placed["stretch"] == heads["stretch"])
    ghosts = placed.join(F.broadcast(heads), same).select("doc_id", "text", F.col("target").alias("stretch"), F.lit(1).alias("ghost"))
    own = Window.partitionBy("stretch").orderBy("ghost", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    both = placed.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    linked = both.withColumns({"next_text": F.lead("text").over(own), "rank": F.row_number().over(own)}).where("ghost = 0")
    starts = heads.select(F.col("target").alias("stretch"), "start")
    return linked.join(F.broadcast(starts), "stretch").select("doc_id", "text", "next_text", (F.col("start") + F.col("rank") - 1).alias("pos"))


def sketch(sets: DataFrame, key: list[str], width: int) -> DataFrame:
    """The non-empty cells of each key's digests: slot, c (count), x (xor of digests), h (xor of checks)."""
    entry = F.explode("digests").alias("x")
    one = sets.select(*key, entry)
    cells = F.explode(F.array(*[cell_of(F.col("x"), s, width) for s in range(SUBTABLES)])).alias("slot")
    spread = one.select(*key, "x", cells)
    return spread.groupBy(*key, "slot").agg(F.count("*").alias("c"), F.bit_xor("x").alias("x"), F.bit_xor(check_of(F.col("x"))).alias("h"))


def subtract(cells: DataFrame, terms: Column) -> DataFrame:
    """Cells of the pairs: terms is an array of (kind, sign) in which a version's sketch takes part."""
    signed = cells.select("pos", "slot", "c", "x", "h", F.inline(terms))
    return signed.groupBy("pos", "kind", "slot").agg(F.sum(F.col("c") * F.col("sign")).alias("c"), F.bit_xor("x").alias("x"), F.bit_xor("h").alias("h")).where("c <> 0 OR x <> 0 OR h <> 0")


def pure(subtable: int, width: int) -> Column:
    """Whether a cell of the subtable holds a single digest."""
    x = F.col("x")
    inside = F.col("slot").between(subtable * width, (subtable + 1) * width - 1)
    return inside & (F.abs("c") == 1) & (check_of(x) == F.col("h")) & (cell_of(x, subtable, width) == F.col("slot"))


def peel(state: DataFrame, width: int) -> DataFrame:
    """Peels all pairs (pos, kind) at once, by one pass over the subtables. Rows with slot -1 are recovered digests: x the
    digest, c the side it is on. Rows with other slots are cells that are not empty yet."""
    for s in range(SUBTABLES):
        x, c = F.col("x"), F.col("c")
        zero = F.lit(0).cast("long")

        def row(slot: Column, of: Column, count: Column, xor: Column, check: Column) -> Column:
            return F.struct(slot.cast("int").alias("slot"), of.alias("of"), count.cast("long").alias("c"), xor.alias("x"), check.alias("h"))

        itself = row(F.col("slot"), F.col("of"), c, x, F.col("h"))
        # a digest leaves its cells of the other subtables; its own cell is simply not passed on
        others = [row(cell_of(x, t, width), zero, -c, x, F.col("h")) for t in range(SUBTABLES) if t != s]
        found = row(F.lit(-1), x, c, zero, zero)
        out = F.when(pure(s, width), F.array(found, *others)).otherwise(F.array(itself))
        moved = state.select("pos", "kind", F.inline(out))
        state = moved.groupBy("pos", "kind", "slot", "of").agg(F.sum("c").alias("c"), F.bit_xor("x").alias("x"), F.bit_xor("h").alias("h")).where("c <> 0 OR x <> 0 OR h <> 0")
    return state


def peeled_out(cells: DataFrame, width: int, scratch: Scratch, level: int) -> tuple[list[DataFrame], DataFrame]:
    """Peels pass by pass until no cell holds a single digest: the tables of recovered digests (pos, kind, x, c), and
    the pairs (pos, kind) that need a larger sketch. Most pairs end with the first pass; later ones read only the
    cells that are left."""
    state = cells.select("pos", "kind", "slot", F.lit(0).cast("long").alias("of"), "c", "x", "h")
    found, turn = [], 0
    while True:
        state = scratch.save(peel(state, width), f"peeled-{level}-{turn}")
        found.append(state.where("slot < 0").select("pos", "kind", F.col("of").alias("x"), "c"))
        state = state.where("slot >= 0")
        if not state.where(reduce(or_, [pure(s, width) for s in range(SUBTABLES)])).limit(1).count():
            break
        turn += 1
    # a digest that was recovered twice, or on no single side, is a false one; only pairs that took more than one pass
    # can have it in two tables
    wrong = found[0].where("abs(c) <> 1").select("pos", "kind")
    if turn:
        late = reduce(DataFrame.unionByName, found[1:]).select("pos", "kind").distinct()
        again = reduce(DataFrame.unionByName, found).join(small(late, late.count()), ["pos", "kind"], "left_semi")
        wrong = wrong.union(again.groupBy("pos", "kind", "x").agg(F.sum("c").alias("c")).where("abs(c) <> 1").select("pos", "kind"))
    return found, state.select("pos", "kind").union(wrong).distinct()


def version_pairs(versions: DataFrame, width: int, parts: int) -> DataFrame:
    """Subtracted sketches of the pairs that versions asks for (columns edit_open, next_open).

    versions has pos and the digests of the text (own), of its edited form (edited) and of the next
    document (next). Rows are dealt by pos once, to a stated number of parts since the rows are few but fan out;
    every aggregation below keeps that partitioning."""
    dealt = versions.repartition(parts, "pos")
    term = lambda kind, sign, on: F.when(F.col(on), F.struct(F.lit(kind).alias("kind"), F.lit(sign).alias("sign")))
    sets = F.array(
        F.struct(F.col("own").alias("digests"), F.array_compact(F.array(term("edit", 1, "edit_open"), term("next", 1, "next_open"))).alias("terms")),
        F.struct(F.col("edited").alias("digests"), F.array_compact(F.array(term("edit", -1, "edit_open"))).alias("terms")),
        F.struct(F.col("next").alias("digests"), F.array_compact(F.array(term("next", -1, "next_open"))).alias("terms")),
    )
    each = dealt.select("pos", F.posexplode(sets).alias("version", "v")).select("pos", "version", "v.digests", "v.terms").where(F.size("terms") > 0)
    cells = sketch(each, ["pos", "version", "terms"], width)
    return subtract(cells, F.col("terms"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and the numbers of paragraphs that the edit removed and added.

    The edited text is the text with its last third of code points replaced by the first as many (or all)
    of the next document's, by descending doc_id. Paragraphs are lines that are not blank (of blanks, tabs and line controls), as a set. A fingerprint
    is the paragraph count and the sketch's non-empty cells, so equal texts have equal ones. Likeness is the
    Jaccard index of the paragraph sets, whose difference peeling recovers from the sketches; two texts
    without paragraphs are alike (1.0). Null texts count as empty; repeated rows each stand in the order; a
    single row follows itself; an empty table gives an empty result; other columns, of any name,
    are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprint")
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    texts = ring(docs).withColumn("edited_text", edited)
    versions = texts.select(
        "doc_id",
        "pos",
        n.cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"),
        digests(F.col("edited_text")).alias("edited"),
        digests(F.col("next_text")).alias("next"),
    )
    versions = scratch.save(versions, "versions")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(versions.count() / PART_ROWS))
    width, level = WIDTH, 0
    open_ = versions.withColumns({"edit_open": F.lit(True), "next_open": F.lit(True)})
    results = []
    while True:
        cells = version_pairs(open_.select("pos", "own", "edited", "next", "edit_open", "next_open"), width, parts)
        found, bad = peeled_out(cells, width, scratch, level)
        bad = scratch.save(bad, f"bad-{level}")
        left = bad.count()
        good = reduce(DataFrame.unionByName, found)
        if left:
            good = good.join(small(bad, left), ["pos", "kind"], "left_anti")
            failed = bad.groupBy("pos").agg(F.max(F.col("kind") == "edit").alias("edit_open"), F.max(F.col("kind") == "next").alias("next_open"))
        results.append(good)
        if not left:
            break
        open_ = versions.join(small(failed, left), "pos")
        width, level = width * GROWTH, level + 1
    recovered = reduce(DataFrame.unionByName, results)
    side = lambda kind, sign: F.count_if((F.col("kind") == kind) & (F.col("c") == sign))
    counted = recovered.groupBy("pos").agg(side("edit", 1).alias("e_own"), side("edit", -1).alias("e_other"), side("next", 1).alias("n_own"), side("next", -1).alias("n_other"))
    pairs = versions.select("pos", F.explode(F.array(F.struct(F.lit(0).alias("version"), F.col("own").alias("digests")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("digests")))).alias("v"))
    cells = sketch(pairs.repartition(parts, "pos").select("pos", "v.version", "v.digests"), ["pos", "version"], WIDTH)
    cell = F.struct("slot", F.concat_ws(".", F.col("slot"), F.col("c"), F.lower(F.hex("x")), F.lower(F.hex(F.col("h").bitwiseAND(0xFFFFFFFF)))).alias("s"))
    listed = lambda v: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("version") == v, cell))), lambda x: x["s"]), ",")
    named = cells.groupBy("pos").agg(listed(0).alias("f0"), listed(1).alias("f1"))

    def likeness(own: str, other: str) -> Column:
        union = F.size("own") + F.coalesce(F.col(other), F.lit(0))
        return F.when(union == 0, 1.0).otherwise((F.size("own") - F.coalesce(F.col(own), F.lit(0))) / union)

    string = lambda f, s: F.concat_ws(":", F.size(s), F.coalesce(F.col(f), F.lit("")))
    return (
        versions.join(counted, "pos", "left")
        .join(named, "pos", "left")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            string("f0", "own").alias("fingerprint"),
            string("f1", "edited").alias("edited_fingerprint"),
            likeness("e_own", "e_other").alias("near_edited"),
            likeness("n_own", "n_other").alias("near_next"),
            F.coalesce("e_own", F.lit(0)).alias("removed"),
            F.coalesce("e_other", F.lit(0)).alias("added"),
        )
    )
