"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's documents share one expected number of copies, target / size.  The whole
part is certain; the fractions are rounded pairwise: of two documents, words move from
one to the other, in a random direction whose odds keep both expectations, until one
fraction is 0 or 1.  The words expected in total never change, so a source ends within
one document of its target.

The pairs form a reduction tree.  A leaf holds some fifty documents by hash, folds them
and passes its one unsettled document on; fifty leaves make the next group.  No group
grows with a source, and all randomness is hashed from keys, so reruns agree.

What a leaf passes on tends to be long, since of two documents the shorter one settles.  So a few
documents of every size class of a source stay out of the leaves and join the last group only.
There each document, from long to short, is paired with all shorter ones together, who give or take
in proportion to their room, until it is settled; the document left over is the shortest.

Texts are read once.  The tree holds numbered rows of a few numbers each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import discard, load, materialize, named, seeded, words
from loomgraph.operators.graph import assign_ids

#: Documents, or unsettled documents of lower groups, in a group of the tree on average.
FANOUT = 48
#: Documents of a size class (a power of two words) that wait for the last group, on average: at least, for each
#: time that the next longer class's words exceed its own, and at most.
RESERVE, RESERVE_STEP, RESERVE_MOST = 12, 4, 4096
#: Parts that a source's rows, and rows of one key and size, are dealt to.
SALTS = 32
_SURE = 1e-12


def source_targets(sizes: DataFrame, share: float, most: float, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources in order of code points, null last, weigh ``cycle`` repeating.  They share
    ``share`` times all sizes by weight; a target stops at ``most`` times its source's
    size and the excess goes to the others by weight.  There may be very many sources: they are
    numbered by ranges, and the level is found by sums over the sources not yet at their limit.
    """
    rows = assign_ids(sizes.select("source", F.col("source_size").cast("long").alias("source_size")), [F.col("source").asc_nulls_last()], "_i")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in cycle]), (F.col("_i") % len(cycle) + 1).cast("int"))
    rows = materialize(rows.select("source", "source_size", weight.alias("_w")))
    whole = rows.agg(F.sum("source_size"), F.sum("_w")).first()
    total, level, capped = share * (whole[0] or 0), 0.0, -1
    # A source at its limit stays there as the level rises, and every round but the last adds one.
    full = F.lit(False)
    while True:
        r = rows.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("_w")))).first()
        if r[0] == capped or not r[2]:
            break
        capped, level = r[0], (total - most * (r[1] or 0)) / r[2]
        full = F.lit(level) * F.col("_w") >= most * F.col("source_size")
    limit = most * F.col("source_size")
    target = limit if not whole[1] or not r[2] else F.least(limit, F.lit(level) * F.col("_w"))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def _uniform(h: Column, level: int) -> Column:
    return F.abs(F.xxhash64(h, F.lit(level)) % F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold(items: Column) -> Column:
    """Settles all items of a group but one at most.

    Items have u, p (fraction) and a (words).  Gives an array of (i, p) in the items' order;
    p is 0 or 1 but for the unsettled item.
    """
    state = "struct<i:int,p:double,a:double,k:int,out:array<struct<i:int,p:double>>>"
    start = F.struct(F.lit(-1).alias("i"), F.lit(0.0).alias("p"), F.lit(1.0).alias("a"), F.lit(0).alias("k"), F.array().cast("array<struct<i:int,p:double>>").alias("out")).cast(state)

    def step(s: Column, x: Column) -> Column:
        # Words that can move to the held item (up) and from it (down).
        up = F.least(s.a * (1 - s.p), x.a * x.p)
        down = F.least(s.a * s.p, x.a * (1 - x.p))
        moved = F.when(x.u * (up + down) < down, up).otherwise(-down)
        held = F.round(s.p + moved / s.a, 12)
        other = F.round(x.p - moved / x.a, 12)
        held_settled, other_settled = (held <= _SURE) | (held >= 1 - _SURE), (other <= _SURE) | (other >= 1 - _SURE)
        one = lambda i, p: F.array(F.struct(i.alias("i"), p.alias("p")))
        make = lambda i, p, a, out: F.struct(i.cast("int").alias("i"), p.alias("p"), a.alias("a"), (s.k + 1).alias("k"), out.alias("out")).cast(state)
        return (
            F.when(s.i < 0, make(s.k, x.p, x.a, s.out))
            .when(held_settled & other_settled, make(F.lit(-1), F.lit(0.0), F.lit(1.0), F.concat(s.out, one(s.i, F.round(held)), one(s.k, F.round(other)))))
            .when(held_settled, make(s.k, other, x.a, F.concat(s.out, one(s.i, F.round(held)))))
            .otherwise(make(s.i, held, s.a, F.concat(s.out, one(s.k, F.round(other)))))
        )

    rest = lambda s: F.array_sort(F.when(s.i < 0, s.out).otherwise(F.concat(s.out, F.array(F.struct(s.i.alias("i"), s.p.alias("p"))))))
    return F.aggregate(items, start, step, rest)


def _settle(items: Column) -> Column:
    """Settles all items of the last group but the shortest, each against the rest together; as ``_fold`` otherwise.

    Moving words between an item and the rest changes all fractions of the rest by one straight line, so the
    state holds that line and two sums, not the fractions.
    """
    total = lambda f: F.aggregate(items, F.lit(0.0), lambda s, x: s + f(x))
    fields = lambda scale, shift, words, mass, out: F.struct(scale.alias("scale"), shift.alias("shift"), words.alias("words"), mass.alias("mass"), out.alias("out"))
    start = fields(F.lit(1.0), F.lit(0.0), total(lambda x: x.a), total(lambda x: x.a * x.p), F.array().cast("array<double>"))

    def step(s: Column, x: Column) -> Column:
        p, words, mass = s["scale"] * x.p + s["shift"], s["words"] - x.a, s["mass"] - x.a * x.p
        held = F.greatest(F.lit(0.0), s["scale"] * mass + s["shift"] * words)
        room = F.greatest(F.lit(0.0), words - held)
        up, down = F.least(x.a * (1 - p), held), F.least(x.a * p, room)
        # What the rest can settle in one direction only goes there, lest a document longer than all that a
        # source has to round decides by luck.
        pays, takes = held >= x.a * (1 - p), room >= x.a * p
        rises = F.when(pays != takes, pays).otherwise(x.u * (up + down) < down)
        own = F.round(p + F.when(rises, up).otherwise(-down) / x.a, 12)
        part = F.when(rises, F.when(held > 0, up / held).otherwise(0.0)).otherwise(F.when(room > 0, down / room).otherwise(0.0))
        return fields(s["scale"] * (1 - part), s["shift"] * (1 - part) + F.when(rises, 0.0).otherwise(part), words, mass, F.concat(s["out"], F.array(own)))

    done = F.aggregate(items, start, step, lambda s: s["out"])
    snap = lambda p: F.when(p <= 1e-9, 0.0).when(p >= 1 - 1e-9, 1.0).otherwise(p)
    return F.transform(done, lambda p, i: F.struct(i.alias("i"), snap(p).alias("p")))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``_no``: 0 and up among rows of one source, key and size, whose luck would be one otherwise.

    Which of them has which number does not matter.  Very many of them are numbered in parts.
    """
    same = ["_s", "_k", "_size"]
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    counts = rows.groupBy(*same, "_part").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    many = counts.groupBy(*same).agg(F.sum("_c").alias("_all")).filter("_all > 1").drop("_all")
    key = lambda c: F.struct(*[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in same], *[F.col(x).isNull() for x in same]).alias(c)
    offsets = counts.withColumn("_first", F.coalesce(F.sum("_c").over(before), F.lit(0))).select(key("_key"), "_part", "_first").join(many.select(key("_key")), "_key", "left_semi")
    within = F.row_number().over(Window.partitionBy(*same, "_part").orderBy("_id")) - 1
    return rows.withColumn("_no", within).withColumn("_key", key("_key")).join(offsets, ["_key", "_part"], "left").withColumn("_no", F.col("_no") + F.coalesce("_first", F.lit(0))).drop("_key", "_first", "_part")


def mix_sources(docs: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple[int, ...] = (3, 1, 2), seed: int = 11, key: str = "doc_id", source: str = "source", size: Column | None = None) -> DataFrame:
    """All rows and columns of ``docs`` plus _size, _source_size, _target and _copies (0 to ceil(most)).

    ``size`` defaults to the words of column ``text``.  A null source is a source of its
    own, a null text has size 0.  Rows of size 0 take part with the whole part of their
    source's ratio, since they carry no words.  Rows that agree in source, key and size
    may be exchanged.  An empty table gives an empty one.  Columns of ``docs`` named like a result give
    way to it.
    """
    size = F.size(words(F.col("text"))) if size is None else size
    names = named(docs, "_size", "_source_size", "_target", "_copies", used=(key, source))
    base = docs.select(F.struct(*names).alias("_row"), F.col(source).alias("_s"), F.col(key).cast("string").alias("_k"), size.cast("long").alias("_size"))
    base = materialize(base.withColumn("_id", F.monotonically_increasing_id()))
    rows = _numbered(base.select("_id", "_s", "_k", "_size"))
    band = F.when(F.col("_size") > 0, F.floor(F.log2(F.col("_size").cast("double"))).cast("int")).otherwise(-1)
    rows = rows.select("_id", "_s", "_size", seeded(seed, F.col("_k"), F.col("_size"), F.col("_no")).alias("_h"), band.alias("_band"))
    per_band = rows.groupBy("_s", "_band").agg(F.sum("_size").alias("source_size"), F.count("*").alias("_n"))
    # Without documents somewhat shorter than the longest, more of the next ones must wait to settle it.
    gap = F.pow(F.lit(2.0), F.lead("_band").over(Window.partitionBy("_s").orderBy("_band")) - F.col("_band"))
    wait = F.greatest(F.lit(RESERVE), F.least(F.lit(RESERVE_MOST), RESERVE_STEP * F.coalesce(gap, F.lit(0.0))))
    per_band = materialize(per_band.withColumn("_wait", wait.cast("double")))
    per_source = per_band.groupBy(F.col("_s").alias("source")).agg(F.sum("source_size").alias("source_size"), F.sum(F.when(F.col("_band") >= 0, F.col("_n")).otherwise(0)).alias("_all"))
    per_source = materialize(per_source)
    plan = source_targets(per_source.select("source", "source_size"), share, most, cycle)
    plan = plan.join(per_source.select(F.col("source").alias("_t"), "_all"), F.col("source").eqNullSafe(F.col("_t"))).drop("_t")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.select("source", "source_size", "target", "_all", F.floor(ratio).cast("int").alias("_base"), (ratio - F.floor(ratio)).alias("_p"))
    plan = plan.join(per_band.select("_s", "_band", "_n", "_wait"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = materialize(plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("_band", "_b"))
    salted = rows.withColumn("_salt", F.pmod("_h", F.lit(SALTS)).cast("int"))
    rows = salted.join(plan, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_band") == F.col("_b")) & (salted["_salt"] == plan["_salt"])).drop("_salt", "_b")
    waits = F.col("_h") / F.lit(float(1 << 60)) < F.col("_wait") / F.col("_n")
    leaves = F.greatest(F.lit(1), F.ceil(F.col("_all") / FANOUT))
    group = F.when(waits, F.lit(-1)).otherwise(F.pmod(F.xxhash64("_h", F.lit(seed)), leaves))
    rows = rows.select("_id", "source", "_size", "source_size", "target", "_base", "_h", F.when(F.col("_size") > 0, F.col("_p")).otherwise(0.0).alias("_p"), group.alias("_g"))
    rows = materialize(rows)
    open_row = (F.col("_p") > _SURE) & (F.col("_p") < 1 - _SURE)
    level, reserve, done = rows.filter(open_row & (F.col("_g") >= 0)), rows.filter(open_row & (F.col("_g") < 0)), []
    small = ["source", "_id", "_size", "_h", "_p", "_g"]
    level, reserve = level.select(*small), reserve.select(*small[:-1], F.lit(0).cast("long").alias("_g"))
    discard(per_band, plan)
    groups, step = max(1, -(-(per_source.agg(F.max("_all")).first()[0] or 0) // FANOUT)), 0
    while True:
        if groups == 1:
            level = level.unionByName(reserve)
        item = F.struct((-F.col("_size")).alias("order"), F.col("_h").alias("h"), _uniform(F.col("_h"), step).alias("u"), F.col("_p").alias("p"), F.col("_size").cast("double").alias("a"), "_id", "_size")
        folded = level.groupBy("source", "_g").agg(F.sort_array(F.collect_list(item)).alias("_items"))
        folded = folded.withColumn("_out", (_settle if groups == 1 else _fold)(F.transform("_items", lambda x: F.struct(x.u.alias("u"), x.p.alias("p"), x.a.alias("a")))))
        each = folded.select("source", "_g", F.explode(F.arrays_zip("_items", "_out")).alias("_x"))
        each = each.select("source", F.col("_x._items._id").alias("_id"), F.col("_x._items._size").alias("_size"), F.col("_x._items.h").alias("_h"), F.col("_x._out.p").alias("_p"), F.floor(F.col("_g") / FANOUT).alias("_g"))
        each = materialize(each)
        done.append(each.filter(~open_row).select("_id", F.round("_p").cast("int").alias("_up")))
        level = each.filter(open_row)
        if groups == 1:
            break
        groups, step = -(-groups // FANOUT), step + 1
    done.append(level.select("_id", (_uniform(F.col("_h"), -1) < F.col("_p")).cast("int").alias("_up")))
    up = done[0]
    for d in done[1:]:
        up = up.union(d)
    numbers = rows.join(up, "_id", "left").select("_id", "source_size", "target", (F.col("_base") + F.coalesce("_up", F.round("_p").cast("int"))).alias("_copies"))
    return base.join(numbers, "_id").select("_row.*", "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_copies")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", F.size(words(F.col("text"))).alias("n_words"))
    out = mix_sources(docs, size=F.col("n_words"))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))
