"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source gets the same number of copies in expectation, target
over size of its source.  The fractional parts are rounded dependently: two
documents meet, word mass moves from one to the other at random until one of
them is taken whole or not at all, and the other goes on.  Sums of words are kept
by every move, so that a source ends within one document of its target.  Meetings
happen in a tree: buckets of about ``FAN`` documents leave one document each, and
those meet on the next level.

Random numbers are hashes of the documents that meet, so reruns agree.

Defined results: null text has size 0; documents of size 0 take 0; null sources
are one source, last in order; equal rows are counted first, numbered, and rounded
one by one; the residual of a source goes to the nearer side; an empty table gives no rows; further columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscan.llm import common

FAN = 64
SALTS = 32
BLOCK = 4096  # repeats that one task makes of a row
ROW = "struct<size:bigint,h:bigint,row_h:bigint,doc_id:bigint,base:bigint,source_size:bigint,target:double,mass:double>"
KEPT = ("size", "h", "row_h", "doc_id", "base", "source_size", "target")


def word_count(text: str = "text") -> Column:
    """Number of runs without blank, tab, line break, vertical tab or form feed."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def source_key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("~"))


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Targets of ``sizes(key, source_size, n)``, a row per source.

    Weights repeat over the sources in code point order.  A target is
    ``min(cap * size, level * weight)``, and the level makes them add up to
    ``share`` of all sizes.  With sources in the order of cap over weight, the
    capped ones come first, so running sums give the level.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int") + 1)
    one = Window.partitionBy(F.lit(0))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    limit = F.col("source_size") * F.lit(cap)
    level = (F.col("all") - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (
        F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    return (
        sizes.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("key")) - 1)
        .withColumn("weight", weight)
        .withColumn("ratio", limit / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(one) * F.lit(share))
        .withColumn("level", level)
        .withColumn("pos", F.row_number().over(by_ratio))
        .withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("pos"))).over(one))
        .withColumn("target", F.least(limit, F.coalesce("level", F.lit(float("inf"))) * F.col("weight")))
        .select("key", "source_size", "n", "target")
    )


def _with_mass(row: str, mass: str) -> str:
    fields = ", ".join(f"'{k}', {row}.{k}" for k in KEPT)
    return f"named_struct({fields}, 'mass', {mass})"


def _fold(level: int) -> str:
    """SQL: the documents of a bucket meet one after the other.

    ``c`` is the document that goes on, ``done`` those decided (1 taken, 0 not).
    """
    to_x, to_c = "least(s.c.mass, x.size - x.mass)", "least(s.c.size - s.c.mass, x.mass)"
    u = f"(pmod(xxhash64({level}, s.c.h, x.h), 4503599627370496) / 4503599627370496D)"
    move = (
        f"CASE WHEN {u} * ({to_x} + {to_c}) <= {to_c}"
        " THEN CASE WHEN s.c.mass <= x.size - x.mass THEN 1 ELSE 2 END"
        " ELSE CASE WHEN x.mass <= s.c.size - s.c.mass THEN 3 ELSE 4 END END"
    )
    goes_on = (
        f"CASE k WHEN 1 THEN {_with_mass('x', 'x.mass + s.c.mass')}"
        f" WHEN 2 THEN {_with_mass('s.c', 's.c.mass - (x.size - x.mass)')}"
        f" WHEN 3 THEN {_with_mass('s.c', 's.c.mass + x.mass')}"
        f" ELSE {_with_mass('x', 'x.mass - (s.c.size - s.c.mass)')} END"
    )
    decided = (
        "CASE WHEN k IN (1, 4) THEN named_struct('row', s.c, 'v', IF(k = 4, 1, 0))"
        " ELSE named_struct('row', x, 'v', IF(k = 2, 1, 0)) END"
    )
    return (
        f"aggregate(slice(xs, 2, size(xs)), named_struct('c', xs[0], 'done', CAST(array() AS ARRAY<STRUCT<row:{ROW},v:INT>>)),"
        f" (s, x) -> transform(array({move}), k -> named_struct('c', {goes_on}, 'done', array_append(s.done, {decided})))[0])"
    )


def _repeated(rows: DataFrame, count: str, key: str) -> DataFrame:
    """Every row ``count`` times with its number ``i`` from 0.

    A row of very many repeats is dealt over the tasks in blocks of ``BLOCK``.
    """
    last = F.floor((F.col(count) - 1) / BLOCK)
    blocks = rows.where(F.col(count) > 0).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    begin = F.col("_block") * BLOCK
    numbers = F.sequence(begin, F.least(begin + BLOCK, F.col(count)) - 1)
    return blocks.repartition(key, "_block").withColumn("i", F.explode(numbers)).drop("_block")


def copies(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Copies of every row of ``docs(doc_id, text, source)``: doc_id, h, row_h, size, source_size, target, copies.

    ``row_h`` is the hash of id, source and text of the row; ``h`` differs between
    equal rows as well, so that they meet in different buckets.
    """
    counted = (
        docs.select(
            source_key().alias("key"),
            F.col("doc_id").cast("long").alias("doc_id"),
            word_count().alias("size"),
            row_hash().alias("row_h"),
        )
        .groupBy("key", "doc_id", "size", "row_h")
        .agg(F.count("*").alias("m"))
    )
    number = F.when(F.col("i") == 0, F.col("row_h")).otherwise(F.xxhash64("row_h", "i"))
    rows = common.stored(_repeated(counted, "m", "row_h").withColumn("h", number).drop("m", "i"), "mix-sizes")
    sources = common.stored(
        targets(rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), share, cap, weights),
        "mix-sources",
    )
    most = sources.agg(F.max("n")).first()[0] or 0
    salt = F.pmod(F.col("h"), F.lit(SALTS)).cast("int")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    rated = (
        rows.withColumn("salt", salt)
        .join(salted, ["key", "salt"])
        .withColumn("base", F.floor(rate))
        .withColumn("mass", F.when(rate > F.floor(rate), (rate - F.floor(rate)) * F.col("size")).otherwise(F.lit(0.0)))
        .withColumn("bucket", F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.ceil(F.col("n") / FAN))))
    )
    at = common.stored(
        rated.select("key", "bucket", F.struct(*KEPT, "mass").alias("x")), "mix-rated"
    )
    whole = at.where("x.mass <= 0").select("x.*", F.lit(0).alias("v"))
    parts, at, level, left = [whole], at.where("x.mass > 0"), 0, most
    order = "array_sort(collect_list(x), (a, b) -> CASE WHEN a.size <> b.size THEN IF(a.size > b.size, -1, 1) WHEN a.h < b.h THEN -1 WHEN a.h > b.h THEN 1 ELSE 0 END)"
    while True:
        groups = at.groupBy("key", "bucket").agg(F.expr(order).alias("xs"))
        met = common.stored(groups.select("key", "bucket", F.expr(_fold(level)).alias("s")), f"mix-level{level}")
        parts.append(met.select(F.explode("s.done").alias("d")).select("d.row.*", "d.v"))
        left = -(-left // FAN)
        at = met.select("key", F.floor(F.col("bucket") / FAN).alias("bucket"), F.col("s.c").alias("x"))
        level += 1
        if left <= 1:
            break
    parts.append(at.select("x.*", F.when(F.col("x.mass") * 2 >= F.col("x.size"), 1).otherwise(0).alias("v")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "h", "row_h", "size", "source_size", "target", (F.col("base") + F.col("v")).alias("copies"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """Words that the mix takes of every document."""
    return copies(docs, **settings).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; all columns stay.

    Rows equal in id, source and text share their copies evenly, in the order of
    the hash of all their columns.  Wholly equal rows are counted before they are
    repeated, so no window or task holds all of them.
    """
    taken = common.stored(
        copies(docs, **settings).groupBy(F.col("row_h").alias("h")).agg(
            F.sum("copies").alias("_copies"), F.count("*").alias("_rows")
        ),
        "mix-taken",
    ).where("_copies > 0")
    keyed = docs.select(F.struct("*").alias("_row"), row_hash().alias("h")).join(taken, "h")
    single = keyed.where("_rows = 1").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    alike = (
        keyed.where("_rows > 1")
        .groupBy("h", "_copies", "_rows", F.xxhash64("_row").alias("_whole"))
        .agg(F.first("_row").alias("_row"), F.count("*").alias("_n"))
    )
    before = F.sum("_n").over(Window.partitionBy("h").orderBy("_whole")) - F.col("_n")
    further = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_copies") % F.col("_rows") - before))
    times = F.col("_n") * F.floor(F.col("_copies") / F.col("_rows")) + further
    shared = _repeated(alike.withColumn("_times", times), "_times", "_whole")
    return single.select("_row.*").unionAll(shared.select("_row.*"))
