"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text is the sequence of its words' hashes.  Its runs of five words, labelled
with their occurrence number, are hashed ``SKETCHES`` times; each time the two
smallest are kept in text order, so that a sketch agrees only if both runs and
their order agree.  Texts with an equal sketch meet in a bucket.

Two texts are near duplicates if words aligned in order make up ``threshold`` of the
longer text.  The alignment is a bit-parallel longest common subsequence of what is
left between the common beginning and end, in a band around the diagonal that is as
wide as the threshold allows, so that the band loses nothing.

Equal word sequences are one node from the start.  All members of a bucket are
compared with one leader, the first in an order of hashes that is the same in every
bucket, so that a cluster has the same leader almost everywhere and a pair is aligned
once.  Links make components.  Members in the leader's component leave the bucket.
What is left of at most ``LEADERS`` + 1 members meets as it is.  Members of a larger
bucket (texts that share a passage) meet in a bucket for each of their rarest words
instead, of which near texts share at least one, so that texts with nothing but the
passage in common do not meet again, however many they are.  In these buckets the members
outside the largest component lead, up to ``LEADERS`` at once and then fourfold each
time, until every one has met all others; texts of one component need not meet.

A member near the leader stays as long as it may be near one that is left: the
number of words to insert and delete is a distance, so only those whose own distance
from the leader is within reach of the nearest one left.  Links within a bucket are
therefore found up to links within a component; only pairs without a common sketch are
missed, which is measured.

Defined results: texts without words are near only to equal texts; texts of fewer
than five words are one run; rows of equal doc_id are told apart by their text;
the class of a document is the smallest doc_id in it (null if none has one); an
empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from folioscan.llm import common

SHINGLE = 5
SKETCHES = 32
LEADERS = 8
SALTS = 8

_rng = np.random.default_rng(20)
_SEED = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)[:, None]
_FACTOR = (_rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1))[:, None]


# -- sketches and alignment ----------------------------------------------------


def _occurrences(h: np.ndarray) -> np.ndarray:
    """For each hash, how many equal ones stand before it."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.zeros(len(h), bool)
    same[1:] = s[1:] == s[:-1]
    at = np.arange(len(h))
    number = np.empty(len(h), np.uint64)
    number[order] = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64)
    return number


def labelled(words: np.ndarray) -> np.ndarray:
    """Runs of words, told apart by occurrence number."""
    h = common.shingles(words, SHINGLE)
    number = _occurrences(h)
    return common.mix64(h + number * common.BASE) if number.any() else h


def _two_smallest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions, in text order, of the two smallest values under each hash function."""
    if len(x) == 1:
        zero = np.zeros(SKETCHES, np.int64)
        return zero, zero
    step = max(1, (1 << 20) // len(x))
    first, second = np.empty(SKETCHES, np.int64), np.empty(SKETCHES, np.int64)
    for a in range(0, SKETCHES, step):
        y = (x[None, :] ^ _SEED[a : a + step]) * _FACTOR[a : a + step]
        rows = np.arange(len(y))
        first[a : a + step] = i = y.argmin(1)
        y[rows, i] = np.uint64(0xFFFFFFFFFFFFFFFF)
        second[a : a + step] = y.argmin(1)
    return np.minimum(first, second), np.maximum(first, second)


def bands(words: np.ndarray) -> np.ndarray:
    """All sketches of a word sequence; none for a text without words."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    x = labelled(words)
    lo, hi = _two_smallest(x)
    return common.mix64(x[lo] * common.BASE + common.mix64(x[hi] + np.uint64(1)))


def _same_ends(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    return int(apart[0]) if len(apart) else n


def aligned(a: np.ndarray, b: np.ndarray, skip_a: int, skip_b: int) -> int:
    """Most words of ``a`` and ``b`` aligned in order.

    Exact if it leaves out at most ``skip_a`` words of a and ``skip_b`` of b, which
    bounds how far a pair may stand off the diagonal.
    """
    same = _same_ends(a, b)
    a, b = a[same:], b[same:]
    end = _same_ends(a[::-1], b[::-1])
    same += end
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not len(a) or not len(b):
        return same
    places: dict[int, int] = {}
    for i, w in enumerate(b.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    band = (1 << (skip_a + skip_b + 1)) - 1
    row = full
    for i, w in enumerate(a.tolist()):
        if w in places:
            low = i - skip_a
            hit = row & places[w] & (band << low if low >= 0 else band >> -low)
            row = (row + hit | row - hit) & full
    return same + len(b) - row.bit_count()


def counted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(words, return_counts=True)


def _common(a: tuple, b: tuple) -> int:
    """Words that two texts have in common in any order."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    hit = b[0][at] == a[0]
    return int(np.minimum(a[1][hit], b[1][at[hit]]).sum())


def compare(a: np.ndarray, b: np.ndarray, threshold: float = 0.8, counts_a: tuple | None = None) -> tuple[bool, int]:
    """Whether two word sequences are near, and a distance.

    The distance, words inserted and deleted, is exact for near ones and a lower bound
    for others.
    """
    if len(a) == 0 or len(b) == 0:
        return False, len(a) + len(b)
    least = int(np.ceil(threshold * max(len(a), len(b)) - 1e-9))
    if min(len(a), len(b)) < least:
        return False, abs(len(a) - len(b))
    most = _common(counts_a or counted(a), counted(b))
    if most >= least:
        n = aligned(a, b, len(a) - least, len(b) - least)
        if n >= least:
            return True, len(a) + len(b) - 2 * n
    return False, len(a) + len(b) - 2 * most


# -- nodes ---------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def _text_key(text: str, words: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(words.tobytes() if len(words) else b"text:" + text.encode("utf-8"))


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, h (hash of the text), key (of the word sequence), n (words), bands."""
    common.bounded_batches(docs.sparkSession, 4 << 20)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("h", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))]
    )

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            words, first = common.word_hashes(batch.column(2))
            keys, sizes, own = [], [], []
            for k in range(batch.num_rows):
                w = words[first[k] : first[k + 1]]
                keys.append(_text_key("" if len(w) else batch.column(2)[k].as_py(), w))
                sizes.append(len(w))
                own.append(bands(w).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys), pa.array(sizes, pa.int64()), pa.array(own, schema.types[4])],
                schema=schema,
            )

    return _keyed(docs).mapInArrow(read, "doc_id long, h long, key binary, n long, bands array<long>")


def _words_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, words): the word sequence of every node of ``reps(key, doc_id, h)``, 4 bytes a word."""
    schema = pa.schema([("key", pa.int64()), ("words", pa.binary())])

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            words, first = common.word_hashes(batch.column(0))
            own = [words[a:b] for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([(w >> np.uint64(32)).astype("<u4").tobytes() for w in own], pa.binary())],
                schema=schema,
            )

    safe = F.coalesce("doc_id", F.lit(-(1 << 63)))
    wanted = reps.select("key", safe.alias("doc_id"), "h")
    found = _keyed(docs).withColumn("doc_id", safe).join(wanted.hint("shuffle_hash"), ["doc_id", "h"])
    return found.select("text", "key").mapInArrow(read, "key long, words binary").dropDuplicates(["key"])


# -- components ----------------------------------------------------------------


def components(edges: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(key, comp): smallest key of the component of every key in ``edges(a, b)``.

    Large and small stars in turn; the links of a key are reduced before they are
    shuffled, and every step is a stored table.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    canonical = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    parts = common.parts_of(edges.sparkSession, edges.count(), 100_000)
    e = scratch.stored(canonical(edges), "stars", parts)
    before = None
    while (now := state(e)) != before:
        before = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = scratch.stored(canonical(large), "stars", parts)
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(least, "a").select("a", "b", "m")
        linked = small.select("b", "m").unionByName(small.select(F.col("a").alias("b"), "m"))
        e = scratch.stored(canonical(linked.select(F.col("b").alias("a"), F.col("m").alias("b"))), "stars", parts)
    roots = e.select(F.col("b").alias("key"), F.col("b").alias("comp")).distinct()
    return e.select(F.col("a").alias("key"), F.col("b").alias("comp")).unionByName(roots)


# -- links ---------------------------------------------------------------------


def _compared(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """``pairs(lead, key)`` with ``near`` and ``d``.

    A leader's words come once to a task and its members' after them.  Leaders of more
    than a thousandth of all pairs are few and are dealt over several tasks.
    """
    schema = pa.schema([("lead", pa.int64()), ("key", pa.int64()), ("near", pa.bool_()), ("d", pa.int64())])
    counts = pairs.groupBy("lead").agg(F.count("*").alias("m"))
    total = pairs.count()
    hot = counts.where(F.col("m") * 1000 > total).select("lead", F.least(F.ceil(F.col("m") / 500), F.lit(1000)).cast("int").alias("salts"))

    def align(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = own = counts = None
        for batch in rows:
            out = []
            for name, key, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                w = np.frombuffer(raw, "<u4")
                if key is None:
                    if name != lead:
                        lead, own, counts = name, w, counted(w)
                    continue
                out.append((name, key, *compare(own, w, threshold, counts)))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    salts = F.coalesce("salts", F.lit(1))
    members = (
        pairs.join(words, "key")
        .join(F.broadcast(hot), "lead", "left")
        .select("lead", F.pmod(F.xxhash64("key"), salts).cast("int").alias("salt"), "key", "words")
    )
    leads = (
        pairs.select("lead").distinct()
        .join(words.withColumnRenamed("key", "lead"), "lead")
        .join(F.broadcast(hot), "lead", "left")
        .select("lead", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(None).cast("long").alias("key"), "words")
    )
    together = members.unionByName(leads).repartition(common.parts_of(pairs.sparkSession, total, 5_000), "lead", "salt")
    return (
        together.sortWithinPartitions("lead", "salt", F.col("key").isNotNull())
        .select("lead", "key", "words")
        .mapInArrow(align, "lead long, key long, near boolean, d long")
    )


def _salted(members: DataFrame, salts: int) -> DataFrame:
    """Members with a salt; other than 0 only in buckets of more than a thousandth of all rows, which are few."""
    total = members.count()
    sizes = members.groupBy("bucket").agg(F.count("*").alias("m"))
    hot = sizes.where((F.col("m") > 1) & (F.col("m") * 1000 > total)).select("bucket", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(salts))).otherwise(0).cast("int")
    return members.join(F.broadcast(hot), "bucket", "left").withColumn("salt", salt)


def _first_led(members: DataFrame, scratch: common.Scratch, parts: int) -> DataFrame:
    """Members with the leader of their bucket, without the leaders themselves.

    A hot bucket is dealt by salt; every salt has a leader, and these are led by the
    first of them.  The first itself, which has not met the members of other salts, stays
    as led by the last.
    """
    place = F.xxhash64("key")
    least = lambda keys, *way: Window.partitionBy(*keys).orderBy(*way or (place, "key"))
    salted = _salted(members, 4 * SALTS)
    by_salt = least(["bucket", "salt"])
    led = salted.withColumns({"lead": F.first("key").over(by_salt), "ln": F.first("n").over(by_salt)})
    at = ["bucket", "key", "n", "lead", "ln"]
    led = scratch.stored(led.where("key <> lead OR hot").select(*at, "hot"), "led", parts)
    up, down = least(["bucket"]), least(["bucket"], place.desc(), F.desc("key"))
    both = lambda c: F.when(F.col("key") == F.first("key").over(up), F.first(c).over(down)).otherwise(F.first(c).over(up))
    first = led.where("key = lead").withColumns({"lead": both("key"), "ln": both("n")})
    return led.select(*at).unionByName(first.select(*at)).where("key <> lead").withColumns(
        {"comp": F.col("key"), "lcomp": F.col("lead")}
    )


def _led(ranked: DataFrame, threshold: float) -> DataFrame:
    """Members with the leaders of their buckets that rank before them; hot buckets are dealt by salt.

    Lengths may differ by the threshold twice: a text that is near one near the leader is among the led.
    """
    salted = _salted(ranked.drop("leads"), SALTS)
    hot = F.broadcast(salted.where("hot").select("bucket", "hot").distinct())
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    each = ranked.where("leads").join(hot, "bucket", "left").select(
        "bucket", F.explode(salts).alias("salt"), F.col("key").alias("lead"), F.col("n").alias("ln"), F.col("comp").alias("lcomp"), F.col("rank").alias("first")
    )
    m, e = salted.alias("m"), each.alias("e")
    met = m.join(e, F.expr("m.bucket = e.bucket AND m.salt = e.salt AND e.first < m.rank") & (F.least("n", "ln") >= threshold**2 * F.greatest("n", "ln") - 1e-9))
    return met.select("m.bucket", "key", "n", "comp", "lead", "ln", "lcomp")


def _ends() -> dict:
    """A pair whichever of the two leads."""
    return {"lo": F.least("lead", "key"), "hi": F.greatest("lead", "key")}


def links(docs: DataFrame, nodes: DataFrame, scratch: common.Scratch, threshold: float = 0.8) -> DataFrame:
    """(key, comp) for the nodes that have a link.

    ``nodes``: key (a number), rep (doc_id, h), n, bands; one row for each word sequence.
    """
    spark = docs.sparkSession
    members = nodes.select("key", "n", F.posexplode("bands").alias("j", "v")).select(F.xxhash64("j", "v").alias("bucket"), "key", "n")
    parts = common.parts_of(spark, SKETCHES * nodes.count(), 500_000)
    comps, results, words, ranked, each = None, None, None, None, LEADERS
    while True:
        if results is None:
            at = _first_led(members, scratch, parts)
        else:
            ranked = scratch.stored(_ranked(members, each), "ranked", parts)
            at = scratch.stored(_led(ranked, threshold), "led", parts)
            each *= 4
        if words is None:
            wanted = at.select("key").unionByName(at.select(F.col("lead").alias("key"))).distinct()
            words = scratch.stored(_words_of(docs, nodes.join(wanted, "key", "left_semi").select("key", "rep.*")), "words")
        close = F.least("n", "ln") >= threshold * F.greatest("n", "ln") - 1e-9
        pairs = at.where(close & F.expr("comp <> lcomp")).withColumns(_ends()).groupBy("lo", "hi").agg(F.any_value("lead").alias("lead"))
        if results is not None:
            pairs = pairs.join(results, ["lo", "hi"], "left_anti")
        pairs = pairs.select("lead", F.when(F.col("lead") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("key"))
        pairs = scratch.stored(pairs, "pairs", parts)
        found = _compared(pairs, words, threshold).withColumns(_ends()).select("lo", "hi", "near", "d")
        found = scratch.stored(found, "compared", parts)
        comps = _joined(comps, found.where("near").select(F.col("lo").alias("a"), F.col("hi").alias("b")), parts, scratch)
        first = results is None
        results = found if first else results.unionByName(found)
        members = scratch.stored(_left(at, ranked, results, comps, scratch, parts), "left", parts)
        if first and not members.isEmpty():
            members = scratch.stored(_narrowed(members, words, threshold, scratch), "narrowed", parts)
        if members.isEmpty():
            return comps


def _ranked(members: DataFrame, each: int) -> DataFrame:
    """Members with their rank in their bucket and whether they lead: up to ``each``, those of small components first and none of the largest one."""
    whole = Window.partitionBy("bucket")
    sized = members.withColumn("c", F.count("*").over(Window.partitionBy("bucket", "comp")))
    last = F.max(F.struct("c", "comp")).over(whole)["comp"]
    ranked = sized.withColumns({"last": last, "rank": F.row_number().over(whole.orderBy("c", "comp", F.xxhash64("key"), "key"))})
    return ranked.select("bucket", "key", "n", "comp", "rank", ((F.col("rank") <= each) & (F.col("comp") != F.col("last"))).alias("leads"))


def _left(
    at: DataFrame, ranked: DataFrame | None, results: DataFrame, comps: DataFrame, scratch: common.Scratch, parts: int
) -> DataFrame:
    """Members that have to meet again in their bucket: not a leader, and not settled by one."""
    of = lambda end: comps.select(F.col("key").alias(end), F.col("comp").alias(f"c_{end}"))
    pairs = (  # a pair meets in many buckets: what is known of it is joined once
        at.groupBy("lead", "key")
        .agg(F.any_value("n").alias("n"), F.any_value("ln").alias("ln"))
        .join(of("key"), "key", "left")
        .join(of("lead"), "lead", "left")
        .withColumns(_ends())
        .join(results, ["lo", "hi"], "left")
        .withColumn("comp", F.coalesce("c_key", "key"))
        .withColumn("same", F.col("comp") == F.coalesce("c_lead", "lead"))
        .select("lead", "key", "comp", "same", "near", F.coalesce("d", F.abs(F.col("n") - F.col("ln"))).alias("d"))
    )
    pairs = scratch.stored(pairs, "pair-state", parts)
    met = at.select("bucket", "key", "n", "lead")
    if ranked is None:
        unsettled = met.join(pairs.where("NOT same"), ["lead", "key"], "left_semi").select("bucket").distinct()
        met = scratch.stored(met.join(unsettled, "bucket", "left_semi"), "unsettled", parts)
        state = met.join(pairs, ["lead", "key"])
    else:
        state = scratch.stored(met.join(pairs.where("NOT same OR near"), ["lead", "key"]), "state", parts)
    # no text near b is farther from b than half of b's words
    reach = state.where("NOT same").groupBy("bucket", "lead").agg(F.min(F.col("d") - F.col("n") / 2).alias("reach"))
    near = F.coalesce("near", F.lit(False))
    met = state.join(reach, ["bucket", "lead"], "left")
    if ranked is not None:
        settled = met.where(F.col("same") & near & (F.col("reach").isNull() | (F.col("d") < F.col("reach")))).select("bucket", "key")
        gone = settled.unionByName(ranked.where("leads").select("bucket", "key")).distinct()
        now = comps.withColumnRenamed("comp", "now")
        left = ranked.join(gone, ["bucket", "key"], "left_anti").join(now, "key", "left")
        return _open(left.select("bucket", "key", "n", F.coalesce("now", "key").alias("comp")))
    # members of a dealt bucket have met the leader of their salt only
    settled = F.col("same") & (F.col("reach").isNull() | (near & (F.col("d") < F.col("reach"))))
    several = state.groupBy("bucket").agg((F.min("lead") != F.max("lead")).alias("several"))
    left = (
        met.join(several, "bucket").withColumn("settled", settled & ~F.col("several"))
        .groupBy("bucket", "key")
        .agg(F.any_value("n").alias("n"), F.any_value("comp").alias("comp"), F.bool_or("settled").alias("settled"))
        .where("NOT settled")
        .drop("settled")
    )
    return _open(left)


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components; buckets of the same members are one."""
    same = [F.bit_xor(F.xxhash64(F.lit(i), "key")).alias(f"x{i}") for i in range(2)]
    several = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), *same).where("lo <> hi")
    several = several.groupBy("m", "x0", "x1").agg(F.min("bucket").alias("bucket"))
    return members.join(several.select("bucket"), "bucket", "left_semi")


def _large(members: DataFrame) -> DataFrame:
    """Buckets of more members than leaders settle at once."""
    return members.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > LEADERS + 1).select("bucket")


def _prefixes(words: DataFrame, threshold: float) -> DataFrame:
    """(key, token): the rarest words of every text, so many that near texts share one.

    Of two near texts' n words (repeats told apart), at least ``threshold`` * n are common,
    so that the first n - ceil(threshold * n) + 1 in any fixed order cannot all differ.
    The order goes by counts in 65,536 bins, which is what the driver holds.
    """
    bins = 1 << 16

    def tokens(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
        found = (np.frombuffer(raw, "<u4").astype(np.uint64) for raw in batch.column(column).to_pylist())
        return [common.mix64(w + _occurrences(w) * common.BASE) for w in found]

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(bins, np.int64)
        for batch in rows:
            for t in tokens(batch, 0):
                n += np.bincount((t % bins).astype(np.int64), minlength=bins)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bin", "n"])

    counts = np.zeros(bins, np.int64)
    for r in words.select("words").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r["bin"]] = r["n"]

    def rarest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            own = []
            for t in tokens(batch, 1):
                order = np.lexsort((t, counts[(t % bins).astype(np.int64)]))
                own.append(t[order[: len(t) - int(np.ceil(threshold * len(t) - 1e-9)) + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["key", "tokens"])

    return words.select("key", "words").mapInArrow(rarest, "key long, tokens array<long>")


def _narrowed(members: DataFrame, words: DataFrame, threshold: float, scratch: common.Scratch) -> DataFrame:
    """Small buckets as they are; members of larger ones in a bucket for each of their rarest words.

    Only buckets in which several components meet.
    """
    large = _large(members)
    small = members.join(large, "bucket", "left_anti")
    values = [c for c in members.columns if c not in ("bucket", "key")]
    own = members.join(large, "bucket", "left_semi").groupBy("key").agg(*[F.any_value(c).alias(c) for c in values])
    tokens = _prefixes(words.join(own.select("key"), "key", "left_semi"), threshold)
    own = scratch.stored(own.join(tokens, "key"), "rarest")
    met = own.withColumn("token", F.explode("tokens")).withColumn("bucket", F.xxhash64(F.lit("word"), "token"))
    return small.unionByName(_open(met.select(members.columns)))


def _joined(comps: DataFrame | None, edges: DataFrame, parts: int, scratch: common.Scratch) -> DataFrame:
    """Components after further links: only links between components that were apart are followed."""
    if comps is None:
        return scratch.stored(components(edges, scratch), "near-comps", parts)
    of = lambda end: comps.select(F.col("key").alias(end), F.col("comp").alias(f"c{end}"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    ends = scratch.stored(ends.distinct(), "near-bridges", parts)
    if ends.isEmpty():
        return comps
    merged = scratch.stored(components(ends, scratch).withColumnRenamed("key", "old"), "near-merged", parts)
    moved = comps.join(merged.withColumnRenamed("comp", "now"), F.col("comp") == F.col("old"), "left")
    moved = moved.select("key", F.coalesce("now", "comp").alias("comp"))
    fresh = merged.join(comps.select(F.col("key").alias("old")), "old", "left_anti").select(F.col("old").alias("key"), "comp")
    return scratch.stored(moved.unionByName(fresh), "near-comps", parts)


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, h, class_id, and ``first``: whether it stands for its class.

    The row with the smallest (doc_id, h) stands for a class; rows without doc_id
    come last.
    """
    scratch = common.Scratch(docs.sparkSession, "near")
    rows = scratch.stored(sketches(docs), "near-sketches")
    last = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    nodes = scratch.stored(
        rows.groupBy("key").agg(
            F.min(last).alias("least"), F.count("*").alias("copies"), F.max("n").alias("n"), F.any_value("bands").alias("bands")
        ).withColumn("id", F.monotonically_increasing_id()),
        "nodes",
    ).withColumn("rep", F.struct("least.doc_id", "least.h"))
    comps = links(docs, nodes.select(F.col("id").alias("key"), "n", "rep", "bands"), scratch, threshold)
    labelled_nodes = nodes.select("key", "id", "least", "copies").join(comps.withColumnRenamed("key", "id"), "id", "left")
    shared = scratch.stored(labelled_nodes.where("comp IS NOT NULL OR copies > 1"), "near-shared")
    leasts = shared.groupBy(F.coalesce("comp", "id").alias("comp")).agg(F.min("least").alias("head"))
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    heads = (
        shared.select("key", F.coalesce("comp", "id").alias("comp"))
        .join(leasts, "comp")
        .select("key", "head", F.explode(salts).alias("salt"))
    )
    own = F.coalesce("head", last)
    result = (
        rows.select("doc_id", "h", "key", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALTS)).cast("int").alias("salt"))
        .join(heads, ["key", "salt"], "left")
        .select("doc_id", "h", own["doc_id"].alias("class_id"), own.eqNullSafe(last).alias("first"))
    )
    result = common.stored(result, "near-classes")
    scratch.drop()
    return result


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id and class_id of every row."""
    return classes(docs, threshold).select("doc_id", "class_id", "first")


def deduplicated(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stand for their class, one for each class; all columns stay."""
    none = F.lit(-(1 << 63))
    stay = classes(docs, threshold).where("first").select(F.coalesce("doc_id", none).alias("_id"), F.col("h").alias("_h"))
    return (
        docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), none).alias("_id"),
                    F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_h"))
        .join(stay, ["_id", "_h"], "left_semi")
        .dropDuplicates(["_id", "_h"])
        .select("_row.*")
    )
