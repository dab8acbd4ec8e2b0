import os
import random

import numpy as np
import pyarrow as pa

from folioscan.llm import common, ordermin as om
from tests.llm.conftest import sentence


def words(text):
    return common.word_hashes(pa.array([text], pa.string()))[0]


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for j, b in enumerate(y):
            last, row[j + 1] = row[j + 1], last + 1 if a == b else max(row[j + 1], row[j])
    return row[-1]


def share(x, y):
    """Aligned words of the longer text, by the full table."""
    return lcs(x.tolist(), y.tolist()) / max(len(x), len(y), 1)


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + rng.randint(0, 1)] = [sentence(rng, 1)] * rng.randint(0, 2)
    return w or ["x"]


def test_alignment_equals_full_table():
    rng = random.Random(1)
    near = 0
    for _ in range(300):
        a = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(1, 60))]
        x, y = words(" ".join(a)), words(" ".join(edited(rng, a, rng.randint(0, 12))))
        m = lcs(x.tolist(), y.tolist())
        got, d = om.compare(x, y, 0.8)
        assert got == (m >= 0.8 * max(len(x), len(y)))
        assert d == len(x) + len(y) - 2 * m if got else d <= len(x) + len(y) - 2 * m
        near += got
    assert 50 < near < 250


def test_order_matters():
    rng = random.Random(2)
    a, b = sentence(rng, 100), sentence(rng, 100)
    assert not om.compare(words(a + " " + b), words(b + " " + a))[0]
    same = sum(x == y for x, y in zip(om.bands(words(a + " " + b)), om.bands(words(b + " " + a))))
    assert same < om.SKETCHES


def near(x, y, threshold):
    return min(len(x), len(y)) >= threshold * max(len(x), len(y)) > 0 and share(x, y) >= threshold


def brute(rows, threshold=0.8):
    keys = [(r[1] or "") if not len(words(r[1])) else words(r[1]).tobytes() for r in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if keys[i] == keys[j] or near(words(rows[i][1]), words(rows[j][1]), threshold):
                comp[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], least.get(find(i))) for i, r in enumerate(rows)), key=repr)


def near_rows():
    rng = random.Random(3)
    rows, at = [], 1000
    for _ in range(6):
        base = sentence(rng, rng.randint(60, 150)).split()
        for c in range(12):
            w = list(base)
            for _ in range(c // 3):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(999))
            if c == 11:
                del w[10 : 10 + len(w) // 50 + 1]
            rows.append((at, " ".join(w), "en", "a", 1))
            at += 1
    chain = sentence(rng, 120).split()  # each near the next one, the first not near the last
    for c in range(8):
        chain = list(chain)
        chain[10 * c + 5] = f"step{c}"
        rows.append((at + c, " ".join(chain), "en", "a", 1))
    return rows


def test_classes_equal_brute_force(spark, docs, clashing, rows, no_docs, result):
    more = near_rows()
    every = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = om.near_duplicates(every)
    assert result(got, "doc_id", "class_id") == brute(rows + more)
    kept = om.deduplicated(every)
    assert kept.columns == docs.columns
    n = got.where("first").select("doc_id", "class_id").distinct().count()
    assert kept.count() >= n - 1 and kept.where("doc_id IS NOT NULL").count() == kept.where("doc_id IS NOT NULL").select("doc_id").distinct().count()
    assert result(om.near_duplicates(clashing)) == result(om.near_duplicates(docs))
    assert om.deduplicated(clashing).columns == clashing.columns
    assert om.near_duplicates(no_docs).count() == 0 and om.deduplicated(no_docs).count() == 0


def test_a_bucket_whose_members_differ_is_searched_whole(spark, monkeypatch):
    """All texts in one bucket; links exist only between members that are not the leader."""
    monkeypatch.setattr(om, "bands", lambda w: np.zeros(om.SKETCHES, np.uint64) if len(w) else np.empty(0, np.uint64))
    rng = random.Random(4)
    rows = []
    for g in range(9):
        base = sentence(rng, 80).split()
        for c in range(3):
            w = list(base)
            w[c * 7] = f"v{c}"
            rows.append((10 * g + c, " ".join(w), "en", "a", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    nodes = om.sketches(df).toPandas()
    table = spark.createDataFrame(
        [(500 + int(i), (int(i), int(h)), int(n), [7] * om.SKETCHES) for i, h, n in zip(nodes.doc_id, nodes.h, nodes.n)],
        "key long, rep struct<doc_id: long, h: long>, n long, bands array<long>",
    )
    comps = {r["key"]: r["comp"] for r in om.links(df, table, common.Scratch(spark, "test")).collect()}
    of = {int(i): comps[500 + int(i)] for i in nodes.doc_id}
    assert len(set(of.values())) == 9 and all(of[10 * g] == of[10 * g + 1] == of[10 * g + 2] for g in range(9))


def test_pairs_of_a_single_large_bucket_are_found(spark):
    """All texts share one sketch and no other; links exist only between members that are not the leader."""
    rng = random.Random(5)
    rows = []
    for g in range(9):
        base = sentence(rng, 80).split()
        for c in range(3):
            w = list(base)
            w[c * 7] = f"v{c}"
            rows.append((10 * g + c, " ".join(w), "en", "a", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    nodes = om.sketches(df).toPandas()
    table = spark.createDataFrame(
        [(500 + int(i), (int(i), int(h)), int(n), [7] + [1000 * int(i) + j for j in range(1, om.SKETCHES)]) for i, h, n in zip(nodes.doc_id, nodes.h, nodes.n)],
        "key long, rep struct<doc_id: long, h: long>, n long, bands array<long>",
    )
    comps = {r["key"]: r["comp"] for r in om.links(df, table, common.Scratch(spark, "test")).collect()}
    assert all(comps[500 + 10 * g] == comps[501 + 10 * g] == comps[502 + 10 * g] for g in range(9))
    assert len(set(comps.values())) == 9


def test_texts_that_share_a_passage_only_do_not_meet_again(spark, monkeypatch):
    """Sixty texts in two buckets: what is compared grows with the texts and the near pairs, not with all pairs."""
    rows = []
    for g in range(60):
        w = [f"passage{j}" for j in range(20)] + [f"w{g}x{j}" for j in range(60)]
        rows.append((10 * g, " ".join(w), "en", "a", 1))
        if g % 10 == 0:
            rows.append((10 * g + 1, " ".join(w[:-3] + ["changed"] * 3), "en", "a", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    nodes = om.sketches(df).toPandas()
    table = spark.createDataFrame(
        [(500 + int(i), (int(i), int(h)), int(n), [7, 8] + [1000 * int(i) + j for j in range(2, om.SKETCHES)]) for i, h, n in zip(nodes.doc_id, nodes.h, nodes.n)],
        "key long, rep struct<doc_id: long, h: long>, n long, bands array<long>",
    )
    seen, inner = [], om._compared
    monkeypatch.setattr(om, "_compared", lambda pairs, *a: seen.append(pairs.count()) or inner(pairs, *a))
    comps = {r["key"]: r["comp"] for r in om.links(df, table, common.Scratch(spark, "test")).collect()}
    assert len(comps) == 12 and all(comps[500 + 100 * g] == comps[501 + 100 * g] for g in range(6))
    assert sum(seen) <= 4 * len(rows)


def test_near_texts_share_a_rare_word(spark):
    rng = random.Random(7)
    texts = {}
    for g in range(20):
        base = sentence(rng, rng.randint(1, 60)).split()
        texts[2 * g], texts[2 * g + 1] = base, edited(rng, base, max(1, len(base) // 8))
    own = {k: (words(" ".join(t)) >> np.uint64(32)).astype("<u4") for k, t in texts.items()}
    table = spark.createDataFrame([(k, bytearray(w.tobytes())) for k, w in own.items()], "key long, words binary")
    found = {r["key"]: set(r["tokens"]) for r in om._prefixes(table, 0.8).collect()}
    near_ones = [(a, b) for a in own for b in own if a < b and om.compare(own[a], own[b])[0]]
    assert near_ones and all(found[a] & found[b] for a, b in near_ones)


def test_recall_of_single_sketches():
    """Pairs at 0.8 and more that share a bucket, against every pair that is near."""
    rng = random.Random(6)
    met = []
    for _ in range(400):
        base = sentence(rng, rng.randint(60, 300)).split()
        x, y = words(" ".join(base)), words(" ".join(edited(rng, base, rng.randint(1, len(base) // 12))))
        if near(x, y, 0.8):
            met.append((om.bands(x) == om.bands(y)).any())
    assert len(met) > 300 and np.mean(met) >= 0.97


def test_scratch_tables_go(spark, tmp_path):
    scratch = common.Scratch(spark, "t")
    folder = scratch.stored(spark.range(5), "x").inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    assert os.path.isdir(folder)
    scratch.drop()
    assert not os.path.isdir(folder)


def test_components_of_a_path(spark):
    key = lambda i: i.to_bytes(4, "big")
    edges = [(key(i), key(i + 1)) for i in range(40)] + [(key(100), key(90)), (key(100), key(100))]
    got = om.components(spark.createDataFrame(edges, "a binary, b binary"), common.Scratch(spark, "test")).collect()
    assert {bytes(r["key"]): bytes(r["comp"]) for r in got} == {**{key(i): key(0) for i in range(41)}, key(90): key(90), key(100): key(90)}
