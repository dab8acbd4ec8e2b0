import random

import numpy as np
import pyarrow as pa

from folioscan.llm import common, decontam as dc
from tests.llm.conftest import sentence


def words(text):
    return common.word_hashes(pa.array([text], pa.string()))[0]


def brute(items, text, threshold):
    """Best window of every item over all windows, without fingerprints."""
    w = words(text)
    out = {}
    for k, item_id in enumerate(items.ids):
        size, length = int(items.sizes[k]), int(items.lengths[k])
        if len(w) < size:
            continue
        runs = common.shingles(w, size)
        span = max(1, length - size + 1)
        best = max(items.similarity(runs[a : a + span], items.runs[k]) for a in range(max(1, len(runs) - span + 1)))
        if best >= threshold:
            out[item_id] = round(best, 9)
    return out


def test_index_finds_exactly_the_radius():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    asked = np.concatenate([prints[:50] ^ (np.uint64(1) << rng.integers(0, 63, 50).astype(np.uint64)), rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
    for radius in (0, 3, 8, 23):
        at, item, distance = dc.HammingIndex(prints, radius).within(asked)
        every = np.bitwise_count(asked[:, None] ^ prints[None, :])
        assert set(zip(at.tolist(), item.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(every <= radius))))
        assert (distance == every[at, item]).all()


def test_equals_all_windows(spark, docs, rows, clashing, no_docs, result):
    rng = random.Random(8)
    texts = [sentence(rng, n) for n in (3, 5, 8, 20, 35, 60)] + ["", None, "one two"]
    more = []
    for i, t in enumerate(texts[:6]):
        w = t.split()
        for j in range(6):
            changed = list(w)
            if j >= 2 and len(w) > 10:
                changed[rng.randrange(len(w))] = "edited"
            if j == 4:
                changed.insert(len(w) // 2, "inserted")
            if j == 5 and len(w) > 10:
                changed = changed[: len(w) // 2]
            more.append((1000 + 10 * i + j, sentence(rng, 30) + " " + ", ".join(changed).upper() + " " + sentence(rng, 30), "en", "a", 1))
    bench = spark.createDataFrame([*enumerate(texts), (77, texts[3])], "item_id long, text string")
    every = docs.unionByName(spark.createDataFrame(more, docs.schema))
    items = dc.Items([*range(len(texts)), 77], [t or "" for t in texts] + [texts[3]], 23)
    want = {}
    for doc_id, text, *_ in rows + more:
        for item, s in brute(items, text or "", 0.8).items():
            want[(doc_id, item)] = s
    found = dc.contaminated(every, bench).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in found} == want
    assert any(0.8 <= s < 1 for s in want.values()) and (-3, 8) in want
    blocks = dc.contaminated(every, bench, block_items=4).select("doc_id", "item_id").collect()
    assert {tuple(r) for r in blocks} >= set(want)
    clean = dc.clean(every, bench)
    assert clean.columns == every.columns
    bad = {d for d, _ in want}
    assert sorted(map(repr, (r["doc_id"] for r in clean.collect()))) == sorted(repr(r[0]) for r in rows + more if r[0] not in bad)
    assert result(dc.contaminated(clashing.drop("item_id"), bench)) == result(dc.contaminated(docs, bench))
    assert dc.contaminated(no_docs, bench).count() == 0
    assert dc.contaminated(docs, bench.limit(0)).count() == 0
    assert dc.clean(clashing, bench).columns == clashing.columns


def test_repeated_items_fit_any_block(spark):
    rng = random.Random(22)
    text = sentence(rng, 12)
    items = [(200, text)] * 30 + [(None, None)] * 30 + [(201, text)] + [(i, sentence(rng, 20)) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(2, sentence(rng, 9) + " " + text), (4, None)], "doc_id long, text string")
    found = dc.contaminated(docs, bench, block_items=5).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, found)) == [(2, 200), (2, 201)]


def test_blocks_and_repeated_items_change_nothing(spark):
    rng = random.Random(21)
    common_part, tail = sentence(rng, 120), sentence(rng, 12)
    items = [(i, common_part if i < 12 else common_part + " " + sentence(rng, 6)) for i in range(24)]
    items += [(100 + i, sentence(rng, 20)) for i in range(12)] + [(200, tail)] * 30 + [(None, None)] * 30 + [(201, tail)]
    w = common_part.split()
    w[30] = "edited"
    rows = [(1, " ".join(w)), (2, sentence(rng, 9) + " " + tail), (3, items[30][1] + " " + " ".join(w[:40])), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda n: sorted(map(tuple, dc.contaminated(docs, bench, block_items=n).collect()))
    want = found(1000)
    assert [r[1] for r in want if r[0] == 2] == [200, 201]
    assert any(r[0] == 1 and r[5] < 1 for r in want)
    assert found(5) == want
    kept = [(i, t or "") for i, t in dict.fromkeys(items)]
    whole = dc.Items([i for i, _ in kept], [t for _, t in kept], 23)
    for doc_id, text in rows[:3]:
        assert {r[1]: round(r[5], 9) for r in want if r[0] == doc_id} == brute(whole, text, 0.8)
