import random
import zlib

import numpy as np
import pytest

from folioscan.llm import packing
from folioscan.llm.queries import tokenizer_path

CONTRACT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def wanted(rows, length):
    """The pieces by the tokenizers library alone."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    out = []
    for doc_id, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            out.append((doc_id, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=repr)


def check(got, rows, length):
    assert sorted((tuple(r[c] for c in CONTRACT[:5]) for r in got), key=repr) == wanted(rows, length)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(by_sequence), -(-sum(r["length"] for r in got) // length)


@pytest.mark.parametrize("length,open_bins,fan", [(2048, 512, 64), (64, 4, 2), (64, 1, 2), (300, 3, 3)])
def test_pieces_and_places(docs, rows, length, open_bins, fan):
    df = packing.packed(docs.repartition(7), tokenizer_path(), length, open_bins=open_bins, fan=fan)
    got = packing.digest(df)
    assert got.columns == CONTRACT
    used, least = check(got.collect(), rows, length)
    assert used <= 1.35 * least + 1


def test_few_sequences(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue"]) for _ in range(int(rng.paretovariate(0.9) * 9) % 3000))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    used, least = check(packing.digest(packing.packed(df, tokenizer_path(), fan=4)).collect(), rows, 2048)
    assert used <= 1.01 * least + 1


def test_sequences_hold_the_documents(docs, rows):
    df = packing.packed(docs, tokenizer_path(), 100).cache()
    whole = {r["sequence_id"]: r for r in packing.sequences(df).collect()}
    for r in df.collect():
        ids = whole[r["sequence_id"]]["ids"]
        assert ids[r["offset"] * 4 : (r["offset"] + r["length"]) * 4] == r["ids"]
    assert sum(len(r["ids"]) for r in whole.values()) == 4 * sum(r["length"] for r in df.collect())
    assert sum(r["n_pieces"] for r in whole.values()) == df.count()


def test_clashes_and_empty_table(docs, clashing, no_docs):
    of = lambda df: sorted((tuple(r[c] for c in CONTRACT[:5]) for r in packing.digest(packing.packed(df, tokenizer_path())).collect()), key=repr)
    assert of(clashing) == of(docs)
    assert of(no_docs) == []


def test_best_fit_by_brute_force():
    """The bitset finds the open sequence with the least space that is enough, and closes the fullest."""
    rng = random.Random(1)
    for most in (1, 2, 5, 50):
        bins, free = packing.OpenBins(100, most), {}
        for _ in range(2000):
            size = rng.randint(1, 100)
            bin, offset = bins.add(size)
            enough = [s for s in free.values() if s >= size]
            if enough:
                assert free[bin] == min(enough) and offset == 100 - free[bin]
                free[bin] -= size
            else:
                assert bin not in free and offset == 0
                free[bin] = 100 - size
            if free[bin] == 0:
                del free[bin]
            if len(free) > most:
                least = min(free.values())
                gone = [b for b in free if free[b] == least and b not in {x for x, _ in bins.left()}]
                assert len(gone) == 1
                del free[gone[0]]
            assert {b: 100 - u for b, u in bins.left()} == free
