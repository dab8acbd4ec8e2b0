import zlib

from folioscan.llm import sharding


def check(rows, got, shards):
    assert len(got) == len(rows)
    by_text, slots, load = {}, {}, [0] * shards
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1])
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
        by_text.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_text.values())
    want = sorted((repr(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    return load


def test_groups_slots_and_loads(spark, docs, clashing, rows, no_docs, result):
    load = check([r for r in rows if r[1] is not None and r[1] != ""], sharding.shard_documents(docs.where("text <> ''"), 4).collect(), 4)
    assert sum(load) == sum(len(r[1].encode()) + 1 for r in rows if r[1])
    assert result(sharding.shard_documents(clashing)) == result(sharding.shard_documents(docs))
    assert sharding.shard_documents(no_docs).count() == 0
    nulls = sharding.shard_documents(docs.where("text IS NULL")).collect()
    assert len({r["shard"] for r in nulls}) == 1 and {r["size"] for r in nulls} == {1}


def test_many_rows_are_even_and_numbered(spark):
    rows = [(i, f"text {i // 2} " + "y" * (i * 7919 % 300), "en", "a", 1) for i in range(4000)]
    rows += [(10_000 + i, "copy " * 5, "en", "a", 1) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    load = check(rows, sharding.shard_documents(df).collect(), 8)
    assert max(load) - min(load) <= 0.01 * sum(load) / 8


def test_longest_first():
    assert sharding.lpt([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}
