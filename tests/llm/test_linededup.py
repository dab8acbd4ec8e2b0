import numpy as np

from folioscan.llm import linededup as ld


def key(line):
    k = line.strip(" \t\n\x0b\x0c\r")
    k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
    return k if len(k) >= 10 else None


def brute(rows):
    doc = lambda r: ld.NO_DOC if r[0] is None else r[0]
    holders = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if key(line):
                holders.setdefault(key(line), set()).add(doc(r))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not key(x) or min(holders[key(x)]) == doc(r)]
        out.append((r[0], len(lines), len(lines) - len(kept), ld.sha256("\n".join(kept))))
    return sorted(out, key=repr)


def test_equals_brute_force(docs, clashing, rows, result, no_docs):
    assert result(ld.digest(ld.dedup_lines(docs))) == brute(rows)
    assert result(ld.digest(ld.dedup_lines(clashing))) == brute(rows)
    assert ld.dedup_lines(no_docs).count() == 0


def test_insert_and_delete_are_reversible(spark, docs, rows, result):
    first = docs.where("doc_id < 7 OR doc_id > 120").cache()
    rest = docs.exceptAll(first)
    whole = ld.create(docs, shards=4)
    grown = ld.insert(ld.create(first, shards=4), rest)
    cols = ["shard", "key", "refs", "min_doc", "max_doc"]
    assert result(grown.counts, *cols) == result(whole.counts, *cols)
    assert result(ld.repeated(grown)) == result(ld.repeated(whole))
    back = ld.delete(grown, rest.select("doc_id").distinct())
    assert result(back.counts, *cols) == result(ld.create(first, shards=4).counts, *cols)
    held = {r["shard"]: ld.CuckooFilter(r["n_buckets"], bytes(r["table"])) for r in back.filters.collect()}
    entries = sum(int((f.table != 0).sum()) for f in held.values())
    assert entries == sum(1 + (r["min_doc"] != r["max_doc"]) for r in back.counts.collect())
    got = {(r["doc_id"], r["kept"]) for r in ld.rewritten(first, ld.repeated(back)).collect()}
    want = {(r["doc_id"], r["kept"]) for r in ld.dedup_lines(first).collect()}
    assert got == want


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = [rng.bytes(16) for _ in range(5000)]
    f = ld.CuckooFilter(ld.CuckooFilter.buckets_for(7000))
    assert f.insert(keys) and f.insert(keys[:2000])
    assert (f.count(keys) >= 1).all() and (f.count(keys[:2000]) >= 2).all()
    assert (f.count(keys[2000:]) >= 2).mean() < 0.01
    assert (f.count([rng.bytes(16) for _ in range(5000)]) > 0).mean() < 0.01
    f.remove(keys[:2000])
    assert (f.count(keys) >= 1).all() and (f.count(keys[:2000]) >= 2).mean() < 0.01
    f.remove(keys)
    assert not f.table.any()
    again = ld.CuckooFilter(f.n_buckets, f.table.tobytes())
    assert (again.table == f.table).all()
    assert not ld.CuckooFilter(8).insert(keys[:200])
