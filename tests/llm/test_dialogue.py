import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from folioscan.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if hit == 1:
            x = ""
        if hit == 2:
            x = "".join(ch for ch in x if ch not in ".!?")
        for _ in range((1, 2)[hit == 3] if hit else 0):
            yield c, t, "user" if hit == 4 else r, x


def cheapest(letters):
    """(cost, audit) by trying every edit, least cost first, then the ASCII-least audit."""
    grammar = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def go(i, last, inserts):
        options = []
        if i == len(letters) and last in ("", "a"):
            options.append((0, ""))
        if i < len(letters):
            letter, cut, forced = letters[i]
            cost, audit = go(i + 1, last, 0)
            options.append((cost + 2, "D" + audit))
            if not forced:
                for to in grammar[last]:
                    cost, audit = go(i + 1, to, 0)
                    if letter == to:
                        options.append((cost + 5 * cut, "K" + audit))
                    if to != "s":
                        options.append((cost + 1 + 5 * cut, "R" + audit))
        if inserts < 4:
            for to in grammar[last].replace("s", ""):
                cost, audit = go(i, to, inserts + 1)
                options.append((cost + 5, "I" + audit))
        return min(options) if options else (10**9, "~")

    return go(0, "", 0)


def brute(rows, damaged=True):
    out = []
    after = list(damage(rows)) if damaged else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in after if r[0] == conv]
        said = lambda r, x: hashlib.md5(f"{len(r)}:{r}:{x}".encode()).hexdigest()
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), said(r[1], r[2])))
        seen, faults, letters = set(), {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}, []
        for _, r, x in own:
            core = x.strip(WHITE)
            fault = "blank" if not core else "duplicate" if (r, x) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((r, x))
            faults[fault] += 1
            letters.append((r[:1], fault == "truncated", fault in ("blank", "duplicate")))
        cost, audit = cheapest(tuple(letters))
        lines, rest, state = [], iter(own), dialogue.START
        for e in audit:
            role, text = ("", "") if e == "I" else next(rest)[1:]
            if e == "D":
                continue
            if e != "K":
                role, state = dialogue.ASKED[state]
            else:
                state = dialogue.KEPT[state, role[:1]]
            lines.append(f"{role}:{text}")
        turns = {t for t, *_ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"],
                    faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversation(rng, conv, n):
    for t in range(n):
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
        text = rng.choice(["Yes.", "No", "Why?", " \n", "", None, "End.\t ", "é!", f"t{rng.randint(0, 9)}.", "1. a\nb"])
        yield conv, None if rng.random() < 0.05 else t + rng.randint(0, 2), role, text


def sample(seed=7, many=60, longest=7):
    rng = random.Random(seed)
    rows = [r for c in range(many) for r in conversation(rng, None if c == 5 else c, rng.randint(1, longest))]
    rows += [(900, 1, "user", "Hi."), (900, 1, "user", "Hi."), (900, 1, "user", "Hi.")]  # repeated rows
    gone = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (gone, 0, "user", "Lost.")]


def got(df, **kw):
    return sorted(map(tuple, dialogue.repair_digest(df, **kw).collect()), key=repr)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(sample(), SCHEMA).repartition(3)


@pytest.mark.parametrize("chunk", [256, 3, 1])
def test_equals_brute_force(table, chunk):
    assert got(dialogue.damaged(table), chunk=chunk) == brute(sample())


def test_undamaged_rows_and_clashing_columns(table):
    more = table.select("*", *[F.lit("x").alias(c) for c in ("said", "word", "part", "tail", "kind", "edit", "at", "n")])
    assert got(more) == brute(sample(), damaged=False)


def test_long_conversation_in_chunks(spark):
    rows = list(conversation(random.Random(3), 1, 400)) + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    want = got(spark.createDataFrame(rows, SCHEMA), chunk=1000)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5), chunk=16) == want


def test_repaired_rows(table):
    rows = dialogue.repaired(dialogue.damaged(table)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append(r)
    for conv, _, _, _, _, _, _, audit, _ in brute(sample()):
        assert sorted(r["edit"] or "" for r in by[conv]) == sorted(audit or [""])
    assert all(r["new_role"] in ("user", "assistant") and r["text"] == "" for r in rows if r["edit"] == "I")


def test_empty_table(spark):
    assert got(dialogue.damaged(spark.createDataFrame([], SCHEMA))) == []


def test_endings_are_shared():
    """A node for every distinct ending, whatever the number of words."""
    words = sorted({"".join(w) for n in range(1, 6) for w in itertools.product("uaS", repeat=n)}, key=lambda w: w[::-1])
    automaton = dialogue.Automaton(dialogue.END)
    for w in words:
        for state, (cost, audit, end) in enumerate(automaton.word(w)):
            if state == dialogue.START:
                assert (cost, audit + dialogue.ends(dialogue.END)[end][1]) == cheapest(tuple((c.lower(), c.isupper(), False) for c in w))
    assert automaton.made == len({w[i:] for w in words for i in range(len(w))})


def test_tables_compose():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ("".join(rng.choice("suaoSUAO") for _ in range(rng.randint(0, 6))) for _ in range(2))
        x, y, whole = dialogue.table(a), dialogue.table(b), dialogue.table(a + b)
        assert whole == [[min(dialogue.FAR, *(x[p][k] + y[k][q] for k in range(4))) for q in range(4)] for p in range(4)]
