import random
import zlib

import numpy as np
import pytest

from folioscan.llm import tokens
from folioscan.llm.queries import tokenizer_path


@pytest.mark.parametrize("seed", range(6))
def test_elias_fano_round_trip(seed):
    rng = np.random.default_rng(seed)
    values = np.cumsum(rng.integers(0, [1, 5, 300, 3, 100_000, 40][seed], 2000))
    width, low, high, samples = tokens.ef_encode(values, int(values[-1]))
    ef = tokens.EliasFano(len(values), width, low, high, samples)
    assert (ef.values() == values).all()
    assert [ef.select(i) for i in range(0, 2000, 37)] == values[::37].tolist()
    assert len(low) + len(high) <= len(values) * (width + 3) / 8 + 16
    with pytest.raises(IndexError):
        ef.select(2000)


def test_encoder_equals_library():
    encoder = tokens.Encoder(tokenizer_path(), 2, tokens.cuts_by_piece(tokenizer_path()), cache_size=50)
    assert encoder.by_piece
    rng = random.Random(3)
    pool = ["Don't", "it'S", "ÉCOLE", "x2y", "!!'s", "<|endoftext|>", "é", " ", "naïve,", "''ll", "\n", "\t", " ", "a.b", "ß", "日本"]
    for _ in range(300):
        text = "".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12)))
        assert encoder.encode(text) == encoder._library([text])[0], text


def brute(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    out, start = [], 0
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for doc_id, text, *_ in [r for r in rows if r[0] is None] + known:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_all_documents_in_order(docs, clashing, rows, result):
    got = result(tokens.token_ids(docs, tokenizer_path()))
    want = brute(rows)
    of_ids = lambda x: sorted(((r[0], r[2], r[3]) for r in x), key=repr)
    assert of_ids(got) == of_ids(want)
    at = 0
    for r in sorted(got, key=lambda r: r[1]):  # starts are the sums of what lies before
        assert r[1] == at
        at += r[2]
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == [r[0] for r in want]
    assert of_ids(result(tokens.token_ids(clashing, tokenizer_path()))) == of_ids(want)


def test_single_documents_by_select(docs, rows):
    files = tokens.write_token_files(docs, tokenizer_path(), shard_bytes=20_000).orderBy("shard").collect()
    assert len(files) > 1
    assert [f["base"] for f in files] == [sum(g["n_tokens"] for g in files[:i]) for i in range(len(files))]
    texts = {}
    for f in files:
        file = tokens.TokenFile(f["path"])
        for i in range(file.n_docs):
            if i >= file.n_null:
                texts.setdefault(int(file.doc_ids[i]), []).append(file.document(i).tolist())
    assert texts[4] == [[2]] and texts[5] == [[2]]
    assert texts[10] == texts[-3] and len(texts[2]) == 2


def test_empty_table(no_docs):
    assert tokens.token_ids(no_docs, tokenizer_path()).count() == 0


def test_columns_of_the_contract(docs):
    out = tokens.token_ids(docs, tokenizer_path())
    assert out.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert out.agg({"start": "min"}).first()[0] == 0
