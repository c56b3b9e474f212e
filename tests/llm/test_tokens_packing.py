import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tapegrid.llm import pattern_packing, token_counts, word_ids
from tapegrid.llm.unit_tokens import UnitCounter
from tapegrid.llm.word_ids import WordIds

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, n_bytes string, id int"


def odd_texts(n: int, size: int) -> list[str]:
    rng = random.Random(3)
    parts = ["the ", "  ", "\n", " \n ", "don't", "l'été ", "ßen", "123 ", "!!", "<|endoftext|>", " <|endoftext|>", "<|startoftext|>", "日本語", "\t", " ", "  ", "a", "É", "é", " é", "😀", "\r\n", "ΟΔΟΣ ", "\x1c", " we've", "''s "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_units_give_the_library_s_counts():
    counter, byte = UnitCounter(BYTE), Tokenizer.from_file(BYTE)
    for text in odd_texts(600, 30):
        assert int(counter.encode(text)[1][-1]) == len(byte.encode(text, add_special_tokens=False)), text


@pytest.mark.parametrize("part,memo", [(1 << 21, 1 << 24), (64, 1 << 24), (500, 1000)])
def test_ids_are_the_library_s(monkeypatch, part, memo):
    monkeypatch.setattr(word_ids, "PART", part)
    monkeypatch.setattr(word_ids, "MEMO_BYTES", memo)
    rng = random.Random(5)
    letters = [*"abstrdlmvABST''''..,,!  \n\t\x0b\x0c\x85\xa0 1234é×÷ßÄ³ªµΣςжİıſﬃ中’<|>", "̸", "̱", "́", "H̱", "ᄀ", "ᅡ", "<|STARTOFTEXT|>", "'re", "'LL"]
    texts = [None, "", "<|endoftext|>" * 3, *odd_texts(300, 30), *["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]]
    word = Tokenizer.from_file(WORD)
    found = []
    for first, ids, ends in WordIds(WORD)(pa.array(["left out", *texts])[1:]):
        assert first == len(found)
        found += [x.tolist() for x in np.split(ids, ends[:-1])]
    assert found == [e.ids for e in word.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("chunk,overlap", [(64, 40), (100, 16), (300, 64)])
def test_spliced_chunks_give_whole_counts(chunk, overlap):
    byte = Tokenizer.from_file(BYTE)
    counter = UnitCounter(BYTE)
    for text in [*odd_texts(60, 400), "x" * 1000, " " * 700, "a b" * 500, "ab " * 100 + "y" * 900 + " c" * 200, "!?" * 600, "<|endoftext|>" * 80]:
        assert token_counts.spliced(text, counter.encode, chunk, overlap) == len(byte.encode(text, add_special_tokens=False)), (chunk, text[:80])


def test_counts_of_rows(spark):
    texts = [None, "", "one two", *odd_texts(40, 900), "z" * 30_000, "one two"]
    rows = [(i if i != 2 else None, t, "x", 7) for i, t in enumerate(texts)]
    byte = Tokenizer.from_file(BYTE)
    found = token_counts.token_counts(spark.createDataFrame([*rows, rows[5]], SCHEMA), BYTE).collect()
    wanted = [(i, len((t or "").encode()), n := len(byte.encode(t or "", add_special_tokens=False)), n > 512) for i, t, *_ in [*rows, rows[5]]]
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), BYTE).collect() == []


def test_packing_is_whole_and_tight(spark):
    texts = [None, "", *odd_texts(150, 300), "word " * 20_000, *["same text here"] * 40]
    rows = [(i if i != 3 else None, t, "x", 7) for i, t in enumerate(texts)]
    found = pattern_packing.pack_documents(spark.createDataFrame(rows, SCHEMA), WORD, 512).toPandas()
    word = Tokenizer.from_file(WORD)
    by_id = {i: np.array([*word.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, *_ in rows}
    assert found["length"].sum() == sum(map(len, by_id.values()))
    for r in found[found.doc_id.notna()].itertuples():
        cut = by_id[int(r.doc_id)][r.start : r.start + r.length]
        assert r.start == 512 * r.piece and len(cut) == r.length and zlib.crc32(cut.tobytes()) == r.ids_crc32
    for _, s in found.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 512
    assert found.sequence_id.nunique() <= 1.03 * found.length.sum() / 512 + 1
    assert pattern_packing.pack_documents(spark.createDataFrame([], SCHEMA), WORD).collect() == []


def test_plan_places_every_document_once():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000, 200_000):
        lengths = np.minimum(4096, 1 + rng.lognormal(6, 1.2, n).astype(int))
        hist = np.bincount(lengths, minlength=4097)
        plan = pattern_packing.plan(hist)
        assert (np.bincount(plan["length"], plan["count"], 4097) == hist).all()
        used = np.zeros(int((plan["sequence"] + plan["count"]).max()) if n else 0)
        for r in plan.itertuples():
            used[r.sequence : r.sequence + r.count] += r.length
        assert (used <= 4096).all()
        if n >= 5000:
            assert len(used) <= 1.002 * np.ceil(lengths.sum() / 4096) + 1


def test_the_fit_finds_known_repeats():
    members = np.array([[5, 3, -1, -1], [4, 4, -1, -1], [5, -1, -1, -1], [2, 2, 2, 2]])
    wanted = np.zeros(9)
    np.add.at(wanted, [5, 3], 30)
    wanted[4], wanted[2] = 20, 40
    x = pattern_packing.nonnegative_fit(members, wanted, 3000)
    assert np.allclose(x, [30, 10, 0, 10], atol=0.2)


def test_rare_white_space_costs_no_more():
    """The offsets of a chunk are read once, not for each token."""
    import time

    counter, byte = UnitCounter(BYTE), Tokenizer.from_file(BYTE)
    text = "".join(("word " * 400) + "\xa0" for _ in range(50))
    start = time.process_time()
    assert token_counts.spliced(text, counter.encode) == len(byte.encode(text, add_special_tokens=False))
    assert time.process_time() - start < 1.5
