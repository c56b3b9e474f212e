import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tapegrid.llm import lexicon, word_bpe
from tapegrid.llm.common import table

WORD = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, id int"


def wanted(rows):
    tok = Tokenizer.from_file(WORD)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for i, text, *_ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n,letters,longest", [(0, 2, 3), (1, 1, 1), (300, 2, 12), (3000, 5, 7)])
def test_lexicon_finds_its_words_alone(tmp_path, n, letters, longest):
    rng = random.Random(n)
    pick = lambda: "".join(rng.choice("abéc日"[:letters]) for _ in range(rng.randint(1, longest)))
    words = sorted({pick() for _ in range(n)}, key=lambda _: rng.random())
    ids = [[rng.randrange(1 << 32) for _ in range(rng.randint(0, 4))] for _ in words]
    (tmp_path / "f").write_bytes(lexicon.compiled([w.encode() for w in words], ids))
    found = lexicon.Lexicon(str(tmp_path / "f"))
    asked = ["", *words, *(pick() for _ in range(2000)), *(w[:-1] for w in words), *(w + "a" for w in words)]
    known = dict(zip(words, ids, strict=True))
    places = found.places(pa.array(["cut off", *asked], pa.large_string())[1:])
    begins, sizes = found.rows(places[places >= 0])
    assert [w in known for w in asked] == (places >= 0).tolist()
    assert [found.ids[b : b + k].tolist() for b, k in zip(begins.tolist(), sizes.tolist(), strict=True)] == [known[w] for w in asked if w in known]


def test_automaton_is_minimal():
    words = sorted(a + b + c for a in (b"re", b"un", b"pre") for b in (b"do", b"make", b"tie") for c in (b"", b"ing", b"able", b"s"))
    arcs, final = lexicon._automaton(words)

    def endings(state):
        return frozenset([b""] * final[state] + [bytes([b]) + e for b, t in arcs[state] for e in endings(t)])

    reached, todo = set(), [0]
    while todo:
        if (s := todo.pop()) not in reached:
            reached.add(s)
            todo += [t for _, t in arcs[s]]
    assert endings(0) == set(words) and len({endings(s) for s in reached}) == len(reached)


@pytest.mark.parametrize("words", [0, 3, 500])
def test_encoding_and_decoding_are_the_library_s(spark, words):
    rng = random.Random(7)
    parts = ["the ", "The ", "  ", "\n", "don't", "l'été ", "ßen", "123 ", "!!", "<|endoftext|>", "<|startoftext|>", "日本語", "é", "😀", "\r\n", "ΟΔΟΣ ", "\x1c", "\x00", "''s ", "unmet" * 12]
    texts = [None, "", " ", *["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(200)], "long word " * 300_000, "x" * 200_000]
    rows = [(i if i != 4 else None, t, "clash", 1) for i, t in enumerate(texts)]
    rows += rows[3:9]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, word_bpe.digests(spark, df, WORD, words).collect()), key=repr) == wanted(rows)


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert sorted(map(tuple, word_bpe.digests(spark, docs, WORD).collect()), key=repr) == wanted([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_empty_table_and_odd_ids(spark):
    assert word_bpe.digests(spark, spark.createDataFrame([], SCHEMA), WORD).collect() == []
    tok = Tokenizer.from_file(WORD)
    rows = [(1, [320, 49407, 99999, 5]), (2, []), (3, None), (None, [10])]
    found = word_bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), WORD).collect()
    assert {r.doc_id: r.text for r in found} == {i: tok.decode(ids or [], skip_special_tokens=False) for i, ids in rows}


def test_counts_cover_all_texts(spark, monkeypatch):
    monkeypatch.setattr(word_bpe, "HELD", 2)
    docs = spark.createDataFrame([(k, "one two two " * (k + 1), "", 0) for k in range(50)] + [(None, None, "", 0)], SCHEMA)
    assert {bytes(r.word): r.n for r in word_bpe.word_counts(docs).collect()} == {b"one": 1275, b"two": 2550, b" ": 3825}


def test_frequent_words_are_the_most_frequent(spark):
    rows = [(f"w{k}".encode(), n) for k, n in enumerate([900, 500, 500, 80, 80, 80, *[3] * 40, *[1] * 100])]
    counts = spark.createDataFrame(rows, "word binary, n long")
    for words, wanted in ((0, 0), (1, 1), (2, 1), (3, 3), (5, 3), (6, 6), (45, 6), (46, 46), (1000, 146)):
        assert sorted(r.n for r in word_bpe.frequent(counts, words).collect()) == sorted(n for _, n in rows)[len(rows) - wanted :], words
