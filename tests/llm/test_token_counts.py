"""Token counts against the libraries' own ids of whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from peakloom.llm import token_counts

PARTS = ["a", "b", "The", "'", "'s", "'re", "'ll", "'D", " ", "  ", "\n", "\t", "1", "½", ".", "!?", "é", "e\u0301", "ª", "\xa0", "日本", "S'", "\r\n", "ɐ", "\x7f", "\x0b", "\x00", "▁", "<s>", "<unk>", "<|endoftext|>", "<|startoftext|>", " word", "Ünï", "😀"]


def library(path):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t, num_threads=1))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_pieces_add_up_to_the_text(name, monkeypatch):
    path, rng = public_tokenizers.path(name), random.Random(7)
    count, own = library(path), token_counts.tokenizer_for(path)
    monkeypatch.setattr(token_counts, "CUT_BYTES", 50)
    texts = ["", " ", "  a", "a ", None, "x" * 300, *("".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(1500))]
    got = [0] * len(texts)
    for cut in token_counts.cuts(pa.array(texts), path):
        tokens = own.count([p.decode() for p in cut.distinct().to_pylist()])
        for o, i in zip(cut.owner.tolist(), cut.inverse.tolist(), strict=True):
            got[cut.index[o]] += tokens[i]
    assert got == [count(t or "") for t in texts]
    assert own.safe if name.endswith(".model") else own.stepwise


@pytest.mark.parametrize("limit", [0, 30, 1 << 20])
def test_counts_equal_the_library(docs, texts, nothing, limit):
    count = library(public_tokenizers.path("byte_bpe_50k.json"))
    out = token_counts.count(docs, limit=limit)
    expected = [(i, len((t or "").encode()), count(t or "")) for i, t, _ in texts]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)
    if not limit:
        assert token_counts.count(nothing).count() == 0


def test_the_shared_table_is_bounded_and_exact(spark):
    words = spark.createDataFrame([(bytearray(f" w{k}".encode()), k, 2) for k in range(1, 200)], "piece binary, n long, tokens long")
    for limit in (0, 1, 17, 60, 198, 199, 500):
        least, table = token_counts.frequent(words, limit)
        assert len(table.keys) <= limit and (len(table.keys) == 199) == (limit >= 199)
        assert len(table.keys) == words.filter(token_counts.eighths(words["n"]) >= least).count()
    (cut,) = token_counts.cuts(pa.array([" w3 w199 w1000"]), public_tokenizers.path("byte_bpe_50k.json"))
    assert table.find(cut).tolist() == [-1] * len(cut.keys)  # " w" and the digits are apart
    table.data = table.data.copy()
    table.data[:] = 0  # equal hashes of other bytes are told apart
    cut = token_counts.Cut(np.array([0]), np.frombuffer(b" w3", np.uint8), np.array([0]), np.array([3]), np.array([0]))
    assert token_counts.frequent(words, 500)[1].find(cut).tolist() == [2] and table.find(cut).tolist() == [-1]


def test_long_texts_and_odd_columns(spark):
    long = "some more words, it's 12 " * 4000
    docs = spark.createDataFrame([(None, long, 5, "x"), (None, long, 6, "x"), (3, None, 7, "x")], "doc_id long, text string, n_tokens long, row string")
    count = library(public_tokenizers.path("byte_bpe_50k.json"))
    got = [tuple(r) for r in token_counts.count(docs).orderBy("doc_id").collect()]
    assert got == [(None, len(long), count(long))] * 2 + [(3, 0, 0)]
