from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from rookery.llm import pieces
from rookery.llm.common import read

TEXTS = [
    "Hello  world\nfoo\tbar", "   lead", "", " ", "a", "\x00 a  ", "x" * 300, "    four     spaces \n\n next ", "日本語 naïve Straße 🙂 ﬁ", "é é",
    "\r\n\r\n", "12345 + 67,890.12", "def f(x):\n    return x  # done",
]


@pytest.fixture(scope="module")
def path():
    return pieces.default_path()


@pytest.fixture(scope="module")
def library(path):
    """The library over the same pieces and scores, as a unigram model: its own Viterbi."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def split(ids, counts):
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts)]


def test_equals_the_library(path, library):
    vocabulary = pieces.load(path)
    got = split(*pieces.Encoder(vocabulary).encode(TEXTS))
    assert got == [library.encode(t) for t in TEXTS]


def test_words_of_the_table_score_as_in_the_library(spark, small, path, library):
    """Nearly all paths are the library's; where they differ the sum is equal, or better here."""
    vocabulary = pieces.load(path)
    words = sorted({w for r in read(spark, small, "documents").limit(60).collect() for w in r["text"].split()})
    got = split(*pieces.Encoder(vocabulary).encode(words))
    theirs = [library.encode(w) for w in words]
    assert all(vocabulary.score[a].sum() >= vocabulary.score[b].sum() for a, b in zip(got, theirs))
    assert sum(a == b for a, b in zip(got, theirs)) > 0.99 * len(words)


@pytest.mark.parametrize("scores", ["stored", "rank"])
def test_brute_force_path(path, scores):
    """Every path of short words, tried one by one."""
    vocabulary = pieces.load(path, scores)
    usable = {vocabulary.surface[i]: vocabulary.score[i] for i in vocabulary.ids}

    def best(word):
        if not word:
            return 0.0
        return max(best(word[:-k]) + (usable[word[-k:]] if word[-k:] in usable else vocabulary.unknown if k == 1 else -np.inf) for k in range(1, len(word) + 1))

    rng = random.Random(6)
    for _ in range(60):
        word = pieces.SPACE + "".join(rng.choice("aehintrsé☃") for _ in range(rng.randrange(1, 7)))
        chars = np.frombuffer(word.encode("utf-32-le"), np.uint32)[None, :]
        ids, _ = pieces.viterbi(vocabulary, chars)
        assert sum(vocabulary.score[i] if i >= 0 else vocabulary.unknown for i in ids) == pytest.approx(best(word), rel=1e-12)


def test_round_trip(path):
    vocabulary = pieces.load(path)
    texts = [*TEXTS, "literal ▁ mark ▁▁", "▁", "tail "]
    ids, counts = pieces.Encoder(vocabulary, keep=3).encode(texts)
    assert pieces.decode(vocabulary, ids, counts) == [t.encode() for t in texts]


def test_cut_words_loses_nothing():
    for t in [*TEXTS, "  \n  a\n b"]:
        assert "".join(pieces.cut_words(t)) == (" " + t)


def test_a_cache_of_any_size_gives_the_same(path):
    vocabulary = pieces.load(path)
    small, large = pieces.Encoder(vocabulary, keep=2), pieces.Encoder(vocabulary)
    for t in TEXTS * 2:
        assert small.encode([t])[0].tolist() == large.encode([t])[0].tolist()


def test_odd_rows(odd_docs, no_docs, path):
    rows = {r["doc_id"]: r for r in pieces.encode_pieces(odd_docs, path).collect()}
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in rows.values())
    assert rows[1]["ids"] == rows[2]["ids"] == [] and rows[4]["n_pieces"] > 60_000
    assert pieces.encode_pieces(odd_docs, path).count() == odd_docs.count()
    assert pieces.encode_pieces(no_docs, path).count() == 0
