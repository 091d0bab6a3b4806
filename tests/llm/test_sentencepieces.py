import random

import numpy as np
import public_tokenizers
import sentencepiece

from leafgraph.llm.sentencepieces import Pieces, decode, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, ids string, decoded string"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(1)
    alphabet = ["a", "b", "th", "ing", "é", "ß", " ", " ", "  ", "\n", "\t", ",", "日", "😀", "x" * 40, "The ", "1", "\x00", "\r\n"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    return out + ["", " ", "\n", "<s> </s> <unk> <0x41>", "a" * 500, "ab " * 3000]


def test_ids_are_those_of_the_library():
    model = Pieces(PATH)
    got = model.encode_batch(texts())
    for text, ids in zip(texts(), got):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text), repr(text)
        assert model.decode(np.frombuffer(ids, "<u4").tolist()) == text.encode()


def test_fold_of_a_lattice_is_the_fold_of_one_unit():
    model = Pieces(PATH)
    rng = random.Random(2)
    for size in (1, 2, 3, 7, 20, 32):
        units = ["".join(rng.choice("▁abceinorst日") for _ in range(size)) for _ in range(200)]
        assert model.fold(units, size) == [model.scalar(u) for u in units]


def test_viterbi_is_the_best_segmentation():
    model = Pieces(PATH)
    model.scores = {"a": -1.0, "b": -2.0, "ab": -2.5, "ba": -1.5, "aba": -9.0}
    model.longest = 3

    def every(s):
        return [[]] if not s else [[s[:k], *rest] for k in (1, 2, 3) if s[:k] in model.scores and len(s) >= k for rest in every(s[k:])]

    for unit in ("a", "ab", "abab", "babba", "aabbaab"):
        best = max(sum(model.scores[p] for p in parts) for parts in every(unit))
        assert sum(model.scores[p] for p in model.viterbi(unit)) == best


def test_round_trip(spark):
    rows = [(i, t, "a", "b") for i, t in enumerate(texts())] + [(None, "no id", "", ""), (7, None, "", ""), (7, None, "", "")]
    out = decode(encode(spark.createDataFrame(rows, DOCS).repartition(3), PATH), PATH).collect()
    assert sorted(((r.doc_id, r.decoded) for r in out), key=repr) == sorted((r[:2] for r in rows), key=repr)
    assert {(r.ids is None) == (r.decoded is None) for r in out} == {True}
    both = encode(spark.createDataFrame(rows, DOCS), PATH, back=True).collect()
    assert sorted(map(repr, both)) == sorted(map(repr, out))
    assert encode(spark.createDataFrame([], DOCS), PATH).count() == 0
