"""Words that collide for every sum of powers, and words in general, keep apart."""

import random

import numpy as np
import pyarrow as pa

from tradewind.llm import token_shards, tokens, words
from tradewind.llm.ngram_join import near_groups
from tradewind.llm.substring_dedup import repeated_windows

ODD = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
EVEN = "".join("ba"[bin(i).count("1") % 2] for i in range(1024))


def hashes(texts, seed=0):
    buf = np.frombuffer(" ".join(texts).encode(), np.uint8)
    starts, ends, _ = words.word_spans(buf, np.array([0, len(buf)]))
    return words.span_hashes(buf, starts, ends, seed)


def test_hashes_depend_on_the_word_alone():
    rng = random.Random(2)
    some = ["".join(rng.choice("abé1") for _ in range(rng.randrange(1, 200))) for _ in range(3000)] + [ODD, EVEN, ODD[:64], ODD[:65]]
    for seed in (0, 1):
        given = hashes(some, seed)
        again = hashes(some[::-1], seed)[::-1]
        assert (given == again).all()
        assert len(set(given.tolist())) == len(set(some))
    assert (hashes(some) != hashes(some, 1)).all()


def test_prepared_words_are_not_the_same(spark):
    same = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{same} {ODD}"), (2, f"{same} {EVEN}")], "doc_id long, text string")
    assert repeated_windows(docs).count() == 0
    groups = near_groups(docs.selectExpr("doc_id", "concat(text, ' ', text) AS text")).collect()
    assert len({r.class_id for r in groups}) == 2


def test_tokens_spell_the_text_whatever_the_hashes(monkeypatch):
    encoder = tokens.Encoder(token_shards.VOCABULARY)
    texts = pa.array([ODD, EVEN, f"{ODD} {EVEN} and more"], pa.large_string())

    def ids_of():
        _, _, buf, bounds = next(words.blocks(texts))
        ids, at = encoder.encode(buf, bounds)
        return [encoder.encoding.decode(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]

    assert ids_of() == texts.to_pylist()
    # Even if all pieces had one key, or all long ones the same hashes.
    for name, same in (("mixed", lambda x: x * np.uint64(0)), ("span_hashes", lambda buf, starts, ends, seed=0: starts.astype(np.uint64) * np.uint64(0))):
        with monkeypatch.context() as patched:
            encoder._forget()
            patched.setattr(tokens, name, same)
            assert ids_of() == texts.to_pylist()
