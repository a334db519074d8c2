"""Remembered words: looked up one by one, and their ids those of the whole text."""

from __future__ import annotations

import random

from spanloom.llm import rans
from spanloom.llm.common import Remembered


class Unwalked(Remembered):
    """Words that may be looked up, but not walked through for every batch of texts."""

    def __iter__(self):
        raise AssertionError("all remembered words were walked through")


def awkward_texts():
    rng = random.Random(3)
    letters = "ab .,;!?ªµº×÷éÿ\t\n   '’sD1½中🙂…"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    return [*made, "", " ", "... ...!", "don't  we'll,", "ordinary words, said twice: ordinary words."]


def test_batches_dont_walk_through_remembered_words():
    encoder = rans.Encoder(rans.vocabulary_path())
    encoder.known = Unwalked(1000)
    texts = awkward_texts()
    assert encoder.encode(texts) == encoder._whole(texts)


def test_ids_hold_as_words_are_forgotten():
    encoder = rans.Encoder(rans.vocabulary_path())
    encoder.known.most = encoder.letters.most = 20
    texts = awkward_texts()
    for at in range(0, len(texts), 30):
        some = texts[at : at + 30]
        assert encoder.encode(some) == encoder._whole(some)


def test_missing_words_move_from_the_older_generation():
    known = Remembered(2)
    known.update(a=1, b=2, c=3)
    assert sorted(known.missing({"a", "d"})) == ["d"]
    assert dict(known) == {"a": 1} and known.older == {"a": 1, "b": 2, "c": 3}
    assert known.missing({"a", "b"}) == [] and dict(known) == {"a": 1, "b": 2}
