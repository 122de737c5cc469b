"""Names against spellings: the equi-join on pieces finds what comparing all pairs does."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from montage.functions.phonetics import metaphone_key, sounds_like
from montage.operators import lexicon


def _made(rng, n):
    names = {"".join(rng.choices("abcde é", k=rng.randint(0, 14))) for _ in range(n)}
    for name in sorted(names)[: n // 2]:
        for _ in range(3):
            changed = list(name)
            for _ in range(rng.randint(1, 3)):
                at = rng.randint(0, len(changed))
                changed[at : at + rng.randint(0, 1)] = rng.choices("abcde", k=rng.randint(0, 1))
            names.add("".join(changed))
    return sorted(names)


@pytest.mark.parametrize("threshold", [0.4, 0.86, 1.0, 2.0])
def test_similar_keys_are_those_of_all_pairs(spark, threshold):
    rng = random.Random(3)
    names, spelled = _made(rng, 60), _made(rng, 60)
    spelled = sorted({*spelled, *names[::3]})
    want = {(a, b): SequenceMatcher(None, a, b).ratio() for a in names for b in spelled}
    want = {p: r for p, r in want.items() if r >= threshold}
    got = lexicon.similar_keys(spark.createDataFrame([(x,) for x in names], "key string"), spark.createDataFrame([(x,) for x in spelled], "spelled string"), threshold)
    assert {(r.key, r.spelled): r.ratio for r in got.collect()} == want
    assert bool(want) == (threshold <= 1)


def test_similar_keys_of_empty_tables(spark):
    none = spark.createDataFrame([], "key string")
    assert lexicon.similar_keys(none, spark.createDataFrame([("a",)], "spelled string"), 0.86).count() == 0
    assert lexicon.similar_keys(spark.createDataFrame([("a",)], "key string"), none.toDF("spelled"), 0.86).count() == 0


def test_sounds_like(spark):
    pairs = [("Knight", "night"), ("Wright", "rite"), ("Xander", "Sander"), ("", ""), ("12", "34"), ("Aether", "Ether"), ("Anna", "Otto"), (None, "Anna")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sounds_like(F.col("a"), F.col("b")).alias("like")).collect()
    assert [r.like for r in got] == [metaphone_key(a or "") == metaphone_key(b) != "" for a, b in pairs]
    assert got[0].like and got[2].like and not got[3].like and not got[4].like
