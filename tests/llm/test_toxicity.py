"""Learned insults against plain counting."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tickertide.llm import toxicity


def corpus():
    """Toxic texts that share no more than a few words, and clean ones with long tails of words."""
    rng = random.Random(5)

    def filler(k):
        return [f"{rng.choice('bcdfgklmnprst')}{rng.randrange(10**7):x}word{i}" for i in range(k)]

    rows = []
    for k in range(60):
        marks = [["numbskull"], ["numbskulls"], ["blockheadedness"], ["oaf"], ["common"]][k % 5]
        rows.append((" ".join([*filler(20), *marks, "neutral"]), 1))
    for k in range(200):
        rows.append((" ".join([*filler(15), "neutral", *(["common"] if k % 3 else [])]), 0))
    # Repeated and near copies count once; odd texts count as texts.
    rows += [rows[0]] * 5 + [(rows[1][0] + " more", 1), (None, 1), ("", 0), (None, 0), ("x " * 50_000, 0)]
    return rows


def plain_insults(rows, least=0.004, odds=4.0):
    toxic, clean, seen_texts = [], [], set()
    for text, label in rows:
        if not label:
            clean.append(toxicity._words(text or ""))
        elif (text or "") not in seen_texts and not (text or "").endswith(" more"):
            seen_texts.add(text or "")
            toxic.append(toxicity._words(text or ""))

    def holders(texts, p):
        if p.endswith("$"):
            return sum(p[:-1] in words for words in texts)
        return sum(any(w.startswith(p) for w in words) for words in texts)

    every = {p for words in toxic for w in words for p in [w + "$", *(w[:k] for k in range(4, min(len(w), 12) + 1))]}
    got = {}
    for p in every:
        c = holders(toxic, p)
        if c >= max(5, least * len(toxic)):
            weight = math.log((c + 0.5) / (len(toxic) + 1)) - math.log((holders(clean, p) + 0.5) / (len(clean) + 1))
            if weight >= odds:
                got[p] = min(weight, 10.0)
    return {p: w for p, w in got.items() if not any(p[:k] in got for k in range(4, len(p)))}


def test_learned_insults_equal_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "COUNTED", 50)
    rows = corpus()
    sample = spark.createDataFrame(rows, "text string, toxic int").repartition(5)
    got = toxicity.learn_insults(sample)
    want = plain_insults(rows)
    assert set(got) == set(want) and {"numb", "oaf$", "bloc"} <= set(got) and "common$" not in got
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert got == toxicity.learn_insults(sample.repartition(3))


def test_no_limit_on_patterns(spark):
    """Every pattern that qualifies is learned, however many there are."""
    words = [f"{chr(97 + k // 676)}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}q" for k in range(6000)]
    rng = random.Random(3)
    holders = [set(rng.sample(range(60), 6)) for _ in words]
    rows = []
    for k in range(60):
        mine = [w for w, h in zip(words, holders, strict=True) if k in h]
        rows.append((" ".join(mine), 1))
    rows += [("plain words of no note", 0)] * 400
    got = toxicity.learn_insults(spark.createDataFrame(rows, "text string, toxic int"))
    assert len([p for p in got if p.rstrip("$") in set(words)]) == len(words)


def test_nothing_toxic(spark):
    sample = spark.createDataFrame([("a b c", 0), (None, 0)], "text string, toxic int")
    assert toxicity.learn_insults(sample) == {} == toxicity.learn_insults(sample.where(F.lit(False)))
