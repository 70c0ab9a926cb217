"""Samples of any number of classes, and language models against plain dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.llm import langid, sampling, shared


# samples


def test_every_class_is_drawn(spark, monkeypatch):
    rows = spark.range(3_000).select((F.col("id") % 1_500).cast("string").alias("class"), F.concat(F.lit("text "), "id").alias("text"), F.col("id"))
    monkeypatch.setattr(sampling, "ROWS", 1_600)
    with shared.scratch():
        drawn, counts, most = sampling.draw(rows, 500, F.col("id"))
        found = sampling.smallest(drawn, most)
        assert most == 1 and counts.count() == 1_500
    assert len(found) == 1_500 == len({c for _, c in found})


@pytest.mark.parametrize("characters, sizes", [(400_000_000, [3, 3]), (60, [3, 2]), (50, [2, 1]), (2, [1, 1])])
def test_long_texts_and_the_share_of_characters(spark, monkeypatch, characters, sizes):
    """Of class a short texts stay first; of class b there are long ones alone, and the shortest of them is the first."""
    monkeypatch.setattr(sampling, "LONGEST", 20)
    monkeypatch.setattr(sampling, "CHARACTERS", characters)
    rows = [("a", k, "x" * (10 if k < 5 else 90)) for k in range(8)] + [("b", k, "y" * (50 - k if characters > 99 else 15 if k < 2 else 40)) for k in range(4)]
    with shared.scratch():
        found = sampling.smallest(spark.createDataFrame(rows, "class string, h int, text string"), 3)
    assert [sum(c == k for _, c in found) for k in "ab"] == sizes
    assert max(len(t) for t, c in found if c == "a") == 10
    if characters > 99:
        assert sorted(len(t) for t, c in found if c == "b") == [47, 48, 49]


def test_samples_of_one_seed_agree_and_repeated_ids_add_nothing(spark):
    rows = spark.range(4_000).selectExpr("id", "if(id % 10 = 0, 1, 0) as class", "concat('t', id) as text")
    with shared.scratch():
        once = sampling.smallest(*[sampling.draw(rows, 50, F.col("id"))[k] for k in (0, 2)])
        again = sampling.smallest(*[sampling.draw(rows.union(rows).repartition(5), 25, F.col("id"))[k] for k in (0, 2)])
    assert Counter(c for _, c in once) == {0: 50, 1: 50} and Counter(c for _, c in again) == {0: 25, 1: 25}
    assert set(again) <= set(once)


# languages


class Plain:
    """Interpolated Kneser-Ney over characters of framed words, by dictionaries."""

    def __init__(self, texts, order):
        self.order, self.known = order, {}
        words = Counter(w for t in texts for w in t.lower().split())
        full = [Counter() for _ in range(order + 1)]  # occurrences of n-grams that end behind the begin mark
        before = [defaultdict(set) for _ in range(order + 1)]  # the (n+1)-grams an n-gram ends
        begins = [Counter() for _ in range(order + 1)]  # occurrences with no character before
        for w, times in words.items():
            framed = "\x02" + w + "\x02"
            for end in range(1, len(framed)):
                for n in range(1, min(order, end + 1) + 1):
                    gram = framed[end + 1 - n : end + 1]
                    full[n][gram] += times
                    if end + 1 - n > 0:
                        before[n][gram].add(framed[end - n : end + 1])
                    else:
                        begins[n][gram] += times
        self.counts = [None] * (order + 1)
        for n in range(1, order + 1):
            self.counts[n] = dict(full[n]) if n == order else {g: len(before[n][g]) + begins[n][g] for g in full[n]}
        self.discount, self.total, self.kinds = {}, {}, {}
        for n in range(1, order + 1):
            ones, twos = (sum(c == k for c in self.counts[n].values()) for k in (1, 2))
            self.discount[n] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            self.total[n], self.kinds[n] = Counter(), Counter()
            for g, c in self.counts[n].items():
                self.total[n][g[:-1]] += c
                self.kinds[n][g[:-1]] += 1

    def p(self, gram):
        if gram not in self.known:
            self.known[gram] = self.chance(gram)
        return self.known[gram]

    def chance(self, gram):
        n = len(gram)
        lower = self.p(gram[1:]) if n > 1 else 1 / 65536
        if not self.total[n][gram[:-1]]:
            return lower
        total, d = self.total[n][gram[:-1]], self.discount[n]
        return max(self.counts[n].get(gram, 0) - d, 0) / total + d * self.kinds[n][gram[:-1]] / total * lower

    def cost(self, text):
        """Nats a character, marks of ends included."""
        nats = chars = 0
        for w in text.lower().split():
            framed = "\x02" + w + "\x02"
            for end in range(1, len(framed)):
                nats -= math.log(max(self.p(framed[max(0, end + 1 - self.order) : end + 1]), 1e-12))
                chars += 1
        return nats / chars


@pytest.mark.parametrize("order", [2, 3, 4])
def test_costs_equal_those_of_dictionaries(order):
    r = random.Random(order)
    corpora = {lang: [" ".join("".join(r.choices(letters, k=r.randint(1, 7))) for _ in range(60)) for _ in range(4)] for lang, letters in (("a", "abcde"), ("b", "cdefgß"), ("c", "中文字"))}
    model = langid.KneserNey(corpora, order)
    plain = [Plain(corpora[lang], order) for lang in model.langs]
    scorer = langid.Scorer(model)
    for _ in range(40):
        text = " ".join("".join(r.choices("abcdefgß中文zЖ", k=r.randint(1, 9))) for _ in range(r.randint(1, 6)))
        assert scorer.entropy(text) == pytest.approx([p.cost(text) for p in plain], rel=2e-4)


def test_the_query_predicts_what_dictionaries_do(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    drawn, most = {}, langid.ROWS + langid.ROWS // 4
    with shared.scratch():
        known = docs.where(~langid.held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").alias("class"), "text", F.col("doc_id").cast("string").alias("key"))
        found = sampling.smallest(sampling.draw(known, most, F.col("key"))[0], most)
    for k, (text, lang) in enumerate(found):
        if k % 5 != 4:
            drawn.setdefault(lang, []).append(text)
    plain = {lang: Plain(texts, langid.ORDER) for lang, texts in drawn.items()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.identify(docs, model).where("lang_pred <> 'und'").orderBy("doc_id").limit(25).collect():
        costs = {lang: p.cost(texts[r.doc_id]) for lang, p in plain.items()}
        assert r.lang_pred == min(costs, key=costs.get)
    assert np.isfinite(model.limit).any()
