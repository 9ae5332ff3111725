import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import LONG, ODD, documents, words

from winnower.llm import ctw

DEPTH = ctw.DEPTH


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Tree:
    """The same model by brute force: a dictionary of all nodes."""

    def __init__(self, streams):
        self.n, self.children, self.known = defaultdict(lambda: [0, 0]), defaultdict(set), {}
        for s in streams:
            for i in range(DEPTH, len(s)):
                for d in range(DEPTH + 1):
                    m = 1
                    for j in range(7, -1, -1):
                        bit = s[i] >> j & 1
                        self.n[s[i - d : i], m][bit] += 1
                        m = m * 2 + bit
        for c, m in list(self.n):
            if c:
                self.children[c[1:], m].add(c)

    def below(self, c, m):
        return sum(self.weighted(k, m) for k in self.children[c, m])

    def weighted(self, c, m):
        if (c, m) not in self.known:
            a = kt(*self.n[c, m])
            if len(c) < DEPTH:
                b = self.below(c, m)
                top = max(a, b)
                a = top + math.log(math.exp(a - top) + math.exp(b - top)) - math.log(2)
            self.known[c, m] = a
        return self.known[c, m]

    def probability(self, c, m, bit):
        p = None
        for d in range(DEPTH, -1, -1):
            x = c[DEPTH - d :]
            if (x, m) in self.n:
                n = self.n[x, m]
                own = (n[bit] + 0.5) / (sum(n) + 1)
                if p is None:
                    p = own
                else:
                    w = 1 / (1 + math.exp(max(-700, min(700, self.below(x, m) - kt(*n)))))
                    p = w * own + (1 - w) * p
        return 0.5 if p is None else p

    def score(self, s):
        total = 0.0
        for i in range(DEPTH, len(s)):
            m = 1
            for j in range(7, -1, -1):
                bit = s[i] >> j & 1
                total += math.log10(self.probability(s[i - DEPTH : i], m, bit))
                m = m * 2 + bit
        return total


def stream(text):
    return ("\n" * DEPTH + "".join(w + " " for w in words(text)) + "\n").encode()


def test_scores_equal_brute_force(spark):
    texts = ["the cat sat on the mat", "The cat ate", "a dog sat", "der Hund saß", "the the the", "zebra", "cat mat", "on a mat sat the cat"] * 4
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [r for r in ODD if r[1] != LONG]
    got = ctw.score_texts(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    train = [t for i, t, _ in rows if not held(i)]
    tokens = Counter(x for t in train for x in [*words(t), "\n"])
    total, distinct = sum(tokens.values()), len(tokens)
    tree = Tree([stream(t) for t in train])
    want = Counter()
    for i, t, _ in rows:
        w = [*words(t), "\n"]
        base = sum(math.log10((tokens[x] + 1) / (total + distinct + 1)) for x in w)
        want[i, held(i), len(w), sum(tokens[x] > 0 for x in w), total, round(base, 6), round(tree.score(stream(t)), 3)] += 1
    assert want == Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 3)) for r in got)


def test_readings_that_are_split_differently(spark, tmp_path, monkeypatch):
    """The texts are read twice; splits that change in between move no row to another block."""
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randint(0, 300)}" for _ in range(60)), "s") for i in range(3000)] + [(7, "equal rows", "s")] * 50
    path = str(tmp_path / "docs.parquet")
    documents(spark, rows).coalesce(1).sortWithinPartitions("doc_id").write.option("parquet.block.size", 65536).parquet(path)
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 100_000)
    want = Counter(tuple(r) for r in ctw.score_texts(spark.read.parquet(path)).collect())
    key, own = "spark.sql.files.maxPartitionBytes", ctw.materialize

    def then_split(df, name, *more):
        done = own(df, name, *more)
        spark.conf.set(key, "32k")
        return done

    monkeypatch.setattr(ctw, "materialize", then_split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        docs = spark.read.parquet(path)
        got = ctw.score_texts(docs)
        assert got.rdd.getNumPartitions() and Counter(tuple(r) for r in got.collect()) == want
        spark.conf.unset(key)
        derived = ctw.score_texts(docs.union(docs.limit(0)).repartition(3))
        assert Counter(tuple(r) for r in derived.collect()) == want
    finally:
        spark.conf.unset(key)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_long_text_and_empty_table(spark):
    got = {r["doc_id"]: r for r in ctw.score_texts(documents(spark, ODD)).collect()}
    assert got[6]["n_tokens"] == 30_001 and (held(6) or got[6]["bits_per_byte"] < 0.5)
    assert ctw.score_texts(documents(spark, [])).collect() == []


def test_log_gamma():
    import numpy as np

    x = np.array([0.5, 1, 3.5, 1e3, 1e7])
    assert ctw.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)
