import base64
import hashlib
import math
import random
import re
from collections import Counter

import pytest
from helpers import LONG, LOWER, ODD, documents, with_clash
from oracle import DATA, compare

from winnower.llm import bpe, codebooks, entries, ranked


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_vector_codes"])
def test_query_equals_its_sql(spark, name):
    assert compare(spark, entries.QUERIES[name], entries.ORACLE_SQL[name])


# Byte-level BPE


def test_ids_equal_the_library(spark, library):
    rng = random.Random(3)
    texts = ["".join(chr(c) for c in range(a, a + 200) if not 0xD800 <= c < 0xE000) for a in range(0, 0x20000, 200)]
    texts += ["".join(rng.choice("ab \n\t 　é1'sx.,|<\x1c\x85") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["<|endoftext|> x", "aaaa" * 50, "it's we'll I'm don't", LONG, None, ""]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in bpe.encode(documents(spark, [*rows, (7, texts[7], "s")]), decoded=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i]["ids"] == library.encode_ordinary(t or ""), t
        assert got[i]["decoded"] == (t or "").encode()


def test_very_long_pretokens(library):
    rng = random.Random(5)
    own = bpe.Codec(bpe.VOCABULARY)
    for token in ("a" * 30_000, "".join(rng.choice("abcdefgh") for _ in range(60_000)), "日本語" * 5000):
        alone, joint = own.token_ids(token), own.merge([b"first", token.encode(), b"qzqz"])
        assert alone == library.encode_ordinary(token)
        assert joint[1] == bytes(memoryview(__import__("array").array("I", alone)))


def test_ranks_that_fall_back_are_merged_alone(tmp_path):
    """A table in which a merge makes a pair of lower rank: equal to merging by hand, leftmost lowest pair first."""
    tokens = [bytes([i]) for i in range(256)]
    tokens += [b"aba", b"xy", b"ab", b"ba", b"xyx", b"yx"]
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    own = bpe.Codec(str(path))
    ranks = {t: i for i, t in enumerate(tokens)}

    def by_hand(token):
        parts = [token[i : i + 1] for i in range(len(token))]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(1)
    words = [bytes(rng.choice(b"abxyz") for _ in range(rng.randint(2, 30))) for _ in range(3000)]
    got = own.merge(words)
    for w, ids in zip(words, got, strict=True):
        assert list(memoryview(ids).cast("I")) == by_hand(w), w
        assert bpe.merged(w, own.ranks, own.queue) == by_hand(w), w


def test_digests_and_decode(spark, library):
    docs = documents(spark, ODD)
    want = Counter()
    for i, t, _ in ODD:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digests(docs).collect()) == want
    assert bpe.digests(docs.where("false")).count() == 0
    again = bpe.decode(bpe.encode(docs)).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in again) == Counter((i, (t or "").encode()) for i, t, _ in ODD)
    lost = bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect()
    assert {r["doc_id"]: r["decoded"] for r in lost} == {1: None, 2: b""}


# Ranked search

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall((text or "").translate(LOWER))


def by_scan(docs, items, places=20):
    held = [(i, Counter(terms(t))) for i, t, *_ in docs]
    held = [(i, c) for i, c in held if c]
    total, n_docs = sum(sum(c.values()) for _, c in held), len(held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in set(items):
        asked.setdefault(i, Counter()).update(terms(t))
    out = Counter()
    for item, wanted in asked.items():
        scores = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in wanted.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(scores)[:places], 1):
            out[item, rank, None if none else i, -s] += 1
    return out


ITEMS = "item_id long, text string"


def test_search_equals_a_scan(spark):
    rng = random.Random(2)
    word = [f"w{int(rng.expovariate(0.05))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(word) for _ in range(rng.randint(0, 80))), "s") for i in range(600)]
    docs += [(1000 + i, docs[3][1], "s") for i in range(50)] + [(i, None if i % 2 else "", "s") for i in range(2000, 2010)] + ODD + [(None, docs[5][1], "s")]
    items = [(i, " ".join(rng.choice(word) for _ in range(rng.randint(1, 30)))) for i in range(40)]
    items += [(50, docs[3][1]), (51, "nowhere"), (52, None), (53, ""), (54, "w1 w1 W1"), (50, docs[3][1]), (55, "w1"), (55, "w2"), (None, docs[5][1])]
    found = ranked.ranked_search(documents(spark, docs).repartition(3), with_clash(spark.createDataFrame(items, ITEMS)))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == by_scan(docs, items)


def test_many_segments_and_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(i, " ".join(f"t{rng.randint(0, 60)}" for _ in range(rng.randint(1, 30))), "s") for i in range(300)]
    items = [(i, " ".join(f"t{rng.randint(0, 70)}" for _ in range(8))) for i in range(20)]
    monkeypatch.setattr(ranked, "BLOCK", 500)
    frame, asked = documents(spark, docs).repartition(7), spark.createDataFrame(items, ITEMS)
    index = ranked.build_index(frame)
    assert index.segments.count() >= 7
    assert Counter(tuple(r) for r in ranked.search_index(index, asked, 5).collect()) == by_scan(docs, items, 5)


def test_search_of_empty_tables(spark):
    none, asked = documents(spark, []), spark.createDataFrame([(1, "a b")], ITEMS)
    assert ranked.ranked_search(none, asked).count() == 0
    assert ranked.ranked_search(documents(spark, [(1, None, "s"), (2, " . ", "s")]), asked).count() == 0
    assert ranked.ranked_search(documents(spark, ODD), asked.where("false")).count() == 0


def test_search_splits_few_documents():
    """Best-first search scores a small share of a segment's documents."""
    import numpy as np

    rng = np.random.default_rng(1)
    size = 20_000
    numbers, docs, impacts = [], [], []
    for t in range(12):
        d = np.flatnonzero(rng.random(size) < 0.02 + 0.03 * t)
        numbers.append(np.full(len(d), t)), docs.append(d), impacts.append(rng.integers(1, 1000, len(d)))
    lists = ranked.Lists(np.concatenate(numbers), np.concatenate(docs), np.concatenate(impacts), size)
    weights = np.arange(12, 0, -1)
    asked = []
    place = lists.place
    lists.place = lambda keys: asked.append(keys.size) or place(keys)
    best, scores = lists.best(np.arange(12), weights, 20)
    total = np.zeros(size, np.int64)
    np.add.at(total, np.concatenate(docs), np.concatenate(impacts) * weights[np.concatenate(numbers)])
    order = np.lexsort((np.arange(size), -total))[:20]
    assert best.tolist() == order.tolist() and scores.tolist() == total[order].tolist()
    assert sum(asked) / 12 < size / 2


# Vector codes

VECTORS = "vec_id long, embedding array<float>, label int"


def by_rounds(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    size = width // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else e for j, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    last = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in x) for x in last]
    by_label = Counter()
    for (_, _, k), e in zip(kept, errors, strict=True):
        by_label[k] += e
    return Counter((i, "".join(f"{j:02x}" for _, j in x), e, by_label[k], digest) for (i, _, k), x, e in zip(kept, last, errors, strict=True))


def test_codes_equal_plain_rounds(spark):
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)], rng.choice([0, 1, None])) for i in range(700)]
    rows = [(i, [float(spark_float(x)) for x in v], k) for i, v, k in rows]
    rows += [(2000 + i, rows[0][1], 0) for i in range(300)]  # a large group of copies
    rows += [(5, rows[5][1], 1), (5, rows[5][1], 1), (None, rows[9][1], 1)]
    odd = [(3000, None, 0), (3001, [1.0] * 15 + [None], 0), (3002, [float("nan")] + [0.0] * 15, 1), (3003, [float("inf")] * 16, 1), (3004, [1.0] * 8, 1), (3005, [], 0), (3006, [-0.0] * 16, None), (3007, [0.0] * 16, None)]
    frame = with_clash(spark.createDataFrame(rows + odd, VECTORS)).repartition(3)
    got = Counter(tuple(r) for r in codebooks.vector_codes(frame).collect())
    assert got == by_rounds(rows + [r for r in odd if r[1] is not None and len(r[1]) == 16])


def spark_float(x):
    import numpy as np

    return np.float32(x)


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e12])
def test_few_and_large_vectors(spark, scale):
    rng = random.Random(8)
    rows = [(i, [float(spark_float(scale * rng.choice([-1, 1, 2, 2.5]))) for _ in range(8)], i % 2) for i in range(30 if scale > 1 else 5)]
    got = Counter(tuple(r) for r in codebooks.vector_codes(spark.createDataFrame(rows, VECTORS)).collect())
    want = by_rounds(rows)
    if max(w[3] for w in want) < 1 << 63:
        assert got == want
    else:
        assert Counter(r[:2] for r in got.elements()) == Counter(r[:2] for r in want.elements())


def test_codes_of_an_empty_table(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert codebooks.vector_codes(empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codebooks.vector_codes(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0


def test_bounds_save_distances():
    """In later rounds most parts keep their entry unseen, and few look at all entries."""
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(0, 3000, (16, 1, 8))
    vectors = (centres[rng.integers(0, 16, 4000)] + rng.normal(0, 300, (4000, 1, 8))).astype(np.int64)
    books = vectors[:16].transpose(1, 0, 2).copy()
    code, bounds = codebooks.first_look(vectors, books, 5)
    needs = []
    for _ in range(6):
        sums = [vectors[code[:, 0] == e, 0] for e in range(16)]
        new = np.array([[s.sum(0) // len(s) if len(s) else books[0, e] for e, s in enumerate(sums)]])
        moves = np.sqrt(((new - books) ** 2).sum(-1)) * (1 + 1e-12)
        books = new
        bounds.shift(code, moves)
        needs.append(codebooks.look_again(vectors, books, code, bounds))
        plain = codebooks.distances(vectors[:, 0][:, None, :], books[0]).argmin(1)
        assert (code[:, 0] == plain).all()
        again = codebooks.Bounds.unpack(bounds.pack(), 1)
        assert (again.lower <= bounds.lower).all() and (again.upper >= bounds.upper).all()
    assert needs[-1][0] > 0.5 * len(vectors) and needs[-1][-1] < 0.1 * len(vectors)
