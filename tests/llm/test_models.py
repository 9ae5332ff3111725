import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from helpers import ODD, documents, with_clash

from winnower.llm import crf, langid, toxicity, vamana

SYLLABLES = {"aa": ("the", "and", "ing", "tion"), "bb": ("der", "ung", "sch", "ein"), "cc": ("que", "eau", "ment", "ait")}


def held(i, m, r):
    return i is not None and zlib.crc32(str(i).encode()) % m == r


def spoken(draw, lang, n):
    return " ".join("".join(draw.choice(SYLLABLES[lang], draw.integers(1, 4))) for _ in range(n))


# Fields


def enumerated(score, step):
    """Marginals and expected transitions from every labelling of one chain."""
    n, m = score.shape
    weight = {p: math.exp(sum(score[t, k] for t, k in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:], strict=False))) for p in np.ndindex(*[m] * n)}
    total, want, pairs = sum(weight.values()), np.zeros((n, m)), np.zeros((m, m))
    for path, w in weight.items():
        for t, k in enumerate(path):
            want[t, k] += w / total
        for a, b in zip(path, path[1:], strict=False):
            pairs[a, b] += w / total
    return want, pairs


def test_forward_backward_equals_enumeration_across_blocks():
    draw = np.random.default_rng(0)
    sizes = [7, 1, 2, 4, 6, 3]
    text = np.repeat([0, 1, 2, 5, 6, 9], sizes)
    score, step = 2 * draw.normal(size=(len(text), 3)), 2 * draw.normal(size=(3, 3))
    parts = [enumerated(part, step) for part in np.split(score, np.cumsum(sizes)[:-1])]
    want, pairs = np.concatenate([w for w, _ in parts]), sum(p for _, p in parts)
    for length in (1, 2, 3, 64):
        got, moves = crf.forward_backward(score, step, text, pairs=True, length=length)
        assert np.allclose(got, want, atol=1e-5) and np.allclose(moves, pairs, atol=1e-5)


def test_a_word_feels_another_hundreds_of_words_away():
    n = 3 * crf.BLOCK + 5
    score, step = np.zeros((n, 2)), np.array([[5.0, -5.0], [-5.0, 5.0]])
    score[0, 1] = 40
    got, _ = crf.forward_backward(score, step, np.zeros(n, int))
    assert got[-1, 1] > 0.9


# Languages


def test_held_out_accuracy(spark):
    draw = np.random.default_rng(2)
    rows = []
    for i in range(400):
        lang = list(SYLLABLES)[i % 3]
        rows.append((i, spoken(draw, lang, int(draw.integers(3, 40))), lang))
    df = with_clash(spark.createDataFrame([(i, t, x, "s", len(t)) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long"))
    got = {r["doc_id"]: r for r in langid.language_id(df).collect()}
    tested = [(i, x) for i, _, x in rows if held(i, 4, 2)]
    assert all(got[i]["held_out"] == held(i, 4, 2) for i, _, _ in rows)
    assert sum(got[i]["lang_pred"] == x for i, x in tested) / len(tested) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_code_switched_text_has_both(spark):
    draw = np.random.default_rng(3)
    rows = [(spoken(draw, x, 30), x) for x in SYLLABLES for _ in range(60)]
    model = langid.fit_languages(spark.createDataFrame(rows, "text string, lang string"))
    mixed = spoken(draw, "aa", 30) + " " + spoken(draw, "bb", 20)
    row = langid.identify_languages(spark.createDataFrame([(1, mixed, False)], "doc_id long, text string, held_out boolean"), model).first()
    assert row["lang_pred"] == "aa" and row["lang_shares"]["bb"] > 0.25 and row["lang_shares"]["cc"] < 0.15


def test_odd_texts_and_no_labels(spark):
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.language_id(documents(spark, ODD)).collect()]
    assert len(got) == len(ODD) and {(1, "und"), (2, "und"), (3, "und")} <= set(got) and (4, "en") in got
    none = langid.language_id(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")).first()
    assert none["lang_pred"] == "und" and none["score"] == 0
    assert langid.language_id(documents(spark, [])).collect() == []


def test_labels_of_long_texts_only_are_learned(spark):
    draw = np.random.default_rng(6)
    rows = [(spoken(draw, "aa", 30), "aa") for _ in range(40)] + [(spoken(draw, "bb", 4000), "bb") for _ in range(12)]
    assert all(len(t) > langid.BYTES_PER_ROW for t, x in rows if x == "bb")
    model = langid.fit_languages(spark.createDataFrame(rows, "text string, lang string"))
    row = langid.identify_languages(spark.createDataFrame([(1, spoken(draw, "bb", 20), False)], "doc_id long, text string, held_out boolean"), model).first()
    assert row["lang_pred"] == "bb"
    labelled = [(spoken(draw, "aa", 30), 0) for _ in range(40)] + [(spoken(draw, "aa", 2500) + " vileword" * 3 + spoken(draw, "aa", 2500), 1) for _ in range(12)]
    assert toxicity.fit_toxicity(spark.createDataFrame(labelled, "text string, toxic int")) is not None


def test_sample_is_of_distinct_texts_and_bounded(spark):
    copies = [("the same text", "aa")] * 500 + [(f"text {i}", "aa") for i in range(30)]
    got = [r["text"] for r in langid.sample(spark.createDataFrame(copies, "text string, lang string"), 40, "lang").collect()]
    assert len(got) == len(set(got)) == 31
    long = [("".join(chr(0x4E00 + (i * j) % 999) for j in range(9000)) + f" {i}", "cc") for i in range(20)]
    got = [r["text"] for r in langid.sample(spark.createDataFrame(long, "text string, lang string"), 4, "lang").collect()]
    assert 1 <= len(got) <= 4 and sum(len(t.encode()) for t in got) <= 4 * langid.BYTES_PER_ROW


# Toxicity


def toxic_tables(spark, n=600):
    draw = np.random.default_rng(4)
    docs, labels = list(ODD), []
    for i in range(100, 100 + n):
        w = spoken(draw, "aa", 40).split()
        bad = i % 5 == 0
        if bad:
            for k in range(3):
                w[5 * k + 2] = draw.choice(["vileword", "grimstuff", "vilename"]) + ("s" if i % 2 else "")
        docs.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(bad)))
    return documents(spark, docs), spark.createDataFrame([*labels, (None, 1, 1), (100, 1, None)], "doc_id long, quality int, toxic int")


def test_toxic_documents_and_spans(spark):
    docs, labels = toxic_tables(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    tested = [i for i in got if i is not None and i >= 100 and held(i, 5, 0)]
    assert all(r["held_out"] == held(i, 5, 0) for i, r in got.items())
    assert sum(got[i]["predicted"] == (i % 5 == 0) for i in tested) / len(tested) >= 0.97
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = next(i for i in tested if i % 5 == 0)
    words = {text[toxic][s["start"] : s["end"]] for s in got[toxic]["spans"]}
    assert words and all(w.startswith(("vile", "grim")) for w in words)
    assert len(got) == len({i for i, _, _ in ODD}) + 600 and all(0 <= r["score"] <= 1 for r in got.values())


def test_stage_keeps_columns_and_clean_rows(spark):
    docs, labels = toxic_tables(spark)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids[4] == 2 and ids[1] == 1 and not any(ids[i] for i in range(100, 700, 5))
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_spans_are_code_points(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.fit_toxicity(toxicity.labelled_texts(docs, labels))
    text = "é日本 the vileword ing"
    row = toxicity.score_toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == ["vileword"]


# Nearest neighbours


def test_recall_ties_and_rows_that_take_no_part(spark):
    draw = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=16)]) for i in range(1, 1500)]
    same = [0.25] * 16
    rows += [(5000 + i, same) for i in range(40)] + [(5001, same)]
    odd = [(6000, None), (6100, []), (6200, [0.0] * 16), (6300, [float("nan")] * 16), (6400, [float("inf")] * 16), (6500, [None] * 16), (None, same), (7000, [1.0, 2.0]), (7001, [1.0, 2.5]), (8000, [9.0])]
    df = with_clash(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"))
    got = defaultdict(list)
    for r in vamana.nearest(df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    points = dict(rows)
    ids = np.array(sorted(points))
    x = np.array([points[i] for i in ids])
    found = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - points[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]].tolist()
        answer = sorted(got[q])
        assert [r for r, _, _ in answer] == list(range(1, 11))
        assert [s for _, _, s in answer] == sorted(s for _, _, s in answer)
        assert all(abs(s - d[ids == v][0]) < 1e-12 for _, v, s in answer)
        found, total = found + len(set(want) & {v for _, v, _ in answer}), total + 10
        if q == 5000:
            assert [v for _, v, _ in answer] == list(range(5001, 5011))
    assert found / total >= 0.9
    assert got[7000] == [(1, 7001, 0.5)]
    assert set(got) == {*ids[ids % 100 == 0].tolist(), 7000}
    assert vamana.nearest(df.limit(0)).collect() == []


def test_every_node_is_reached():
    draw = np.random.default_rng(8)
    points = np.concatenate([draw.normal(size=(300, 8)), draw.normal(size=(3, 8)) + 100, draw.normal(size=(2, 8)) - 500])
    graph, start = vamana.build_graph(points)
    seen = np.zeros(len(points), bool)
    vamana.reached(graph, seen, start)
    assert seen.all()
