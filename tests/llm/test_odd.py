"""Clashing names, hot groups, bounds of slices, and models against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from helpers import ODD
from pyspark.sql import functions as F
from test_models import enumerated, toxic_tables

from winnower.llm import common, crf, decontaminate, jaccard, langid, linespread, packing, secrets, sharding, toxicity, vamana

CLASH = {"score": "'mine'", "predicted": "1L", "spans": "7", "n_words": "'n'", "items": "map('a', 1)", "_text": "2.5", "_clean": "3", "_cut": "'c'", "_rest": "4", "_id": "5", "_whole": "'w'", "_key": "6", "Tokens": "array(1)"}


def clashing(spark, rows):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id int, text string, lang string, source string, n_chars int")
    return df.withColumns({k: F.expr(v) for k, v in CLASH.items()})


def test_stages_keep_values_and_types_of_other_columns(spark):
    docs = clashing(spark, [*ODD, (40, "alpha beta gamma delta epsilon zeta", "s9")])
    _, labels = toxic_tables(spark, 20)
    tests = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    for stage in (lambda d: toxicity.drop_toxic(d, labels), linespread.drop_boilerplate, jaccard.keep_one, lambda d: decontaminate.remove_contamination(d, tests)):
        out = stage(docs)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        rows = out.collect()
        assert len(rows) >= len(ODD) - 2
        want = docs.first().asDict()
        assert all(r[c] == want[c] for r in rows for c in CLASH)
    assert stage(docs).where("doc_id = 40").first()["text"] == " delta epsilon zeta"


def test_keep_one_goes_by_id_and_text(spark):
    a, b = "one text of seven words in all", "another text that has nothing like it"
    rows = [(1, a, "s"), (5, a, "s"), (5, b, "s"), (5, b, "s"), (None, b, "s"), (None, "a text that only a null id has", "s"), (6, None, "s"), (6, None, "s"), (7, "", "s")]
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.keep_one(clashing(spark, rows)).collect())
    assert kept == Counter([(1, a), (5, b), (None, "a text that only a null id has"), (6, None), (7, "")])


def test_similar_sets_that_a_larger_one_heads(spark):
    """Two short texts that share their rarest shingles with a long one only must be linked with each other."""
    words = [f"w{i}" for i in range(400)]
    short = " ".join(words[:24])
    rows = [(1, " ".join(words), "s"), (2, short, "s"), (3, short + " end", "s"), (4, "x " + short, "s"), *((10 + i, " ".join(words[i : i + 30]), "s") for i in range(0, 300, 7))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_components(clashing(spark, rows), jaccard.Rule()).collect()}
    assert got[2] == got[3] == got[4] and got[1] == 1


def test_slices_bound_rows_and_bytes():
    import pyarrow as pa

    texts = [f"short text {i}" for i in range(9000)] + ["x" * (9 << 20)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = list(common.byte_slices(batch))
    assert [t for p in parts for t in p["text"].to_pylist()] == texts and max(p.num_rows for p in parts) <= common.SLICE_ROWS
    sizes = [n for p in parts[:-1] for n in jaccard.token_sets(p["text"], 4).size.tolist()]
    assert sizes == [1] * 9000


def test_sketch_decides_far_from_the_threshold(spark):
    rows = [(i, f"own {i}\neverywhere\non five\n" if i < 5 else f"own {i}\neverywhere", f"site{i}") for i in range(30)]
    got = {r["doc_id"]: r for r in linespread.line_dedup(clashing(spark, rows)).collect()}
    assert [got[i]["n_cut"] for i in range(30)] == [0] + [2] * 4 + [1] * 25


def test_lines_leave_a_long_text_in_order(spark):
    lines = [f"line {i}" for i in range(20_000)]
    df = spark.createDataFrame([("\n".join(lines), list(range(0, 20_000, 3))), ("a\n\nb", [0, 2]), ("a", [0]), ("a", None)], "text string, cut array<int>")
    got = [r[0] for r in df.select(linespread.without_lines(F.col("text"), F.col("cut"))).collect()]
    assert got == ["\n".join(x for i, x in enumerate(lines) if i % 3), "", "", "a"]


def test_secrets_of_long_empty_and_repeated_texts(spark):
    long = " ".join(f"password={i:06d}x" for i in range(3000)) + " " + "é" * 1000 + " AKIA" + "A" * 16
    got = {r["doc_id"]: r for r in secrets.find_secrets(clashing(spark, [(1, long, "s"), (2, "token=abcdef", "s"), (3, None, "s")])).collect()}
    spans = [f"assign:{m.start()}:{m.end()}" for m in re.finditer(r"password=[0-9a-z]+", long)] + [f"access:{len(long) - 20}:{len(long)}"]
    assert got[1]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest() and got[1]["n_assign"] == 3000 and got[1]["n_access"] == 1
    assert got[3]["spans"] == "" and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    twice = clashing(spark, [(2, "token=abcdef", "s")] * 2)
    assert [r["spans"] for r in secrets.find_secrets(twice).collect()] == ["assign:0:12"] * 2
    assert secrets.find_secrets(twice.limit(0)).collect() == []


def test_one_very_long_text_in_shards(spark):
    rows = [(i, "x" * (1_000_000 if i == 3 else 9), "s") for i in range(20)]
    got = sharding.byte_shards(clashing(spark, rows)).collect()
    assert len(got) == 20 and sum(r["size"] for r in got) == 1_000_001 + 190 and [r["shard"] for r in sorted(got, key=lambda r: r["doc_id"])] == [0] * 4 + [7] * 16


def test_remembered_ids_equal_fresh_ones():
    tokenizers, vocabularies = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    kept = packing.Remembered(tokenizer, generation=3)
    for k in range(6):
        strings = [f" word{(j + k) % 7}" for j in range(4)]
        assert [np.frombuffer(x, np.uint32).tolist() for x in kept.ids(strings)] == [tokenizer.encode(x, add_special_tokens=False).ids for x in strings]
        assert len(kept.new) + len(kept.old) <= 2 * (3 + 4)


def test_queries_in_several_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(vamana, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vamana, "shard_rows", lambda rows, width: 100)
    draw = np.random.default_rng(1)
    points = draw.normal(size=(700, 8)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    rows = vamana.nearest(df).collect()
    found = 0
    for q in range(0, 700, 100):
        d = np.sqrt(((points - points[q]) ** 2).sum(1))
        d[q] = np.inf
        found += len({r["vec_id"] for r in rows if r["query_id"] == q} & set(np.argsort(d)[:10].tolist()))
    assert len(rows) == 70 and found >= 67


def brute_marginals(chain: crf.Chain, text: str) -> np.ndarray:
    """Marginals by enumeration, with each word's features listed one by one."""
    found = re.findall(rb"[A-Za-z\x80-\xff]+", text.encode())
    score = np.zeros((len(found), len(chain.labels)))
    number = lambda x: int.from_bytes(x, "big")
    for k, w in enumerate(found):
        h = crf.run_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
        feats = [(1, int(h[0]))]
        feats += [(2, int(kind)) for entry, kind in zip(*chain.lexicon, strict=True) if entry == h[0]]
        feats += [(2 + n, number(w[:n])) for n in range(1, 5) if len(w) >= n] + [(10 + n, number(w[-n:])) for n in range(1, 5) if len(w) >= n]
        feats += [(20 + n, number(w[i : i + n])) for n in (2, 3) for i in range(len(w) - n + 1)]
        for kind, value in feats:
            score[k] += chain.weights[crf.slots(kind, np.array([value], np.uint64))[0]]
    return enumerated(score, chain.step)[0]


def random_chain(labels):
    draw = np.random.default_rng(2)
    lexicon = crf.run_hashes(np.frombuffer(b"known", np.uint8), np.array([0]), np.array([5]))
    return crf.Chain(labels, draw.normal(size=(1 << crf.BITS, len(labels))).astype(np.float32) / 3, draw.normal(size=(len(labels),) * 2), (lexicon, np.array([1])))


TEXTS = ["known words here", "été, known! a", "bb cc dd ee", "same same same", "one"]


def test_languages_equal_brute_force_and_ties_go_by_name(spark):
    model = random_chain(["aa", "bb", "cc"])
    df = spark.createDataFrame([(i, t, False) for i, t in enumerate(TEXTS)], "doc_id long, text string, held_out boolean")
    for r in langid.identify_languages(df, model).collect():
        mean = brute_marginals(model, TEXTS[r["doc_id"]]).mean(0)
        assert r["lang_pred"] == model.labels[mean.argmax()] and r["score"] == pytest.approx(mean.max(), abs=1e-4)
    flat = crf.Chain(["aa", "bb"], np.zeros((1 << crf.BITS, 2), np.float32), np.zeros((2, 2)), (np.zeros(0, np.uint64), np.zeros(0, int)))
    assert {r["lang_pred"] for r in langid.identify_languages(df, flat).collect()} == {"aa"}


def test_toxicity_equals_brute_force(spark):
    model = toxicity.ToxicityModel(random_chain([0, 1]), np.array([-1.0, 2.0, 0.5, 0.25]))
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in toxicity.score_toxicity(df, model).collect():
        text = TEXTS[r["doc_id"]]
        marginal = brute_marginals(model.chain, text)[:, 1]
        found = re.findall(r"[^\W\d_]+", text)
        peaks = {w: max(m for v, m in zip(found, marginal, strict=True) if v == w) for w in found}
        x = np.array([1, max(peaks.values()), np.log1p(sum(peaks.values())), np.log1p(100 * sum(peaks.values()) / len(found))])
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-x @ model.curve)), abs=1e-4)
        assert [text[s["start"] : s["end"]] for s in r["spans"]] == [w for w, m in zip(found, marginal, strict=True) if m >= 0.5]


def test_fields_find_forms_that_no_training_word_had(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.fit_toxicity(toxicity.labelled_texts(docs, labels))
    rows = {r["text"]: r["predicted"] for r in toxicity.score_toxicity(spark.createDataFrame([(1, "theand ingtion vileworded grimstuffing andthe"), (2, "theand ingtion andthe thething")], "doc_id long, text string"), model).collect()}
    assert list(rows.values()) == [1, 0]


def test_pipeline_of_odd_and_empty_documents(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = clashing(spark, [*ODD, (8, "one", "s1"), (9, LINE, "s1")])
    packed = {}
    for name, rows in (("full", docs), ("empty", docs.limit(0))):
        folder = f"{tmp_path}/{name}"
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, LINE)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        packed[name] = pipeline.run(spark, folder).collect()
    assert packed["empty"] == []
    ids = Counter(r["doc_id"] for r in packed["full"] if r["start"] == 0)
    assert ids == Counter([1, 2, 3, 4, None, 5, 6, 9]) and next(r["doc_tokens"] for r in packed["full"] if r["doc_id"] == 9) == 1


LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
