import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import LOWER, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import __spark_entry__ as entry  # noqa: E402
from winnower.llm import crf, entries, toxicity  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), name)
        assert docs.columns == columns and 0 < docs.count() <= count
        count = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_names_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    found = entry.queries()
    assert set(entries.QUERIES) | {"pipeline"} <= set(found)
    assert [sum(n.startswith(f"op{k}_") for n in found) for k in range(1, 14)] == [1] * 13


def test_oracles(spark):
    from oracle import compare

    for name, sql in entries.ORACLE_SQL.items():
        assert compare(spark, entries.QUERIES[name], sql) > 0


# The whole pipeline by brute force: plain Python, stage by stage, from the documents to the pieces. Only the fitted weights
# of the toxicity model are taken from the library; its scores are computed here word by word.


def word_features(word):
    number = lambda x: int.from_bytes(x, "big")
    found = [(2 + n, number(word[:n])) for n in range(1, 5) if len(word) >= n] + [(10 + n, number(word[-n:])) for n in range(1, 5) if len(word) >= n]
    return found + [(20 + n, number(word[i : i + n])) for n in (2, 3) for i in range(len(word) - n + 1)]


def toxic_score(model, text, known):
    chain, found = model.chain, re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").translate(LOWER).encode())
    for w in set(found) - set(known):
        h = crf.run_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
        feats = [(1, int(h[0])), *((2, int(k)) for e, k in zip(*chain.lexicon, strict=True) if e == h[0]), *word_features(w)]
        known[w] = sum(chain.weights[crf.slots(kind, np.array([value], np.uint64))[0]].astype(float) for kind, value in feats)
    peaks = {}
    if found:
        step, score = np.asarray(chain.step, float), np.array([known[w] for w in found])
        ahead = [score[0]]
        for k in range(1, len(found)):
            ahead.append(score[k] + np.logaddexp.reduce(ahead[-1][:, None] + step, 0))
        back = [np.zeros(2)]
        for k in range(len(found) - 1, 0, -1):
            back.append(np.logaddexp.reduce(step + (score[k] + back[-1])[None, :], 1))
        both = np.array(ahead) + np.array(back[::-1])
        marginal = np.exp(both - np.logaddexp.reduce(both, 1)[:, None])[:, 1]
        for w, m in zip(found, marginal, strict=True):
            peaks[w] = max(m, peaks.get(w, 0))
    total = sum(peaks.values())
    x = np.array([1, max(peaks.values(), default=0), np.log1p(total), np.log1p(100 * total / max(1, len(found)))])
    return 1 / (1 + np.exp(-x @ model.curve))


def without_boilerplate(docs):
    places, sites, texts = defaultdict(list), defaultdict(set), defaultdict(set)
    for i, t, site in docs:
        for pos, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                places[line.strip(" ")].append((i, pos))
                sites[line.strip(" ")].add(site)
                texts[line.strip(" ")].add(t)
    cut = {p for line, where in places.items() if len(sites[line]) >= 5 and len(texts[line]) >= 2 for p in where if p != min(where)}
    for i, t, site in docs:
        lines = (t or "").split("\n")
        kept = [x for pos, x in enumerate(lines) if (i, pos) not in cut]
        if len(kept) == len(lines) or "\n".join(kept).strip(" "):
            yield i, t if len(kept) == len(lines) else "\n".join(kept), site


def one_of_each(docs):
    sets = []
    for _, t, _ in docs:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, *_), g in zip(docs, group, strict=True):
        least[g] = min(i, least.get(g, i))
    return [d for d, g in zip(docs, group, strict=True) if d[0] == least[g]]


def without_tests(text, windows):
    word = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))
    found, hit = [m[0] for m in word], set()
    for size in {len(w) for w in windows}:
        for k in range(len(found) - size + 1):
            if tuple(found[k : k + size]) in windows:
                hit.update(range(k, k + size))
    out, at = [], 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out.append(text[at : word[k].start()])
        at = word[k].end()
    return text if not hit else "".join(out) + text[at:]


def test_pipeline_equals_brute_force(spark):
    tokenizers, vocabularies = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    table = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
    model = toxicity.fit_toxicity(toxicity.labelled_texts(table("documents"), table("labels")))
    known = {}
    docs = [(r["doc_id"], r["text"], r["source"]) for r in table("documents").collect()]
    docs = [d for d in docs if toxic_score(model, d[1], known) < 0.5]
    docs = one_of_each(list(without_boilerplate(docs)))
    tests = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(LOWER)) for r in table("benchmark").collect()]
    windows = {tuple(w[k : k + 10]) for w in tests if w for k in range(max(1, len(w) - 9))}
    tokenizer, want, sizes = tokenizers.Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json")), Counter(), []
    for i, t, _ in docs:
        ids = np.array([*tokenizer.encode(without_tests(t, windows) or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 2048):
            want[i, a, min(2048, len(ids) - a), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)] += 1
            sizes.append(min(2048, len(ids) - a))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in got) == want
    room = []
    for n in sorted(sizes, reverse=True):  # best fit decreasing, one by one
        fit = [k for k, left in enumerate(room) if left >= n]
        if fit:
            room[min(fit, key=room.__getitem__)] -= n
        else:
            room.append(2048 - n)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(2048 - sum(n for _, n in h) for h in held.values()) == sorted(room)
    assert all(offset == sum(n for o, n in h if o < offset) for h in held.values() for offset, _ in h)
