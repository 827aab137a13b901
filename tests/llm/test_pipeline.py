"""The pipeline's stages on a small table, each judged on its own input."""

import random
import zlib
from collections import defaultdict

import corpus_pipeline
from kpiforge.llm import decontaminate, mixing, ngram_join

SF_SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_join", "benchmark_decontamination", "source_mixing", "sharding"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names, inputs = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, SF_SMALL), name)
        if name != "sharding":
            assert docs.columns == names
    found = ngram_join.join_components(inputs["ngram_join"], 5, 80)
    heads = {r.component_id for r in found.collect()}
    assert {r.doc_id for r in inputs["benchmark_decontamination"].collect()} == heads
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    judged = decontaminate.judge(inputs["benchmark_decontamination"], bench).filter("not contaminated")
    assert {r.doc_id for r in judged.collect()} == {r.doc_id for r in inputs["source_mixing"].collect()}
    assert docs.count() == inputs["sharding"].count() and docs.filter("shard not between 0 and 15").count() == 0


LOWER = {i: i + 32 for i in range(65, 91)}


def awkward():
    """(doc_id, text, lang, source, n_chars): NULLs, empty texts, copies, near copies, one id with two texts, a row listed twice."""
    rnd = random.Random(23)
    prose = lambda n, vocab=10**6: " ".join(f"w{rnd.randrange(vocab)}" for _ in range(n))
    base, other = prose(90), prose(80)
    near = base.split()
    near[40] = "changed"
    texts = [(0, None, "a"), (1, "", "a"), (2, " \n ", None), (3, base, "a"), (4, base.upper(), "b"), (5, " ".join(near), "b"), (6, other, "c"), (7, prose(60), "c")]
    texts += [(8, " ".join(near) + " end", "a"), (8, prose(50), "a"), (9, prose(40), None), (9, prose(40), None), (None, base, "b"), (None, None, None), (10, "one two", "b"), (11, "one two", "c")]
    texts.append((12, texts[10][1], "a"))
    texts += [texts[10], (13, "BENCH-mark item " + prose(20), "a"), (14, prose(300), "c"), (15, "", "b"), (15, "", "b")]
    texts += [(20 + i, prose(rnd.randrange(5, 80)), rnd.choice("abc")) for i in range(40)]
    return [(i, t, "en", s, None if t is None else len(t)) for i, t, s in texts]


def shingles(text, k=5):
    w = (text or "").translate(LOWER).split()
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_brute(rows):
    """The rows that stay: of each component of near copies that with the smallest id; rows without id or words stay once listed."""
    sets = list({shingles(r[1]) for r in rows if r[0] is not None} - {frozenset()})
    root = list(range(len(sets)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    heads = {}
    for r in rows:
        if r[0] is not None and shingles(r[1]):
            c = find(sets.index(shingles(r[1])))
            heads[c] = min(heads.get(c, r[0]), r[0])
    kept = [r for r in rows if r[0] is None]
    for r in dict.fromkeys(r for r in rows if r[0] is not None):
        if not shingles(r[1]) or heads[find(sets.index(shingles(r[1])))] == r[0]:
            kept.append(r)
    return sorted(kept, key=repr)


def test_stages_on_awkward_rows_equal_brute_force(spark, tmp_path):
    rows = awkward()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    spark.createDataFrame([(1, "Bench mark, ITEM"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    got = stages["ngram_join"](spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=repr) == near_brute(rows)

    clean = stages["benchmark_decontamination"](spark, docs, str(tmp_path))
    assert sorted(map(tuple, clean.collect()), key=repr) == sorted((r for r in rows if r[0] != 13), key=repr)

    mixed = stages["source_mixing"](spark, docs, str(tmp_path)).collect()
    goal = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    words, whole = defaultdict(int), defaultdict(set)
    for r in rows:
        whole[r[0], r[3]].add(" ".join((r[1] or "").split()))
    for r in mixed:
        words[r.source] += len(r.text.split())
        assert any(t.startswith(" ".join(r.text.split())) for t in whole[r.doc_id, r.source])
    assert {s: words[s] for s in goal} == {s: int(t + 1e-6) for s, t in goal.items()}

    shards = stages["sharding"](spark, docs, str(tmp_path)).collect()
    sizes = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in shards), key=repr) == sorted(sizes, key=repr)
    slots = defaultdict(list)
    for r in shards:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
