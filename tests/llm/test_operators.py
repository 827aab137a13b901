"""Every corpus operator against plain Python on a fixture of awkward rows, and on empty tables."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kpiforge.llm import decontaminate, language, line_dedup, mixing, ngram_join, quality, sharding, substring_dedup, topk_search, warc

ASCII_UPPER = {i: i + 32 for i in range(65, 91)}
SEPARATORS = "".join(chr(i) for i in [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def sentence(rnd, n, vocab=400):
    return " ".join(f"w{rnd.randrange(vocab)}" for _ in range(n))


def corpus():
    """(doc_id, text, lang, source): NULLs, empty and long texts, copies, near copies, passages, repeated rows."""
    rnd = random.Random(7)
    passage, base = sentence(rnd, 30, 10**6), sentence(rnd, 120, 10**6)
    edited = base.split()
    edited[60] = "changed"
    rows = [
        (0, None, "en", "a"), (1, "", None, "b"), (2, " \n\t ", "en", None), (3, "one", "en", ""),
        (4, base, "en", "a"), (5, base, "de", "b"), (6, " ".join(edited), "en", None), (7, base.upper(), "en", "c"),
        (8, f"{sentence(rnd, 10)}\n{passage}\n{sentence(rnd, 10)}", "en", "a"), (9, passage + " " + passage, "en", "a"),
        (10, "Thé ÉTÉ, café-bar!", "fr", "b"), (11, "same line of text here\nsame line of text hera\nother", "en", "b"),
        (12, "same line of text her\n\nsame line of text here", "en", "c"), (13, "x" * 5000, "en", "d"),
        (14, sentence(rnd, 30_000), "en", "d"), (15, "a b", "en", "a"), (16, "A B", "en", "a"), (17, "!!! 123", None, "a"),
        (None, base, "en", "a"), (None, None, None, None), (20, "twice listed row of text", "en", "e"), (20, "twice listed row of text", "en", "e"),
    ]
    return rows + [(i, sentence(rnd, rnd.randrange(1, 60)), "en", rnd.choice("abc")) for i in range(30, 60)]


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names clash with inner names, also by case."""
    df = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    df = df.withColumns({c: F.lit("extra") for c in ("size", "n_words", "word", "node", "rank", "label")})
    return df.toDF(*df.columns[:-1], "TEXT")


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def order(r):
    return (r[0] is None, r[0] or 0)


def test_warc_round_trip(spark, no_docs):
    html = [(1, "u1", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u 3\n", None), (4, "u4", ""), (5, "u5", "x" * 200_000), (None, "u6", "<p>é</p>"), (1, "u1", "<p>é</p>")]
    pages = spark.createDataFrame(html, "page_id long, url string, html string").withColumn("sha1", F.lit(1))
    chunks = warc.read_chunks(warc.write(pages)).cache()
    got = rows(chunks.filter("last"), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, (p, _, h) in enumerate(html):
        body = (h or "").encode()
        same = [x[0] for x in html if (x[2] or "") == (h or "") and x[0] is not None]
        response = p == min(same) and i != 6
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((p, len(body), digest, "response" if response else "revisit", None if response else min(same)))
    assert got == sorted(want, key=repr)
    whole = {r.page_id: b"".join(bytes(x) for _, x in sorted(r.parts)) for r in chunks.filter("record_type = 'response'").groupBy("page_id").agg(F.collect_list(F.struct("chunk_no", "data")).alias("parts")).collect()}
    assert whole[5] == b"x" * 200_000 and whole[1] == "<p>é</p>".encode()
    assert chunks.filter("page_id = 5").count() == -(-200_000 // warc.CHUNK_BYTES)
    small = warc.read_chunks(warc.write(pages, revisit_from=100)).filter("last")
    assert small.filter("record_type = 'revisit'").count() == 0 and small.count() == len(html)
    assert warc.read_chunks(warc.write(pages.limit(0))).count() == 0


def near(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < line_dedup.MIN_CHARS or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    i = next((k for k, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[i + (len(a) == len(b)) :] == long[i + 1 :]


def test_line_dedup(docs, no_docs):
    listed = sorted({(d, t) for d, t, *_ in corpus()}, key=lambda r: (*order(r), r[1] or ""))
    seen, want = [], {}
    for d, t in listed:
        lines = [x for x in (t or "").split("\n") if x.strip(" ")]
        kept = []
        for x in lines:
            if not any(near(x, y) for y in seen):
                kept.append(hashlib.md5(x.encode()).hexdigest())
            seen.append(x)
        want[d, t] = (d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    got = rows(line_dedup.summary(docs), "doc_id", "n_lines", "n_removed", "kept_sha256")
    assert got == sorted((want[d, t] for d, t, *_ in corpus()), key=repr)
    assert want[11, corpus()[11][1]][2] == 1 and want[12, corpus()[12][1]][2] == 2
    texts = {r.doc_id: r.text for r in line_dedup.apply(docs.toDF(*docs.columns[:-1], "z"), line_dedup.kept_lines(docs)).collect()}
    assert texts[12] == "" and texts[11] == "same line of text here\nother" and texts[0] is None
    assert line_dedup.summary(no_docs).count() == 0


def test_line_dedup_of_many_alike_lines(spark):
    texts = [f"this is the numbered line {i:04d} of a table" for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.summary(df).filter("n_removed = 1").collect()}
    assert gone == {i for i in range(400) if any(near(texts[i], texts[j]) for j in range(i))}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("per_chars", [8, 50])
def test_line_dedup_with_a_growing_edit_bound(spark, per_chars):
    """Edits of every number about the bound, at random, at either end and evenly spread, by segments up to the deep ones."""
    rnd = random.Random(per_chars)
    texts = []
    for n in (15, 16, 23, 60, 99, 100, 101, 149, 150, 320):
        base = "".join(rnd.choices("abcdé ", k=n)).replace("  ", " é").strip().ljust(n, "z")
        texts.append(base)
        k = max(1, n // per_chars)
        for count in sorted({1, 2, k - 1, k, k + 1}):
            for places in ([rnd.randrange(n) for _ in range(count)], range(count), range(n - count, n), [(2 * j + 1) * n // (2 * count) for j in range(count)]):
                line = list(base)
                for at in places:
                    line[at] = rnd.choice(["", f"{line[at]}#", "#"])
                texts.append("".join(line))
    rnd.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bound = lambda a, b: max(1, min(len(a), len(b)) // per_chars) if min(len(a), len(b)) >= 16 else 0
    want = {i for i, a in enumerate(texts) if any(abs(len(a) - len(b)) <= bound(a, b) and edits(a, b) <= bound(a, b) for b in texts[:i])}
    got = {r.doc_id for r in line_dedup.summary(df, per_chars=per_chars).filter("n_removed = 1").collect()}
    one = {r.doc_id for r in line_dedup.summary(df).filter("n_removed = 1").collect()}
    assert got == want and one < got


def test_substring_dedup(docs, no_docs):
    listed = sorted({(d, t) for d, t, *_ in corpus()}, key=order)
    seen, want = set(), {}
    for d, t in listed:
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            gone |= set(range(s, s + 20)) if key in seen else set()
            seen.add(key)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want[d, t] = (d, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    got = rows(substring_dedup.dedup(docs, with_text=True), "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")
    assert got == sorted((want[d, t] for d, t, *_ in corpus()), key=repr)
    assert substring_dedup.dedup(no_docs).count() == 0


def test_substring_dedup_of_frequent_passages(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FREQUENT", 5)
    rnd = random.Random(3)
    passage = sentence(rnd, 25, 10**6)
    df = spark.createDataFrame([(i, f"{sentence(rnd, 30, 10**6)} {passage}") for i in range(60)], "doc_id long, text string")
    got = substring_dedup.dedup(df.repartition(5)).filter("n_removed > 0")
    assert got.count() == 59 and got.filter("n_removed = 25").count() == 59 and got.filter("doc_id = 0").count() == 0


def bench_words(t):
    return [w for w in "".join(" " if c in SEPARATORS else c for c in (t or "").translate(ASCII_UPPER)).split(" ") if w]


def contaminated(benchmark):
    wins = defaultdict(set)
    for item, t in benchmark:
        w = bench_words(t)
        for s in range(max(1, len(w) - 12) if w and item is not None else 0):
            wins[tuple(w[s : s + 13])].add(str(item))
    out = []
    for d, t, *_ in corpus():
        w, hit, items = bench_words(t), set(), set()
        for win, names in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    items |= names
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination(spark, docs, no_docs, monkeypatch):
    base = corpus()[4][1]
    benchmark = [(1, " ".join(base.split()[20:50])), (2, " ".join(base.split()[30:44]).upper()), (10, "thé ÉTÉ"), (3, "one"), (4, None), (5, ""), (None, "a b"), (10, "thé ÉTÉ"), (6, "absent words here"), (7, "a b")]
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    table = spark.createDataFrame(benchmark, "item_id long, text string").withColumn("w", F.lit(0))
    judged = decontaminate.judge(docs, table)
    want = contaminated(benchmark)
    assert rows(judged, *names) == want and sum(r[-1] for r in want) >= 6
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 4)
    assert rows(decontaminate.judge(docs, table), *names) == want
    kept = decontaminate.drop_contaminated(docs.toDF(*docs.columns[:-1], "z"), table)
    assert kept.count() == sum(not r[-1] for r in want) and kept.columns == [*docs.columns[:-1], "z"]
    assert decontaminate.judge(docs, table.limit(0)).filter("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.judge(no_docs, table).count() == 0


def test_decontamination_by_items_without_id(spark):
    docs = spark.createDataFrame([(1, "some words of a passage"), (2, "a b"), (3, "clean")], "doc_id long, text string")
    table = spark.createDataFrame([(None, "words of a passage"), (None, "A-B"), (7, "a b")], "item_id long, text string")
    got = rows(decontaminate.judge(docs, table), "doc_id", "n_hit", "n_items", "items_sha256", "contaminated")
    none, seven = (hashlib.sha256(x).hexdigest() for x in (b"", b"7"))
    assert got == [(1, 4, 0, none, True), (2, 2, 1, seven, True), (3, 0, 0, none, False)]
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, table).collect()] == [3]


def test_mixing(docs, no_docs):
    mixed = mixing.mix(docs).cache()
    size = {s: sum(len((t or "").split()) for _, t, _, x in corpus() if x == s) for s in {r[3] for r in corpus()}}
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(size.values())), set(names)
    while True:
        total = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / total >= 3 * size[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: 3.0 * size[s] for s in full}
        left -= sum(3 * size[s] for s in full)
        free -= full
    taken = defaultdict(int)
    for r in mixed.collect():
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert rows(mixed, "doc_id", "taken") == rows(mixing.mix(docs.repartition(5)), "doc_id", "taken")
    plain = docs.toDF(*docs.columns[:-1], "z")
    out = mixing.apply_mix(plain, mixed)
    assert out.columns == plain.columns
    assert out.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(taken.values())
    assert mixing.mix(no_docs).count() == 0 and mixing.apply_mix(no_docs, mixing.mix(no_docs)).count() == 0


def near_components(texts, k, percent):
    sets = []
    for _, t in texts:
        w = (t or "").translate(ASCII_UPPER).encode().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = {d: d for d, _ in texts if d is not None}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, (d, _) in enumerate(texts):
        for j in range(i):
            e, a, b = texts[j][0], sets[i], sets[j]
            if d is not None and e is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(d), find(e)))
                root[y] = x
    return sorted(((d, len(s), None if d is None else find(d)) for (d, _), s in zip(texts, sets)), key=repr)


def test_ngram_join(docs, no_docs):
    want = near_components([(d, t) for d, t, *_ in corpus()], 4, 85)
    assert rows(ngram_join.join_components(docs), "doc_id", "n_shingles", "component_id") == want
    assert {5, 6, 7} <= {r[0] for r in want if r[2] == 4}
    kept = ngram_join.keep_representatives(docs.toDF(*docs.columns[:-1], "z"))
    five = near_components([(d, t) for d, t, *_ in corpus()], 5, 80)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({r[2] for r in five if r[2] is not None})
    assert kept.filter("doc_id is null").count() == 2 and kept.columns == [*docs.columns[:-1], "z"]
    assert ngram_join.join_components(no_docs).count() == 0


def test_ngram_join_of_ids_with_two_texts(spark):
    rnd = random.Random(11)
    a, b, c, d = (sentence(rnd, 60, 10**6) for _ in range(4))
    texts = [(3, a), (5, a), (5, b), (9, f"{b} end"), (12, c), (12, d), (13, ""), (13, f"{c} end"), (20, d), (20, d), (21, f"{a} end"), (21, "unlike text")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for k, percent in ((4, 85), (5, 80)):
        got = rows(ngram_join.join_components(df, k, percent), "doc_id", "n_shingles", "component_id")
        assert got == near_components(texts, k, percent)
    assert {r[2] for r in got if r[0] == 9} == {3}
    kept = rows(ngram_join.keep_representatives(df), "doc_id", "text")
    assert kept == sorted([(3, a), (5, b), (12, c), (12, d), (13, ""), (21, "unlike text")], key=repr)


def test_ngram_join_of_a_large_group(spark):
    """Chains of near copies whose ends are unlike, in blocks far smaller than the group."""
    rnd = random.Random(5)
    words = sentence(rnd, 150, 10**6).split()
    texts = []
    for i in range(120):
        if i % 3 == 0:
            words[rnd.randrange(150)] = f"new{i}"
        other = list(words)
        other[rnd.randrange(150)] = f"odd{i}"
        texts.append((i, " ".join(other)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = rows(ngram_join.join_components(df, block=1500), "doc_id", "n_shingles", "component_id")
    assert got == near_components(texts, 4, 85)


def test_topk_search(spark):
    rnd = random.Random(2)
    vectors = [(i, [rnd.gauss(0, 0.2) for _ in range(16)]) for i in range(400)]
    vectors += [(1000, None), (1050, [0.1, None]), (1100, [float("nan")]), (1150, [float("inf")]), (None, [1.0] * 16), (450, vectors[3][1]), (1200, [0.5]), (1250, []), (0, vectors[0][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).cache()
    q = {r.vec_id: [int((256 * float(x)) // 1) for x in r.embedding] for r in df.collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and abs(x) < float("inf") for x in r.embedding)}
    want = []
    for i in q:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    found = topk_search.search(topk_search.build_index(df, block_rows=100), df.filter("vec_id % 50 = 0"))
    assert rows(found, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    few = df.filter("vec_id in (50, 51)")
    assert topk_search.search(topk_search.build_index(few), few).count() == 2
    none = df.limit(0)
    assert topk_search.search(topk_search.build_index(none), none).count() == 0
    assert topk_search.search(topk_search.build_index(none), few).count() == 0


def fold(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0


def test_quality_classifier(spark, docs, no_docs):
    rnd = random.Random(4)
    texts = [(i, " ".join(w.upper() + "!!" for w in sentence(rnd, 60).split()) if i % 2 else sentence(rnd, 60)) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in texts] + [(7, 1), (8, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    got = quality.score(df, model).collect()
    assert all(r.held_out == fold(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in held) >= 0.95 * len(held)
    swapped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows(quality.score(df, quality.fit(df, swapped)), "doc_id", "score") == rows(quality.score(df, model), "doc_id", "score")
    assert quality.score(docs, model).count() == len(corpus())
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).filter("score <> 0.5").count() == 0
    assert quality.score(no_docs, model).count() == 0


def test_sharding(spark, docs, no_docs):
    hot = spark.createDataFrame([(1000 + i, "the same text again") for i in range(500)], "doc_id long, text string")
    both = docs.toDF(*docs.columns[:-1], "z").select("doc_id", "text").unionByName(hot)
    got = sharding.assign(both, 4).collect()
    assert len(got) == len(corpus()) + 500
    slots, load = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    biggest = max(len((t or "").encode()) + 1 for _, t, *_ in corpus())
    assert max(load.values()) - min(load.get(i, 0) for i in range(4)) <= biggest
    assert sorted(r.text_crc32 for r in got) == sorted([zlib.crc32((t or "").encode()) for _, t, *_ in corpus()] + [zlib.crc32(b"the same text again")] * 500)
    again = {(r.doc_id, r.text_crc32, r.shard) for r in sharding.assign(both.repartition(5), 4).collect()}
    assert again == {(r.doc_id, r.text_crc32, r.shard) for r in got}
    assert sharding.assign(no_docs).count() == 0


def test_language_id(spark, docs, no_docs):
    rnd = random.Random(9)
    parts = {"aa": ["ba", "bo", "ki", "lu"], "bb": ["str", "en", "sch", "ig"], "cc": ["ño", "ção", "ez", "iu"]}
    texts = [(i, " ".join("".join(rnd.choices(parts[g], k=3)) for _ in range(40)), g) for i in range(240) for g in [list(parts)[i % 3]]]
    df = spark.createDataFrame([*texts, (500, "zz zz", None), (None, "ba", "aa")], "doc_id long, text string, lang string")
    models = language.fit(df)
    assert list(models) == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in language.predict(df, models).collect()}
    held = [t for t in texts if fold(t[0])]
    assert sum(got[i].lang_pred == g for i, _, g in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and all(got[i].held_out == fold(i) for i, *_ in texts)
    blank = {r.doc_id: r.lang_pred for r in language.predict(docs, models).collect()}
    assert [blank[i] for i in (0, 1, 2, 17)] == ["und"] * 4 and blank[14] in models
    assert language.predict(no_docs, models).count() == 0
    assert language.predict(docs, language.fit(no_docs)).filter("lang_pred <> 'und'").count() == 0


def test_suffix_automaton_holds_exactly_the_substrings():
    rnd = random.Random(1)
    texts = ["".join(rnd.choices("abc", k=rnd.randrange(1, 12))) for _ in range(40)]
    automaton = language.SuffixAutomaton()
    for t in texts:
        automaton.add(t)
    step = automaton.frozen()
    inside = {t[i:j] for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(3000):
        word, state = "".join(rnd.choices("abc", k=rnd.randrange(1, 7))), 0
        for c in word:
            state = step.get((state, c)) if state is not None else None
        assert (state is not None) == (word in inside)
