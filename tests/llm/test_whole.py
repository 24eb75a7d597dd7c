"""Cases in which an operator once did less than the whole job."""

import random

import numpy as np

from repograph.llm import decontam, lm, minhash, pq, warc


def _words(seed, n):
    g = random.Random(seed)
    return ["".join(g.choice("abcdefghij") for _ in range(g.randint(3, 8))) for _ in range(n)]


def test_rare_words_and_pairs_count_in_a_large_corpus(spark):
    # of 400,000 tokens a share of 1e-5 is 4: words and pairs seen twice must not become the unknown word
    rows = [(1, "seldom seen"), (2, "seldom seen"), (3, "only once"), (4, None)] + [(i, "a b c d " * 10_000) for i in range(10, 20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.cross_entropy_difference(d, d.filter("doc_id = 1").select("doc_id")).collect()}
    assert got[1].background_loss == got[2].background_loss < got[3].background_loss
    assert got[1].target_loss < got[3].target_loss and got[4].n_tokens == 0 and got[10].n_tokens == 40_000


def test_a_copy_with_a_repeated_passage_is_a_near_duplicate(spark):
    text = _words(1, 40)
    d = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text * 6)), (3, " ".join(_words(2, 40)))], "doc_id long, text string")
    assert [(r.doc_id, r.duplicate_of) for r in minhash.near_duplicates(d).collect()] == [(2, 1)]


def test_salvage_goes_on_inside_a_member(spark, tmp_path):
    records = [warc.record(i, f"http://x/{i}", " ".join(_words(i, 4000))) for i in range(8)]
    bad = records[:3] + [records[3].replace(b" ", b"_", 30)] + records[4:]
    (tmp_path / "a.warc.gz").write_bytes(warc.member(b"".join(bad)))
    torn = warc.member(b"".join(records))
    torn = torn[: len(torn) // 2] + b"\xff" * 200
    (tmp_path / "b.warc.gz").write_bytes(torn)
    (tmp_path / "c.warc").write_bytes(warc.record(20, "u" * 70_000, "p"))
    path = f"file://{tmp_path}"
    got = warc.read_warc(spark, path)
    ids = {x: sorted(r.page_id for r in got.collect() if r.file.endswith(x)) for x in ("a.warc.gz", "b.warc.gz", "c.warc")}
    assert ids["a.warc.gz"] == [0, 1, 2, 4, 5, 6, 7] and ids["c.warc"] == [20]
    assert ids["b.warc.gz"][:3] == [0, 1, 2] and len(ids["b.warc.gz"]) < 8
    gaps = {r.file[-9:]: r for r in warc.gaps(got, spark, path).collect()}
    first = sum(map(len, bad[:3]))
    assert (gaps["a.warc.gz"].inner_start, gaps["a.warc.gz"].inner_end, gaps["a.warc.gz"].next_id) == (first, first + len(bad[3]), 4)
    assert gaps["b.warc.gz"].inner_start == sum(map(len, records[: len(ids["b.warc.gz"])])) and gaps["b.warc.gz"].inner_end is None
    pages = spark.createDataFrame([(1, "v" * 70_000, "x")], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 1


def test_an_item_copied_everywhere_is_found_everywhere(spark):
    item = " ".join(_words(99, 20))
    rows = [(i, " ".join(_words(i, 30)) + (" " + item if i % 2 else "") + " " + " ".join(_words(i + 50, 30))) for i in range(12)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 12, 2)) and {r.coverage for r in got} == {1.0}


def _jaccard(a, b, k=3):
    sets = [{tuple(x[i : i + k]) for i in range(max(1, len(x) - k + 1))} for x in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_minhash_groups_are_the_components_of_all_candidates(spark):
    # one word a shingle, one minhash, one table: documents of one bucket are all candidates of each other
    g = random.Random(5)
    docs = {}
    for i in range(60):
        docs[i] = [f"w{g.randint(0, 11)}" for _ in range(g.randint(3, 9))]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string")
    _, edges_of = minhash.near_groups(d, threshold=0.6, side=1, rows=1, k=1)
    mul, xor = minhash._multipliers(2, 1)
    low = {}
    for i, t in docs.items():
        h = np.unique(minhash.shingles(minhash.word_hashes([" ".join(t)])[0], 1))
        low[i] = tuple(((h ^ xor[j]) * mul[j]).min() for j in (0, 1))
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in docs:
        for j in range(i):
            if docs[i] == docs[j] or (low[i] == low[j] and _jaccard(docs[i], docs[j], 1) >= 0.6):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {(i, find(i)) for i in docs if find(i) != i}
    assert len(want) > 5
    assert {(r.doc_id, r.duplicate_of) for r in minhash.near_duplicates(d, threshold=0.6, side=1, rows=1, k=1).collect()} == want


def test_minhash_rows_of_one_id_with_different_texts_stay(spark):
    a, b, c = (" ".join(_words(i, 60)) for i in (1, 2, 3))
    rows = [(1, a, "x"), (1, b, "x"), (2, b, "x"), (3, a + " more", "x"), (4, c, "x"), (4, c, "x"), (5, "", "x"), (5, None, "x"), (None, a, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, rg_nth string")
    kept = sorted(map(str, minhash.without_near_duplicates(d).collect()))
    assert kept == sorted(map(str, d.filter("doc_id NOT IN (2, 3, 4) OR doc_id IS NULL").unionByName(d.filter("doc_id = 4").limit(1)).collect()))
    assert {(r.doc_id, r.duplicate_of) for r in minhash.near_duplicates(d).collect()} == {(2, 1), (3, 1)}


def test_minhash_against_brute_force(spark):
    g = random.Random(3)
    texts = {}
    for i in range(120):
        if i % 3 and i > 5:
            t = list(texts[g.randrange(i - 1)])
            for _ in range(g.randint(0, 12)):
                t[g.randrange(len(t))] = g.choice("xyz") * 4
            texts[i] = t
        else:
            texts[i] = _words(1000 + i, 60)
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    dup = {r.doc_id for r in minhash.near_duplicates(d).collect()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in range(i):
            if _jaccard(texts[i], texts[j]) >= 0.5:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i for i in texts if find(i) != i}
    # candidates are a matter of chance near the threshold; nothing that isn't near is ever found
    assert dup <= want and len(dup) >= 0.9 * len(want)


def _groups(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(int(a)), find(int(b))))
        root[b] = a
    return {(i, find(i)) for i in range(n) if find(i) != i}


def test_embeddings_of_few_intrinsic_dimensions_against_brute_force(spark):
    g = np.random.default_rng(4)
    x = g.standard_normal((700, 6)) @ g.standard_normal((6, 128))
    x = np.concatenate([x, x[:60] + 0.1 * g.standard_normal((60, 6)) @ g.standard_normal((6, 128)), np.repeat(x[:1], 30, 0) + 0.3 * g.standard_normal((30, 128))])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = _groups(np.argwhere(np.triu(u @ u.T >= 0.95, 1)), len(x))
    got = {(r.vec_id, r.duplicate_of) for r in pq.near_duplicates(d).collect()}
    assert len(want) > 60 and len(got & want) >= 0.99 * len(want)


def test_embeddings_of_each_length_and_hot_lists_in_parts(spark, monkeypatch):
    monkeypatch.setattr(pq, "LIST_ROWS", 5)
    g = np.random.default_rng(6)
    hot = g.standard_normal(16) + 0.02 * g.standard_normal((80, 16))
    rest = g.standard_normal((40, 16))
    short = g.standard_normal((20, 8))
    x = [*hot, *rest, *short, *(short[:7] * 2.5), *(rest[:5] + 0.01), [1.0, float("nan")], [2.0, 1.0]]
    rows = [(i, [float(v) for v in y]) for i, y in enumerate(x)] + [(3, [float(v) for v in hot[3]]), (500, None), (501, [None, 1.0])]
    got = {(r.vec_id, r.duplicate_of) for r in pq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {(i, 0) for i in range(1, 80)} | {(140 + i, 120 + i) for i in range(7)} | {(147 + i, 80 + i) for i in range(5)}
