import random

import numpy as np
import pytest

from repograph.llm import decontam, linededup, lm, minhash, mixing, pq, sharding, tokens, toxicity, warc
from repograph.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, copies string, count string"


def _text(seed, n=80):
    g = random.Random(seed)
    return " ".join("".join(g.choice("abcdefghij") for _ in range(g.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = _text(1)
    texts = [base, base, base.replace(base.split()[5], "other"), None, "", "   ", _text(2), _text(3, 20_000), "x" * 50_000, _text(4) + "\n" + "same line here", _text(5) + "\nsame line here", "same line here", None]
    rows = [(i, t, "en", None if i == 6 else f"s{i % 2}", 0, "a", "b", "c") for i, t in enumerate(texts[:-1])]
    rows += [(None, None, None, None, None, None, None, None), (2, texts[2], "en", "s0", 0, "a", "b", "c"), (2, texts[2], "en", "s0", 0, "a", "b", "c")]
    return spark.createDataFrame(rows, DOCS)


def test_prefix_counts_are_those_of_encoding_every_prefix():
    c = tokens.PrefixCounter()
    g = random.Random(7)
    for t in ["it're   b's \n\n x", "a   b", "ünï 日本語 😀😀", "x" * 200, " " * 150 + "b", *("".join(g.choice("ab '\nélr0!  st") for _ in range(50)) for _ in range(60))]:
        packed = tokens.pack(c.deltas(t))
        want = [len(c.encoding.encode_ordinary(t[:i])) for i in range(len(t) + 1)]
        assert tokens.counts(packed).tolist() == want
        assert tokens.longest_within(packed, 3) == max(i for i, n in enumerate(want) if n <= 3)


def test_token_rows(spark, docs):
    got = {r.doc_id: r for r in tokens.prefix_token_counts(docs).collect()}
    assert got[3].n_tokens is None and got[4].n_tokens == 0 and got[8].n_chars == 50_000


def test_near_duplicates(spark, docs):
    assert {(r.doc_id, r.duplicate_of) for r in minhash.near_duplicates(docs).collect()} == {(1, 0), (2, 0)}
    kept = minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in [0, *range(3, 12), None])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51), (51, 51)], "src long, dst long")
    got = dict(components(edges).collect())
    assert {got[i] for i in range(1, 31)} == {1} and got[51] == 50


def test_embeddings_against_brute_force(spark):
    g = np.random.default_rng(1)
    x = g.standard_normal((120, 32))
    x = np.concatenate([x, x[:30] + 0.02 * g.standard_normal((30, 32)), x[:3]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 32), (903, [1.0]), (None, x[0].tolist())]
    got = {(r.vec_id, r.duplicate_of) for r in pq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {(120 + i, i) for i in range(30)} | {(150 + i, i) for i in range(3)}
    assert pq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pivot_keeps_sums_and_expectations():
    p = np.full(40, 0.3)
    g = np.random.default_rng(3)
    sums, mean = set(), np.zeros(40)
    for _ in range(2000):
        out, live = mixing.pivot(p, g.random(40))
        sums.add(round(out.sum(), 6))
        mean += out
    assert sums == {12.0} and abs(mean / 2000 - 0.3).max() < 0.06


def test_mixing(spark, docs):
    got = mixing.copy_counts(docs, weights={"s0": 1, "s1": 3}, total=40).collect()
    by = {s: sum(r.copies for r in got if r.source == s) for s in ("s0", "s1", None)}
    assert by == {"s0": 10, "s1": 30, None: 0}
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.copy_counts(docs.limit(0)).count() == 0


def test_shards_match_the_mixture(spark, docs):
    got = sharding.shard_documents(docs, 3)
    rows = got.collect()
    assert sorted(r.position for r in rows) == list(range(docs.count()))
    assert set(got.columns) == {*docs.columns, "position"}
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_line_dedup(spark, docs):
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert got[9].n_removed == 0 and got[10].n_removed == 1 and got[11].text == "" and got[3].text is None
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 20_000, dtype=np.uint64))
    assert sorted(linededup.PerfectHash.build(keys).places(keys)) == list(range(len(keys)))
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_leaks(spark, docs):
    item = _text(99, 30)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    some = docs.select("doc_id", "text").union(spark.createDataFrame([(70, _text(8) + " " + item + " " + _text(9))], "doc_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(some, bench).collect()] == [(70, 1)]
    assert decontam.without_leaks(docs, bench).count() == docs.count()
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0
    g = random.Random(1)
    for _ in range(50):
        a, b = [g.randint(0, 4) for _ in range(12)], [g.randint(0, 4) for _ in range(15)]
        t = np.zeros((13, 16), int)
        for i in range(12):
            for j in range(15):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontam.lcs(a, b) == t[-1, -1]


def test_toxicity_on_held_out_rows(spark):
    rows = [(i, _text(i, 60) + (" you idiot moron trash" if i % 4 == 0 else "")) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    got = {r.doc_id: r.is_toxic for r in toxicity.score(d, model).collect()}
    assert all(got[i] == (i % 4 == 0) for i in range(300, 400))
    assert toxicity.without_toxic(d, model).count() == 300
    assert toxicity.score(d.limit(0), toxicity.fit(d.limit(0), labels)).count() == 0


def test_losses_against_brute_force(spark):
    rows = [(i, " ".join(random.Random(i).choice("abcde") for _ in range(30))) for i in range(20)] + [(50, None), (51, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    t = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    got = {r.doc_id: r for r in lm.cross_entropy_difference(d, t).collect()}
    assert got[50].n_tokens == 0 and got[50].target_loss is None
    from collections import Counter

    width = 5 + 2
    seqs = [x.split() for _, x in rows[:20]]
    uni = Counter(w for s in seqs for w in s)
    pair = Counter(p for s in seqs for p in zip(["^", *s], s))
    ctx = Counter(h for s in seqs for h in ["^", *s][:-1])
    kept = {p: n for p, n in pair.items() if n >= 2 or sum(q == p for s in seqs[:10] for q in zip(["^", *s], s)) >= 2}
    loss = 0.0
    for p in zip(["^", *seqs[3]], seqs[3]):
        left = 1 - sum((n - 0.75) / ctx[p[0]] for q, n in kept.items() if q[0] == p[0])
        word = (uni[p[1]] + 0.5) / (sum(uni.values()) + 0.5 * width)
        loss -= np.log((kept[p] - 0.75 if p in kept else 0) / ctx[p[0]] + left * word)
    assert abs(got[3].background_loss - loss / 30) < 1e-4


def test_warc_salvage(spark, tmp_path):
    parts = [warc.member(warc.record(i, f"http://x/{i}", "body" * i)) for i in range(6)]
    parts[2] = parts[2][:20] + bytes([parts[2][20] ^ 255]) + parts[2][21:]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    plain = [warc.record(i, None, "p" * 50) for i in range(10, 14)]
    plain[1] = plain[1].replace(b"Content-Length: 50", b"Content-Length: 49")
    (tmp_path / "b.warc").write_bytes(b"".join(plain))
    path = f"file://{tmp_path}"
    got = warc.read_warc(spark, path)
    assert sorted(r.page_id for r in got.collect()) == [0, 1, 3, 4, 5, 10, 12, 13]
    assert sorted(r.end - r.start for r in warc.gaps(got, spark, path).collect()) == sorted([len(parts[2]), len(plain[1])])
    pages = spark.createDataFrame([(1, "u%0A\n", "é" * 9), (2, None, None), (3, "", ""), (3, "", ""), (None, "x", "y" * 3_000_000)], "page_id long, url string, html string")
    back = warc.round_trip(pages, "page_id = 3")
    assert sorted(map(str, back.drop("gaps_before").collect())) == sorted(map(str, pages.collect()))
