"""Awkward input - nulls, empty and very long texts, repeated rows, ties, empty tables, clashing names - and brute-force versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from repograph.llm import decontam, linededup, lm, minhash, mixing, pq, sharding, tokens, toxicity, warc

#: Names that operators use, or used, inside.
CLASHING = ("rg_id", "rg_source", "rg_copies", "rg_copy", "rg_gone", "rg_leaked", "rg_occurrence", "rg_o", "rg_nth", "rg_t", "node", "key", "comp", "copies", "n", "block", "kind", "toxicity", "is_toxic", "row")


def _words(seed, n):
    g = random.Random(seed)
    return ["".join(g.choice("abcdefghij") for _ in range(g.randint(3, 8))) for _ in range(n)]


def _text(seed, n=60):
    return " ".join(_words(seed, n))


@pytest.fixture(scope="module")
def awkward(spark):
    texts = [_text(1), _text(1), None, "", " \n\t ", "?!", "x" * 200_000, _text(2, 30_000), _text(3), _text(3) + " z", "é 日本語 \U0001f600", _text(4)]
    rows = [(i, t, "en", None if i == 3 else f"s{i % 2}", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s0", 1), (0, texts[0], "en", "s0", 1), (None, _text(5), None, None, None), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.selectExpr("*", *[f"'c' AS {c}" for c in CLASHING]).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, _text(90, 25)), (1, _text(91, 25)), (2, None), (3, "  "), (None, _text(92, 20)), (1, _text(90, 25))], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 1, 0), (1, 0, 1), (None, 1, 1), (7, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")


def test_every_operator_keeps_rows_and_columns_of_awkward_input(spark, awkward, bench, labels):
    n = awkward.count()
    assert tokens.prefix_token_counts(awkward).count() == n
    assert linededup.dedup_lines(awkward).count() == n
    assert lm.cross_entropy_difference(awkward, labels.select("doc_id")).count() == n
    model = toxicity.fit(awkward, labels)
    assert toxicity.score(awkward, model).count() == n
    assert {(r.doc_id, r.duplicate_of) for r in minhash.near_duplicates(awkward).collect()} == {(1, 0), (9, 8)}
    assert decontam.contaminated(awkward, bench).count() == 0
    assert sharding.shard_rows(awkward).count() == n
    assert mixing.copy_counts(awkward).count() == n - 3
    for got in (minhash.without_near_duplicates(awkward), decontam.without_leaks(awkward, bench), mixing.mix_documents(awkward), toxicity.without_toxic(awkward, model)):
        assert got.columns == awkward.columns
        got.count()
    assert minhash.without_near_duplicates(awkward).count() == n - 4
    assert decontam.without_leaks(awkward, bench).count() == n
    shared = sharding.shard_documents(awkward.withColumn("shard", awkward["lang"]), 4)
    assert shared.count() == n and shared.columns == [*awkward.columns, "shard", "position"]


def test_empty_tables_give_no_rows(spark, awkward, bench, labels):
    none, no_items, no_labels = awkward.limit(0), bench.limit(0), labels.limit(0)
    for got in (
        tokens.prefix_token_counts(none), linededup.dedup_lines(none), lm.cross_entropy_difference(none, no_labels), toxicity.score(none, toxicity.fit(none, no_labels)), minhash.near_duplicates(none),
        minhash.without_near_duplicates(none), decontam.contaminated(none, bench), decontam.contaminated(awkward, no_items), decontam.without_leaks(none, no_items), sharding.shard_documents(none), mixing.mix_documents(none),
        pq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")), warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert got.count() == 0
    assert lm.cross_entropy_difference(awkward.filter("text IS NULL OR doc_id = 3"), no_labels).filter("target_loss IS NULL").count() == 3


def test_warc_headers_that_are_no_utf8_and_foreign_digests(spark, tmp_path):
    head = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: text/plain\r\nContent-Length: 4\r\n"
    body = b"\r\nbody\r\n\r\n"
    sha = hashlib.sha1(b"body").hexdigest().encode()
    parts = [
        head + b"WARC-Target-URI: http://x/\xed\r\n" + body, head + b"WARC-Page-ID: abc\r\n" + body, head + b"WARC-Page-ID: 99999999999999999999\r\n" + body,
        head + b"WARC-Payload-Digest: sha1:" + b"A" * 32 + b"\r\n" + body, head + b"WARC-Block-Digest: sha1:" + sha + b"\r\n" + body, head + b"WARC-Block-Digest: sha1:" + sha[::-1] + b"\r\n" + body,
        head + b"WARC-Block-Digest: odd:1\r\n" + body,
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    got = warc.read_warc(spark, f"file://{tmp_path}").orderBy("start").collect()
    at = np.cumsum([0, *map(len, parts)]).tolist()
    assert [r.start for r in got] == [at[i] for i in (0, 1, 2, 4, 6)] and {r.page_id for r in got} == {None} and got[0].uri == "http://x/�"
    back = warc.gaps(warc.read_warc(spark, f"file://{tmp_path}"), spark, f"file://{tmp_path}")
    assert {(r.start, r.end) for r in back.collect()} == {(at[3], at[4]), (at[5], at[6])}


def test_lines_routed_to_shards_as_probed_in_place(spark, awkward, monkeypatch):
    rows = awkward.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, f"{_text(i % 7, 8)}\nshared {i % 3}\n\n{_text(i, 5)}") for i in range(60)], "doc_id long, text string"))
    plain = sorted(map(str, linededup.dedup_lines(rows).collect()))
    monkeypatch.setattr(linededup, "SHARD_KEYS", 10)
    monkeypatch.setattr(linededup, "CACHED_SHARDS", 2)
    assert sorted(map(str, linededup.dedup_lines(rows).collect())) == plain


def test_mixing_through_levels_of_the_tree(spark):
    docs = spark.range(300_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN 'b' ELSE concat('s', id % 5) END AS source")
    got = mixing.copy_counts(docs, weights={"hot": 0.2, "b": 0.5, "s1": 0.3}, total=123_457)
    sums = {r[0]: r[1:] for r in got.groupBy("source").agg({"copies": "sum", "doc_id": "count"}).collect()}
    n = {s: v[0] if v[0] > v[1] else v[1] for s, v in sums.items()}
    assert sum(n.values()) >= 300_000 - 5
    total = {r.source: r.c for r in got.groupBy("source").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "c").collect()}
    want = {"hot": 24_691.4, "b": 61_728.5, "s1": 37_037.1}
    assert all(abs(total[s] - want.get(s, 0.0)) <= 1 for s in total)
    rate = want["b"] / 100_000
    assert {r.copies for r in got.filter("source = 'b'").select("copies").distinct().collect()} == {int(rate), int(rate) + 1}


def test_every_shard_holds_each_source_in_its_share(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source")
    rows = [(r.doc_id, r.source, r.shard, r.position) for r in sharding.shard_rows(docs, 11).collect()]
    size, per, of = Counter(r[2] for r in rows), Counter(r[1:3] for r in rows), Counter(r[1] for r in rows)
    assert max(size.values()) - min(size.values()) <= 1
    assert all(abs(per[s, k] - of[s] / 11) <= 2 for s in of for k in range(11))


def _leaks(docs, items):
    """What passes the exact check, whatever the retrieval finds: every item against every passage."""
    out = {}
    for i, text in docs.items():
        w = decontam.words(text)
        for k, item in items.items():
            want, answer = decontam.words(item), decontam.answer_of(item)
            for start in range(0, max(1, len(w) - decontam.BLOCK), decontam.BLOCK):
                near = w[max(0, start - len(want)) : start + 2 * decontam.BLOCK + len(want)]
                got = decontam._cover(want, near)
                told = bool(answer) and decontam.lcs(answer, near) >= decontam.ANSWER_COVER * len(answer)
                if got >= decontam.COVER or (told and got >= decontam.COVER_WITH_ANSWER):
                    out[i, k] = max(out.get((i, k), 0.0), got)
    return out


def test_leaks_against_brute_force_with_short_items_and_paraphrases(spark):
    g = random.Random(8)
    common = _words(5, 400)
    say = lambda n: [common[min(int(g.paretovariate(0.7)), 399)] if g.random() < 0.7 else g.choice(common) for _ in range(n)]
    items = {k: [*say(g.choice((10, 12, 15, 25, 40))), "answer:", *_words(3000 + k, 3)] for k in range(150)}
    docs = {}
    for i in range(200):
        body = say(g.randint(20, 150))
        if i % 2:
            leak = list(items[g.randrange(150)])
            for _ in range(int(len(leak) * g.choice((0, 0.1, 0.2)))):
                leak[g.randrange(len(leak) - 4)] = g.choice(common)
            at = g.randint(0, len(body))
            body[at:at] = leak
        docs[i] = " ".join(body)
    flat = {k: " ".join(v) for k, v in items.items()}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(flat.items()), "item_id long, text string")
    want, got = _leaks(docs, flat), {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()}
    assert len(want) > 80 and len(got & set(want)) >= 0.97 * len(want)
    assert got <= set(want)


def test_pipeline_against_brute_force(spark, tmp_path):
    g = random.Random(2)
    texts = {}
    for i in range(240):
        if i % 6 == 1:
            texts[i] = texts[i - 1] + (" tail" if i % 12 == 1 else "")
        else:
            texts[i] = _text(500 + i, g.randint(30, 90))
        if i % 10 == 4:
            texts[i] += " you idiot moron trash scum"
    item = _text(9000, 30)
    for i in (12, 50, 51):
        texts[i] = f"{_text(i, 20)} {item} {_text(i + 1, 20)}"
    rows = [(i, t, "en", f"src{i % 3 and 1 + i % 2}", len(t)) for i, t in texts.items()] + [(300, None, None, None, None), (301, "", "en", "src0", 0), (302, "x" * 90_000, "en", "src1", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    toxic = {i for i in texts if i % 10 == 4}
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = {r[0]: r for r in rows if r[0] not in toxic}
    sets = {i: set(zip(*(w[k:] for k in range(3)))) for i, w in ((i, (r[1] or "").split()) for i, r in left.items())}
    for i in sorted(left):
        if any(j < i and j in left and sets[i] and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j]) for j in sets):
            del left[i]
    for i, _ in _leaks({i: r[1] for i, r in left.items() if r[1]}, {1: item}):
        left.pop(i, None)
    n, shares = Counter(r[3] for r in left.values()), {}
    for s, k in n.items():
        shares[s] = k**mixing.TEMPERATURE
    mixed = []
    for s, k in n.items():
        rate = len(left) * shares[s] / sum(shares.values()) / k
        ids = np.array(sorted(i for i in left if left[i][3] == s), np.int64)
        out, live = mixing.pivot(np.full(k, rate - int(rate)), mixing._draws(ids, 0, mixing.SEED))
        if live >= 0:
            out[live] = float(mixing._draws(ids[live : live + 1], 999, mixing.SEED)[0] < out[live])
        mixed += [left[i] for i, c in zip(ids.tolist(), out) for _ in range(int(rate) + round(c))]
    seen, keyed = Counter(), []
    for r in mixed:
        seen[r[0]] += 1
        keyed.append((r[3], hashlib.md5(f"{sharding.SEED}:{r[0]}:{seen[r[0]]}".encode()).hexdigest(), r[0]))
    ranked = []
    for s in {k[0] for k in keyed}:
        own = sorted(k for k in keyed if k[0] == s)
        ranked += [((2 * i + 1) / (2 * len(own)), "" if s is None else "s" + s, i, k[2]) for i, k in enumerate(own)]
    want = [(i, p * sharding.SHARDS // len(ranked), p) for p, (_, _, _, i) in enumerate(sorted(ranked))]

    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "position"]
    assert sorted((r.position, r.doc_id, r.shard) for r in got.collect()) == [(p, i, s) for i, s, p in want]


def test_pipeline_stages_on_awkward_input(spark, awkward, bench, labels, tmp_path):
    for name, df in (("benchmark", bench), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = awkward
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[: len(awkward.columns)] == awkward.columns, name
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert {None, 0, 2, 3, 6, 7, 10} & {r.doc_id for r in docs.collect()}
    assert stage(spark, awkward.limit(0), str(tmp_path)).count() == 0
