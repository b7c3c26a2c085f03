"""Nulls, repeated and very long rows, clashing columns, damaged files; the pipeline and its stages by brute force."""

import hashlib
import os
import random
import shutil
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from obsidra.llm import cross_polytope, exact_search, langid, minhash, mixing, packing, quality, suffix_dedup, token_store
from obsidra.llm.common import sliced
from obsidra.llm.tokens import Cache, encoder, vocabulary
from tests.llm.test_operators import _near, _repeats

BYTE, WORD = (vocabulary(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
WORDS = ["the", "of", "alpha", "beta", "gamma", "delta.", "Omega,", "run", "x", "stone", "river", "light"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def test_slices_are_bounded_and_whole():
    rows = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["a" * n for n in (1, 2, 900, 1, 1, 1, 1, 1, 1)])], ["k", "t"])
    parts = list(sliced([rows, rows.slice(0, 0)], most=100, rows=3))
    assert pa.Table.from_batches(parts).column("k").to_pylist() == list(range(9))
    assert all(p.num_rows <= 3 for p in parts) and max(p.num_rows for p in parts if 2 in p.column(0).to_pylist()) <= 3


def test_cache_is_bounded_in_bytes_and_keeps_what_is_used():
    cache = Cache(20_000)
    cache.add({"often": b"1234"})
    for k in range(2000):
        cache.add({f"w{k}": b"1234"})
        assert cache.find(["often"]) == [b"1234"]
    assert len(cache.young) + len(cache.old) < 120
    cache.add({f"v{k}": b"1" for k in range(5000)})
    assert cache.held <= 10_000


def test_packing_of_texts_longer_than_a_block(spark):
    texts = [prose(1, 900), None, prose(2, 40), prose(3, 2500), ""]
    docs = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs, BYTE, length=64, grid=8, block_ids=300, sentence_cost=1.0, forced_cost=2.0).collect()
    for k, text in enumerate(texts):
        want, at = np.frombuffer(encoder(BYTE).whole([text or ""])[0] + np.array([1], "<u4").tobytes(), "<u4"), 0
        for r in sorted((r for r in rows if r.doc_id == (k or None)), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want)) and bytes(r.ids) == want[at : at + r.length].tobytes()
            at += r.length
        assert at == len(want)
    sizes = {}
    for r in rows:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert sorted(sizes) == list(range(len(sizes))) and max(sizes.values()) <= 64
    assert sum(1 for n in sizes.values() if n < 32) < 12  # only the partition's last ids make short sequences


def test_near_duplicates_of_null_and_repeated_ids(spark):
    a, b = prose(5, 300), prose(6, 300)
    near = [a, a + " more", a + " words here"]
    rows = [(None, near[0]), (None, near[1]), (5, near[2]), (None, b), (7, b), (7, b), (8, None), (8, "")]
    docs = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "doc_id long, text string, cid int, root int, tag string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 5, False), (None, 5, False), (5, 5, True), (None, 7, False), (7, 7, True), (7, 7, True), (8, 8, True), (8, 8, True)], key=str)
    kept = sorted(((r.doc_id, r.text, r.cid, r.root, r.tag) for r in minhash.keep_first(docs).collect()), key=str)
    assert kept == sorted([(5, near[2], 1, 2, "z"), (7, b, 1, 2, "z"), (8, None, 1, 2, "z"), (8, "", 1, 2, "z")], key=str)


def test_keep_first_goes_by_row(spark):
    t, other = prose(7, 60), prose(8, 60)
    docs = spark.createDataFrame([(1, t), (1, t), (2, other), (2, t)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in minhash.keep_first(docs).collect()) == [(1, t), (2, other)]
    assert minhash.keep_first(docs.limit(0)).columns == docs.columns


def test_repeats_of_one_anchor_in_many_runs(spark):
    """More runs of one anchor than a part holds, through small batches."""
    r = random.Random(9)
    common = "".join(r.choice("abcdefgh") for _ in range(90))
    mark = lambda: "".join(r.choice("ijklmnop") for _ in range(3))
    texts = [mark() + mark() * r.randrange(1, 8) + common + mark() * r.randrange(1, 8) for _ in range(5000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
        got = suffix_dedup.repeated(docs, part=1000).orderBy("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got] == _repeats(texts, 100)
    assert sum(x.n_removed > 0 for x in got) > 1000


def test_repeats_in_texts_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 500)
    text = prose(10, 400).encode()
    data = np.frombuffer(text + text[:700], np.uint8)
    starts, counts, ahead, anchors = suffix_dedup.runs_of(data, 100)
    monkeypatch.undo()
    assert counts.sum() == len(data) - 99 and (starts[1:] == starts[:-1] + counts[:-1]).all()
    whole = suffix_dedup.runs_of(data, 100)
    place = np.repeat(starts + ahead, counts)
    assert (place == np.repeat(whole[0] + whole[2], whole[1])).all()


def test_without_repeats_keeps_columns_that_clash(spark):
    passage = prose(11, 40)
    rows = [(1, "a " + passage, 5, "s", "d", 1), (2, "b " + passage, 6, "s", "d", 1), (None, "c " + passage, 7, "s", "d", 1), (3, None, 8, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string, doc string, tag int")
    got = sorted(suffix_dedup.without_repeats(docs).collect(), key=lambda r: str(r.doc_id))
    assert [r.spans for r in got] == ["s", "s", None, "s"] and [r.doc for r in got] == ["d", "d", None, "d"]
    by = {r.doc_id: r for r in got}
    assert by[None].text == "c " + passage and len(by[1].text) < 12 and by[1].n_chars == len(by[1].text) and by[3].text is None


def test_mixing_keeps_columns_that_clash(spark):
    docs = spark.createDataFrame([(k, "w " * 5, "en", f"s{k % 3}", "zz", k) for k in range(30)] + [(None, "w", None, None, "zz", 1)], "doc_id long, text string, lang string, source string, mix_lang string, mix_tokens long")
    got = mixing.mix(docs, fraction=1.0).collect()
    assert {(r.doc_id, r.mix_lang, r.mix_tokens) for r in got} == {(k, "zz", k) for k in range(30)} | {(None, "zz", 1)}


def test_damaged_token_stores_raise(spark, tmp_path):
    docs = spark.createDataFrame([(k, prose(k, 60)) for k in range(6)] + [(3, "again"), (None, "none")], "doc_id long, text string")
    path = str(tmp_path / "store")
    token_store.write(docs, path, WORD, mean=16, most=64)
    assert token_store.read(spark, path).count() == 8
    levels = {r.level: r for r in spark.read.parquet(f"{path}/manifest").collect()}
    assert levels[2].documents == 8 and len(levels) == 3

    def damaged(kind, part):
        other = str(tmp_path / f"{kind}-{part}")
        shutil.copytree(path, other)
        kept = spark.read.parquet(f"{path}/{kind}").collect()
        schema = spark.read.parquet(f"{path}/{kind}").schema
        shutil.rmtree(f"{other}/{kind}")
        return other, kept, schema

    other, rows, schema = damaged("objects", "chunk")
    chunks = [r for r in rows if r.kind == "chunk"][1:]
    spark.createDataFrame(chunks, schema).write.partitionBy("kind").parquet(f"{other}/objects")
    with pytest.raises(Exception, match="missing chunk"):
        token_store.read(spark, other).collect()
    with pytest.raises(Exception, match="missing chunk"):
        token_store.restore(spark, other).collect()
    other, rows, schema = damaged("recipes", "lost")
    spark.createDataFrame(rows[1:], schema).write.parquet(f"{other}/recipes")
    assert not token_store.verify(spark, other)
    with pytest.raises(ValueError):
        token_store.read(spark, other)
    empty = str(tmp_path / "empty")
    token_store.write(docs.limit(0), empty, WORD)
    assert token_store.read(spark, empty).count() == 0


def test_searches_of_repeated_and_few_vectors(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((15, 64))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(0, x[0].tolist()), (3, x[3].tolist()), (None, x[1].tolist()), (5, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for found, scores in ((exact_search.search(df), np.floor(x * 64) @ np.floor(x * 64).T), (cross_polytope.search(df), x @ x.T)):
        got = sorted((q.rank, q.vec_id, float(q.score)) for q in found.collect())
        want = sorted((-scores[0, k], k) for k in range(1, 15))
        assert [(a, b) for a, b, _ in got] == [(n + 1, k) for n, (_, k) in enumerate(want)]
        assert np.allclose([s for _, _, s in got], [-v for v, _ in want])


def test_searches_order_ties_by_id(spark):
    same = [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(60)]
    df = spark.createDataFrame(same, "vec_id long, embedding array<float>")
    for found in (exact_search.search(df, k=5), cross_polytope.search(df, k=5)):
        rows = {(r.query_id, r.rank): r.vec_id for r in found.collect()}
        assert [rows[0, k] for k in range(1, 6)] == [1, 2, 3, 4, 5] and [rows[20, k] for k in range(1, 6)] == [0, 1, 2, 3, 4]


def test_pairs_of_axes_have_the_greatest_sums():
    x = np.random.default_rng(4).standard_normal((6, 8))
    got = cross_polytope.nearest_pairs(x, 1, 8, 3, 5)
    for row, names in zip(x, got, strict=True):
        sides = [np.stack([y := cross_polytope.rotated(row[None], 2 + k, 8, 4)[0], -y], axis=1).ravel() for k in (0, 1)]
        sums = (sides[0][:, None] + sides[1][None, :]).ravel()
        assert np.allclose(sums[names], np.sort(sums)[::-1][:5])


def _state(net, k, data):
    """One direction of the network, a byte at a time in plain Python."""
    h = net.recur[k].shape[0]
    state, out = np.zeros(h), []
    for byte in data:
        x, u = net.inputs[k][byte].astype(float) + net.bias[k], state @ net.recur[k].astype(float)
        z, r = (1 / (1 + np.exp(-(x[a : a + h] + u[a : a + h]))) for a in (0, h))
        new = np.tanh(x[2 * h :] + r * u[2 * h :])
        state = z * state + (1 - z) * new
        out.append(state)
    return np.array(out)


def test_language_scores_by_reading_byte_by_byte():
    net = langid.new_network(["a", "b", "c"], 5, 2)
    texts = [b"the quick", b"", b"x", prose(12, 90).encode()]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    got = langid.text_scores(net, raw, np.cumsum([0, *map(len, texts)]))
    blank = b" " * langid.WARM
    for text, row in zip(texts, got, strict=True):
        total = np.zeros(3)
        for at in range(0, len(text), langid.SEGMENT):
            before = (blank + text)[at : at + langid.WARM]
            after = (text[at + langid.SEGMENT :] + blank)[: langid.WARM]
            own = text[at : at + langid.SEGMENT]
            ahead = _state(net, 0, before + own)[langid.WARM :]
            behind = _state(net, 1, (own + after)[::-1])[langid.WARM :][::-1]
            logits = np.concatenate([ahead, behind], axis=1) @ net.out + net.out_bias
            total += (logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))).sum(axis=0)
        assert np.allclose(row[:-1], total, rtol=1e-3, atol=1e-3) and row[-1] == len(text)


def _plain_features(text):
    """The features of quality.features, counted one by one."""
    out = np.zeros(quality.N_FEATURES)
    raw = text.encode()
    if not raw:
        out[-1] = 1.0
        return out
    for byte in raw:
        out[byte] += 1
    count = lambda test: sum(1 for b in raw if test(b))
    upper, lower, digits = count(lambda b: 65 <= b <= 90), count(lambda b: 97 <= b <= 122), count(lambda b: 48 <= b <= 57)
    marks = len(raw) - upper - lower - digits - count(lambda b: b in b"\t\n\x0b\x0c\r ") - count(lambda b: b > 127)
    words, lines = text.split(), text.split("\n")
    w, distinct = max(len(words), 1), len(set(words))
    more = [
        upper / (upper + lower + 1), marks / len(raw), digits / len(raw), marks / w, len(raw) / w / 10, np.log1p(w) / 5, distinct / w, np.log1p(distinct) / np.log1p(w),
        sum(words[k] == words[k - 1] for k in range(1, len(words))) / w, len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)) / 5, out[33] / w, (out[46] + out[63] + out[33]) / w, 0.0,
    ]
    out[:256] = np.sqrt(out[:256] / len(raw))
    out[256:] = more
    return out


def test_quality_by_brute_force(spark):
    texts = [prose(k, 30 + k) if k % 3 else "CLICK!! $$$ 9 " * (k + 2) for k in range(60)] + ["", None, "über\nüber", prose(1, 31)]
    docs = spark.createDataFrame([(*x, 1, "y") for x in enumerate(texts)], "doc_id long, text string, n int, score string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(60)] + [(2, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    ranking = quality.fitted(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), 5, 0, 6000)
    for r in quality.score(docs, labels).collect():
        x = _plain_features(texts[r.doc_id] or "")
        assert np.allclose(x, quality.features(texts[r.doc_id]))
        raw = sum(w * min(max((v - m) / s, -6), 6) for w, v, m, s in zip(ranking.weights, x, ranking.mean, ranking.scale, strict=True))
        want = 1 / (1 + np.exp(-np.clip((raw - ranking.threshold) / ranking.spread + np.log(0.3 / 0.7), -40, 40)))
        assert r.score == pytest.approx(want, abs=1e-6) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    # The weights are a minimum: pairs of the sample are in order, and no held-out label is used.
    others = labels.where("doc_id IS NULL").union(spark.createDataFrame([(k, 1 - int(k % 3 > 0) if zlib.crc32(str(k).encode()) % 5 == 0 else int(k % 3 > 0), 0) for k in range(60)] + [(2, 1, 0)], labels.schema))
    again = quality.fitted(docs.select("doc_id", "text"), others.select("doc_id", "quality"), 5, 0, 6000)
    assert np.allclose(again.weights, ranking.weights)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, labels).count() == 0 and langid.identify(docs).count() == 0
    for kept in (quality.keep_good(docs, labels), minhash.keep_first(docs), suffix_dedup.without_repeats(docs), mixing.mix(docs)):
        assert kept.columns == docs.columns and kept.count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with near copies, repeated rows and passages, nulls and bad documents, as a table folder."""
    path = str(tmp_path_factory.mktemp("corpus"))
    good = [prose(k, 80) for k in range(40)]
    rows = [(k, t, "en" if k % 3 else "de", f"s{k % 6}") for k, t in enumerate(good)]
    rows += [(100 + k, good[k] + " tail", "en", "s1") for k in range(5)] + [(200, good[3][:200] + " " + prose(99, 50), "fr", "s2")]
    rows += [(300 + k, "CLICK!! $$$ 9 " * (k + 3), "en", "s0") for k in range(20)] + [(7, good[7], "de", "s1"), (400, None, None, None), (None, prose(77, 60), "en", None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(3).write.parquet(f"{path}/documents.parquet")
    labels = [(k, int(k < 100), 0) for k in [*range(40), *range(300, 320)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_by_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    by_stage = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            out.write.mode("overwrite").parquet(f"{corpus}/{name.replace(' ', '-')}")
            docs = spark.read.parquet(f"{corpus}/{name.replace(' ', '-')}")
            out = docs
        by_stage[name] = out.collect()
    start, good, near, passages, mixed, packed = by_stage.values()
    scores = quality.score(spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet")).collect()
    wanted = {r.doc_id for r in scores if r.score >= 0.3}
    assert sorted(map(str, good)) == sorted(str(r) for r in start if r.doc_id in wanted) and not any(r.doc_id is not None and 300 <= r.doc_id < 400 for r in good)
    order = sorted(good, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    five = _near([r.text for r in order], width=5)
    stay = [r for r, (n, root, _) in zip(order, five, strict=True) if n == 0 or order[root] == r]
    unique = {str(r): r for r in stay if r.text} | {f"empty {k}": r for k, r in enumerate(r for r in stay if not r.text)}
    assert sorted(map(str, near)) == sorted(map(str, unique.values()))
    rows = sorted(near, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    left = {r.doc_id: r.text for r in passages}
    for r, (_, removed, _, sha) in zip(rows, _repeats([r.text for r in rows], 100), strict=True):
        assert hashlib.sha256((left[r.doc_id] or "").encode()).hexdigest() == sha and len(left[r.doc_id] or "") == len(r.text or "") - removed
    assert sum(len(r.text or "") for r in passages) < sum(len(r.text or "") for r in near)
    assert all(r.n_chars == len(r.text) for r in passages if r.text is not None)
    taken = mixing.select_prefixes(spark.createDataFrame(passages, docs.schema), fraction=0.9, weights=corpus_pipeline.MIX_WEIGHTS).collect()
    assert sorted(str(r.doc_id) for r in mixed) == sorted(str(r.doc_id) for r in taken)
    total = sum(len((r.text or "").split()) for r in passages)
    assert total * 0.9 <= sum(len((r.text or "").split()) for r in mixed) <= total * 0.9 + 90 * 12
    counts = {}
    for r in packed:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + r.length
    want = {}
    for r in mixed:
        want[r.doc_id] = want.get(r.doc_id, 0) + len(encoder(BYTE).whole([r.text or ""])[0]) // 4 + 1
    assert counts == want
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, corpus).collect()) == sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in packed)
    assert os.path.isdir(corpus)


def test_exact_search_takes_many_pairs_as_one_product(monkeypatch):
    r = np.random.default_rng(8)
    single, plain = [], np.einsum
    monkeypatch.setattr(exact_search.np, "einsum", lambda how, *x: single.append(len(x[0])) or plain(how, *x))
    near = np.repeat(r.integers(-9, 9, (40, 64)), 50, axis=0)
    x = {
        "random": r.integers(-30, 30, (2000, 64)), "equal": np.ones((2000, 64)), "growing": np.arange(2000)[:, None] * np.ones(64),
        "large": r.integers(-(10**6), 10**6, (2000, 64)), "near": near + r.integers(0, 2, (2000, 64)),
    }
    for name, rows in x.items():
        rows, ids = rows.astype(float), np.arange(2000)
        queries = exact_search.Queries(ids[::20], rows[::20], 7)
        for at in range(0, 2000, 256):
            block = exact_search.unpacked(exact_search.packed(rows[at : at + 256]), 64)
            queries.look(exact_search.Vectors(ids[at : at + 256], block))
        got = queries.answers().to_pydict()
        for q in range(0, 2000, 20):
            scores = [(-int(v), int(n)) for n, v in enumerate(rows @ rows[q]) if n != q]
            mine = [(-s, v) for a, v, s in zip(got["query_id"], got["vec_id"], got["score"], strict=True) if a == q]
            assert mine == sorted(scores)[:7], name
        assert name != "random" or sum(single) < 2000 * 100 / 8


def test_chunks_of_documents_on_end_are_those_of_each_alone():
    r = np.random.default_rng(6)
    sizes = [1, 1, 3, 0, 7, 8, 9, 400, 2, 5000, 1]
    at = np.cumsum([0, *sizes])
    ids = r.integers(0, 50, at[-1]).astype("<u4")
    ids[at[9] : at[10]] = 7  # no hit in a long stretch
    got = token_store.cut_positions(ids, at, 16, 64).tolist()
    want = []
    for a, b in zip(at, at[1:]):  # noqa: B905
        want += [a + e for e in token_store.cut_positions(ids[a:b], np.array([0, b - a]), 16, 64).tolist()]
    assert got == want and set(at[1:].tolist()) - {0} <= set(got) and max(np.diff([0, *got])) <= 64


def test_words_are_told_apart_by_the_ids_that_end_them():
    coder = encoder(WORD)
    words = ["stone", "zzyxwq", "éreétion", "a", "undeinzuausch", "the"]
    assert coder.of_words(words) == coder.whole(words) == [coder.whole([w])[0] for w in words]
    assert coder.of_words(["two words", "one"]) == coder.whole(["two words", "one"])
    assert sum(coder.last) > 0 and encoder(BYTE).last is None


def test_cross_polytope_meets_the_probed_pairs_at_any_size_and_share(spark):
    r = np.random.default_rng(9)
    x = r.standard_normal((400, 16)).astype(np.float32)
    x[300:] = x[7]  # a crowded bucket
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    y = cross_polytope.unit(x.astype(float))
    met = np.zeros((400, 400), dtype=bool)
    for t in range(3):
        code = cross_polytope.nearest_pairs(y, t, 16, 3, 1)[:, 0]
        for q in range(0, 400, 20):
            met[q] |= np.isin(code, cross_polytope.nearest_pairs(y[q : q + 1], t, 16, 3, 40)[0])
    want = {}
    for q in range(0, 400, 20):
        scores = x.astype(float) @ x[q].astype(float)
        able = [n for n in range(400) if n != q and (met[q, n] or met[q].sum() - met[q, q] < 5)]
        want[q] = sorted(able, key=lambda n: (-round(scores[n], 9), n))[:5]
    for more in ({}, {"tile_bytes": 5000, "least_tiles": 1}):
        found = cross_polytope.search(df, k=5, tables=3, pair_probes=40, **more).orderBy("query_id", "rank").collect()
        assert {q: [r.vec_id for r in found if r.query_id == q] for q in want} == want


def test_buckets_beyond_a_list_are_found_alike():
    r = np.random.default_rng(1)
    ids, x = np.arange(50), r.standard_normal((50, 4))
    codes, probes = r.integers(0, 64, (50, 2)), [r.integers(0, 64, (6, 9)) for _ in range(2)]
    got = [[rows.tolist() for rows in cross_polytope.Index(ids, x, codes, n).met(probes)] for n in (64, 1 << 40)]
    assert got[0] == got[1] == [[n for n in range(50) if codes[n, 0] in a or codes[n, 1] in b] for a, b in zip(*probes, strict=True)]
