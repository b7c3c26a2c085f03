"""Operators against brute force on small frames: nulls, empty and repeated rows, ties, clashing columns, empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from obsidra.llm import chat, cross_polytope, exact_search, langid, minhash, mixing, packing, quality, suffix_dedup, token_store
from obsidra.llm.tokens import Encoder, encoder, vocabulary

BYTE, WORD = (vocabulary(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
CLASH = ", tag int, n int, key string, start int"


def frame(spark, texts, extra=True):
    rows = [(k, t, *((1, 2, "x", 3) if extra else ())) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + (CLASH if extra else ""))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    words = ["the", "of", "alpha", "beta", "gamma", "über", "delta.", "Omega,", "run\nfast", "x"]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(1, 120))) for _ in range(30)]
    near = [t.replace("alpha", "ALPHA", 1) for t in base[:6]]
    part = [base[k][:150] + " " + base[k + 1][-140:] for k in range(8)]
    return [*base, None, "", " ", "one", *near, *part, *base[:3], "Und " * 300, "Und " * 301, " ".join(map(str, range(4000)))]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_encoding_is_the_librarys(path):
    import pyarrow as pa

    r = random.Random(1)
    bits = ["a", "b ", " ", "\n", "1", ".", "é", "'s", "<|", "endoftext|>", "中", "\t", "\x1d", "́"]
    cases = [None, "", " ", "it's we'll 12", "a  b", *("".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(500))]
    coder = Encoder(path)
    ids, at = coder.encode(pa.array(cases, pa.string()))
    assert [ids[a:b].tobytes() for a, b in zip(at, at[1:])] == coder.whole([t or "" for t in cases])  # noqa: B905


def _ids(path, text):
    return np.frombuffer(encoder(path).whole([text or ""])[0] + np.array([1], "<u4").tobytes(), "<u4")


def test_packing(spark, texts):
    rows = packing.pack(frame(spark, texts), BYTE, length=64, grid=8, block_ids=500).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in enumerate(texts):
        want, at = _ids(BYTE, text), 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(want[at : at + r.length].tobytes())
            at += r.length
        assert at == len(want)
    for part in by_sequence.values():
        part.sort(key=lambda r: r.offset)
        assert [r.offset for r in part] == [sum(x.length for x in part[:k]) for k in range(len(part))]
        assert sum(r.length for r in part) <= 64
    assert packing.pack(frame(spark, texts).limit(0), BYTE).count() == 0


def test_window_ends_are_optimal():
    r = random.Random(2)
    for _ in range(50):
        cuts = np.cumsum([r.randrange(1, 5) for _ in range(12)])
        cost = np.array([r.choice([0.0, 1.0, 3.0]) for _ in cuts])
        ends = packing.window_ends(cuts, cost, 8)
        best = {0: 0.0}
        for k, c in enumerate(cuts.tolist()):
            best[c] = min(best[b] + cost[k] + 8 - (c - b) for b in best if c - b <= 8)
        at, total = 0, 0.0
        for e in ends:
            total += cost[cuts.tolist().index(e)] + 8 - (e - at)
            at = e
        assert total == pytest.approx(best[int(cuts[-1])])


def test_token_store(spark, texts, tmp_path):
    path = str(tmp_path / "store")
    docs = frame(spark, texts)
    token_store.write(docs, path, WORD, mean=16, most=64)
    start = 0
    for r in token_store.read(spark, path).orderBy("doc_id").collect():
        want = _ids(WORD, texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    for r in token_store.restore(spark, path).collect():
        assert bytes(r.ids) == _ids(WORD, texts[r.doc_id]).tobytes()
    assert token_store.verify(spark, path)
    keys = [r.key for r in spark.read.parquet(f"{path}/objects").where("kind = 'chunk'").collect()]
    assert len(keys) == len(set(map(bytes, keys)))
    with pytest.raises(ValueError):
        token_store._unpacked(__import__("zstandard").ZstdCompressor().compress(b"\0\0"), 1, b"x" * 16)


def _repeats(texts, length):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        left = bytes(b for b, g in zip(raw, gone) if not g)  # noqa: B905
        out.append((len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def test_suffix_dedup(spark, texts):
    got = suffix_dedup.repeated(frame(spark, texts).repartition(5)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == _repeats(texts, 100)
    assert suffix_dedup.repeated(frame(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_suffix_dedup_of_rows_that_stand_twice(spark, texts, parts):
    """Equal in doc_id and text, they are one document: its first copy of a passage stays."""
    docs = frame(spark, texts)
    want = sorted((k, *r) for k, r in enumerate(_repeats(texts, 100)))
    got = suffix_dedup.repeated(docs.union(docs).repartition(parts)).collect()
    found = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert found[::2] == want and found[1::2] == want
    kept = suffix_dedup.without_repeats(docs.union(docs).repartition(parts)).collect()
    assert sum(len((r.text or "").encode()) for r in kept) >= 2 * sum(r[1] - r[2] for r in want) - 8 * len(want)


def test_positional_transform():
    r = random.Random(3)
    for _ in range(60):
        ts = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 12))) for _ in range(r.randrange(1, 8))]
        ahead = np.array([r.randrange(min(3, len(t))) for t in ts])
        size = r.randrange(1, 5)
        lens = np.array([len(t) for t in ts])
        flat = np.frombuffer(b"".join(ts), np.uint8)
        firsts = suffix_dedup.repeats_of(flat, np.cumsum(lens) - lens, lens, ahead, size)
        found = [(int(w), int(k) + j) for w, k, n in zip(*firsts[:3]) for j in range(n)]  # noqa: B905
        want = sorted(
            (i, k) for i, t in enumerate(ts) for k in range(len(t) - size + 1)
            if any(k - ahead[i] + ahead[j] >= 0 and ts[j][k - ahead[i] + ahead[j] :][:size] == t[k : k + size] for j in range(i))
        )
        assert sorted(found) == want
        assert [k for k, w in enumerate(firsts[3]) if w] == [k for k, t in enumerate(ts) if len([w for w in want if w[0] == k]) == len(t) - size + 1]


def _near(texts, width=4):
    """(n, component, kept) by comparing all pairs."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return [(len(s), root[k], root[k] == k) for k, s in enumerate(sets)]


def test_near_duplicates(spark, texts):
    got = minhash.near_duplicates(frame(spark, texts), width=4).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id, r.kept) for r in got] == _near(texts)


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """Altered copies of a text, many too far from it to link; groups are cut into blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    r, texts = np.random.default_rng(6), []
    for words, copies, most in ((150, 120, 12), (420, 60, 30), (12, 30, 2)):
        base = [f"w{x}" for x in r.integers(0, 5000, words)]
        for _ in range(copies):
            own = list(base)
            for at in r.integers(0, words, r.integers(0, most)):
                own[at] = f"x{r.integers(0, 50)}"
            texts.append(" ".join(own))
    texts = [texts[k] for k in r.permutation(len(texts))]
    got = minhash.near_duplicates(frame(spark, texts), width=4).orderBy("doc_id").collect()
    assert [(x.n_shingles, x.component_id, x.kept) for x in got] == _near(texts)


def test_estimates_far_below_the_similarity_pass(spark):
    """Similarity of 0.8, but of the 64 least values of the union 34 are shared."""
    union = np.arange(400, dtype=np.uint64)
    alone = np.concatenate([union[:60:2], union[350:]])
    a, b = np.setdiff1d(union, alone[::2]), np.setdiff1d(union, alone[1::2])
    assert len(np.intersect1d(a, b)) == 320
    classes = spark.createDataFrame([(k, len(s), bytearray(minhash.packed(s[: minhash.SKETCH]))) for k, s in ((1, a), (2, b))], "cid long, n long, sketch binary")
    links = spark.createDataFrame([(2, 1)], "u long, v long")
    assert 0.5 < minhash.estimate(a[: minhash.SKETCH], b[: minhash.SKETCH]) < 0.58
    assert minhash._estimated(links, classes, 0.8 - minhash.SLACK).count() == 1
    with pytest.raises(ValueError):
        minhash.near_duplicates(frame(spark, ["a b c d e"]), percent=79)


def test_searches(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((120, 16)).astype(np.float32)
    x[50] = x[40]
    rows = [(k, v.tolist(), "x") for k, v in enumerate(x)] + [(200, None, "x"), (220, [float("nan")] * 16, "x"), (240, [0.0] * 16, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    whole = np.floor(x.astype(float) * 64).astype(np.int64)
    names = [*range(120), 240]
    scores = np.vstack([whole, np.zeros((1, 16), np.int64)])
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in exact_search.search(df, k=5).collect()}
    for q in (0, 20, 40, 60, 80, 100, 240):
        s = scores @ scores[names.index(q)]
        best = sorted((-int(v), n) for v, n in zip(s, names) if n != q)[:5]  # noqa: B905
        assert [found[q, k + 1] for k in range(5)] == [(n, -v) for v, n in best]
    hits = cross_polytope.search(df, k=5, tables=6, probes=16).collect()
    exact = {q: {n for _, n in sorted((-float(x[n].astype(float) @ x[q].astype(float)), n) for n in range(120) if n != q)[:5]} for q in range(0, 120, 20)}
    recall = sum(r.vec_id in exact[r.query_id] for r in hits) / 30
    assert recall >= 0.9 and {r.query_id for r in hits} == set(exact)
    assert exact_search.search(df.limit(0)).count() == 0 and cross_polytope.search(df.limit(0)).count() == 0


def test_language_gradients_and_labels(spark):
    net = langid.new_network(["a", "b"], 4, 1)
    words, labels = np.random.default_rng(1).integers(97, 100, (5, 4)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    for p in net.parameters():
        p[...] = p.astype(np.float32)
    _, grads = langid.gradients(net, words, labels)
    for p, g in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, step = p[at], 1e-2
        p[at] = keep + step
        up, _ = langid.gradients(net, words, labels)
        p[at] = keep - step
        down, _ = langid.gradients(net, words, labels)
        p[at] = keep
        assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=0.08, abs=2e-4)
    rows = [(k, ("le chat et les chiens " if k % 2 else "the dog and those cats ") * 5, "fr" if k % 2 else "en") for k in range(60)]
    df = spark.createDataFrame([*rows, (100, None, None), (101, " 12 !", "en"), (102, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(got[k].lang_pred == lang and 0 <= got[k].score <= 1 for k, _, lang in rows)
    assert [got[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3


def test_quality(spark):
    rows = [(k, "Good plain words here. " * 5 if k % 2 else "BAD!! *** $$$ " * 9) for k in range(80)]
    docs = spark.createDataFrame([*rows, (200, None), (201, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(80)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert all(got[k].predicted == k % 2 for k in range(80)) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.score == 0.5 for r in quality.score(docs, labels.limit(0)).collect())


def test_chat(spark):
    rows = [(1, 0, "u", "hi"), (2, 0, "u", "hi"), (2, 1, "a", "yo"), (3, 0, "u", "hi"), (3, 1, "a", "yo"), (4, 0, "u", None), (5, 0, "u", "hi"), (5, 1, "a", "no"), (5, 1, "a", "no")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, place int")
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.render(df).collect()}
    line = lambda a, b: f"<|im_start|>{a}\n{b}<|im_end|>\n"
    assert got == {2: (2, line("u", "hi") + line("a", "yo")), 4: (1, line("u", "")), 5: (3, line("u", "hi") + line("a", "no") * 2)}
    assert chat.render(df.limit(0)).count() == 0


def test_mixing(spark):
    rows = [(k, "w " * (k % 7 + 1), "en" if k % 3 else None, f"s{k % 5}") for k in range(200)] + [(900, None, "en", "s1"), (7, "w w", "en", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = {("d0",): 3.0, ("d1", "en"): 2.0}
    got = mixing.select_prefixes(df, weights=weights, rows_a_range=10).collect()
    held = {}
    for _, text, lang, source in rows:
        leaf = (f"d{int(source[1:]) % 4}", lang or "(none)", source)
        held[leaf] = held.get(leaf, 0) + len((text or "").split())
    budgets = mixing.leaf_budgets(held, 0.5 * sum(held.values()), weights, 4)
    assert sum(budgets.values()) == pytest.approx(0.5 * sum(held.values()))
    want = []
    for leaf, budget in budgets.items():
        limit, before = int(np.ceil(budget - 1e-6)), 0
        for epoch in range(max(1, int(np.ceil(limit / held[leaf]))) if held[leaf] else 1):
            own = [(hashlib.md5(f"17:{epoch}:{d}".encode()).hexdigest(), d, len((t or "").split())) for d, t, lang, s in rows if (f"d{int(s[1:]) % 4}", lang or "(none)", s) == leaf]
            for key in sorted({k for k, _, _ in own}):
                same = [x for x in own if x[0] == key]
                want += [(d, *leaf, epoch, before, min(n, limit - before)) for _, d, n in same if before < limit]
                before += sum(n for _, _, n in same)
    assert sorted(map(tuple, got)) == sorted(want)
    assert mixing.mix(df, weights=weights).columns == df.columns
    assert mixing.select_prefixes(df.limit(0)).count() == 0


def test_shortages_go_to_siblings_first():
    leaves = {("a", "x", "1"): 10.0, ("a", "x", "2"): 100.0, ("b", "y", "3"): 100.0}
    found = mixing.leaf_budgets(leaves, 100.0, {}, 1)
    assert found == {("a", "x", "1"): 10.0, ("a", "x", "2"): 40.0, ("b", "y", "3"): 50.0}


def test_estimates_of_many_are_those_of_pairs():
    r = np.random.default_rng(5)
    pool = np.sort(r.choice(1 << 40, 150, replace=False)).astype(np.uint64)
    sketches = [np.sort(r.choice(pool, r.integers(20, 120), replace=False))[: minhash.SKETCH] for _ in range(20)]
    grid = np.full((20, minhash.SKETCH), np.uint64(0xFFFFFFFFFFFFFFFF))
    for k, s in enumerate(sketches):
        grid[k, : len(s)] = s
    values, codes = np.unique(grid, return_inverse=True)
    codes, blank = codes.reshape(grid.shape), values == np.uint64(0xFFFFFFFFFFFFFFFF)
    for i in range(20):
        own = np.zeros(len(values), bool)
        own[codes[i]] = True
        own[blank] = False
        got = minhash._estimates(codes, i, np.arange(20), own, blank)
        assert np.allclose(got, wanted := [minhash.estimate(sketches[i], s) for s in sketches])
        assert np.allclose(minhash._similar(np.repeat(grid[i : i + 1], 20, axis=0), grid), wanted)
