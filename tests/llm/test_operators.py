"""The training-data operators against brute force, round trips and held-out labels, on small tables with odd rows."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gridlark.llm import covering, flac, langid, lm_score, mixing, order_minhash, packing, quality, suffix_dedup, token_counts
from gridlark.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, marks string, f long"
EN, FR = ("the", "of", "and", "ing", "tion", "there", "with"), ("le", "de", "que", "eau", "était", "ça", "aux")


def prose(rng, words, n):
    return " ".join("".join(rng.choices(words, k=rng.randint(1, 3))) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(60):
        fr = i % 3 == 0
        text = prose(rng, FR if fr else EN, rng.randint(3, 160))
        if i % 7 == 1:
            text = " ".join(w.upper() + "!!" for w in text.split()[:20])
        out.append([i * 3, text, "fr" if fr else "en", f"s{i % 4}" if i % 5 else None])
    passage = prose(rng, EN, 90)
    for i in (4, 11, 23):
        out[i][1] = out[i][1] + " " + passage + " " + out[i][1][::-1]
    out[8][1] = out[9][1] = out[2][1]  # copies
    out[10][1] = out[2][1] + " more"
    out += [[200, None, "en", "s1"], [201, "", None, "s1"], [202, " \t\n", "fr", None], [None, "no id here", "en", "s0"], [5000, "x" * 30_000, "en", "big"], [*out[5]], [203, "日本語 テスト 日本語", "ja", "s2"], [204, "aé" * 900, None, "s2"]]
    return [tuple([*r, len(r[1] or ""), 1, "k", "m", 7]) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "text")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_language_model(docs, rows, empty, spark):
    marked = docs.withColumn("learn", docs.doc_id % 2 == 0).na.fill({"learn": False})
    got = {r.doc_id: r for r in lm_score.score_documents(marked, "learn").collect()}
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    train = [w for r in rows if r[0] is not None and r[0] % 2 == 0 for w in [*words_of(low(r[1] or "")), "\n"]]
    n, v = len(train), len(set(train))
    for r in rows:
        ws = [*words_of(low(r[1] or "")), "\n"]
        base = sum(np.log10((train.count(w) + 1) / (n + v + 1)) for w in ws)
        g = got[r[0]]
        assert g.n_tokens == len(ws) and g.train_tokens == n and g.n_known == sum(w in train for w in ws) and g.base_score == pytest.approx(base) and g.score < 0
    assert lm_score.score_documents(empty.withColumn("learn", empty.doc_id == 1), "learn").count() == 0


def a_model(texts, **params):
    p = lm_score.MixingParams(**params)
    coder = lm_score.Coder(12, lm_score.fit_topics(texts, p), lm_score.byte_tree(lm_score.byte_counts(texts)), p)
    rng = np.random.default_rng(0)
    states = (rng.integers(0, 60, (lm_score.ORDERS, 1 << 12)) << 6 | rng.integers(0, 60, (lm_score.ORDERS, 1 << 12))).astype(np.uint16)
    weights = rng.normal(0.3, 0.1, (lm_score.GATES, lm_score.ORDERS))
    return lm_score.Scorer(states, weights, coder)


def test_language_model_is_a_distribution():
    """The scores of all texts of one short word sum to no more than 1."""
    s = a_model([b"the cat", b"le chat"])
    ones = s.score([lm_score.spelled([bytes([b])]) for b in range(256) if not bytes([b]).isspace()], np.zeros(256 - 6, bool))
    assert 0 < np.exp(ones).sum() < 1


def slow_score(s, stream, learned):
    """Bit by bit and byte by byte, with plain integers."""
    m64, raw, lead = (1 << 64) - 1, bytes(64) + stream, 64
    span = lambda a, b: sum(int(lm_score.BYTE[raw[j]]) * pow(int(lm_score.ODD), j - a, 1 << 64) for j in range(a, b)) & m64
    params, topics, (length, offset, node, bit_of) = s.coder.params, s.coder.topics, s.coder.tree
    factor, total, pending, sums, seen, top = np.ones(lm_score.ORDERS), 0.0, [], np.zeros(params.topics, int), 0, 0
    starts, grad, bits = [lead], np.zeros(lm_score.ORDERS), 0
    value = lambda q: q if q < 16 else 16 * 2 ** ((q - 16) / 6)
    for i in range(lead, len(raw)):
        if (i - lead) % lm_score.STEP == 0:
            for w in pending:
                at = np.flatnonzero(topics.words == np.uint64(w))
                if len(at):
                    sums, seen = sums + topics.weights[at[0]], seen + 1
            pending, top = [], int(np.argmax(sums)) + 1 if seen else 0
        if i > lead and (i - lead) % params.round == 0:
            factor, grad, bits = np.clip(factor + params.text_rate * grad / bits, 0.2, 3), np.zeros(lm_score.ORDERS), 0
        word = max(starts[-1], i - 32)
        previous = max(starts[-2], i - 64) if len(starts) > 1 else i - 64
        topic = top * int(lm_score.ODD) & m64
        contexts = [span(i - 3, i) ^ topic, span(i - 5, i), span(word, i) ^ topic, span(previous, i)]
        contexts = [((c + k + 1) * int(lm_score.MIX) & m64) >> (64 - s.coder.bits) for k, c in enumerate(contexts)]
        for j in range(offset[raw[i]], offset[raw[i]] + length[raw[i]]):
            bit, x, gate = int(bit_of[j]), [], 0
            for k, c in enumerate(contexts):
                slot = c ^ int(node[j])
                state = int(s.states[k, slot])
                zeros, ones = value(state >> 6), value(state & 63)
                zeros, ones = max(zeros - learned * (1 - bit), 0), max(ones - learned * bit, 0)
                x.append((2 * bit - 1) * math.log((ones + 0.3) / (zeros + 0.3)))
                if k >= lm_score.ORDERS - 2:
                    gate = gate * lm_score.LEVELS + min(math.ceil(math.log2(zeros + ones + 1)), lm_score.LEVELS - 1)
            x = np.array(x) * s.weights[:, gate]
            odds = np.clip(factor @ x, -20, 20)
            total -= math.log1p(math.exp(-odds))
            grad, bits = grad + x / (1 + math.exp(odds)), bits + 1
        if raw[i] in b" \n":
            pending.append(span(max(starts[-1], i - 32), i) * int(lm_score.MIX) & m64)
            starts.append(i + 1)
    return total


def test_language_model_bit_by_bit(rows):
    texts = [t.lower().encode() for t in (r[1] or "" for r in rows) if len(t) < 3000] + [b"\0\0 nul", b"x" * 200 + b" y"]
    streams = [lm_score.spelled(t.split()) for t in texts[::6] + texts[-2:]]
    for params in ({}, {"round": 64, "window": 128}, {"round": 96, "window": 96}):
        s = a_model(texts, **params)
        for learned in (0, 1):
            got = s.score(streams, np.full(len(streams), bool(learned)))
            assert got == pytest.approx([slow_score(s, x, learned) for x in streams], rel=1e-4)


def test_language_model_and_partitions(spark, rows):
    """Scores depend on the rows alone, copies score better, and a text of over a window goes through."""
    rows = [(r[0], r[1], r[0] is None or r[0] % 7 != 2) for r in rows] + [(7000, "the cat sat on the mat " * 30_000, False)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    one, other = (sorted((r.doc_id or -1, r.score, r.base_score) for r in lm_score.score_documents(frame.repartition(n), "learn").collect()) for n in (4, 9))
    assert [x[0] for x in one] == [x[0] for x in other] and np.allclose([x[1:] for x in one], [x[1:] for x in other], rtol=1e-9)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_language_model_beats_the_base(spark):
    got = lm_score.op1_lm_score(spark, "/root/testdata/sf0.01").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and held.score.sum() > held.base_score.sum()


def test_language_model_learns_from_all_texts(spark, monkeypatch):
    """Tree, topics and starting weights come from every training text, long ones too, and few tasks count many small files."""
    rng, models, tasks = random.Random(4), [], []
    texts = [prose(rng, FR if i % 2 else EN, 2500).encode() for i in range(12)] + [b"zq " * 9000]
    assert min(map(len, texts)) > 8192
    frame = spark.createDataFrame([(i, t.decode(), True) for i, t in enumerate(texts)] + [(100, "the thing of", False)], "doc_id long, text string, learn boolean").repartition(40)
    score_part, train_states = lm_score._score_part, lm_score.train_states
    monkeypatch.setattr(lm_score, "_score_part", lambda model: models.append(model.value) or score_part(model))
    monkeypatch.setattr(lm_score, "train_states", lambda docs, *a: tasks.append(docs.rdd.getNumPartitions()) or train_states(docs, *a))
    assert lm_score.score_documents(frame, "learn").count() == 14
    (_, weights, coder, *_), want = models[0], lm_score.byte_tree(lm_score.byte_counts(texts))
    assert all(np.array_equal(a, b) for a, b in zip(coder.tree, want))
    seen = {w for t in texts for w in t.lower().split()}
    assert len(coder.topics.words) == min(len(seen), 512) and len(np.unique(coder.topics.weights, axis=1).T) > 1
    assert np.abs(weights - 0.3).max() > 0.1 and tasks[0] <= 2 * spark.sparkContext.defaultParallelism


def test_language_model_counts_copies_once(rows, monkeypatch):
    """Equal bytes in equal contexts go through a table together, and the counts are those of bit after bit."""
    texts = [t for t in ((r[1] or "").lower().encode() for r in rows) if len(t) < 3000] + [b"\0\0 nul", b"x" * 200 + b" y"]
    small, spread = a_model(texts).coder, []
    coder = lm_score.Coder(lm_score.CHUNK.bit_length() - 2, small.topics, small.tree, small.params)
    length, offset, node, bit = coder.tree
    plain = lm_score.Coder.spread
    monkeypatch.setattr(lm_score.Coder, "spread", lambda self, contexts, code, *a: spread.append(len(code)) or plain(self, contexts, code, *a))
    for copies, held in ((1, 1 << 21), (40, 1 << 21), (3, 500)):
        spread.clear()
        monkeypatch.setattr(lm_score, "HELD", held)
        want, met = np.zeros((lm_score.ORDERS, 2 << coder.bits), np.int64), set()
        for window in coder.windows([lm_score.spelled(t.split()) for t in texts]):
            for i, b in enumerate(window.code.tolist()):
                for k in range(lm_score.ORDERS):
                    met.add((k, int(window.contexts[k][i]), b))
                    for j in range(offset[b], offset[b] + length[b]):
                        want[k, 2 * (int(window.contexts[k][i]) ^ int(node[j])) + int(bit[j])] += copies
        got = np.zeros_like(want)
        for out in lm_score._count_bits(coder)([pa.RecordBatch.from_pydict({"text": [t.decode() for t in texts * copies]})]):
            for piece, counts in zip(*(out.column(n).to_pylist() for n in ("piece", "counts"))):
                at = piece & 0xFFFFFFFF
                got[piece >> 32, at : at + lm_score.CHUNK] = lm_score._widened(counts)
        assert np.array_equal(got, want)
        assert held == 500 or sum(spread) == len(met)


@pytest.mark.parametrize("most", [1, 200, 60_000, 1 << 20])
def test_narrow_counts(most):
    rng = np.random.default_rng(most)
    for met in (1, 500, lm_score.CHUNK):
        counts = np.zeros(lm_score.CHUNK, np.uint32)
        counts[rng.choice(lm_score.CHUNK, met, replace=False)] = rng.integers(1, most + 1, met)
        held = lm_score._narrow(counts)
        assert np.array_equal(lm_score._widened(held), counts) and len(held) <= 4 * lm_score.CHUNK + 1


def test_quality(docs, empty, spark, rows):
    labels = spark.createDataFrame([(r[0], 0 if "!!" in (r[1] or "") else 1) for r in rows if r[0] is not None and r[0] < 200] + [(None, 1), (0, None), (777, 0)], "id long, y int")
    stats = quality.document_statistics(docs)
    model = quality.train(stats, labels)
    got = quality.score(stats, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    shouted = {r[0] for r in rows if r[1] and "!!" in r[1]}
    assert np.mean([r.predicted == (r.id not in shouted) for r in got if r.id is not None and r.id < 200]) > 0.95
    x = np.random.default_rng(1).normal(size=(500, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = quality.fit(x, y)
    slow = [trees.base + sum(v[_leaf(f, t, row)] for f, t, v in zip(trees.feature, trees.threshold, trees.value)) for row in x[:50]]
    assert np.allclose(trees.predict(x[:50]), 1 / (1 + np.exp(-np.array(slow)))) and ((trees.predict(x) > 0.5) == y).mean() > 0.95
    assert quality.train(stats, labels.where("y = 1")).predict(np.zeros((2, 32)))[0] > 0.5
    assert quality.score(quality.document_statistics(empty), model).count() == 0


def _leaf(feature, threshold, row):
    at = 0
    while at < len(feature):
        at = 2 * at + 1 + (row[feature[at]] > threshold[at])
    return at - len(feature)


def test_order_minhash(docs, rows, empty):
    got = order_minhash.edit_sensitivity(docs).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is not None, r[0] or 0)
    order = sorted(rows, key=key)
    ids = [r[0] for r in order]
    by_id = {r.doc_id: r for r in got}
    for i, r in enumerate(order):
        if ids.count(r[0]) > 1 or i + 1 < len(order) and ids.count(ids[i + 1]) > 1:
            continue
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert by_id[r[0]].edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
    long = [r for r in got if r.n_chars > 300 and r.doc_id not in (5000, 204)]
    assert np.mean([r.near_edited for r in long]) > 0.25 > 0.1 > np.mean([r.near_next for r in long])
    texts = {r[0]: r[1] for r in rows}
    prints = {}
    for r in got:
        assert prints.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint or not words_of(texts[r.doc_id])
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert order_minhash.edit_sensitivity(empty).count() == 0
    assert {r.fingerprint for r in order_minhash.fingerprint_documents(docs).where("doc_id in (200, 201, 202)").collect()} == {"0" * 256}


def slow_print(text):
    ws = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_order_minhash_of_short_texts(spark):
    """Swapped halves show in short texts too, and unlike ones are not overstated."""
    rng = random.Random(12)
    rows, likes = [], {}
    for n in (10, 30, 60, 300):
        for i in range(60):
            ws = [f"{rng.randrange(10**6)}" for _ in range(n)]
            rows += [(f"{n}", i, "own", " ".join(ws)), (f"{n}", i, "swapped", " ".join(ws[n // 2 :] + ws[: n // 2])), (f"{n}", i, "half", " ".join(ws[: n // 2] + [f"x{w}" for w in ws[: n // 2]]))]
    rows += [("0", 0, "own", "one two"), ("0", 0, "swapped", "one two"), ("0", 0, "half", "")]
    told = order_minhash.signatures(spark.createDataFrame(rows, "n string, i int, side string, text string"), ["n", "i", "side"])
    wide = told.groupBy("n", "i").pivot("side", ["own", "swapped", "half"]).agg({"signature": "first"})
    for r in wide.select("n", order_minhash.likeness("own", "swapped").alias("s"), order_minhash.likeness("own", "half").alias("h")).collect():
        likes.setdefault(r.n, []).append((r.s, r.h))
    assert likes.pop("0") == [(1, 0)]
    for n, found in likes.items():
        swapped, half = np.mean(np.square(found), axis=0)
        assert 0.2 < swapped < 0.75, n  # most k-mers are the same, about half of the pairs are in another order
        assert half < 0.2, n  # about the square of a third


def test_near_duplicates(docs, rows, empty):
    got = covering.near_duplicates(docs).collect()
    prints = [(r[0], slow_print(r[1])) for r in rows]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{f:016x}") for i, f in prints)
    comp = {f: f for _, f in prints}
    for _ in comp:
        for a in comp:
            for b in comp:
                if (a ^ b).bit_count() <= 4:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    least: dict = {}
    for i, f in prints:
        least[comp[f]] = min((x for x in (least.get(comp[f]), i) if x is not None), default=None)
    want = {(i, f"{f:016x}", least[comp[f]]) for i, f in prints}
    assert {tuple(r) for r in got} == want
    assert covering.near_duplicates(empty).count() == 0


def test_covering_masks_meet_every_pair():
    rng = random.Random(1)
    masks = covering.masks(4).tolist()
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(bits & m == 0 for m in masks)
    x = np.unique(np.random.default_rng(2).integers(0, 1 << 12, 2000).astype(np.uint64) << np.uint64(20))
    small = covering._grow(x, 1)
    covering.LARGE, kept = 50, covering.LARGE
    try:
        assert np.array_equal(covering.roots(x, 1), small)
    finally:
        covering.LARGE = kept


def test_tables_are_released(spark):
    from gridlark.llm import common

    common.release(spark)
    kept = common.materialize(spark.range(5), "five")
    (path,) = [f.split("/part-")[0].removeprefix("file:") for f in kept.inputFiles()[:1]]
    path = "/" + path.lstrip("/")
    assert kept.count() == 5 and os.path.isdir(path)
    assert common.release(spark) == 1 and not os.path.exists(path) and common.release(spark) == 0


def test_large_buckets_are_divided(spark):
    """Values that share most masks: links are the same however small the buckets are."""
    rng = random.Random(5)
    values = sorted({0xABCDEF << 30 ^ sum(1 << rng.randrange(14) for _ in range(rng.randint(0, 9))) for _ in range(400)})
    want, left = set(), set(values)
    while left:
        group = front = {left.pop()}
        while front:
            front = {y for y in left if any((x ^ y).bit_count() <= 4 for x in front)}
            group, left = group | front, left - front
        want.add(frozenset(group))
    prints = spark.createDataFrame([(x,) for x in values], "f long")

    def components(large):
        found = connected_components(covering.fingerprint_links(prints, large=large)).collect()
        groups = {x: x for x in values} | {r.node: r.root for r in found}
        return {frozenset(x for x in values if groups[x] == g) for g in set(groups.values())}

    assert components(3) == components(10**6) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 100), (7, 7), (200, 199), (200, 199)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 95: 90, 100: 90, 200: 199}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(docs, rows, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    got = packing.pack_documents(docs, path, P.PATTERN).collect()
    full = Tokenizer.from_file(path)
    texts = [r[1] or "" for r in rows if r[0] != rows[5][0]]
    ids = {r[0]: np.array([*full.encode(t, add_special_tokens=False).ids, 0], "<u4") for r, t in zip([r for r in rows if r[0] != rows[5][0]], texts)}
    sequences: dict = {}
    pieces: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        if r.doc_id in ids:
            part = ids[r.doc_id][r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for parts in (*sequences.values(), *(v for k, v in pieces.items() if k in ids)):
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
    for k, v in pieces.items():
        if k in ids:
            assert sum(n for _, n in v) == len(ids[k])
    for parts in sequences.values():
        n = sum(x for _, x in parts)
        assert n <= 1024 and (n == 1024 or n & (n - 1) == 0)
    assert packing.pack_documents(empty, path, P.PATTERN).count() == 0


def test_special_strings_are_the_librarys():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endoftext", "plain text"]
    full = Tokenizer.from_file(path)
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.Tokenizer(path, P.PATTERN).encode(texts)]
    assert got == [full.encode(t, add_special_tokens=False).ids for t in texts] and got[0] == [64, 220, 50256, 275]


def test_sum_of_squares_choice():
    p = packing.Packer(packing.PackingParams(window=10), 0)
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 9)
        counts = p.count.copy()
        options = [0] + [h for h in range(1, 10) if counts[h] and h + n <= 10]

        def after(h):
            c = counts.copy()
            if h:
                c[h] -= 1
            if h + n < 10:
                c[h + n] += 1
            return (c[:10].astype(int) ** 2).sum()

        assert after(p.level(n)) == min(map(after, options))
        list(p.place(("d", n), bytes(4 * n)))


def test_flac(docs, rows, empty):
    streams = flac.media(docs)
    got = {r.doc_id: r for r in flac.digests(streams).collect()}
    for r in rows:
        p = flac.payload_of((r[1] or "").encode())
        g = got[r[0]]
        assert len(p) % 64 == 0 and g.payload_bytes == len(p) and g.payload_sha256 == hashlib.sha256(p).hexdigest() and g.tail_crc32 == zlib.crc32(p[-64:])
    blocks = flac.pcm_blocks(streams.where("doc_id = 5000")).orderBy("sample_offset").collect()
    assert [b.sample_offset for b in blocks] == list(range(0, 30_016, 4096)) and sum(b.n_samples for b in blocks) == 30_016
    assert flac.digests(flac.media(empty)).count() == 0


def test_flac_odd_samples_and_damage():
    rng = np.random.default_rng(0)
    ps = [bytes(64), bytes(range(256)) * 33, b"\xff\x00" * 320, rng.integers(0, 256, 64 * 201, dtype=np.uint8).tobytes(), (np.sin(np.arange(64 * 90) / 9) * 100 + 128).astype(np.uint8).tobytes()]
    streams = flac.encode(ps)
    for p, blocks in zip(ps, flac.read_streams(streams)):
        assert (np.concatenate([x for _, x in blocks]) + 128).astype(np.uint8).tobytes() == p
    assert len(streams[4]) < 0.5 * len(ps[4])
    assert (flac.read_samples(streams[3], 5000, 100) + 128).astype(np.uint8).tobytes() == ps[3][5000:5100]
    assert flac.crc16_lanes(np.frombuffer(b"123456789x", np.uint8), np.array([0, 0]), np.array([9, 8]))[0] == 0xFEE8
    for at in (-1, -50, -len(streams[1]) + 150):
        bad = bytearray(streams[1])
        bad[at] ^= 4
        with pytest.raises((flac.CorruptStream, IndexError)):
            flac.read_streams([bytes(bad)])


def test_token_counts(docs, rows, empty, spark):
    import public_tokenizers as P
    from sentencepiece import SentencePieceProcessor

    path = P.path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    log_sum = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    score, longest = {p: -math.log(r + 1) - log_sum for r, p in enumerate(pieces)}, max(map(len, pieces))

    def slow(word):
        best = [(0.0, 0)]
        w = token_counts.MARK + word
        for end in range(1, len(w) + 1):
            width = len(w[end - 1].encode())
            best.append(max([(best[end - 1][0] - 16.0 * width, best[end - 1][1] - width)] + [(best[a][0] + score[w[a:end]], best[a][1] - 1) for a in range(max(0, end - longest), end) if w[a:end] in score]))
        return -best[-1][1]

    memo: dict = {}
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, path).collect()}
    for r in rows:
        ws = words_of(r[1])
        assert got[r[0]].n_words == len(ws) and got[r[0]].n_tokens == sum(memo.setdefault(w, slow(w)) if w not in memo else memo[w] for w in ws)
    # parts, long words and forgotten counts change nothing
    words = sorted({w for r in rows for w in words_of(r[1])}, key=lambda w: w.encode())
    for params in (token_counts.UnigramParams(part=7, long=3, kept=5), token_counts.UnigramParams(long=10**9)):
        shared = token_counts.SharedCounts(token_counts.Vocabulary(path, params))
        for _ in range(2):
            assert shared.count([[w.encode() for w in words[:50]], [], [w.encode() for w in words[50:]]]) == [[memo[w] for w in words[:50]], [], [memo[w] for w in words[50:]]]
    assert token_counts.count_tokens(empty, path).count() == 0
    long = spark.createDataFrame([(1, "ab" * 600_000), (2, "the " * 400_000)], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_tokens > 0) for r in token_counts.count_tokens(long, path).collect()} == {1: (1, True), 2: (400_000, True)}


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs, params=mixing.MixParams(shard=2000)).collect()
    assert len(got) == len(rows)
    size: dict = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(words_of(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full, target = 1.5 * sum(size.values()), set(), {}
    while True:
        rest, w = total - sum(2 * size[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: 2 * size[s] if s in full else rest * weight[s] / w for s in names}
        more = {s for s in names if s not in full and target[s] > 2 * size[s]}
        if not more:
            break
        full |= more
    taken: dict = {}
    for g in got:
        assert 0 <= g.taken <= 2 * g.size and g.source_size == size[g.source] and g.target == pytest.approx(target[g.source])
        taken[g.source] = taken.get(g.source, 0) + g.taken
    assert all(abs(taken[s] - target[s]) <= 3 * 16 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, params=mixing.MixParams(shard=2000)).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.take(empty).count() == 0


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 101])
def test_sainte_lague(spark, seats):
    from pyspark.sql import functions as F

    votes = [53, 24, 23, 0, 10, 10, 1]
    df = spark.createDataFrame(list(enumerate(votes)), "p int, v int")
    got = {r.p: r.quota for r in mixing.apportion(df, "v", F.lit(seats), [], ["p"]).collect()}
    want = dict.fromkeys(range(len(votes)), 0)
    for _ in range(seats):
        best = max(want, key=lambda p: (votes[p] / (2 * want[p] + 1), -p))
        want[best] += 1
    assert got == want


def slow_repeats(texts, length):
    seen: dict = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        m = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                m[i : i + length] = True
        out.append(m[:-1])
    return out


@pytest.mark.parametrize("group", [1000, 1])
def test_repeats(docs, rows, empty, group):
    params = suffix_dedup.RepeatParams(group=group)
    some = [r for r in rows if r[0] != 5000]
    texts = [(r[1] or "").encode() for r in rows]
    masks = slow_repeats(texts, 400)
    got = sorted(map(tuple, suffix_dedup.repeat_report(docs, params=params).collect()), key=str)
    want = []
    for r, t, m in zip(rows, texts, masks):
        spans = int((np.diff(m.astype(int), prepend=0) == 1).sum())
        want.append((r[0], len(t), int(m.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest()))
    assert got == sorted(want, key=str) and any(w[2] for w in want) and len(some) < len(rows)
    kept = suffix_dedup.remove_repeats(docs, params=params)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert suffix_dedup.repeat_report(empty).count() == 0


def test_run_index_statistics():
    rng = random.Random(2)
    for _ in range(20):
        strings = ["".join(rng.choices("ab", k=rng.randint(1, 40))).encode() for _ in range(6)] + [b"abab" * 8]
        text = [(k, i) for k, s in enumerate(strings) for i in range(len(s))]

        def common(a, b):
            x, y = strings[a[0]][a[1] :], strings[b[0]][b[1] :]
            n = 0
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            return n

        want = [max(common(a, b) for b in text if b != a) for a in text]
        index = suffix_dedup.RunIndex(strings)
        assert index.statistics().tolist() == want and len(index.symbols) <= index.n


def test_language(docs, rows, empty):
    marked = docs.withColumn("learn", docs.doc_id % 2 == 0).na.fill({"learn": False})
    got = {r.doc_id: r for r in langid.identify(marked, "learn").collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (200, 201, 202))
    right = [got[r[0]].lang_pred == r[2] for r in rows if r[0] is not None and r[0] < 200 and r[0] % 2]
    assert np.mean(right) > 0.9 and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(empty.withColumn("learn", empty.doc_id == 1), "learn").count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("learn", docs.doc_id == -1), "learn").collect()} == {"und"}


def test_language_of_letterless_runs():
    """Superscripts, fractions and circled numbers make no language, however many."""
    for n in (49, 50, 500):
        assert langid.words_of(" ".join(["\u00b2", "\u00bd", "\u2460"][i % 3] for i in range(n))) == []
        assert len(langid.words_of("\u00b2 " * n + "a")) == n + 1


def test_forward_backward():
    rng = np.random.default_rng(4)
    chain = langid.Chain(["a", "b", "c"], np.zeros((4, 3), np.float32), rng.normal(size=(3, 3)), langid.ChainParams())
    scores = rng.normal(size=(7, 3))
    p, pairs = chain.marginals(scores, np.array([4, 3]), pairs=True)
    import itertools

    want = np.zeros((4, 3))
    moves = np.zeros((3, 3))
    z = 0
    for path in itertools.product(range(3), repeat=4):
        w = np.exp(sum(scores[i, y] for i, y in enumerate(path)) + sum(chain.moves[a, b] for a, b in zip(path, path[1:])))
        z += w
        for i, y in enumerate(path):
            want[i, y] += w
        for a, b in zip(path, path[1:]):
            moves[a, b] += w
    assert np.allclose(p[:4], want / z)
    _, first = chain.marginals(scores[:4], np.array([4]), pairs=True)
    assert np.allclose(first, moves / z)


def test_repeats_in_a_text_over_the_block_size(spark):
    rng = np.random.default_rng(8)
    raw = bytearray(rng.integers(97, 123, (1 << 21) + 5000, dtype=np.uint8).tobytes())
    raw[(1 << 20) - 300 : (1 << 20) + 500] = raw[100:900]  # across the edge of two blocks
    raw[-450:] = raw[5000:5450]
    raw[2000:2399], raw[9000:9399] = raw[40_000:40_399], raw[40_000:40_399]  # too short by one
    text = bytes(raw).decode()
    got = suffix_dedup.repeat_report(spark.createDataFrame([(1, text), (2, text[700_000:700_600])], "doc_id long, text string")).collect()
    seen: dict = {}
    for t in (text, text[700_000:700_600]):
        for i in range(len(t) - 399):
            seen[hash(t[i : i + 400])] = seen.get(hash(t[i : i + 400]), 0) + 1
    for r, t in zip(sorted(got), (text, text[700_000:700_600])):
        m = np.zeros(len(t) + 1, np.int32)
        for i in range(len(t) - 399):
            if seen[hash(t[i : i + 400])] > 1:
                m[i : i + 1] += 1
                m[min(i + 400, len(t))] -= 1
        gone = np.cumsum(m)[:-1] > 0
        assert (r.n_removed, r.n_spans) == (int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()))
        assert r.kept_sha256 == hashlib.sha256(np.frombuffer(t.encode(), np.uint8)[~gone].tobytes()).hexdigest()
    assert sum(r.n_removed for r in got) >= 800 * 2 + 450 * 2 + 600 * 2


CLASH = ("id", "block", "place", "digest", "uid", "rest", "learned", "h", "n", "f", "v", "k", "seg", "anchor", "shard", "size", "__key", "__text", "__marks", "__words", "__row", "__size", "__epochs", "__f", "__k")


def test_clashing_names_and_nulls(spark):
    """Every operator gives the same rows with other columns beside its own, whatever these are called, and lets them be."""
    import public_tokenizers as P

    text = " ".join(f"word{i % 97}" for i in range(160))
    rows = [(1, text, "en", "s"), (2, "x " + text, "en", None), (2, "short", None, "s"), (None, None, None, None), (3, "", "fr", "t"), (4, "le chat et la souris " * 20, "fr", "t"), (5, "the cat and the mouse " * 20, "en", "s")]
    names = "doc_id long, text string, lang string, source string"
    plain = spark.createDataFrame(rows, names).selectExpr("*", "coalesce(doc_id % 2 = 0, false) AS learn")
    full = spark.createDataFrame([(*r, *range(len(CLASH))) for r in rows], names + "".join(f", {c} int" for c in CLASH)).selectExpr("*", "coalesce(doc_id % 2 = 0, false) AS learn")
    operators = [
        lambda d: lm_score.score_documents(d, "learn"), lambda d: order_minhash.edit_sensitivity(d), lambda d: order_minhash.fingerprint_documents(d), lambda d: covering.near_duplicates(d),
        lambda d: packing.pack_documents(d, P.path("byte_bpe_50k.json"), P.PATTERN).select("doc_id", "start", "length", "ids_crc32"), lambda d: flac.digests(flac.media(d)),
        lambda d: token_counts.count_tokens(d, P.path("piece_bpe_32k.model")), lambda d: mixing.mix(d).select("doc_id", "size", "target", "taken"), lambda d: suffix_dedup.repeat_report(d), lambda d: langid.identify(d, "learn"),
    ]
    for f in operators:
        assert sorted(map(str, f(plain).collect())) == sorted(map(str, f(full).collect()))
    for f in (suffix_dedup.remove_repeats, suffix_dedup.remove_passages, mixing.take):
        got = f(full)
        assert got.columns == full.columns and all(tuple(r[c] for c in CLASH) == tuple(range(len(CLASH))) for r in got.collect())
        assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, f(plain).collect()))
