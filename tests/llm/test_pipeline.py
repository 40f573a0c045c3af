"""The pipeline's stages against brute force on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages(spark):
    import corpus_pipeline as c
    from gridlark.llm import covering
    from gridlark.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    out = {}
    for name, stage in c.STAGES[:-1]:
        docs = out[name] = materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == names
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    kept = {r.doc_id for r in out["quality"].collect()}
    assert len(kept & good) >= 0.97 * len(good) and len(kept & bad) <= 0.1 * len(bad)
    near = out["near_duplicates"].collect()
    prints = [covering.fingerprint(r.text.encode()) for r in near]
    assert not [1 for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 4] and {r.doc_id for r in near} <= kept
    texts = [r.text.encode() for r in near]
    seen: dict = {}
    for t in texts:
        for i in range(len(t) - 399):
            seen[t[i : i + 400]] = seen.get(t[i : i + 400], 0) + 1
    passages: dict = {}
    for t in texts:
        ws = t.split()
        for i in range(len(ws) - 50):
            passages[tuple(ws[i : i + 51])] = passages.get(tuple(ws[i : i + 51]), 0) + 1
    cut = {r.doc_id: r.text for r in out["repeats"].collect()}
    for r, t in zip(near, texts):
        ws = t.split()
        dup = any(seen[t[i : i + 400]] > 1 for i in range(len(t) - 399)) or any(passages[tuple(ws[i : i + 51])] > 1 for i in range(len(ws) - 50))
        assert (cut[r.doc_id] == before[r.doc_id]) == (not dup)
    mixed = out["mix"].collect()
    assert all(cut[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in mixed)
    total = sum(len(t.split()) for t in cut.values())
    assert sum(len(r.text.split()) for r in mixed) == pytest.approx(1.5 * total, rel=0.02)
    packed = c.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in mixed}


def test_near_duplicates_from_four_fifths(spark):
    """Planted pairs at 0.8 to 0.95 lose one text; pairs just below keep both; the brute force decides which is which."""
    import random

    import corpus_pipeline as c

    rng = random.Random(5)
    grams = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    rows, want, kinds = [], 0, [0, 0]
    for i in range(120):
        a = [str(rng.randrange(10**6)) for _ in range(rng.randint(80, 400))]
        b = list(a)
        for at in rng.sample(range(len(a)), rng.randint(1, max(1, len(a) // 32))):
            b[at] = "edited"
        x, y = grams(a), grams(b)
        near = len(x & y) / len(x | y) >= 0.8
        kinds[near] += 1
        want += 1 if near else 2
        rows += [(2 * i, " ".join(a), "en", "s", 1), (2 * i + 1, " ".join(b), "en", "s", 1)]
    assert kinds[0] > 10 and kinds[1] > 40
    rows += [(None, rows[0][1], "en", "s", 1), (1000, None, "en", "s", 1), (1001, " ", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = c.near_duplicate_filter(spark, docs, SF).collect()
    assert len(got) == want + 1 and len({r.doc_id for r in got}) == len(got) and None not in {r.doc_id for r in got}
    assert c.near_duplicate_filter(spark, docs.limit(0), SF).count() == 0


def test_near_duplicates_by_the_covering_operator(spark):
    """Without help from bands every similar pair that op4 links is found, and an exact check follows."""
    import random

    from gridlark.llm import covering, shingles

    rng = random.Random(8)
    texts = []
    for _ in range(20):
        a = [str(rng.randrange(10**6)) for _ in range(600)]
        b = list(a)
        b[rng.randrange(600)] = "edited"
        texts += [" ".join(a), " ".join(b)]
    line = " ".join(str(rng.randrange(10**6)) for _ in range(13))
    texts += [" ".join([line] * 90 + [str(rng.randrange(10**6)) for _ in range(20)]) for _ in range(2)]
    prints = [covering.fingerprint(t.encode()) for t in texts]
    near = [i for i in range(0, len(texts), 2) if (prints[i] ^ prints[i + 1]).bit_count() <= 4]
    assert len(near) > 10 and near[-1] == 40  # the last pair is within 4 bits, its sets are not similar
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r.k: r.root for r in shingles.classes(rows, shingles.ShingleParams(bands=1, rows=2000)).collect()}
    assert all(got.get(i + 1) == i for i in near[:-1]) and got.get(41, 41) == 41


def test_shingle_components_are_exact():
    import numpy as np
    from gridlark.llm import shingles

    rng = np.random.default_rng(2)
    base = [rng.choice(10**6, 60, replace=False).astype(np.uint64) for _ in range(8)]
    sets = []
    for i in range(150):
        s = base[i % 8].copy()
        s[: i % 12] = rng.integers(10**6, 10**7, i % 12)
        sets.append(np.unique(s[rng.integers(0, 2) :]))
    root = np.arange(len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8:
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    assert np.array_equal(shingles.similar(sets, 0.8), root)


def test_covering_passes_words_on(spark):
    from gridlark.llm import covering

    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [int(covering.near_duplicates(docs, words=n).first().fingerprint, 16) for n in (4, 5)] == [covering.fingerprint(text.encode(), n) for n in (4, 5)]


def test_passages_of_over_fifty_words(spark):
    """A passage of 51 short words goes from every document, one of 50 stays, and so does what stands around them."""
    import random

    import corpus_pipeline as c

    rng = random.Random(9)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    short = lambda n: [rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(n)]
    cut, kept = short(51), short(50)
    rows, want = [], {}
    for i in range(12):
        a, b = own(rng.randint(0, 90)), own(rng.randint(1, 90))
        passage = [cut, kept, short(60)][i % 3]
        rows.append((i, (" ", "\n")[i % 2].join([*a, *passage, *b]), "en", "s", 1))
        want[i] = a + b if i % 3 == 0 else [*a, *passage, *b]
    rows += [(50, None, "en", "s", 1), (51, "", "en", "s", 1), (None, "no id", "en", "s", 1), (52, "\u00e9" * 300, "fr", "s", 1), (53, "x" + "\u00e9" * 300, "fr", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in c.repeat_filter(spark, docs, SF).collect()}
    assert len(got) == len(rows) and got[50] is None and got[51] == "" and got[None] == "no id"
    assert {i: got[i].split() for i in want} == want
    assert not got[52] and got[53] in ("x", "x\u00e9")  # bytes that repeat go as before
    assert c.repeat_filter(spark, docs.limit(0), SF).count() == 0


def test_stages_on_odd_rows(spark):
    """Nulls everywhere, equal rows, equal ids, columns with clashing names and empty tables go through every stage."""
    import corpus_pipeline as c
    from gridlark.llm.common import materialize

    schema = "doc_id long, text string, lang string, source string, n_chars long, k string, __k long, r long, key string, __marks int, root long"
    extra = ("k", 1, 2, "key", 3, 4)
    words = " ".join(f"word{i}" for i in range(120))
    rows = [(1, words, "en", "s", 5), (1, words, "en", "s", 5), (1, "another text of its own", None, None, None), (None, words, "en", None, 1), (None, None, None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, words + " and more", "en", "t", 9), (5, " ", None, "t", None)]
    docs = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    for name, stage in c.STAGES[1:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == c.COLUMNS, name
        n = len(got.collect())
        assert n == (3 if name == "near_duplicates" else n if name == "mix" else len(rows)), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = sorted(map(tuple, c.near_duplicate_filter(spark, docs, SF).collect()), key=str)
    assert [r[:2] for r in kept] == [(1, "another text of its own"), (1, words), (2, None)]
    assert c.pack(spark, docs, SF).count() > 0 and c.pack(spark, docs.limit(0), SF).count() == 0
    assert c.quality_filter(spark, materialize(docs, "odd"), SF).columns == c.COLUMNS
