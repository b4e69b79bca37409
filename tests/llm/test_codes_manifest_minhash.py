"""Vector codes, the Merkle manifest and MinHash near-duplicates against brute force, and odd inputs."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basaltry.llm import common, components, merkle, minhash, queries, vector_codes

# -- vector codes ------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, v int, code string, error int"


def _nearest(x, book):
    d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("dense", [0.0, 0.05, 1.1])
@pytest.mark.parametrize("width", [1, 3, 16, 30])
def test_nearest_entry_is_exact_and_bounds_prune(monkeypatch, dense, width):
    monkeypatch.setattr(vector_codes, "DENSE", dense)  # by products alone, both, pair by pair alone
    rng = np.random.default_rng(width)
    centres = rng.standard_normal((40, width))[rng.integers(0, 40, 1500)] * 300
    for x in (centres + rng.standard_normal((1500, width)) * 4, rng.standard_normal((1500, width)) * 300, rng.integers(0, 2, (1500, width)), centres * 2.0**16):
        x = np.clip(np.floor(x), -vector_codes.MOST, vector_codes.MOST).astype(np.int64)
        book, looked = x[rng.integers(0, len(x), 100)], []  # with entries that are equal: ties
        got, want = vector_codes.nearest(x, book, looked), _nearest(x, book)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
        assert sum(looked) <= x.shape[0] * len(book)
    looked = []
    x = np.floor(centres + rng.standard_normal((1500, width)) * 4).astype(np.int64)
    vector_codes.nearest(x, x[:100], looked)
    assert sum(looked) < 0.1 * 1500 * 100  # the bounds leave few


def test_bounds_are_lower_bounds():
    rng = np.random.default_rng(3)
    x, y = rng.integers(-500, 500, (200, 22)), rng.integers(-500, 500, (200, 22))
    far = ((x - y) ** 2).sum(axis=1)
    last = np.zeros(200)
    for n in vector_codes.segments(22):
        bound = ((vector_codes.profile(x, n) - vector_codes.profile(y, n)) ** 2).sum(axis=1)
        assert (bound <= far * (1 + 1e-9)).all() and bound.mean() > last.mean()
        last = bound


def _codes_by_brute_force(rows, entries=256, parts=4, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, [max(-vector_codes.MOST, min(vector_codes.MOST, x)) for x in v] + [0] * (width - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    x = np.array([v for _, v, _ in kept]).reshape(len(kept), parts, width // parts)
    books = np.array([v for _, v, _ in first]).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    for again in range(rounds + 1):
        found = [_nearest(x[:, p], books[p]) for p in range(parts)]
        if again < rounds:
            for p in range(parts):
                for e in range(len(first)):
                    mine = x[found[p][0] == e, p]
                    if len(mine):
                        books[p, e] = mine.sum(axis=0) // len(mine)
    error = sum(f[1] for f in found)
    by_label = {}
    for (_, _, label), e in zip(kept, error.tolist(), strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((i, "".join(f"{f[0][k]:02x}" for f in found), int(error[k]), by_label[label]) for k, (i, _, label) in enumerate(kept)), key=repr), books


def _vectors(n, seed):
    rng = np.random.default_rng(seed)
    return [(int(i), rng.standard_normal(10).round(2).tolist(), [None, 1, 2][int(rng.integers(0, 3))]) for i in rng.permutation(n)]


@pytest.mark.parametrize("entries", [8, 256])
def test_codes_equal_brute_force(spark, monkeypatch, entries):
    monkeypatch.setattr(common, "NAMES", 1)
    rows = _vectors(150, 1)
    rows += [(5, rows[0][1], 7), (5, [9.0] * 10, 7), (None, [1.0] * 10, None), (200, None, 1), (201, [1.0, None], 1), (202, [math.nan] * 10, 1), (203, [math.inf] * 10, 1)]
    rows += [(204, [], None), (205, [1.5, -2.25], 3), (206, [3e38] + [-3e38] * 9, 4), (3, rows[0][1], 7)]
    df = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], VECTORS).repartition(3)
    got, books = vector_codes.compress(df, entries=entries)
    want, want_books = _codes_by_brute_force(rows, entries)
    assert (books == want_books).all()
    assert sorted(map(tuple, got.collect()), key=repr) == want
    again = vector_codes.decode([r[1] for r in want], books)
    assert again.shape == (len(want), 12)
    assert vector_codes.fingerprint(books) == hashlib.sha256(",".join(str(int(x)) for x in want_books.ravel()).encode()).hexdigest()


def test_codes_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    rows, books = vector_codes.compress(none)
    assert rows.count() == 0 and books.shape[1] == 0 and vector_codes.fingerprint(books) == hashlib.sha256(b"").hexdigest()
    rows, books = vector_codes.compress(spark.createDataFrame([(1, [], None, 1, "", 1)], VECTORS))
    assert [tuple(r) for r in rows.collect()] == [(1, "00000000", 0, 0)]


# -- Merkle manifest ---------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree int, place string, leaf string, digest int"
ODD = [(1, None, "en", "a", 3), (2, "", None, "a", None), (3, "x" * 300_000, "en", None, 9), (4, "the cat", "", "b", 7), (4, "the cat", "", "b", 7), (4, "a cat", "", "b", 7), (None, "日本語", "é", "c", 1), (7, "z", "z", "c", -1)]


def _sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, text, lang, source, n_chars):
    return _sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def _tree(leaves, fanout):
    """Root, and for each leaf the digests beside its way up with their places in the run."""
    ways, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for way, i in zip(ways, at, strict=True):
            run = level[i - i % fanout : i - i % fanout + fanout]
            way.append((run[: i % fanout], run[i % fanout + 1 :]))
        level = [_sha(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return level[0], ways


def _report(rows, fanout=2):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = [], []
    for lang in langs:
        mine = sorted(((r[0] is not None, r[0] or 0, _leaf(*r), r) for r in rows if r[2] == lang), key=lambda t: t[:3])
        trees.append((mine, *_tree([leaf for _, _, leaf, _ in mine], fanout)))
    root, tops = _tree([subroot for _, subroot, _ in trees], fanout)
    for (mine, subroot, ways), top in zip(trees, tops, strict=True):
        for (_, _, leaf, r), way in zip(mine, ways, strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            now = _leaf(*r[:4], r[4] + 1) if tampered else leaf
            for left, right in way + top:
                now = _sha(*left, now, *right)
            proof = _sha(*[d for left, right in way + top for d in left + right])
            out.append((r[0], leaf, subroot, root, proof, now, now == root))
    return sorted(out, key=repr)


def _documents(n):
    rnd = random.Random(n)
    return [(i, f"text {rnd.random()}", rnd.choice(["en", "en", "en", "de", None, "fr"]), "s", rnd.randint(0, 99)) for i in range(n)]


@pytest.mark.parametrize(("n", "fanout", "levels"), [(0, 2, 10), (1, 2, 1), (65, 2, 2), (300, 2, 3), (200, 3, 2), (40, 5, 1)])
def test_manifest_by_brute_force(spark, n, fanout, levels):
    rows = ODD + _documents(n)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "clash", "clash", 2) for r in rows], DOCS).repartition(3)
    got = merkle.tamper_report(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, fanout=fanout, levels=levels)
    assert sorted(map(tuple, got.collect()), key=repr) == _report(rows, fanout)


def test_proofs_and_kept_columns(spark, monkeypatch):
    monkeypatch.setattr(common, "NAMES", 1)  # names and runs are joined, not broadcast
    rows = _documents(90)
    df = spark.createDataFrame([(*r, 1, "clash", "clash", 2) for r in rows], DOCS).repartition(4)
    made = merkle.manifest(df, keep=("digest", "n_chars"), levels=2).collect()
    assert len(made) == 90 and {r.digest for r in made} == {2}
    for r in made:
        path = [(r.place, r.nodes), (r.tree, r.trees)]
        assert merkle.fold(r.leaf, r.proof, path) == r.root
        assert merkle.fold(_sha("other"), r.proof, path) != r.root
    for t in {r.tree for r in made}:
        mine = [r for r in made if r.tree == t]
        assert sorted(r.place for r in mine) == list(range(len(mine))) and {r.nodes for r in mine} == {len(mine)}
    with pytest.raises(ValueError, match="root"):
        merkle.manifest(df.withColumn("root", F.lit(1)), keep=("root",))


def test_manifest_of_nothing(spark):
    assert merkle.tamper_report(spark.createDataFrame([], DOCS), F.lit(True)).count() == 0


def test_manifest_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(*r, 1, "", "", 2) for r in _documents(120)], DOCS)
    roots = {r.root for k in (1, 7) for r in merkle.manifest(df.repartition(k)).select("root").distinct().collect()}
    assert len(roots) == 1


# -- MinHash -----------------------------------------------------------------------------------------------

TEXTS = "doc_id long, text string, key int, n int, words int, component_id long"


def _brute(rows, percent=85, shingle=3):
    def of(text):
        words = (text or "").encode().lower().split()
        return frozenset(tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else frozenset()

    sets = [of(t) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and part[i] != part[j]:
                a, b = part[i], part[j]
                part = [b if p == a else p for p in part]
    out = []
    for (doc_id, _), s, p in zip(rows, sets, part, strict=True):
        ids = [rows[k][0] for k in range(len(rows)) if part[k] == p and rows[k][0] is not None] if s else [doc_id]
        low = min(ids, default=None)
        out.append((doc_id, len(s), low, doc_id == low))
    return sorted(out, key=repr)


def _check(spark, texts, **how):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in texts], TEXTS).repartition(3)
    assert sorted(map(tuple, minhash.near_duplicates(df, **how).collect()), key=repr) == _brute(texts, how.get("percent", 85), how.get("shingle", 3))


def _planted(groups, seed, words=90):
    """Groups of texts with a few words changed, around the threshold, exact copies, chains, and others."""
    rnd, rows = random.Random(seed), []
    for _ in range(groups):
        text = [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(words // 2, words))]
        for _ in range(rnd.randint(1, 7)):
            rows.append(" ".join(text))
            if rnd.random() < 0.2:
                rows.append(" ".join(text).upper())
            text = list(text)
            for _ in range(rnd.choice([1, 1, 2, 3])):
                text[rnd.randrange(len(text))] = f"v{rnd.randint(0, 10**6)}"
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "the cat sat on"), (4, "the cat sat on"), (5, "The CAT  sat\non"), (6, "word other thing " * 30_000), (None, "the cat sat on"), (8, "a"), (9, "A"), (10, "a b"), (11, "a  b"), (12, "Ä b c"), (13, "ä b c"), (None, "alone in here")]
    rows += [(4, "another text with this id here"), (14, "another text with this id here")]
    _check(spark, rows)
    assert minhash.near_duplicates(spark.createDataFrame([], TEXTS)).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_by_brute_force(spark, monkeypatch, small):
    if small:  # every block is dealt over tiles, and names are joined
        monkeypatch.setattr(minhash, "TILE", 3)
        monkeypatch.setattr(minhash, "TILE_BYTES", 4000)
        monkeypatch.setattr(common, "NAMES", 1)
        monkeypatch.setattr(components, "NAMES", 1)
    _check(spark, _planted(40, 5))


def test_rows_that_come_again_among_near_copies(spark):
    rows = _planted(6, 9)
    _check(spark, rows + rows[::3] + [(None, text) for _, text in rows[::2]] * 2)


def test_bands_move_once_and_texts_of_near_copies_instead_of_their_sets(spark, monkeypatch):
    made, write = {}, minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name: made.setdefault(name, write(df, name)))
    docs = spark.createDataFrame(_planted(6, 9), "doc_id long, text string")
    assert minhash.near_duplicates(docs).where("not kept").count()
    assert not any("members" in df.columns for df in made.values())  # 8 bytes for each word
    assert "minhash-groups" not in made  # for which all bands were shuffled twice
    plan = minhash.candidate_blocks(made["minhash-classes"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [h#") == 1 and "Join" not in plan


def test_near_duplicates_of_the_small_table(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=repr) == _brute(rows)


def test_other_shingles_and_similarity(spark):
    _check(spark, _planted(12, 8), percent=60, shingle=2, bands=60, rows=3)


def test_spanning_links_join_what_pairs_join_and_no_more():
    rnd = random.Random(2)
    base = list(range(400))
    sets = []
    for _ in range(120):  # pairs on both sides of the threshold, more than 32 candidates for each
        own = [x if rnd.random() > 0.06 else 10**6 + rnd.randint(0, 10**9) for x in base[: rnd.randint(330, 400)]]
        sets.append(np.unique(np.array(own, dtype=np.uint64)))
    sigs = np.zeros((len(sets), 4), dtype="<u2")
    links = minhash.spanning_links(sets, sigs, 85, 0)
    like = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    part = list(range(len(sets)))

    def join(i, j):
        a, b = part[i], part[j]
        part[:] = [b if p == a else p for p in part]

    for i, j in links:
        assert like(sets[i], sets[j])
        join(i, j)
    assert len(links) == len(sets) - len(set(part))
    assert all(part[i] == part[j] for i in range(len(sets)) for j in range(i) if like(sets[i], sets[j]))
    assert len(set(part)) > 1 or len(links) == len(sets) - 1


def test_minima_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(0)
    functions = minhash.family(2000)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    same = (minhash.signature(a, *functions) == minhash.signature(b, *functions)).mean()
    assert abs(same - 800 / 1200) < 0.05
    assert minhash.least_agreement(180, 85) < 0.72 * 180 and minhash.least_agreement(180, 100) == 180
    mask = minhash.partners(np.array([1000, 1000, 10]), np.array([[1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 3, 4]], dtype="<u2"), 85, 3)
    assert mask.tolist() == [True, True, False]
    assert (1 - 0.85**minhash.ROWS) ** minhash.BANDS < 1e-9
