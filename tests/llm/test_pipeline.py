"""The corpus pipeline: every stage against brute force, on odd rows and whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from basaltry.llm import similar
from basaltry.llm.common import id_hash_mod
from basaltry.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, root long"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1) for i, t in rows], COLUMNS).repartition(3)


def bag(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_force(rows):
    """Sorted (doc_id, text) that stay."""
    prints, bags = [fingerprint((t or "").encode(), 5) for _, t in rows], [bag(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(bags[i] & bags[j])
            if (prints[i] ^ prints[j]).bit_count() <= 2 or bags[i] and 5 * both >= 4 * (len(bags[i]) + len(bags[j]) - both):
                up[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i])
    smallest = {}
    for g, members in groups.items():
        low = min((i is None, i or 0) for i, _ in members)
        smallest[g] = {m for m in members if (m[0] is None, m[0] or 0) == low}
    return list(smallest.values())


def check(spark, rows):
    got = [(r.doc_id, r.text) for r in p.near_dedup(spark, rows_of(spark, rows), "").collect()]
    want = brute_force(rows)
    assert len(got) == len(want)
    assert all(sum(g in w for g in got) == 1 for w in want)
    return {i for i, _ in got}


def planted(n, seed):
    """A base text and n copies of it, each with some of its words changed: pairs of all similarities."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(120)]
    out = [" ".join(base)]
    for _ in range(n):
        words = list(base)
        for k in rnd.sample(range(len(words)), rnd.choice([1, 2, 3, 4, 6])):
            words[k] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("tile", "hot"), [(32 << 20, 1 << 16), (4000, 2)])
def test_near_dedup_joins_what_brute_force_joins(spark, monkeypatch, tile, hot):
    monkeypatch.setattr(similar, "TILE", tile)  # small: blocks are dealt as pairs of tiles
    monkeypatch.setattr(similar, "HOT", hot)  # small: members of several texts are grouped by their smallest keys
    monkeypatch.setattr(similar, "CHUNK", 2000)
    texts = [t for seed in range(4) for t in planted(30, seed)]
    random.Random(5).shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_near_dedup_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    left = check(spark, [tuple(r) for r in docs])
    assert 177 not in left and 145 not in left


def test_near_dedup_judges_rows_by_id_and_text(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "red green blue white black grey"
    assert check(spark, [(5, a), (5, a), (7, b), (7, c)]) == {5, 7}
    assert check(spark, [(3, a), (7, a), (7, c)]) == {3, 7}
    odd = [(1, None), (2, ""), (3, " \t"), (4, a), (4, a), (4, a.upper()), (None, a), (None, b), (None, b), (8, "a"), (9, "A"), (10, "long text " * 30_000)]
    check(spark, odd)
    assert p.near_dedup(spark, rows_of(spark, odd).limit(0), "").count() == 0
    assert p.near_dedup(spark, rows_of(spark, odd), "").columns == rows_of(spark, odd).columns


def test_groups_over_batches():
    import pyarrow as pa

    rows = [(1, 5), (2, 3), (2, 3), (2, 4), (2, 9), (3, 7), (3, 7), (4, 1), (4, 2)]
    want = {(3, 3), (3, 4), (3, 9), (1, 1), (1, 2)}
    for cut in range(len(rows) + 1):
        parts = [pa.RecordBatch.from_arrays([pa.array([h for h, _ in p], pa.int64()), pa.array([k for _, k in p], pa.int64())], names=["h", "key"]) for p in (rows[:cut], rows[cut:])]
        assert {(r["block"], r["key"]) for b in similar.groups(iter(parts)) for r in b.to_pylist()} == want


def test_block_links_are_spanning_and_few():
    sets = [similar.shingles(t.encode()) for t in planted(80, 9)]
    links = similar.block_links(sets)
    part = np.arange(len(sets))
    for i, j in links:
        assert similar.similar(sets[i], sets[j])
        part[part == part[i]] = part[j]
    for i in range(len(sets)):
        for j in range(i):
            assert not similar.similar(sets[i], sets[j]) or part[i] == part[j]
    assert len(links) < len(sets)


def test_common_members_change_cost_alone():
    sets = [similar.shingles(t.encode()) for t in planted(20, 3)]
    every, often = np.unique(np.concatenate(sets), return_counts=True)
    nothing = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for order in (nothing, (every, often)):
        heads = [set(similar.prefix(s, *order).tolist()) for s in sets]
        for i in range(len(sets)):
            for j in range(i):
                assert not similar.similar(sets[i], sets[j]) or heads[i] & heads[j]


def test_language_stage_drops_texts_without_letters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_000, None, "en", "s", 0), (10_001, "12 !! 34", "en", "s", 0), (None, "the and of", None, None, None)], docs.schema)
    every = docs.unionByName(extra).withColumn("score", F.lit(1)).withColumn("words", F.lit("clash"))
    kept = p.language_id(spark, every, SF)
    ids = [r[0] for r in kept.select("doc_id").collect()]
    lettered = {r.doc_id for r in docs.collect() if r.text and any(map(str.isalpha, r.text))}
    assert kept.columns == every.columns and set(ids) - {None} == lettered and ids.count(None) == 1
    assert p.language_id(spark, every.limit(0), SF).count() == 0
    assert p.language_id(spark, every.withColumn("lang", F.lit(None).cast("string")), SF).count() == every.count()


def test_quality_stage_keeps_what_the_vote_keeps(spark):
    from basaltry.llm import quality as vote

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    extra = spark.createDataFrame([(10_000, None, "en", "s", 0), (None, "", "en", "s", 0)], docs.schema)
    every = docs.unionByName(extra).unionByName(docs.limit(3)).withColumn("score", F.lit(1))
    kept = p.quality(spark, every, SF)
    learn = id_hash_mod("doc_id", 4) != 2
    model = vote.fit_on(every.where(learn), labels.where(learn))
    text = {r.doc_id: r.text for r in every.collect()}
    good = {i for i, t in text.items() if model.scores(np.array([vote.term_counts(None if t is None else t.encode())]))[0] >= p.GOOD}
    got = [r[0] for r in kept.select("doc_id").collect()]
    assert kept.columns == every.columns and set(got) == good and 0 < len(good) < len(text)
    assert p.quality(spark, every.limit(0), SF).count() == 0


def test_packing_stage_holds_every_id(spark):
    from basaltry.llm.tokens import Encoder, public_path

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).unionByName(spark.createDataFrame([(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    pieces = p.packing(spark, docs, SF).collect()
    enc = Encoder(public_path("byte_bpe_50k.json")).whole
    want = sum(len(enc.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r.length for r in pieces) == want
    at = 0
    for s, o, n in sorted((r.sequence_id, r.offset, r.length) for r in pieces):
        assert (s, o) == divmod(at, 1024)
        at += n


def test_run_applies_all_stages(spark):
    assert [n for n, _ in p.STAGES] == ["language_id", "quality", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    stay = {r[0] for r in docs.select("doc_id").collect()}
    out = p.run(spark, SF).collect()
    assert {r.doc_id for r in out} == stay and 0 < len(stay)
    assert sum(r.length for r in out) == sum(dict((r.doc_id, r.doc_tokens) for r in out).values())
