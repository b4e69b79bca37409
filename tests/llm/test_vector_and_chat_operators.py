"""Vector searches against brute force; chat formatting; the registered queries and the pipeline."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basaltry.llm import ann_search, chat_format, queries, topk_search, vectors
from basaltry.llm.vectors import top_of

V = "vec_id long, embedding array<float>, v int, score int"


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(6).tolist(), 1, 2) for i in range(300)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.5], 1, 2) for i in range(300, 420)]  # copies: ties
    rows += [(20, rows[20][1], 1, 2), (500, None, 1, 2), (None, [1.0] * 6, 1, 2), (520, [float("nan")] * 6, 1, 2), (540, [math.inf] + [0.0] * 5, 1, 2), (560, [], 1, 2), (580, [0.0] * 6, 1, 2), (600, [None] + [1.0] * 5, 1, 2)]
    return spark.createDataFrame(rows, V).repartition(3), rows


def _brute(rows, k, every, zero_counts, scale=None):
    """An id with several vectors is as many candidates, and gets the best of what they find."""
    data = []
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (not zero_counts and not any(v)):
            continue
        x = np.array(v or [0.0] * 6, dtype=np.float32).astype(np.float64)
        data.append((i, np.floor(scale * x) if scale else x))
    ids, table = np.array([i for i, _ in data]), np.array([x for _, x in data])
    out = {}
    for q, x in data:
        if q % every == 0:
            score = table @ x
            some = np.flatnonzero((ids != q) & (score >= np.partition(score, -min(len(score), k + 200))[-min(len(score), k + 200)]))
            out.setdefault(q, set()).update((-float(score[j]), int(ids[j])) for j in some)
    return {q: sorted(v)[:k] for q, v in out.items()}


def test_exact_topk_equals_brute_force(odd):
    df, rows = odd
    got = {}
    for r in topk_search.exact_topk(df, df.where("vec_id % 20 = 0"), 10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (-r.score, r.vec_id)
    want = _brute(rows, 10, 20, True, 1024)
    assert {q: [v[i] for i in sorted(v)] for q, v in got.items()} == {q: [(int(s), i) for s, i in v] for q, v in want.items()}


def test_dual_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (6, 8))
    x = np.concatenate([c + rng.integers(-20, 20, (300, 8)) for c in centres]).astype(float)
    q = np.concatenate([c + rng.integers(-20, 20, (4, 8)) for c in centres]).astype(float)
    looked = []
    rows, ids, scores = topk_search.dual_tree(q, x, np.arange(len(x)), 7, np.full(len(q), -np.inf), looked)
    assert sum(looked) < 0.5 * len(q) * len(x)
    s = q @ x.T
    for i in range(len(q)):
        want = np.lexsort((np.arange(len(x)), -s[i]))[:7]
        assert sorted(zip(-scores[rows == i], ids[rows == i], strict=True)) == [(-s[i, j], j) for j in want]
    tree = topk_search.cover_tree(x)
    assert tree.children and all(((x[c.points] - c.centre) ** 2).sum(1).max() <= c.radius**2 * (1 + 1e-9) for c in tree.children)


def test_cover_tree_goes_to_its_leaves():
    rng = np.random.default_rng(3)
    x = np.floor(rng.standard_normal((800, 32)) * 200)  # no two are near each other
    tree, stack, held = topk_search.cover_tree(x), [], []
    assert tree.children
    stack = [tree]
    while stack:
        node = stack.pop()
        assert np.sqrt(((x[node.points] - node.centre) ** 2).sum(axis=1)).max() <= node.radius * (1 + 1e-9)
        if node.children:
            assert max(c.radius for c in node.children) <= node.radius / 2 * (1 + 1e-9)
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
            stack += node.children
        else:
            assert len(node.points) <= topk_search.LEAF or node.radius == 0
            held += node.points.tolist()
    assert sorted(held) == list(range(800))


def test_exact_topk_over_many_cells_and_blocks(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 10)) * 3
    x = np.concatenate([centres[rng.integers(0, 12, 1500)] + rng.standard_normal((1500, 10)) * 0.2, rng.standard_normal((900, 10))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, [float(np.float32(9.0))] * 10), (40, [float(np.float32(-9.0))] * 10)]  # two ids with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in topk_search.exact_topk(df, df.where("vec_id % 20 = 0"), 10, block_size=64, query_block=16).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert {q: sorted(v) for q, v in got.items()} == _brute(rows, 10, 20, True, 1024)


def _shared_and_doubled(seed):
    """Ids that share vectors, ids with several vectors, some of them shared with others."""
    rng = np.random.default_rng(seed)
    pool = np.round(rng.standard_normal((40, 5)) * 8) / 8
    rows = [(int(i), pool[rng.integers(0, 40)].tolist()) for i in rng.integers(0, 60, 150)]
    return sorted(rows + [(100, [1.0, 0.0, 0.0, 0.0, 0.0]), (100, [0.0, 5.0, 0.0, 0.0, 0.0]), (200, [1.0, 0.0, 0.0, 0.0, 0.0]), (303, [0.0, 1.0, 0.0, 0.0, 0.0]), (404, [2.0, 0.0, 0.0, 0.0, 0.0])])


@pytest.mark.parametrize("few", [1 << 12, 3])
def test_ids_that_share_vectors_and_have_several(spark, monkeypatch, few):
    monkeypatch.setattr(vectors, "FEW", few)  # the second time classes are joined, not broadcast
    for rows in ([(100, [1.0, 0.0]), (100, [0.0, 5.0]), (200, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [2.0, 0.0])], _shared_and_doubled(few)):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
        for found, want in (
            (topk_search.exact_topk(df, df.where("vec_id % 4 = 0"), 6), _brute(rows, 6, 4, True, 1024)),
            (ann_search.approximate_neighbours(df, df.where("vec_id % 4 = 0"), 6), _brute(rows, 6, 4, False)),
        ):
            got = {}
            for r in found.collect():
                got.setdefault(r.query_id, {})[r["rank"]] = (-r.score, r.vec_id)
            assert {q: [v[i] for i in sorted(v)] for q, v in got.items()} == want


def test_only_crowded_buckets_are_copied(spark, monkeypatch):
    monkeypatch.setattr(ann_search, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(11)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((1500, 8)).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want, got = _brute(rows, 10, 10, False), {}
    for r in ann_search.approximate_neighbours(df, df.where("vec_id % 10 = 0"), 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9


def test_exact_topk_of_large_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8) * (1 if i % 3 else 3e4)]) for i in range(200)]
    rows += [(200 + i, [float(np.float32(x)) for x in rng.standard_normal(8) * 1e5]) for i in range(6)] + [(240, [1e5] * 8), (260, [-1e5] * 8), (280, [1e12] * 8), (300, [-1e12] * 8), (301, [3e38] + [0.0] * 7), (320, [3e38, -3e38] + [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk_search.exact_topk(df, df.where("vec_id % 20 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    data = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in rows}
    most = 2**63 - 2
    for q in (i for i in data if i % 20 == 0):
        want = sorted((-max(-most, min(most, sum(a * b for a, b in zip(data[q], x, strict=True)))), i) for i, x in data.items() if i != q)[:10]
        assert [t[1:] for t in sorted(got[q])] == want


def test_neighbours_have_high_recall_and_exact_scores(odd):
    df, rows = odd
    got = {}
    for r in ann_search.approximate_neighbours(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = _brute(rows, 20, 20, False)
    assert got.keys() == want.keys()
    hits = [len({v for v, _ in got[q].values()} & {i for _, i in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    for found in got.values():
        listed = [found[i] for i in sorted(found)]
        assert len(listed) == 20 and listed == sorted(listed, key=lambda t: (-t[1], t[0]))


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_where_lists_are_pruned(spark, clustered):
    rng = np.random.default_rng(5)
    n, d = 12_000, 24
    x = rng.standard_normal((60, d))[rng.integers(0, 60, n)] + rng.standard_normal((n, d)) * 0.3 if clustered else rng.standard_normal((n, d))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in ann_search.approximate_neighbours(df, df.where("vec_id % 60 = 0"), 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x, hits = x.astype(np.float64), []
    for q in range(0, n, 60):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9
    graph = ann_search.centroid_graph(ann_search._lifted(x[::3], 1.0, d, False), n, 1.0)
    _, take = graph.search(ann_search._lifted(x[::60], 1.0, d, True), ann_search.RATIO, ann_search.PROBES)
    assert take.mean() < (0.4 if clustered else 0.9) and len(graph.centroids) == n // ann_search.LIST


def test_searches_of_nothing(spark, odd):
    none = spark.createDataFrame([], V)
    assert topk_search.exact_topk(none, none, 10).count() == 0
    assert ann_search.approximate_neighbours(none, none, 20).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, 1), (1, [0.5, 0.5], 1, 1)], V)
    assert [tuple(r) for r in topk_search.exact_topk(few, few.where("vec_id = 0"), 10).collect()] == [(0, 1, 1, 1024 * 512)]
    assert ann_search.approximate_neighbours(few, few.where("vec_id = 0"), 20).count() == 1


def test_top_of_breaks_ties_by_place():
    r, c = top_of(np.array([[1.0, 3.0, 3.0, 3.0, 0.0]]), np.arange(5), 2)
    assert c.tolist() == [1, 2]


T = "pair_id long, side string, turn long, role string, text string, prompt string"


def _pairs(spark, rows, block=256):
    out = chat_format.preference_pairs(spark.createDataFrame([(*r, "clash") for r in rows], T), block)
    return {(r.pair_id, r.block): r for r in out.collect()}


def test_longest_common_prefix_is_rendered_once(spark):
    common = [(0, "system", "be brief"), (1, "user", "hi")]
    rows = [(1, s, *t) for s in ("chosen", "rejected") for t in common]
    rows += [(1, "chosen", 2, "assistant", "hello"), (1, "rejected", 2, "assistant", "go away"), (1, "rejected", 3, "user", "oh")]
    r = _pairs(spark, rows)[1, 0]
    assert r.prompt == "<|system|>\nbe brief<|end|>\n<|user|>\nhi<|end|>\n"
    assert r.chosen == "<|assistant|>\nhello<|end|>\n" and r.rejected == "<|assistant|>\ngo away<|end|>\n<|user|>\noh<|end|>\n"
    assert (r.prompt_turns, r.chosen_turns, r.rejected_turns) == (2, 1, 2)
    for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
        assert sum(m.length for m in mask) == len(text)
    at, trained = 0, ""
    for m in r.rejected_mask:
        trained += r.rejected[at : at + m.length] * m.train
        at += m.length
    assert trained == "go away<|end|>\n"


def test_odd_conversations(spark):
    rows = [(1, "chosen", 0, None, None), (1, "rejected", 0, None, None), (2, "chosen", 0, "user", "x"), (None, "chosen", 0, "user", "x"), (3, "other", 0, "user", "x"), (4, "chosen", None, "user", "first"), (4, "chosen", 0, "user", "x"), (4, "rejected", None, "user", "first"), (4, "rejected", 0, "user", "x"), (4, "rejected", 0, "user", "x")]
    got = _pairs(spark, rows)
    assert set(got) == {(1, 0), (2, 0), (4, 0)}
    assert got[1, 0].prompt == "<||>\n<|end|>\n" and got[1, 0].chosen == "" and got[2, 0].prompt == "" and got[2, 0].rejected_turns == 0
    assert got[4, 0].prompt_turns == 2 and got[4, 0].rejected_turns == 1
    assert chat_format.preference_pairs(spark.createDataFrame([], T)).count() == 0


def test_long_pairs_go_on_in_further_rows(spark):
    rows = [(1, s, t, "user", f"t{t}") for s in ("chosen", "rejected") for t in range(10)] + [(1, "chosen", 10, "assistant", "a"), (1, "rejected", 10, "assistant", "b"), (1, "chosen", 12, "user", "z"), (1, "rejected", 12, "user", "z")]
    got, whole = _pairs(spark, rows, block=4), _pairs(spark, rows)[1, 0]
    for c in ("prompt", "chosen", "rejected"):
        assert "".join(got[1, b][c] for b in range(3)) == whole[c]
    assert whole.chosen_turns == 2 and len(got) == 3


def test_turn_numbers_do_not_cut_a_pair(spark):
    """Only the number of turns does: few turns with high or negative numbers are one row, many turns of one number several."""
    rows = [(1, s, t, "user", f"t{t}") for s in ("chosen", "rejected") for t in (-5, 0)] + [(1, "chosen", 70_000, "assistant", "a"), (1, "rejected", 70_000, "assistant", "b")]
    (r,) = _pairs(spark, rows, chat_format.BLOCK).values()
    assert (r.prompt_turns, r.chosen_turns, r.rejected_turns) == (2, 1, 1)
    rows = [(2, "chosen", 0, "user", f"{i:02}") for i in range(9)] + [(2, "rejected", 0, "user", f"{i:02}") for i in range(6)] + [(2, "rejected", 0, "user", "zz")] + [(3, "chosen", 0, "user", "x")]
    got = _pairs(spark, rows, block=4)
    assert set(got) == {(2, 0), (2, 1), (2, 2), (3, 0)}
    assert [got[2, b].prompt_turns for b in range(3)] == [4, 2, 0] and [got[2, b].chosen_turns for b in range(3)] == [0, 2, 1] and [got[2, b].rejected_turns for b in range(3)] == [0, 1, 0]


def test_a_pair_of_600_turns_is_one_row(spark):
    rows = [(1, s, t, "user", f"t{t}") for s in ("chosen", "rejected") for t in range(598)] + [(1, "chosen", 598, "assistant", "yes"), (1, "rejected", 598, "assistant", "no")]
    (r,) = _pairs(spark, rows, chat_format.BLOCK).values()
    assert r.prompt_turns == 598 and r.chosen == "<|assistant|>\nyes<|end|>\n" and r.rejected_turns == 1


def test_swapped_endings_of_odd_conversations(spark):
    rows = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, 1, "assistant", "b2"), (1, 0, "user", "c"), (1, 2, "assistant", "d"), (4, None, "user", "e"), (6, 0, None, None), (6, 1, "assistant", None), (7, 0, "x", "y"), (7, 0, "x", "y"), (None, 0, "user", "z")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, side string")
    got = sorted(map(str, (tuple(r) for r in chat_format.swapped_endings(df).collect())))
    chosen = [(i, "chosen", -1 if t is None else t, role, text) for i, t, role, text in rows if i is not None]
    rejected = [(0, "rejected", 0, "user", "a"), (0, "rejected", 1, "assistant", "d"), (1, "rejected", 0, "user", "c"), (1, "rejected", 2, "assistant", "b"), (1, "rejected", 2, "assistant", "b2")]
    rejected += [(6, "rejected", 0, None, None), (6, "rejected", 1, "x", "y"), (6, "rejected", 1, "x", "y"), (7, "rejected", 0, "assistant", None)]
    assert got == sorted(map(str, chosen + rejected))
    assert chat_format.swapped_endings(df.limit(0)).count() == 0


def test_every_operator_has_a_query():
    names = {q.split("_")[0] for q in queries.QUERIES}
    assert names == {f"op{n}" for n in range(1, 14)} and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
