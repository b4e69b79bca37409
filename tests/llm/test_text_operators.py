"""Operators on documents, against brute force, round trips and odd inputs."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basaltry.llm import language_id, lm_scoring, packing, pieces, quality, simhash, token_output
from basaltry.llm.common import fresh_path
from basaltry.llm.components import connected_components
from basaltry.llm.tokens import Encoder, public_path

BPE, PIECES = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")
LONG = "word other thing " * 40_000
#: Nulls, empty and blank texts, repeated rows, one very long text, other scripts, and columns whose names clash.
ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "the cat sat", "b"), (4, "the cat sat", "b"), (5, "The CAT sat", "b"), (6, LONG, "a"), (7, "日本語 ünïcode 👍\x00", "c"), (None, "the cat sat on", "a"), (8, "a", None)]
SCHEMA = "doc_id long, text string, source string, chunk long, fp long, queue string, n long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, 2, "q", 3) for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_cached_encoding_is_that_of_whole_texts():
    enc, rnd = Encoder(BPE), random.Random(1)
    bits = ["a", "b", " ", "  ", "\n", "\t", "é", "12", "'s", "!", "\x1c", "\x85", "<|endoftext|>", "日本", "👍", "\r\n", "the ", "　"]
    texts = [None, "", " ", *["".join(rnd.choices(bits, k=rnd.randint(0, 14))) for _ in range(3000)]]
    for t, got in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == enc.whole.encode(t or "", add_special_tokens=False).ids


def test_token_shards_round_trip(spark, odd, none):
    folder = fresh_path(spark, "test")
    manifest = token_output.write_token_shards(odd, folder, BPE)
    rows = token_output.read_token_shards(spark, manifest).collect()
    assert sorted(r.doc_id or 0 for r in rows) == sorted(r[0] or 0 for r in ODD)
    enc = Encoder(BPE).whole
    want = sorted((i or 0, struct.pack(f"<{len(x) + 1}I", *x, 0)) for i, x in ((r[0], enc.encode(r[1] or "", add_special_tokens=False).ids) for r in ODD))
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == sorted((i, len(x) // 4, zlib.crc32(x)) for i, x in want)
    at = 0
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)):
        assert r.start == at
        at += r.n_tokens
    reader = next(x for x in (token_output.ShardReader(m[0]) for m in manifest) if 6 in x.doc_ids)
    assert reader.ids_of(6).tolist() == [*enc.encode(LONG, add_special_tokens=False).ids, 0]
    with pytest.raises(KeyError):
        reader.ids_of(10**9)
    assert token_output.token_output(none, BPE).count() == 0


def test_shared_dictionary_and_its_hash(spark):
    docs = spark.createDataFrame([(i, f"the number {i} of many and a tail of words " * 60) for i in range(300)], "doc_id long, text string")
    folder = fresh_path(spark, "test")
    manifest = token_output.write_token_shards(docs, folder, BPE)
    reader = token_output.ShardReader(manifest[0][0])
    assert len(reader.header["dictionary_sha256"]) == 64 and reader.n and reader.ids_at(0)[-1] == 0
    token_output._decompressor.cache_clear()
    fs, path = token_output.filesystem(folder)
    name = f"{path}/dictionary-{reader.header['dictionary_sha256']}.zdict"
    with fs.open_output_stream(name) as f:
        f.write(b"other")
    with pytest.raises(ValueError):
        token_output.ShardReader(manifest[0][0])
    token_output._decompressor.cache_clear()


@pytest.mark.parametrize("proportions", [None, {"a": 0.5, "b": 0.3, "c": 0.2, None: 0.1}])
def test_packing_covers_every_id_once(spark, odd, none, proportions):
    rows = packing.pack_mixture(odd, BPE, seq_len=64, window=256, proportions=proportions).collect()
    enc, total = Encoder(BPE).whole, 0
    docs = {}
    for i, t, _ in ODD:
        x = [*enc.encode(t or "", add_special_tokens=False).ids, 0]
        docs.setdefault(i, []).append(x)
        total += len(x)
    assert sum(r.length for r in rows) == total
    for r in rows:
        assert any(zlib.crc32(struct.pack(f"<{r.length}I", *x[r.start : r.start + r.length])) == r.ids_crc32 and len(x) == r.doc_tokens for x in docs[r.doc_id])
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    at = 0
    for s, o, n in places:
        assert (s, o) == divmod(at, 64)
        at += n
    assert packing.pack_mixture(none, BPE).count() == 0


def test_windows_hold_the_target_proportions():
    s = packing.Schedule([10_000, 30_000, 60_000], 1000)
    for w in range(s.n):
        took = s.sent(w + 1) - s.sent(w)
        assert np.abs(took - [100, 300, 600]).max() <= 1
    weighted = packing.Schedule([10_000, 30_000, 60_000], 1000, [1, 1, 2])
    took = weighted.sent(5) - weighted.sent(4)
    assert np.abs(took - [250, 250, 500]).max() <= 1
    assert weighted.sent(weighted.n).tolist() == [10_000, 30_000, 60_000]
    assert all((weighted.sent(w + 1) >= weighted.sent(w)).all() for w in range(weighted.n))


@pytest.mark.parametrize("named", [False, True])
def test_each_of_many_sources_has_its_share_of_every_window(spark, named):
    docs = [(i, "a b c d e f", f"s{i % 1500}") for i in range(1500)] + [(i, "a b c d e f", s) for i, s in enumerate(["big"] * 600 + ["half"] * 600, 1500)]
    rows = packing.pack_mixture(spark.createDataFrame(docs, "doc_id long, text string, source string"), BPE, seq_len=64, window=2048, proportions={"big": 1000.0, "half": 500.0, "s7": 1.0} if named else None).collect()
    total, size = sum(r.length for r in rows), rows[0].doc_tokens
    assert total == size * len(docs)
    at = 0
    for s, o, n in sorted((r.sequence_id, r.offset, r.length) for r in rows):
        assert (s, o) == divmod(at, 64)
        at += n
    source, sent = {i: s for i, _, s in docs}, {}
    for r in rows:
        sent[r.window_id, source[r.doc_id]] = sent.get((r.window_id, source[r.doc_id]), 0) + r.length
    for name, tokens, weight in (("big", 600 * size, 1000), ("half", 600 * size, 500), ("s7", size, 1), ("s8", size, 1)):
        share = weight / 3000 if named else tokens / total  # the other 1499 sources get the smallest share named
        upto = sum(sent.get((w, name), 0) for w in range(2))
        assert abs(upto - share * 2 * 2048) <= 1


def test_fingerprints_follow_their_definition():
    from xxhash import xxh64_intdigest

    def plain(text):
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if x]
        sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxh64_intdigest(x.encode(), 42) for x in sh]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)) if h else 0

    for t in (None, "", "one", "One two", "a b c", "A b\x0bc d\ne  f", "Ünï b c d É", "x\x1cy z w", "ÀB c d e"):
        assert simhash.fingerprint(None if t is None else t.encode()) == plain(t)


@pytest.mark.parametrize("tile", [4096, 40])
def test_links_lose_no_pair(spark, tile):
    rng = np.random.default_rng(0)
    prints = set(rng.integers(0, 2**63, 60, dtype=np.uint64).tolist())
    for x in list(prints)[:20]:
        for _ in range(8):
            x ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            prints.add(x)
    centre = next(iter(prints))
    prints |= {centre ^ (1 << i) ^ (1 << j) for i in range(0, 64, 2) for j in range(i)}
    a = np.array(sorted(prints), dtype=np.uint64)
    signed, up = a.view(np.int64).tolist(), list(range(len(a)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 2):
            x, y = sorted((root(i), root(i + 1 + int(j))))
            up[y] = x
    want = {signed[i]: min(signed[k] for k in range(len(a)) if root(k) == root(i)) for i in range(len(a))}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = dict(connected_components(simhash.links(df, 2, tile)).collect())
    assert {x: got.get(x, x) for x in signed} == want


@pytest.mark.parametrize("names", [1 << 16, 1])
def test_near_duplicates_of_odd_rows(spark, odd, none, monkeypatch, names):
    monkeypatch.setattr(simhash, "NAMES", names)
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16 and by[3].component_id == 1
    assert by[5].component_id == 4 and by[4].copies == 3 and by[7].component_id == 7
    assert simhash.near_duplicates(none).count() == 0


def _stupid_backoff(texts, min_count, order=3):
    count = {}
    for w in texts:
        for n in range(1, order + 1):
            for k in range(len(w) - n + 1):
                g = tuple(w[k : k + n])
                count[g] = count.get(g, 0) + 1
    total = sum(map(len, texts))

    def score(w):
        out, backed = 0.0, 0
        for k in range(len(w)):
            depth = min(order, k + 1)
            for n in range(depth, 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if n == 1 or count.get(g, 0) >= min_count:
                    out += np.log(max(count.get(g, 0), 1) / (total if n == 1 else count[g[:-1]])) + (depth - n) * np.log(0.4)
                    backed += n < depth
                    break
        return out, backed

    return score


@pytest.mark.parametrize(("min_count", "chunk", "span"), [(2, None, None), (1, None, None), (2, 40, 64)])
def test_lm_scores_by_brute_force(spark, odd, none, monkeypatch, min_count, chunk, span):
    if chunk:  # many chunks and hash ranges
        monkeypatch.setattr(lm_scoring, "CHUNK", chunk)
        monkeypatch.setattr(lm_scoring, "RANGE", span)
    got = sorted(((r.doc_id or 0, r.n_words, round(r.log_score, 4), r.n_backoff) for r in lm_scoring.lm_scores(odd, min_count=min_count).collect()))
    score = _stupid_backoff([(t or "").lower().split() for _, t, _ in ODD], min_count)
    want = []
    for i, t, _ in ODD:
        w = (t or "").lower().split()
        value, backed = score(w)
        want.append((i or 0, len(w), round(value, 4), backed))
    assert [(*x[:2], x[3]) for x in got] == [(*x[:2], x[3]) for x in sorted(want)]
    assert np.allclose([x[2] for x in got], [x[2] for x in sorted(want)], rtol=1e-6)
    assert lm_scoring.lm_scores(none).count() == 0


def test_lm_scores_by_another_corpus(spark, odd):
    seen = {r.doc_id: r for r in lm_scoring.lm_scores(odd.where("doc_id in (1, 4, 7)"), train=odd.where("doc_id in (4, 5)")).collect()}
    assert seen[7].n_backoff == 2 and seen[4].n_backoff == 0 and seen[1].mean_log_score is None


def test_long_document_is_scored_whole(spark, odd):
    r = lm_scoring.lm_scores(odd.where("doc_id = 6")).first()
    assert r.n_words == 120_000 and r.log_score < 0


def test_forward_sums_all_segmentations():
    trie = language_id.vocabulary(BPE)
    n = int(trie.value.max()) + 1
    probs = np.vstack([np.random.default_rng(0).random((n, 2)) * 1e-2, np.zeros(2)])
    word = b" there"

    def total(at):
        return np.ones(2) if at == len(word) else sum((probs[k] * total(at + m) for m, k in trie.prefixes(word, at)), np.zeros(2))

    found = trie.match(np.frombuffer(word, np.uint8)[None])
    assert np.allclose(language_id.forward(found, probs)[-1, 0], total(0))
    model = language_id.LanguageModel(BPE, ["x", "y"], np.zeros(2), np.log(np.maximum(probs[:-1], 1e-12)).astype(np.float32))
    short = model.score_words(["there"])[0]
    assert np.allclose(short, np.log(total(0)), rtol=1e-4)
    long_word = "abcdefghij" * 8
    assert np.allclose(model.score_words([long_word])[0], model._score_long(b" " + long_word.encode()))


def test_language_id_on_held_out_and_odd_rows(spark, odd, none):
    words = {"xx": ["lorem", "ipsum", "dolor", "amet"], "yy": ["zwart", "wit", "groen", "blauw"]}
    rnd = random.Random(0)
    docs = [(i, " ".join(rnd.choices(words["xx" if i % 2 else "yy"], k=20)), "xx" if i % 2 else "yy") for i in range(60)]
    model = language_id.fit_on(spark.createDataFrame(docs[:40], "doc_id long, text string, lang string"), BPE)
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(docs[40:], "doc_id long, text string, lang string"), model).collect()}
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, _, lang in docs[40:])
    rows = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[1].score == 0 and rows[6].words == 120_000
    assert language_id.fit_on(none.withColumn("lang", F.lit("x")), BPE) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    assert language_id.identify(none, model).count() == 0


def test_long_words_and_long_pieces_are_fitted():
    trie = language_id.vocabulary(BPE)
    assert trie.longest > 12 and any(n == 15 for n, _ in trie.prefixes(b" responsibility", 0))
    rnd = random.Random(0)
    scripts = {"ja": "日本語東京人大学生", "zh": "中国汉字北京们这说"}
    line = lambda x: "".join(rnd.choices(scripts[x], k=40))
    model = language_id.fit([(x, line(x), 1) for x in scripts for _ in range(30)], BPE, dict.fromkeys(scripts, 30))
    names, scores, _ = model.classify([line(x) for x in scripts for _ in range(10)])
    assert names == ["ja"] * 10 + ["zh"] * 10 and scores.min() > 0.99
    # sums in logarithms are those of the short form, and expectations too
    short, limit = [("ja", "thereupon", 2), ("zh", "thereafter", 1)], language_id.SHORT
    one = language_id.fit(short, BPE, dict.fromkeys(scripts, 1))
    language_id.SHORT = 3
    try:
        two = language_id.fit(short, BPE, dict.fromkeys(scripts, 1))
        assert np.allclose(one.log_probs, two.log_probs, atol=1e-5)
        in_logs = two.score_words(["thereupon", "x" * 500])
    finally:
        language_id.SHORT = limit
    assert np.allclose(in_logs[0], one.score_words(["thereupon"])[0], atol=1e-4) and np.isfinite(in_logs).all()


def test_unigram_pieces_agree_with_the_library():
    import sentencepiece

    raw = open(PIECES, "rb").read()
    i = raw.rindex(b"\x12\x06tok_v0\x18\x02") + 9
    lib = sentencepiece.SentencePieceProcessor(model_proto=raw[:i] + b"\x01" + raw[i + 1 :])  # the same pieces as a unigram model
    u, rnd = pieces.UnigramPieces(PIECES), random.Random(3)
    bits = [*"abcdetheinß019.,!", "the", "ing", " of", " to", " and"]
    score = lambda x: sum(lib.get_score(int(k)) for k in x)
    for _ in range(300):
        text = "".join(rnd.choices(bits, k=rnd.randint(1, 12))).strip()
        ids = np.frombuffer(u.encode([text])[0], "<u4")
        assert u.decode(ids) == text
        assert score(ids) >= score(lib.nbest_encode_as_ids(text, 1)[0])


def test_best_segmentation_by_enumeration():
    """Unknown characters, line ends, double and edge spaces too."""
    u, rnd = pieces.UnigramPieces(PIECES), random.Random(4)
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    scores = {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
    unknown = min(scores.values()) - pieces.UNK_PENALTY

    def best(text):
        reach = [0.0] + [-np.inf] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(e):
                if text[s:e] in scores:
                    reach[e] = max(reach[e], reach[s] + scores[text[s:e]])
            if text[e - 1] not in scores:
                reach[e] = max(reach[e], reach[e - 1] + unknown)
        return reach[-1]

    def cost(ids):
        total, raw = 0.0, b""
        for k in [*ids.tolist(), -1]:
            if k >= 0 and m.is_byte(k):
                raw += bytes([int(m.id_to_piece(k)[3:5], 16)])
                continue
            total += len(raw.decode()) * unknown + (m.get_score(k) if k >= 0 else 0.0)
            raw = b""
        return total

    bits = [*"abthein\n👍é日ß09. \x00", " ", "  ", "the", "ing"]
    for _ in range(400):
        text = "".join(rnd.choices(bits, k=rnd.randint(1, 9)))
        ids = np.frombuffer(u.encode([text])[0], "<u4")
        assert u.decode(ids) == text
        assert cost(ids) == pytest.approx(best("▁" + text.replace(" ", "▁")))


def test_vectorised_viterbi_equals_the_scalar_one():
    u, rnd = pieces.UnigramPieces(PIECES), random.Random(4)
    words = ["▁" + "".join(rnd.choices("abcdethingéß日👍", k=rnd.randint(0, 9))) for _ in range(400)]
    for w in words:
        b = w.encode()
        assert u._many(np.frombuffer(b, np.uint8)[None])[0] == u._one(b)


def test_pieces_of_odd_rows_round_trip(spark, odd, none):
    rows = {r.doc_id: r for r in pieces.round_trips(odd, PIECES).collect()}
    assert all(r.round_trip for r in rows.values()) and rows[1].n_ids == 0 and rows[7].n_fallback > 0
    back = {r.doc_id: r.text for r in pieces.decode_pieces(pieces.encode_pieces(odd, PIECES), PIECES).collect()}
    assert back[6] == LONG and back[7] == ODD[7][1] and back[1] == ""
    assert pieces.round_trips(none, PIECES).count() == 0


def test_quality_votes(spark, odd, none):
    rnd = random.Random(0)
    good = lambda: " ".join(rnd.choices(["calm", "plain", "words", "here", "and", "there"], k=30)).capitalize() + "."
    docs = [(i, good() if i % 2 else good().upper().replace(" ", "!! "), i % 2) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    model = quality.fit_on(df.where("doc_id < 60").select("doc_id", "text"), df.select("doc_id", "quality"))
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert all((got[i] >= 0.7) == bool(q) for i, _, q in docs[60:])
    rows = {r.doc_id: r.score for r in quality.score(odd, model).collect()}
    assert rows[1] == rows[2] == model.prior == 0.5 and all(0 <= v <= 1 for v in rows.values())
    empty = quality.fit_on(none, df.select("doc_id", "quality"))
    assert {r.score for r in quality.score(odd, empty).collect()} == {0.5}
    assert quality.score(none, model).count() == 0


def test_votes_are_exact_neighbours():
    rng = np.random.default_rng(0)
    counts = rng.poisson(1.0, (60, quality.TERMS)).astype(np.float32)
    counts[20:40] = counts[:20]  # ties
    m = quality.fit(counts[:40], np.arange(40) % 2, {0: 20, 1: 20})
    z = m.vectors(counts[40:])
    assert m.scores(counts[40:]).tolist() == [m.scores(counts[k : k + 1])[0] for k in range(40, 60)]
    for i, s in enumerate(m.scores(counts[40:])):
        c = np.round(z[i].astype(float) @ m.voters.T.astype(float), quality.PLACES)
        top = sorted(range(40), key=lambda k: (-c[k], k))[: quality.NEIGHBOURS]
        w = np.exp(quality.SHARPNESS * (c[top].astype(float) - 1)) * m.weights[top]
        assert s == pytest.approx((w * m.votes[top]).sum() / w.sum())
