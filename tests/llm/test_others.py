import hashlib
import math
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from phishscreen.llm import bpe, embed_dedup, lm, mixing, quality, queries, url_filter

from .helpers import corpus, frame, union_find, words_of


@pytest.fixture(scope="module")
def codec():
    return queries.codec()


def test_bpe_is_tiktoken_and_round_trips(spark, codec):
    rows = corpus(3) + [(1000, "x" * 3000), (1001, "日本語。" * 500), (1002, "it's 12,5\n\n  end \t")]
    small = bpe.Codec.from_path(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, piece_chars=40)
    plain = {i: codec.encoding.encode_ordinary(t or "") for i, t in rows}
    out = bpe.encode(frame(spark, rows), small)
    assert all(r.ids == plain[r.doc_id] and r.n_tokens == len(r.ids) for r in out.collect())
    assert out.columns.count("ids") == 1
    texts = dict(rows)
    assert all(bytes(r.decoded) == (texts[r.doc_id] or "").encode() for r in bpe.decode(out, small).collect())
    for r in bpe.round_trip_digests(frame(spark, rows), small).collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, plain[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_bpe_decodes_parts_of_a_character(codec):
    ids = codec.encode("🙂")
    assert b"".join(codec.decode([i]) for i in ids) == "🙂".encode()


def test_quality_statistics(spark):
    rows = corpus(5) + [(900, "a b c d e\na b c d e\n\nX# $y"), (901, None)]
    for r in quality.statistics(frame(spark, rows)).collect():
        text = dict(rows)[r.doc_id] or ""
        words = words_of(text)
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        again = [False] * len(words)
        for i in range(len(words) - 4):
            if grams[tuple(words[i : i + 5])] > 1:
                again[i : i + 5] = [True] * 5
        lines = [x for x in text.encode().split(b"\n") if x.split()]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(again))


def test_quality_rejects_junk_and_keeps_clean(spark):
    good = [(i, " ".join(f"word{(i * 7 + j * (i % 5 + 1)) % 500}" for j in range(60))) for i in range(300)]
    junk = [(1000 + i, " ".join(f"wo{(i + j) % 300}%%%" for j in range(60))) for i in range(40)]
    short = [(2000, "too short"), (2001, None)]
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in (good + junk)[::2]] + [(None, 1, 0), (0, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.judge(frame(spark, good + junk + short), labels).collect()}
    assert sum(got[i] for i, _ in good) >= 294
    assert not any(got[i] for i, _ in junk + short)
    kept = quality.filter_docs(frame(spark, good + junk + short), labels)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, k in got.items() if k)


def test_quality_without_labels_only_has_base_rules(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality.judge(frame(spark, corpus(6)), labels).collect()
    assert all(r.kept != r.base_failed for r in got)
    assert quality.judge(frame(spark, []), labels).collect() == []


RULES = [("org", "/", "allow"), ("Example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, "/", "block"), ("", "/", "block")]


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h.lower() + p, a) for h, p, a in RULES if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_url_filter(spark):
    urls = ["http://Example.ORG/es/1", "https://a.example.org/en/12?x", "x://b.org", "x://b.org/", "http://notexample.org/es/", "http://a.com/fr/#z", "http://a.com/de/x", "http://com/de/", "nothing", "", None, "http://", "http:///es/", "a://u@é.org:80/p#q?r", "http://org./x", "http://a..com/de/"]
    urls += [f"http://h{i % 9}.example.org/{'es' if i % 2 else 'en/1'}{i % 4}/" for i in range(60)] + ["http://hot.com/de/"] * 50
    pages = spark.createDataFrame([(i, u, "clash", "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string").repartition(4)
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got == {i: plain_url(u) for i, u in enumerate(urls)}
    none = url_filter.judge(pages, rules.limit(0)).collect()
    assert {r.verdict for r in none} == {"allow"} and len(none) == len(urls)
    assert url_filter.judge(pages.limit(0), rules).collect() == []


def test_mixing_meets_targets(spark):
    rows = [(i, " ".join(["w"] * (5 + i * 37 % 200)) if i % 11 else None) for i in range(900)]
    docs = frame(spark, rows)
    got = mixing.rates(docs).collect()
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        x = by.setdefault(r.source, [r.source_size, r.target, 0, 0, 0])
        x[2] += r.copies * r.size
        x[3] += r.size
        x[4] = max(x[4], r.size)
        assert 0 <= r.copies <= 2
    assert math.isclose(sum(x[1] for x in by.values()), 1.5 * total)
    for size, target, took, own, largest in by.values():
        assert size == own and target <= 2 * size + 1e-6 and abs(took - target) <= largest
    again = mixing.rates(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mixing_targets_go_by_code_point_with_null_last(spark):
    """Weights 3, 1, 2 and again; what exceeds twice a source's size is shared again by weight."""
    sources = ["é", "B", "a", None, "😀", "Z"]
    rows = [(10 * k + j, "w " * (5 + 3 * j + 40 * (k == 2)), s) for k, s in enumerate(sources) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in sources}
    order = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    left, weight, target = 1.5 * sum(sizes.values()), dict(zip(order, [3, 1, 2, 3, 1, 2], strict=True)), {}
    while True:
        free = [s for s in order if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left = 1.5 * sum(sizes.values()) - sum(target.values())
    assert 0 < len(target) < 6
    for r in mixing.rates(docs).collect():
        assert r.source_size == sizes[r.source] and math.isclose(r.target, (target | share)[r.source], rel_tol=1e-9)


def test_mixing_frequent_sizes_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 7)
    monkeypatch.setattr(mixing, "BLOCK_SIZES", 4)
    rows = [(i, "w " * (5 if i % 3 else i % 40)) for i in range(600)]
    for broadcast in (0, 1000):
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
        got = mixing.rates(frame(spark, rows)).collect()
        assert sorted(r.doc_id for r in got) == list(range(600))
        for source in {r.source for r in got}:
            own = [r for r in got if r.source == source]
            assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= max(r.size for r in own)
            assert all(r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in own)


def test_mix_keeps_columns_that_clash(spark):
    docs = frame(spark, [(1, "a b"), (2, "c d e")]).withColumnsRenamed({"rest": "draw", "ids": "copies", "chunk": "nth"})
    assert mixing.apply_mix(docs).columns == docs.columns
    assert {r.draw for r in mixing.apply_mix(docs).collect()} == {"r"}


def test_mixing_dual_is_solved(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 90))) for i in range(400)]
    got = [r for r in mixing.rates(frame(spark, rows)).collect()]
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert math.isclose(sum(r.rate * r.size for r in own), own[0].target, rel_tol=1e-4)


def test_mixing_edges(spark):
    assert mixing.rates(frame(spark, [])).collect() == []
    assert [(r.size, r.copies * r.size) for r in mixing.rates(frame(spark, [(1, None), (1, None)])).collect()] == [(0, 0), (0, 0)]
    assert mixing.water_fill([10, 10, 100], [3, 1, 2], 180, 2) == [20, 20, 140]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", 1) for i, v, label in rows], "vec_id bigint, embedding array<float>, label int, node string, n bigint").repartition(3)


def test_embedding_links_are_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        v = rng.standard_normal(16)
        rows.append((len(rows), v, i % 3))
        for _ in range(i % 4):
            rows.append((len(rows), v + rng.standard_normal(16) * 0.08, i % 3))
    hub = rng.standard_normal(16)
    rows += [(len(rows) + k, hub + rng.standard_normal(16) * 0.03, 1) for k in range(120)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    good = [(i, np.array(v) / np.linalg.norm(v), label) for i, v, label in rows]
    bad = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, rows[0][1], None), (5004, [None] + rows[0][1][1:], 0), (5005, [1.0], 0), (5006, [], 1)]
    twice = [(6000, rows[0][1], 0), (6000, rows[0][1], 0)]
    good += [(6000, good[0][1], 0)]
    links = [(good[a][0], good[b][0]) for a in range(len(good)) for b in range(a) if good[a][2] == good[b][2] and good[a][1] @ good[b][1] >= 0.93]
    root = union_find([g[0] for g in good], links)
    count = Counter(x for pair in links for x in pair)
    got = embed_dedup.near_duplicates(vectors(spark, rows + bad + twice)).collect()
    assert len(got) == len(rows) + len(bad) + 2
    found = sum(r.n_links for r in got if r.vec_id < 5000)
    extra = count[6000]  # 6000 comes twice
    assert found >= 0.98 * sum(count[r[0]] for r in rows) and found <= sum(count[r[0]] for r in rows) + extra
    assert sum(r.component_id == root.get(r.vec_id, r.vec_id) for r in got) >= 0.98 * len(got)
    assert all(r.n_links == 0 and r.kept and r.component_id == r.vec_id for r in got if 5000 <= r.vec_id < 6000)
    assert embed_dedup.near_duplicates(vectors(spark, [])).collect() == []


def test_embedding_tiles_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "MAX_SHARD", 40)
    rng = np.random.default_rng(8)
    base = rng.standard_normal(8)
    rows = [(i, [float(x) for x in base + rng.standard_normal(8) * 0.02], 1) for i in range(150)]
    got = embed_dedup.near_duplicates(vectors(spark, rows)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.n_links for r in got) >= 0.95 * 150 * 149


def plain_links(rows, threshold=0.93):
    unit = [(i, np.array(v) / np.linalg.norm(v), label) for i, v, label in rows]
    links = [(x[0], y[0]) for k, x in enumerate(unit) for y in unit[:k] if x[2] == y[2] and x[1] @ y[1] >= threshold]
    return Counter(x for pair in links for x in pair), union_find([r[0] for r in rows], links)


def near_rows(seed, groups, size, noise):
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        base = rng.standard_normal(8)
        rows += [(len(rows) + k, [float(np.float32(x)) for x in base + rng.standard_normal(8) * noise], g % 2) for k in range(size)]
    return rows


def test_embedding_links_lead_over_shards(spark, monkeypatch):
    """With one home each, links between shards are found over the united lists, and none is counted twice."""
    monkeypatch.setattr(embed_dedup, "SHARD_ROWS", 12)
    monkeypatch.setattr(embed_dedup, "TARGET_RECALL", 0.0)
    rows = near_rows(3, 8, 40, 0.12)
    count, _ = plain_links(rows)
    got = {}
    for overlap in (1, 2, 3):
        monkeypatch.setattr(embed_dedup, "OVERLAP", overlap)
        out = embed_dedup.near_duplicates(vectors(spark, rows)).collect()
        assert all(r.n_links <= count[r.vec_id] for r in out)
        got[overlap] = sum(r.n_links for r in out) / sum(count.values())
    assert got[2] >= 0.9 and got[3] >= 0.97
    nodes = embed_dedup.numbered(embed_dedup.cut(embed_dedup.rows_of(vectors(spark, rows), "vec_id", "embedding", "label")))[1]
    found, asked = embed_dedup.graph_links(nodes, 0.93, 2)
    assert found.where(f"kind = {embed_dedup._CROSS}").count() > 0
    assert embed_dedup.audit(nodes, found, asked, 0.93) >= 0.9
    assert embed_dedup.audit(nodes, found.where("kind = 0"), asked, 0.93) == 0
    assert embed_dedup.audit(nodes, found, asked.limit(0), 0.93) is None


def test_embedding_links_that_no_draw_has_are_still_found(spark, monkeypatch):
    """Recall that can't be measured is not taken for good: all pairs are compared."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i // 2] + rng.normal(size=16) * 0.02 * (i % 2)).tolist(), i % 4 // 2) for i in range(120)]
    expected = sorted((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_duplicates(vectors(spark, rows)).collect())
    assert sum(n for _, n, _ in expected) == 120
    real = embed_dedup.graph_links

    def blind(*args):
        found, asked = real(*args)
        return found.limit(0), asked.limit(0)

    monkeypatch.setattr(embed_dedup, "graph_links", blind)
    got = embed_dedup.near_duplicates(vectors(spark, rows)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == expected


@pytest.mark.parametrize("largest", [4096, 40])
def test_embedding_falls_back_to_all_pairs(spark, monkeypatch, largest):
    monkeypatch.setattr(embed_dedup, "MAX_SHARD", largest)
    monkeypatch.setattr(embed_dedup, "TARGET_RECALL", 2.0)
    monkeypatch.setattr(embed_dedup, "LAST_OVERLAP", embed_dedup.OVERLAP)
    rows = near_rows(5, 5, 30, 0.2)
    count, root = plain_links(rows)
    got = embed_dedup.near_duplicates(vectors(spark, rows + [(900, rows[0][1], 0)])).collect()
    assert count.total() > 0
    same = {900, 0, *(r[0] for r in rows if plain_links([rows[0], r])[0])}
    for r in got:
        assert r.n_links == (count[r.vec_id] if r.vec_id < 900 else count[0]) + (r.vec_id in same)
        assert r.component_id == root.get(r.vec_id, root[0])


def test_lm_base_and_model(spark):
    rng = np.random.default_rng(2)
    tongues = [[f"{p}{i}" for i in range(40)] for p in "abcd"]
    rows = [(i, " ".join(rng.choice(tongues[i % 4], 80))) for i in range(600)] + [(700, None), (701, "Never Seen"), (702, "")]
    got = {r.doc_id: r for r in lm.score(frame(spark, rows)).collect()}
    tokens = {i: [*words_of(t, lower=True), None] for i, t in rows}
    held = {i: crc32(str(i).encode()) % 10 == 0 for i in tokens}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.05 * sum(r.n_tokens for r in out)
    assert lm.score(frame(spark, [])).collect() == []


def test_lm_is_a_distribution_and_gradients_are_right():
    net = lm.Network(np.array([5.0, 9, 4, 3, 1] * 30))
    rng = np.random.default_rng(1)
    h = rng.standard_normal((3, lm.HIDDEN)).astype(np.float32)
    for row in h:
        logp = net.predict(np.repeat(row[None], net.n, 0), np.arange(net.n))
        assert math.isclose(np.exp(logp).sum(), 1, rel_tol=1e-4)
    x, y = rng.integers(0, net.n, (4, 5)), rng.integers(0, net.n, (4, 5))
    new = np.zeros((4, 5), bool)
    new[2, 1] = True

    def loss(flat):
        other = lm.Network(np.array([5.0, 9, 4, 3, 1] * 30))
        for k in net.NAMES:
            setattr(other, k, getattr(other, k).astype(np.float64))
        at = 0
        for k in net.NAMES:
            size = getattr(other, k).size
            setattr(other, k, flat[at : at + size].reshape(getattr(other, k).shape))
            at += size
        state, total = np.zeros((5, lm.HIDDEN)), 0.0
        for t in range(4):
            state = other.step(np.where(new[t][:, None], 0.0, state), x[t])
            total -= other.predict(state, y[t]).sum()
        return total / y.size

    flat = net.flat().astype(np.float64)
    moved = {}
    trainer = lm.Trainer(net)
    trainer._move = lambda name, grad, rows=None: moved.__setitem__(name, (grad, ... if rows is None else (slice(None), rows)))
    trainer.window(np.zeros((5, lm.HIDDEN), np.float32), x, y, new)
    at = 0
    for k in net.NAMES:
        full = np.zeros_like(getattr(net, k), dtype=np.float64)
        full[moved[k][1]] = moved[k][0]
        for j in rng.integers(0, full.size, 6):
            up, down = flat.copy(), flat.copy()
            up[at + j] += 1e-4
            down[at + j] -= 1e-4
            assert abs((loss(up) - loss(down)) / 2e-4 - full.ravel()[j]) < 2e-4
        at += full.size


def test_lm_has_24_state_units_in_every_parameter():
    net = lm.Network(np.array([5.0, 9, 4, 3]))
    # three gates of 24 units; the output has a bias beside them
    assert (net.inp.shape, net.rec.shape, net.cls.shape[1], net.out.shape[1]) == ((3, 4, 24), (3, 24, 24), 25, 25)


def test_lm_vocabulary_grows_with_the_corpus(spark):
    """A vocabulary of all words above a count, known to be larger than the fixed part, in classes that cover it."""
    words = [f"w{i}" for i in range(3000)]
    docs = frame(spark, [(i, " ".join(words[i % 3 :: 3])) for i in range(240)])
    chunks, counter = lm.chunked(docs, "doc_id", "text", lm.CHUNK_BYTES), lm.Counter(lm.bucket_bits(spark))
    sent = chunks.groupBy("chunk").applyInArrow(lambda k, t: counter.send(k, t), lm.PACKET)
    vocab = lm.vocabulary(sent.groupBy("bucket").applyInArrow(lambda k, t: lm.total(k, t), lm.PACKET))
    assert len(vocab.hashes) == 3001
    net = lm.Network(vocab.all_counts)
    h = np.random.default_rng(1).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    assert math.isclose(np.exp(net.predict(np.repeat(h, net.n, 0), np.arange(net.n))).sum(), 1, rel_tol=1e-4)


def test_lm_trains_every_token(monkeypatch):
    end = np.array([lm.END])
    vocab, trained, window = lm.Vocabulary(end, np.array([9]), 9, 1), [], lm.Trainer.window
    monkeypatch.setattr(lm.Trainer, "window", lambda self, h, x, y, new: (trained.append((y.size, int(new.sum()))), window(self, h, x, y, new))[1])
    sizes = [lm.STREAMS * lm.WINDOW * lm.STREAM_WINDOWS + 255, 5003]
    texts = [(np.repeat(end, n), np.array([0, n - 2, n])) for n in sizes]
    assert lm.train_texts(lm.Network(vocab.all_counts), vocab, iter(texts)) == sum(sizes)
    assert [sum(x) for x in zip(*trained, strict=True)] == [sum(sizes), 4]
    assert lm.train_texts(lm.Network(vocab.all_counts), vocab, iter([(end, np.array([0, 1]))])) == 1


def test_lm_carries_state_through_whole_documents():
    net = lm.Network(np.array([5.0, 9, 4, 3]))
    ids, first = np.array([1, 2, 3, 1, 2, 2, 1]), np.array([0, 5, 7])
    whole = lm.document_scores(net, ids, first, 1, block=2)
    for k in range(2):
        h, before, total = np.zeros((1, lm.HIDDEN), np.float32), 1, 0.0
        for w in ids[first[k] : first[k + 1]]:
            h = net.step(h, np.array([before]))
            total += net.predict(h, np.array([w]))[0]
            before = w
        assert math.isclose(whole[k], total / math.log(10), rel_tol=1e-5)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = queries.table(spark, sf_dir, "documents")
    names, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        sizes.append(len(rows))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
            docs = spark.createDataFrame(rows, docs.schema)
    assert sizes[1] < sizes[0] and sizes[2] <= sizes[1] and sizes[3] <= sizes[2] and sizes[5] == sizes[4]
    assert all(len(r.ids) == r.n_tokens for r in rows)


def test_pipeline_is_what_plain_versions_say(spark, sf_dir):
    """Each stage on what its predecessor kept, with null, empty and repeated rows and a long text among the documents."""
    import corpus_pipeline

    from .test_dedup import gram_set, plain_classes, plain_lines

    docs = queries.table(spark, sf_dir, "documents")
    some = docs.orderBy("doc_id").first().asDict()
    long = " ".join(f"w{i}x{i % 977}" for i in range(60_000))
    extra = [{**some, "doc_id": 900_000 + i, "text": text} for i, text in enumerate([None, "", "few words", long, long])]
    docs = spark.createDataFrame([r.asDict() for r in docs.collect()] + extra + [extra[3]], docs.schema)
    stages, kept = dict(corpus_pipeline.STAGES), {}
    for name in ("quality rules", "line dedup", "n-gram Jaccard join", "mixing to target weights"):
        rows = stages[name](spark, docs, sf_dir).collect()
        kept[name], docs = [(r.doc_id, r.text) for r in rows], spark.createDataFrame(rows, docs.schema)
    judged = {r.doc_id for r in quality.judge(queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels")).where("kept").collect()}
    assert {i for i, _ in kept["quality rules"] if i < 900_000} == judged and not {900_000, 900_001, 900_002} & {i for i, _ in kept["quality rules"]}
    plain = [(i, text) for i, n, gone, _, text in plain_lines(kept["quality rules"], 3, 50) if n == 0 or gone < n]
    assert sorted(kept["line dedup"]) == sorted(plain)
    first = {c for _, n, c in plain_classes(kept["line dedup"], 5, 80) if n} | {i for i, t in kept["line dedup"] if not gram_set(t, 5)}
    assert {i for i, _ in kept["n-gram Jaccard join"]} == first and len(kept["n-gram Jaccard join"]) == len(first)
    times = Counter(kept["mixing to target weights"])
    assert max(times.values()) <= 2 and set(times) <= set(kept["n-gram Jaccard join"])
    coded = stages["byte-level BPE encoding"](spark, docs, sf_dir).collect()
    codec = queries.codec()
    assert Counter((r.doc_id, codec.decode(r.ids)) for r in coded) == Counter((i, t.encode()) for i, t in kept["mixing to target weights"])


def test_pipeline_of_an_empty_table(spark, sf_dir):
    import corpus_pipeline

    docs = queries.table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.collect() == [] and "ids" in docs.columns


BLANK_RUNS = [" ", "\t", "\n", "\r\n", "\u00a0", "\u3000 ", " \n\t"]


def test_bpe_long_blanks_are_the_pattern_rule(codec):
    for blank in BLANK_RUNS:
        for n in (bpe.LONG_BLANKS - 1, bpe.LONG_BLANKS, 3 * bpe.LONG_BLANKS):
            for before, after in (("", ""), ("a b", "c d"), ("x", ", y"), ("'s", "\n"), ("5", "7"), ("", "z")):
                text = before + blank * n + after
                assert codec.encode(text) == codec.encoding.encode_ordinary(text)


@pytest.mark.parametrize("n", [1_000_000, 2_000_000, 10_000_000])
def test_bpe_millions_of_blanks(codec, n):
    for blank in " \t\n":
        words = "ordinary words " * 200
        for text in (blank * n, words + "end" + blank * n + words):
            ids = codec.encode(text)
            assert codec.decode(ids) == text.encode()
        # what stands around is encoded as ever: the run leaves its last character to what follows
        head, tail = codec.encoding.encode_ordinary(words + "end"), codec.encoding.encode_ordinary(blank + words)
        assert ids[: len(head)] == head and ids[-len(tail) :] == tail
        assert ids[len(head) : -len(tail)] == codec.encoding._encode_single_piece(blank * (n - 1))


def test_bpe_millions_of_blanks_on_spark_and_empty_table(spark, codec):
    text = " " * 1_000_000
    got = bpe.round_trip_digests(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), codec).collect()
    assert got[0].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.round_trip_digests(empty, codec).collect() == bpe.encode(empty, codec).collect() == []


def test_url_filter_long_hosts(spark):
    import time

    host = "a." * 500_000 + "example.org"
    began = time.time()
    assert url_filter._suffixes(host, 2, 20) == ["org", "example.org"] and url_filter._suffixes(".", 3, 9) == ["", "."] and url_filter._suffixes("", 3, 9) == []
    got = list(url_filter._points(2, 20)([pa.record_batch({"host": [host], "path": ["/es/x"]})]))[0]
    assert got.num_rows == 2 and time.time() - began < 1
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block")], "host string, path string, action string")
    pages = spark.createDataFrame([(1, f"http://{host}/es/x"), (2, None), (3, "no scheme")], "page_id bigint, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()} == {1: ("example.org/es/", "block"), 2: (None, "allow"), 3: (None, "allow")}
