import hashlib
from collections import Counter

import pytest

from phishscreen.llm import line_dedup, ngram_join, substring_dedup, suffix_dedup

from .helpers import corpus, frame, ordered, union_find, words_of

EMPTY = []


def runs(flags):
    return sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))


def plain_words(rows, width):
    seen, out = set(), []
    for i, text in ordered(rows):
        words = words_of(text)
        gone = [False] * len(words)
        for s in range(len(words) - width + 1):
            window = tuple(words[s : s + width])
            if window in seen:
                gone[s : s + width] = [True] * width
            seen.add(window)
        out.append((i, len(words), sum(gone), runs(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [2, 5, 20])
def test_substring_dedup_is_brute_force(spark, width):
    rows = corpus(width)
    got = substring_dedup.dedup(frame(spark, rows), width).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, len(r.spans), r.kept_text) for r in got], key=str) == plain_words(rows, width)


def test_substring_dedup_first_is_smallest_id_with_null_smallest(spark):
    text = " ".join(f"w{i}" for i in range(25))
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup(frame(spark, [(5, text), (2, text), (None, text)])).collect()}
    assert got == {None: 0, 2: 25, 5: 25}


class WeakHasher(substring_dedup.Hasher):
    """Takes many different windows for equal."""

    def windows(self, values, width):
        return super().windows(values, width) >> 59 << 59


@pytest.mark.parametrize("lines", [False, True])
def test_windows_with_one_hash_are_told_apart(spark, lines):
    rows, bits = corpus(2), substring_dedup.bucket_bits(spark)
    by = line_dedup.LineRuns(3, 45, bits) if lines else substring_dedup.Windows(20, bits)
    by.hasher = WeakHasher()
    got = substring_dedup.exchange(frame(spark, rows), by, (line_dedup if lines else substring_dedup).RESULT, "doc_id", "text").collect()
    if lines:
        assert sorted([tuple(r) for r in got], key=str) == plain_lines(rows, 3, 45)
    else:
        assert sorted([(r.doc_id, r.n_words, r.n_removed, len(r.spans), r.kept_text) for r in got], key=str) == plain_words(rows, 20)


def plain_bytes(rows, length):
    count = Counter()
    for _, text in rows:
        raw = (text or "").encode()
        count.update(raw[s : s + length] for s in range(len(raw) - length + 1))
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            if count[raw[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        out.append((i, len(raw), sum(gone), runs(gone), bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [3, 20, 60, 200])
def test_suffix_dedup_is_brute_force(spark, length):
    rows = corpus(length, 40)
    got = suffix_dedup.dedup(frame(spark, rows), length).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got], key=str) == plain_bytes(rows, length)


def test_covers_have_every_shift():
    for v, members in suffix_dedup.COVERS.items():
        assert {(a - b) % v for a in members for b in members} == set(range(v))


def test_suffix_dedup_overlapping_repeat_in_one_text(spark):
    got = suffix_dedup.dedup(frame(spark, [(1, "a" * 300), (2, "b" * 200)])).collect()
    assert {r.doc_id: (r.n_removed, len(r.spans)) for r in got} == {1: (300, 1), 2: (0, 0)}


def plain_lines(rows, min_lines, long_words):
    seen, out = set(), []
    for i, text in ordered(rows):
        raw = (text or "").encode().split(b"\n")
        lines = [(b" ".join([x]).strip(b" \t\x0b\x0c\r"), k) for k, x in enumerate(raw) if x.split()]
        gone = [False] * len(lines)
        for s in range(len(lines)):
            held = lambda a, b: sum(len(x.split()) for x, _ in lines[a:b])
            windows = [tuple(x for x, _ in lines[s : s + min_lines])] if s + min_lines <= len(lines) else []
            for k in range(1, min_lines):
                if s + k <= len(lines) and held(s, s + k) >= long_words > max(held(s + 1, s + k), held(s, s + k - 1)):
                    windows.append(tuple(x for x, _ in lines[s : s + k]))
            for w in windows:
                if w in seen:
                    gone[s : s + len(w)] = [True] * len(w)
                seen.add(w)
        at, state, kept = {k: g for (_, k), g in zip(lines, gone, strict=True)}, False, []
        for k, x in enumerate(raw):
            state = at.get(k, state)
            if not state:
                kept.append(x)
        out.append((i, len(lines), sum(gone), runs(gone), b"\n".join(kept).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("min_lines", "long_words"), [(1, 50), (2, 25), (3, 20), (3, 45), (4, 60)])
def test_line_dedup_is_brute_force(spark, min_lines, long_words):
    rows = corpus(min_lines)
    got = line_dedup.dedup(frame(spark, rows), min_lines, long_words).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_lines(rows, min_lines, long_words)


def test_line_dedup_takes_two_lines_that_are_long_together(spark):
    first, second = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, f"{first}\n{second}"), (2, f"x\n{first}\n{second}\ny"), (3, f"{first}\nz"), (4, f"{second}\n{first}")]
    got = {r.doc_id: (r.n_removed, r.n_runs, r.kept_text) for r in line_dedup.dedup(frame(spark, rows)).collect()}
    assert got == {1: (0, 0, rows[0][1]), 2: (2, 1, "x\ny"), 3: (0, 0, rows[2][1]), 4: (0, 0, rows[3][1])}


def test_line_dedup_docs_keeps_columns_and_drops_emptied_rows(spark):
    text = "a b\nc d\ne f"
    docs = frame(spark, [(1, text), (2, text), (3, text + "\nnew"), (4, None)])
    out = line_dedup.dedup_docs(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars, r.rest) for r in out.collect()} == {1: (text, 11, "r"), 3: ("new", 3, "r"), 4: ("", 0, "r")}


def gram_set(text, n):
    words = words_of(text, lower=True)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def plain_classes(rows, n, percent):
    sets = [(i, gram_set(t, n)) for i, t in rows]
    links = []
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                links.append((a, b))
    root = union_find(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root[k]] = min(least.get(root[k], i), i)
    return sorted((i, len(s), least[root[k]]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 60), (2, 50)])
def test_ngram_join_is_brute_force(spark, n, percent):
    rows = corpus(n * percent, 80)
    got = ngram_join.classes(frame(spark, rows), n, percent).collect()
    assert sorted(tuple(r) for r in got) == plain_classes(rows, n, percent)


def test_ngram_join_large_group_of_near_copies(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(words[: 20 + k % 150] + [f"own{k}"] + words[21 + k % 150 :])) for k in range(150)]
    got = ngram_join.classes(frame(spark, rows), 4, 85).collect()
    assert sorted(tuple(r) for r in got) == plain_classes(rows, 4, 85)


def test_ngram_join_tells_sets_with_one_id_apart(spark, monkeypatch):
    """With ids of 5 bits nearly all sets share one; the second hash makes ids of their own."""
    plain = ngram_join.record_ids
    monkeypatch.setattr(ngram_join, "record_ids", lambda sets, edge: plain(sets, edge) >> 59)
    monkeypatch.setattr(ngram_join, "second_ids", lambda sets, edge: plain(sets, edge, ngram_join._SECOND))
    rows = corpus(3, 60)
    got = ngram_join.classes(frame(spark, rows), 4, 85).collect()
    assert sorted(tuple(r) for r in got) == plain_classes(rows, 4, 85)


def test_ngram_join_allocates_by_cost():
    import numpy as np

    rng = np.random.default_rng(2)
    sets, bands = np.sort(rng.integers(0, 1 << 63, 600).astype(np.uint64)) * np.uint64(2), ngram_join.Bands(80, 600)
    edge, band = np.array([0, 600]), bands.of(np.array([600]))
    none = np.zeros(1 << ngram_join.COST_BITS)
    _, sig, role = ngram_join.signatures(sets, edge, band, bands, True, none)
    probes = set(sig[role & ngram_join.PROBE > 0].tolist())
    assert len(probes) == bands.segments[band[0]]
    light = ngram_join.signatures(sets, edge, band, bands, True, None)
    dear = [s for s in light.tolist() if s in probes][-3:]
    costs = none.copy()
    costs[[s >> (64 - ngram_join.COST_BITS) for s in dear]] = 1e6
    _, sig, role = ngram_join.signatures(sets, edge, band, bands, True, costs)
    again = set(sig[role & ngram_join.PROBE > 0].tolist())
    # dear ones are skipped, others raised instead, and all are indexed as before
    assert not again & set(dear) and len(again) > len(probes) and set(dear) <= set(sig[role & ngram_join.INDEX > 0].tolist())


@pytest.mark.parametrize("tile", [512, 8])
def test_ngram_join_tiles_open_groups(spark, monkeypatch, tile):
    """Short sets share segments without an n-gram with all others of their band."""
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "WIDE_TILE", tile)
    rows = [(k, " ".join(f"w{k % 7}x{i}" for i in range(6 + k % 3)) + f" own{k % 50}") for k in range(140)]
    got = ngram_join.classes(frame(spark, rows), 1, 60).collect()
    assert sorted(tuple(r) for r in got) == plain_classes(rows, 1, 60)


def test_ngram_dedup_keeps_columns_that_clash(spark):
    docs = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f")]).withColumnsRenamed({"rest": "draw", "ids": "one", "chunk": "nth"})
    out = ngram_join.dedup_docs(docs)
    assert out.columns == docs.columns and [(r.doc_id, r.draw) for r in out.collect()] == [(1, "r")]


def test_ngram_join_compares_leaders_that_nobody_chose(spark, monkeypatch):
    """r1..r4 are linked with l, which leads their groups, but each has a nearer and heavier leader of its own."""
    words = [f"w{i}" for i in range(40)]
    texts = {"l": " ".join(words)} | {f"r{i}": " ".join([*words[:39], f"own{i}"]) for i in range(4)}
    texts |= {f"{c}{i}": " ".join(f"{c}{i}x{k}" for k in range(40)) for c in "cd" for i in range(4)}
    hasher, rec = ngram_join.Hasher(), {}
    for k, t in texts.items():
        data, off = ngram_join.utf8(ngram_join.pa.array([t.encode()], ngram_join.pa.binary()))
        rec[k] = int(ngram_join.record_ids(*ngram_join.record_sets(data, off, hasher, 1))[0])
    pairs = [(x.format(i), y.format(i), times) for i in range(4) for x, y, times in (("l", "r{}", 2), ("c{}", "r{}", 3), ("c{}", "d{}", 9))]
    found = [(g, 0, times, [rec[x], rec[y]], [True, True]) for g, (x, y, times) in enumerate(pairs)]
    found = spark.createDataFrame(found, "grp bigint, part bigint, times bigint, recs array<bigint>, probes array<boolean>")
    monkeypatch.setattr(ngram_join, "candidate_groups", lambda *_: found)
    rows = list(enumerate(texts.values()))
    got = ngram_join.classes(frame(spark, rows), 1, 85).collect()
    assert sorted(tuple(r) for r in got) == plain_classes(rows, 1, 85)


def test_parities_never_overstate_the_difference():
    import random

    import numpy as np

    rng = random.Random(3)
    for _ in range(200):
        common = {rng.getrandbits(64) for _ in range(rng.randint(0, 300))}
        x, y = (common | {rng.getrandbits(64) for _ in range(rng.randint(1, 200))} for _ in range(2))
        odd = [ngram_join.parities(np.array(sorted(s), np.uint64), np.array([0, len(s)]))[0] for s in (x, y)]
        assert ngram_join._apart(*odd) <= len(x ^ y)


def test_ngram_dedup_docs_keeps_one_of_each_group_and_all_empties(spark):
    text = "one two three four five six seven"
    out = ngram_join.dedup_docs(frame(spark, [(3, text), (1, text), (1, text), (2, "ONE two three four five six seven"), (9, None), (8, ""), (7, "else")]))
    assert sorted(r.doc_id for r in out.collect()) == [1, 7, 8, 9]


@pytest.mark.parametrize("run", [substring_dedup.dedup, suffix_dedup.dedup, line_dedup.dedup, line_dedup.dedup_docs, ngram_join.classes, ngram_join.dedup_docs])
def test_empty_table(spark, run):
    assert run(frame(spark, EMPTY)).collect() == []


def test_queries_digest_what_operators_return(spark, sf_dir):
    from phishscreen.llm import queries

    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").collect()]
    got = sorted(tuple(r) for r in queries.op2_substring_dedup(spark, sf_dir).collect())
    plain = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, _, t in plain_words(docs, 20)]
    assert got == sorted(plain)


def thue_morse(k):
    """A word of 2 ** k letters and the one with letters exchanged: any polynomial modulo 2 ** 64 takes them for equal."""
    x = "a"
    for _ in range(k):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_regular_words_are_told_apart(spark):
    x, y = thue_morse(10)
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{x} {tail}"), (2, f"{y} {tail}")]
    assert [r.n_removed for r in substring_dedup.dedup(frame(spark, rows)).collect()] == [0, 0]
    lines = [(i, "\n".join([word, "second line", "third line"])) for i, word in ((1, x), (2, y))]
    assert [r.n_removed for r in line_dedup.dedup(frame(spark, lines)).collect()] == [0, 0]
    near = [(1, f"{x} p q r"), (2, f"{y} p q r")]
    assert sorted(r.component_id for r in ngram_join.classes(frame(spark, near), n=4, percent=85).collect()) == [1, 2]
    a, b = thue_morse(8)
    assert [r.n_removed for r in suffix_dedup.dedup(frame(spark, [(1, a), (2, b)])).collect()] == plain_bytes_removed([a, b])


def plain_bytes_removed(texts, length=200):
    raw, seen = [t.encode() for t in texts], Counter()
    for t in raw:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(sum(gone))
    return out


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 20, 33])
def test_window_hashes_are_equal_where_windows_are(width):
    import numpy as np

    rng = np.random.default_rng(width)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    for got in (ngram_join.Hasher().byte_windows(data, width), ngram_join.Hasher().windows(data.astype(np.uint64), width)):
        raw = data.tobytes()
        windows = [raw[i : i + width] for i in range(len(raw) - width + 1)]
        assert len(got) == len(windows) and len(set(got.tolist())) == len(set(windows)) == len(set(zip(got.tolist(), windows)))


def test_span_hashes_are_equal_where_spans_are():
    import numpy as np

    data = np.frombuffer(b"ab" * 300, np.uint8)
    starts = np.arange(0, 400)
    for size in (0, 1, 7, 8, 9, 16, 64, 65, 130):
        got = ngram_join.Hasher().spans(data, starts, starts + size)
        assert len(set(got.tolist())) == (2 if size else 1)
