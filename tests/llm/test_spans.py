"""Decontamination, phrase mining and the fill-in-middle transformation against plain versions."""

import hashlib
import random
import re
from collections import Counter

import pytest

from phishscreen.llm import contamination, infill, phrases, queries

from .helpers import corpus, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain_hits(text, items, width=10):
    """(n_words, which words are hit, sorted item ids)."""
    ws, named = plain_words(text), set()
    gone = [False] * len(ws)
    for item, said in items:
        own = plain_words(said)
        k = min(width, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for s in range(len(ws) - k + 1):
            if own and tuple(ws[s : s + k]) in windows:
                gone[s : s + k] = [True] * k
                if item is not None:
                    named.add(str(item))
    return len(ws), gone, sorted(named)


def bench_rows(rows):
    """Items that share words with the documents: whole passages, short ones, nulls, repeats, and one phrase in all of them."""
    long = [t for _, t in rows if t and len(t.split()) > 40]
    cuts = [" ".join(t.split()[3:27]) for t in long[:4]]
    out = [(i, c.upper() + " and other words that stand nowhere else") for i, c in enumerate(cuts)]
    out += [(10, "two words"), (11, "One."), (12, None), (13, " .,; "), (None, cuts[1]), (2, cuts[0]), (2, cuts[0]), (100, " ".join(long[0].split()[:12]))]
    return out


@pytest.mark.parametrize("small", [True, False])
def test_decontamination_is_brute_force(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(contamination, "BROADCAST_BYTES", 0)
    rows = [*corpus(4), (7, None), (None, "two words"), (None, None), (8, "ONE!two words;two words")]
    items = bench_rows(rows)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, key string")
    got = contamination.report(frame(spark, rows), bench).collect()
    want = []
    for i, t in rows:
        n, gone, named = plain_hits(t, items)
        edges = [x for x in range(n + 1) if (x < n and gone[x]) != (x > 0 and gone[x - 1])]
        want.append((i, n, sum(gone), list(zip(edges[::2], edges[1::2], strict=True)), named))
    assert any(len(w[4]) > 1 for w in want) and any(w[2] == 0 < w[1] for w in want)
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], [tuple(x) for x in r["spans"]], r["items"]) for r in got], key=repr) == sorted(want, key=repr)


def test_decontamination_removes_documents_or_spans(spark):
    passage = "a passage of some test item that is ten words long"
    docs = [(1, f"Before, {passage}. After"), (2, "clean text;\nas it was "), (3, passage), (3, passage), (4, None), (5, f"{passage}, {passage.upper()}! end")]
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    left = contamination.remove(frame(spark, docs), bench)
    assert left.columns == frame(spark, docs).columns
    # a passage of eleven words has two windows of ten
    assert sorted([(r.doc_id, r.text) for r in left.collect()], key=repr) == [(1, "Before. After"), (2, "clean text;\nas it was "), (3, ""), (3, ""), (4, None), (5, "! end")]
    assert sorted(r.doc_id for r in contamination.remove(frame(spark, docs), bench, "documents").collect()) == [2, 4]


def test_decontamination_of_empty_tables_and_a_long_text(spark):
    docs, bench = "doc_id bigint, text string", "item_id bigint, text string"
    none, items = spark.createDataFrame([], docs), spark.createDataFrame([(1, "the words of one item stand here in a row now")], bench)
    assert contamination.report(none, items).collect() == []
    text = "the words of one item stand here in a row now " * 20_000
    got = contamination.report(spark.createDataFrame([(1, text)], docs), items).collect()[0]
    assert (got["n_words"], got["n_hit"], got["items"], [tuple(x) for x in got["spans"]]) == (220_000, 220_000, ["1"], [(0, 220_000)])
    got = contamination.report(spark.createDataFrame([(1, "a b"), (1, None)], docs), spark.createDataFrame([], bench)).collect()
    assert sorted((r["n_words"], r["n_hit"], r["items"]) for r in got) == [(0, 0, []), (2, 0, [])]


def test_decontamination_is_native(spark):
    from phishscreen.llm.queries import table

    sf = "/root/testdata/sf0.001"
    out = contamination.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert plan.split("== Physical Plan ==")[1].count("FileScan") == 3  # documents once, the items for hashes and for names


def plain_phrases(rows, least, most=5):
    grams, total = {}, Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(ws)
            own = grams.setdefault(lang, Counter())
            for k in range(1, most + 1):
                own.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in grams.items():
        kept = {p: f for p, f in own.items() if f >= least}
        for p, a in kept.items():
            if len(p) < 2:
                continue
            score, k = min((1000 * a * total[lang] // (kept[p[:k]] * kept[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and f >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, f in kept.items())
            if not inside:
                out.append((lang, " ".join(p), a, kept[p[:k]], kept[p[k:]], total[lang], score))
    return sorted(out)


@pytest.mark.parametrize("hot", [1, 20, 1 << 20])
def test_phrases_are_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 3000)
    rng, words = random.Random(hot), ["the", "The", "of", "é", "日本", "x1", "a b", "ring", "sea", "house"]
    texts = []
    for i in range(120):
        parts = [rng.choice(["new york city hall is", "of the sea"]) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 60))]
        texts.append((i, rng.choice(["en", "fr", None]), "".join(p + rng.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for p in parts)))
    texts += [(200, "en", None), (201, None, ""), (202, "en", " \n.,"), (5, *texts[5][1:]), (5, *texts[5][1:]), (None, "en", texts[7][2])]
    docs = spark.createDataFrame([(i, lang, t, "x", 1) for i, lang, t in texts], "doc_id bigint, lang string, text string, phrase string, n bigint").repartition(3)
    got = phrases.collocations(docs, least=12, hot=hot).collect()
    want = plain_phrases([(lang or "und", t) for _, lang, t in texts], 12)
    assert any(len(w[1].split(" ")) == 5 for w in want) and len({w[0] for w in want}) == 3
    assert sorted(tuple(r[c] for c in ("lang", "phrase", "a", "l", "r", "n", "score")) for r in got) == want


def test_phrases_with_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(phrases.Hasher, "spans", lambda self, data, starts, ends: (ends - starts).astype("uint64") << 60)
    docs = [(i, "cat dog cow. cat dog hen sits") for i in range(5)]
    got = phrases.collocations(frame(spark, docs), least=5).collect()
    assert sorted((r.phrase, r.a) for r in got) == [("cat dog", 10), ("cat dog cow", 5), ("cat dog hen sits", 5)]


def test_top_phrases_by_score_then_count_then_bytes(spark):
    rng = random.Random(3)
    rows = [(lang, f"p{i} é", rng.randint(1, 3), rng.randint(1, 4)) for lang in ("en", "fr") for i in range(300)]
    found = spark.createDataFrame(rows, "lang string, phrase string, a bigint, score bigint")
    for n in (1, 37, 1000):
        want = {(lang, p, i + 1) for lang in ("en", "fr") for i, (_, p, _, _) in enumerate(sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[3], -r[2], r[1].encode()))[:n])}
        assert {(r.lang, r.phrase, r["rank"]) for r in phrases.top(found, n).collect()} == want


def test_phrases_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert phrases.collocations(docs).collect() == []
    rare = spark.createDataFrame([(1, "a b c", "en")], "doc_id bigint, text string, lang string")
    assert phrases.top(phrases.collocations(rare)).collect() == []


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    n, h = len(units), hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None), text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return (doc_id, n, form, len(p), len(m)), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize("frame_bytes", [8, 50, 1 << 16])
def test_fill_in_middle_is_brute_force(spark, frame_bytes):
    rows = [*corpus(6), (None, "no id é"), (None, None), (500, "a <P> b"), (501, "x" * 45 + "<M>"), (502, "abc" * 60), (503, "日本🙂" * 30), (504, "a\n\x00b"), (505, "<P"), (506, "P><S")]
    rows += [(600 + i, f"text number {i}, é") for i in range(40)]
    framed = infill.frames(frame(spark, rows), frame_bytes=frame_bytes)
    made = infill.transform(framed, frame_bytes=frame_bytes)
    want = [plain_infill(i, t) for i, t in rows]
    assert {w[0][2] for w in want} == {"plain", "psm", "spm"}
    got = infill.texts(made).collect()
    assert sorted([((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars), r.text) for r in got], key=repr) == sorted(want, key=repr)
    said = infill.digests(made).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted([(r.doc_id, r.output_sha256, r.restored_sha256) for r in said], key=repr) == sorted([(i, sha(plain_infill(i, t)[1]), sha(t)) for i, t in rows], key=repr)
    back = infill.texts(framed)
    assert set(back.columns) == set(frame(spark, rows).columns)
    assert sorted([(r.doc_id, r.text, r.ids) for r in back.collect()], key=repr) == sorted([(i, t or "", "i") for i, t in rows], key=repr)


def test_fill_in_middle_enters_one_frame(spark):
    import zstandard

    text = ("word " * 50_000 + "日本" * 1000).encode()
    writer = infill.Writer(1000)
    writer.write(text)
    frames = [dict(zip(("units", "chars", "start", "within", "blob"), f, strict=True)) for f in writer.end()]
    reader, entered = infill.Reader(frames, writer.units, writer.chars, writer.bytes, zstandard.ZstdDecompressor()), []
    read = reader.frame
    reader.frame = lambda i: entered.append(i) or read(i)
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text.decode())
    for c in (0, 1, 77_777, 100_500, len(units) - 1, len(units)):
        entered.clear()
        before = "".join(units[:c])
        assert reader.locate(c) == (len(before.encode()), len(before)) and len(entered) <= 1
    assert b"".join(reader.stream(999, 2001)) == text[999:2001]


def test_fill_in_middle_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert infill.digests(infill.transform(infill.frames(docs))).collect() == []


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_collocations", "op13_fill_in_middle"])
def test_queries_return_their_columns(spark, name):
    out = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert name in queries.oracle_sql()
    out.collect()
