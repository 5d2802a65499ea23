"""Small corpora with the cases that operators must bear, and plain versions to hold results against."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, chunk string, ids string, rest string"


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, nulls, empties, repeated rows, a long text; extra columns with clashing names."""
    rng = random.Random(seed)
    words = ["the", "of", "é", "日本", "Was", "x1", "don't", "a", "ring", "sea", "house", "tree", "🙂", "stone", "I"]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [line(30) for _ in range(3)]
    texts = []
    for i in range(n):
        kind = i % 10
        if kind == 0 and texts:
            texts.append(rng.choice(texts))
        elif kind == 1 and texts and texts[-1]:
            parts = texts[-1].split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            texts.append(" ".join(parts))
        elif kind == 2:
            texts.append("\n".join([line(5), rng.choice(shared), shared[0], line(4), " \t", line(7)]))
        elif kind == 3:
            texts.append(rng.choice(["", " \n\t ", "one", "two words", None]))
        else:
            texts.append("\n".join(line(rng.randint(1, 40)) for _ in range(rng.randint(1, 6))))
    texts.append(" ".join(line(50) for _ in range(80)))
    ids = [i * 3 for i in range(len(texts))]
    rows = list(zip(ids, texts, strict=True))
    rows += [rows[4], rows[5], rows[5]]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    full = [(i, t, "en", None if i is None or i % 7 == 0 else f"s{i % 5}", len(t or ""), "c", "i", "r") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def words_of(text, lower=False):
    raw = (text or "").encode()
    if lower:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    return raw.split()


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
