"""Operator 2 against brute force over all windows, with small parameters and with the real ones."""

import hashlib
import random
from collections import Counter

import pytest

from tessera.llm import repeats


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return out


def brute_shared(texts, length):
    """The words of each text in runs of ``length`` words that another text has too."""
    owners = {}
    words = [t.split() for t in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - length + 1):
            owners.setdefault(tuple(w[k : k + length]), set()).add(i)
    out = []
    for w in words:
        gone = bytearray(len(w))
        for k in range(len(w) - length + 1):
            if len(owners[tuple(w[k : k + length])]) > 1:
                gone[k : k + length] = b"\1" * length
        out.append(sum(gone))
    return out


def corpus(rng, unit, n):
    letters = "ab cdé"
    fresh = lambda k: "".join(rng.choices(letters, k=k))
    shared = [fresh(unit * k // 2) for k in (2, 3, 4, 6)]
    texts = [None, "", "a", shared[0], shared[0][:unit], "a" * unit * 7, "xyz " * unit * 3, shared[2], shared[2]]
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(fresh(rng.randrange(0, 2 * unit)))
            s = rng.choice(shared)
            cut = rng.randrange(0, unit)
            parts.append(rng.choice([s, s[cut:], s[: len(s) - cut], "b" * rng.randrange(0, 3 * unit), ""]))
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize(("length", "gram", "most", "n"), [(20, 8, 10**6, 80), (20, 12, 6, 80), (30, 10, 2, 60), (400, 200, 4096, 40), (400, 200, 8, 40)])
def test_repeats(spark, length, gram, most, n):
    rng = random.Random(length + most)
    texts = corpus(rng, length, n)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[20], "x", 1), (21, texts[21], "x", 1), (21, texts[22] + "!", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, packed string, n_bytes int")
    passage = repeats.Symbols(7, 4, True)
    got = Counter(tuple(r) for r in repeats.remove_repeats(docs, length, gram, most, passage).collect())
    raw = [(r[1] or "").encode() for r in rows]
    want = Counter((r[0], *x, shared) for r, x, shared in zip(rows, brute(raw, length), brute_shared(raw, 7)))
    assert got == want
    assert sum(x[2] for x in want) > 0 and sum(x[5] for x in want) > 0


@pytest.mark.parametrize(("words", "gram", "most", "n"), [(6, 3, 10**6, 60), (6, 2, 4, 60), (51, 26, 3, 25), (51, 26, 1024, 25)])
def test_passages_of_words(spark, words, gram, most, n):
    """Passages shared by documents and by no document, at either end and inside, beside repeats within one document."""
    rng = random.Random(words + most)
    fresh = lambda k: [f"w{rng.randrange(4000)}" for _ in range(k)]
    passages = [fresh(words + k) for k in (0, 0, 1, 7)] + [fresh(words - 1)]
    texts = [None, "", " \t\n", "the " * 4 * words, "the " * (words - 1), "the " * 3 * words + "end", " ".join(passages[0]), "\n".join(passages[0])]
    for _ in range(n):
        own = fresh(words + 2)
        parts = [fresh(rng.randrange(2 * words)), rng.choice(passages), fresh(rng.randrange(3)), rng.choice([own + own, own + fresh(1) + own, []]), rng.choice(passages)]
        texts.append(rng.choice([" ", "\n", "  "]).join(x for part in parts for x in part))
    texts += [texts[9], texts[10] + " more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_shared_words for r in repeats.remove_repeats(docs, most=most, passage=repeats.Symbols(words, gram, True)).collect()}
    want = dict(enumerate(brute_shared([(t or "").encode() for t in texts], words)))
    assert got == want
    assert 0 < sum(n > 0 for n in want.values()) < len(want)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(docs).count() == 0


def test_anchors_of_pieces(monkeypatch):
    rng = random.Random(1)
    data = bytes(rng.choices(b"ab", k=9000))
    powers = repeats.Powers()
    whole = repeats.anchors(data, powers, 60, 20)
    monkeypatch.setattr(repeats, "PIECE", 1000)
    cut = repeats.anchors(data, powers, 60, 20)
    cover = lambda x: {w: int(k) for k, a, b in zip(x[0], x[2], x[3]) for w in range(a, b + 1)}
    assert cover(whole) == cover(cut) and len(cover(whole)) == 9000 - 59


def test_columns_give_the_order_of_suffixes():
    rng = random.Random(3)
    length, gram = 12, 5
    strings = ["".join(rng.choices("ab", k=rng.randrange(12, 19))).encode() for _ in range(40)]
    at = repeats.np.array([min(7, len(s) - 12) for s in strings])
    groups = repeats.np.array(sorted(rng.choices(range(3), k=40)))
    for column, order, transform, common in repeats.insert_columns(groups, at, strings, repeats.Symbols(length, gram)):
        suffix = lambda i: strings[i][max(0, column + at[i]) :] if 0 <= column + at[i] else b""
        real = [i for i in order if suffix(i)]
        assert [(groups[i], suffix(i)) for i in real] == sorted((groups[i], suffix(i)) for i in real)
        for k in range(1, len(order)):
            a, b = suffix(order[k - 1]), suffix(order[k])
            n = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
            assert common[k] == (n if groups[order[k - 1]] == groups[order[k]] else 0)
        for k, i in enumerate(order):
            j = column + at[i] - 1
            assert transform[k] == (strings[i][j] if 0 <= j < len(strings[i]) else -1)
