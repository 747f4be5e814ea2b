"""The trained operators against versions in plain Python: features, learning steps and scores."""

import math
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import regex

from tidemark.llm import langid, quality, toxicity, words

M64 = (1 << 64) - 1
TEXTS = ["", " ", "?!", "Ein Haus. Zwei Häuser, zwei häuser!\n\nEin Haus. Zwei Häuser,", "ÀÉ ǅ x² ½",
         "one line\r\nand\tanother one\none line\n", "日本語 текст नमस्ते a_b", "idiot idiots IDIOTIC " * 3,
         "no stop " * 40, "5 5 5. (6) \"7\" - '8': 9; #@", "İstanbul ß ŉ", "\n\n\n"]


@pytest.fixture(scope="module")
def texts(documents):
    return TEXTS + [t or "" for _, t in documents[:60]]


def word_list(text):
    return regex.findall(r"[\p{L}\p{N}\p{M}]+", text.lower())


def softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


# ---- quality -------------------------------------------------------------------------------------


def plain_numbers(text):
    kinds = Counter()
    for c in text:
        category = unicodedata.category(c)
        if c == "\n":
            kinds["break"] += 1
        elif c in "\t\v\f\r" or category[0] == "Z":
            kinds["blank"] += 1
        elif c in ".,;:?'\"()-":
            kinds["mark"] += 1
        elif category in ("Lu", "Lt"):
            kinds["upper"] += 1
        elif category[0] in "LM":
            kinds["lower"] += 1
        else:
            kinds["digit" if category[0] == "N" else "other"] += 1
    w, lines = word_list(text), [x for x in text.split("\n") if x]
    pairs = list(zip(w, w[1:]))
    some, letters = max(len(text), 1), kinds["lower"] + kinds["upper"]
    distinct = lambda x: len(set(x)) / len(x) if x else 1.0
    return [
        math.log(1 + len(text)), math.log(1 + len(w)), (letters + kinds["digit"]) / max(len(w), 1),
        distinct(w), sum(a == b for a, b in pairs) / max(len(pairs), 1), distinct(pairs),
        kinds["upper"] / max(letters, 1), kinds["digit"] / some, kinds["mark"] / some,
        kinds["other"] / some, kinds["blank"] / some, 1000 * kinds["break"] / some, distinct(lines),
        len(w) / max(text.count(".") + text.count("?"), 1)]


def test_quality_numbers(texts):
    got = quality.features(texts)
    for text, row in zip(texts, got):
        assert row == pytest.approx(plain_numbers(text), abs=1e-12), text[:50]


def leaf(g, h):
    return quality.RATE * sum(g) / (sum(h) + quality.RIDGE)


def worth(g, h):
    return sum(g) ** 2 / (sum(h) + quality.RIDGE)


def plain_cut(g, h):
    best = (1e-9, 0)
    for at in range(1, len(g)):
        gain = worth(g[:at], h[:at]) + worth(g[at:], h[at:]) - worth(g, h)
        if gain > best[0]:
            best = (gain, at)
    return best if best[1] else (0.0, 0)


def plain_tree(g, h, depth=2):
    at = plain_cut(g, h)[1] if depth else 0
    if not at:
        return [leaf(g, h)] * len(g)
    return plain_tree(g[:at], h[:at], depth - 1) + plain_tree(g[at:], h[at:], depth - 1)


def plain_pair(g, h):
    """(gain, table) over two features' bins, given as rows of lists."""
    best = None
    for i in range(1, len(g)):
        total, table = 0.0, []
        for part in (slice(0, i), slice(i, None)):
            own_g, own_h = ([sum(c) for c in zip(*x[part])] for x in (g, h))
            gain, at = plain_cut(own_g, own_h)
            total += gain + worth(own_g, own_h)
            row = [leaf(own_g[:at], own_h[:at])] * at if at else []
            row += [leaf(own_g[at:], own_h[at:])] * (len(own_g) - at)
            table += [row] * len(g[part])
        if best is None or total > best[0]:
            best = (total, table)
    flat = [v for row in g for v in row], [v for row in h for v in row]
    return best[0] - worth(*flat), best[1]


def plain_boost(f, y, apart, places, shapes, tree, rounds):
    """`places`: for each table the cell of each row, as (i, j); shapes: rows and columns."""
    tables = [[[0.0] * n for _ in range(m)] for m, n in shapes]
    best_loss, best = math.inf, None
    for _ in range(rounds):
        for k, (place, (m, n)) in enumerate(zip(places, shapes)):
            g, h = ([[0.0] * n for _ in range(m)] for _ in "gh")
            for (i, j), v, label, out in zip(place, f, y, apart):
                if not out:
                    p = 1 / (1 + math.exp(-v))
                    g[i][j] += label - p
                    h[i][j] += p * (1 - p)
            step = tree(g, h)
            tables[k] = [[a + b for a, b in zip(*rows)] for rows in zip(tables[k], step)]
            f = [v + step[i][j] for v, (i, j) in zip(f, place)]
        losses = [math.log(1 + math.exp(v)) - label * v for v, label, out in zip(f, y, apart) if out]
        loss = sum(losses) / len(losses)
        if loss < best_loss - 1e-5:
            best_loss, best = loss, (tables[:], f)
    return best


def test_quality_learning(monkeypatch):
    monkeypatch.setattr(quality, "MOST_ROUNDS", 6)
    monkeypatch.setattr(quality, "BINS", 9)
    monkeypatch.setattr(quality, "PAIRS", 2)
    pick = np.random.default_rng(3)
    x = pick.normal(size=(300, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0) ^ (pick.random(300) < 0.1)).astype(float)
    apart = np.arange(300) % 6 == 0
    model = quality.fit(x, y, apart)
    for j, own in enumerate(model.edges):
        ordered = sorted(x[:, j])
        at = [q / 9 * 299 for q in range(1, 9)]
        assert own == pytest.approx([ordered[int(a)] + (a % 1) * (ordered[int(a) + 1] - ordered[int(a)])
                                     for a in at])
    bins = [[bisect_left(e.tolist(), v) for e, v in zip(model.edges, row)] for row in x]
    bias = math.log((y.sum() + 1) / (300 + 2 - y.sum() - 1))
    shapes = [(1, 9)] * 4
    tables, f = plain_boost([bias] * 300, y, apart, [[(0, b[j]) for b in bins] for j in range(4)],
                            shapes, lambda g, h: [plain_tree(g[0], h[0])], 6)
    for own, table in zip(model.tables, tables):
        assert own == pytest.approx(table[0], abs=1e-9)
    gains = []
    for i, j in combinations(range(4), 2):
        g, h = ([[0.0] * 9 for _ in range(9)] for _ in "gh")
        for b, v, label, out in zip(bins, f, y, apart):
            if not out:
                p = 1 / (1 + math.exp(-v))
                g[b[i]][b[j]] += label - p
                h[b[i]][b[j]] += p * (1 - p)
        gains.append((-plain_pair(g, h)[0], i, j))
    chosen = [c[1:] for c in sorted(gains)[:2]]
    assert [(i, j) for i, j, _ in model.pairs] == chosen and (1, 2) in chosen
    pairs, _ = plain_boost(f, y, apart, [[(b[i], b[j]) for b in bins] for i, j in chosen],
                           [(9, 9)] * 2, lambda g, h: plain_pair(g, h)[1], 6)
    for (*_, own), table in zip(model.pairs, pairs):
        assert own == pytest.approx(np.array(table), abs=1e-9)
    for row, b, got in zip(x, bins, model.scores(x)):
        total = bias + sum(t[0][k] for t, k in zip(tables, b))
        total += sum(t[b[i]][b[j]] for t, (i, j) in zip(pairs, chosen))
        assert got == pytest.approx(1 / (1 + math.exp(-total)))


# ---- language ------------------------------------------------------------------------------------


def plain_grams(text):
    """Counts of hashed runs of one to three characters of the text and a blank behind it."""
    cps = [ord(c) if c.isalpha() else 32 for c in text.lower()] + [32]
    if set(cps) == {32}:
        return None
    counts = Counter()
    for at in range(len(cps)):
        key = 0
        for order, c in enumerate(cps[at: at + 3]):
            key = (key * 0x01000193 & 0xFFFFFFFF) ^ (c * 0x9E3779B1 + order & 0xFFFFFFFF)
            counts[(key ^ key >> 15) * 0x85EBCA6B % (1 << 32) >> 17] += 1
    return counts


def plain_vector(counts, idf):
    raw = {k: (1 + math.log(n)) * float(idf[k]) for k, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    return {k: v / norm for k, v in raw.items()}


def plain_ftrl(rows, classes, epochs=3, alpha=0.5, beta=1.0, l1=0.2, l2=0.5, seed=7):
    z, n = (defaultdict(lambda: [0.0] * classes) for _ in "zn")

    def weight(k, c):
        least = 0 if k == "bias" else l1
        if abs(z[k][c]) <= least:
            return 0.0
        return (math.copysign(least, z[k][c]) - z[k][c]) / ((beta + math.sqrt(n[k][c])) / alpha + l2)

    pick = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in pick.permutation(len(rows)):
            vector, label = rows[i]
            vector = {**vector, "bias": 1.0}
            w = {k: [weight(k, c) for c in range(classes)] for k in vector}
            p = softmax([sum(v * w[k][c] for k, v in vector.items()) for c in range(classes)])
            for k, v in vector.items():
                for c in range(classes):
                    g = v * (p[c] - (c == label))
                    sigma = (math.sqrt(n[k][c] + g * g) - math.sqrt(n[k][c])) / alpha
                    z[k][c] += g - sigma * w[k][c]
                    n[k][c] += g * g
    return {k: [weight(k, c) for c in range(classes)] for k in list(z)}


def test_language_learning(texts, documents):
    counts = langid.gram_counts(texts)
    for text, own in zip(texts, counts):
        want = plain_grams(text[:20_000])
        if len(text) <= 20_000:
            assert (own is None) == (want is None)
            assert own is None or dict(zip(np.flatnonzero(own), own[own > 0])) == want
    short = [(plain_grams(t[:300]), langid.gram_counts([t[:300]])[0], i % 3)
             for i, (_, t) in enumerate(documents[:60]) if t and plain_grams(t[:300])]
    idf = np.zeros(langid.DIMS, np.float32)
    for own, _, _ in short:
        idf[list(own)] += 1
    idf = np.where(idf > 0, np.log((1 + len(short)) / (1 + idf)) + 1, 0).astype(np.float32)
    weights, bias = langid.train_ftrl([(*langid.tf_idf(c, idf), y) for _, c, y in short], 3)
    plain = plain_ftrl([(plain_vector(c, idf), y) for c, _, y in short], 3)
    assert bias == pytest.approx(plain.pop("bias"), abs=1e-4)
    assert any(any(w) for w in plain.values())
    dense = np.zeros((langid.DIMS, 3))
    for k, w in plain.items():
        dense[k] = w
    assert weights == pytest.approx(dense, abs=1e-4)
    model = langid.Model(["a", "b", "c"], idf, weights, bias, 1.7)
    for own, c, _ in short:
        vector = plain_vector(own, idf)
        p = softmax([(sum(v * float(weights[k][y]) for k, v in vector.items()) + float(bias[y])) / 1.7
                     for y in range(3)])
        best = max(range(3), key=lambda y: p[y])
        lang, score = model.predict(c)
        assert lang == "abc"[best] and score == pytest.approx(p[best], abs=1e-5)


# ---- toxicity ------------------------------------------------------------------------------------


def mixed(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & M64
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & M64
    return x ^ x >> 33


def plain_features(text):
    """Hashed words, beginnings of four and five characters, and runs of five within words."""
    def hashed(part, tag):
        total = sum(ord(c) * pow(words.BASE, i, 1 << 64) for i, c in enumerate(part)) + len(part)
        return mixed((mixed(total & M64) ^ tag) * words.BASE & M64) >> 64 - toxicity.BITS

    out = set()
    for w in word_list(text):
        out.add(hashed(w, 0))
        out |= {hashed(w[:n], n) for n in (4, 5) if len(w) > n}
        out |= {hashed(w[i: i + 5], 99) for i in range(len(w) - 4)}
    return out


def test_toxicity_features_and_scores(texts):
    rows, keys = toxicity.features(texts)
    pick = np.random.default_rng(5)
    weights = np.where(pick.random(1 << toxicity.BITS) < 0.3, pick.normal(size=1 << toxicity.BITS), 0)
    model = toxicity.Model(weights.astype(np.float32), -0.4)
    for i, (text, got) in enumerate(zip(texts, model.scores(texts))):
        own = plain_features(text)
        assert set(keys[rows == i].tolist()) == own
        f = sum(float(model.weights[k]) for k in own) - 0.4
        assert got == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, f)))), rel=1e-5)


def plain_nnpu(rows, positive, width, prior, steps, rate=0.06, l2=2e-4):
    """The same steps with slopes from differences of the risk itself; also how often each kind came."""
    soft = lambda v: math.log1p(math.exp(v))
    mean = lambda values: sum(values) / len(values)

    def risks(w):
        f = [sum(w[k] for k in r) + w[width] for r in rows]
        p, u = ([v for v, m in zip(f, positive) if m == kind] for kind in (True, False))
        return prior * mean([soft(-v) for v in p]), mean([soft(v) for v in u]) - prior * mean([soft(v) for v in p])

    w = [0.0] * width + [math.log(prior / (1 - prior))]
    first, second, kinds = [0.0] * (width + 1), [0.0] * (width + 1), Counter()
    for step in range(1, steps + 1):
        up = risks(w)[1] < 0
        kinds[up] += 1
        goal = (lambda v: -risks(v)[1]) if up else (lambda v: sum(risks(v)))
        slopes = []
        for k in range(width + 1):
            more, less = w[:], w[:]
            more[k] += 1e-5
            less[k] -= 1e-5
            slopes.append((goal(more) - goal(less)) / 2e-5 + (l2 * w[k] if k < width else 0))
        for k, g in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w[k] -= rate * (first[k] / (1 - 0.9**step)) / (
                math.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return w, kinds


def test_toxicity_learning():
    """Both kinds of step: down the whole risk, and up the clean part once it is negative."""
    pick = np.random.default_rng(9)
    rows = [np.array([0, *np.flatnonzero(pick.random(7) < 0.4) + 1]) for _ in range(12)]
    rows += [np.flatnonzero(np.append(pick.random() < 0.1, pick.random(7) < 0.4)) for _ in range(40)]
    positive = [True] * 12 + [False] * 40
    w, bias = toxicity.train_nnpu(rows, np.array(positive), 8, 0.45, steps=60)
    plain, kinds = plain_nnpu([r.tolist() for r in rows], positive, 8, 0.45, 60)
    assert kinds[True] > 3 and kinds[False] > 3
    assert w == pytest.approx(plain[:8], abs=1e-3)
    mean = np.mean([1 / (1 + math.exp(-(sum(plain[k] for k in r) + bias))) for r in rows[12:]])
    assert mean == pytest.approx(0.45, abs=1e-3)
