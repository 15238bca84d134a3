"""Operators on texts against brute force, and their defined cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.llm import langid, mixing, packing, ppm, quality, sharding, simhash, toxicity
from quern.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, size int, __extra string"


def docs_of(spark, rows):
    """(doc_id, text, lang, source) with other columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1.0, "x", 7, "y") for i, t, lang, s in rows], DOCS)


WORDS = "the of and river stone light winter paper green moon seven letters quietly house garden".split()


def prose(seed, n):
    draw = np.random.default_rng(seed)
    return " ".join(draw.choice(WORDS, n))


ODD = [(None, None, None, None), (1, "", "en", "a"), (2, None, "en", "b"), (3, " \n\t ", None, "a"), (4, "Ünïcode ｗｉｄｅ text 中文 \U0001f600", "fr", None), (5, prose(5, 3000), "en", "a"), (6, "same text", "en", "a"), (6, "same text", "en", "a"), (7, "same text", "en", "b"), (8, "x" * 20000, "de", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return docs_of(spark, []).cache()


def tokens(text):
    return (text or "").encode().lower().split()


def brute_components(n, near):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if near(i, j) and root[i] != root[j]:
                    root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
                    changed = True
    return root


def test_components(spark):
    draw = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 60, (40, 2))] + [(100 + k, 101 + k) for k in range(20)] + [(None, 1)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {tuple(sorted(p)) for p in pairs if None not in p and p[0] != p[1]}
    nodes = sorted({x for p in linked for x in p})
    expected = brute_components(len(nodes), lambda i, j: tuple(sorted((nodes[i], nodes[j]))) in linked)
    assert found == {n: nodes[r] for n, r in zip(nodes, expected, strict=True)}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


# Scoring
def test_scores(spark):
    rows = [(i, prose(i, 30), "en", "a") for i in range(10, 70)] + ODD
    out = {(r["doc_id"], r["n_tokens"], r["score"]): r for r in ppm.score_texts(docs_of(spark, rows), nodes=5000, common=4).collect()}
    train = [t for i, t, *_ in rows if zlib.crc32(str("" if i is None else i).encode()) % 10]
    counts = Counter(w for t in train for w in tokens(t))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    by_id = {}
    for r in out.values():
        by_id[r["doc_id"]] = r
    for i, t, *_ in rows:
        r, words = by_id[i], tokens(t)
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [counts[w] for w in words] + [len(train)])
        assert r["base_score"] == pytest.approx(base) and r["n_tokens"] == len(words) + 1 and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[w] > 0 for w in words) + 1 and r["held_out"] == (zlib.crc32(str("" if i is None else i).encode()) % 10 == 0)
        assert r["score"] <= 0 and math.isfinite(r["score"])
    held = [r for r in by_id.values() if r["held_out"] and r["doc_id"] is not None and 9 < r["doc_id"] < 70]
    assert sum(r["score"] for r in held) > -2.2 * sum(r["n_tokens"] * 5 for r in held) / math.log2(10)


def brute_ppm(texts, order):
    seen = Counter()
    for t in texts:
        data = bytes([ppm.START]) * order + t + bytes([ppm.END])
        for i in range(order, len(data)):
            for k in range(order + 1):
                seen[data[i - k : i + 1]] += 1
    return seen


def brute_probability(seen, order, history, symbol):
    """By the definition: contexts from long to short, excluding what longer ones knew."""
    excluded, p = set(), 1.0
    for k in range(order, -1, -1):
        context = history[len(history) - k :]
        after = {s: seen[context + bytes([s])] for s in range(256) if context + bytes([s]) in seen}
        if not after:
            continue
        left = {s: 2 * n - 1 for s, n in after.items() if s not in excluded}
        escape = len(left)
        whole = sum(left.values()) + escape
        if symbol in left:
            return p * left[symbol] / whole
        if whole:
            p *= escape / whole
        excluded |= set(after)
    return p / (ppm.ALPHABET - len(excluded))


def test_model_by_definition(spark):
    texts = [prose(k, 6).encode() for k in range(8)] + [b"", "é".encode()]
    frame = spark.createDataFrame([(t.decode(),) for t in texts], "text string")
    model, seen = ppm.train(frame, sum(len(t) + 1 for t in texts), order=3, nodes=1 << 20), brute_ppm(texts, 3)
    for t in (b"the river zz", b"", prose(99, 5).encode()):
        data = bytes([ppm.START]) * 3 + t + bytes([ppm.END])
        expected = [math.log10(brute_probability(seen, 3, data[i - 3 : i], data[i])) for i in range(3, len(data))]
        assert model.score(np.frombuffer(data, np.uint8)).tolist() == pytest.approx(expected, abs=1e-5)
    # Given any history, all bytes together have a probability of at most one.
    history = bytes([ppm.START]) * 3 + b"the ri"
    data = [10 ** model.score(np.frombuffer(history[-3:] + bytes([s]), np.uint8))[0] for s in range(256) if s != ppm.START]
    assert sum(data) == pytest.approx(1, abs=1e-4)


def test_pruned_model_is_bounded(spark):
    texts = [prose(k, 40) for k in range(50)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    model = ppm.train(frame, sum(len(t) + 1 for t in texts), order=4, nodes=100)
    assert all(len(t.spread) <= 100 for t in model.sequences)
    for history in (b"the ", b"zzzz", b"r ri"):
        total = sum(10 ** model.score(np.frombuffer(history + bytes([s]), np.uint8))[0] for s in range(256) if s != ppm.START)
        assert total == pytest.approx(1, abs=1e-3)


def test_rare_sequences_count_in_large_corpora(spark):
    common = [prose(k, 400) for k in range(4)]
    rows = [(1000 + i, common[i % 4], "en", "a") for i in range(1200)] + [(5000 + k, f"zq{k} xjv kwy {prose(50 + k, 5)}", "en", "a") for k in range(30)] + ODD
    train, seen = Counter((t or "").encode().lower() for i, t, *_ in rows if zlib.crc32(str("" if i is None else i).encode()) % 10), Counter()
    assert sum(n * (len(t) + 1) for t, n in train.items()) > 1 << 21
    for t, n in train.items():
        for s, c in brute_ppm([t], 3).items():
            seen[s] += n * c
    out = {r["doc_id"]: r["score"] for r in ppm.score_texts(docs_of(spark, rows), order=3).collect()}
    for i, t, *_ in rows[1200:1230] + ODD[1:5]:
        data = bytes([ppm.START]) * 3 + (t or "").encode().lower() + bytes([ppm.END])
        assert out[i] == pytest.approx(sum(math.log10(brute_probability(seen, 3, data[j - 3 : j], data[j])) for j in range(3, len(data))), abs=1e-4)


def test_scores_of_nothing(nothing):
    assert ppm.score_texts(nothing).count() == 0


# Quality
def brute_quality(text):
    words = tokens(text)
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    windows = [tuple(words[i : i + 3]) for i in range(len((text or "").encode().split()) - 2)]
    raw = (text or "").encode().split()
    windows = [tuple(raw[i : i + 3]) for i in range(len(raw) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(raw), sum(len(w.decode()) for w in raw), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality(spark):
    good = [(i, prose(i, 80), "en", "a") for i in range(10, 400)]
    bad = [(i, " ".join(w + "###" for w in prose(i, 80).split()), "en", "a") for i in range(400, 440)]
    repeats = [(441, "a b c d\n" * 30 + prose(1, 200), "en", "a"), (442, "one two three " * 40, "en", "a")]
    docs = docs_of(spark, good + bad + repeats + ODD)
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad] + [(10, None), (None, 0), (99999, 1)], "doc_id long, quality int")
    out = quality.verdicts(docs, labels, rate=0.3).toPandas()
    texts = Counter((i, t) for i, t, *_ in good + bad + repeats + ODD)
    by = {}
    for i, t in texts:
        by.setdefault(i, []).append(brute_quality(t))
    for r in out.itertuples():
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert found in by[None if pd.isna(r.doc_id) else int(r.doc_id)]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (not r.kept or not r.base_failed)
    kept = set(out[out.kept].doc_id)
    assert {i for i, *_ in good} <= kept and not kept & {i for i, *_ in bad} and 442 not in kept
    accepted = quality.accepted(docs, labels, rate=0.3)
    assert accepted.columns == docs.columns and sorted(accepted.toPandas().doc_id) == sorted(out[out.kept].doc_id)


def test_binomial():
    from math import comb

    for k, n, p in ((0, 50, 0.05), (3, 200, 0.05), (7, 100, 0.2)):
        exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.tail(k, n, p) == pytest.approx(exact) and quality.upper(k, n, exact, 0.9) == pytest.approx(p, rel=1e-6)
    assert quality.upper(0, 0, 0.05, 0.5) == quality.upper(5, 10, 0.05, 0.5) == 1


def test_bounds_hold():
    """With random measures that say nothing, the chosen cutoffs lose more than the rate in few trials."""
    draw, wrong, none = np.random.default_rng(1), 0, [quality.LEVELS] * len(quality.RULES)
    for _ in range(100):
        good, bad = (np.stack([np.bincount(draw.integers(1, 200, 2000), minlength=quality.LEVELS) for _ in quality.RULES]) for _ in range(2))
        cuts, spent = quality.choose(good, bad, none, 0.0, 0.05, 0.05 / (6 * 32))
        wrong += sum(max(0, 200 - c) / 199 for c in cuts) > 0.05
        assert spent <= 0.05
    assert wrong <= 5


def test_quality_of_nothing(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.verdicts(nothing, labels).count() == 0 and quality.accepted(nothing, labels).count() == 0
    assert quality.verdicts(docs_of(spark, ODD), labels).count() == len(ODD)


# SimHash
def brute_fingerprint(text, width):
    from xxhash import xxh64_intdigest

    words = tokens(text)
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    votes = np.zeros(64, int)
    for s in shingles:
        votes += [(xxh64_intdigest(s, 42) >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles)) if shingles else 0


def test_simhash(spark):
    base = prose(1, 400).split()
    near = [(20 + k, " ".join(w if i != 7 * k else "changed" for i, w in enumerate(base)), "en", "a") for k in range(25)]
    rows = ODD + near + [(60 + k, prose(k, 3), "en", "a") for k in range(40)]
    out = simhash.classes(docs_of(spark, rows)).toPandas()
    prints = [brute_fingerprint(t, 3) for _, t, *_ in rows]
    expected = sorted((f"{x:016x}" for x in prints))
    assert sorted(out.fingerprint) == expected
    root = brute_components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    least = {}
    for k, (i, *_) in enumerate(rows):
        least[root[k]] = min([x for x in (least.get(root[k]), i) if x is not None], default=None)
    want = Counter((i, f"{prints[k]:016x}", least[root[k]]) for k, (i, *_) in enumerate(rows))
    have = Counter((None if pd.isna(a) else int(a), b, None if pd.isna(c) else int(c)) for a, b, c in zip(out.doc_id, out.fingerprint, out.component_id, strict=True))
    assert want == have


def test_long_posting_lists():
    draw = np.random.default_rng(2)
    low = draw.integers(0, 1 << 40, 5000, dtype=np.uint64)
    prints = np.unique(np.concatenate((low, low[:300] ^ np.uint64(5), low[:300] ^ np.uint64(1 << 39 | 1 << 8))))
    positions = (0, 1, 2)
    a, b = simhash.links(prints, positions, 3)
    root = {int(x): int(x) for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert (x ^ y).bit_count() <= 3
        root[find(x)] = find(y)
    for i in range(0, len(prints), 500):
        close = np.bitwise_count(prints[i : i + 500, None] ^ prints[None]) <= 3
        for p, q in zip(*np.nonzero(close), strict=True):
            assert find(int(prints[i + p])) == find(int(prints[q]))


def test_deduplicate(spark):
    def changed(words, every, by):
        return " ".join(by if i % every == 3 else w for i, w in enumerate(words))

    draw = np.random.default_rng(0)
    fresh = lambda n: ["".join(draw.choice(list("abcdefghij"), 6)) for _ in range(n)]
    texts = {k: fresh(300) for k in range(10, 40)}
    rows = [(k, " ".join(t), "en", "a") for k, t in texts.items()]
    rows += [(100 + k, " ".join(t), "en", "b") for k, t in texts.items() if k < 20] + [(200 + k, changed(t, 100, "new"), "en", "b") for k, t in texts.items() if k < 30]
    rows += [(300, " ".join(texts[39][:60] + fresh(240)), "en", "a")] + ODD
    docs = docs_of(spark, rows)
    out = simhash.deduplicate(docs)
    ids = Counter(None if pd.isna(i) else int(i) for i in out.toPandas().doc_id)
    assert out.columns == docs.columns and all(ids[k] == 1 for k in range(10, 40)) and ids[300] == 1
    assert not any(100 <= i < 300 for i in ids if i is not None) and ids[6] == 1
    # One of the texts without words stays.
    assert sum(ids[k] for k in (1, 2, 3) if k in ids) <= 3


def similar(seed, n, lost):
    """A text of n words and a copy with the last words changed, so that the five-word shingles are alike to (n - 4 - lost) / (n - 4 + lost)."""
    draw = np.random.default_rng(seed)
    words = ["".join(draw.choice(list("abcdefghij"), 6)) for _ in range(n + lost)]
    return " ".join(words[:n]), " ".join(words[: n - lost] + words[n:])


def test_only_near_copies_go(spark):
    # Of similarity 0.70 and 0.85; the former pairs are often within the bits.
    rows = [(10 * k + i, t, "en", "a") for k in range(40) for i, t in enumerate(similar(k, 204, 36 if k % 2 else 16))]
    ids = {r["doc_id"] for r in simhash.deduplicate(docs_of(spark, rows)).collect()}
    assert ids >= {10 * k + i for k in range(1, 40, 2) for i in (0, 1)}
    assert ids >= set(range(0, 400, 10)) and not ids & set(range(1, 400, 20))


def test_near_copies_at_the_limit_go(spark):
    # All have a similarity of 0.802.
    rows = [(10 * k + i, t, "en", "a") for k in range(300) for i, t in enumerate(similar(k, 204, 22))]
    assert {r["doc_id"] for r in simhash.deduplicate(docs_of(spark, rows)).collect()} == set(range(0, 3000, 10))


def test_simhash_of_nothing(nothing):
    assert simhash.classes(nothing).count() == 0 and simhash.deduplicate(nothing).count() == 0


# Toxicity
def test_folding():
    assert toxicity.fold("Ｉｄ１0t ІDІОТ tr@sh $cum mörón") == "idiot idiot trash scum moron"


def test_toxicity(spark):
    toxic = [(i, prose(i, 40) + (" idiot" if i % 2 else " vequ" + WORDS[i % 15]) + " " + prose(i + 999, 20), "en", "a") for i in range(1000, 1120)]
    clean = [(i, prose(i, 60), "en", "a") for i in range(2000, 2400)]
    hidden = [(3000, prose(1, 30) + " 1d10t " + prose(2, 20), "en", "a"), (3001, prose(1, 30) + " іdіоt " + prose(2, 20), "en", "a"), (3002, prose(3, 50), "en", "a"), (3003, "IDIOT", "en", "a")]
    docs = docs_of(spark, toxic + clean + hidden + ODD)
    labels = spark.createDataFrame([(i, 1) for i, *_ in toxic] + [(i, 0) for i, *_ in clean] + [(None, 1), (5, None), (1000, 0)], "doc_id long, toxic int")
    out = toxicity.score_texts(docs, labels).toPandas()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    assert (out.held_out == [zlib.crc32(str("" if pd.isna(i) else int(i)).encode()) % 5 == 0 for i in out.doc_id]).all()
    by = out.set_index("doc_id").predicted
    assert by.loc[[i for i, *_ in toxic]].mean() > 0.97 and by.loc[[i for i, *_ in clean]].max() == 0
    assert by.loc[3000] == by.loc[3001] == by.loc[3003] == 1 and by.loc[3002] == 0
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns and sorted(kept.toPandas().doc_id.fillna(-1)) == sorted(out[out.predicted == 0].doc_id.fillna(-1))


def test_exceptions():
    lexicon = toxicity.Lexicon({"clown ": 3.0, "trash ": 3.0, "vequ": 2.0})
    assert lexicon.features("a class clown and a trash can") == (0.0, 0.0, 0.0)
    assert lexicon.features("a clown")[0] > 0 and lexicon.features("clownish")[0] == 0 and lexicon.features("xvequ")[0] == 0 and lexicon.features("vequxx")[0] > 0


def test_toxicity_of_nothing(spark, odd, nothing):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_texts(nothing, labels).count() == 0
    assert [r["score"] for r in toxicity.score_texts(odd, labels).collect()] == [0.0] * len(ODD)


# Mixing
def test_mixing(spark):
    draw = np.random.default_rng(4)
    rows = [(i, prose(i, int(draw.integers(1, 60))), "en", s) for i, s in enumerate(["a"] * 300 + ["b"] * 40 + ["c"] * 100 + [None] * 20)] + ODD
    docs = docs_of(spark, rows)
    out = mixing.plan(docs).toPandas()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(tokens(t))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, free, total = {}, set(names), sum(sizes.values())
    while True:
        level = (total - sum(target.values())) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    for s in names:
        own = out[out.source.isna() if s is None else out.source == s]
        assert own["__mix_target"].iloc[0] == pytest.approx(target[s]) and own["__mix_source_size"].iloc[0] == sizes[s]
        assert set(own["__mix_copies"]) <= {math.floor(target[s] / sizes[s]) if sizes[s] else 0, math.floor(target[s] / sizes[s]) + 1 if sizes[s] else 0, 3}
    assert out["__mix_copies"].max() <= 3 and abs((out["__mix_copies"] * out["__mix_size"]).sum() / total - 1) < 0.25
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == out["__mix_copies"].sum()
    again = mixing.plan(docs.repartition(3)).toPandas()
    assert Counter(zip(out.doc_id.fillna(-1), out["__mix_copies"], strict=True)) == Counter(zip(again.doc_id.fillna(-1), again["__mix_copies"], strict=True))


def test_mixing_of_nothing(nothing, spark):
    assert mixing.plan(nothing).count() == 0
    assert [r["__mix_copies"] for r in mixing.plan(docs_of(spark, [(1, None, "en", "a"), (2, "", "en", None)])).collect()] == [0, 0]


def test_word_count(spark):
    texts = ["", None, " a  b\n", "a b c\u0085d", "x\x0by\x1cz", "\t"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.n_words(F.col("t"))).collect()
    assert [r[0] for r in out] == [len(tokens(t)) for t in texts]


# Packing
def bracketed(spark, runs):
    """What a sweep matches, document by document: each takes the smallest gap left that holds it."""
    gaps, out = sorted((v, k, n) for k, (v, kind, _, n) in enumerate(runs) if kind == 0 for n in range(n)), Counter()
    free = [(v, runs[k][2]) for v, k, _ in gaps]
    for value, kind, id_, n in sorted(runs, reverse=True):
        for _ in range(n if kind else 0):
            at = next((k for k, (v, _) in enumerate(free) if v >= value), None)
            if at is not None:
                out[id_, free.pop(at)] += 1
    return out


def test_sweep(spark):
    draw = np.random.default_rng(4)
    for _ in range(6):
        runs = [(v, 0, v, int(draw.integers(1, 5))) for v in draw.choice(40, 8, False).tolist()] + [(v, 1, 100 + v, int(draw.integers(1, 9))) for v in draw.choice(40, 10, False).tolist()]
        found, seen = packing.swept(spark, runs), Counter()
        sizes = {(kind, k): n for _, kind, k, n in runs}
        have = Counter()
        for doc, gap, doc_at, gap_at, n in found:
            have[doc, (gap, gap)] += n
            seen.update([(1, doc, k) for k in range(doc_at, doc_at + n)] + [(0, gap, k) for k in range(gap_at, gap_at + n)])
            assert doc_at + n <= sizes[1, doc] and gap_at + n <= sizes[0, gap]
        # Each gap's value is its id here; of equal documents it doesn't matter which goes where.
        assert max(seen.values(), default=1) == 1 and have == bracketed(spark, runs)


def test_best_fit(spark):
    draw = np.random.default_rng(5)
    for _ in range(10):
        counts = Counter(draw.integers(1, 65, int(draw.integers(0, 300))).tolist())
        segments, fill, n = packing.best_fit(spark, counts, 64), Counter(), 0
        for k, (length, rank, first, offset) in enumerate(segments.tolist()):
            end = segments[k + 1, 1] if k + 1 < len(segments) and segments[k + 1, 0] == length else counts[length]
            for s in range(first, first + int(end) - rank):
                assert offset + length <= 64
                fill[s] += length
                n += 1
        assert n == sum(counts.values()) and sum(fill.values()) == sum(a * b for a, b in counts.items())
        assert len(fill) <= 1.1 * sum(fill.values()) / 64 + 12


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["It's  two spaces,\n new line", " lead and trail ", "<|endoftext|> 'll '", "tab\there   nbsp", "1234 x5 !!??", prose(2, 2500)]
    rows = ODD + [(50 + k, t, "en", "a") for k, t in enumerate(texts)] + [(80 + k, prose(k, 37 * k), "en", "a") for k in range(40)]
    out = packing.pack(docs_of(spark, rows), 256).toPandas()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert want == Counter((None if pd.isna(i) else int(i), *r) for i, *r in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    out = out.sort_values(["sequence_id", "offset"])
    by = out.groupby("sequence_id").length
    assert (by.cumsum() - out.length == out.offset).all() and by.sum().max() <= 256 and by.ngroups <= 1.02 * out.length.sum() / 256 + 1


def test_divided_texts():
    encode = packing.public_encoder()
    for text in (prose(1, 300), "a  b \n c" * 200 + prose(2, 100), "x" * 500, " lead " * 80):
        parts = list(packing.divided(text, 40))
        assert "".join(parts) == text and b"".join(map(encode.part, parts)) == np.array(encode.whole(text), "<u4").tobytes()


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing).count() == 0


# Sharding
def test_sharding(spark):
    rows = [(i, prose(i, 3), "en", "a") for i in range(10, 3010)] + ODD
    out = sharding.shard_records(docs_of(spark, rows), [1.0] * 16).toPandas()
    assert len(out) == len(rows) and (out.law == "key").all()
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own))) and 110 < len(own) < 280
    moved = out[out.shard != out.grown_shard]
    assert (moved.grown_shard == 16).all() and 100 < len(moved) < 280
    by = {i: t for i, t, *_ in rows}
    for r in out.itertuples():
        body = (by[None if pd.isna(r.doc_id) else int(r.doc_id)] or "").encode()
        assert r.size == len(body) + 1 and r.text_crc32 == zlib.crc32(body)
    again = sharding.shard_records(docs_of(spark, rows[::-1]), [1.0] * 17).toPandas()
    assert dict(zip(again.doc_id.fillna(-1), again.shard, strict=True)) == dict(zip(out.doc_id.fillna(-1), out.grown_shard, strict=True))


def test_weighted_shards(spark):
    df = spark.range(20000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0, 0.0]).alias("s"))
    n = {r["s"]: r["count"] for r in df.groupBy("s").count().collect()}
    assert set(n) == {0, 1} and 0.23 < n[0] / 20000 < 0.27
    with pytest.raises(ValueError, match="positive"):
        sharding.rendezvous(F.lit(1), [0.0])


def test_sharding_of_nothing(nothing):
    assert sharding.shard_records(nothing, [1.0] * 4).count() == 0


# Languages
FRENCH, GERMAN = "le la rivière été pierre lumière hiver papier déjà".split(), "der die fluß stein licht über schön haus garten".split()


def test_languages(spark):
    def text(words, seed):
        return " ".join(np.random.default_rng(seed).choice(words, 25))

    rows = [(i, text(w, i), lang, "a") for i, (w, lang) in enumerate([(WORDS, "en"), (FRENCH, "fr"), (GERMAN, "de")] * 60, 10)] + ODD + [(900, "123 !!", "en", "a"), (901, "pierre lumière hiver", None, "a"), (902, "no label", None, "a")]
    out = langid.predict(docs_of(spark, rows)).toPandas()
    truth = {i: lang for i, _, lang, _ in rows if i is not None and i >= 10 and i < 900}
    held = out[out.held_out & out.doc_id.isin(truth)]
    assert (out.held_out == [zlib.crc32(str("" if pd.isna(i) else int(i)).encode()) % 4 == 2 for i in out.doc_id]).all() and out.score.between(0, 1).all()
    assert len(held) > 20 and (held.lang_pred == held.doc_id.map(truth)).mean() > 0.98
    by = out.set_index("doc_id").lang_pred
    assert by.loc[900] == by.loc[1] == by.loc[2] == by.loc[3] == "und" and by.loc[901] == "fr"


def test_kernel_by_definition():
    sample = [("a", langid.present(langid.clean(prose(k, 20)))) for k in range(6)] + [("b", langid.present(langid.clean(" ".join(GERMAN[k:] * 2)))) for k in range(5)]
    model = langid.fit(sample, landmarks=8)
    text = "the river fluß 99"
    grams = {text_[i : i + n] for text_ in [langid.clean(text)] for n in (1, 2, 3) for i in range(len(text_) - n + 1)}
    codes = {int.from_bytes(g, "big") + (1 << 8 * len(g)) for g in grams} & set(model.universe.tolist())
    row = model.presence([langid.clean(text)])
    assert set(model.universe[row[0] > 0].tolist()) == codes
    landmark = set(model.universe[model.landmarks[:, 0] > 0].tolist())
    assert model.kernel(row)[0, 0] == pytest.approx(len(codes & landmark) / math.sqrt(len(codes) * len(landmark)), rel=1e-5)


def test_languages_of_nothing(spark, nothing):
    assert langid.predict(nothing).count() == 0
    out = langid.predict(docs_of(spark, [(1, "some text", None, "a")])).first()
    assert (out["lang_pred"], out["score"]) == ("und", 0.0)
