"""Operators against independent versions of their methods, and their cases at the edges."""

import gzip
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash

from quern.llm import embeddings, langid, ppm, quality, sharding, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string"
WORDS = "the of and river stone light winter paper green moon seven letters quietly house garden".split()


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def grouped(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# SimHash
def test_tally_comes_before_bits():
    draw = np.random.default_rng(0)
    base = draw.integers(0, 1 << 63, 20, dtype=np.uint64)
    prints = np.unique(np.concatenate([base ^ np.uint64(m) for m in (0, 1, 1 << 9 | 1 << 17, 0x0101010100, 0x0F0F0F0F00)]))
    seen = []
    found = {(int(prints[i]), int(prints[j])) for a, b in simhash.near(np.zeros(len(prints), np.int64), prints, 3, lambda *n: seen.append(n)) for i, j in zip(a, b, strict=True)}
    every = [(int(x), int(y)) for k, x in enumerate(prints) for y in prints[k + 1 :]]
    enough = [(x, y) for x, y in every if sum(p == q for p, q in zip(struct.pack(">Q", x), struct.pack(">Q", y), strict=True)) >= 5]
    # All pairs of the list are tallied; only those that share five bytes or more are compared bit by bit.
    assert sum(n for n, _ in seen) == len(every) and sum(n for _, n in seen) == len(enough) < len(every)
    assert found == {(x, y) for x, y in enough if (x ^ y).bit_count() <= 3}


def test_forests_span():
    draw = np.random.default_rng(1)
    for n in (1, 5, 60):
        i, j = draw.integers(0, n, 2 * n), draw.integers(0, n, 2 * n)
        made, root = simhash.forest(n, i, j)
        whole = grouped(n, zip(i.tolist(), j.tolist(), strict=True))
        assert root.tolist() == whole == grouped(n, zip(i[made].tolist(), j[made].tolist(), strict=True))
        assert len(made) == n - len(set(whole))


def test_hot_fingerprints(spark):
    rows = [(k, "one text that very many share" if k % 3 else prose(k, 30), "en", "a") for k in range(900)]
    out = simhash.classes(spark.createDataFrame(rows, DOCS)).toPandas().set_index("doc_id")
    hot = out.loc[[k for k in range(900) if k % 3]]
    assert len(out) == 900 and hot.fingerprint.nunique() == 1 and (hot.component_id == 1).all()


@pytest.mark.parametrize("block", [256, 16])
def test_clusters_and_tiles(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    draw = np.random.default_rng(3)
    fresh = lambda n: ["".join(draw.choice(list("abcdefghij"), 6)) for _ in range(n)]
    base, texts = fresh(120), []
    for k in range(90):
        # Around one text: many pairs of similarity 0.6 to 0.9, some alike enough to link.
        words = list(base)
        at = int(draw.integers(0, 100))
        n = int(draw.integers(4, 16))
        words[at : at + n] = fresh(n)
        texts.append(" ".join(words))
    texts += [" ".join(fresh(60)) for _ in range(30)]
    sets = [simhash.shingles(t.encode(), 5) for t in texts]
    prints = np.frombuffer(b"".join(map(simhash.wide_fingerprint, sets)), np.uint8).reshape(len(texts), -1)
    pairs = [
        (i, j) for i in range(len(texts)) for j in range(i)
        if simhash.alike(sets[i], sets[j]) >= 0.8 and np.bitwise_count(prints[i] ^ prints[j]).sum() <= 64 and (prints[i] == prints[j]).sum() >= 2
    ]
    root = grouped(len(texts), pairs)
    assert 10 < len({r for r in root[:90]}) < 80
    out = simhash.deduplicate(spark.createDataFrame([(k, t, "en", "a") for k, t in enumerate(texts)], DOCS)).toPandas()
    assert sorted(out.doc_id) == sorted(set(root))


def test_long_texts_have_the_fingerprint_of_all_shingles():
    words = np.random.default_rng(9).choice(5000, 10_000).astype(str).tolist()
    votes = np.zeros(64, int)
    for k in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42)
        votes += [(h >> (63 - b)) & 1 for b in range(64)]
    want = int("".join("1" if 2 * v > len(words) - 2 else "0" for v in votes), 2)
    assert simhash.fingerprint(" ".join(words).encode(), 3) == want


# Language models
def test_sequences_across_pieces():
    data = np.random.default_rng(1).integers(0, 256, (2 << 20) + 1234).astype(np.uint8)
    whole = ppm.windows(data, 7)[data[6:] != ppm.START]
    assert (np.concatenate(list(ppm.sequences(data, 6))) == whole).all()
    distinct = ppm.asked(data, 6)
    assert (distinct == np.unique(whole)).all()
    places = ppm.Places(distinct)
    assert (distinct[places.order[places.find(whole[:100_000])]] == whole[:100_000]).all()


# Embeddings
@pytest.mark.parametrize("dim", [64, 1536, 4096])
def test_products_are_exact(dim):
    draw = np.random.default_rng(dim)
    x, y = (draw.integers(-127, 128, (20, dim)).astype(np.float32) for _ in range(2))
    assert (embeddings.product(x, y) == x.astype(np.int64) @ y.astype(np.int64).T).all()
    unit = draw.normal(size=(40, dim))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    q, s, e = embeddings.quantise(unit)
    about = embeddings.product(q, q) * s[:, None] * s[None]
    assert (np.abs(about - unit @ unit.T) <= e[:, None] + (1 + e[:, None]) * e[None] + embeddings.SLACK).all()


# Archives
def test_files_are_bounded_by_bytes(spark, tmp_path):
    draw = np.random.default_rng(2)
    html = lambda n: draw.bytes(n).hex()
    pages = [(k, f"http://a/{k}", html(int(draw.integers(1, 40_000)))) for k in range(60)] + [(100, "http://big", "x" * (17 << 20)), (101, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)
    warc.write(df, str(tmp_path / "w"), chunk=50_000, rows=3)
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    sizes = [len(p.read_bytes()) for p in files]
    assert len(files) > 5 and max(sizes) < 3 * (50_000 + 45_000)
    # Strict members, one after another, without padding between them.
    for p in files:
        data = p.read_bytes()
        while data:
            one = zlib.decompressobj(31)
            one.decompress(data)
            assert one.eof
            data = one.unused_data
    content = b"".join(gzip.decompress(p.read_bytes()) for p in files)
    assert content.count(b"WARC-Record-ID: ") == len(pages)
    out = warc.read(spark.read.format("binaryFile").load(str(tmp_path / "w"))).toPandas()
    assert sorted(out.page_id) == sorted(i for i, *_ in pages) and out.set_index("page_id").payload_bytes[100] == 17 << 20


def test_many_copies_of_a_page(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "NARROW", 1)
    pages = [(k, "u", "copy" if k % 3 else f"own {k // 6}") for k in range(600)]
    out = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "w")).toPandas().set_index("page_id")
    assert len(out) == 600 and out.refers_to[1] == 599 and out.record_type[599] == "response" and (out.record_type == "response").sum() == 1 + len({h for _, _, h in pages}) - 1


# Toxicity
def naive(lexicon, text):
    """Start, end and weight of all matches, looked for one entry after another."""
    folded, best = toxicity.fold(text), {}
    for entry, weight in lexicon.entries.items():
        word = entry.strip("~ ")
        for m in re.finditer(f"(?={re.escape(word)})", folded):
            a, b = m.start(), m.start() + len(word)
            begins, closed = not (a and folded[a - 1].isalpha()), b == len(folded) or not folded[b].isalpha()
            if entry.startswith("~") or (begins and (closed or not entry.endswith(" "))):
                rank = 1 if entry.endswith(" ") else 0
                best.setdefault(a, {}).setdefault(len(word), {})[0 if entry.startswith("~") else 1 + rank] = weight
    out = {}
    for a, by_length in best.items():
        each = [(w[max(k for k in w)], n) for n, w in by_length.items()]
        out[a] = max(w for w, _ in each)
    for phrase in map(toxicity.fold, lexicon.exceptions):
        for m in re.finditer(f"(?={re.escape(phrase)})", folded):
            a, b = m.start(), m.start() + len(phrase)
            if not (a and folded[a - 1].isalpha()) and (b == len(folded) or not folded[b].isalpha()):
                out = {s: w for s, w in out.items() if not (a <= s and any(s + n <= b for n in best[s]))}
    return sorted(out.items())


def test_matches_against_a_naive_matcher():
    draw = np.random.default_rng(6)
    letters = list("abc d")
    lexicon = toxicity.Lexicon({"ab ": 1.0, "abc": 2.0, "b": 0.5, "cab ": 3.0, "~語悪": 4.0, "d ": 0.25}, ("ab d",))
    for _ in range(400):
        text = "".join(draw.choice(letters, int(draw.integers(0, 40)))) + ("悪語悪" if draw.random() < 0.3 else "") + "".join(draw.choice(letters, 6))
        assert sorted((s, w) for s, (_, w, _) in lexicon.matches(toxicity.fold(text)).items()) == naive(lexicon, text), text


def test_learnt_exceptions_and_short_words(spark):
    toxic = [(k, prose(k, 30) + (" you zq" if k % 3 == 0 else " you bogan" if k % 3 == 1 else " 悪語悪口") + " " + prose(k + 7, 10), "en", "a") for k in range(1000, 1240)]
    clean = [(k, prose(k, 40) + (" bogan shire" if k % 60 == 0 else ""), "en", "a") for k in range(2000, 2800)]
    docs = spark.createDataFrame(toxic + clean, DOCS)
    labels = spark.createDataFrame([(k, 1) for k, *_ in toxic] + [(k, 0) for k, *_ in clean], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs.select("doc_id", "text"), labels)
    assert "bogan shire" in lexicon.exceptions and "zq " in lexicon.entries and any(e.startswith("~") for e in lexicon.entries)
    assert lexicon.features("the bogan shire") == (0.0, 0.0, 0.0) and lexicon.score(prose(1, 30) + " you bogan") > 0.5 > lexicon.score(prose(1, 30) + " bogan shire")
    assert lexicon.score(prose(1, 30) + " 悪語悪口") > 0.5


# Sharding
def test_shards_against_brute_force(spark):
    def draw(key, shard, weight):
        mixed = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed=xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42))
        return -math.log(((mixed >> 11) + 0.5) / (1 << 53)) / weight, shard

    weights = [1.0, 2.0, 0.5, 1.0]
    out = sharding.shard_records(spark.createDataFrame([(k, "x") for k in range(-50, 250)], "doc_id long, text string"), weights).collect()
    for r in out:
        assert r["shard"] == min(draw(r["doc_id"], s, w) for s, w in enumerate(weights))[1]
        assert r["grown_shard"] == min(draw(r["doc_id"], s, w) for s, w in enumerate([*weights, 1.0]))[1]


# Languages
def test_letters_decide_what_can_be_named(spark):
    rows = [(k, " ".join(np.random.default_rng(k).choice(w, 25)), lang, "a") for k, (w, lang) in enumerate([(WORDS, "en"), ("pierre lumière hiver papier vert lune sept lettres maison jardin".split(), "fr")] * 40)]
    # Rows of one key in two languages: each is learnt as what it says.
    rows += [(5000 + k, rows[0][1], "en", "a") for k in range(8)] + [(5000 + k, rows[1][1], "fr", "a") for k in range(8)]
    rows += [(9000, "½ ² Ⅷ 12", "en", "a"), (9001, "½ é", "fr", "a"), (9002, "pierre lumière " * 90_000, None, "a")]
    out = langid.predict(spark.createDataFrame(rows, DOCS)).toPandas()
    by = out[out.doc_id >= 9000].set_index("doc_id")
    assert by.lang_pred[9000] == "und" and by.score[9000] == 0 and by.lang_pred[9001] != "und" and by.lang_pred[9002] == "fr"
    assert Counter(out[out.doc_id.between(5000, 5010)].lang_pred) == {"en": 8, "fr": 8}


def test_prediction_by_definition():
    sample = [(lang, langid.present(langid.clean(" ".join(np.random.default_rng(k).choice(words, 12))))) for k in range(12) for lang, words in (("a", WORDS), ("b", "pierre lumière hiver papier vert lune".split()), ("c", "stein licht winter papier grün mond".split()))]
    model = langid.fit(sample, landmarks=9)
    texts = [" ".join(np.random.default_rng(100 + k).choice(WORDS + "lumière hiver grün mond".split(), 9)) for k in range(30)]
    universe, marks = model.universe.tolist(), [set(model.universe[model.landmarks[:, k] > 0].tolist()) for k in range(model.landmarks.shape[1])]
    names, scores = model.predict(texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        data = langid.clean(text)
        own = {int.from_bytes(data[i : i + n], "big") + (1 << 8 * n) for n in (1, 2, 3) for i in range(len(data) - n + 1)} & set(universe)
        kernel = np.array([len(own & m) / math.sqrt(len(own) * len(m)) for m in marks])
        values = 8 * kernel @ model.weights.astype(float)
        share = np.exp(values - values.max()) / np.exp(values - values.max()).sum()
        assert name == model.languages[int(share.argmax())] and score == pytest.approx(share.max(), abs=1e-3)


# Quality
def test_kept_against_brute_force(spark):
    draw = np.random.default_rng(8)
    rows = [(k, prose(k, 80) + " #%&" * (int(draw.integers(8, 20)) if k % 5 == 0 else int(draw.integers(0, 2))), "en" if k % 2 else None, "a") for k in range(900)]
    labels = [(k, 0 if k % 5 == 0 else 1) for k in range(0, 900, 1)] + [(0, 1), (0, None)]
    docs = spark.createDataFrame(rows, DOCS)
    out = quality.verdicts(docs, spark.createDataFrame(labels, "doc_id long, quality int")).toPandas().set_index("doc_id")
    measured = {k: quality.measure(t.encode()) for k, t, *_ in rows}
    for strata in ("en", None):
        keys = [k for k, _, lang, _ in rows if lang == strata]
        passed = [(k, q) for k, q in labels if q is not None and k in set(keys) and not measured[k].base_failed]
        cuts, spent = [quality.LEVELS] * len(quality.RULES), 0.0
        each = 0.05 / (2 * len(quality.RULES) * (quality.LEVELS // quality.STEP))
        for _ in quality.RULES:
            good, bad = np.zeros((len(quality.RULES), quality.LEVELS), int), np.zeros((len(quality.RULES), quality.LEVELS), int)
            for k, q in passed:
                levels = measured[k].levels
                if q == 1 or all(x < c for x, c in zip(levels, cuts, strict=True)):
                    for r, x in enumerate(levels):
                        (good if q == 1 else bad)[r][x] += 1
            now, spent = quality.choose(good, bad, cuts, spent, 0.05, each)
            if now == cuts:
                break
            cuts = now
        assert any(c < quality.LEVELS for c in cuts) and spent <= 0.05
        for k in keys:
            m = measured[k]
            assert out.kept[k] == (not m.base_failed and all(x < c for x, c in zip(m.levels, cuts, strict=True)))
    kept = quality.accepted(docs, spark.createDataFrame(labels, "doc_id long, quality int")).toPandas()
    assert sorted(kept.doc_id) == sorted(out.index[out.kept]) and pd.Series(kept.doc_id).is_unique


# The pipeline on nothing, and with awkward columns
def test_pipeline_cases(spark, tmp_path):
    import corpus_pipeline

    awkward = DOCS + ", `a.b` string, th long, key string, node int, cluster string, side int"
    rows = [(k, prose(k, 90), "en", "s", "x", 1, "k", 2, "c", 3) for k in range(30)] + [(100 + k, prose(k, 90), "en", "s", "x", 1, "k", 2, "c", 3) for k in range(10)]
    rows += [(5, prose(5, 90), "en", "s", "x", 1, "k", 2, "c", 3), (None, None, None, None, None, None, None, None, None, None)]
    for name, held in (("some", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(held, awkward).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns
            docs = out
        kept = corpus_pipeline.simhash_dedup(spark, spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id IS NOT NULL"), folder).toPandas()
        assert sorted(kept.doc_id) == (list(range(30)) if held else [])
        assert corpus_pipeline.run(spark, folder).count() == 0 if not held else corpus_pipeline.run(spark, folder).count() > 0
