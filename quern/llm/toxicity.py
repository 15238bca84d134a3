"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, strips accents, replaces letters of other scripts that look like Latin ones, and undoes digit and
symbol substitutions, so that disguised spellings match. The lexicon is learnt from labelled texts: whole words and
beginnings of words (for inflected and compounded forms) with their log odds of standing in a toxic text; in scripts that
don't divide words, runs of two to four characters. A match must begin where a word begins, but for those runs. Phrases of
an entry and a neighbouring word that are found in clean texts, and against all chance not in toxic ones, are exceptions:
a match inside one doesn't count. Matched weight, as such and per word of the text, goes into a logistic score.

Learning takes at most SAMPLE labelled rows of each class, those with the smallest key hashes (a documented bound; counts
are weighted back to the true shares, and the score's intercept accounts for it). Which candidates become entries or
exceptions is a matter of evidence alone; their number isn't bounded. Every whole text is scored.

Defined cases: null and empty texts have no match and get the score of such texts; labels without a value or text are
ignored; of several labels of a key the largest counts; without toxic examples every score is 0; an empty table gives an
empty result. Other columns are kept as they are; names that begin with __tox_ are reserved.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import checkpointed, remainder

#: Labelled rows of a class that are learnt from at most.
SAMPLE = 20_000
#: The log likelihood ratio against chance that an entry or an exception needs, and the least log odds of an entry.
EVIDENCE, ODDS = 20.0, 2.5
#: Lengths of the word beginnings that may become entries.
STEMS = range(4, 9)

# Letters of other scripts by the Latin letter that they look like, and digits by the letter they stand for.
HOMOGLYPHS = {
    "a": "аαɑ", "b": "вЬьβ", "c": "сϲ", "d": "ԁɗ", "e": "еєεё", "g": "ɡԍ", "h": "һнհ", "i": "іιїӏı", "j": "јϳ", "k": "кκ", "l": "ⅼ", "m": "мⅿ",
    "n": "пηո", "o": "оοσօ", "p": "рρ", "q": "ԛ", "r": "гᴦ", "s": "ѕʂ", "t": "тτ", "u": "υսц", "v": "νѵ", "w": "ѡԝω", "x": "хχ", "y": "уүγ", "z": "ᴢʐ",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a"}
#: Phrases in which an entry is meant otherwise, whatever was learnt.
EXCEPTIONS = ("pathetic fallacy", "sore loser rule", "trash can", "class clown", "clown fish", "stupid question")

FOLD = {ord(c): a for a, looks in HOMOGLYPHS.items() for c in looks} | {ord(c): a for c, a in DIGITS.items()}
# Latin letters with accents, as their bare letters, and full-width forms.
for _c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)]:
    if _c not in FOLD and (_d := unicodedata.normalize("NFKD", chr(_c)).lower())[0] != chr(_c):
        FOLD[_c] = DIGITS.get(_d[0], _d[0])
# Marks, soft hyphens and zero-width characters inside a word go.
FOLD |= dict.fromkeys([*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
TABLE = str.maketrans(FOLD)
MONEY = re.compile(r"\$(?=[^\W\d_])")
WORDS = re.compile(r"[^\W\d_]+")
#: Scripts that don't divide words: kana, Han, Thai, Lao, Khmer, Burmese. Their entries begin with INNER.
UNSPACED, INNER = re.compile("[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0eff\u1780-\u17ff\u1000-\u109f]{2,}"), "~"


def fold(text: str) -> str:
    text = text.lower().translate(TABLE)
    return MONEY.sub("s", text) if "$" in text else text


def candidates(text: str) -> set[str]:
    """The entries that could match in a text: 'word ' for whole words, 'stem' for beginnings, '~run' for runs of unspaced scripts."""
    folded = fold(text)
    words = {w for w in WORDS.findall(folded) if 2 <= len(w) <= 40}
    runs = {INNER + r[a : a + n] for r in UNSPACED.findall(folded) for n in (2, 3, 4) for a in range(len(r) - n + 1)}
    return {w + " " for w in words} | {w[:n] for w in words for n in STEMS if len(w) >= n} | runs


@dataclass
class Lexicon:
    """entries: weights of 'word ' and 'stem' entries; model: mean, scale and coefficients of the logistic score."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    model: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    automaton: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def build(self) -> object:
        if self.automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            # By what is to be matched: the weights as a whole word, a beginning and a run, and whether it is an exception.
            of: dict[str, list] = {}
            for entry, weight in self.entries.items():
                kind = 2 if entry.startswith(INNER) else 0 if entry.endswith(" ") else 1
                of.setdefault(entry.strip(INNER + " "), [None, None, None, False])[kind] = weight
            for phrase in map(fold, self.exceptions):
                of.setdefault(phrase, [None, None, None, False])[3] = True
            for word, what in of.items():
                made.add_word(word, (len(word), *what))
            made.make_automaton()
            self.automaton = made
        return self.automaton

    def matches(self, folded: str) -> dict[int, tuple[int, float, int]]:
        """By where a match starts: its end, weight and length. Those inside an exception are left out."""
        best: dict[int, tuple[int, float, int]] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, whole, stem, run, exception) in self.build().iter(folded):
            start = end - length + 1
            begins = not (start and folded[start - 1].isalpha())
            closed = end + 1 == len(folded) or not folded[end + 1].isalpha()
            if exception and begins and closed:
                spared.append((start, end))
            weight = whole if begins and closed and whole is not None else stem if begins and stem is not None else run
            if weight is not None and weight > best.get(start, (0, -1.0, 0))[1]:
                best[start] = (end, weight, length)
        return {s: (e, w, n) for s, (e, w, n) in best.items() if not any(a <= s and e <= b for a, b in spared)} if spared else best

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Weight matched, the same per hundred words, and the number of different entries matched, each on a log scale."""
        if not text or not self.entries:
            return 0.0, 0.0, 0.0
        folded = fold(text)
        hits = self.matches(folded)
        if not hits:
            return 0.0, 0.0, 0.0
        weight = sum(w for _, w, _ in hits.values())
        kinds = len({folded[s : s + n] for s, (_, _, n) in hits.items()})
        return math.log1p(weight), math.log1p(100 * weight / max(1, len(text.split()))), math.log1p(kinds)

    def phrases(self, text: str) -> set[tuple[str, str]]:
        """(entry matched, phrase): each match with the word before it, and with the word behind it."""
        folded, out = fold(text), set()
        for start, (end, _, length) in self.matches(folded).items():
            entry = folded[start : start + length]
            last = WORDS.match(folded, start)
            stop = max(last.end() if last else 0, end + 1)
            out.add((entry, ""))
            if (after := WORDS.match(folded, stop + 1)) and folded[stop] == " ":
                out.add((entry, folded[start : after.end()]))
            if start > 1 and folded[start - 1] == " ":
                before = start - 2
                while before >= 0 and folded[before].isalpha():
                    before -= 1
                if before < start - 2:
                    out.add((entry, folded[before + 1 : stop]))
        return out

    def score(self, text: str | None) -> float:
        if self.model is None:
            return 0.0
        mean, scale, beta = self.model
        x = (np.array(self.features(text)) - mean) / scale
        return float(1 / (1 + math.exp(-max(-500.0, min(500.0, beta[0] + float(beta[1:] @ x))))))


def evidence(neg: float, pos: float, n_neg: float, n_pos: float) -> float:
    """The log likelihood ratio of a candidate's counts against chance."""
    share = n_pos / (n_pos + n_neg)
    return 2 * sum(x * math.log(x / (e * (neg + pos))) for x, e in ((pos, share), (neg, 1 - share)) if x)


def select(counts: list[tuple[str, float, float]], n_neg: float, n_pos: float, least_odds: float = ODDS, least_evidence: float = EVIDENCE) -> dict[str, float]:
    """The lexicon from (candidate, negative texts, positive texts): all that is telling and not by chance.

    Of nested candidates the shortest that is as telling stays, or a longer one that explains it.
    """
    weights = {c: math.log((p + 0.5) / (n_pos + 1)) - math.log((n + 0.5) / (n_neg + 1)) for c, n, p in counts}
    seen = {c: p for c, _, p in counts}
    strong = {c: evidence(n, p, n_neg, n_pos) >= least_evidence for c, n, p in counts}
    telling = {c: w for c, w in weights.items() if w >= least_odds and strong[c]}
    chosen: dict[str, float] = {}
    for c in sorted(telling, key=lambda c: (len(c), c)):
        inner = [] if c.startswith(INNER) else [c[:n] for n in STEMS if n < len(c)]
        inner = [x for x in inner if x in chosen]
        if not inner:
            chosen[c] = telling[c]
        elif all(seen[c] >= 0.95 * seen[x] for x in inner):
            for x in inner:
                del chosen[x]
            chosen[c] = telling[c]
    # A beginning rests on many words; what is left of it in other texts counts against it already.
    return dict(sorted(chosen.items(), key=lambda x: (-seen[x[0]] * x[1], x[0])))


def spared(counts: list[tuple[str, str, float, float]], least_evidence: float = EVIDENCE) -> tuple[str, ...]:
    """The exceptions from (entry, phrase, negative texts, positive texts); an empty phrase stands for all matches of the entry.

    A phrase is one if, against all chance, it is in fewer toxic texts than the entry is, and in at most a tenth.
    """
    whole = {e: (n, p) for e, phrase, n, p in counts if not phrase}
    return tuple(sorted({phrase for e, phrase, n, p in counts if phrase and 9 * p <= n and evidence(n, p, *(x + 0.5 for x in whole[e])) >= least_evidence}))


def logistic(x: np.ndarray, y: np.ndarray, offset: float, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton's method; offset is added to the intercept afterwards."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack((np.ones(len(x)), (x - mean) / scale))
    beta, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1]) * len(x) / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(beta)), z.T @ (y - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    beta[0] += offset
    return mean, scale, beta


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> Lexicon:
    """A lexicon and its score from labelled rows whose crc32 of doc_id isn't divisible by folds; docs: doc_id, text."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter(remainder("doc_id", folds) != 0)
    # Copies of a text count once, or their words would seem telling; labels of documents that aren't there don't count.
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    met = known.join(hashed.select("doc_id", "text_hash"), "doc_id").groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    known = checkpointed(met.filter("toxic IN (0, 1)"))
    there = {int(k): n for k, n in known.groupBy("toxic").count().collect()}
    if set(there) != {0, 1}:
        return Lexicon({})
    few = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(sample) for y in (0, 1)]
    # Twice the sample at most: these rows are broadcast, and only their texts are learnt from.
    few = checkpointed(few[0].unionByName(few[1]))
    texts = checkpointed(hashed.join(F.broadcast(few), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("toxic", F.coalesce("text", F.lit("")).alias("text")))
    n_pos, n_neg = (min(there[y], sample) for y in (1, 0))
    # What one sampled negative text stands for, against one positive.
    weight = (there[0] / n_neg) / (there[1] / n_pos)
    spark = docs.sparkSession

    def counted(what: Callable[[str], set], names: list[str]) -> DataFrame:
        """(names, neg, pos): in how many texts of each class what it finds in a text is found."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: tuple[Counter, Counter] = (Counter(), Counter())

            def rows(y: int) -> Iterator[pa.RecordBatch]:
                keys, n = list(counts[y]), list(counts[y].values())
                for a in range(0, len(keys), 1 << 16):
                    part = keys[a : a + (1 << 16)]
                    columns = [pa.array([k[i] for k in part], pa.string()) for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([y] * len(part), pa.int32()), pa.array(n[a : a + (1 << 16)], pa.int64())], [*names, "y", "n"])
                counts[y].clear()

            for batch in batches:
                for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    counts[y].update(what(text.as_py()))
                    if len(counts[y]) > 500_000:
                        yield from rows(y)
            yield from rows(0)
            yield from rows(1)

        found = texts.mapInArrow(run, ", ".join(f"{n} string" for n in names) + ", y int, n bigint")
        return found.groupBy(*names).agg((F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)) * F.lit(weight)).alias("neg"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).cast("double").alias("pos"))

    true_neg = n_neg * weight
    share = n_pos / (n_pos + true_neg)
    log = lambda x, e: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / (e * (F.col("neg") + F.col("pos"))))).otherwise(0.0)
    ratio = 2 * (log("pos", share) + log("neg", 1 - share))
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (true_neg + 1))
    telling = counted(lambda text: {(c,) for c in candidates(text)}, ["name"]).filter((ratio >= EVIDENCE) & (odds >= ODDS))
    # What passes both tests needs several positive texts of the sample: its size bounds what comes here.
    lexicon = Lexicon(select([tuple(r) for r in telling.collect()], true_neg, n_pos))
    if lexicon.entries:
        first = spark.sparkContext.broadcast(lexicon)
        near = counted(lambda text: first.value.phrases(text), ["entry", "phrase"]).filter("phrase = '' OR (neg >= 2 AND 9 * pos <= neg)")
        learnt = spared([tuple(r) for r in near.collect()])
        lexicon = Lexicon(lexicon.entries, tuple(sorted({*EXCEPTIONS, *learnt})))
        first.unpersist()
    last = spark.sparkContext.broadcast(lexicon)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [last.value.features(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.float64()), *(pa.array([x[k] for x in out], pa.float64()) for k in range(3))], ["y", "a", "b", "c"])

    table = texts.mapInArrow(features, "y double, a double, b double, c double").toArrow().to_pandas().to_numpy()
    last.unpersist()
    lexicon.model = logistic(table[:, 1:], table[:, 0], -math.log(weight))
    return lexicon


def scored(df: DataFrame, lexicon: Lexicon, text: str = "text", keep_text: bool = True) -> DataFrame:
    """df with __tox_score; without the text itself if it isn't to be kept."""
    columns = [c for c in df.columns if c != text or keep_text]
    rows = df.select(*(F.col(f"`{c}`") for c in columns), F.col(text).alias("__tox_text"))
    known = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [known.value.score(x.as_py()) for x in batch.column(len(columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*columns, "__tox_score"])

    schema = T.StructType([f for f in rows.schema.fields if f.name != "__tox_text"] + [T.StructField("__tox_score", T.DoubleType())])
    # By position, as names with dots are not found there.
    return rows.toDF(*(f"_{k}" for k in range(len(columns) + 1))).mapInArrow(run, schema)


def score_texts(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    lexicon = learn(docs.select("doc_id", "text"), labels, folds)
    rows = docs.select("doc_id", (remainder("doc_id", folds) == 0).alias("held_out"), "text")
    return scored(rows, lexicon, keep_text=False).select("doc_id", "held_out", F.col("__tox_score").alias("score"), (F.col("__tox_score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """The documents with scores below threshold, with the columns of docs."""
    lexicon = learn(docs.select("doc_id", "text"), labels, folds)
    return scored(docs, lexicon).filter(F.col("__tox_score") < threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
