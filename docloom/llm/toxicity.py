"""Toxicity of texts after noisy-channel restoration of disguised words.

A word that holds stand-ins for letters (1d10t), separators (i.d.i.o.t, i d i o t) or stretched letters
(idiooot) is read as the output of a noisy channel: each sign may stand for one of several letters or,
if it repeats or separates, for none. A Viterbi search over this lattice finds the likeliest letters under a
trigram model of the language's characters. The score is a logistic function of the evidence of the words of
the raw and the restored text.

The character model, the words' evidence and the logistic function are learned from all labelled rows of the
training folds; equal texts count once, as toxic if a row of theirs is. Evidence are words
and stems (the first 4, 5 or 6 letters of a word) that occur in one in a hundred toxic texts (three at least) and
TIMES as often there as elsewhere, and of whose texts PURE are toxic; LEXICON of them at most. The character model is made of
the 200,000 most frequent trigrams of these rows' words and those of the evidence. Texts are scored whole.

Defined results: null and empty texts have no words and get the score of no evidence. Without labelled rows of
both kinds the score is the share of toxic rows, or 0. Rows repeat as they come. Only text is read for a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import crc_mod, keep_rows, sift, slices, text_key, write_shared

LEXICON, THRESHOLD = 2000, 0.3
SUPPORT, TIMES, PURE, STEMS = 0.01, 20.0, 0.95, (6, 5, 4)
#: Letters a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h", "%": "o", "&": "a"}
SEPARATORS = set(".-_~'·,:;/\\")
EDGES = "\"'.,;:?()[]{}<>“”„‚’‘«»…-–—"
_TWICE = re.compile(r"(.)\1+")
_LETTER = re.compile(r"[^\W\d_]")
_SUSPECT = re.compile(r"[0-9@$!|+(€£¡*#%&.\-_~'·,:;/\\]|(\w)\1")
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t._*\-]{1,3}){2,}\S(?![^\s.,;:!?])")
#: The least probability of a letter, and what two letters can differ by.
FLOOR = 0.01 / 64
LEAD = -2 * math.log(FLOOR)
LETTER_COST, SIGN_COST, DROP_COST, REPEAT_COST = 0.0, -0.7, -7.0, -0.3


class Language:
    """Trigram model of the characters of words, interpolated with bigrams and a floor."""

    def __init__(self, words: dict[str, float]):
        self.three: dict[str, float] = defaultdict(float)
        self.two: dict[str, float] = defaultdict(float)
        self.one: dict[str, float] = defaultdict(float)
        for word, n in words.items():
            padded = f"^^{word}$"
            for i in range(2, len(padded)):
                self.three[padded[i - 2 : i + 1]] += n
                self.two[padded[i - 1 : i + 1]] += n
                self.one[padded[i]] += n
        self.three_of: dict[str, float] = defaultdict(float)
        self.two_of: dict[str, float] = defaultdict(float)
        for k, n in self.three.items():
            self.three_of[k[:2]] += n
        for k, n in self.two.items():
            self.two_of[k[0]] += n
        self.total = sum(self.one.values()) or 1.0
        self.three, self.two, self.one = dict(self.three), dict(self.two), dict(self.one)
        self.met: dict[str, float] = {}

    def log(self, x: str, y: str, z: str) -> float:
        """Log probability of z after x and y."""
        if (known := self.met.get(x + y + z)) is not None:
            return known
        if len(self.met) >= 200_000:
            self.met.clear()
        p = FLOOR + 0.09 * self.one.get(z, 0) / self.total
        if (n := self.two_of.get(y)) is not None:
            p += 0.3 * self.two.get(y + z, 0) / n
        if (n := self.three_of.get(x + y)) is not None:
            p += 0.6 * self.three.get(x + y + z, 0) / n
        found = self.met[x + y + z] = math.log(p)
        return found

    def decode(self, word: str) -> str:
        """The likeliest letters behind a disguised word, by Viterbi search; states are the last two letters.

        Letters are held as chains (letters before, letter). After two letters more all states are the same, so one that
        lies behind another by more than two letters can make up (LEAD) is not on the best path and goes."""
        states: dict[tuple[str, str], tuple[float, tuple | None]] = {("^", "^"): (0.0, None)}
        last = ""
        for sign in word:
            options = [(c, SIGN_COST) for c in SIGNS.get(sign, "")]
            if sign.isalpha():
                options.append((sign, LETTER_COST))
            repeated = sign == last
            drop = 0.0 if sign in SEPARATORS or sign.isspace() else REPEAT_COST if repeated else DROP_COST
            kept = not sign.isalpha() or repeated
            following: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            for (x, y), (cost, text) in states.items():
                if kept and ((x, y) not in following or cost + drop > following[x, y][0]):
                    following[x, y] = (cost + drop, text)
                for c, price in options:
                    total = cost + price + self.log(x, y, c)
                    if (y, c) not in following or total > following[y, c][0]:
                        following[y, c] = (total, (text, c))
            least = max(cost for cost, _ in following.values()) - LEAD
            states = {state: found for state, found in following.items() if found[0] >= least}
            last = sign
        ends = [(cost + self.log(x, y, "$"), text) for (x, y), (cost, text) in states.items()]
        most = max(cost for cost, _ in ends)
        return max(spelled(text) for cost, text in ends if cost == most)


def spelled(chain: tuple | None) -> str:
    """The letters of a chain."""
    out = []
    while chain is not None:
        chain, letter = chain
        out.append(letter)
    return "".join(reversed(out))


class Verdicts(dict):
    """For each word met: the evidence words it holds, as they stand or restored; emptied when it is full."""

    def __init__(self, language: Language, evidence: dict[str, float], most: int = 200_000):
        super().__init__()
        self.language, self.evidence, self.most = language, evidence, most
        self.shortest = min((len(w.rstrip("*")) for w in evidence), default=1)
        self.squeezed = {squeeze(w): w for w in evidence if not w.endswith("*")}
        self.long = [(w, w.rstrip("*")) for w in evidence if len(w) > 3]

    def known(self, word: str) -> str | None:
        """The heaviest evidence that a word or its stem is."""
        found = [k for k in features(word) if k in self.evidence]
        return max(found, key=lambda k: (self.evidence[k], k)) if found else None

    def __missing__(self, word: str) -> str | None:
        if len(self) >= self.most:
            self.clear()
        bare = word.strip(EDGES)
        found = self.known(bare)
        if found is None and len(bare) >= self.shortest and _SUSPECT.search(bare) and _LETTER.search(bare):
            restored = restore(bare, self.language)
            found = self.known(restored) or self.squeezed.get(squeeze(restored))
        self[word] = found
        return found

    def of(self, text: str) -> set[str]:
        """The evidence words in a text."""
        low = text.lower()
        found = {self[w] for w in set(low.split())}
        for m in _SPACED.finditer(low):
            joined = "".join(m.group().split())
            if _LETTER.search(joined):
                restored = restore(joined, self.language)
                found |= {w for w, part in self.long if part in restored} | {self.known(restored)}
                once = squeeze(restored)
                found |= {w for part, w in self.squeezed.items() if len(part) > 3 and part in once}
        found.discard(None)
        return found


def squeeze(word: str) -> str:
    """A word with its repeated letters written once."""
    return _TWICE.sub(r"\1", word)


def features(word: str) -> list[str]:
    """A word and its stems, which end in a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def restore(word: str, language: Language) -> str:
    """A word with its disguise removed; words of letters alone, none three times running, are their own reading.

    Signs at the end are first taken as punctuation; only if nothing but letters is left is that the answer."""
    stretched = re.search(r"(.)\1\1", word)
    trimmed = word.rstrip("!*#%&+|")
    if trimmed.isalpha() and not stretched:
        return trimmed
    return language.decode(word)


def restore_text(text: str, language: Language) -> str:
    """A whole text with spaced-out and disguised words restored."""
    joined = _SPACED.sub(lambda m: restore("".join(m.group().split()), language), text.lower())
    return re.sub(r"\S+", lambda m: restore(m.group().strip(EDGES), language) if _SUSPECT.search(m.group()) and _LETTER.search(m.group()) else m.group(), joined)


class Model:
    """Language, evidence words with weights, and the logistic function's two numbers."""

    def __init__(self, language: Language, evidence: dict[str, float], slope: float, base: float):
        self.language, self.evidence, self.slope, self.base = language, evidence, slope, base

    def score(self, found: set[str]) -> float:
        return self.of(sum(sorted(self.evidence[w] for w in found)))

    def of(self, total: float) -> float:
        """The score of evidence whose weights have this sum."""
        x = self.base + self.slope * total
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, toxic = batch.column("text"), batch.column("toxic").to_pylist()
        for lo, hi in slices(texts):
            counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
            for text, t in zip(texts.slice(lo, hi - lo).to_pylist(), toxic[lo:hi], strict=True):
                found = {b for w in set(text.lower().split()) if (b := w.strip(EDGES)).isalpha() and len(b) <= 40}
                counts[t].update(found)
                for n in STEMS:
                    counts[t].update({b[:n] + "*" for b in found if len(b) > n})
            words = list(counts[True].keys() | counts[False].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[True][w] for w in words], pa.int64()), pa.array([counts[False][w] for w in words], pa.int64())], ["word", "n1", "n0"])


def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if len(word) > 1 and not word.endswith("*"):
                counts[word] += n
        grams: Counter = Counter()
        for word, n in counts.items():
            padded = f"^^{word}$"
            for i in range(len(padded) - 2):
                grams[padded[i : i + 3]] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["gram", "n"])


def evidence(shared):
    """The last column, text, becomes x, the sum of the weights of its evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language, weights = shared.value
        verdicts = Verdicts(language, weights)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts):
                x = [sum(sorted(weights[w] for w in verdicts.of(t or ""))) for t in texts.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), pa.array(x, pa.float64())], [*batch.schema.names[:-1], "x"])

    return run


def logistic(seen: DataFrame) -> tuple[float, float]:
    """Slope and base by Newton's method, with a weak pull to 0 that keeps separable rows finite, from x and its toxic and other rows (n1, n0).

    Only sums are collected; they are sums of decimals, which do not depend on the order of the rows."""
    w, x, n = np.zeros(2), F.col("x"), F.col("n1") + F.col("n0")
    for _ in range(50):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x * float(w[0]) + float(w[1])))))
        rest, bend = F.col("n1") - n * p, n * p * (1 - p)
        g1, g0, h11, h10, h00 = map(float, seen.select(*[F.sum(c.cast("decimal(38,12)")) for c in (rest * x, rest, bend * x * x, bend * x, bend)]).first())
        step = np.linalg.solve(np.array([[h11, h10], [h10, h00]]) + 0.01 * np.eye(2), np.array([g1, g0]) - 0.01 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def training(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> tuple[DataFrame, DataFrame]:
    """All labelled texts of the training folds, each text once: key, doc_id (the smallest) and toxic; toxic and text.

    Texts are matched by their keys; only those rows are shuffled whole whose id is the smallest of a labelled text."""
    usable = labels.where("doc_id is not null and toxic is not null").where(crc_mod(F.col("doc_id"), folds) != held)
    usable = usable.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null").where(crc_mod(F.col("doc_id"), folds) != held)
    chosen = rows.select("doc_id", text_key(F.col("text")).alias("key")).join(usable, "doc_id").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    chosen = write_shared(chosen, "chosen")
    some, _ = sift(rows.withColumn("short", F.xxhash64("doc_id")), "short", chosen.select(F.xxhash64("doc_id")))
    found = some.withColumn("key", text_key(F.col("text"))).join(chosen, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
    return chosen, write_shared(found.select("toxic", "text"), "training")


def learn(rows: DataFrame) -> Model:
    """Language and evidence from rows of toxic and text, each text once; the logistic function is still to be fitted if there are both kinds."""
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    if not n1 or not n0:
        return Model(Language({}), {}, 0.0, 500.0 if n1 else -500.0)
    words = rows.mapInArrow(distinct_words, "word string, n1 bigint, n0 bigint").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    words = write_shared(words, "evidence")
    weight = F.log((F.col("n1") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("n0") + 0.5) / F.lit(n0 + 1.0))
    found = words.where(f"n1 >= {max(3, math.ceil(SUPPORT * n1))} and length(word) >= 3").withColumn("weight", weight).where(F.col("weight") >= math.log(TIMES)).where(f"n1 >= {PURE} * (n1 + n0)")
    weights = {r.word: r.weight for r in found.orderBy(F.desc(F.col("weight") * F.col("n1")), "word").limit(LEXICON).collect()}
    grams = words.select("word", (F.col("n1") + F.col("n0")).alias("n")).mapInArrow(trigrams, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    language = Language({})
    counts = {r.gram: float(r.n) for r in grams.orderBy(F.desc("n"), "gram").limit(200_000).collect()}
    total = sum(counts.values()) or 1.0
    for word in weights:  # the words to be found make up a fifth of the model
        padded = f"^^{word}$".replace("*$", "")
        for g in (padded[i : i + 3] for i in range(len(padded) - 2)):
            counts[g] = counts.get(g, 0.0) + total / 4 / len(weights) / (len(padded) - 2)
    language.three = counts
    two, one, of3, of2 = (defaultdict(float) for _ in range(4))
    for g, c in counts.items():
        two[g[1:]] += c
        one[g[2]] += c
        of3[g[:2]] += c
        of2[g[1]] += c
    language.two, language.one, language.three_of, language.two_of, language.total = dict(two), dict(one), of3, of2, sum(one.values())
    return Model(language, weights, 1.0, 0.0)


def fitted(model: Model, seen: DataFrame) -> Model:
    """The model with the logistic function of rows of toxic and x; there are rows of both kinds."""
    seen = write_shared(seen.groupBy("x").agg(F.count_if("toxic").alias("n1"), F.count_if(~F.col("toxic")).alias("n0")), "seen", waves=1)
    return Model(model.language, model.evidence, *logistic(seen))


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> Model:
    _, rows = training(docs, labels, folds, held)
    model = learn(rows)
    if model.slope == 0:
        return model
    shared = docs.sparkSession.sparkContext.broadcast((model.language, model.evidence))
    return fitted(model, rows.mapInArrow(evidence(shared), "toxic boolean, x double"))


def scorer(model: Model):
    """The last column, x, becomes the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([model.of(x) for x in batch.column("x").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], [*batch.schema.names[:-1], "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of each row.

    x is found once for each row; the logistic function is fitted on the x of the training texts' rows."""
    chosen = None
    if model is None:
        chosen, rows = training(docs, labels, folds, held)
        model = learn(rows)
    shared = docs.sparkSession.sparkContext.broadcast((model.language, model.evidence))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), F.when(F.col("text").isNotNull(), text_key(F.col("text"))).alias("key"), "text")
    out = rows.mapInArrow(evidence(shared), "doc_id bigint, held_out boolean, key binary, x double")
    if chosen is not None and model.slope > 0:
        out = write_shared(out, "evidence_sums")
        known = out.where("not held_out").join(chosen, ["doc_id", "key"]).groupBy("key").agg(F.first("toxic").alias("toxic"), F.first("x").alias("x"))
        model = fitted(model, known.select("toxic", "x"))
    numbers = Model(Language({}), {}, model.slope, model.base)
    out = out.select("doc_id", "held_out", "x").mapInArrow(scorer(numbers), "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def judge():
        verdicts = Verdicts(shared.value.language, shared.value.evidence)
        return lambda text: shared.value.score(verdicts.of(text)) < THRESHOLD

    return keep_rows(docs, judge)
