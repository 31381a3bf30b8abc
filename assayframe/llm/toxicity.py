"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The lexicon is counted over all labelled training rows: a word enters when it stands after different words in toxic
texts (contexts, so that one text copied a thousand times does not make a word) and its share of toxic texts is several times its share of
clean ones. Word beginnings are learned the same way: inflected forms never seen count by them. Every word and beginning is counted and tested
in Spark, joined by shuffle; only the final lists are bounded, by strength. The classifier and the calibration are fitted on a bounded sample,
`SAMPLE` labelled rows chosen by a hash of the id. Trees must see words that a lexicon took by chance, so the counts are kept by fold, and a
row of the sample gets its features from the lexicon that was counted without its own fold."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import crc_mod, packed, small_batches, written

SAMPLE = 20_000
LEXICON = 2000
FOLDS = 3
CONTEXTS, RATIO = 4, 8
STEMS = (4, 7)  # least and greatest length of word beginnings
STEM_CONTEXTS, STEM_RATIO = 8, 4
HELD = 200_000  # entries a task sums up before it sends them
KEPT = 400_000  # words a task remembers
THRESHOLD = 0.3
# Second-person words of English, German, French and Spanish.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine deinen euch ihr tu te toi ton ta vous votre vos tú ti tus usted ustedes vosotros".split())
# Plain insults that count without having been seen in the labels.
SEED_WORDS = frozenset(("idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown imbecile "
                        "idiota imbécil estúpido estúpida basura idiote imbécile crétin stupide ordure dummkopf vollidiot arschloch abschaum").split())
PLAIN = str.maketrans("013457@$!|", "oieastasii")
EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$")
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]+\b")
ODD = re.compile(r"[^\w\s.,;:'\"!?()-]")
LEET = re.compile(r"(?<=[^\W\d_])[0-9@$!|*#]+(?=[^\W\d_])")
SPACED = re.compile(r"\b(?:[^\W\d_][ .*_-]){3,}[^\W\d_]\b")
LONE = re.compile(r"(?:(?<=[\W_])|^)[^\W\d_](?=[\W_]|$)")  # a letter with no other word sign beside it
SIDE_BY_SIDE = re.compile(r"[1-9]{2}|[4-9]")  # where a spaced word can stand, in the lone letters of each word
RUN = re.compile(r"([^\W\d_])\1{2,}|[!?]{2,}")
NAMES = ["words", "hits", "density", "kinds", "near_you", "you", "capitals", "shouting", "marks", "odd", "hidden", "leet", "spaced", "runs", "stems", "stem_density"]


def words_of(text: str) -> list[str]:
    """Lower-case words without outer punctuation."""
    return [w for w in (EDGE.sub("", x) for x in text.lower().split()) if w]


def stems_of(word: str) -> list[str]:
    """Beginnings of a word, shorter than the word itself or equal to it."""
    return [word[:n] for n in range(STEMS[0], min(STEMS[1], len(word)) + 1)]


def unhidden(word: str) -> str:
    """The word with usual digit and symbol stand-ins undone and other marks dropped."""
    return re.sub(r"[\W_]", "", word.translate(PLAIN))


class Reader:
    """Dense features of texts under one lexicon. What a word alone decides is kept, for a bounded number of words."""

    def __init__(self, lexicon: frozenset[str], stems: frozenset[str] = frozenset()):
        self.lexicon, self.stems = lexicon, stems
        self.kept: dict[str, tuple] = {}

    def word(self, x: str) -> tuple | None:
        """Lower case, kind (1: in the lexicon, 2: in it once unhidden, 3: second person), begins like a toxic word, lone letters, stand-ins
        between letters, odd signs, repeats, capitals, shouted words; none if all of them are nothing."""
        core = x.rstrip(".,;:")
        simple = core.isalpha() and core.islower()  # no stand-ins, odd signs or capitals
        w = core if simple else EDGE.sub("", x.lower())
        kind = 1 if w in self.lexicon else 3 if w in YOU else 0
        if not kind and not w.isalpha() and unhidden(w) in self.lexicon:
            kind = 2
        begun = False
        if len(w) >= STEMS[0]:
            for n in range(STEMS[0], STEMS[1] + 1):
                if w[:n] in self.stems:
                    begun = True
                    break
        lone = int(len(core) == 1) if simple else len(LONE.findall(x))
        leet = odd = upper = shout = 0
        if not simple:
            leet, odd = len(LEET.findall(x)), len(ODD.findall(x))
            if not x.islower():
                upper = sum(map(len, CAPITALS.findall(x)))
                shout = sum(len(c) > 2 for c in SHOUTED.findall(x)) if upper > 2 else 0
        facts = (kind, begun, lone, leet, odd, len(RUN.findall(x)), upper, shout)
        return (x.lower(), *facts) if any(facts) else None

    def features(self, text: str | None) -> list[float]:
        """Values in the order of `NAMES`; null is the empty text."""
        text = text or ""
        raw = text.split()
        n, chars = max(1, len(raw)), max(1, len(text))
        kept = self.kept
        if len(kept) > KEPT:
            kept.clear()
        times = Counter(raw)
        for x in [x for x in times if x not in kept]:
            kept[x] = self.word(x)
        hits = hidden = you = begun = lone = leet = odd = runs = upper = shout = 0
        kinds = set()
        for x in times:
            if facts := kept[x]:
                m = times[x]
                low, kind, b, single, c, d, e, f, g = facts
                if kind == 3:
                    you += m
                elif kind:
                    hits += m
                    hidden += m * (kind == 2)
                    kinds.add(low)
                begun, lone, leet, odd, runs, upper, shout = begun + m * b, lone + m * single, leet + m * c, odd + m * d, runs + m * e, upper + m * f, shout + m * g
        spaced = []
        if lone > 3 and SIDE_BY_SIDE.search("".join([str(min(9, facts[3])) if (facts := kept[x]) else "0" for x in raw])):
            spaced = [m.group() for m in SPACED.finditer(text)]
        hidden += sum(unhidden(x.lower()) in self.lexicon for x in spaced)
        near = 0
        if hits and you:
            which = [facts[1] if (facts := kept[x]) else 0 for x in raw]
            at_hits = np.array([i for i, k in enumerate(which) if k in (1, 2)])
            at_you = np.array([-100, *(i for i, k in enumerate(which) if k == 3), 10**9])
            at = np.searchsorted(at_you, at_hits)
            near = int(((at_hits - at_you[at - 1] <= 5) | (at_you[at] - at_hits <= 5)).sum())
        return [float(np.log1p(len(raw))), float(hits + hidden), (hits + hidden) / n, float(len(kinds)), near / n, you / n,
                upper / chars, shout / n, (text.count("!") + text.count("?")) / chars, odd / chars, float(hidden),
                leet / n, len(spaced) / n, runs / n, float(begun), begun / n]


def features(text: str | None, lexicon: frozenset[str], stems: frozenset[str] = frozenset()) -> list[float]:
    """Dense features of one text."""
    return Reader(lexicon, stems).features(text)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled training rows (doc_id, text, toxic): ids whose crc32 modulo 4 is not 2; of several labels the highest.

    Labels grow with the corpus, so they are joined by shuffle at every size."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return docs.select("doc_id", "text").where(crc_mod(F.col("doc_id"), 4) != 2).join(marks.hint("shuffle_merge"), "doc_id")


def _toxic_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (stem, w, p, fold, n): in n texts of the fold the first place of the word or beginning has the context hash p."""
    total: dict[tuple[bool, str, int, int], int] = {}
    for batch in batches:
        for text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            first: dict[tuple[bool, str], str] = {}
            before = ""
            for w in words_of(text or ""):
                if (False, w) not in first:
                    first[False, w] = before
                    for b in stems_of(w):
                        first.setdefault((True, b), before + " " + w)
                before = w
            for (stem, w), context in first.items():
                key = (stem, w, xxhash.xxh64_intdigest(context.encode("utf-8", "surrogatepass")) >> 1, fold)
                total[key] = total.get(key, 0) + 1
            if len(total) > HELD:
                yield _entries(total, ["stem", "w", "p", "fold"])
                total = {}
    yield _entries(total, ["stem", "w", "p", "fold"])


def _clean_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (stem, w, fold, n): n texts of the fold hold the word or beginning."""
    words, stems = Counter(), Counter()

    def sent():
        return _entries({(False, w, f): n for (w, f), n in words.items()} | {(True, w, f): n for (w, f), n in stems.items()}, ["stem", "w", "fold"])

    for batch in batches:
        for text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            mine = set(words_of(text or ""))
            words.update([(w, fold) for w in mine])
            stems.update([(b, fold) for b in {b for w in mine for b in stems_of(w)}])
            if len(words) + len(stems) > HELD:
                yield sent()
                words, stems = Counter(), Counter()
    yield sent()


def _entries(total: dict[tuple, int], names: list[str]) -> pa.RecordBatch:
    kinds = {"stem": pa.bool_(), "w": pa.string(), "p": pa.int64(), "fold": pa.int32()}
    keys = list(zip(*total)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(k, kinds[x]) for k, x in zip(keys, names)] + [pa.array(list(total.values()), pa.int64())], [*names, "n"])


def lexicons(rows: DataFrame, sizes: dict[tuple[int, int], int], folds: int = FOLDS, size: int = LEXICON) -> list[tuple[list[str], list[str]]]:
    """Words and word beginnings of toxic texts, at most `size` each, strongest first: counted without fold 0, without fold 1 and so on, and last
    over all `rows(text, toxic, fold)`. `sizes` are the numbers of texts by (toxic, fold).

    An entry needs `CONTEXTS` (`STEM_CONTEXTS`) different contexts in toxic texts, and a share of the toxic texts over `RATIO`
    (`STEM_RATIO`) times its share of the clean texts, one clean text added. All entries of `rows` are tested."""
    def by_fold(prefix):
        return [F.coalesce(F.sum(F.when(F.col("fold") == k, F.col("n"))), F.lit(0)).alias(f"{prefix}{k}") for k in range(folds)]

    def without(prefix, k):
        return sum((F.col(f"{prefix}{j}") for j in range(folds) if j != k), F.lit(0))

    def limit(stem, word):
        return F.when(F.col("stem"), stem).otherwise(word)

    cases = range(folds + 1)
    fields = "stem boolean, w string, fold int, n long"
    bad = rows.where("toxic > 0").select("text", "fold").mapInArrow(_toxic_entries, "stem boolean, w string, p long, fold int, n long").groupBy("stem", "w", "p").agg(*by_fold("t"))
    bad = bad.groupBy("stem", "w").agg(*[F.count(F.when(without("t", k) > 0, 1)).alias(f"contexts{k}") for k in cases], *[F.sum(without("t", k)).alias(f"toxic{k}") for k in cases])
    bad = bad.where(F.col(f"contexts{folds}") >= limit(STEM_CONTEXTS, CONTEXTS))
    good = rows.where("toxic <= 0").select("text", "fold").mapInArrow(_clean_entries, fields).groupBy("stem", "w").agg(*by_fold("c"))
    found = bad.hint("shuffle_merge").join(good, ["stem", "w"], "left").fillna(0, [f"c{k}" for k in range(folds)])
    ratios = []
    for k in cases:
        toxic, clean = (sum(n for (t, f), n in sizes.items() if t == mark and f != k) for mark in (1, 0))
        ratio = F.col(f"toxic{k}") / F.lit(max(1, toxic)) / ((without("c", k) + 1) / F.lit(max(1, clean)))
        fits = (F.col(f"contexts{k}") >= limit(STEM_CONTEXTS, CONTEXTS)) & (ratio > limit(STEM_RATIO, RATIO)) & F.lit(bool(toxic and clean))
        ratios.append(F.when(fits, ratio).alias(f"r{k}"))
    found = written(found.select("stem", "w", *ratios).where(F.coalesce(*[f"r{k}" for k in cases]).isNotNull()), "toxic-entries")
    return [tuple([r["w"] for r in found.where((F.col("stem") == stem) & F.col(f"r{k}").isNotNull()).orderBy(F.desc(f"r{k}"), "w").limit(size).select("w").collect()]
                  for stem in (False, True)) for k in cases]


def learn(rows: DataFrame, toxic: int, clean: int, size: int = LEXICON) -> tuple[list[str], list[str]]:
    """The lexicon of `lexicons` over all rows; `toxic` and `clean` are the numbers of texts."""
    return lexicons(rows.withColumn("fold", F.lit(0)), {(1, 0): toxic, (0, 0): clean}, 1, size)[-1]


def learn_stems(rows: DataFrame, toxic: int, clean: int, size: int = LEXICON) -> list[str]:
    """The word beginnings of `learn`."""
    return learn(rows, toxic, clean, size)[1]


class Model:
    """Lexicon, word beginnings, boosted trees and calibration; all of bounded size."""

    def __init__(self, lexicon: frozenset[str], stems: frozenset[str], trees, isotonic):
        self.lexicon, self.stems, self.trees, self.isotonic = lexicon, stems, trees, isotonic

    def scored(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Rows (row, score): each row of `df` as a struct with the calibrated probability that its text is toxic, 0 to 1; null and empty
        texts get one too."""
        if self.trees is None:
            return packed(df, score=F.lit(0.0))
        mine = packed(small_batches(df), _features=array_to_vector(feature_column(F.col(text), self.lexicon, self.stems)))
        x, y = (list(map(float, v.toArray())) for v in (self.isotonic.boundaries, self.isotonic.predictions))
        p = self.trees.transform(mine).select("row", vector_to_array("_prob")[1].alias("p"))
        return p.select("row", _steps(F.col("p"), x, y).alias("score"))

    def score(self, df: DataFrame, text: str = "text", into: str = "score") -> DataFrame:
        """`df` with the score as column `into`."""
        return self.scored(df, text).select(*[f"row.`{c}`" for c in df.columns if c != into], F.col("score").alias(into))


def _steps(p, x: list[float], y: list[float]):
    """The calibration's piecewise linear function at p, kept within 0 and 1."""
    xs, ys = F.array(*map(F.lit, x)), F.array(*map(F.lit, y))
    i = F.size(F.filter(xs, lambda v: v <= p))  # boundaries at or below p
    a, b = F.get(xs, i - 1), F.get(xs, i)
    low, high = F.get(ys, i - 1), F.get(ys, i)
    between = F.when(i == 0, y[0]).when(i >= len(x), y[-1]).otherwise(low + (high - low) * (p - a) / (b - a))
    return F.least(F.greatest(between, F.lit(0.0)), F.lit(1.0))


def feature_column(text, lexicon: frozenset[str], stems: frozenset[str]):
    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(lexicon, stems)
        for texts in parts:
            yield pd.Series(list(map(reader.features, texts)), dtype=object)

    return run(text)


def fold_features(text, fold, lists: list[tuple[frozenset[str], frozenset[str]]]):
    """Features of a text under the lexicon of its fold."""
    @F.pandas_udf("array<double>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        readers = [Reader(*x) for x in lists]
        for texts, folds in parts:
            yield pd.Series([readers[f].features(t) for t, f in zip(texts, folds)], dtype=object)

    return run(text, fold)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the labelled training rows: the lexicon from all of them, the classifier and its calibration from
    about `sample` of them. With no row of one of the classes every score is 0."""
    fold = F.pmod(F.xxhash64("doc_id", F.lit("lexicon")), F.lit(FOLDS)).cast("int")
    rows = written(training_rows(small_batches(docs), labels).withColumn("fold", fold), "toxic-rows")
    sizes = {(r["toxic"], r["fold"]): r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic"), "fold").agg(F.count("*").alias("n")).collect()}
    lists = [(frozenset(words) | SEED_WORDS, frozenset(begun)) for words, begun in lexicons(rows, sizes)]
    if {t for t, _ in sizes} != {0, 1}:
        return Model(*lists[-1], None, None)
    share = min(1.0, sample / sum(sizes.values()))
    pick = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    few = rows.where(pick < int(share * 1_000_000)).select(
        (F.col("toxic") > 0).cast("double").alias("label"), array_to_vector(fold_features(F.col("text"), F.col("fold"), lists[:FOLDS])).alias("_features"),
        (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)) == 0).alias("calibrates"))
    few = written(few, "toxic-sample").coalesce(4)
    have = {(r["calibrates"], r["label"]) for r in few.groupBy("calibrates", "label").count().collect()}
    if len({label for _, label in have}) < 2:
        return Model(*lists[-1], None, None)
    fit, hold = (few.where("not calibrates"), few.where("calibrates")) if len(have) == 4 else (few, few)
    learner = GBTClassifier(labelCol="label", featuresCol="_features", predictionCol="_predicted", maxIter=12, maxDepth=3, minInstancesPerNode=10, stepSize=0.3, seed=7)
    trees = learner.setRawPredictionCol("_raw").setProbabilityCol("_prob").fit(fit)
    seen = trees.transform(hold).select("label", vector_to_array("_prob")[1].alias("p"))
    isotonic = IsotonicRegression(labelCol="label", featuresCol="p").fit(seen)
    return Model(*lists[-1], trees, isotonic)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs(doc_id, text)`; repeated rows give repeated results,
    further columns are ignored, an empty table gives no rows."""
    scored = train(docs, labels).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, all columns as they were, whatever their names.

    Null and empty texts are scored like any other and stay if the score is low; repeated rows stay or go together; without labels of both classes
    all rows stay; an empty table gives no rows."""
    return train(docs, labels).scored(docs).where(F.col("score") < THRESHOLD).select("row.*")
