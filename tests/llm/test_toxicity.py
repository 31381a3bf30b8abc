"""Toxicity against plain Python: features, lexicons by fold, and the scores of a whole small table."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from assayframe.llm import toxicity
from assayframe.llm.toxicity import EDGE, LEET, ODD, RUN, SPACED, YOU, stems_of, unhidden, words_of

MARKS = re.compile(r"[!?]")


def plain_features(text, lexicon, stems=frozenset()):
    """Word by word and sign by sign, without anything kept."""
    text = text or ""
    raw = text.lower().split()
    n = max(1, len(raw))
    hits, hidden, kinds, you = [], 0, set(), []
    begun = 0
    seen: dict[str, int] = {}
    stemmed: dict[str, bool] = {}
    for i, x in enumerate(raw):
        kind = seen.get(x)
        if kind is None:
            w = EDGE.sub("", x)
            kind = 1 if w in lexicon else 3 if w in YOU else 0
            if not kind and not w.isalpha() and unhidden(w) in lexicon:
                kind = 2
            seen[x] = kind
            stemmed[x] = bool(stems) and any(b in stems for b in stems_of(w))
        begun += stemmed[x]
        if kind:
            if kind == 3:
                you.append(i)
            else:
                hits.append(i)
                hidden += kind == 2
                kinds.add(x)
    spaced = [m.group() for m in SPACED.finditer(text)]
    hidden += sum(unhidden(x.lower()) in lexicon for x in spaced)
    near = 0
    if hits and you:
        at = np.searchsorted(you, hits)
        y = np.array([-100, *you, 10**9])
        near = int(((np.array(hits) - y[at] <= 5) | (y[at + 1] - np.array(hits) <= 5)).sum())
    chars = max(1, len(text))
    upper = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", text)))
    shout = sum(len(x) > 2 for x in re.findall(r"\b[A-ZÀ-ÖØ-Þ]+\b", text))
    return [float(np.log1p(len(raw))), float(len(hits) + hidden), (len(hits) + hidden) / n, float(len(kinds)), near / n, len(you) / n,
            upper / chars, shout / n, len(MARKS.findall(text)) / chars, len(ODD.findall(text)) / chars, float(hidden),
            len(LEET.findall(text)) / n, len(spaced) / n, len(RUN.findall(text)) / n,
            float(begun), begun / n]



ODD_TEXTS = [None, "", "  ", "a", "a b c d e", "i.d.i.o.t you", "x_y_z_w", "foo-a b c d", "a b.c d", "1d10t you id!ot", "AAA bbb ccc!!! ??", "You IDIOT, sh1t", "É É É É", "Ａｂ c d e f",
             "a.b.c.d. e f g h", "I D I O T S", "you " * 3000 + "idiot", "İstanbul ǅ ß", "x\x1cy\u2003z"]


def test_features():
    r = random.Random(1)
    texts = ODD_TEXTS + ["".join(r.choice("ab .*_-1@!?IDO yu\n") for _ in range(r.randint(1, 40))) for _ in range(1500)]
    lexicon, stems = frozenset(toxicity.SEED_WORDS | {"the", "zork", "ab", "bab"}), frozenset(["idio", "that", "aaaa"])
    reader = toxicity.Reader(lexicon, stems)
    for text in texts * 2:
        assert reader.features(text) == plain_features(text, lexicon, stems), text


def test_a_reader_forgets_within_its_bound(monkeypatch):
    monkeypatch.setattr(toxicity, "KEPT", 10)
    reader = toxicity.Reader(toxicity.SEED_WORDS)
    for i in range(50):
        text = f"w{i} x{i} y{i} idiot you"
        assert reader.features(text) == plain_features(text, toxicity.SEED_WORDS)
    assert len(reader.kept) < 20


def corpus():
    r = random.Random(7)
    common = [f"{a}{b}{c}" for a in "bdfg" for b in "aeio" for c in ("n", "rt", "mel")]
    out = []
    for i in range(900):
        words = [r.choice(common) for _ in range(r.randint(3, 60))]
        toxic = i % 6 == 0
        if toxic:
            words += [r.choice(["zork", "zorkan", "blirg", "you"]) for _ in range(r.randint(2, 5))]
            r.shuffle(words)
        out.append((i, " ".join(words), toxic))
    out += [(900 + i, t, False) for i, t in enumerate(ODD_TEXTS[:16])]
    return out


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "n") for i, t, _ in corpus()], "doc_id long, text string, _score int, _p int, _features int, fold string").repartition(4)
    labels = spark.createDataFrame([(i, int(x), 1) for i, _, x in corpus() if i % 9] + [(0, None, 1), (None, 1, 1), (2, 0, 0)], "doc_id long, toxic int, quality int")
    return docs, labels


def test_lexicons_leave_a_fold_out(spark):
    rows = [(t, int(x), i % 3) for i, t, x in corpus()]
    sizes = Counter((x, f) for _, x, f in rows)
    got = toxicity.lexicons(spark.createDataFrame(rows, "text string, toxic int, fold int").repartition(3), sizes)
    for k, (words, stems) in enumerate(got):
        some = [x for x in rows if x[2] != k]
        toxic, clean = sum(x for _, x, _ in some), sum(not x for _, x, _ in some)
        contexts, bad, good = {}, Counter(), Counter()
        for text, mark, _ in some:
            first, before = {}, ""
            for w in words_of(text or ""):
                if (False, w) not in first:
                    first[False, w] = before
                    for b in stems_of(w):
                        first.setdefault((True, b), before + " " + w)
                before = w
            for e, c in first.items():
                if mark:
                    bad[e] += 1
                    contexts.setdefault(e, set()).add(c)
                else:
                    good[e] += 1
        for stem, found, least, ratio in ((False, words, toxicity.CONTEXTS, toxicity.RATIO), (True, stems, toxicity.STEM_CONTEXTS, toxicity.STEM_RATIO)):
            want = {e[1]: (n / toxic) / ((good[e] + 1) / clean) for e, n in bad.items() if e[0] == stem and len(contexts[e]) >= least}
            want = {w: x for w, x in want.items() if x > ratio}
            assert sorted(found) == sorted(want) and found == sorted(want, key=lambda w: (-want[w], w))
    assert "zork" in got[-1][0] and "zork" in got[-1][1]


def test_scores(spark, tables):
    """The whole table is scored by plain features, Spark's own trees and a plain interpolation."""
    docs, labels = tables
    model = toxicity.train(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    plain = spark.createDataFrame([(i, plain_features(t, model.lexicon, model.stems)) for i, t, _ in corpus()], "doc_id long, f array<double>")
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import functions as F

    raw = model.trees.transform(plain.select("doc_id", array_to_vector("f").alias(model.trees.getFeaturesCol()))).select("doc_id", vector_to_array(model.trees.getProbabilityCol())[1].alias("p")).collect()
    x, y = (np.array(v.toArray()) for v in (model.isotonic.boundaries, model.isotonic.predictions))
    assert len(scored) == len(corpus()) and F
    for r in raw:
        assert scored[r["doc_id"]] == pytest.approx(float(np.interp(r["p"], x, y)), abs=1e-12)
    found = toxicity.predictions(docs, labels).toPandas().set_index("doc_id")
    assert (found.score == [scored[i] for i in found.index]).all() and (found.predicted == (found.score >= 0.3)).all()
    toxic = {i for i, _, t in corpus() if t}
    held = found[found.held_out]
    assert (held.predicted == [int(i in toxic) for i in held.index]).mean() > 0.97


def test_clean_rows_stay_as_they_are(tables):
    docs, labels = tables
    kept = toxicity.keep_clean(docs, labels)
    toxic = {i for i, _, t in corpus() if t}
    assert kept.columns == docs.columns
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert all((r["_score"], r["_p"], r["_features"], r["fold"]) == (1, 2, 3, "n") for r in rows.values())
    assert len(set(rows) & toxic) < 8 and len(rows) > 730
    assert toxicity.keep_clean(docs.limit(0), labels).count() == 0 and toxicity.keep_clean(docs, labels.limit(0)).count() == docs.count()
