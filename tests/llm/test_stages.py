"""The pipeline's stages: user columns of any name stay as they are, and the chain equals plain Python row by row."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken

import corpus_pipeline
from assayframe.llm import bpe, decontaminate, simhash, substrings, toxicity

NAMES = ["_hash", "_score", "_t1", "_t2", "_spans", "_features", "_p", "_raw", "_prob", "_predicted", "_n", "_k", "_drop", "row", "id", "hash", "score", "t1", "t2", "spans",
         "left", "loses", "n", "k", "drop", "fp", "u", "v", "h", "w0", "c_id", "c_hash", "item_id", "text_hash", "a", "b", "x", "toxic", "fold", "component_id", "with.dot"]
WORDS = [f"w{i}" for i in range(300)]


def line(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE, ITEM = line(1, 60), line(2, 30)


def texts():
    out = [None, None, "", "  ", "one", PASSAGE + " " + line(3, 80), line(4, 50) + "\n" + PASSAGE, "start " + ITEM + " " + line(5, 90), line(6, 70), line(6, 70), line(6, 69) + " changed",
           "You idiot, you moron! " + line(7, 10), "You are a stupid pathetic idiot, you scum", line(8, 1500), ITEM]
    r = random.Random(9)
    for i in range(200):
        out.append(("you idiot moron trash " if i % 3 == 0 else "") + line(100 + i, r.randint(5, 80)))
    return out


def rows():
    some = [(i, t) for i, t in enumerate(texts())]
    return some + [(8, texts()[8]), (None, line(55, 20)), (None, None), (5, "another text of the same id")]


@pytest.fixture(scope="module")
def wide(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.IntegerType())]
                          + [T.StructField(n, T.StringType()) for n in NAMES])
    return spark.createDataFrame([(i, t, len(t or ""), *[f"{n}-{i}" for n in NAMES]) for i, t in rows()], schema).repartition(4)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int("idiot" in (t or "")), 1) for i, t in rows() if i is not None], "doc_id long, toxic int, quality int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, line(77, 25))], "item_id long, text string")


@pytest.mark.parametrize("stage", ["toxicity", "simhash", "substrings", "decontamination"])
def test_user_columns_stay(stage, wide, labels, items):
    run = {"toxicity": lambda d: toxicity.keep_clean(d, labels), "simhash": simhash.keep_first, "substrings": substrings.without_repeats,
           "decontamination": lambda d: decontaminate.keep_clean(d, items)}[stage]
    out = run(wide)
    assert out.columns == wide.columns and out.dtypes == wide.dtypes
    got = out.collect()
    assert got and all(r[n] == f"{n}-{r['doc_id']}" for r in got for n in NAMES)
    have = Counter((r["doc_id"], r["text"], r["n_chars"]) for r in wide.collect())
    if stage != "substrings":
        assert not Counter((r["doc_id"], r["text"], r["n_chars"]) for r in got) - have
    assert run(wide.limit(0)).count() == 0


def plain_cut(some):
    words = [(i, (t or "").split()) for i, t in some]
    seen = Counter(tuple(w[k:k + 35]) for _, w in words for k in range(len(w) - 34))
    out = []
    for (i, t), (_, w) in zip(some, words):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k:k + 35])] > 1:
                gone[k:k + 35] = [True] * 35
        out.append((i, " ".join(x for x, y in zip(w, gone) if not y) if any(gone) else t))
    return out


def test_cut_texts(wide):
    want = Counter((i, t, len(t or "")) for i, t in plain_cut(rows()))
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in substrings.without_repeats(wide).collect()) == want


def plain_groups(some):
    fps = [(i, t, simhash.fingerprint(t)) for i, t in some]
    left, kept = list(range(len(fps))), []
    while left:
        group, todo = set(), [left[0]]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += [y for y in left if y not in group and (fps[x][2] ^ fps[y][2]).bit_count() <= 3]
        kept.append(group)
        left = [x for x in left if x not in group]
    return [[(fps[x][0], fps[x][1]) for x in g] for g in kept]


def shingles(text):
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_chain(spark, tmp_path_factory, items):
    """Nulls, empty texts, repeats, clashing columns: what `run` returns, from plain Python."""
    folder = str(tmp_path_factory.mktemp("chain"))
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "user") for i, t in rows()], "doc_id long, text string, lang string, source string, n_chars int, row string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int("idiot" in (t or "")), 1) for i, t in rows() if i is not None], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    toxic = {(r["doc_id"], r["text"]) for r in toxicity.train(docs, labels).score(docs).where("score >= 0.3").collect()}
    now = [x for x in rows() if x not in toxic]
    assert 0 < len(toxic) < 90
    # of each group one row stays; of an id with two texts the hash decides, so such a group is not planted
    now = [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in plain_groups(now)]
    now = plain_cut(now)
    asked = [s for s in map(shingles, (ITEM, line(77, 25)))]
    now = [(i, t) for i, t in now if not any(5 * len(s & shingles(t)) >= 4 * len(s) for s in asked)]
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec = tiktoken.Encoding("chain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in now:
        ids = codec.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(codec.decode_bytes(ids)).hexdigest()] += 1
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, got.collect())) == want
