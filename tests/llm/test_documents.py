"""Document operators against brute force: planted cases, nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash

from assayframe.llm import bpe, decontaminate, licenses, ngrams, shards, simhash, substrings, toxicity
from assayframe.llm.common import components, lower_words, plain_words

SCHEMA = "doc_id long, text string, n_words long, score double, shard int, size string, t1 int, h int, key string"
WORDS = [f"w{i}" for i in range(400)]


def line(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def planted():
    passage = line(1, 60)
    texts = [None, "", "   ", "one", "two words", line(2, 30), passage, passage + " tail", "head " + passage, line(3, 200), line(3, 200),
             "a " * 90, "a " * 200, "x y " * 60, "x y z " * 40, line(4, 3000), "É ß 中文 " + passage + " " + line(5, 40), line(6, 34), line(6, 35), line(6, 36),
             "  \x1f tab\tnew\nline\x0bvt\x0cff\rcr " + line(7, 50), line(8, 120).replace(" ", "\n")]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, line(2, 30)), (9, line(3, 200)), (None, line(9, 50)), (None, None)]
    return [(i, t, 1, 0.5, 2, "x", 3, 4, "k") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(planted(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_substrings(docs, none):
    texts = [(r[0], plain_words(r[1])) for r in planted()]
    seen = Counter(tuple(w[i:i + 35]) for _, w in texts for i in range(len(w) - 34))
    want = Counter()
    for doc_id, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i:i + 35])] > 1:
                gone[i:i + 35] = [True] * 35
        kept = b" ".join(x for x, y in zip(w, gone) if not y)
        want[doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    assert rows(substrings.digest(docs)) == want
    assert substrings.digest(none).count() == 0
    cut = substrings.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_few_words(spark, seed):
    """Texts over two words are full of runs and periods: every window is compared with a plain count."""
    r = random.Random(seed)
    texts = [(i, " ".join(r.choice("ab") * r.randint(1, 9) if j % 7 else "c " * r.randint(1, 20) for j in range(r.randint(1, 60)))) for i in range(40)]
    words = {i: t.split() for i, t in texts}
    seen = Counter(tuple(w[i:i + 8]) for w in words.values() for i in range(len(w) - 7))
    want = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 7):
            if seen[tuple(w[k:k + 8])] > 1:
                gone[k:k + 8] = [True] * 8
        want[i] = sum(gone)
    got = substrings.digest(spark.createDataFrame(texts, "doc_id long, text string"), size=8, rounds=4).collect()
    assert {x["doc_id"]: x["n_removed"] for x in got} == want


def fingerprint(text):
    w = lower_words(text)
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_simhash(docs, none):
    fps = [(r[0], fingerprint(r[1])) for r in planted()]
    values = sorted({f for _, f in fps})
    group = groups([(a, b) for a in values for b in values if (a ^ b).bit_count() <= 3], values)
    least = {}
    for i, f in fps:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    want = Counter((i, f"{f:016x}", least.get(group[f])) for i, f in fps)
    assert rows(simhash.digest(docs)) == want
    assert simhash.digest(none).count() == 0 and simhash.keep_first(none).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert len({group[fingerprint(r["text"])] for r in kept.collect()}) == kept.count() == len(set(group.values()))


@pytest.mark.parametrize("shard", [1, 5, 4096])
def test_bk_trees_lose_no_link(spark, shard):
    r = random.Random(shard)
    centres = [r.getrandbits(64) for _ in range(20)] + [0, (1 << 64) - 1]
    values = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for c in centres for _ in range(12)})
    fps = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(fps, 3, shard)).collect()}
    signed = [simhash._signed(v) for v in values]
    want = groups([(simhash._signed(a), simhash._signed(b)) for a in values for b in values if (a ^ b).bit_count() <= 3], signed)
    assert {v: got.get(v, v) for v in signed} == want


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(pairs + [(None, 1)], "u long, v long")).collect()}
    assert got == groups([p for p in pairs if p[0] != p[1]], nodes)


def test_decontamination(spark, docs, none):
    words = lambda t: [x for x in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if x]
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    passage = line(1, 60).split()
    items = [(1, " ".join(passage)), (2, " ".join(passage[:20])), (3, " ".join(passage[:36] + ["new"] * 4)), (4, " ".join(passage[:30] + line(50, 10).split())),
             (5, "two words"), (6, "One"), (7, None), (8, ""), (2, " ".join(passage[:20])), (9, line(77, 40)), (10, line(4, 3000)[:500].rsplit(" ", 1)[0].upper())]
    benchmark = spark.createDataFrame([(*x, 1, 1.0, "x") for x in items], "item_id long, text string, h int, n double, sketch string")
    want = set()
    for r in planted():
        have = grams(words(r[1]))
        for i, t in items:
            g = grams(words(t))
            if g and 5 * len(g & have) >= 4 * len(g):
                want.add((r[0], i, len(g), len(g & have)))
    assert want
    for limit in (0, 500_000):
        got = decontaminate.contained(docs, benchmark, broadcast_rows=limit)
        assert {(x["doc_id"], x["item_id"], x["n_shingles"], x["n_found"]) for x in got.collect()} == want
    assert decontaminate.contained(none, benchmark).count() == 0
    assert decontaminate.contained(docs, benchmark.limit(0)).count() == 0
    clean = decontaminate.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns
    bad = {i for i, *_ in want}
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(r[0] for r in planted() if r[0] not in bad)


def test_bpe(docs, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    truth = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r[1] or "" for r in planted()] + ["<|endoftext|>", "à ‍👩‍👩‍👧 ½ Ⅷ ١٢", " \n\n  x", "z" * 3000]
    codec = bpe.Codec(ranks, bpe.PerfectHash(list(ranks)), public_tokenizers.PATTERN)
    for t in texts:
        ids = codec.ids(t)
        assert ids.tolist() == truth.encode_ordinary(t) and codec.decode(ids) == t.encode()
    want = Counter((r[0], len(i := codec.ids(r[1] or "")), hashlib.sha256(i.tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in planted())
    assert rows(bpe.digest(docs, path, public_tokenizers.PATTERN)) == want
    assert bpe.digest(none, path, public_tokenizers.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN, into="back")
    assert all(bytes(r["back"]) == (r["text"] or "").encode() for r in back.collect())


def test_minimal_perfect_hash():
    keys = [bytes([i % 256, i // 256]) for i in range(3000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.slot) == list(range(3000)) and all(keys[table.find(k)] == k for k in keys)


def test_scores(docs, none):
    import math

    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    texts = [(r[0], [*lower_words(r[1]), b"\0E"]) for r in planted()]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for i, t in texts:
        if not held(i):
            before = [b"\0S", *t[:-1]]
            uni.update(t), bi.update(zip(before, t)), ctx.update(before)
    n, v = sum(uni.values()), len(uni)
    want = sorted((-1 if i is None else i, held(i), len(t), sum(uni[w] > 0 for w in t), n, round(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in texts)
    got = ngrams.scores(docs, shard_bytes=1000).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    model = lambda t: sum(math.log10(bi[a, b] / (ctx[a] + 4) if bi[a, b] else 4 / (ctx[a] + 4) * (uni[b] + 1) / (n + v + 1)) for a, b in zip([b"\0S", *t[:-1]], t))
    by = {(r["doc_id"], r["n_tokens"]): r["score"] for r in got}
    assert all(abs(by[i, len(t)] - model(t)) < 0.002 * len(t) for i, t in texts)
    assert ngrams.scores(none).count() == 0


def test_elias_fano():
    import numpy as np

    r = random.Random(3)
    mixed = sorted({r.getrandbits(r.choice([8, 20, 47])) for _ in range(5000)})
    for values in ([], [0], [5, 5, 5], list(range(0, 10**6, 777)), [0, 2**60, 2**63], [2**64 - 1], mixed, [7] * 1000 + [2**40], list(range(300))):
        x = np.array(values, np.uint64)
        n, low, words, raw = ngrams.EliasFano.pack(x)
        level = ngrams.EliasFano(n, low, words, raw)
        assert level.access(np.arange(n)).tolist() == values
        asked = sorted({0, 1, 2**63, *values, *(v + 1 for v in values if v < 2**64 - 1), *(r.getrandbits(48) for _ in range(50))})
        first = {v: i for i, v in reversed(list(enumerate(values)))}
        assert level.search(np.array(asked, np.uint64)).tolist() == [first.get(v, -1) for v in asked]


def test_trie():
    import math

    import numpy as np

    r = random.Random(4)
    pairs = Counter((r.choice([3, 2**47, r.getrandbits(47)]), r.getrandbits(r.choice([3, 47]))) for _ in range(3000))
    rows = sorted(pairs)
    trie = ngrams.Trie(*(np.array([p[i] for p in rows], np.uint64) for i in (0, 1)), np.array([pairs[p] << 40 for p in rows]))
    asked = sorted({*rows, *((a, b + 1) for a, b in rows), *((a + 1, b) for a, b in rows), (0, 0)})
    heads = sorted({a for a, _ in asked})
    spread = Counter(a for a, _ in asked)
    found = trie.find(np.array(heads, np.uint64), np.array([spread[a] for a in heads]), np.array([b for _, b in asked], np.uint64))
    place = {p: i for i, p in enumerate(rows)}
    assert found.tolist() == [place.get(p, -1) for p in asked]
    assert all(abs(x - math.log10((pairs[p] << 40) / 4)) < 0.002 for p, x in zip(rows, trie.log10(np.arange(len(rows))), strict=True))
    empty = ngrams.Trie(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert empty.find(np.array([1], np.uint64), np.array([2]), np.array([1, 2], np.uint64)).tolist() == [-1, -1]


def test_licenses(docs, none):
    scan = licenses.Scanner().scan
    for text in [None, "", "MIT License and mit  LICENSE.", "the Apache\nLicense, Version 2.0", "xmit license", "mit licenses", "GNU General Public License general public license",
                 "é mit license", "mit license" * 3, "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause"]:
        w = regex.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(licenses.LOWER))
        hits = [(i, label) for i in range(len(w)) for p, label in licenses.BASE.items() if w[i:i + len(p.split())] == p.encode().split()]
        at = [i for i, _ in hits]
        got = scan(text)
        assert got[:5] == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))
        assert set(got[4].split(",")) - {""} <= set(got[5].split(",")) and 0 <= got[6] <= 1
    parse = lambda x: licenses.evaluate(licenses.postfix(licenses.TOKEN.findall(x)))
    assert parse("MIT OR GPL-2.0-only")[1] == 1.0 and parse("MIT AND GPL-2.0-only")[1] == 0.3
    assert parse("GPL-2.0 WITH Classpath-exception-2.0 OR MIT")[0] == {"gpl-2.0-with-classpath-exception-2.0", "mit"}
    assert parse("(MIT AND (GPL-3.0 OR ISC))")[1] == 1.0 and parse(") and or")[0] == frozenset() and parse("MIT OR")[0] == {"mit"}
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(none).count() == 0


def test_sharding(spark, docs, none, tmp_path):
    out, flow = shards.plan(docs, shards.old_layout(docs, 3, "doc_id"), 3, 4)
    got = out.collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in planted())
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    total = sum(r["size"] for r in got)
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    supply = [sum(r["size"] for r in got if r["old_shard"] == s) for s in range(3)]
    room = shards.capacities(total, 4)
    assert sum(flow[i][i] for i in range(3)) == sum(min(a, b) for a, b in zip(supply, room))  # the most that can stay
    assert [sum(f) for f in flow] == supply and [sum(f[j] for f in flow) for j in range(4)] == room
    assert shards.digest(none.withColumn("source", none["key"])).count() == 0
    named = shards.rewrite(docs, shards.old_layout(docs, 3, "doc_id"), 3, 4, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert named == shards.affected(flow) and Counter(r["text"] for r in back.collect()) == Counter(
        t for t, s in _texts_by_shard(got) if s in named)


def _texts_by_shard(got):
    text = {(r[0], len((r[1] or "").encode()) + 1): r[1] for r in planted()}
    return [(text[r["doc_id"], r["size"]], r["shard"]) for r in got]


def test_flow_is_cheapest():
    """All ways to place small supplies, compared with the flow's cost."""
    from itertools import product

    r = random.Random(5)
    for _ in range(20):
        supply, cost = [r.randint(0, 4) for _ in range(2)], [[r.randint(0, 5) for _ in range(3)] for _ in range(2)]
        room = [r.randint(0, 5) for _ in range(2)]
        room.append(max(0, sum(supply) - sum(room)))
        flow = shards.min_cost_flow(supply, room, cost)
        got = sum(flow[i][j] * cost[i][j] for i in range(2) for j in range(3))
        ways = []
        for a in product(range(5), repeat=3):
            for b in product(range(5), repeat=3):
                if [sum(a), sum(b)] == supply and all(x + y <= z for x, y, z in zip(a, b, room)):
                    ways.append(sum(x * c for x, c in zip(a, cost[0])) + sum(x * c for x, c in zip(b, cost[1])))
        assert got == min(ways)


def test_toxicity(spark, none):
    r = random.Random(3)
    clean = [(i, line(i, r.randint(5, 200)), 0) for i in range(300)]
    toxic = [(1000 + i, " ".join(w if r.random() > 0.1 else "grobian" for w in line(1000 + i, r.randint(30, 200)).split()) + " you moron", 1) for i in range(200)]
    texts = clean + toxic + [(5000, None, None), (5001, "", 0), (5002, "you are a grobian and a grobian " * 5, None), (5003, line(9, 4000), None), (1000, toxic[0][1], 1)]
    docs = spark.createDataFrame([(i, t, 0.1, "x") for i, t, _ in texts], "doc_id long, text string, score double, w string")
    labels = spark.createDataFrame([(i, x, 1) for i, _, x in texts if x is not None] + [(None, 1, 0), (77777, 1, 0)], "doc_id long, toxic int, text int")
    got = toxicity.predictions(docs, labels).collect()
    assert len(got) == len(texts) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for x in got)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got)
    flagged = {x["doc_id"] for x in got if x["predicted"]}
    assert flagged == {i for i, *_ in toxic} | {5002}
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {i for i, *_ in texts} - flagged
    assert toxicity.predictions(none, labels).count() == 0
    assert {x["score"] for x in toxicity.predictions(docs, labels.limit(0)).collect()} == {0.0}


def test_calibration_steps(spark):
    import numpy as np

    x, y = [0.1, 0.2, 0.2, 0.7], [0.0, 0.3, 0.5, 0.9]
    p = spark.createDataFrame([(float(v),) for v in np.linspace(0, 1, 41)], "p double")
    for r in p.withColumn("s", toxicity._steps(p["p"], x, y)).collect():
        if r["p"] != 0.2:
            assert abs(r["s"] - np.interp(r["p"], x, y)) < 1e-12
