"""Word beginnings of the toxicity operator."""

from assayframe.llm import toxicity


def test_inflected_forms_count_by_their_beginning():
    stems = frozenset(["zork"])
    seen = dict(zip(toxicity.NAMES, toxicity.features("A zorkan, zorkest and zor. ZORKIX!", frozenset(), stems)))
    assert (len(seen), seen["stems"], seen["hits"]) == (len(toxicity.NAMES), 3.0, 0.0)
    for empty in (None, "", "  "):
        assert toxicity.features(empty, frozenset(), stems)[-2:] == [0.0, 0.0]


def test_beginnings_are_learned_from_contexts_not_copies(spark):
    toxic = [(1, f"word{i} zork{chr(97 + i)} common{i % 3}") for i in range(12)] + [(1, "one copied blarg")] * 50
    clean = [(0, f"some common{i % 3} words here {i}") for i in range(200)] + [(0, None), (0, "")]
    rows = spark.createDataFrame(toxic + clean, "toxic int, text string")
    found = toxicity.learn_stems(rows, 62, 202)
    assert "zork" in found and not {"blar", "blarg", "comm", "common"} & set(found)
    assert toxicity.learn_stems(rows.where("toxic = 0"), 0, 202) == []


def test_rare_toxic_words_are_not_lost_behind_common_ones(spark):
    """More neutral words with more contexts than any list of candidates: the rare toxic word is still found."""
    common = [" ".join(f"w{(i + k * j) % 21_000:05d}" for j in range(1000)) for k in (1, 11, 13, 17, 19, 23) for i in range(0, 21_000, 1000)]
    rare = [f"say{i} zork now{i}" for i in range(4)]
    rows = spark.createDataFrame([(1, t) for t in common + rare] + [(0, t) for t in common * 3], "toxic int, text string")
    words, stems = toxicity.learn(rows, len(common) + 4, 3 * len(common))
    assert words == ["zork"] and not {s for s in stems if s.startswith("w")}
