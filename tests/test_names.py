"""The name index against brute force; names scoped by show; suggestions as close matches."""

import random
from difflib import SequenceMatcher, get_close_matches

import pytest
from pyspark.sql import functions as F

from turnlake.operators import name_index as I
from turnlake.operators import names as N

CAST = "ord bigint, canonical string, role string, aliases array<string>, misspellings array<string>, show string"


def spelled(rnd, letters, low, high):
    return "".join(rnd.choice(letters) for _ in range(rnd.randint(low, high)))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("method", ["ratio", "levenshtein"])
@pytest.mark.parametrize("letters, low, high, cutoff", [("abcdefghijklmnop", 1, 14, 0.8), ("aé😀z", 1, 7, 0.6), ("abcdefgh", 50, 90, 0.7), ("ab", 1, 5, 0.0)])
def test_closest_equals_brute_force(spark, method, letters, low, high, cutoff):
    rnd = random.Random(high)
    cands = list(dict.fromkeys(spelled(rnd, letters, low, high) for _ in range(40)))
    asked = list(dict.fromkeys([spelled(rnd, letters, low, high) for _ in range(25)] + [c[1:] + c[:1] for c in cands[:15] if len(c) > 1] + ["%%"]))
    score = {"ratio": lambda a, b: SequenceMatcher(None, a, b).ratio(), "levenshtein": lambda a, b: 1 - edits(a, b) / max(len(a), len(b))}[method]
    rows = [(c, c.upper() + str(i), i) for i, c in enumerate(cands)] + [(cands[0], "later", 99)]
    c = spark.createDataFrame(rows, "norm string, canonical string, ord bigint")
    got = {r["norm"]: r for r in N.fuzzy_name(spark.createDataFrame([(w,) for w in asked], "norm string"), c, cutoff, method).collect()}
    assert len(got) == len(asked)
    for w in asked:
        best, name = 0.0, None
        for n, canonical, _ in rows:
            if (s := score(w, n)) > best:
                best, name = s, canonical
        assert abs(got[w].conf - best) < 1e-12
        hit = name is not None and best >= cutoff
        assert got[w].canonical == (name if hit else None) and got[w].method == ("fuzzy" if hit else "no_match")


def test_few_pairs_are_compared(spark):
    rnd = random.Random(5)
    cands = [spelled(rnd, "abcdefghijklmnopqrstuvwxyz", 8, 18) for _ in range(500)]
    asked = [c[:3] + c[4:] for c in cands[:200]]
    held = spark.createDataFrame([(c, c, i) for i, c in enumerate(cands)], "norm string, canonical string, ord bigint")
    left, right = I.indexed(spark.createDataFrame([(a,) for a in asked], "norm string"), held)
    met = I.pairs(left, right, "ratio", 0.8)
    assert met.count() < 0.05 * len(asked) * len(cands)
    assert met.count() == met.distinct().count()


def test_suggestions_rank_like_close_matches(spark):
    rnd = random.Random(7)
    cands = list(dict.fromkeys(spelled(rnd, "abcde", 3, 8) for _ in range(60)))
    asked = list(dict.fromkeys(spelled(rnd, "abcde", 3, 8) for _ in range(30)))
    c = spark.createDataFrame([(w, w, i) for i, w in enumerate(cands)], "norm string, canonical string, ord bigint")
    got = N.suggest(spark.createDataFrame([(w,) for w in asked], "norm string"), c).collect()
    for w in asked:
        own = [r["canonical"] for r in sorted((r for r in got if r["norm"] == w), key=lambda r: r["rank"])]
        assert own == get_close_matches(w, cands, n=3, cutoff=0.65)


def two_shows(spark):
    rows = [(0, "Michael Scott", "host", ["Mike"], ["Micheal Skott"], "A"), (1, "Mike Wazowski", "lead", ["Mike"], [], "B"),
            (2, "Michelle Stott", "host", [], ["Micheal Skott"], "B"), (0, "Nobody", "x", [], [], None)]
    return spark.createDataFrame(rows, CAST)


def test_names_stay_in_their_show(spark):
    cast = two_shows(spark)
    heard = [("A", "Mike"), ("B", "Mike"), ("A", "Micheal Skott"), ("B", "Micheal Skott"), ("A", "Micheal Scot"), ("B", "Michelle Stot"), ("A", "Mike Wazowski"),
             (None, "Nobody"), (None, "Mike"), ("C", "Mike")]
    got = N.correct_names(spark.createDataFrame(heard, "show string, name string"), cast, by=("show",)).collect()
    found = {(r["show"], r["name"]): (r["canonical"], r["method"]) for r in got}
    assert found == {
        ("A", "Mike"): ("Michael Scott", "alias"), ("B", "Mike"): ("Mike Wazowski", "alias"), ("A", "Micheal Skott"): ("Michael Scott", "misspelling"),
        ("B", "Micheal Skott"): ("Michelle Stott", "misspelling"), ("A", "Micheal Scot"): ("Michael Scott", "fuzzy"), ("B", "Michelle Stot"): ("Michelle Stott", "fuzzy"),
        ("A", "Mike Wazowski"): (None, "no_match"), (None, "Nobody"): ("Nobody", "canonical"), (None, "Mike"): (None, "no_match"), ("C", "Mike"): (None, "no_match"),
    }
    segments = spark.createDataFrame([(s, k, n) for k, (s, n) in enumerate(heard)], "show string, seg_id int, speaker string")
    fixed = {r["seg_id"]: r["speaker"] for r in N.correct_speakers(segments, cast, by=("show",)).collect()}
    assert fixed[0] == "Michael Scott" and fixed[1] == "Mike Wazowski" and fixed[9] == "Mike" and len(fixed) == len(heard)
    lines = spark.createDataFrame([(s, 1, k, f"[00:01] {n}: hi") for k, (s, n) in enumerate(heard)], "show string, doc_id int, line_no int, line string")
    out = {r["line_no"]: r["line"] for r in N.correct_text_labels(lines, cast, by=("show",)).collect()}
    assert out[0] == "[00:01] Michael Scott: hi" and out[1] == "[00:01] Mike Wazowski: hi" and out[9] == "[00:01] Mike: hi"


def test_no_candidates_and_no_names(spark):
    cast = two_shows(spark)
    empty = N.correct_names(spark.createDataFrame([], "name string"), cast)
    assert empty.count() == 0
    got = N.correct_names(spark.createDataFrame([("x",), (None,), ("",)], "name string"), cast.where("false")).collect()
    assert {r["method"] for r in got} == {"no_match", "empty"} and all(r["conf"] == 0 for r in got)
    assert N.suggest(spark.createDataFrame([("x",)], "norm string"), N.cast_candidates(cast.where("false"))).count() == 0
    assert N.canonical_metadata(cast, cast.where("false").withColumn("speaker_key", F.lit("k")), by=("show",)).count() == 4
