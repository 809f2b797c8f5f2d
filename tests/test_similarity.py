"""Similar pairs and name matches against brute force, with terms that many records hold."""

import itertools
import math
import random

from pyspark.sql import functions as F

from tessera.operators import similarity as S


def cosines(docs: dict[int, list[str]]) -> dict[tuple[int, int], float]:
    df = {}
    for ts in docs.values():
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    vectors = {}
    for k, ts in docs.items():
        x = {t: (1 + math.log(ts.count(t))) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in set(ts)}
        n = math.sqrt(sum(v * v for v in x.values()))
        vectors[k] = {t: v / n for t, v in x.items()}
    return {(a, b): sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items()) for a, b in itertools.combinations(sorted(docs), 2)}


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(60)]
    docs = {i: rng.choices(common, k=rng.randint(1, 3)) + rng.choices(rare, k=rng.choice((0, 0, 1, 2))) for i in range(240)}
    want = {p for p, s in cosines(docs).items() if s >= 0.6}
    counts = S.term_counts(spark.createDataFrame(list(docs.items()), "id int, terms array<string>"), "id", F.col("terms"))
    for hot, depth in ((1_000, 2), (7, 2), (1_000, 1), (7, 1)):
        got = [(r["a"], r["b"]) for r in S.similar_pairs(S.tfidf(counts, "id"), "id", 0.6, hot=hot, depth=depth).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    # every record holds the one term, more of them than any earlier bound
    alike = spark.createDataFrame([(i, ["robe"]) for i in range(100)], "id int, terms array<string>")
    assert S.similar_pairs(S.tfidf(S.term_counts(alike, "id", F.col("terms")), "id"), "id", 0.6).count() == 100 * 99 // 2


def test_name_matches_equal_brute_force(spark):
    from difflib import SequenceMatcher

    rng = random.Random(3)
    stem = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    keys = {f"{a} {b} home goods gmbh" for a, b in zip(stem, stem[1:])} | {f"{a}{b} home goods gmbh" for a, b in zip(stem, stem[1:])} | {f"{a} home goods" for a in stem}
    rows = [(k, 1, False) for k in sorted(keys)]
    df = {w: sum(w in k.split() for k in keys) for k in keys for w in k.split()}
    want = set()
    for a, b in itertools.combinations(sorted(keys), 2):
        x, y = set(a.split()), set(b.split())
        jac, ratio = len(x & y) / len(x | y), SequenceMatcher(None, a, b, autojunk=False).ratio()
        told = len(x & y) == min(len(x), len(y)) and any(df[w] <= 3 and w not in ("home", "goods") for w in x & y)
        if x & y and (told or (jac >= 0.6 and ratio >= 0.8) or ratio >= 0.92):
            want.add((a, b))
    got = S.name_matches(spark.createDataFrame(rows, "key string, n int, joint boolean"), "key", "n", ["home", "goods"])
    assert {(r["key_a"], r["key_b"]) for r in got.collect()} == want


def test_counted_matches_equal_brute_force(spark):
    rng = random.Random(2)
    # one class holds a third of the members
    rows = [(i, rng.choice((0, 0, rng.randrange(6))), rng.choice("abc"), rng.randrange(40), rng.choice(("x", "y", None))) for i in range(150)] + [(900, 1, None, 5, "x"), (901, None, "a", 5, "x")]
    members = spark.createDataFrame(rows, "id int, cls int, firm string, day int, country string")
    pairs = [(0, 1), (2, 3), (3, 0)]
    links = spark.createDataFrame(pairs, "a int, b int")
    linked = {*pairs, *[(b, a) for a, b in pairs], *[(c, c) for c in range(6)]}
    for same, few in (([], 16), (["country"], 16), ([], 3), (["country"], 0)):
        S.FEW, want = few, {}
        for x, y in itertools.permutations(rows, 2):
            if None not in (x[1], x[2], y[1], y[2]) and (x[1], y[1]) in linked and x[2] != y[2] and abs(x[3] - y[3]) <= 4 and (not same or x[4] is not None and x[4] == y[4]):
                k = (x[1], y[1], *([x[4]] if same else []), x[2], x[3])
                want[k] = want.get(k, 0) + 1
        got = {(r["a"], r["b"], *(r[c] for c in same), r["firm"], r["day"]): r["q"] * r["n"] for r in S.counted_matches(members, links, "cls", "firm", "day", 4, same).collect()}
        assert got == want
    S.FEW = 16
    assert S.counted_matches(members.limit(0), links, "cls", "firm", "day", 4).count() == 0


def test_char_ngrams(spark):
    df = spark.createDataFrame([("Ab  c", 1)], "t string, i int")
    assert df.select(S.char_ngrams(F.col("t"), 3, 5).alias("g")).first()["g"] == [" ab", "ab ", " ab ", " c "]
    assert df.select(S.word_ngrams(F.lit("red, robe of a x1")).alias("g")).first()["g"] == ["red", "robe", "of", "x1", "red robe", "robe of", "of x1"]
