"""Text similarity and entity resolution by inverted indexes: only rows that share an indexed term meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import similarity_ratio, token_containment, token_jaccard
from tessera.session import materialize, release


def term_counts(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf) of an array of terms per row; NULL and empty arrays give no rows."""
    return docs.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def char_ngrams(text: Column, least: int, most: int | None = None) -> Column:
    """The pieces of `least` to `most` letters of each word, padded by one blank on either side; a shorter word is one piece."""
    padded = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def pieces(w: Column, n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))
        return each if n == least else F.when(F.length(w) >= n, each).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(padded, lambda w: F.concat(*[pieces(w, n) for n in range(least, (most or least) + 1)])))


def word_ngrams(text: Column) -> Column:
    """The words of two letters or digits or more of a text, and the pairs of neighbours among them."""
    words = F.regexp_extract_all(text, F.lit(r"\w\w+"), F.lit(0))
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))


def tfidf(counts: DataFrame, key: str, min_records: int = 1, copies: DataFrame | None = None) -> DataFrame:
    """(key, term, w, df): 1 + ln(tf) times ln((1+N)/(1+df)) + 1, normalised to length 1 per record. `copies` (key, copies)
    says how many records each key stands for; without it, one."""
    if copies is None:
        n, held = counts.select(key).distinct().count(), F.count("*")
    else:
        n, counts, held = copies.agg(F.sum("copies")).first()[0] or 0, counts.join(copies, key), F.sum("copies")
    df = counts.groupBy("term").agg(held.alias("df")).where(F.col("df") >= min_records)
    raw = counts.join(df, "term").withColumn("x", (1 + F.log("tf")) * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1))
    return raw.select(key, "term", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))).alias("w"), "df")


def similar_pairs(vectors: DataFrame, key: str, least: float, traits: DataFrame | None = None, only: str = "true", hot: int = 1_000, depth: int = 2) -> DataFrame:
    """(a, b, similarity) of all a < b whose unit vectors have a cosine of `least` or more and for which `only` holds, a
    condition on the columns of `traits` (key, ...), which end in `_a` and `_b`.

    Terms stand in one order, rarest first. A vector is filed under each two of its terms t, u for which the length of t, u
    and all terms after u is `least` or more, and under each term that has this weight alone. The first two terms that a
    pair at `least` shares, or the only one, file both its vectors, so no pair is lost, however common its terms are. With a
    `depth` of 1 a vector is filed under each single term t for which the length of t and all after it is `least` or more,
    which is the better choice for vectors of many terms; the first term that a pair shares files both. The
    same lengths bound the cosine of those that meet; it is summed over all terms for those who pass. A place of more than
    `hot` vectors is divided into blocks that meet pairwise.
    """
    order = Window.partitionBy(key).orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    own = materialize(vectors.select(key, "term", "w", "df").withColumn("rest", F.sum(F.col("w") * F.col("w")).over(order)), "vectors")
    floor = least * least - 1e-9
    first = own.where(F.col("rest") >= floor).select(key, F.col("term").alias("t"), F.col("w").alias("wt"), F.col("df").alias("dt"))
    after = own.select(key, F.col("term").alias("u"), F.col("w").alias("wu"), F.col("df").alias("du"), F.greatest(F.col("rest") - F.col("w") * F.col("w"), F.lit(0.0)).alias("r"), "rest")
    two = first.join(after, key).where(((F.col("dt") < F.col("du")) | ((F.col("dt") == F.col("du")) & (F.col("t") < F.col("u")))) & (F.col("wt") * F.col("wt") + F.col("rest") >= floor))
    whole = own.where(F.col("rest") >= floor).select(key, F.xxhash64("term").alias("place"), F.col("w").alias("wt"), F.lit(0.0).alias("wu"), F.greatest(F.col("rest") - F.col("w") * F.col("w"), F.lit(0.0)).alias("r"))
    one = first.where(F.col("wt") >= least - 1e-9).select(key, F.xxhash64("t").alias("place"), "wt", F.lit(0.0).alias("wu"), F.lit(0.0).alias("r"))
    filed = two.select(key, F.xxhash64("t", "u").alias("place"), "wt", "wu", "r").unionByName(one) if depth == 2 else whole
    filed = materialize(filed, "filed")
    sizes = filed.groupBy("place").agg(F.count("*").alias("m")).where("m > 1").select("place", F.ceil(F.col("m") / hot).cast("int").alias("nb"))
    placed = filed.join(sizes, "place").withColumn("mine", F.pmod(F.xxhash64(key), "nb").cast("int"))
    if traits is not None:
        placed = placed.join(traits, key)
    placed = placed.withColumn("their", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cells = placed.withColumn("i", F.least("mine", "their")).withColumn("j", F.greatest("mine", "their")).drop("nb", "their")
    at = ["place", "i", "j"]
    left, right = (cells.select(*at, *[F.col(c).alias(f"{c}_{x}") for c in cells.columns if c not in at]) for x in "ab")
    reach = F.col("wt_a") * F.col("wt_b") + F.col("wu_a") * F.col("wu_b") + F.sqrt(F.col("r_a") * F.col("r_b"))
    met = left.join(right, at).where(F.col(f"{key}_a") < F.col(f"{key}_b")).where("i = j OR mine_a <> mine_b").where(only).where(reach >= least - 1e-9)
    met = materialize(met.select(F.col(f"{key}_a").alias("a"), F.col(f"{key}_b").alias("b")).distinct(), "met")
    release(filed)
    both = met.join(own.select(F.col(key).alias("a"), "term", F.col("w").alias("wa")), "a")
    both = both.join(own.select(F.col(key).alias("b"), "term", F.col("w").alias("wb")), ["b", "term"])
    return both.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity")).where(F.col("similarity") >= least)


FEW = 16  # groups of a class that are looked at one by one


def counted_matches(members: DataFrame, links: DataFrame, cls: str, differ: str, day: str, width: int, same: list[str] = []) -> DataFrame:
    """(a, b, same, differ, day, q, n): for each group of q members of class a that are equal in `same`, `differ` and `day`, how
    many members n of class b are equal in `same`, not equal in `differ` and at most `width` days away.

    `links` (a, b) are pairs of classes; every class is linked with itself, too, and pairs count in both directions. Members
    with a NULL in any of the columns match nothing. A group is compared with the groups of a class of FEW or less; for a
    larger class n is a difference of running totals over all members in order of class and day, so that no pair of groups is
    formed, and a class with a third of all members is spread over several tasks. Both ways give the same.
    """
    from tessera.operators.series import running

    known = members.where(" AND ".join(f"{c} IS NOT NULL" for c in (cls, differ, day, *same)))
    g = materialize(known.groupBy(cls, *same, differ, day).agg(F.count("*").alias("q")), "groups")
    sizes = materialize(g.groupBy(cls).agg(F.count("*").alias("groups")), "sizes")
    itself = sizes.where("groups > 1").select(F.col(cls).alias("a"), F.col(cls).alias("b"))  # a lone group differs from none
    both = links.select("a", "b").union(links.select("b", "a")).union(itself).distinct().join(sizes.select(F.col(cls).alias("b"), "groups"), "b")
    asked = materialize(g.withColumnRenamed(cls, "a").join(both, "a"), "asked")
    out = ["a", "b", *same, differ, day, "q"]

    there = g.select(F.col(cls).alias("b"), *same, F.col(differ).alias("__differ"), F.col(day).alias("__day"), F.col("q").alias("__n"))
    near = asked.where(F.col("groups") <= FEW).join(there, ["b", *same]).where((F.col(differ) != F.col("__differ")) & (F.abs(F.col(day) - F.col("__day")) <= width))
    found = near.groupBy(*out).agg(F.sum("__n").alias("n"))

    many = asked.where(F.col("groups") > FEW)
    if many.isEmpty():
        return found
    ends = F.explode(F.array(F.struct((F.col(day) + width).alias("at"), F.lit(1).alias("sign")), F.struct((F.col(day) - width - 1).alias("at"), F.lit(-1).alias("sign"))))
    ends = many.withColumn("end", ends).select(*out, "end.at", "end.sign", F.lit(0).alias("held"), F.lit(1).alias("kind"))
    own = g.join(sizes.where(F.col("groups") > FEW).select(cls), cls)
    own = own.select(F.lit(None).cast(dict(g.dtypes)[cls]).alias("a"), F.col(cls).alias("b"), *same, differ, day, F.lit(0).cast("bigint").alias("q"), F.col(day).alias("at"), F.lit(0).alias("sign"), F.col("q").cast("int").alias("held"), F.lit(0).alias("kind"))
    every = materialize(ends.unionByName(own), "ends")
    parts = [
        running(every, ["b", *same, *extra, "at", "kind"], {"upto": "held"}).where("kind = 1").withColumn("n", F.col("upto") * F.col("sign") * weight)
        for extra, weight in (([], 1), ([differ], -1))
    ]
    counted = parts[0].unionByName(parts[1]).groupBy(*out).agg(F.sum("n").alias("n")).where("n > 0")
    return found.unionByName(counted)


def name_matches(names: DataFrame, key: str, count: str, generic: list[str], rare: int = 3) -> DataFrame:
    """(key_a, key_b, rule, jaccard, containment, ratio) of different name keys that mean the same entity.

    Rules, first that holds: one key's words contain the other's and they share a word that is neither generic nor held by
    more than `rare` keys (joint names excepted); or word overlap of 0.6 with letter similarity of 0.8; or letter similarity
    of 0.92 and a shared word. Keys meet on such a rare word, on the rarest words that keys of that overlap must share, or
    on the rarest three-letter pieces that keys of that similarity must share, so no rule loses a pair.
    """
    base = names.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.array_distinct(F.split(key, " ")).alias("t"), F.col("joint").alias("j")).dropDuplicates(["k"])
    letters = F.expr("aggregate(split(k, ''), 0, (s, c) -> s | shiftleft(1, pmod(ascii(c), 32)))")  # which letters a key has
    base = materialize(base.withColumn("id", F.xxhash64("k")).withColumn("l", F.length("k").cast("int")).withColumn("m", letters), "keys")
    # keys meet as numbers; the names themselves join the pairs that are left
    words = base.select("id", "l", "m", F.size("t").alias("n"), F.explode("t").alias("w"))
    listed = words.join(words.groupBy("w").agg(F.count("*").alias("df")), "w")
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "w"))
    overlap = listed.withColumn("i", place).where("i <= n - ceil(0.6 * n - 1e-9) + 1")
    # of l letters and at most 0.54 / 0.46 of them on the other side, d = 0.08 * l / 0.46 are unmatched; each spoils three pieces
    pieces = base.where("l >= 6").select("id", "l", "m", F.explode(F.transform(F.sequence(F.lit(1), F.col("l") - 2), lambda i: F.substr(F.col("k"), i, F.lit(3)))).alias("g"))
    pieces = pieces.groupBy("id", "l", "m", "g").agg(F.count("*").cast("int").alias("n")).select("id", "l", "m", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.col("g"), i.cast("string")))).alias("w"))
    near = pieces.join(pieces.groupBy("w").agg(F.count("*").alias("df")), "w").withColumn("i", place).where("i <= 3 * floor(0.08 * l / 0.46 + 1e-9) + 1")

    def meet(x: DataFrame, informative: Column, only: str = "true") -> DataFrame:
        held = x.where("df >= 2").withColumn("h", F.xxhash64("w"))
        left, right = held.select("h", F.col("id").alias("a"), F.col("l").alias("la"), F.col("m").alias("ma"), informative.alias("informative")), held.select("h", F.col("id").alias("b"), F.col("l").alias("lb"), F.col("m").alias("mb"))
        return left.join(right, "h").where("a < b").where(only).select("a", "b", "informative")

    # each letter that only one key has is unmatched
    close = "least(la, lb) >= 0.46 * (la + lb) - 1e-9 AND bit_count(ma ^ mb) <= 0.08 * (la + lb) + 1e-9"
    found = meet(listed.where(F.col("df") <= rare), ~F.col("w").isin(generic)).union(meet(overlap, F.lit(False))).union(meet(near, F.lit(False), close))
    pairs = found.groupBy("a", "b").agg(F.max("informative").alias("informative"))
    side = lambda x: base.select(F.col("id").alias(x), F.col("k").alias(f"k{x}"), F.col("t").alias(f"t{x}"), F.col("j").alias(f"j{x}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    # the smaller key first
    turned = F.col("ka") > F.col("kb")
    full = full.select("informative", "ta", "tb", "ja", "jb", F.when(turned, F.col("kb")).otherwise(F.col("ka")).alias("ka"), F.when(turned, F.col("ka")).otherwise(F.col("kb")).alias("kb"))
    full = full.withColumn("jaccard", token_jaccard(F.col("ta"), F.col("tb"))).withColumn("containment", token_containment(F.col("ta"), F.col("tb")))
    contained = (F.col("containment") == 1) & F.col("informative") & (F.least(F.length("ka"), F.length("kb")) >= 4) & ~F.col("ja") & ~F.col("jb")
    # letters that match are in the same order, so no more edits than unmatched letters
    alike = (F.col("jaccard") > 0) & (F.levenshtein("ka", "kb") <= 0.08 * (F.length("ka") + F.length("kb")) + 1e-9)
    full = full.where(contained | (F.col("jaccard") >= 0.6) | alike).withColumn("ratio", similarity_ratio(F.col("ka"), F.col("kb")))
    rule = F.when(contained, "containment").when((F.col("jaccard") >= 0.6) & (F.col("ratio") >= 0.8), "jaccard+ratio").when((F.col("ratio") >= 0.92) & (F.col("jaccard") > 0), "ratio")
    return full.select(F.col("ka").alias("key_a"), F.col("kb").alias("key_b"), rule.alias("rule"), "jaccard", "containment", "ratio").where("rule IS NOT NULL")


def standardised(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, columns): missing values as the median, then centred and divided by the population deviation (0 if that is 0)."""
    medians = df.agg(*[F.median(c).alias(f"m_{c}") for c in columns])
    full = df.join(F.broadcast(medians)).select(key, *[F.coalesce(c, f"m_{c}").alias(c) for c in columns])  # one row
    stats = full.agg(*[F.avg(c).alias(f"a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    return full.join(F.broadcast(stats)).select(key, *[F.coalesce(F.try_divide(F.col(c) - F.col(f"a_{c}"), F.col(f"s_{c}")), F.lit(0.0)).alias(c) for c in columns])  # one row


def agreement(assigned: DataFrame, a: str, b: str) -> DataFrame:
    """One row (agreement): the share of rows in the largest cell of each row of the crosstab of two labelings."""
    cells = assigned.groupBy(a, b).agg(F.count("*").alias("n"))
    return cells.groupBy(a).agg(F.max("n").alias("m"), F.sum("n").alias("n")).agg((F.sum("m") / F.sum("n")).alias("agreement"))


def npmi(docs: DataFrame, key: str, terms: str, top: DataFrame) -> DataFrame:
    """(topic, npmi): mean normalised pointwise mutual information of the pairs of each topic's top terms.

    `docs`: key and an array of terms; `top`: (topic, term), a short list. Counts have one added.
    """
    n = docs.count()
    held = docs.select(key, F.explode(F.array_distinct(terms)).alias("term")).join(top.select("term").distinct(), "term")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    co = held.select(key, F.col("term").alias("x")).join(held.select(key, F.col("term").alias("y")), key).where("x < y").groupBy("x", "y").agg(F.count("*").alias("co"))
    pairs = top.select("topic", F.col("term").alias("x")).join(top.select("topic", F.col("term").alias("y")), "topic").where("x < y")
    full = pairs.join(co, ["x", "y"], "left").join(df.select(F.col("term").alias("x"), F.col("df").alias("dx")), "x", "left").join(df.select(F.col("term").alias("y"), F.col("df").alias("dy")), "y", "left")
    p = lambda c: (F.coalesce(F.col(c), F.lit(0)) + 1) / float(n + 1)
    return full.groupBy("topic").agg(F.avg(F.log(p("co") / (p("dx") * p("dy"))) / -F.log(p("co"))).alias("npmi"))
