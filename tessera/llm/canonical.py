"""Mapping of freely typed values to the entries of a reference list, in SQL functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

_MARKS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžığř", "aaaaaaceeeeiiiinooooouuuuyyszigr")


def words(value: Column) -> Column:
    """Lower-case words without accents, apostrophes closed up and other signs as blanks."""
    plain = F.translate(F.lower(value), *_MARKS)
    closed = F.regexp_replace(F.regexp_replace(plain, "̇", ""), "['’]", "")
    return F.trim(F.regexp_replace(closed, "[^a-z]+", " "))


def _compact(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def _stripped(text: Column, wrapping: Sequence[str], lead: str) -> Column:
    """The words without a leading phrase, without the wrapping ones and without single letters, closed up."""
    made = F.regexp_replace(text, rf"^(?:{lead})( |$)", "") if lead else text
    return _compact(F.regexp_replace(made, r"\b(" + "|".join([*wrapping, "[a-z]"]) + r")\b", ""))


def reference_forms(reference: DataFrame, key: str, name: str, aliases: DataFrame | None = None, wrapping: Sequence[str] = (), lead: str = "") -> DataFrame:
    """(form, key, stage, fuzzy): the closed-up forms of each entry, by which values are looked up.

    `stage` is `exact` for the entries' own names and `alias` for `aliases` (key, alias), in which the key -1 stands for names
    that resemble an entry and are none (`not_listed`). A form that several entries share belongs to the smallest key, own names first. Only
    names of four letters or more and aliases of seven or more are also matched by similarity. The result has a few forms per
    entry, so its size follows the reference list and not the data.
    """
    own = reference.where(F.col(key).isNotNull()).select(F.col(key).cast("int").alias("key"), words(F.col(name)).alias("w"))
    forms = own.select("key", _compact(F.col("w")).alias("form"), F.lit(0).alias("order"), F.lit(True).alias("fuzzy"))
    forms = forms.unionByName(own.select("key", _stripped(F.col("w"), wrapping, lead).alias("form"), F.lit(0).alias("order"), F.lit(False).alias("fuzzy")))
    if aliases is not None:
        other = aliases.select(F.col(key).cast("int").alias("key"), _compact(words(F.col("alias"))).alias("form"), F.lit(1).alias("order"))
        forms = forms.unionByName(other.withColumn("fuzzy", (F.length("form") >= 7) & (F.col("key") >= 0)))
    best = forms.where("form <> ''").groupBy("form").agg(F.min(F.struct("order", "key")).alias("b"), F.max("fuzzy").alias("fuzzy"))
    stage = F.when(F.col("b.key") < 0, "not_listed").when(F.col("b.order") == 0, "exact").otherwise("alias")
    return best.select("form", F.col("b.key").alias("key"), stage.alias("stage"), (F.col("fuzzy") & (F.length("form") >= 4) & (F.col("b.key") >= 0)).alias("fuzzy"))


SEGMENTS = {False: 3, True: 5}  # k + 1 segments for k = 2 edits, and for k = 4 in forms of seven letters or more


def similar_forms(typed: DataFrame, forms: DataFrame) -> DataFrame:
    """(form, key) of the one closest reference form of each typed form within two slips of the keyboard.

    A slip is an added, lost, changed or swapped letter; a swap counts two edits. Up to four letters allow one edit that keeps
    the first letter; five and six allow two (in five letters only as a swap); longer forms also three or four edits where the
    letters themselves differ by one slip or not at all. Pigeonhole: a reference form cut into k+1 segments keeps one of them
    unchanged under k edits, shifted by two places at most, so candidates are equalities of segments with the typed form's
    substrings at these places, each verified with levenshtein. A form to which entries of different keys are equally close
    is ambiguous and has no row.
    """
    count = lambda n: F.when(n >= 7, SEGMENTS[True]).otherwise(SEGMENTS[False])
    cut = lambda n, i: F.floor(n * i / count(n)).cast("int")
    n, i = F.col("n"), F.col("i")
    ref = forms.where("fuzzy").select(F.col("form").alias("ref"), "key", F.length("form").alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0), count(n) - 1)))
    segments = ref.select("ref", "key", "n", "i", F.substr("ref", cut(n, i) + 1, cut(n, i + 1) - cut(n, i)).alias("seg"))
    probe = (
        typed.where(F.length("form") >= 3)
        .select("form", F.explode(F.sequence(F.greatest(F.length("form") - 2, F.lit(4)), F.length("form") + 2)).alias("n"))
        .select("form", "n", F.explode(F.sequence(F.lit(0), count(n) - 1)).alias("i"))
        .select("form", "n", "i", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("shift"))
        .select("form", "n", "i", (cut(n, i) + F.col("shift")).alias("at"), (cut(n, i + 1) - cut(n, i)).alias("len"))
        .where((F.col("at") >= 0) & (F.col("at") + F.col("len") <= F.length("form")))
        .select("form", "n", "i", F.substr("form", F.col("at") + 1, F.col("len")).alias("seg"))
        .distinct()
    )
    pairs = probe.join(segments, ["n", "i", "seg"]).select("form", "ref", "key").distinct()
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    d, bag, least = F.col("d"), F.col("bag"), F.least(F.length("form"), F.length("ref"))
    close = pairs.withColumn("d", F.levenshtein("form", "ref")).where("d <= 4").withColumn("bag", F.levenshtein(letters("form"), letters("ref")))
    ok = (
        ((d <= 1) & ((F.length("ref") >= 5) | (F.substr("form", F.lit(1), F.lit(1)) == F.substr("ref", F.lit(1), F.lit(1)))))
        | ((d == 2) & (F.length("ref") >= 5) & ((least >= 6) | (bag == 0)))
        | ((F.length("ref") >= 7) & (((d == 3) & (bag <= 2)) | ((d == 4) & (bag == 0))))
    )
    near = close.where(ok).groupBy("form", "key").agg(F.min(F.struct("d", (bag > 0).alias("other"))).alias("far"))
    best = near.groupBy("form").agg(F.min(F.struct("far", "key")).alias("b"), F.collect_list("far").alias("every"))  # a few keys a form
    return best.where(F.size(F.filter("every", lambda x: x == F.col("b.far"))) == 1).select("form", F.col("b.key").alias("key"))


def map_to_reference(values: DataFrame, reference: DataFrame, key: str, name: str, aliases: DataFrame | None = None, wrapping: Sequence[str] = (), lead: str = "") -> DataFrame:
    """`values` (with a column `value`) plus `key`, the entry each value stands for or -1, and `stage`, how it was found.

    A value is read as a whole, then without its bracketed notes, then without the phrase `lead` (a pattern) and the words of
    `wrapping`, then part by part at commas (places beside a country); each reading is looked up exactly among names (stage
    `exact`) and `aliases` (`alias`, or `not_listed` for those of no entry), and what stays unmatched is matched by similarity (`fuzzy`); the rest is `unmatched`.
    Every distinct typed value is resolved once. NULL and signless values are unmatched; other columns are kept, but for one
    named `stage`; an empty table stays empty. A value whose parts name several entries stands for each of them.
    """
    forms = reference_forms(reference, key, name, aliases, wrapping, lead)
    v = F.col("value")
    unnoted = F.regexp_replace(v, r"\([^)]*\)?", " ")
    reading = lambda x: F.array(_compact(words(x)), _stripped(words(x), wrapping, lead))
    whole = F.concat(F.array(_compact(words(v))), reading(unnoted))
    parts = F.flatten(F.transform(F.split(unnoted, ","), reading))
    distinct = values.select("value").distinct().withColumn("__whole", F.array_distinct(whole)).withColumn("__parts", F.array_distinct(parts))
    ranked = F.concat(
        F.transform("__whole", lambda f, i: F.struct(f.alias("form"), i.cast("int").alias("rank"))),
        F.transform("__parts", lambda f: F.struct(f.alias("form"), F.lit(9).alias("rank"))),
    )
    tries = materialize(distinct.select("value", F.inline(ranked)).where("form <> ''"), "tries")
    exact = tries.join(forms.select("form", "key", "stage"), "form").select("value", "rank", "key", "stage")
    left = tries.join(exact.select("value").distinct(), "value", "left_anti")
    fuzzy = left.join(similar_forms(left.select("form").distinct(), forms), "form").select("value", "rank", "key", F.lit("fuzzy").alias("stage"))
    found = exact.unionByName(fuzzy).withColumn("__r", F.min("rank").over(Window.partitionBy("value"))).where("rank = __r")
    found = materialize(found.groupBy("value", "key").agg(F.min("stage").alias("stage")), "found").withColumnRenamed("key", key)
    rows = values.drop("stage", key) if "stage" in values.columns or key in values.columns else values
    matched = rows.join(found, "value")
    unmatched = rows.join(found.select("value").distinct(), "value", "left_anti")
    return matched.unionByName(unmatched.withColumns({key: F.lit(-1), "stage": F.lit("unmatched")}))
