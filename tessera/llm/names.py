"""Linking the spellings of names typed by people, by a trie join over Levenshtein automata."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property
from itertools import combinations
from types import MappingProxyType

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import components
from tessera.session import materialize


@dataclass(frozen=True)
class Lexicon:
    """What is known of the names of a collection; all of it may be empty.

    `trades` maps words for a line of business, `given` given names, to their short and other forms, separated by blanks; names
    that differ in these are not one. `noise` are words that identify nothing, such as legal forms.
    """

    trades: Mapping[str, str] = field(default_factory=dict)
    given: Mapping[str, str] = field(default_factory=dict)
    noise: frozenset[str] = frozenset()

    @cached_property
    def tables(self) -> tuple[dict[str, str], dict[str, set[str]]]:
        trade_of = {v: k for k, vs in self.trades.items() for v in (k, *vs.split())}
        given_of: dict[str, set[str]] = {}
        for k, vs in self.given.items():
            for v in (k, *vs.split()):
                given_of.setdefault(v, set()).add(k)
        return trade_of, given_of


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


@dataclass(frozen=True)
class Core:
    """What identifies a name: its own words (a trailing dot marks a cut-off one), its trade and the bearer's given name."""

    words: tuple[str, ...]
    trade: str | None = None
    given: tuple[str, ...] = ()


def core_of(name: str, lexicon: Lexicon = Lexicon()) -> Core:
    """The core of a name. A place after `of` is no own word where two others stand before it. A name that holds nothing but
    legal forms, trades and the like keeps all its words; one without letters and digits keeps its signs."""
    trade_of, given_of = lexicon.tables
    text = fold(name)
    if m := re.match(r"^\W*([a-z]{2,6})\s*\(([^)]*\w\s+\w[^)]*)\)\W*$", text):  # an acronym explained in brackets
        text = m.group(2)
    text = re.sub(r"\([^)]*\)?", " ", text)
    text = re.split(r"(?<!\w)(?:d/b/a|dba|t/a|a/k/a)(?!\w)", text)[0]
    text = re.sub(r"\b(?:\w\.){2,}(?=\W|$)", lambda m: m.group().replace(".", "") + " ", text)  # g.m.b.h. is one word
    cut = re.search(r"\s+of\s+\w+\W*$", text)
    if cut and len(_parsed(name, text[: cut.start()], trade_of, given_of, lexicon.noise).words) >= 2:
        text = text[: cut.start()]
    core = _parsed(name, text, trade_of, given_of, lexicon.noise)
    if core.words:
        return core
    every = tuple(re.sub(r"['’]", "", w) for w in re.findall(r"[^\W_]+(?:['’][^\W_]+)*", fold(name)))
    return Core(every or (re.sub(r"\s+", " ", name).strip(),))


def _parsed(name: str, text: str, trade_of: dict[str, str], given_of: dict[str, set[str]], noise: frozenset[str]) -> Core:
    trade, given, own = None, (), []
    for w in re.findall(r"[^\W_]+(?:['’][^\W_]+)*\.?", text):
        bare = re.sub(r"['’.]", "", w)
        if bare in trade_of:
            trade = trade or trade_of[bare]
        elif bare in given_of and not given:
            given = tuple(sorted(given_of[bare]))
        elif len(bare) > 1 and bare not in noise:
            own.append(bare + "." if w.endswith(".") and len(bare) >= 3 else bare)
    if own and own[-1].endswith(".") and not name.rstrip(" \"”").endswith(("Inc.", "Co.")) and len(own) > 2:
        own[-1] = own[-1][:-1]
    if len(own) > 2:  # slips in the common words
        for known in (trade_of, given_of):
            for w in list(own):
                hit = next((k for k in known if len(own) > 2 and len(k) >= 6 and abs(len(k) - len(w)) <= 2 and distance(k, w, 2) <= 2), None)
                if hit:
                    own.remove(w)
                    if known is trade_of:
                        trade = trade or trade_of[hit]
                    elif not given:
                        given = tuple(sorted(given_of[hit]))
    return Core(tuple(own), trade, given)


def distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is larger."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return most + 1
        row = new
    return min(row[-1], most + 1)


def bound(word: str) -> int:
    """Edits allowed in a word: two, which a swap of letters counts, in words of six letters or more; else one."""
    return 2 if len(word) >= 6 else 1 if len(word) >= 4 else 0


def reach(word: str) -> int:
    """Edits within which spellings of a word are looked for."""
    return 2 if len(word) >= 4 else 0


def alike(a: str, b: str, edits: int) -> bool:
    """Whether so many edits make slips: within both words' bound, or one swap of letters, in words of four letters or more."""
    return edits <= min(bound(a), bound(b)) or (edits == 2 and min(len(a), len(b)) >= 4 and sorted(a) == sorted(b))


class Automaton:
    """Levenshtein automata for up to k edits, determinised lazily and shared by all words.

    A state is the set of (offset, edits) that are alive relative to the letters read; a step depends only on which of the
    next 2k+1 letters of the word equal the letter read, so the table of steps serves every word.
    """

    def __init__(self, k: int) -> None:
        self.k, self.steps = k, {}
        self.start = self._closed({(0, 0)})

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        return frozenset((o, e) for o, e in states if not any(f < e and abs(o - p) <= e - f for p, f in states))

    def step(self, state: frozenset, match: int) -> frozenset:
        """The state after one letter; bit i of `match`: it equals the word's letter at the base + i - k."""
        if (got := self.steps.get((state, match))) is None:
            k, new = self.k, set()
            for o, e in state:  # o: place in the word relative to the number of letters read
                if match >> (o + k) & 1:
                    new.add((o, e))
                if e < k:
                    new.add((o - 1, e + 1))
                    new.add((o, e + 1))
                    for skip in range(1, k - e + 1):
                        if o + skip <= k and match >> (o + skip + k) & 1:
                            new.add((o + skip, e + skip))
            got = self.steps[state, match] = self._closed({(o, e) for o, e in new if -k <= o <= k and e <= k})
        return got

    def edits(self, state: frozenset, left: int) -> int:
        """Edits if the word has `left` letters more than were read (negative: fewer); k + 1 if too many."""
        return min((e + left - o for o, e in state if left - o >= 0), default=self.k + 1)


class Trie:
    """Words with the values filed under them, searched by automaton or by beginning."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, value) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(value)

    def near(self, word: str, automaton: Automaton) -> Iterator[tuple[str, int]]:
        """(value, edits) of all filed words within the automaton's edits of `word`."""
        k, n = automaton.k, len(word)
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << (i + k)
        window = (1 << (2 * k + 1)) - 1
        todo = [(self.root, automaton.start, 0)]
        while todo:
            node, state, depth = todo.pop()
            for c, child in node.items():
                if c == "":
                    e = automaton.edits(state, n - depth)
                    if e <= k:
                        for v in child:
                            yield v, e
                    continue
                new = automaton.step(state, at.get(c, 0) >> depth & window)
                if new:
                    todo.append((child, new, depth + 1))

    def under(self, prefix: str) -> Iterator:
        """Values of all filed words that begin with `prefix`."""
        node = self.root
        for c in prefix:
            if (node := node.get(c)) is None:
                return
        todo = [node]
        while todo:
            for c, child in todo.pop().items():
                if c == "":
                    yield from child
                else:
                    todo.append(child)


_AUTOMATA = {k: Automaton(k) for k in (1, 2)}


def variants(word: str, k: int) -> set[str]:
    """All ways to leave out up to k letters. Two words within k edits have one of these in common."""
    return {"".join(c for i, c in enumerate(word) if i not in out) for n in range(min(k, len(word)) + 1) for out in combinations(range(len(word)), n)}


def segments(text: str) -> Iterator[tuple[str, str]]:
    """(key, role) of a long text: its three parts, filed with their place and the whole length (role `i`), and the pieces that
    such parts become in a text up to two letters longer (role empty). Two edits leave one part whole, so that of two texts
    within two edits the longer one has a key that is a part of the shorter one."""
    for more in range(3):
        size, start = len(text) - more, 0
        for part in range(3):
            length = size // 3 + (part >= 3 - size % 3)
            for at in range(max(start - part, start + more - 2 + part, 0), min(start + part, start + more + 2 - part, len(text) - length) + 1):
                yield f"{size} {part} {text[at : at + length]}", "" if more or at != start else "i"
            start += length


def word_shards(word: str) -> Iterator[tuple[str, str, str, str]]:
    """Where single words meet if they are near: by what is left when letters are left out, long ones by their parts."""
    if reach(word) and len(word) < 14:
        for v in variants(word, reach(word)):
            yield f"1 {v}", word, "", ""
    if len(word) >= 12:
        for key, role in segments(word):
            yield f"+ {key}", word, "", role


def shards(words: tuple[str, ...], near: Mapping[str, Iterable[str]] = MappingProxyType({})) -> Iterator[tuple[str, str, str, str]]:
    """(shard, word, other, rest): where a core of any number of words is filed; `near` has, of a word, the words alike that sort
    before it. Two cores of full words within the bounds always meet in one of their shards, whatever the order of the words:

    `=`: all words but one are equal, and that one is near, or one is the beginning of the other (a cut-off word);
    `~`: two words or more carry slips; of two alike words the first in order is a name for both, so the cores meet under the
    names of any two of their words;
    `1`: single words of less than ten letters, by what is left when letters are left out;
    `+`: eight letters or more, the words run together or torn apart, by the parts of the whole.
    """
    whole = [w.rstrip(".") for w in words]
    if len(words) == 1 and len(words[0]) < 10 and not words[0].endswith("."):
        for v in variants(words[0], reach(words[0])) if reach(words[0]) else ():
            yield f"1 {v}", words[0], "", ""
    for i, w in enumerate(words) if len(words) > 1 else ():
        others = sorted((*words[:i], *words[i + 1 :]))
        if not any(o.endswith(".") for o in others):
            yield "= " + " ".join(others), w, "", ""
    for i, j in combinations(range(len(words)), 2):
        a, b = words[i], words[j]
        if not a.endswith(".") and not b.endswith(".") and min(len(a), len(b)) >= 4:
            rest = " ".join(sorted(w for n, w in enumerate(words) if n not in (i, j)))
            for x in (a, *near.get(a, ())):
                for y in (b, *near.get(b, ())):
                    yield "~ " + " ".join(sorted((x, y))), a, b, rest
    for joined in {"".join(whole), "".join(whole[::-1])}:
        if len(joined) >= 8:
            for key, role in segments(joined):
                yield f"+ {key}", joined, "", role


def _near(a: list[str], b: list[str]) -> bool:
    """Whether the words of two lists can be paired so that each pair is alike."""
    if len(a) != len(b):
        return False
    if not a:
        return True
    for i, w in enumerate(b):
        if alike(a[0], w, distance(a[0], w, 2)) and _near(a[1:], b[:i] + b[i + 1 :]):
            return True
    return False


def one_name(cut: str, words: set[str]) -> bool:
    """Whether the full words under a cut-off word (`cut`, with its dot) are spellings of one: connected by steps within the
    bound, or to a word with the same beginning, two letters longer than `cut`."""
    trie, heads = Trie(), {}
    for w in words:
        trie.add(w, w)
        heads.setdefault(w[: len(cut) + 2], []).append(w)
    todo = [next(iter(words))]
    seen = set(todo)
    while todo:
        w = todo.pop()
        near = [v for v, e in trie.near(w, _AUTOMATA[bound(w)]) if e <= bound(v)] if bound(w) else []
        new = {*near, *heads.pop(w[: len(cut) + 2], [])} - seen
        seen |= new
        todo += new
    return len(seen) == len(words)


def _match(rows: list[tuple]) -> Iterator[tuple[str, str, str, str]]:
    """(a, b, cut, full): edges between the cores of one cell, where `cut` is empty, and the full words that a cut-off word
    may stand for; rows: (cell, node, word, other, rest, trades, givens, blk)."""
    kind, parts = rows[0][0][0], rows[0][0].split("\t")
    divided = len(parts) > 1  # by what is left of the word, or by its beginning
    beginnings = divided and parts[1].startswith("^")
    both = kind == "~" and not divided  # a divided shard holds the words in both orders
    trie = Trie()
    for i, r in enumerate(rows):
        if not r[2].endswith(".") and (kind != "+" or r[4] == "i"):  # of long texts, the parts are searched by the pieces
            trie.add(r[2], i)
            if both:
                trie.add(r[3], ~i)

    def agree(r: tuple, s: tuple) -> bool:
        if r[7] and r[7] == s[7]:  # two blocks of one place: only across
            return False
        if r[1].partition(" (")[0] == s[1].partition(" (")[0]:  # equal words, told apart by trade or given name
            return False
        return not (r[5] and s[5] and not set(r[5]) & set(s[5])) and not (r[6] and s[6] and not set(r[6]) & set(s[6]))

    for i, r in enumerate(rows):
        if r[2].endswith("."):
            if len(r[2]) >= 4:
                for j in trie.under(r[2][:-1]):
                    if agree(r, rows[j]):
                        yield r[1], rows[j][1], r[2], rows[j][2]
            continue
        k = reach(r[2])
        if not k or beginnings:
            continue
        for j, e in trie.near(r[2], _AUTOMATA[k]):
            s, turned = rows[j if j >= 0 else ~j], j < 0
            if (s[1] <= r[1] and kind != "+") or not agree(r, s) or not alike(r[2], s[3] if turned else s[2], e):
                continue
            if kind == "~":
                rest = s[2] if turned else s[3]
                if not alike(r[3], rest, distance(r[3], rest, 2)) or not _near(r[4].split(), s[4].split()):
                    continue
            yield min(r[1], s[1]), max(r[1], s[1]), "", ""


_FILED = "node string, trades array<string>, givens array<string>, shard string, word string, other string, rest string"


def _placed(filed: DataFrame, cut) -> DataFrame:
    """`filed` with the shards that `cut` (shard, word, other, rest) -> iterable of such rows makes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, out = [], []
            for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in b.schema.names[3:]))):
                for x in dict.fromkeys(cut(*row)):
                    keep.append(i)
                    out.append(x)
            base = b.select(["node", "trades", "givens"]).take(pa.array(keep, pa.int64()))
            cols = [pa.array([o[i] for o in out], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*base.columns, *cols], names=["node", "trades", "givens", "shard", "word", "other", "rest"])

    return filed.mapInArrow(run, _FILED)


def _divide(shard: str, word: str, other: str, rest: str) -> Iterator[tuple[str, str, str, str]]:
    """The places of a row of a crowded shard: by the word with letters left out, and by its beginning for cut-off words."""
    if shard[0] == "=" and len(word) >= 3:
        yield f"{shard}\t^{word[:3]}", word, other, rest
    if not word.endswith("."):
        for v in variants(word, reach(word)):
            yield f"{shard}\t{v}", word, other, rest
        for v in variants(other, reach(other)) if shard[0] == "~" else ():
            yield f"{shard}\t{v}", other, word, rest


def _met(start: DataFrame, cut, hot: int) -> DataFrame:
    """(a, b, cut, full): what `_match` finds in the shards that `cut` makes of `start` (node, trades, givens, ...)."""
    spark = start.sparkSession
    filed = materialize(_placed(start, cut), "filed")
    # a shard of pieces that are nobody's part links nothing
    parts_too = F.col("shard").startswith("+") & (F.max(F.col("rest") == "i") == F.lit(False))
    sizes = filed.groupBy("shard").agg(F.count_distinct("node").alias("m"), parts_too.alias("idle")).where("m > 1 AND NOT idle").select("shard", "m")
    sizes = materialize(sizes, "sizes")
    crowded = sizes.where(F.col("m") > hot)
    cells = filed.join(sizes.where(F.col("m") <= hot).select("shard"), "shard").select(F.col("shard").alias("cell"), "node", "word", "other", "rest", "trades", "givens", F.lit(0).alias("blk"))
    if not crowded.isEmpty():
        parted = materialize(_placed(filed.join(crowded.select("shard"), "shard").select(*filed.columns), _divide), "divided")
        blocks = parted.groupBy("shard").agg(F.count_distinct("node").alias("m")).where("m > 1").select("shard", F.ceil(F.col("m") / hot).cast("int").alias("nb"))
        placed = parted.join(blocks, "shard").withColumn("mine", F.pmod(F.xxhash64("node"), "nb").cast("int"))
        placed = placed.withColumn("their", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        cell = F.concat_ws("\t", "shard", F.when(F.col("nb") > 1, F.concat_ws("\t", F.least("mine", "their"), F.greatest("mine", "their"))))
        blk = F.when(F.col("mine") == F.col("their"), 0).when(F.col("mine") < F.col("their"), 1).otherwise(2)
        cells = cells.unionByName(placed.select(cell.alias("cell"), "node", "word", "other", "rest", "trades", "givens", blk.alias("blk")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found(rows: list[tuple]) -> pa.RecordBatch:
            edges = sorted(set(_match(rows)))
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.string()) for i in range(4)], names=["a", "b", "cut", "full"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("cell", "node", "word", "other", "rest", "trades", "givens", "blk"))):
                if held and held[-1][0] != row[0]:
                    if len(held) > 1:
                        yield found(held)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield found(held)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return materialize(cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(search, "a string, b string, cut string, full string"), "met")


def spelling_links(cores: DataFrame, hot: int = 2_000) -> DataFrame:
    """(a, b) of nodes whose cores are within the bounds; `cores`: node, words, trades, givens, a row for each order of the words.

    The different words of the cores are linked first, then the cores are filed in shards by their words and these links; every
    shard is a trie that each of its own cores searches. A shard of more than `hot` cores is divided by what its words have in
    common when letters are left out, which words within the bound always have, so its cost follows its size; a place that is
    still crowded is divided into blocks that meet pairwise. A cut-off word is linked after all this, if all full words under
    it are spellings of one. No pair within the bounds is left out, and no division changes the result.
    """
    spark = cores.sparkSession
    each = cores.where(F.size("words") > 1).select("node", F.explode(F.array_distinct("words")).alias("word")).where(~F.col("word").endswith("."))
    none = F.array().cast("array<string>")
    alone = each.select("word").distinct().select(F.col("word").alias("node"), none.alias("trades"), none.alias("givens"), "word")
    near = _met(alone, word_shards, hot).select(F.col("b").alias("word"), "a").groupBy("word").agg(F.collect_set("a").alias("before"))
    near = each.join(near, "word").groupBy("node").agg(F.collect_list(F.struct("word", "before")).alias("near"))
    start = cores.select("node", "trades", "givens", F.array_join("words", " ").alias("words")).join(near, "node", "left")
    met = _met(start, lambda words, near: shards(tuple(words.split(" ")), {x["word"]: x["before"] for x in near or ()}), hot)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def linked(rows: list[tuple]) -> pa.RecordBatch:
            # a beginning that fits several names identifies none
            edges = sorted({r[:2] for r in rows}) if rows and one_name(rows[0][2], {r[3] for r in rows}) else []
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.string()) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("a", "b", "cut", "full"))):
                if held and held[-1][0] != row[0]:
                    yield linked(held)
                    held = []
                held.append(row)
        yield linked(held)

    whole = met.where("cut <> ''").repartition(parts, "a").sortWithinPartitions("a").mapInArrow(decide, "a string, b string")
    return met.where("cut = ''").select("a", "b").union(whole).distinct()


def _clusters(combos: list[tuple[str | None, tuple[str, ...]]]) -> list[int]:
    """A group number for each (trade, given names): those with most facts first, each joins the one group all of which agrees
    with it; one that agrees with several groups belongs to none of them."""
    agree = lambda x, y: (not x[0] or not y[0] or x[0] == y[0]) and (not x[1] or not y[1] or bool(set(x[1]) & set(y[1])))
    groups: list[list[int]] = []
    for i in sorted(range(len(combos)), key=lambda i: (-bool(combos[i][0]) - bool(combos[i][1]), combos[i][0] or "", combos[i][1])):
        fit = [g for g in groups if all(agree(combos[i], combos[j]) for j in g)]
        if len(fit) == 1:
            fit[0].append(i)
        else:
            groups.append([i])
    return [next(n for n, g in enumerate(groups) if i in g) for i in range(len(combos))]


def link_names(names: DataFrame, column: str = "name", lexicon: Lexicon = Lexicon(), hot: int = 2_000) -> DataFrame:
    """(name, entity): each distinct name with the smallest core of the entity it belongs to.

    A name's core is its own words, freed of case, accents, places and what the lexicon knows as legal forms, trades and given
    names. Names with equal words in any order are one entity unless their trades or given names differ; a name without these
    joins the only entity it fits, and stays alone where it fits several. Cores within the slips that `shards` describes are
    linked. NULL and blank names are left out; every other name comes out, if only by itself. Repeated rows count once. An
    empty table gives no rows.
    """
    distinct = names.select(F.col(column).alias("name")).where(F.trim(F.regexp_replace("name", r"\s", " ")) != "").distinct()

    def analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cores = [core_of(n, lexicon) for n in b.column("name").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("name"),
                    pa.array([" ".join(sorted(c.words)) for c in cores], pa.string()),
                    pa.array([list(min(c.words, c.words[::-1])) for c in cores], pa.list_(pa.string())),  # run together both ways
                    pa.array([c.trade or "" for c in cores], pa.string()),
                    pa.array([" ".join(c.given) for c in cores], pa.string()),
                ],
                names=["name", "own", "words", "trade", "given"],
            )

    parsed = materialize(distinct.mapInArrow(analyse, "name string, own string, words array<string>, trade string, given string"), "names")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for own, orders, combos in zip(*(b.column(c).to_pylist() for c in ("own", "orders", "combos"))):
                keys = [(c["trade"], tuple(c["given"].split())) for c in combos]
                groups = _clusters(keys)
                for g in dict.fromkeys(groups):
                    inside = [k for k, x in zip(keys, groups) if x == g]
                    node = own if len(set(groups)) == 1 else f"{own} ({min(' '.join((t, *gs)) for t, gs in inside)})"
                    trades, givens = sorted({t for t, _ in inside if t}), sorted({x for _, gs in inside for x in gs})
                    rows += [(own, c["trade"], c["given"], node, orders, trades, givens) for c, x in zip(combos, groups) if x == g]
            kinds = [pa.string()] * 4 + [pa.list_(pa.list_(pa.string()))] + [pa.list_(pa.string())] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["own", "trade", "given", "node", "orders", "trades", "givens"])

    # the facts of equal words are as many as the lexicon allows, the orders as many as the words
    facts = parsed.groupBy("own").agg(F.collect_set("words").alias("orders"), F.collect_set(F.struct("trade", "given")).alias("combos"))
    nodes = facts.mapInArrow(split, "own string, trade string, given string, node string, orders array<array<string>>, trades array<string>, givens array<string>")
    nodes = materialize(nodes, "nodes")
    typed = nodes.select("node", "trades", "givens", F.explode("orders").alias("words"))
    cores = typed.groupBy("node", "words").agg(F.min("trades").alias("trades"), F.min("givens").alias("givens"))
    linked = components(spelling_links(cores, hot)).withColumnRenamed("component", "entity")
    placed = nodes.select("own", "trade", "given", "node").join(linked, "node", "left").select("own", "trade", "given", F.coalesce("entity", "node").alias("entity"))
    return parsed.select("name", "own", "trade", "given").join(placed, ["own", "trade", "given"]).select("name", "entity")
