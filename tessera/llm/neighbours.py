"""Near-duplicate records by Jaccard similarity of their term sets, over count-vector R-trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.terms import TERM
from tessera.operators.graph import components
from tessera.session import materialize, release

GROUPS = 32  # token groups; a point has one count per group
LEAF = 64  # points of an R-tree leaf
FANOUT = 16  # nodes under an inner node
HOT_SLOTS = 1 << 16
SLOTS = 1 << 16  # slots of tokens whose frequency is estimated, in a sample of so many records
SAMPLE = 20_000
LEVELS = 3  # tokens in common by which crowded cells are divided, at most


def _terms(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def band_plan(threshold: float, miss: float = 0.01, rows: int = 5) -> tuple[int, int]:
    """(bands, rows) such that a pair at the threshold shares no band with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows)), rows


def band_rows(n: int) -> int:
    """Minima in a band key for a collection of n records: five up to two million, and one more each time the collection
    grows by 2.3, which keeps the random collisions a record takes part in at their number, at any size."""
    return 5 + max(0, math.ceil(math.log(max(n, 1) / 2e6) / math.log(2.3)))


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, n, same, scale, counts, keys) of (id, tokens): size, content hash, group counts, band keys of each token set.

    Group g counts the tokens whose hash falls into it; a band key is the hash of `rows` minima of the token set. Whole token
    sets are used, in Arrow batches. Counts are packed as four bits each, in units of `scale` and rounded up, so that they
    bound the true counts from above at any length; the scale is 1 unless a group holds more than 15 tokens.
    """
    rng = np.random.default_rng(20_011)
    mul = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mix = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            starts = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[starts[0] : starts[-1]]
            starts = starts - starts[0]
            n = np.diff(starts)
            full = n > 0
            at = starts[:-1][full]
            keys = np.zeros((len(n), bands), np.uint64)
            for i in range(bands * rows):
                h = (flat ^ mix[i]) * mul[i]
                low = np.zeros(len(n), np.uint64)
                if len(at):
                    low[full] = np.minimum.reduceat(h ^ (h >> np.uint64(29)), at)
                keys[:, i // rows] = (keys[:, i // rows] * np.uint64(0x9E3779B97F4A7C15)) ^ (low + np.uint64(i))
            keys = (keys + np.arange(bands, dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            doc = np.repeat(np.arange(len(n)), n)
            group = ((flat * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(59)).astype(np.int64)
            counts = np.bincount(doc * GROUPS + group, minlength=len(n) * GROUPS).reshape(-1, GROUPS)
            scale = np.maximum(1, -(-counts.max(1, initial=0) // 15))
            nibbles = (-(-counts // scale[:, None])).astype(np.uint8)
            packed = nibbles[:, 0::2] | (nibbles[:, 1::2] << 4)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"),
                    pa.array(n.astype(np.int32)),
                    b.column("same"),
                    pa.array(scale.astype(np.int32)),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(GROUPS // 2), len(n), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(keys.ravel().view(np.int64))),
                ],
                names=["id", "n", "same", "scale", "counts", "keys"],
            )

    return docs.mapInArrow(run, "id bigint, n int, same bigint, scale int, counts binary, keys array<bigint>")


class CountTree:
    """An R-tree over (key, group counts): nodes carry the key range and the coordinate-wise maxima below them.

    Points are packed in the order of their keys, then of their counts, so that a node's box is narrow in the leading
    coordinate. A query descends only into nodes whose key range holds its key and whose maxima allow enough overlap.
    """

    def __init__(self, key: np.ndarray, size: np.ndarray, counts: np.ndarray) -> None:
        self.key, self.size, self.counts = key, size, counts
        self.levels = []
        lo, hi, top, least = key, key, counts, size
        span = LEAF
        while True:
            cut = np.arange(0, len(lo), span)
            lo, hi = np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)
            top, least = np.maximum.reduceat(top, cut, axis=0), np.minimum.reduceat(least, cut)
            self.levels.append((lo, hi, top, least))
            if len(lo) <= FANOUT:
                break
            span = FANOUT

    def pairs(self, share: float, chunk: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions a < b of points with equal keys whose counts allow a Jaccard similarity of `share`."""
        bound = share / (1 + share)
        n = len(self.key)
        for q0 in range(0, n, chunk):
            q = np.arange(q0, min(n, q0 + chunk))
            lo, hi, _, _ = self.levels[-1]
            node_q, node = np.nonzero((lo[None] <= self.key[q][:, None]) & (hi[None] >= self.key[q][:, None]))
            node_q = q[node_q]
            for depth in range(len(self.levels) - 1, -1, -1):
                lo, hi, top, least = self.levels[depth]
                ok = (lo[node] <= self.key[node_q]) & (hi[node] >= self.key[node_q])
                node_q, node = node_q[ok], node[ok]
                keep = np.zeros(len(node), bool)
                for s in range(0, len(node), 65_536):  # bounded blocks of node tests
                    e = slice(s, s + 65_536)
                    over = np.minimum(self.counts[node_q[e]], top[node[e]]).sum(1, dtype=np.int32)
                    keep[e] = over >= bound * (self.size[node_q[e]] + least[node[e]]) - 1e-9
                node_q, node = node_q[keep], node[keep]
                span, limit = (LEAF, n) if depth == 0 else (FANOUT, len(self.levels[depth - 1][0]))
                for s in range(0, len(node), 16_384) if depth == 0 else ():
                    child = node[s : s + 16_384, None] * span + np.arange(span)[None]
                    a = np.repeat(node_q[s : s + 16_384], span)
                    b = child.ravel()
                    ok = (b < limit) & (b > a)
                    a, b = a[ok], b[ok]
                    ok = self.key[a] == self.key[b]
                    a, b = a[ok], b[ok]
                    over = np.minimum(self.counts[a], self.counts[b]).sum(1, dtype=np.int32)
                    ok = over >= bound * (self.size[a] + self.size[b]) - 1e-9
                    if ok.any():
                        yield a[ok], b[ok]
                if depth:
                    child = node[:, None] * span + np.arange(span)[None]
                    node_q, node = np.repeat(node_q, span), child.ravel()
                    ok = node < limit
                    node_q, node = node_q[ok], node[ok]


def _packed(column: pa.Array, width: int) -> np.ndarray:
    """A binary Arrow column of `width` bytes a value as rows of bytes, without an object per row."""
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(-1, width) if len(column) else np.empty((0, width), np.uint8)


def _by_cell(search, names: tuple[str, ...], packed: str, width: int):
    """Arrow batches sorted by cell -> what `search` makes of whole cells, buffered up to a block; `names` begin with cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        rows = 0

        def take(upto_key) -> list:
            cols = [np.concatenate([h[i] for h in held]) for i in range(len(names) + 1)]
            cut = len(cols[0]) if upto_key is None else int(np.searchsorted(cols[0], upto_key))
            done, rest = [c[:cut] for c in cols], [c[cut:] for c in cols]
            held[:] = [rest] if len(rest[0]) else []
            return done

        for b in batches:
            held.append([*(b.column(c).to_numpy(zero_copy_only=False) for c in names), _packed(b.column(packed), width)])
            rows += b.num_rows
            if rows >= 200_000:
                done = take(held[-1][0][-1])
                rows = len(held[0][0]) if held else 0
                if len(done[0]) > 1:
                    yield search(done)
        if held:
            done = take(None)
            if len(done[0]) > 1:
                yield search(done)

    return run


def _pairs(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    """Different pairs of content hashes, the smaller one first."""
    a, b = np.concatenate([np.empty(0, np.int64), *left]), np.concatenate([np.empty(0, np.int64), *right])
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _tree_join(share: float):
    """Arrow batches sorted by cell -> candidate pairs; the cells of a block are searched as one tree."""

    def search(cols: list[np.ndarray]) -> pa.RecordBatch:
        cell, same, size, blk, scale, packed = cols
        # short numbers where they hold every count, which halves the memory that is read
        counts = np.empty((len(packed), GROUPS), np.int16 if 15 * int(scale.max()) < 1 << 15 else np.int32)
        counts[:, 0::2], counts[:, 1::2] = packed & 15, packed >> 4
        counts *= scale[:, None].astype(counts.dtype)
        order = np.lexsort((counts[:, 0], counts[:, 1], counts[:, 2], size, cell))
        cell, same, size, blk, counts = cell[order], same[order], size[order], blk[order], counts[order]
        tree = CountTree(cell, size.astype(np.int32), counts)
        left, right = [], []
        for a, b in tree.pairs(share):
            # of a divided cell, one side is compared with the other; the diagonal is compared with itself
            ok = (same[a] != same[b]) & ((blk[a] != blk[b]) | (blk[a] == 0))
            left.append(same[a[ok]])
            right.append(same[b[ok]])
        return _pairs(left, right)

    return _by_cell(search, ("cell", "same", "n", "blk", "scale"), "counts", GROUPS // 2)


def _crowded(points: DataFrame, column: str, hot: int) -> DataFrame | None:
    """(key, nb): the keys that more than `hot` points have, and into how many blocks these go; None if there are none."""
    key = F.col(column).alias("key")
    slot = F.pmod("key", F.lit(HOT_SLOTS))
    # a crowded key makes its slot crowded; only keys of such slots need a count of their own
    slots = points.select(key).groupBy(slot.alias("slot")).count().where(F.col("count") > hot).select("slot")
    slots = materialize(slots, "slots")
    if slots.isEmpty():
        return None
    crowded = points.select(key).withColumn("slot", slot).join(slots, "slot", "left_semi").groupBy("key").count().where(F.col("count") > hot)
    crowded = materialize(crowded.select("key", F.ceil(F.col("count") / hot).cast("int").alias("nb")), "hot")
    return None if crowded.isEmpty() else crowded


def candidate_pairs(sigs: DataFrame, share: float, hot: int = 20_000) -> DataFrame:
    """(a, b) content hashes, a < b, of token sets that share a band and whose group counts allow the similarity.

    Records with equal token sets enter once. A band key that more than `hot` different sets share is divided: its sets fall
    into blocks of `hot` rows at most on average, every block meets itself and every other one in a cell of its own, so
    that no task holds the whole group and no pair is lost.
    """
    points = sigs.where("n > 0").dropDuplicates(["same"]).select("same", "n", "scale", "counts", F.explode(F.array_distinct("keys")).alias("key"))
    crowded = _crowded(points, "key", hot)
    rows = points.withColumnRenamed("key", "cell")
    return _search(_in_blocks(rows, crowded), _tree_join(share))


def _in_blocks(rows: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """`rows` (cell, same, ...) with `blk`, those of the cells in `crowded` (key, nb) placed in blocks that meet pairwise."""
    if crowded is None or crowded.isEmpty():
        return rows.withColumn("blk", F.lit(0))
    placed = rows.join(crowded.withColumnRenamed("key", "cell"), "cell", "left").withColumn("mine", F.when(F.col("nb").isNull(), 0).otherwise(F.pmod(F.xxhash64("same"), "nb").cast("int")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("nb"), F.lit(1)) - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    cell = F.when(F.col("nb").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", low, high))
    # 0 on the diagonal; off it 1 and 2 tell the two blocks apart
    blk = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return placed.select(cell.alias("cell"), *[c for c in rows.columns if c != "cell"], blk.alias("blk"))


def _search(cells: DataFrame, search) -> DataFrame:
    spark = cells.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(search, "a bigint, b bigint")
    return found.distinct()


def token_order(hashed: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(place of each slot of tokens, from the rarest to the commonest; words of a bit set) of a collection of n records.

    The slot of a token is the top of its hash. Slots are counted in a sample of SAMPLE records: any order serves, one near
    to the true one costs least. A bit set has two words, and more where records have more than ninety terms on average.
    """
    every = max(1, n // SAMPLE)
    sample = hashed.where(F.pmod(F.xxhash64("id", F.lit("order")), F.lit(every)) == 0).select(F.explode("tokens").alias("t"))
    seen = np.zeros(SLOTS, np.int64)
    for r in sample.groupBy(F.shiftrightunsigned("t", 48).alias("slot")).count().collect():  # SLOTS rows at most
        seen[r["slot"]] = r["count"]
    place = np.empty(SLOTS, np.uint16)
    place[np.argsort(seen, kind="stable")] = np.arange(SLOTS)
    return place, min(16, max(2, math.ceil(seen.sum() / max(1, n / every) / 45)))


def least_shared(share: float) -> int:
    """Tokens that two different sets have in common at least, if their similarity is `share`: with i of them, the sets have
    i + 1 tokens or more together."""
    return math.ceil(share / (1 - share) - 1e-9) if share < 1 else LEVELS


def prefixes(docs: DataFrame, place: np.ndarray, words: int, share: float) -> DataFrame:
    """(id, n, same, bits, keys) of (id, tokens, same): size, content hash, bit set and first tokens of each token set.

    Tokens are put in the order of `place`, then of the rest of their hash; two sets with a similarity of `share` have a token
    in common among the first n - share * n + 1 of each, and a second one among one more. A bit tells whether an odd number
    of tokens falls into its place, so two sets differ in as many tokens as their bit sets do in bits, or more.
    """
    more = min(LEVELS, least_shared(share)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            starts = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[starts[0] : starts[-1]]
            starts = starts - starts[0]
            n = np.diff(starts)
            doc = np.repeat(np.arange(len(n)), n)
            # the place instead of the slot: still one number for each token
            flat = place[flat >> np.uint64(48)].astype(np.uint64) << np.uint64(48) | flat & np.uint64((1 << 48) - 1)
            flat = flat[np.lexsort((flat, doc))]
            bit = ((flat & np.uint64((1 << 48) - 1)) % np.uint64(64 * words)).astype(np.int64)
            odd = np.bincount(doc * 64 * words + bit, minlength=len(n) * 64 * words).astype(np.uint8) & 1
            bits = np.packbits(odd)
            first = np.where(n > 0, np.minimum(n, n - np.ceil(share * n - 1e-9).astype(np.int64) + 1 + more), 0)
            ends = np.concatenate([[0], np.cumsum(first)])
            at = np.arange(ends[-1]) - np.repeat(ends[:-1] - starts[:-1], first)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"),
                    pa.array(n.astype(np.int32)),
                    b.column("same"),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * words), len(n), [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[at].view(np.int64))),
                ],
                names=["id", "n", "same", "bits", "keys"],
            )

    return docs.mapInArrow(run, "id bigint, n int, same bigint, bits binary, keys array<bigint>")


def near_bits(size: np.ndarray, most: np.ndarray, bits: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (x, y) of the sets of one cell, x being as large as y or larger, whose bit sets allow the similarity.

    `most` is the size of the largest set that a set can be alike to, given the token it is filed by. Blocks of sets meet as
    tables of counts of different bits.
    """
    limit = (1 - share) / (1 + share)
    cap = np.minimum(size, most)
    xs, ys = np.argsort(cap, kind="stable"), np.flatnonzero(most >= size)
    ys = ys[np.argsort(size[ys], kind="stable")]
    sizes, left, right = size[ys], [np.ascontiguousarray(w) for w in bits[xs].T], [np.ascontiguousarray(w) for w in bits[ys].T]
    kind = np.uint8 if len(left) < 4 else np.uint16
    bound = np.minimum(np.floor(limit * (size[xs].astype(np.int64) + cap[xs]) + 1e-9), np.iinfo(kind).max).astype(kind)[:, None]
    for i in range(0, len(xs), 32):
        x = slice(i, i + 32)
        low = int(np.searchsorted(sizes, math.ceil(share * int(size[xs[x]].min()) - 1e-9)))
        high = int(np.searchsorted(sizes, int(cap[xs[x]].max()), "right"))
        for j in range(low, high, 4096):
            y = slice(j, min(j + 4096, high))
            odd = np.bitwise_count(left[0][x, None] ^ right[0][None, y]).astype(kind, copy=False)
            for u, v in zip(left[1:], right[1:]):
                odd += np.bitwise_count(u[x, None] ^ v[None, y])
            at = np.flatnonzero(odd <= bound[x])
            if len(at):
                width = y.stop - j
                a, b = xs[i + at // width], ys[j + at % width]
                ok = (size[b] <= cap[a]) & (size[a] <= most[b]) & (size[b] >= share * size[a] - 1e-9)
                ok &= odd.ravel()[at] <= limit * (size[a].astype(np.int64) + size[b]) + 1e-9
                yield a[ok], b[ok]


def _bit_join(share: float, words: int):
    """Arrow batches sorted by cell -> candidate pairs of each cell."""

    def search(cols: list[np.ndarray]) -> pa.RecordBatch:
        cell, same, size, blk, most, packed = cols
        bits = np.ascontiguousarray(packed).view(np.uint64)
        ends = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]
        left, right = [], []
        for lo, hi in zip(ends[:-1], ends[1:]):
            for a, b in near_bits(size[lo:hi], most[lo:hi], bits[lo:hi], share) if hi - lo > 1 else ():
                a, b = a + lo, b + lo
                ok = (same[a] != same[b]) & ((blk[a] != blk[b]) | (blk[a] == 0))
                left.append(same[a[ok]])
                right.append(same[b[ok]])
        return _pairs(left, right)

    return _by_cell(search, ("cell", "same", "n", "blk", "most"), "bits", 8 * words)


def all_candidate_pairs(sigs: DataFrame, share: float, words: int, hot: int = 20_000) -> DataFrame:
    """(a, b) content hashes, a < b, of all pairs of different token sets whose sizes and bit sets allow the similarity.

    Sets meet in the cell of the first token they share. A cell of more than `hot` sets is divided by the second one, then by
    the third one, and after that into blocks that meet pairwise; as many tokens as that are always shared. Nothing is lost.
    """
    start = sigs.where("n > 0").dropDuplicates(["same"])
    rows = start.select("same", "n", "bits", "keys", F.posexplode("keys").alias("at", "cell"))
    levels, done = min(LEVELS, least_shared(share)), []
    for level in range(1, levels + 1):
        most = F.floor((F.col("n") - F.col("at") + level - 1) * F.lit((1 + share) / share) - F.col("n") + 1e-9).cast("int")
        rows = rows.withColumn("most", most).where(F.col("most") >= F.ceil(F.col("n") * F.lit(share) - 1e-9))
        full = _crowded(rows, "cell", hot)
        flat = rows.select("cell", "same", "n", "most", "bits")
        if full is None or level == levels:
            done.append(_in_blocks(flat, full))
            break
        done.append(_in_blocks(flat.join(full.select(F.col("key").alias("cell")), "cell", "left_anti"), None))
        inside = rows.join(full.select(F.col("key").alias("cell")), "cell").withColumnRenamed("at", "before").withColumnRenamed("cell", "path")
        rows = inside.select("same", "n", "bits", "keys", "before", "path", F.posexplode("keys").alias("at", "key")).where(F.col("at") > F.col("before"))
        rows = rows.select("same", "n", "bits", "keys", "at", F.xxhash64("path", "key").alias("cell"))
    cells = done[0]
    for d in done[1:]:
        cells = cells.unionByName(d)
    return _search(cells, _bit_join(share, words))


def near_duplicates(df: DataFrame, key: str, fields: list[str], share: float = 0.7, miss: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(links, members) of the records of `df`: links (a, b, similarity) between classes of records with equal term sets,
    a < b being their smallest keys, whose distinct terms are at least `share` in common; members (id, class) of every record.

    Terms are the runs of TERM in the fields joined by one space, NULL being empty. Repeated rows of a key are one record (one
    that holds several texts is in the class of each); rows with a NULL key are left out; a record without a term is a class
    of its own and has no link. Every surviving candidate is verified on its exact terms, so no false link comes out; a true
    one is missed with probability `miss` at most at the threshold, and less above; with `miss` = 0 none is missed. Columns of
    other names are not read. An empty table gives no rows.

    Plan: token hashes -> one compact row per record, kept in the shared folder -> cells -> exact verification of the term
    sets that take part. With `miss` = 0 the rows are first tokens from the rarest on and bit sets, the cells are those of a
    shared token, and bit sets are compared; else they are count vectors and band keys, the cells those of equal band keys,
    and each is searched by a count-vector R-tree.
    """
    source = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.concat_ws(" ", *[F.col(f).cast("string") for f in fields]).alias("text"))

    # the generators keep the optimizer from evaluating the terms once per reference
    tokens = F.sort_array(F.array_distinct(F.transform(_terms("text"), lambda t: F.xxhash64(t))))
    hashed = source.select("id", F.explode(F.array(tokens)).alias("tokens")).select("id", "tokens", F.xxhash64("tokens").alias("same"))
    if miss:
        sigs = materialize(signatures(hashed, *band_plan(share, miss, band_rows(source.count()))), "sig")
        pairs = materialize(candidate_pairs(sigs, share), "pairs")
    else:
        place, words = token_order(hashed, source.count())
        sigs = materialize(prefixes(hashed, place, words, share), "sig")
        pairs = materialize(all_candidate_pairs(sigs, share, words), "pairs")
    ids = sigs.select("id", F.when(F.col("n") > 0, F.col("same")).alias("same")).distinct()
    first = materialize(ids.where("same IS NOT NULL").groupBy("same").agg(F.min("id").alias("class")), "first")

    # exact verification: of each set that takes part, one record is read again, and its terms travel once, as one string
    taking = pairs.select(F.col("a").alias("same")).union(pairs.select("b")).distinct().join(first, "same").select(F.col("class").alias("id"))
    again = _perhaps(source, "id", materialize(taking, "taking")).select(F.explode(F.array(F.array_distinct(_terms("text")))).alias("terms"))
    text = again.select(F.xxhash64(F.sort_array(F.transform("terms", lambda t: F.xxhash64(t)))).alias("same"), F.array_join("terms", " ").alias("terms")).dropDuplicates(["same"])
    left, right = text.select(F.col("same").alias("a"), F.col("terms").alias("ta")), text.select(F.col("same").alias("b"), F.col("terms").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.split("ta", " ").alias("ta"), F.split("tb", " ").alias("tb"))
    both = both.select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.size(F.array_intersect("ta", "tb")).alias("i"))
    similarity = F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))
    linked = both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= share)

    # a set's class is its smallest record; records without terms stand for themselves
    members = materialize(ids.join(first, "same", "left").select("id", F.coalesce("class", "id").alias("class")), "members")
    named = linked.join(first.select(F.col("same").alias("a"), F.col("class").alias("x")), "a").join(first.select(F.col("same").alias("b"), F.col("class").alias("y")), "b")
    links = materialize(named.where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("similarity").alias("similarity")), "links")
    release(sigs, pairs)
    return links, members


def expanded(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b) of all pairs of records, a < b: those of linked classes, and those within a class."""
    side = lambda c, x: members.select(F.col("class").alias(c), F.col("id").alias(x))
    across = links.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    crowd = members.groupBy("class").count().where("count > 1").select("class")
    copies = members.join(crowd, "class")
    within = copies.select("class", F.col("id").alias("a")).join(copies.select("class", F.col("id").alias("b")), "class").where("a < b").select("a", "b")
    return across.unionByName(within).distinct()


def grouped(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class, links, group): each record with its class, the number of other classes like it, and the smallest class that
    a chain of links connects it to."""
    degree = links.select(F.col("a").alias("class")).union(links.select("b")).groupBy("class").agg(F.count("*").alias("links"))
    group = components(links).select(F.col("node").alias("class"), F.col("component").alias("group"))
    full = members.join(degree, "class", "left").join(group, "class", "left")
    return full.select("id", "class", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group", "class").alias("group"))


FILTER_BITS = (1 << 16, 1 << 26)  # least and most bits of a filter: a table of 1,024 to 1,048,576 words


def _perhaps(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of `df` whose value may be in `keys`: all that are, and few others; an exact join follows.

    A filter of eight bits a key, within FILTER_BITS, is made by hash aggregation and broadcast as a table of words.
    """
    bits = min(max(1 << (8 * max(keys.count(), 1) - 1).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    slot = F.pmod(F.xxhash64(column, F.lit("filter")), F.lit(bits))
    mask = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    words = keys.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(mask).alias("bits"))
    placed = df.withColumn("slot", slot).withColumn("word", F.floor(F.col("slot") / 64))
    return placed.join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(mask) != 0).select(*df.columns)  # FILTER_BITS / 64 rows at most
