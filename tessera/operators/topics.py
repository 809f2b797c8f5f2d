"""Topics of documents: vocabulary, nonnegative factors, latent Dirichlet allocation, stability and naming."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel, NGram, StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.similarity import tfidf
from tessera.session import materialize

# English words without a meaning of their own.
STOP_WORDS = """a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do
does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more
most must my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them
themselves then there these they this those through to too under until up upon us very was we were what when where which while who whom why will with within
without would you your yours yourself yourselves""".split()
VOCABULARY = 50_000  # most terms that a topic model keeps, the most frequent ones; its factors are this wide
BLOCK = 4096  # terms of which one row of partial sums holds all factors
SENT = 1 << 25  # bytes of partial sums that the driver takes at a time


def vectors(docs: DataFrame, text: str, min_df: int = 3, max_share: float = 0.6, stop: Sequence[str] = (), size: int = VOCABULARY) -> tuple[DataFrame, list[str], dict]:
    """(documents with `features` and `terms`, vocabulary, report): words and word pairs without stop words, within the
    frequency bounds; of more than `size` terms the most frequent. The report says how many terms there are, how many are kept,
    and what share of all occurrences these hold."""
    tokens = docs.withColumn("words", F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z\-]+"), F.lit(0)))
    kept = StopWordsRemover(inputCol="words", outputCol="kept", stopWords=[*STOP_WORDS, *stop]).transform(tokens)
    pairs = materialize(NGram(n=2, inputCol="kept", outputCol="pairs").transform(kept).withColumn("terms", F.concat("kept", "pairs")).drop("words", "kept", "pairs"), "terms")
    n = pairs.count()
    counts = pairs.select(F.monotonically_increasing_id().alias("i"), F.explode("terms").alias("term")).groupBy("i", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    fit = materialize(counts.where((F.col("df") >= min_df) & (F.col("df") <= max_share * n)), "vocabulary")
    vocabulary = [r["term"] for r in fit.orderBy(F.desc("tf"), "term").limit(size).collect()]  # `size` terms at most
    total = fit.agg(F.count("*"), F.sum("tf")).first()
    held = fit.orderBy(F.desc("tf"), "term").limit(size).agg(F.sum("tf")).first()[0]
    report = {"terms": total[0], "kept": len(vocabulary), "share": float(held / total[1]) if total[1] else 0.0}
    if not vocabulary:
        raise ValueError("no term lies within the frequency bounds")
    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="features")
    return model.transform(pairs), vocabulary, report


def weighted(docs: DataFrame, key: str, vocabulary: Sequence[str]) -> DataFrame:
    """(key, term, w) of the terms in the vocabulary: 1 + ln(tf) times ln((1+N)/(1+df)) + 1, of length 1 per document."""
    known = docs.sparkSession.createDataFrame([(t,) for t in vocabulary], "term string")
    cells = docs.select(key, F.explode("terms").alias("term")).join(known, "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"))
    return tfidf(cells, key).select(key, "term", "w")


class Factors:
    """Documents' cells in the shared folder, and what is summed over them for given factors of the terms."""

    def __init__(self, cells: DataFrame, doc: str, term: str, value: str, terms: Sequence[str] | None = None) -> None:
        self.spark, self.doc = cells.sparkSession, doc
        self.terms = list(terms) if terms is not None else [r[0] for r in cells.groupBy(term).agg(F.sum(value).alias("s")).orderBy(F.desc("s"), term).collect()]  # VOCABULARY at most, by `vectors`
        if len(self.terms) > VOCABULARY:
            raise ValueError(f"factors take {VOCABULARY} terms at most")
        index = self.spark.createDataFrame([(t, i) for i, t in enumerate(self.terms)], f"`{term}` string, j int")
        rows = cells.join(index, term).groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("j", F.col(value).cast("double").alias("v")))).alias("c"))
        self.rows = materialize(rows.select(doc, "c.j", "c.v"), "rows")  # a document's own terms

    def sums(self, given, of, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all documents, a batch at a time: `of` (given, document of each cell, number of documents, terms' places,
        values) -> (width, documents) weights and `size` more numbers. Gives (width, terms): weights times values; and these numbers.

        Each task sends the driver its own sums; there are no more tasks than cores, and fewer where their sums would exceed SENT.
        """
        n, handle = len(self.terms), self.spark.sparkContext.broadcast(given)

        def run(batches):
            import pyarrow as pa

            at, rest, seen = np.zeros((width, n)), np.zeros(size), False
            for b in batches:
                i, j, v = _cells(b)
                w, more = of(handle.value, i, b.num_rows, j, v)
                for r in range(width):
                    at[r] += np.bincount(j, w[r, i] * v, n)
                rest, seen = rest + more, True
            if seen:
                kinds = pa.schema([("block", pa.int32()), ("s", pa.binary())])
                yield pa.RecordBatch.from_pydict({"block": [-1], "s": [rest.tobytes()]}, kinds)
                for c in range(0, n if width else 0, BLOCK):
                    yield pa.RecordBatch.from_pydict({"block": [c], "s": [at[:, c : c + BLOCK].tobytes()]}, kinds)

        tasks = min(self.spark.sparkContext.defaultParallelism, max(1, SENT // (8 * (width * n + size))))
        out, rest = np.zeros((width, n)), np.zeros(size)
        for r in self.rows.select("j", "v").coalesce(tasks).mapInArrow(run, "block int, s binary").collect():  # SENT bytes at most, or one task's sums
            s = np.frombuffer(r["s"])
            if r["block"] < 0:
                rest += s
            else:
                out[:, r["block"] : r["block"] + BLOCK] += s.reshape(width, -1)
        handle.destroy()
        return out, rest


def _cells(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each cell in an Arrow batch of rows, its row, its term's place and its value."""
    j, v = batch.column("j"), batch.column("v")
    return np.repeat(np.arange(batch.num_rows), j.value_lengths().to_numpy(zero_copy_only=False)), j.flatten().to_numpy(), v.flatten().to_numpy()


def _products(base: np.ndarray, i: np.ndarray, n: int, j: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(factors, documents): the factors' products with each document."""
    return np.array([np.bincount(i, row[j] * v, n) for row in base])


def _places(ks: Sequence[int]) -> list[slice]:
    """Where the factors of each model are when those of all models stand below each other."""
    ends = np.cumsum(ks).tolist()
    return [slice(e - k, e) for k, e in zip(ks, ends)]


def _grams(w: np.ndarray, places: Sequence[slice]) -> np.ndarray:
    return np.concatenate([(w[p] @ w[p].T).ravel() for p in places])


def _squares(numbers: np.ndarray, ks: Sequence[int]) -> list[np.ndarray]:
    return [x.reshape(k, k) for k, x in zip(ks, np.split(numbers, np.cumsum([k * k for k in ks])[:-1]))]


def singular_start(f: Factors, k: int, rounds: int = 4) -> np.ndarray:
    """Nonnegative factors of the terms from the leading singular vectors, found by subspace iteration over the documents: of
    each pair of vectors the heavier of its positive and negative parts, zeros being the mean."""
    return singular_starts(f, [k], rounds)[0]


def singular_starts(f: Factors, ks: Sequence[int], rounds: int = 4) -> list[np.ndarray]:
    """The same for several numbers of factors in the same passes."""
    n = len(f.terms)
    ks = [min(k, n) for k in ks]
    places, width = _places(ks), sum(ks)
    each = [np.linalg.qr(np.random.default_rng(0).standard_normal((n, k)))[0].T for k in ks]

    def step(v, i, m, j, x):
        w = _products(v, i, m, j, x)
        return w, _grams(w, places)

    for _ in range(rounds):
        y, grams = f.sums(np.vstack(each), step, width, sum(k * k for k in ks))
        for c, gram in enumerate(_squares(grams, ks)):
            values, turn = np.linalg.eigh(gram)
            order = np.argsort(-values)
            each[c] = np.linalg.qr((turn[:, order].T @ y[places[c]]).T)[0].T

    def parts(v, i, m, j, x):
        u = _products(v, i, m, j, x)
        return u, np.concatenate([(np.maximum(u, 0) ** 2).sum(1), (np.minimum(u, 0) ** 2).sum(1)])

    _, squares = f.sums(np.vstack(each), parts, 0, 2 * width)
    out = []
    for v, p in zip(each, places):
        up, down = np.sqrt(squares[:width][p]), np.sqrt(squares[width:][p])
        h = np.zeros(v.shape)
        for i in range(len(v)):
            plus, minus = np.maximum(v[i], 0), np.maximum(-v[i], 0)
            a, b = up[i] * np.linalg.norm(plus), down[i] * np.linalg.norm(minus)
            part, weight = (plus, a) if a >= b else (minus, b)
            h[i] = np.sqrt(weight) * part / max(np.linalg.norm(part), 1e-12)
        mean = max(float(h.mean()), 1e-9)
        out.append(np.where(h > 1e-9, h, mean))
    return out


def _weights(b: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """(factors, documents): nonnegative weights from the factors' products with the documents and with each other."""
    w = np.full(b.shape, 1.0 / len(b))
    for _ in range(30):
        w = w * b / np.maximum(gram @ w, 1e-12)
    return w


def factorise(cells: DataFrame, doc: str, term: str, value: str, k: int, rounds: int = 15, start: str = "singular", seed: int = 1) -> tuple[DataFrame, np.ndarray, list[str]]:
    """(document weights, term factors, terms) of a nonnegative factorisation by alternating multiplicative updates, from the
    singular vectors or from a `random` start.

    Documents stay distributed; the factors of the bounded vocabulary are broadcast, and each round sends back two matrices
    of that size. A document's weights are solved from its own cells.
    """
    f = Factors(cells, doc, term, value)
    h = factorise_each(f, [k], rounds, start, seed)[0]
    return _solved(f, h), h, f.terms


def factorise_each(f: Factors, ks: Sequence[int], rounds: int = 15, start: str = "singular", seed: int = 1) -> list[np.ndarray]:
    """The term factors of `factorise` for several numbers of factors; a round of all of them is one pass over the documents."""
    ks = [min(k, len(f.terms)) for k in ks]
    places = _places(ks)
    hs = singular_starts(f, ks) if start == "singular" else [np.random.default_rng(seed).random((k, len(f.terms))) + 0.1 for k in ks]

    def update(given, i, m, j, v):
        base, grams = given
        b = _products(base, i, m, j, v)
        w = np.vstack([_weights(b[p], g) for p, g in zip(places, grams)])
        return w, _grams(w, places)

    for _ in range(rounds):
        num, wtw = f.sums((np.vstack(hs), [h @ h.T for h in hs]), update, sum(ks), sum(k * k for k in ks))
        hs = [h * num[p] / np.maximum(g @ h, 1e-12) for h, p, g in zip(hs, places, _squares(wtw, ks))]
        hs = [h / np.maximum(h.sum(1, keepdims=True), 1e-12) for h in hs]
    return hs


def _solved(f: Factors, h: np.ndarray) -> DataFrame:
    handle = f.spark.sparkContext.broadcast((h, h @ h.T))
    doc = f.doc

    def solve(batches):
        import pyarrow as pa

        for b in batches:
            base, gram = handle.value
            i, j, v = _cells(b)
            w = _weights(_products(base, i, b.num_rows, j, v), gram)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(base), pa.int32()), pa.array(w.T.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(doc), lists], [doc, "weights"])

    return f.rows.mapInArrow(solve, f"`{doc}` {dict(f.rows.dtypes)[doc]}, weights array<double>")


def residual(cells: DataFrame, doc: str, term: str, value: str, h: np.ndarray, terms: Sequence[str]) -> float:
    """The norm of what the factors leave of other documents, each solved for its own weights."""
    return residuals(Factors(cells, doc, term, value, terms), [h])[0]


def residuals(f: Factors, hs: Sequence[np.ndarray]) -> list[float]:
    """The same for the factors of several models in one pass."""
    places = _places([len(h) for h in hs])

    def left(given, i, m, j, v):
        base, grams = given
        b = _products(base, i, m, j, v)
        w = [_weights(b[p], g) for p, g in zip(places, grams)]
        return b, np.array([v @ v - 2 * (x * b[p]).sum() + (x * (g @ x)).sum() for x, p, g in zip(w, places, grams)])

    _, rest = f.sums((np.vstack(hs), [h @ h.T for h in hs]), left, 0, len(hs))
    return [float(np.sqrt(max(x, 0.0))) for x in rest]


def lda(docs: DataFrame, k: int, rounds: int = 25, seed: int = 1):
    """A latent Dirichlet allocation model by variational updates over all documents at a time, and its log perplexity."""
    # the whole collection is the batch, and a decay of nearly zero lets each update replace the last
    model = LDA(k=k, maxIter=rounds, seed=seed, optimizer="online", subsamplingRate=1.0, learningDecay=1e-6, learningOffset=1.0).fit(docs)
    return model, model.logPerplexity(docs)


def top_terms(factors: np.ndarray, terms: Sequence[str], n: int = 8) -> list[list[str]]:
    """The heaviest terms of each topic, ties in the order of the terms."""
    return [[terms[j] for j in sorted(range(len(terms)), key=lambda j: (-row[j], terms[j]))[:n]] for row in factors]


def topic_name(terms: Sequence[str], n: int = 3) -> str:
    """The first terms of a topic that aren't part of one another."""
    out: list[str] = []
    for t in terms:
        if len(out) < n and not any(t in o or o in t for o in out):
            out.append(t)
    return " / ".join(out)


def cophenetic(labels: Sequence[Sequence], sizes: Sequence[int]) -> float:
    """Correlation of the consensus distances of all documents with those of their average-linkage tree.

    `labels` are the different rows of topics that documents got over the runs (None where a document was left out), `sizes`
    how many documents have each row; these are equal to each other in every run, so that the tree begins with them.
    """
    x = np.array([[-1 if v is None else v for v in row] for row in labels])
    m = np.array(sizes, float)
    n = len(x)
    there = x >= 0
    runs = (there[:, None] & there[None]).sum(-1)
    same = ((x[:, None] == x[None]) & there[:, None] & there[None]).sum(-1)
    d = 1 - np.divide(same, runs, out=np.zeros_like(same, float), where=runs > 0)
    np.fill_diagonal(d, np.where(there.any(1), 0.0, 1.0))
    height, far = np.zeros((n, n)), d.copy()
    np.fill_diagonal(far, np.inf)
    weight, members, alive = m.copy(), [[i] for i in range(n)], np.ones(n, bool)
    for _ in range(n - 1):
        i, j = sorted(np.unravel_index(np.argmin(far), far.shape))
        for a in members[i]:
            height[a, members[j]] = far[i, j]
            height[members[j], a] = far[i, j]
        far[i] = (weight[i] * far[i] + weight[j] * far[j]) / (weight[i] + weight[j])
        far[:, i] = far[i]
        far[i, i], alive[j] = np.inf, False
        far[j], far[:, j] = np.inf, np.inf
        weight[i] += weight[j]
        members[i] += members[j]
    np.fill_diagonal(height, np.diag(d))
    w = np.outer(m, m) / 2
    np.fill_diagonal(w, m * (m - 1) / 2)
    w = w / max(w.sum(), 1e-12)
    dx, dy = d - (w * d).sum(), height - (w * height).sum()
    spread = np.sqrt((w * dx * dx).sum() * (w * dy * dy).sum())
    return 1.0 if spread < 1e-12 else float((w * dx * dy).sum() / spread)
