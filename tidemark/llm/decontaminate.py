"""Benchmark decontamination by latent semantic retrieval.

1. Passages are runs of ``PASSAGE`` words. Terms are the benchmark's words; their passage frequencies, over all
   documents, give TF-IDF weights. A term in more than ``STOP`` of the passages (and more than ``STOP_LEAST``) is a stop
   term of weight 0, unless its item has too few others.
2. Distributed randomised SVD in one pass: each task sends A' (A W) of its passages, A being its TF-IDF rows and W a
   random matrix of ``SKETCH`` columns. Partial results are summed in a tree of bounded fan-in; the right singular
   vectors of A follow from the sum and W (Nystrom), the leading ``RANK`` are kept. Terms beyond ``FEATURES`` share
   features by their number.
3. Search: windows over each whole document, of lengths and strides that hold every item in some window, are
   projected by the basis. A window is a candidate for an item when the cosine and the covered share of the item's
   latent vector pass. Windows whose terms weigh too little to cover an item aren't projected. What the basis doesn't
   show of an item's words, their sequence does: runs of ``GRAM`` of an item's words (its rarest runs among the items,
   or all that at most ``SHARED`` items hold) are candidates too, so an item that stands verbatim is always one.
4. Check: longest common subsequence of the candidate region and the item, in words and in weight. This accepts
   paraphrases that change, drop or add some words, and passages cut or re-worded at either end. A weak likeness, of
   less than ``CLOSE`` of the words and without a run of ``LCS`` of them (``RUN`` at least), must hold the answer too,
   taken to be the item's last words.
5. Items of fewer than ``LEAST`` words have no passage to speak of: they match where their words stand consecutively.

The benchmark is taken in blocks of bounded text, each with a basis of its own; ``GROUP`` blocks share the passes over the
documents, so what travels to the executors is bounded whatever the benchmark's size.

Memory: an item's subsequence is traced over bit rows, of which only about twice the square root of its region's words
are kept, and windows of long items are projected a few at a time; an item of 20,000 words takes some ten megabytes and
a second for each region.

Defined cases: null or empty texts and wordless items match nothing; null and repeated ids are judged by their text;
equal texts get equal answers; items with equal words are both reported; empty tables give empty results (an empty
benchmark keeps all documents); other columns pass through the filter.
"""

from math import isqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import ALNUM, Vocabulary, WordHasher, mix, slices, texts_of

PASSAGE, STOP, STOP_LEAST, LEAST, RANK, SKETCH, FEATURES, FAN_IN = 32, 0.002, 50, 5, 64, 80, 1 << 14, 8
COSINE, COVERED, LCS, LCS_WEIGHT, ANSWER, CLOSE, RUN = 0.5, 0.5, 0.6, 0.6, 0.5, 0.8, 10
BLOCK_BYTES, GROUP, GRAM, SHARED = 4 << 20, 8, 8, 16


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    out = hashes
    for k in range(1, n):
        out = mix(out[:-1] * np.uint64(0x9FB21C651E98DF25) + hashes[k:]) if len(out) > 1 else out[:0]
    return out


class Places:
    """Where runs of words stand: ``add`` (run, place) pairs, then ``find`` gives (index, place) of known runs."""

    def __init__(self, runs: np.ndarray, places: list):
        order = np.argsort(runs, kind="stable")
        self.table, first = np.unique(runs[order], return_index=True)
        self.first = np.append(first, len(runs))
        self.places = [places[k] for k in order.tolist()]

    def find(self, runs: np.ndarray):
        if not len(self.table):
            return
        at = np.minimum(np.searchsorted(self.table, runs), len(self.table) - 1)
        for i in np.flatnonzero(self.table[at] == runs).tolist():
            for k in range(self.first[at[i]], self.first[at[i] + 1]):
                yield i, self.places[k]


class Items:
    """The words of a block of benchmark items."""

    def __init__(self, rows: list[tuple]):
        hasher = WordHasher(ALNUM)
        words = [(i, hasher.words((t or "").encode())[2]) for i, t in rows]
        self.short = {}
        for n in range(1, LEAST):
            own = [(i, w) for i, w in words if len(w) == n]
            if own:
                self.short[n] = Places(np.concatenate([runs_of(w, n) for _, w in own]), [i for i, _ in own])
        words = [(i, w) for i, w in words if len(w) >= LEAST]
        self.ids = [i for i, _ in words]
        self.hashes = [w for _, w in words]
        self.vocabulary = Vocabulary(np.concatenate([*self.hashes, np.zeros(0, np.uint64)]))
        self.words = [self.vocabulary.tokens(w) for w in self.hashes]

    def runs(self) -> dict[int, Places]:
        """By run length: the (item, word) places of the runs that make an item a candidate."""
        out = {}
        for n in range(LEAST, GRAM + 1):
            own = [k for k, w in enumerate(self.hashes) if min(len(w), GRAM) == n]
            grams = [runs_of(self.hashes[k], n) for k in own]
            held = [np.unique(g) for g in grams]
            known, holders = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            runs, places = [], []
            for k, g in zip(own, grams, strict=True):
                count = holders[np.searchsorted(known, g)]
                use = np.flatnonzero(count <= max(SHARED, count.min()))
                runs.append(g[use])
                places += [(k, j) for j in use.tolist()]
            if own:
                out[n] = Places(np.concatenate(runs), places)
        return out


def passages(tokens: np.ndarray, bounds: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct (passage, term) of a run of documents, sorted, and the number of passages."""
    sizes = -(-np.diff(bounds) // PASSAGE)
    first = np.concatenate([[0], np.cumsum(sizes)])
    hit = np.flatnonzero(tokens < terms)
    doc = np.searchsorted(bounds, hit, side="right") - 1
    pair = np.unique((first[doc] + (hit - bounds[doc]) // PASSAGE) * np.int64(terms) + tokens[hit])
    return pair // terms, pair % terms, int(first[-1])


def frequencies(shared):
    """Passage frequencies of each block's terms, each followed by the number of passages."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        blocks, hasher = [Items(rows).vocabulary for rows in shared.value], WordHasher(ALNUM)
        totals = [np.zeros(len(v) + 1) for v in blocks]
        for batch in slices(batches):
            for _, hashes, bounds in hasher.documents(texts_of(batch)):
                for vocabulary, total in zip(blocks, totals, strict=True):
                    _, terms, n = passages(vocabulary.tokens(hashes), bounds, len(vocabulary))
                    total[:-1] += np.bincount(terms, minlength=len(vocabulary))
                    total[-1] += n
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.concatenate(totals).tobytes()], pa.binary())], ["part", "payload"])

    return run


def group_sums(values: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows by sorted key."""
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.add.reduceat(values, at, axis=0)


def add_product(total: np.ndarray, vocabulary: Vocabulary, weight: np.ndarray, basis: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> None:
    passage, term, _ = passages(vocabulary.tokens(hashes), bounds, len(vocabulary))
    use = weight[term] > 0
    passage, term = passage[use], term[use]
    if not len(term):
        return
    value, feature = weight[term].astype(np.float32)[:, None], term % len(basis)
    which, rows = group_sums(value * basis[feature], passage)
    back = value * rows[np.searchsorted(which, passage)]
    order = np.argsort(feature, kind="stable")
    features, sums = group_sums(back[order], feature[order])
    total[features] += sums


def gram_product(shared, models):
    """A' (A W) over a task's passages, of each block."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        blocks, hasher = [(Items(rows).vocabulary, *model) for rows, model in zip(shared.value, models.value, strict=True)], WordHasher(ALNUM)
        totals = [np.zeros(basis.shape, dtype=np.float64) for _, _, basis in blocks]
        for batch in slices(batches):
            for _, hashes, bounds in hasher.documents(texts_of(batch)):
                for total, block in zip(totals, blocks, strict=True):
                    add_product(total, *block, hashes, bounds)
        payload = np.concatenate([t.ravel() for t in totals]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([payload], pa.binary())], ["part", "payload"])

    return run


def tree_sum(partial: DataFrame, parts: int) -> np.ndarray:
    """Sum of the payloads (float64), each task adding at most a few of them."""

    def add(pdf):
        import pandas as pd

        total = np.frombuffer(pdf["payload"].iloc[0]).copy()
        for x in pdf["payload"].iloc[1:]:
            total += np.frombuffer(x)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "payload": [total.tobytes()]})

    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        partial = partial.groupBy((F.col("part") % parts).alias("to")).applyInPandas(add, "part bigint, payload binary").withColumn("part", F.col("part") % parts)
    total = None
    for row in partial.select("payload").collect():  # at most FAN_IN rows
        x = np.frombuffer(row[0])
        total = x.copy() if total is None else total + x
    return total


def term_weights(items: Items, frequency: np.ndarray, n: float) -> np.ndarray:
    """Smooth inverse passage frequencies, 0 for stop terms."""
    weight = np.log((1 + n) / (1 + frequency)) + 1
    stop = frequency > max(STOP * n, STOP_LEAST)
    for words in items.words:
        own = np.unique(words)
        if (~stop[own]).sum() < 3:
            stop[own] = False
    return np.where(stop, 0.0, weight)


def leading_vectors(sketch: np.ndarray, test: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of a positive semidefinite G from sketch = G test."""
    shift = np.finfo(float).eps * np.linalg.norm(sketch)
    shifted = sketch + shift * test
    core = test.T @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 0) * 1e-12
    root = vectors[:, good] / np.sqrt(values[good])
    return np.linalg.svd(shifted @ root, full_matrices=False)[0][:, :rank]


def fit(docs: DataFrame, blocks: list[Items], shared, rank: int = RANK, sketch: int = SKETCH) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weight of each term, features x rank basis) of each block, in two passes over the documents."""
    spark = docs.sparkSession
    parts = docs.rdd.getNumPartitions()
    sizes = [len(b.vocabulary) for b in blocks]
    total = tree_sum(docs.mapInArrow(frequencies(shared), "part bigint, payload binary"), parts)
    total = np.zeros(sum(sizes) + len(sizes)) if total is None else total
    weights, tests = [], []
    for own, block in zip(np.split(total, np.cumsum([n + 1 for n in sizes])[:-1]), blocks, strict=True):
        weights.append(term_weights(block, own[:-1], own[-1]))
        features = min(len(own) - 1, FEATURES)
        tests.append(np.random.default_rng(3).standard_normal((features, min(sketch, features))).astype(np.float32))
    models = spark.sparkContext.broadcast(list(zip(weights, tests, strict=True)))  # at most GROUP x (BLOCK_BYTES of terms, FEATURES x SKETCH)
    product = tree_sum(docs.mapInArrow(gram_product(shared, models), "part bigint, payload binary"), parts)
    models.unpersist()
    out = []
    for k, (weight, test) in enumerate(zip(weights, tests, strict=True)):
        at = sum(t.size for t in tests[:k])
        own = None if product is None else product[at : at + test.size].reshape(test.shape)
        if not test.size:
            basis = np.zeros((1, 1))
        elif own is None or not own.any():
            basis = np.linalg.qr(test)[0][:, :rank]
        else:
            basis = leading_vectors(own, test.astype(np.float64), min(rank, len(test)))
        out.append((weight, basis.astype(np.float32)))
    return out


def bit_rows(x: list, y: list, row: int):
    """Yields, after each element of x, the bits at which the row of subsequence lengths doesn't rise."""
    where: dict = {}
    for j, b in enumerate(y):
        where[b] = where.get(b, 0) | (1 << j)
    full = (1 << len(y)) - 1
    for a in x:
        m = where.get(a, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
        yield row


def lcs_pairs(x: list, y: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence. Every isqrt(len(x))-th bit row is kept, the rows between are made
    again when the trace reaches them."""
    full, step = (1 << len(y)) - 1, isqrt(len(x)) + 1
    kept = [full]
    for i, row in enumerate(bit_rows(x, y, full), 1):
        if i % step == 0:
            kept.append(row)
    i, j, out = len(x), len(y), []
    rows: list = []
    base = len(x) + 1
    while i and j:
        if i - 1 < base:  # the rows base .. i, row base being kept
            base = (i - 1) // step * step
            rows = [kept[base // step], *bit_rows(x[base:i], y, kept[base // step])]
        if rows[i - base] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 1 - base] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def lcs_length(x: list, y: list) -> int:
    """Bit-parallel: one big-integer step per element of x."""
    row = (1 << len(y)) - 1
    for row in bit_rows(x, y, row):  # noqa: B007  the last one counts
        pass
    return len(y) - row.bit_count()


def longest_run(pairs: list[tuple[int, int]]) -> int:
    """Length of the longest run of pairs that are neighbours in both."""
    best = now = 0
    for k, (i, j) in enumerate(pairs):
        now = now + 1 if k and pairs[k - 1] == (i - 1, j - 1) else 1
        best = max(best, now)
    return best


class Searcher:
    """Finds the items of one block."""

    def __init__(self, items: Items, weight: np.ndarray, basis: np.ndarray):
        self.items, self.basis, self.runs = items, basis, items.runs()
        self.vocabulary = items.vocabulary
        self.weight = np.append(weight, 0.0)
        self.answer = [max(3, len(w) // 6) for w in items.words]
        vectors = np.array([self.latent(np.unique(w)) for w in items.words], dtype=np.float32).reshape(len(items.words), basis.shape[1])
        weights = np.array([self.weight[np.unique(w)].sum() for w in items.words])
        self.weights = [self.weight[w].sum() for w in items.words]
        norms = np.linalg.norm(vectors, axis=1)
        lengths = np.array([len(w) for w in items.words])
        self.classes, low = [], 0
        while len(lengths) and low < lengths.max():
            least = lengths[lengths > low].min()
            high = int(least * 1.3)
            left = np.flatnonzero((lengths > low) & (lengths <= high) & (norms > 0))
            low = high
            size = int(np.ceil(high * 1.25)) + 1
            strata = []
            while len(left):  # items of about equal weight share a threshold
                light = weights[left].min()
                which, left = left[weights[left] <= 1.5 * light], left[weights[left] > 1.5 * light]
                strata.append((light * COVERED, which, vectors[which].T, norms[which]))
            if strata:
                self.classes.append((size, max(1, size // 5), strata))

    def latent(self, terms: np.ndarray) -> np.ndarray:
        return (self.weight[terms][:, None] * self.basis[terms % len(self.basis)]).sum(axis=0)

    def windows(self, tokens: np.ndarray, bounds: np.ndarray):
        """Candidates (first word, end, item) in a run of documents."""
        total = np.concatenate([[0.0], np.cumsum(self.weight[tokens])])
        sizes = np.diff(bounds)
        for size, stride, strata in self.classes:
            each = -(-sizes // stride)
            doc = np.repeat(np.arange(len(sizes)), each)
            at = bounds[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)) * stride
            end = np.minimum(at + size, bounds[doc + 1])
            held = total[end] - total[at]
            for least, which, vectors, norms in strata:
                heavy = np.flatnonzero(held >= least)
                step = max(1, min(1024, (1 << 19) // size))
                for k in range(0, len(heavy), step):
                    a, b = at[heavy[k : k + step]], end[heavy[k : k + step]]
                    x = self.project(tokens, a, b, size)
                    dot = x @ vectors
                    length = np.maximum(np.linalg.norm(x, axis=1), 1e-9)
                    for r, c in zip(*np.nonzero((dot >= COSINE * length[:, None] * norms) & (dot >= COVERED * norms**2)), strict=True):
                        yield int(a[r]), int(b[r]), int(which[c]), float(dot[r, c] / (length[r] * norms[c]))

    def project(self, tokens: np.ndarray, at: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
        """Latent vectors of windows; a term counts once in each."""
        span = at[:, None] + np.arange(size)
        t = np.where(span < end[:, None], tokens[np.minimum(span, len(tokens) - 1)], len(self.vocabulary))
        rows, cols = np.nonzero(self.weight[t])
        pair = np.unique(rows * np.int64(len(self.weight)) + t[rows, cols])
        rows, terms = pair // len(self.weight), pair % len(self.weight)
        x = np.zeros((len(at), self.basis.shape[1]), dtype=np.float32)
        if len(rows):
            which, sums = group_sums(self.weight[terms].astype(np.float32)[:, None] * self.basis[terms % len(self.basis)], rows)
            x[which] = sums
        return x

    def check(self, words: list, item: int) -> tuple | None:
        """(first, last, share of words, share of weight, share of the answer) if words holds the item."""
        own = self.items.words[item].tolist()
        if lcs_length(words, own) < LCS * len(own):
            return None
        pairs = lcs_pairs(words, own)
        weight = sum(self.weight[own[j]] for _, j in pairs) / max(self.weights[item], 1e-9)
        answer = sum(j >= len(own) - self.answer[item] for _, j in pairs) / self.answer[item]
        sure = answer >= ANSWER or len(pairs) >= CLOSE * len(own) or longest_run(pairs) >= max(RUN, LCS * len(own))
        return (pairs[0][0], pairs[-1][0], len(pairs) / len(own), weight, answer) if weight >= LCS_WEIGHT and sure else None

    def candidates(self, tokens: np.ndarray, hashes: np.ndarray, bounds: np.ndarray):
        """(document, item, first word, end, cosine) of the regions to check."""
        for a, b, item, cosine in self.windows(tokens, bounds):
            yield int(np.searchsorted(bounds, a, side="right")) - 1, item, a, b, cosine
        for n, known in self.runs.items():
            for i, (item, j) in known.find(runs_of(hashes, n)):
                d = int(np.searchsorted(bounds, i, side="right")) - 1
                if i + n <= bounds[d + 1]:
                    yield d, item, i - j, i - j + len(self.items.words[item]), 1.0

    def search(self, hashes: np.ndarray, bounds: np.ndarray) -> list[list[tuple]]:
        """(item id, first word, last word, cosine, words, weight, answer) of each text's hits, one per item."""
        tokens = self.vocabulary.tokens(hashes)
        found: list[list[tuple]] = [[] for _ in range(len(bounds) - 1)]
        regions: dict = {}
        for d, item, a, b, cosine in self.candidates(tokens, hashes, bounds):
            reach = len(self.items.words[item]) // 4 + 1
            regions.setdefault((d, item), []).append((max(int(bounds[d]), a - reach), min(int(bounds[d + 1]), b + reach), cosine))
        for (d, item), raw in sorted(regions.items()):
            spans, most = [], 4 * len(self.items.words[item])
            for a, b, cosine in sorted(raw):
                if spans and a <= spans[-1][1] and (b <= spans[-1][1] or b - spans[-1][0] <= most):
                    spans[-1][1], spans[-1][2] = max(b, spans[-1][1]), max(cosine, spans[-1][2])
                else:
                    spans.append([a, b, cosine])
            hits = [(s, h) for s in spans if (h := self.check(tokens[s[0] : s[1]].tolist(), item))]
            if hits:
                s, h = max(hits, key=lambda x: x[1][2])
                base = s[0] - int(bounds[d])
                found[d].append((self.items.ids[item], base + h[0], base + h[1], s[2], *h[2:]))
        for n, known in self.items.short.items():
            first: dict = {}
            for i, item in known.find(runs_of(hashes, n)):
                d = int(np.searchsorted(bounds, i, side="right")) - 1
                if i + n <= bounds[d + 1]:
                    first.setdefault((d, item), i - int(bounds[d]))
            for (d, item), at in first.items():
                found[d].append((item, at, at + n - 1, 1.0, 1.0, 1.0, 1.0))
        return found


class Searchers:
    """All blocks of a group over the same words."""

    def __init__(self, blocks: list, models: list):
        self.hasher = WordHasher(ALNUM)
        self.blocks = [Searcher(Items(rows), *model) for rows, model in zip(blocks, models, strict=True)]

    def search(self, texts: list) -> list[list[tuple]]:
        out: list[list[tuple]] = []
        for _, hashes, bounds in self.hasher.documents(texts):
            own = [b.search(hashes, bounds) for b in self.blocks]
            out += [[h for hits in each for h in hits] for each in zip(*own, strict=True)]
        return out


SCHEMA = "doc_id bigint, item_id bigint, first_word bigint, last_word bigint, cosine double, lcs_share double, weight_share double, answer_share double"


def pair_finder(items, model):
    def run(batches):
        import pyarrow as pa

        searcher = Searchers(items.value, model.value)
        kinds = [pa.int64()] * 3 + [pa.float64()] * 4
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in slices(batches):
            hits = searcher.search(texts_of(batch))
            rows = [i for i, h in enumerate(hits) for _ in h]
            flat = [h for own in hits for h in own]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array([h[k] for h in flat], kind) for k, kind in enumerate(kinds))], names)

    return run


def clean_filter(items, model, text_col: str):
    def run(batches):
        import pyarrow as pa

        searcher = Searchers(items.value, model.value)
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array([not h for h in searcher.search(texts_of(batch, text_col))], pa.bool_()))

    return run


def searches(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str = "item_id"):
    """Broadcast (rows, models) of each group of blocks of the benchmark, fitted on all documents."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    bench = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), "text")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    bench = bench.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for k in range(0, blocks, GROUP):
        group: dict = {}
        for row in bench.where(F.col("block").between(k, min(k + GROUP, blocks) - 1)).collect():  # about GROUP x BLOCK_BYTES
            group.setdefault(row["block"], []).append((row["item_id"], row["text"]))
        rows = [sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")) for _, own in sorted(group.items())]
        items = [Items(own) for own in rows]
        if any(b.ids or b.short for b in items):
            shared = spark.sparkContext.broadcast(rows)
            yield shared, spark.sparkContext.broadcast(fit(texts, items, shared))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and benchmark item that it holds."""
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    for items, model in searches(docs, benchmark, text_col):
        out = out.unionByName(rows.mapInArrow(pair_finder(items, model), SCHEMA))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, all columns, no shuffle."""
    for items, model in searches(docs, benchmark, text_col):
        docs = docs.mapInArrow(clean_filter(items, model, text_col), docs.schema)
    return docs


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
