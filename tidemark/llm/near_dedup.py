"""MinHash near-dedup with sequential Bayesian verification.

1. Each text becomes its set of distinct word shingles (64-bit), a signature of ``bands`` x ``rows`` MinHashes and
   the bands' keys. Equal sets collapse to one representative before anything else, so copies never meet.
2. Representatives that share a band are candidates. Each bucket links its members to its least member: as many
   pairs as members, not their square.
3. Pairs are compared in batches of signature rows. After each batch the posterior of their similarity (uniform
   prior) decides: a pair is doubtful once its chance of reaching the threshold is below ``miss``; the others are
   verified on their full sets. Doubtful pairs go only if sizes or parity sketches of their sets rule a link out, which
   is exact; else they are verified too.
4. Components of verified links. In buckets that still hold several components, the members outside the largest
   are compared with all members, in blocks of bounded size, again by signature, the doubtful last by sketches, and then
   by full sets; so links that the bucket's least member doesn't have are found too. Members of buckets with more than
   ``LARGE`` members outside their largest component (pages of one template) meet where they share a rare shingle
   instead, which is exact. Components again.

Rare shingles (``_rare_links``): shingles are put into one order, the rarest first, by counts in ``SLOTS`` slots; links
are the same in any order. A set of n shingles whose partner is no larger has a link only if the first
n - ceil(t n) + 1 of its shingles hold one of the partner's first m - ceil(2 t m / (1 + t)) + 1. Such pairs, of different
components, go if parity sketches of their sets differ in more bits than a link allows; the others are verified. What
a template holds in common comes last in that order, so pages meet by what is their own; no pair with a link is left out.

Misses: a pair at the threshold shares no band with probability (1 - t**rows)**bands, 6e-5 for 0.8, 6 and 32, which falls
fast above it. No pair that shares a band is left out: ``miss`` and the signatures only order the work.

Defined cases: null or wordless texts have an empty set, link with nothing and are kept; a text with fewer words
than a shingle has one shingle; rows that repeat an id are judged each by its own text, and ``one_of_each`` keeps one row
of each component, so two rows of one id with unlike texts both stay; a row without an id is in no link (its component
is null, it is kept); an empty table gives an empty result; other columns aren't read.
"""

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._runtime import materialize
from ._words import BLANK_SPLIT, WordHasher, mix, slices, texts_of

BANDS, ROWS, BATCH, MISS, BLOCK, LARGE = 32, 6, 32, 1e-4, 256, 4096
#: Counters that order shingles by how rare they are, and the least and most bits of a set's parity sketch.
SLOTS, SKETCH, MOST_SKETCH = 1 << 20, 1 << 10, 1 << 16


def shingle_sets(texts: list, size: int, hasher: WordHasher):
    """Sorted distinct shingles (uint64) of each text."""
    for _, hashes, bounds in hasher.documents(texts):
        grams = hashes
        for k in range(1, size):
            grams = mix(grams[:-1] * np.uint64(0x9FB21C651E98DF25) + hashes[k:]) if len(grams) > 1 else grams[:0]
        for i in range(len(bounds) - 1):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                yield mix(np.uint64(b - a) + (hashes[a:b] * np.arange(3, 3 + 2 * (b - a), 2, dtype=np.uint64)).sum(keepdims=True))
            else:
                yield hashes[:0]


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minhash(grams: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1024) -> np.ndarray:
    low = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(grams), step):
        h = (grams[at : at + step] >> np.uint64(32)).astype(np.uint32)
        x = np.multiply(h[:, None], a[None, :])
        x += b
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(low, x.min(axis=0), out=low)
    return low


def least_matches(threshold: float, total: int, batch: int, miss: float) -> list[tuple[int, int]]:
    """(rows compared, least matches to go on): with m of n rows equal and a uniform prior the similarity is
    Beta(m + 1, n - m + 1), whose tail above t is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in [*range(batch, total, batch), total]:
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(x: np.ndarray, y: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the pairs of signature rows that no batch rejects."""
    alive, same, at = np.arange(len(x)), np.zeros(len(x), dtype=np.int32), 0
    for n, least in steps:
        same[alive] += (x[alive, at:n] == y[alive, at:n]).sum(axis=1, dtype=np.int32)
        alive, at = alive[same[alive] >= least], n
    return alive


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct arrays."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large) or not len(small):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def signer(size: int, bands: int, rows: int):
    def run(batches):
        import pyarrow as pa

        hasher, (a, b) = WordHasher(BLANK_SPLIT), permutations(bands * rows)
        spread = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in slices(batches):
            n, k1, k2, sigs = [], [], [], []
            for grams in shingle_sets(texts_of(batch), size, hasher):
                n.append(len(grams))
                k1.append(mix(grams).sum(dtype=np.uint64))
                k2.append(mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                sigs.append(minhash(grams, a, b))
            sigs = np.array(sigs, dtype=np.uint32).reshape(len(n), bands * rows)
            keys = mix((mix(sigs.astype(np.uint64).reshape(-1, bands, rows) * spread)).sum(axis=2, dtype=np.uint64) + salt)
            keep = [x > 0 for x in n]
            short = (sigs & np.uint32(0xFFFF)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(np.array(k1, dtype=np.uint64).view(np.int64)), pa.array(np.array(k2, dtype=np.uint64).view(np.int64)),
                    pa.array([r if k else None for r, k in zip(list(keys.view(np.int64)), keep, strict=True)], pa.list_(pa.int64())),
                    pa.array([r.tobytes() if k else None for r, k in zip(short, keep, strict=True)], pa.binary()),
                ],
                ["doc_id", "mark", "n_shingles", "k1", "k2", "keys", "sig"],
            )

    return run


def set_maker(size: int):
    """Sets of the texts; of equal rows that meet in a task the first only."""

    def run(batches):
        import pyarrow as pa

        hasher, seen = WordHasher(BLANK_SPLIT), set()
        for batch in slices(batches):
            repeated = [k for k, rows in enumerate(batch.column("rows").to_pylist()) if rows > 1]
            if repeated:
                nodes, drop = batch.column("node").to_pylist(), set()
                for k in repeated:
                    if nodes[k] in seen:
                        drop.add(k)
                    seen.add(nodes[k])
                batch = batch.take(pa.array([k for k in range(batch.num_rows) if k not in drop], pa.int64()))
            sets = [g.tobytes() for g in shingle_sets(texts_of(batch), size, hasher)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("rows"), pa.array(sets, pa.binary())], ["node", "rows", "grams"])

    return run


def pruner(steps: list[tuple[int, int]]):
    """Marks the pairs that no batch rejects as likely."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "sig_x"):
            total = steps[-1][0]
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, total) for c in ("sig_x", "sig_y"))
            likely = np.zeros(len(x), dtype=bool)
            likely[survivors(x, y, steps)] = True
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(likely)], ["x", "y", "likely"])

    return run


def verifier(percent: int):
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "grams_x"):
            pairs = zip(batch.column("grams_x").to_pylist(), batch.column("grams_y").to_pylist(), strict=True)
            good = [similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("x", "y")], ["x", "y"]).filter(pa.array(good, pa.bool_()))

    return run


def block_linker(steps: list[tuple[int, int]], percent: int):
    """Members outside a bucket's largest component against all of a block: the links that join components."""

    def run(pdf):
        import pandas as pd

        root: dict = {}

        def find(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        minor, every = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        total = steps[-1][0]
        sig_y = np.frombuffer(b"".join(every["sig"]), dtype=np.uint16).reshape(-1, total)
        ids, comps = every["node"].to_numpy(), every["comp"].to_numpy()
        grams_y = [np.frombuffer(g, dtype=np.uint64) for g in every["grams"]]
        n_y = np.array([len(g) for g in grams_y], dtype=np.int64)
        bits = sketch_bits(int(n_y.max(initial=0)))
        odd_y = np.frombuffer(b"".join(parity(g, bits) for g in grams_y), dtype=np.uint64).reshape(-1, bits // 64)
        links = []
        for node, comp, sig, grams in zip(minor["node"], minor["comp"], minor["sig"], minor["grams"], strict=True):
            x = np.frombuffer(sig, dtype=np.uint16)
            good = survivors(np.broadcast_to(x, sig_y.shape), sig_y, steps)
            good = good[np.argsort(-(sig_y[good] == x).sum(axis=1), kind="stable")]
            own = np.frombuffer(grams, dtype=np.uint64)
            apart = np.bitwise_count(odd_y ^ np.frombuffer(parity(own, bits), dtype=np.uint64)).sum(axis=1, dtype=np.int64)
            may = possible(apart, np.int64(len(own)), n_y, percent)
            likely, may[good] = good[may[good]], False
            for j in (*likely, *np.flatnonzero(may)):
                if find(comp) != find(comps[j]) and similar(own, grams_y[j], percent):
                    root[find(comp)] = find(comps[j])
                    links.append((node, ids[j]))
        return pd.DataFrame(links, columns=["x", "y"]).astype("int64")

    return run


def sketch_bits(n: int) -> int:
    return min(MOST_SKETCH, max(SKETCH, 1 << (2 * n).bit_length()))


def parity(grams: np.ndarray, bits: int) -> bytes:
    """Of each of so many slots, whether it holds an odd number of shingles. Half as many bits: both halves' XOR."""
    return np.packbits((np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def possible(apart: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, percent: int) -> np.ndarray:
    """Sets whose sketches differ in so many bits differ in as many shingles at least; False where that or their sizes rule
    a link out."""
    return (apart * (100 + percent) <= (n_x + n_y) * (100 - percent)) & (100 * np.minimum(n_x, n_y) >= percent * np.maximum(n_x, n_y))


def slot_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)


def slot_counter(batches):
    import pyarrow as pa

    total = np.zeros(SLOTS, dtype=np.int64)
    for batch in slices(batches, "grams"):
        total += np.bincount(slot_of(np.frombuffer(b"".join(batch.column("grams").to_pylist()), dtype=np.uint64)), minlength=SLOTS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])


def first_shingles(n: int, percent: int) -> tuple[int, int]:
    """How many of n ordered shingles must meet a partner's: towards partners of at most n, and of at least n."""
    return n + 1 + -percent * n // 100, n + 1 + -2 * percent * n // (100 + percent)


def rare_shingles(counts: np.ndarray, percent: int):
    """Each set's first shingles in the order of (slot's count, shingle); ``indexed``: those for partners of at least n."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "grams"):
            grams, lengths, indexed, sizes = [], [], [], []
            for raw in batch.column("grams").to_pylist():
                own = np.frombuffer(raw, dtype=np.uint64)
                probe, index = first_shingles(len(own), percent)
                grams.append(own[np.argsort(counts[slot_of(own)], kind="stable")[:probe]])  # own is sorted
                lengths.append(len(grams[-1]))
                indexed.append(np.arange(lengths[-1]) < index)
                sizes.append(len(own))
            node, comp = (np.repeat(batch.column(c).to_numpy(), lengths) for c in ("node", "comp"))
            keys = np.concatenate(grams).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, node, comp, np.repeat(sizes, lengths), np.concatenate(indexed))], ["key", "node", "comp", "n", "indexed"])

    return run


def sketcher(batches):
    import pyarrow as pa

    for batch in slices(batches, "grams"):
        sets = [np.frombuffer(raw, dtype=np.uint64) for raw in batch.column("grams").to_pylist()]
        odd = [parity(x, sketch_bits(len(x))) for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(x) for x in sets], pa.int64()), pa.array(odd, pa.binary())], ["node", "n", "odd"])


def folded(odd: bytes, size: int) -> bytes:
    while len(odd) > size:
        both = np.frombuffer(odd, dtype=np.uint8).reshape(2, -1)
        odd = (both[0] ^ both[1]).tobytes()
    return odd


def may_link(percent: int):
    """Drops the pairs that sizes or sketches rule out."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "odd_x"):
            odd_x, odd_y = (batch.column(c).to_pylist() for c in ("odd_x", "odd_y"))
            sizes = np.array([min(len(x), len(y)) for x, y in zip(odd_x, odd_y, strict=True)])
            apart = np.zeros(len(sizes), dtype=np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                x, y = (np.frombuffer(b"".join(folded(odd[k], size) for k in at), dtype=np.uint64).reshape(len(at), -1) for odd in (odd_x, odd_y))
                apart[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            good = possible(apart, batch.column("n_x").to_numpy(), batch.column("n_y").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("x", "y")], ["x", "y"]).filter(pa.array(good))

    return run


def _both(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """pairs: (x, y); of: (node, ...). Adds the other columns of both nodes, named with _x and _y."""
    for side in "xy":
        pairs = pairs.join(of.withColumnsRenamed({c: side if c == "node" else f"{c}_{side}" for c in of.columns}), side)
    return pairs


def _exact_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that are links, by sketches and then by full sets."""
    sketches = materialize(sets.select("node", "grams").mapInArrow(sketcher, "node bigint, n bigint, odd binary"), "sketches")
    left = materialize(_both(pairs, sketches).mapInArrow(may_link(percent), "x bigint, y bigint"), "possible")
    return materialize(_both(left, sets.select("node", "grams")).mapInArrow(verifier(percent), "x bigint, y bigint"), "exact-links")


def _rare_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members: (node, comp). (x, y): every link between members of different components."""
    held = materialize(members.join(sets, "node"), "crowded")
    slots = held.select("grams").mapInArrow(slot_counter, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, dtype=np.int64)
    counts[slots["slot"].to_numpy()] = slots["n"].to_numpy()
    rare = materialize(held.mapInArrow(rare_shingles(counts, percent), "key bigint, node bigint, comp bigint, n bigint, indexed boolean"), "rare")
    # written first, so that both sides of the join are plain exchanges and a frequent shingle's rows can be split
    met = materialize(rare.join(materialize(_mixed(rare).select("key", "main"), "rare-mixed"), "key").withColumn("minor", F.col("comp") != F.col("main")).drop("main"), "rare-met")
    named = lambda s: met.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "comp", "n", "indexed", "minor")))
    # x the smaller set; most rows of a frequent shingle are not indexed, so they don't meet each other
    smaller = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("node_x") < F.col("node_y")))
    fits = smaller & (100 * F.col("n_x") >= percent * F.col("n_y")) & (F.col("comp_x") != F.col("comp_y")) & (F.col("minor_x") | F.col("minor_y"))
    pairs = named("x").where("indexed_x").join(named("y"), "key").where(fits)
    return _exact_links(materialize(pairs.select(F.col("node_x").alias("x"), F.col("node_y").alias("y")).distinct(), "rare-pairs"), held, percent)


def _mixed(members: DataFrame) -> DataFrame:
    """members: (key, node, comp). The keys that hold several components: (key, main, all, most), main the largest."""
    parts = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    counts = [F.count(F.lit(1)).alias("comps"), F.sum("n").alias("all"), F.max("n").alias("most")]
    return parts.groupBy("key").agg(*counts, F.max_by("comp", F.struct("n", "comp")).alias("main")).where("comps > 1").drop("comps")


def _block_tasks(members: DataFrame, mixed: DataFrame, block: int) -> DataFrame:
    """Members outside the main component (side 0) and all members (side 1), dealt to blocks (key, i, j)."""
    sized = mixed.select("key", "main", F.ceil((F.col("all") - F.col("most")) / block).alias("rows"), F.ceil(F.col("all") / block).alias("cols"))
    inside = members.join(sized, "key")
    spot = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    minor = inside.where("comp <> main").select("key", "node", "comp", F.lit(0).alias("side"), spot("rows", 1).alias("i"), span("cols").alias("j"))
    every = inside.select("key", "node", "comp", F.lit(1).alias("side"), span("rows").alias("i"), spot("cols", 2).alias("j"))
    return minor.unionByName(every)


def _classes(docs: DataFrame, size: int, percent: int, bands: int, rows: int, miss: float, block: int, large: int) -> DataFrame:
    """docs: (doc_id, text, mark). (doc_id, mark, n_shingles, first) for each row: first is the least (doc_id, mark) of
    the row's component, null for rows that are in no link."""
    steps = least_matches(percent / 100, bands * rows, BATCH, miss)
    schema = "doc_id bigint, mark bigint, n_shingles bigint, k1 bigint, k2 bigint, keys array<bigint>, sig binary"
    signed = materialize(docs.mapInArrow(signer(size, bands, rows), schema), "signatures")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    # copies: one representative for each distinct set; its signature is that of each copy
    least = F.min(F.struct("doc_id", "mark")).alias("least")
    reps = known.groupBy("n_shingles", "k1", "k2").agg(least, F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "representatives")
    member = reps.select("node", F.explode("keys").alias("key"))
    bucket = member.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1")
    # written first, so that both sides of the join are plain exchanges and a large bucket's rows can be split
    met = materialize(member.join(materialize(bucket, "pivots"), "key"), "buckets")
    pairs = met.where("node <> pivot").select(F.col("node").alias("x"), F.col("pivot").alias("y")).distinct()
    sigs = reps.select("node", "sig")
    judged = materialize(_both(pairs, sigs).mapInArrow(pruner(steps), "x bigint, y bigint, likely boolean"), "judged")
    # full sets of everything that shares a bucket, from one row of each
    copies = known.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("rows"))
    wanted = reps.join(met.select("node").distinct(), "node", "left_semi").select("node", "least.doc_id", "least.mark")
    wanted = materialize(wanted.join(copies, ["doc_id", "mark"]), "wanted")
    # the plan of a large table at any size: a shuffle of the texts by row, whose hot keys can be split
    texts = docs.join(wanted.hint("merge"), ["doc_id", "mark"]).select("node", "rows", "text")
    sets = materialize(texts.mapInArrow(set_maker(size), "node bigint, rows bigint, grams binary"), "sets")
    # equal rows that met in several tasks are few by now
    sets = sets.where("rows = 1").select("node", "grams").unionByName(sets.where("rows > 1").groupBy("node").agg(F.first("grams").alias("grams")))
    links = materialize(_both(judged.where("likely").select("x", "y"), sets).mapInArrow(verifier(percent), "x bigint, y bigint"), "links")
    links = links.unionByName(_exact_links(judged.where("not likely").select("x", "y"), sets, percent))
    roots = components(links, "x", "y")
    # buckets with several components left
    open_ = met.where("members > 2").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    mixed = materialize(_mixed(open_), "mixed")
    outside = F.col("all") - F.col("most")
    tasks = _block_tasks(open_, mixed.where(outside <= large), block).join(sigs, "node").join(sets, "node")
    more = materialize(tasks.groupBy("key", "i", "j").applyInPandas(block_linker(steps, percent), "x bigint, y bigint"), "more-links")
    crowded = mixed.where(outside > large).select("key")
    if not crowded.isEmpty():
        more = more.unionByName(_rare_links(open_.join(crowded, "key").select("node", "comp").distinct(), sets, percent))
    roots = components(links.unionByName(more), "x", "y") if not more.isEmpty() else roots
    # each component's least document; representatives are the least of their copies
    linked = reps.select("n_shingles", "k1", "k2", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = materialize(linked.groupBy("root").agg(F.min("least").alias("first")), "firsts")
    classes = linked.join(firsts, "root").select("n_shingles", "k1", "k2", "first")
    out = signed.select("doc_id", "mark", "n_shingles", "k1", "k2").join(classes, ["n_shingles", "k1", "k2"], "left")
    return out.select("doc_id", "mark", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first"))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def near_components(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, miss: float = MISS, block: int = BLOCK, large: int = LARGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row."""
    out = _classes(_named(docs, id_col, text_col), size, percent, bands, rows, miss, block, large)
    component = F.coalesce("first.doc_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, miss: float = MISS, block: int = BLOCK, large: int = LARGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns: one with its least id. Rows without words or without an id stay."""
    out = _classes(_named(docs, id_col, text_col), size, percent, bands, rows, miss, block, large).where("doc_id is not null")
    least = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.mark") == F.col("mark"))
    stay = out.where(F.col("first").isNull() | least).groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"))
    stay = materialize(stay.agg(F.count(F.lit(1)).alias("__rows"), F.first(F.col("first").isNull()).alias("__all")), "stay")
    found = docs.join(stay, (F.col(id_col).cast("bigint") == F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__mark")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    equal = found.where("not __all and __rows > 1").groupBy("__id", "__mark").agg(F.first(F.struct(*columns)).alias("__row")).select("__row.*")
    return found.where("__all or __rows = 1").select(columns).unionByName(equal).unionByName(docs.where(F.col(id_col).isNull()))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2)
