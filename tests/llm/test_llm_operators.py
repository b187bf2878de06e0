"""Each operator against brute force on small tables, and on null, empty, long, tied and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, exact_dedup, html_text, license_scan, mixing, near_dedup, sharding, token_counts, token_files, toxicity
from tidemark.llm._components import components
from tidemark.llm._words import ALNUM, BLANK_SPLIT, WordHasher

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BLANKS, WORDS = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sentence(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}x" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    long = sentence(rng, 60_000, 5000)
    rows = [(1, "Same Text", "en", "a", 9), (2, "same text", None, "b", None), (3, "SAME TEXT", "de", None, 1), (4, None, "en", "a", 0), (5, "", "en", "a", 0), (6, "one", "en", "b", 3)]
    rows += [(7, long, "en", "a", len(long)), (8, long, "en", "c", 1), (None, "no id here", "en", "a", 1), (9, "  \t\n ", "en", "a", 1), (10, "Éé Straße 東京 " * 5, "fr", "é", 2)]
    rows += [(11, "twice the same row", "en", "a", 1)] * 2 + [(12, "x" * 1_200_000, "en", "b", 1), (13, "fuck" * 3 + " <b>&amp;", "en", "b", 1)]
    rows += [(20 + k, sentence(rng, 30), "en", "abc"[k % 3], 1) for k in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    clash = {c: F.lit("clash") for c in ("size", "shard", "kept", "score", "taken", "labels", "slot", "node", "key", "start", "words", "ids", "month", "sig")}
    return df.withColumns(clash)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_word_hashes():
    rng = random.Random(1)
    for kind, pattern in ((BLANK_SPLIT, BLANKS), (ALNUM, WORDS)):
        for segment in (64, 1 << 20):
            hasher, seen, back = WordHasher(kind, segment), {}, {}
            texts = ["".join(rng.choice("aB c\t\n-é0_東\x7f.Z") for _ in range(rng.randrange(200))) for _ in range(60)] + ["", "q" * 500]
            data = [t.encode() for t in texts]
            got = [h[b[i] : b[i + 1]].tolist() for _, h, b in hasher.documents(data) for i in range(len(b) - 1)]
            for text, hashes in zip(texts, got, strict=True):
                words = re.findall(pattern, low(text))
                assert len(words) == len(hashes)
                for w, h in zip(words, hashes, strict=True):
                    assert seen.setdefault(w, h) == h and back.setdefault(h, w) == w


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert dict(rows_of(components(df, "a", "b"), "node", "root")) == {x: find(x) for e in edges for x in e if e[0] != e[1]}


# --- op4
@pytest.mark.parametrize("options", [{}, {"bits_per_key": 1, "max_filter_bits": 1 << 15}, {"bits_per_key": 1 << 13, "max_filter_bits": 1 << 17}])
def test_exact_dedup(spark, odd, options):
    made = exact_dedup.exact_dedup(odd, **options)
    groups = defaultdict(list)
    source = rows_of(odd, "doc_id", "text")
    for i, t in source:
        groups[low(t)].append(i)
    want, first = Counter(), set()
    for i, t in sorted(source, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True):
        keep = max((x for x in groups[low(t)] if x is not None), default=None)
        want[i, keep, len(groups[low(t)]), low(t) not in first, hashlib.sha256(low(t).encode()).hexdigest()] += 1
        first.add(low(t))
    assert Counter(rows_of(made, "doc_id", "keep_id", "group_size", "kept", "text_sha256")) == want
    assert sum(r["kept"] for r in made.collect()) == len(groups)
    assert made.where("kept = 'clash'").isEmpty() if dict(made.dtypes)["kept"] == "string" else True
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


def test_only_repeated_rows_are_shuffled(spark, tmp_path):
    """In one filter and in several: the rows that meet in an exchange are those of repeated texts (and few false
    positives); what pass 1 exchanges are position counts."""
    text = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string")))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), text.alias("text"))
    for options in ({}, {"max_filter_bits": 1 << 14, "bits_per_key": 16}):
        made = exact_dedup.exact_dedup(df, **options)
        assert made.where("text = 'hot' and group_size = 1000").count() == 1000 and made.where("kept").count() == 2001
    keyed = df.select("doc_id", exact_dedup.text_hash(F.col("text")).alias("text_sha256"), F.col("doc_id").alias("__uid"))
    keyed.write.parquet(str(tmp_path / "keyed"))
    marked = exact_dedup._marked(spark.read.parquet(str(tmp_path / "keyed")), "doc_id", 1 << 16)
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    unique = plan.split("Union")[1].split("\n:- ")[1].split("\n+- ")[0]
    assert "Aggregate" in unique and "text_sha256" in unique  # the filter is its only aggregate
    joined = marked.where("group_size = 1").count()
    assert joined >= 2000
    tested = marked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in tested and "hashpartitioning(pos" in tested
    assert not any("hashpartitioning(text_sha256" in line and "Exchange" in line for line in unique.splitlines())


# --- op2
def test_sharding(spark, odd):
    for df in (odd, odd.limit(0), spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))):
        rows = sharding.shard_rows(df, shards=7).collect()
        assert len(rows) == df.count()
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        if rows:
            counts = [len(slots.get(k, ())) for k in range(7)]
            assert max(counts) - min(counts) <= 1
    sizes = {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows_of(odd, "doc_id", "text")}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in sharding.shard_rows(odd).collect()} == sizes


def test_ring_moves_few():
    arcs = sharding.ring(24)
    counts = {i: 40 + (i * 7919) % 30 for i in range(len(arcs))}
    pieces = sharding.walk(arcs, counts, sharding.bounds(sum(counts.values()), 24))
    ends = defaultdict(list)
    for arc, first, shard, _ in pieces:
        ends[arc].append((first, shard))
    moved = 0
    for arc, own in ends.items():
        own.sort()
        for (first, shard), stop in zip(own, [*(f for f, _ in own[1:]), counts[arc]], strict=True):
            moved += (stop - first) * (shard != arcs[arc][1])
    assert sum(counts.values()) * 0.2 > moved


def test_sharding_against_a_plain_ring(spark):
    """Row by row: home shards take their rows in clockwise order while they have room, then what is left goes clockwise
    from its arc to the next arc whose shard has room."""
    shards = 6
    df = spark.createDataFrame([(k if k % 9 else None, f"text {k % 400}") for k in range(3000)], "doc_id bigint, text string")
    keyed = df.withColumn("spot", F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary")), (F.octet_length("text") + 8).cast("bigint")))
    arcs = sharding.ring(shards)
    limits = sharding.bounds(3000, shards)
    waiting, used, home = [], Counter(), Counter()
    rows = []
    for r in keyed.select("doc_id", "text", "spot").collect():
        cell = r["spot"] % sharding.CELLS
        arc = next((k for k, (last, _) in enumerate(arcs) if last >= cell), 0)
        rows.append((arc, r["spot"]))
    placed = Counter()
    for arc, spot in sorted(rows):
        shard = arcs[arc][1]
        home[shard] += 1
        if used[shard] < limits[shard]:
            used[shard] += 1
            placed[spot, shard] += 1
        else:
            waiting.append((arc, spot))
    queue, at = [], 0
    for lap in range(2):
        for k, (_, shard) in enumerate(arcs):
            while lap == 0 and at < len(waiting) and waiting[at][0] == k:
                queue.append(waiting[at])
                at += 1
            while queue and used[shard] < limits[shard]:
                used[shard] += 1
                placed[queue.pop(0)[1], shard] += 1
    made = sharding.shard_rows(df, shards=shards)
    got = Counter(rows_of(made.select(F.xxhash64("doc_id", "text_crc32", "size").alias("spot"), "shard"), "spot", "shard"))
    assert got == placed and not queue
    assert made.where("shard <> home_shard").count() == len(waiting)


def test_one_more_shard_moves_few():
    """From 24 to 25 shards the least that must move is 1/25; some cells besides go between old shards."""
    def homes(shards):
        arcs, out, k = sharding.ring(shards), [], 0
        for cell in range(sharding.CELLS):
            while k < len(arcs) and cell > arcs[k][0]:
                k += 1
            out.append(arcs[k % len(arcs)][1])
        return np.array(out)

    before, after = homes(24), homes(25)
    assert len(sharding.ring(25)) == 25 * sharding.VNODES
    to_new, between_old = (after == 24).mean(), ((after != before) & (after != 24)).mean()
    assert 0.02 < to_new < 0.06 and between_old < 0.005

    def placed(shards, rows):
        arcs = sharding.ring(shards)
        ends = np.array([c for c, _ in arcs])
        cells = np.array([zlib.crc32(str(k).encode()) % sharding.CELLS for k in range(rows)])
        arc = np.searchsorted(ends, cells) % len(arcs)
        counts = Counter(arc.tolist())
        pieces = defaultdict(list)
        for a, first, shard, _ in sharding.walk(arcs, counts, sharding.bounds(rows, shards)):
            pieces[a].append((first, shard))
        seen, out = Counter(), []
        for k in np.argsort(cells, kind="stable").tolist():
            a = int(arc[k])
            rank = seen[a]
            seen[a] += 1
            out.append((k, [s for f, s in sorted(pieces[a]) if f <= rank][-1]))
        return np.array([s for _, s in sorted(out)])

    a, b = placed(24, 20_000), placed(25, 20_000)
    assert (a != b).mean() < 0.15, (a != b).mean()


# --- op6
def targets(sizes, repeat=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(repeat * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        t = {s: repeat * sizes[s] if s in full else left * weight[s] / free for s in names}
        more = {s for s in names if s not in full and t[s] > repeat * sizes[s]}
        if not more:
            return t
        full |= more


def test_targets_and_quotas(spark):
    rng = random.Random(3)
    for case in range(4):
        sizes = {f"s{k:02d}": rng.choice([0, 1, 7, 300, 5000, 200_000]) for k in range(rng.randrange(2, 12))} | ({None: 50} if case % 2 else {}) | {"zz": 10_000}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r["source"]: r for r in mixing.seat_quotas(mixing.source_targets(df), block=37).collect()}
        want = targets(sizes)
        assert all(got[s]["target"] == pytest.approx(want[s], abs=1e-6) for s in sizes)
        # highest quotients, one seat at a time
        seats = dict.fromkeys(sizes, 0)
        order = sorted(sizes, key=lambda s: (s is not None, (s or "").encode()))
        order = [s for s in order if s is not None] + [None] * (None in sizes)
        blocks = {s: -(-sizes[s] // 37) for s in sizes}
        for _ in range(round(sum(sizes.values()) / 37)):
            best = max((s for s in order if seats[s] < 3 * blocks[s]), key=lambda s: want[s] / (2 * seats[s] + 1))
            seats[best] += 1
        assert all(abs(got[s]["seats"] - seats[s]) <= 1 for s in sizes) and sum(g["seats"] for g in got.values()) == sum(seats.values())
        parts = mixing.shard_quotas(mixing.seat_quotas(mixing.source_targets(df), block=37), 5).collect()
        for s in sizes:
            own = sorted((p for p in parts if p["source"] == s), key=lambda p: p["shard"])
            assert sum(p["quota"] for p in own) == got[s]["seats"] and sum(p["own_blocks"] for p in own) == blocks[s]
            assert all(0 <= p["extra"] <= p["own_blocks"] and p["quota"] <= 3 * p["own_blocks"] for p in own)
            share = [p["quota"] - got[s]["seats"] * p["own_blocks"] / max(1, blocks[s]) for p in own]
            assert all(abs(x) < 1 for x in share), (s, share)


def brute_taken(sized, quotas, block, shards):
    """Words taken of each document, by a list of all of a source's words: sized is [(words)] in the source's order."""
    owner = [k for k, n in enumerate(sized) for _ in range(n)]
    taken = Counter()
    for q in quotas:
        chosen = [i for i in range(q["own_blocks"]) if (i + 1) * q["extra"] + q["phase"] >= ((i * q["extra"] + q["phase"]) // max(1, q["own_blocks"]) + 1) * q["own_blocks"]]
        assert len(chosen) == q["extra"]
        for i in range(q["own_blocks"]):
            times = q["full"] + (i in chosen)
            for w in range((q["first"] + i) * block, min(len(owner), (q["first"] + i + 1) * block)):
                taken[owner[w]] += times
    return [taken[k] for k in range(len(sized))]


def test_taken_words_block_by_block(spark):
    """taken of each document against a walk over all words of all blocks."""
    rng = random.Random(31)
    rows = [(k, sentence(rng, rng.choice([0, 1, 3, 40, 700])), "en", rng.choice(["a", "b", None, "é"]), 1) for k in range(300)] + [(900, "w " * 9000, "en", "a", 1), (901, "x", "en", "tiny", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for block, shards in ((None, 24), (7, 3), (50, 24)):
        made = mixing.mix(df, block=block, shards=shards).collect()
        narrow = mixing._sized(df, mixing.SEED, "doc_id", "text", "source")
        narrow = narrow.withColumn("__bucket", mixing._bucket(mixing._bucket_count(narrow))).collect()
        sizes = Counter()
        for r in narrow:
            sizes[r["__source"]] += r["__size"]
        quotas = mixing.seat_quotas(mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")), block=block)
        width = quotas.first()["block"]
        parts = mixing.shard_quotas(quotas, shards).collect()
        taken = {r["doc_id"]: r["taken"] for r in made}
        for s in sizes:
            own = sorted((r for r in narrow if r["__source"] == s), key=lambda r: (r["__bucket"], r["__id"], r["__mark"], r["__size"]))
            mine = sorted((p for p in parts if p["source"] == s), key=lambda p: p["shard"])
            assert brute_taken([r["__size"] for r in own], mine, width, shards) == [taken[r["__id"]] for r in own], (s, block)


def test_mix(spark, odd):
    for df in (odd, odd.limit(0), spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))):
        rows = mixing.mix(df).collect()
        assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted((i or -1, len(re.findall(BLANKS, t or ""))) for i, t in rows_of(df, "doc_id", "text"))
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
        taken, target = Counter(), {}
        for r in rows:
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
        assert all(abs(taken[s] - t) <= max(0.01 * t, 60) for s, t in target.items())
        again = mixing.mix(df.repartition(3)).collect()
        assert Counter((r["doc_id"], r["size"], r["taken"]) for r in rows) == Counter((r["doc_id"], r["size"], r["taken"]) for r in again)
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 6


def test_mixed_documents_meet_targets(spark):
    """Also where one small source makes blocks of one word, so that every document's share is its source's."""
    rng = random.Random(12)
    rows = [(k, sentence(rng, rng.randrange(20, 400)), "en", f"s{k % 4}", 1) for k in range(1200)] + [(2000 + k, "same size " * 20, "en", "s1", 1) for k in range(300)] + [(5000, sentence(rng, 50), "en", "tiny", 1)]
    df = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mixed_documents(df)
    times = Counter(i for i, in rows_of(mixed, "doc_id"))
    made = mixing.mix(df).collect()
    assert all(abs(times[r["doc_id"]] - r["taken"] / r["size"]) < 1 for r in made)
    for s in {r["source"] for r in made}:
        own = [r for r in made if r["source"] == s]
        written = sum(times[r["doc_id"]] * r["size"] for r in own)
        assert abs(written - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 60, s
    assert Counter(i for i, in rows_of(mixing.mixed_documents(df.repartition(3)), "doc_id")) == times


# --- op9
def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(BLANKS, low(t))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(rng, words, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words)


@pytest.mark.parametrize(("size", "large"), [(2, 4096), (5, 4096), (2, 1)])
def test_near_dedup(spark, size, large):
    rng = random.Random(size)
    rows = [(k, sentence(rng, 60)) for k in range(60)]
    for base in range(12):  # groups whose members are near the threshold
        words = sentence(rng, 120).split()
        rows += [(1000 * (base + 1) + k, edited(rng, words, rng.choice([0, 0.01, 0.02, 0.04, 0.05]))) for k in range(12)]
    rows += [(50_000 + k, rows[5][1].upper()) for k in range(5)] + [(60_000, None), (60_001, ""), (60_002, "one"), (60_003, "ONE"), (60_004, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = set(rows_of(near_dedup.near_components(df, size=size, block=4, large=large), "doc_id", "n_shingles", "component_id", "kept"))
    assert got == brute_components(rows, size, 80)


def pages_of_a_template(seed=31, families=40, own=30):
    """Pages that hold one template's words, and words of their family's, near the threshold in a family. All have the same
    least shingle, so they are one bucket where there is one band of one row."""
    rng = random.Random(seed)
    shared, rows = sentence(rng, 110).split(), []
    for k in range(families):
        words = [f"f{k}w{j}" for j in range(own)]
        for m in range(3):
            rows.append((100 * k + m, " ".join([*shared, *words[: own - rng.randrange(8)], *(f"x{k}y{m}z{j}" for j in range(rng.randrange(30)))])))
    sets = near_dedup.shingle_sets([t.encode() for _, t in rows], 2, near_dedup.WordHasher(near_dedup.BLANK_SPLIT))
    least = [int(near_dedup.minhash(x, *near_dedup.permutations(1))[0]) for x in sets]
    return [r for r, x in zip(rows, least, strict=True) if x == Counter(least).most_common(1)[0][0]]


def test_links_of_pages_in_a_crowded_bucket(spark):
    """Every pair of a bucket with many members outside its largest component meets, whatever else the two share."""
    rows = pages_of_a_template()
    want = brute_components(rows, 2, 80)
    assert len(rows) > 60 and 40 < sum(kept for *_, kept in want) < len(rows) - 15
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = rows_of(near_dedup.near_components(df, size=2, bands=1, rows=1, block=8, large=0), "doc_id", "n_shingles", "component_id", "kept")
    assert set(got) == want


def test_first_shingles_hold_one_of_every_link():
    """Of any two ordered sets with a link, the larger's probed and the smaller's indexed shingles meet."""
    rng = random.Random(32)
    for _ in range(3000):
        percent = rng.choice([50, 80, 90, 100])
        both, more = rng.randrange(1, 60), rng.randrange(0, 16)
        x = set(rng.sample(range(200), both))
        y = set(rng.sample(sorted(x), rng.randrange(1, len(x) + 1))) | set(rng.sample(range(200, 260), more))
        x, y = sorted((sorted(x), sorted(y)), key=len, reverse=True)
        if 100 * len(set(x) & set(y)) >= percent * len(set(x) | set(y)):
            assert set(x[: near_dedup.first_shingles(len(x), percent)[0]]) & set(y[: near_dedup.first_shingles(len(y), percent)[1]])


def test_near_dedup_odd_rows(spark, odd):
    got = near_dedup.near_components(odd)
    assert got.count() == odd.count() and got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[8]["component_id"] == 7 and by[2]["component_id"] == 1 and by[None]["component_id"] is None and by[None]["kept"] and by[4]["n_shingles"] == 0 and by[5]["kept"]
    assert near_dedup.near_components(odd.limit(0)).count() == 0
    left = near_dedup.one_of_each(odd)
    assert left.columns == odd.columns and sorted(r[0] or 0 for r in left.select("doc_id").collect()) == sorted({i or 0 for i, in odd.select("doc_id").collect()} - {2, 3, 8})


def test_near_dedup_of_clashing_ids(spark):
    """Rows of one id with unlike texts link by their own texts; equal rows are one."""
    rng = random.Random(21)
    x, y, z = (sentence(rng, 80) for _ in range(3))
    rows = [(1, x), (1, y), (2, y), (3, x + " tail"), (4, z), (4, z), (1, y), (5, None), (5, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(rows_of(near_dedup.near_components(df, size=2), "doc_id", "component_id", "kept"))
    assert got == Counter({(1, 1, True): 3, (2, 1, False): 1, (3, 1, False): 1, (4, 4, True): 2, (5, 5, True): 2})
    left = Counter(rows_of(near_dedup.one_of_each(df), "doc_id", "text"))
    assert left == Counter({(1, x): 1, (1, y): 1, (4, z): 1, (5, None): 2})


def test_one_text_repeated_under_one_id(spark):
    df = spark.range(2200).select(F.lit(7).cast("bigint").alias("doc_id"), F.concat(F.lit("a b c d e f g "), F.when(F.col("id") < 2000, "same").otherwise(F.col("id").cast("string"))).alias("text"))
    assert near_dedup.near_components(df, size=2).select("component_id", "kept").distinct().collect() == [(7, True)]
    assert near_dedup.one_of_each(df).where("text like '%same'").count() <= 1


def test_bayes_bounds():
    steps = near_dedup.least_matches(0.8, 192, 32, 1e-4)
    assert [n for n, _ in steps] == [32, 64, 96, 128, 160, 192]
    rng = np.random.default_rng(0)
    x = np.zeros((4000, 192), dtype=np.uint16)
    same = (rng.random((4000, 192)) < 0.8).astype(np.uint16)
    assert len(near_dedup.survivors(x, 1 - same, steps)) >= 3990
    far = (rng.random((4000, 192)) < 0.5).astype(np.uint16)
    assert len(near_dedup.survivors(x, 1 - far, steps)) == 0


# --- op1
def test_license_scan_base_places(spark, odd):
    rng = random.Random(4)
    phrases = list(license_scan.BASE)
    rows = []
    for k in range(120):
        parts = [rng.choice([*phrases, "the", "license", "under", "cc by", "apache license version", "mit", "word", "MIT", "under the mit License", "version 2"]) for _ in range(rng.randrange(14))]
        rows.append((1000 + k, rng.choice([" ", ", ", "\n", "--"]).join(parts)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    rows += [(i, t) for i, t in rows_of(odd, "doc_id", "text") if i is not None and i != 11]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(df).unionByName(license_scan.scan_licenses(odd)).collect()}
    for i, t in rows:
        w = re.findall(WORDS, low(t))
        places, names = [], set()
        for p, label in license_scan.BASE.items():
            q = p.split()
            found = [a for a in range(len(w)) if w[a : a + len(q)] == q]
            places += found
            names |= {label} if found else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(names)))
        assert names <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert license_scan.scan_licenses(odd).count() == odd.count() and license_scan.scan_licenses(odd.limit(0)).count() == 0


def test_license_base_phrases_of_one_and_two_words(spark):
    base = {"cc0": "cc0", "public domain": "pd", "a b a": "aba"}
    rng = random.Random(41)
    rows = [(k, " ".join(rng.choice(["cc0", "public", "domain", "a", "b", "zz", "license"]) for _ in range(rng.randrange(12)))) for k in range(80)]
    made = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"), base=base)
    for r in made.collect():
        w = rows[r["doc_id"]][1].split()
        places = [(a, label) for p, label in base.items() for a in range(len(w)) if w[a : a + len(p.split())] == p.split()]
        assert (r["n_base"], r["base_labels"]) == (len(places), ",".join(sorted({x for _, x in places}))), rows[r["doc_id"]]


def test_license_chains_against_all_chains():
    """The covered share of the best chain against a plain search over all chains of maximal matches."""
    templates = [("x", "a b c d e f g h i j k l"), ("y", "m n a b c d o p q r s t")]
    scanner = license_scan.Scanner(templates, {})
    vocabulary = scanner.vocabulary
    rng = random.Random(43)
    for _ in range(150):
        own = rng.choice(templates)[1].split()
        words = [w for w in own if rng.random() > 0.1]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words))
            words[at:at] = rng.choice([["zz"], own[:4], own[-5:], ["a", "b", "c", "d"]])
        hashes = scanner.hasher.words(" ".join(words).encode())[2]
        got = defaultdict(float)
        for label, _, _, covered in scanner.scan(vocabulary.tokens(hashes))["spans"]:
            got[label] = max(got[label], covered)
        for label, text in templates:
            t = text.split()
            every = {tuple(x.split()[a:b]) for _, x in templates for a in range(12) for b in range(a + 1, 13) for x in [x]}
            stats, n = [], 0
            for i in range(len(words)):
                n = next((k for k in range(min(12, i + 1), 0, -1) if tuple(words[i + 1 - k : i + 1]) in every), 0)
                stats.append(n)
            matches = []
            for i, n in enumerate(stats):
                if n >= license_scan.MIN_MATCH and (i + 1 == len(stats) or stats[i + 1] != n + 1):
                    run = words[i + 1 - n : i + 1]
                    matches += [(i + 1 - n, a, n) for a in range(len(t) - n + 1) if t[a : a + n] == run]
            best = [0] * len(matches)
            for k, (start, at, n) in enumerate(matches):
                best[k] = n
                for j, (start2, at2, n2) in enumerate(matches[:k]):
                    end, reach = start2 + n2, at2 + n2
                    cut = max(0, end - start, reach - at)
                    if start - end <= license_scan.GAP and at - reach <= license_scan.GAP and cut < n:
                        best[k] = max(best[k], best[j] + n - cut)
            assert got[label] == pytest.approx(max(best, default=0) / len(t)), (words, label)


def test_license_spans_and_automaton():
    scanner = license_scan.Scanner()
    text = "junk " + license_scan.TEMPLATES[5][1].replace("modification", "any modification") + " junk"
    r = scanner.scan(scanner.vocabulary.tokens(scanner.hasher.words(text.encode())[2]))
    assert any(s[0] == "bsd" and s[3] >= 0.75 and s[1] == 1 for s in r["spans"]) and r["n_base"] == 0 and r["score"] > 0.75
    rng = random.Random(6)
    texts = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(12)]
    automaton = license_scan.Automaton(texts, [0])
    stream = [rng.randrange(5) for _ in range(400)]
    every = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    for i, (state, n) in enumerate(automaton.stream(stream)):
        longest = next((k for k in range(min(12, i + 1), 0, -1) if tuple(stream[i + 1 - k : i + 1]) in every), 0)
        assert n == longest
        assert any(p == 0 and size <= n for p, size in automaton.phrases[state]) == (tuple(stream[max(0, i + 1 - len(texts[0])) : i + 1]) == tuple(texts[0]))
        if n:
            assert {(t, e) for t, e in automaton.ends[state] if texts[t][e - n + 1 : e + 1] == stream[i + 1 - n : i + 1]} == {(t, e) for t, own in enumerate(texts) for e in range(n - 1, len(own)) if own[e - n + 1 : e + 1] == stream[i + 1 - n : i + 1]}


def test_license_fragment_before_or_within_notice():
    scanner = license_scan.Scanner()
    notice = license_scan.TEMPLATES[7][1]
    words = notice.split()
    spans = lambda text: [s[1:] for s in scanner.scan(scanner.vocabulary.tokens(scanner.hasher.words(text.encode())[2]))["spans"] if s[0] == "gpl"]
    assert (10, 38, 1.0) in spans("released under the terms of the gnu general public license. " + notice)
    # a fragment of the notice's beginning between its halves
    assert (0, len(words) + 3, 1.0) in spans(" ".join([*words[:15], *words[:4], *words[15:]]))
    assert spans(notice + " " + notice) == [(0, 28, 1.0), (29, 57, 1.0)]


# --- op5, op7
def test_token_files(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_files.tokenizer_path())
    path = str(tmp_path / "tokens")
    token_files.write_tokens(odd, path, parts=5)
    rows = sorted(rows_of(odd, "doc_id", "text"), key=lambda r: (r[0] is not None, r[0] or 0))
    made = token_files.read_starts(spark, path).orderBy(F.col("start")).collect()
    assert [r["doc_id"] for r in made] == [i for i, _ in rows]
    texts = defaultdict(list)
    for r in token_files.read_tokens(spark, path).collect():
        texts[r["doc_id"]].append(r["ids"])
    start = 0
    for r, (i, t) in zip(made, rows, strict=True):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"]) == (start, len(ids)) and ids in texts[i]
        start += len(ids)
    token_files.write_tokens(odd.limit(0), str(tmp_path / "none"), parts=2)
    assert token_files.read_starts(spark, str(tmp_path / "none")).count() == 0


def test_piece_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(token_files.tokenizer_path()), token_files.PieceEncoder(token_files.tokenizer_path(), cache=50)
    rng = random.Random(8)
    pool = [chr(c) for c in range(0x250)] + ["'s", "'re", " ", "\n", "<|endoftext|>", "<|startoftext|>", "́", "Σ", "σ", "İ", " ", "東", "가", "😀", "ﬁ", "٠"] + ["a", "B", ".", ",", " "] * 9
    for _ in range(4000):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(16)))
        assert np.frombuffer(own.text(t), dtype="<i4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_piece_encoder_over_all_of_unicode():
    """Every code point alone, within words and after a combining base; then random texts over all of them."""
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(token_files.tokenizer_path()), token_files.PieceEncoder(token_files.tokenizer_path())
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same = lambda texts: [t for t, e in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True) if np.frombuffer(own.text(t), dtype="<i4").tolist() != e.ids]
    for at in range(0, len(every), 64_000):
        part = every[at : at + 64_000]
        assert not same([" ".join(f"{c}a{c}b" for c in part[k : k + 64]) for k in range(0, len(part), 64)])
    assert not same([f"{c} {c}{c}. x{c}" for c in every[:0x3000]])
    named = [c for c in every if c.isalnum() or not c.isprintable() and c.isspace()][:20_000] + [chr(c) for c in range(0x300, 0x370)] * 20
    rng = random.Random(14)
    assert not same(["".join(rng.choice(named if rng.random() < 0.6 else "aB.,'s 1-é") for _ in range(rng.randrange(1, 30))) for _ in range(20_000)])
    assert not same(["\u09ac\u09dc", "\u0958\u0959 \u09df", "\ufb1f\ufb2a", "\u0b5c", "\u0f43", "\u0558", "\u1c89", "\ua7cb", "\U00010940"])


def test_piece_encoder_in_batches():
    """Columns of texts: the library's ids with full and small caches, and each distinct word encoded once, whatever
    stands beside it. (Before, pieces between blanks were encoded one by one.)"""
    import pyarrow as pa
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_files.tokenizer_path())
    made = []
    counted = token_files.PieceEncoder(token_files.tokenizer_path())
    for known in (counted.words, counted.few):
        known.make = lambda strings, odd, make=known.make: made.extend(strings) or make(strings, odd)
    counted.texts(pa.array(["alpha, beta. gamma", None, "(beta) alpha-gamma 11", "don't"]))
    counted.texts(pa.array(["gamma.alpha,beta don't 1"]))
    assert sorted(made) == sorted(["alpha", ",", "beta", ".", "gamma", "(", ")", "-", "1", "don't"])
    rng = random.Random(31)
    parts = ["alpha", "Beta", "ÉTÉ", "ß", "ǅ", "ȺȾ", "²", "12", "...", ",", "-", "'", "'s", "'Re", "_", "\x00", "\x1c", "\x85", "\u00a0", "\u3000", "\u0301", "Σ", "東京", "😀", "<|endoftext|>", "<|endof", "text|>", "<|startoftext|>", " ", " ", " ", "\n", "\t\r"]
    for cache in (3, 40, 400_000):
        own = token_files.PieceEncoder(token_files.tokenizer_path(), cache=cache)
        for size in (0, 1, 2, 7, 300, 3, 900):
            texts = [rng.choice([None, "", "  "]) if rng.random() < 0.2 else "".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(size + 2)]
            column = pa.array(texts, pa.string()).slice(1, size)  # not at the buffer's beginning
            ids, sizes = own.texts(column)
            want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts[1 : size + 1]]
            assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
            assert len(own.words.strings) <= cache and len(own.few.strings) <= cache
    ids, sizes = own.texts(pa.array(["aé " * 3, "", None], pa.large_string()))
    assert sizes.tolist()[1:] == [0, 0] and ids.tolist() == whole.encode("aé " * 3, add_special_tokens=False).ids


@pytest.mark.parametrize("segment", [1, 7, 64])
def test_piece_encoder_cuts_long_texts_at_blanks(monkeypatch, segment):
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "SEGMENT", segment)
    whole, own = Tokenizer.from_file(token_files.tokenizer_path()), token_files.PieceEncoder(token_files.tokenizer_path())
    rng = random.Random(5)
    parts = ["alpha", "Beta", "é", "12", ",", "'s", "\u0301", "東京", "<|endoftext|>", "a" * 90, " ", " ", "\n", "\u3000"]
    for size in (1, 1, 1, 5, 40):
        texts = [rng.choice([None, ""]) if rng.random() < 0.2 else "".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(size)]
        ids, sizes = own.texts(pa.array(texts, pa.string()))
        want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, odd, rule):
    encoding, width = token_counts.load(*token_counts.rank_file())
    got = defaultdict(list)
    for r in token_counts.section_tokens(odd, rule).collect():
        got[r["doc_id"]].append((r["section"], r["n_bytes"], r["n_tokens"], r["n_crossing"], r["doc_tokens"]))
    rows = rows_of(odd, "doc_id", "text")
    for i, t in rows:
        t, times = t or "", Counter(x for x, _ in rows)[i]
        n = len(encoding.encode_ordinary(t))
        assert {x[4] for x in got[i]} == {n} and sum(x[2] for x in got[i]) == n * times and sum(x[1] for x in got[i]) == len(t.encode()) * times
        assert len(got[i]) == max(1, t.count("\n") + (not t.endswith("\n") and t != "")) * times
    rows = [(-1, "a\n\nbb\n \n  c\r\n")]
    # token by token, byte by byte
    t = rows[-1][1]
    data, ids = t.encode(), encoding.encode_ordinary(t)
    line_of = [data[:k].count(b"\n") for k in range(len(data))]
    starts, at, want, cross = token_counts.line_starts(data), 0, Counter(), Counter()
    for x in ids:
        held = line_of[at : at + int(width[x])]
        own = held[0] if rule == "first" else held[-1] if rule == "last" else max(sorted(set(held)), key=held.count)
        want[own] += 1
        cross[own] += len(set(held)) > 1
        at += int(width[x])
    tokens, crossing = token_counts.attribute(np.cumsum(width[np.array(ids)]), starts, rule)
    assert tokens.tolist() == [want[k] for k in range(len(starts))] and crossing.tolist() == [cross[k] for k in range(len(starts))]
    assert token_counts.section_tokens(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_tokens(odd, "other")


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_of_spans_and_fields(spark, rule):
    """Spans of characters against a walk over bytes: gaps, overlaps, empty and clipped spans."""
    encoding, width = token_counts.load(*token_counts.rank_file())
    rng = random.Random(23)
    rows = []
    for k in range(40):
        t = "".join(rng.choice("ab é東😀\n.") for _ in range(rng.randrange(40)))
        cut = lambda: rng.randrange(-2, len(t) + 3)
        rows.append((k, t, [{"first": cut(), "end": cut()} for _ in range(rng.randrange(6))]))
    rows += [(100, None, [{"first": 0, "end": 5}]), (101, "abc def", None), (102, "abc def", [None, {"first": None, "end": 3}, {"first": 2, "end": None}])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans array<struct<first: bigint, end: bigint>>")
    got = defaultdict(dict)
    for r in token_counts.section_tokens(df, rule, spans_col="spans").collect():
        got[r["doc_id"]][r["section"]] = (r["first_byte"], r["n_bytes"], r["n_tokens"])
    for i, t, spans in rows:
        t = t or ""
        data = t.encode()
        places = []
        for s in spans or []:
            a = min(max((s or {}).get("first") or 0, 0), len(t))
            e = (s or {}).get("end")
            places.append((len(t[:a].encode()), len(t[: max(a, min(max(e, 0), len(t)) if e is not None else 0)].encode())))
        assert len(got[i]) == len(places)
        inner = sorted({p for ab in places for p in ab} - {0})
        piece = [sum(p <= k for p in inner) for k in range(len(data))]
        own, at = [], 0
        for x in encoding.encode_ordinary(t):
            held = piece[at : at + int(width[x])]
            own.append(held[0] if rule == "first" else held[-1] if rule == "last" else max(sorted(set(held)), key=held.count))
            at += int(width[x])
        for k, (a, b) in enumerate(places):
            inside = set(piece[a:b])
            assert got[i][k] == (a, b - a, sum(p in inside for p in own)), (i, k)
    made = token_counts.field_tokens(spark.createDataFrame([(1, "Title é", None, 5), (None, "", "body text", None)], "doc_id bigint, title string, body string, n int"), ["title", "body", "n"], rule=rule)
    by = {(r["doc_id"], r["field"]): (r["n_bytes"], r["n_tokens"], r["doc_tokens"]) for r in made.collect()}
    assert by[1, "title"][0] == 8 and by[1, "body"][:2] == (0, 0) and by[1, "n"][0] == 1 and by[None, "body"][0] == 9
    assert by[1, "title"][2] == len(encoding.encode_ordinary("Title é\n\n5"))


# --- op8
def test_html():
    f = lambda x: html_text.extract(x)[1]
    assert f("<p>a<p>b<ul><li>x<li>y<ol><li>q<li>r</ol></ul>c") == "a\n\nb\n\n- x\n- y\n  1. q\n  2. r\n\nc"
    assert f("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>") == "a    bb\nccc  d"
    assert f("<table><thead><tr><th>k<th>v<tbody><tr><td colspan=2>wide<tr><td>p<td>q</table>") == "k     v\nwide\np     q"
    assert f("x<div hidden>no</div><span style='color:red; display : none'>no</span><i style='visibility:hidden'>no</i>y") == "xy"
    assert f("<pre>a\n  b</pre>c &lt;&amp; d<br>e") == "a\n  b\n\nc <& d\ne"
    assert f("<script>var x='</p>';</script><style>p{}</style>t<!-- c --><noscript>n</noscript>") == "t"
    assert f("a <b>b</b>c  \n d") == "a bc d" and f("<b>x<p>y</b>z") == "x\n\nyz"
    assert html_text.extract("<title>T &amp; t</title><body>b") == ("T & t", "b") and html_text.extract(None) == ("", "")
    assert f("1 < 2 <3 </ <") == "1 < 2 <3 </ <" and f('<a href="x>y" title=\'>\'>l</a>') == "l"
    assert f("<div>" * 50_000 + "deep") == "deep" and f("<table><td>" * 2000 + "t") == "t" and f("<ol start=5><li>a<li>b") == "5. a\n6. b"
    assert f("<table>" + "<tr><td>" + "w" * 500 + "<td>s" + "<tr><td>a<td>b</table>") == "w" * 500 + "  s\na  b"


def test_html_tables():
    f = lambda x: html_text.extract(x)[1]
    assert f("<table><tr><td rowspan=2>r<td>1<td>x<tr><td>2<td>y<tr><td>zzz<td>3<td>w</table>") == "r    1  x\n     2  y\nzzz  3  w"
    assert f("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d<tbody><tr><td>e<td>f</table>") == "a  b\n   c\n   d\ne  f"
    assert f("<table><tr><td colspan=99999>a<td>b<tr><td>c<td>d</table>") == "a     b\nc  d"
    long = " ".join(["word"] * 40)
    lines = f(f"<table><tr><td>{long}<td>k<tr><td>a<td>b</table>").split("\n")
    assert " ".join(x.removesuffix("k").strip() for x in lines[:-1]) == long and {x.index(c) for x, c in ((lines[0], "k"), (lines[-1], "b"))} == {lines[0].index("k")}
    page = "<table>" + "<tr>" + "<td rowspan=3 colspan=2>x" * 2000 + "<tr><td>y" * 3 + "</table>"
    assert f(page).count("x") == 2000 and f(page).count("y") == 3
    assert f("<textarea>x\n y</textarea><select><option>o1<option>o2</select><math><mi>x</mi><mo>+</mo></math><svg><title>no</title><text>draw</text></svg><xmp><b>raw</b></xmp>z") == "x\n y\no1\no2\nx+draw\n\n<b>raw</b>\n\nz"


def random_page(rng):
    """(markup, text): the text is put together beside the markup, without any tree."""
    word = lambda: rng.choice(["alpha", "b", "gamma&amp;x", "d1", "é", "five"])
    plain = lambda x: x.replace("&amp;", "&")

    def inline():
        words = [word() for _ in range(rng.randrange(1, 6))]
        marked = [f"<{t}>{w}</{t}>" if (t := rng.choice(["", "b", "i", "span class=c"])) and " " not in t else w for w in words]
        junk = rng.choice(["", "<!-- x > y -->", "<script>if (a<b) {}</script>", "<span hidden>no</span>"])
        return rng.choice([" ", "\n  "]).join(marked) + junk, plain(" ".join(words))

    def items(depth):
        kind, markup, lines = rng.choice(["ul", "ol"]), "", []
        for k in range(rng.randrange(1, 4)):
            text, shown = inline()
            mark = "- " if kind == "ul" else f"{k + 1}. "
            markup += f"<li>{text}"
            lines.append(mark + shown)
            if depth < 2 and rng.random() < 0.3:
                inner, more = items(depth + 1)
                markup += inner
                lines += [" " * len(mark) + x for x in more]
            markup += rng.choice(["", "</li>"])
        return f"<{kind}>{markup}</{kind}>", lines

    def table():
        n, m = rng.randrange(1, 4), rng.randrange(2, 4)
        cells = [[inline() for _ in range(m)] for _ in range(n)]
        width = [max(len(r[c][1]) for r in cells) for c in range(m)]
        lines = ["  ".join(x[1].ljust(w) for x, w in zip(r, width, strict=True)).rstrip() for r in cells]
        body = "".join("<tr>" + "".join(f"<{(t := rng.choice(['td', 'th']))}>{x[0]}" + rng.choice(["", f"</{t}>"]) for x in r) + rng.choice(["", "</tr>"]) for r in cells)
        return "<table>" + rng.choice(["", "<tbody>"]) + body + "</table>", lines

    markup, blocks = "", []
    for _ in range(rng.randrange(1, 7)):
        kind = rng.randrange(5)
        if kind == 0:
            text, shown = inline()
            markup += f"<p>{text}" + rng.choice(["", "</p>"])
            lines = [shown]
        elif kind == 1:
            text, lines = items(0)
            markup += text
        elif kind == 2:
            text, lines = table()
            markup += text
        elif kind == 3:
            lines = [plain(word()) + "  " + plain(word()) for _ in range(rng.randrange(1, 3))]
            markup += "<pre>" + "\n".join(lines).replace("&", "&amp;") + "</pre>"
        else:
            text, shown = inline()
            markup += f"<h2>{text}</h2><div style='display:none'><p>{text}</div>"
            lines = [shown]
        markup += rng.choice(["", "\n", "<!---->"])
        blocks.append("\n".join(lines))
    return rng.choice(["", "<!doctype html><html><head><title>t</title><style>p{}</style></head><body>"]) + markup, "\n\n".join(blocks)


def test_html_against_plain_text():
    rng = random.Random(47)
    for _ in range(600):
        markup, text = random_page(rng)
        assert html_text.extract(markup)[1] == text, markup


def test_html_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (None, None, None), (2, "u", ""), (2, "u", "")], "page_id bigint, url string, html string").withColumns({"text": F.lit("x"), "title": F.lit(3)})
    assert Counter(rows_of(html_text.extract_pages(pages), "page_id", "text")) == Counter({(1, "a"): 1, (None, ""): 1, (2, ""): 2})
    big = "<table>" + "".join(f"<tr><td>row {k}<td>{k * 7}" for k in range(40_000)) + "</table>"
    long = spark.createDataFrame([(7, "u", big), (8, "u", "<p>" + "x" * 2_000_000)], "page_id bigint, url string, html string").withColumn("page", F.lit("clash"))
    texts = dict(rows_of(html_text.extract_pages(long), "page_id", "text"))
    assert texts[7].split("\n")[123] == "row 123    861" and texts[7].count("\n") == 39_999 and texts[8] == "x" * 2_000_000
    assert html_text.extract_pages(pages.limit(0)).count() == 0


# --- op3
def test_decontamination(spark, odd):
    rng = random.Random(9)
    bench = [(k, sentence(rng, rng.randrange(25, 70), 3000)) for k in range(30)] + [(100, None), (101, "too short"), (102, bench_text := sentence(rng, 40, 3000)), (103, bench_text)]
    rows, want, near = [], set(), set()
    for k in range(400):
        words = sentence(rng, rng.randrange(40, 300), 3000).split()
        if k % 8 == 0:
            i, t = bench[rng.randrange(30)]
            own = t.split()
            if k % 16 == 0:  # a paraphrase: some words changed, dropped or added
                own = [w for w in ((f"p{rng.randrange(10**6)}" if rng.random() < 0.12 else w) for w in own) if rng.random() > 0.06]
                near.add((k, i))
            else:
                want.add((k, i))
            at = rng.randrange(len(words))
            words[at:at] = own
        rows.append((k, " ".join(words).title()))
    rows.append((900, "x " + bench_text))
    want |= {(900, 102), (900, 103)}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    found = decontaminate.find_leaks(df, b)
    got = set(rows_of(found, "doc_id", "item_id"))
    assert want <= got and len(near & got) >= 0.9 * len(near) and got <= want | near
    for r in found.where("doc_id = 900").collect():
        assert (r["first_word"], r["last_word"], r["lcs_share"]) == (1, 40, 1.0)
    clean = decontaminate.drop_leaks(df, b)
    assert {r[0] for r in clean.select("doc_id").collect()} == {i for i, _ in rows} - {i for i, _ in got}
    leaky = odd.unionByName(odd.where("doc_id = 20").withColumns({"doc_id": F.lit(999).cast("bigint"), "text": F.lit(rows[-1][1])}))
    assert sorted(i or 0 for i, in rows_of(decontaminate.drop_leaks(leaky, b), "doc_id")) == sorted(i or 0 for i, in rows_of(odd, "doc_id"))
    assert decontaminate.drop_leaks(odd, b).count() == odd.count() and decontaminate.drop_leaks(odd, b).columns == odd.columns
    assert decontaminate.find_leaks(odd.limit(0), b).count() == 0 and decontaminate.find_leaks(df, b.limit(0)).count() == 0


def test_decontamination_against_all_windows(spark, monkeypatch):
    """Hits against a plain search: every window of every document, LCS by a full table. Blocks of a few items."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)
    rng = random.Random(17)
    bench = [(k, sentence(rng, rng.randrange(8, 40), 600)) for k in range(12)]
    rows = []
    for k in range(60):
        words = sentence(rng, rng.randrange(20, 90), 600).split()
        if k % 2:
            own = bench[rng.randrange(12)][1].split()
            share = rng.choice([0, 0.1, 0.5])
            own = [f"p{rng.randrange(10**6)}" if rng.random() < share else w for w in own]
            at = rng.randrange(len(words))
            words[at:at] = own
        rows.append((k, " ".join(words)))

    def lcs(x, y):
        last = [0] * (len(y) + 1)
        for a in x:
            now = [0]
            for j, b in enumerate(y):
                now.append(last[j] + 1 if a == b else max(last[j + 1], now[-1]))
            last = now
        return last[-1]

    best = {(d, i): max(lcs(w[a : a + round(1.25 * len(t.split()))], t.split()) for a in range(len(w))) / len(t.split()) for d, text in rows for i, t in bench for w in [text.split()]}
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string"))
    got = set(rows_of(found, "doc_id", "item_id"))
    sure, never = {p for p, x in best.items() if x >= 0.85}, {p for p, x in best.items() if x < decontaminate.LCS - 0.1}
    assert len(sure) >= 10 and sure <= got and not got & never


def test_decontamination_of_short_and_very_long_items(spark):
    rng = random.Random(19)
    long = sentence(rng, 6000, 4000)
    bench = [(1, "quite short"), (2, "Single"), (3, "one two three four"), (4, long), (5, ""), (6, "!!"), (7, "quite short")]
    kept = long.split()
    bent = " ".join(w for k, w in enumerate(kept) if k % 9)
    rows = [(1, "a quite short text"), (2, "quite a short one"), (3, "x single"), (4, "one two three five"), (5, "ONE two, three four!"), (6, sentence(rng, 500) + " " + long), (7, bent), (8, "quite"), (9, "short quite")]
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string"))
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], r["last_word"]) for r in found.collect()}
    assert set(got) == {(1, 1), (1, 7), (3, 2), (5, 3), (6, 4), (7, 4)} and got[1, 7] == (1, 2) and got[6, 4] == (500, 6499)


def test_decontamination_of_cut_items(spark):
    rng = random.Random(13)
    bench = [(k, sentence(rng, rng.randrange(25, 70), 3000)) for k in range(30)]
    rows, kinds = [], {}
    for k in range(300):
        words = sentence(rng, rng.randrange(100, 300), 3000).split()
        if k % 3 == 0:
            i, t = bench[rng.randrange(30)]
            own = t.split()
            kind = ("first", "last", "new end")[k // 3 % 3]
            n = round(len(own) * 0.85)
            own = own[:n] if kind == "first" else own[-n:] if kind == "last" else own[: round(len(own) * 0.8)] + sentence(rng, len(own) // 5, 3000).split()
            at = rng.randrange(len(words))
            words[at:at] = own
            kinds[k, i] = kind
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = set(rows_of(decontaminate.find_leaks(df, spark.createDataFrame(bench, "item_id bigint, text string")), "doc_id", "item_id"))
    for kind in ("first", "last", "new end"):
        planted = {p for p, x in kinds.items() if x == kind}
        assert len(planted & got) >= 0.9 * len(planted), (kind, len(planted & got), len(planted))
    assert got <= set(kinds)
    assert decontaminate.longest_run([(0, 0), (1, 2), (2, 3), (3, 4), (9, 9)]) == 3


def test_lcs_and_latent_vectors():
    rng = random.Random(10)
    for _ in range(200):
        x, y = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = decontaminate.lcs_pairs(x, y)
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, c in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if a == c else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs_length(x, y) == len(pairs) == table[-1][-1] and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert all(x[i] == y[j] for i, j in pairs) and pairs == sorted(pairs)
    g = np.random.default_rng(0)
    a = g.standard_normal((300, 6)) @ g.standard_normal((6, 50))
    test = g.standard_normal((50, 12))
    v = decontaminate.leading_vectors(a.T @ (a @ test), test, 6)
    exact = np.linalg.svd(a, full_matrices=False)[2][:6].T
    assert np.linalg.norm(exact @ exact.T - v @ v.T) < 1e-6


# --- op10
def test_toxicity(spark, odd):
    rng = random.Random(11)
    bad = ["vile", "nasty", "rotten", "grim"]
    rows, labels = [], []
    for k in range(900):
        words, toxic = sentence(rng, rng.randrange(5, 80)).split(), rng.random() < 0.15
        if toxic:
            for _ in range(rng.randrange(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words)))
        if k % 3:
            labels.append((k, int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    made = {r["doc_id"]: r for r in toxicity.toxicity(df, lab).collect()}
    held = [(made[k], t) for k, t in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(m["held_out"] for m, _ in held) and all(made[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _ in rows)
    right = sum(m["predicted"] == t for m, t in held) / len(held)
    assert right >= 0.97, right
    assert all(m["predicted"] == int(m["score"] >= 0.5) and 0 <= m["score"] <= 1 for m in made.values())
    # scores word by word
    weights, bias = toxicity.fit(df, lab)
    hasher, begun = toxicity.hashers()
    bits = toxicity.BITS
    for k, t in rows[:60]:
        words = {w for w in re.findall(WORDS, low(t))}
        features = {int(hasher.words(w.encode())[2][0]) >> (65 - bits) for w in words} | {(1 << (bits - 1)) + (int(begun.words(w.encode())[2][0]) >> (65 - bits)) for w in words}
        z = sum(float(weights[f]) for f in features) + bias
        assert made[k]["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -40, 40))), abs=1e-9)
    # a small sample: the bound holds in bytes, and no more rows than asked for are learnt from
    weights, _ = toxicity.fit(df, lab, sample_bytes=2000)
    assert np.isfinite(weights).all()
    # held-out labels don't matter
    flipped = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity(df, flipped).collect()} == {k: m["score"] for k, m in made.items()}
    assert toxicity.toxicity(odd, lab).count() == odd.count() and toxicity.toxicity(odd.limit(0), lab).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(df, lab.limit(0)).collect()} == {0}
    kept = toxicity.drop_toxic(odd, lab)
    scores = {(r["doc_id"], r["score"]) for r in toxicity.toxicity(odd, lab).collect()}
    assert kept.columns == odd.columns and kept.count() == sum(r["predicted"] == 0 for r in toxicity.toxicity(odd, lab).collect())
    by = defaultdict(set)
    for i, s in scores:
        by[i].add(s)
    assert by[1] == by[2] == by[3] and by[7] == by[8] and by[4] == by[5] == by[9] and len(by[4]) == 1  # equal words, equal scores; no words, the bias


def test_nnpu_risk_is_not_negative():
    rng = np.random.default_rng(1)
    positive = [np.array([1, *rng.integers(10, 60, 5)]) for _ in range(40)]
    unlabelled = [np.unique(rng.integers(10, 60, 6)) for _ in range(300)] + [np.array([1, *rng.integers(10, 60, 5)]) for _ in range(30)]
    flat = lambda docs: (np.concatenate(docs).astype(np.int32), np.cumsum([0, *map(len, docs)]))
    w, b = toxicity.train(flat(positive), flat(unlabelled), 30 / 330, bits=8)
    assert w[1] + b > 0 > b
