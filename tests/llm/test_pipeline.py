"""The pipeline: stages in order, each against its own input, on the smallest tables and on odd rows."""

import random
import re
from collections import Counter
from functools import partial
from pathlib import Path

import pytest

import corpus_pipeline
from tidemark.llm import decontaminate, near_dedup, toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    steps = dict(corpus_pipeline.STAGES)
    one = steps["toxicity"](spark, docs, DATA)
    bad = ids(toxicity.toxicity(docs, labels).where("predicted = 1"))
    assert one.columns == docs.columns and ids(one) == ids(docs) - bad
    two = steps["near_dedup"](spark, one, DATA)
    assert two.columns == docs.columns and ids(two) == ids(near_dedup.near_components(one).where("kept"))
    three = steps["decontamination"](spark, two, DATA)
    assert three.columns == docs.columns and ids(three) == ids(two) - ids(decontaminate.find_leaks(two, bench))
    four = steps["mixing"](spark, three, DATA)
    assert four.columns == docs.columns and ids(four) <= ids(three)
    five = steps["sharding"](spark, four, DATA)
    assert five.count() == four.count()
    assert corpus_pipeline.run(spark, DATA).count() == five.count()


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def test_stages_against_brute_force(spark):
    """Each stage's rows by plain Python over all pairs, without the operators."""
    steps = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r["text"].lower() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets, root = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    two = steps["near_dedup"](spark, docs, DATA)
    assert ids(two) == {i for i in rows if find(i) == i}
    three = {r["doc_id"]: r["text"] for r in steps["decontamination"](spark, two, DATA).collect()}
    plain = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())) + " "
    holds = lambda t: any(plain(x) in plain(t) for x in items)
    assert not any(holds(t) for t in three.values())
    gone = ids(two) - set(three)
    assert {i for i in ids(two) if holds(rows[i])} <= gone and len(gone) <= 2 + sum(holds(rows[i]) for i in ids(two))
    four = steps["mixing"](spark, two, DATA)
    before, after, names = Counter(), Counter(), {}
    for r in two.collect():
        before[r["source"]] += words(r["text"])
        names[r["doc_id"]] = r["source"]
    times = Counter(r["doc_id"] for r in four.collect())
    for i, n in times.items():
        after[names[i]] += n * words(rows[i])
    assert max(times.values()) <= 3
    order = sorted((s for s in before if s is not None), key=lambda s: s.encode()) + [None] * (None in before)
    weight, total = {s: k % 3 + 1 for k, s in enumerate(order)}, sum(before.values())
    full: set = set()
    while True:
        left, free = total - sum(3 * before[s] for s in full), sum(weight[s] for s in order if s not in full)
        want = {s: 3 * before[s] if s in full else left * weight[s] / free for s in order}
        more = {s for s in order if want[s] > 3 * before[s] and s not in full}
        if not more:
            break
        full |= more
    most = {s: max(words(rows[i]) for i in names if names[i] == s) for s in order}
    assert all(abs(after[s] - want[s]) <= most[s] / 2 + 0.01 * want[s] + 60 for s in order)
    five = steps["sharding"](spark, four, DATA).collect()
    counts = Counter(r["shard"] for r in five)
    assert len(five) == sum(times.values()) and Counter(r["doc_id"] for r in five) == times
    assert max(counts.values()) - min(counts.get(k, 0) for k in range(24)) <= 1


def test_near_dedup_stage_on_a_crowded_bucket(spark, monkeypatch):
    """Pages of one template, all in one bucket: one of each group stays, though its pages share no second band."""
    rng = random.Random(41)
    template, rows = [f"t{k}" for k in range(150)], []
    for k in range(30):
        own = [f"f{k}w{j}" for j in range(40)]
        rows += [(100 * k + m, " ".join([*template, *own[: 40 - rng.randrange(9)], *(f"x{k}y{m}z{j}" for j in range(rng.randrange(30)))])) for m in range(3)]
    sets = near_dedup.shingle_sets([t.encode() for _, t in rows], 5, near_dedup.WordHasher(near_dedup.BLANK_SPLIT))
    least = [int(near_dedup.minhash(x, *near_dedup.permutations(1))[0]) for x in sets]
    rows = [(i, t, "en", "a", 1) for (i, t), x in zip(rows, least, strict=True) if x == Counter(least).most_common(1)[0][0]]
    held, root = {i: shingles(t) for i, t, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in held:
        for b in held:
            if a < b and 100 * len(held[a] & held[b]) >= 80 * len(held[a] | held[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    stay = {i for i in held if find(i) == i}
    assert len(held) > 40 and 20 < len(stay) < len(held) - 10
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    monkeypatch.setattr(corpus_pipeline, "one_of_each", partial(near_dedup.one_of_each, bands=1, rows=1, block=8, large=0))
    assert ids(corpus_pipeline.near_dedup(spark, df, DATA)) == stay


def test_near_dedup_stage_leaves_no_candidate_to_chance(spark, monkeypatch):
    """What signatures call doubtful is decided on full sets: pairs at the threshold that they reject, one by one and, in
    one bucket, in blocks."""
    schema, hasher = "doc_id bigint, text string, lang string, source string, n_chars bigint", near_dedup.WordHasher(near_dedup.BLANK_SPLIT)
    steps, turns, rows = near_dedup.least_matches(0.8, 192, 32, 1e-4), near_dedup.permutations(192), []
    for k in (1849, 3444, 4308):
        words = [f"p{k}w{j}" for j in range(54)]
        pair = [" ".join(words), " ".join(words[:44])]
        assert 100 * len(shingles(pair[0]) & shingles(pair[1])) == 80 * len(shingles(pair[0]) | shingles(pair[1]))
        x, y = ((near_dedup.minhash(g, *turns) & 0xFFFF).astype("uint16") for g in near_dedup.shingle_sets([t.encode() for t in pair], 5, hasher))
        assert (x == y).reshape(32, 6).all(axis=1).any() and not len(near_dedup.survivors(x[None], y[None], steps))
        rows += [(2 * k, pair[0], "en", "a", 1), (2 * k + 1, pair[1], "en", "a", 1)]
    got = ids(corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, schema), DATA))
    assert got == {2 * k for k in (1849, 3444, 4308)}

    rng, made = random.Random(42), []
    template = [f"t{k}" for k in range(600)]
    for k in range(32):  # some sets need longer sketches than others
        own = [f"f{k}w{j}" for j in range(60 + 30 * (k % 5))]
        made += [" ".join([*template[: 150 * (1 + k % 4)], *own[: len(own) - rng.randrange(9)], *(f"x{k}y{m}z{j}" for j in range(rng.randrange(60)))]) for m in range(4)]
    least = [int(near_dedup.minhash(x, *near_dedup.permutations(1))[0]) for x in near_dedup.shingle_sets([t.encode() for t in made], 5, hasher)]
    made = [t for t, x in zip(made, least, strict=True) if x == Counter(least).most_common(1)[0][0]]
    held, root = [shingles(t) for t in made], list(range(len(made)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(made)):
        for b in range(a):
            if 100 * len(held[a] & held[b]) >= 80 * len(held[a] | held[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    stay = {i for i in range(len(made)) if find(i) == i}
    assert len(made) > 40 and 10 < len(stay) < len(made) - 10
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(made)], schema)
    for large in (0, 4096):
        monkeypatch.setattr(corpus_pipeline, "one_of_each", partial(near_dedup.one_of_each, bands=1, rows=1, miss=0.5, block=8, large=large))
        assert ids(corpus_pipeline.near_dedup(spark, df, DATA)) == stay


def test_stages_on_empty_and_odd_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (1, None, "en", None, 0), (2, "", None, "a", None), (3, "x" * 200_000, "en", "a", 1)]
    for df in (docs.limit(0), spark.createDataFrame(rows, docs.schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, DATA)
            assert name == "sharding" or out.columns == docs.columns
            out.count()
