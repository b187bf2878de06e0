"""Toxicity by non-negative positive-unlabelled learning (nnPU), a linear numpy classifier on hashed words and
word beginnings (``PREFIX`` bytes).

Training: confirmed toxic rows (label 1) against unlabelled text, which is any training row, whatever its label.
The risk is prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss; where the second term turns
negative its gradient is reversed. The class prior is the share of label 1 among the training rows' labels.
Rows with crc32(id as text) mod 5 = 0 take no part in training.

Features, ``MIN_Z``, ``EPOCHS`` and ``DECAY`` have the fewest errors on the training rows with remainder 1 when fitted on
those with remainders 2 to 4; the rows with remainder 0 have no part in that choice.

Sample bound (documented): about ``positives`` toxic and ``unlabelled`` other rows, and about ``sample_bytes`` of text on
either side, picked by a hash of the id, are sent to the driver as lists of hashed words; whole texts are used. Scores are
computed for every whole text.

Defined cases: a null or empty text has the score of the bias alone; repeated labels of an id count once
(the largest); without a toxic training row every score is the prior (0 if there are no labels); null ids are
never trained on and are scored; equal texts get equal scores; an empty table gives an empty result; other
columns aren't read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import ALNUM, WordHasher, slices, texts_of

BITS, POSITIVES, UNLABELLED, PREFIX = 18, 4000, 12000, 4
SAMPLE_BYTES = 64 << 20
EPOCHS, RATE, DECAY, MIN_DOCS, MIN_Z = 300, 0.05, 2e-4, 3, 3.0


def held_out(id_col):
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def hashers() -> tuple[WordHasher, WordHasher]:
    return WordHasher(ALNUM), WordHasher(ALNUM, prefix=PREFIX)


def document_features(texts: list, pair: tuple[WordHasher, WordHasher], bits: int):
    """Distinct hashed words and word beginnings of each text: (features, bounds) for runs of texts. Words fill
    the lower half of the table, beginnings the upper."""
    for (_, hashes, bounds), (_, begun, _) in zip(pair[0].documents(texts), pair[1].documents(texts), strict=True):
        which = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64) << np.uint64(bits), np.diff(bounds))
        shift, half = np.uint64(65 - bits), np.uint64(1 << (bits - 1))
        key = np.unique(np.concatenate([which | (hashes >> shift), which | half | (begun >> shift)]))
        ends = np.searchsorted(key, np.arange(len(bounds), dtype=np.uint64) << np.uint64(bits))
        yield (key & np.uint64((1 << bits) - 1)).astype(np.int64), ends


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[ends[1:]] - total[ends[:-1]]


def featurizer(bits: int):
    def run(batches):
        hasher = hashers()
        for batch in slices(batches):
            lists = []
            for features, ends in document_features(texts_of(batch), hasher, bits):
                lists += [features[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("mark"), pa.array(lists, pa.binary())], ["toxic", "mark", "features"])

    return run


def counts(values: np.ndarray, size: int, step: int = 1 << 20) -> np.ndarray:
    """Occurrences of each feature, a slice at a time."""
    total = np.zeros(size, dtype=np.int64)
    for at in range(0, len(values), step):
        total += np.bincount(values[at : at + step], minlength=size)
    return total


def train(positive: tuple, unlabelled: tuple, prior: float, bits: int = BITS, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights of the features, and the bias. Each side: the documents' features end to end, and their bounds."""
    size, (n_p, n_u) = 1 << bits, (len(positive[1]) - 1, len(unlabelled[1]) - 1)
    in_p, in_u = counts(positive[0], size), counts(unlabelled[0], size)
    # A feature counts as its share among toxic texts stands out from that in unlabelled ones, in standard errors.
    share = (in_p + in_u) / (n_p + n_u)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_p + 1 / n_u))
    z = np.abs(in_p / n_p - in_u / n_u) / error
    scale = np.where((in_p + in_u >= MIN_DOCS) & (z >= MIN_Z), z, 0.0)
    scale = np.minimum(1.0, scale / max(scale.max(), 1e-9) * 2)
    usable = scale > 0

    def pack(values, ends):
        kept = usable[values]
        return values[kept].astype(np.int64), np.concatenate([[0], np.cumsum(kept)])[ends]

    groups = [pack(*positive), pack(*unlabelled)]
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    soft = lambda z: np.logaddexp(0, z)
    for step in range(1, epochs + 1):
        ws = w * scale
        zp, zu = (sums(ws[f], e) + b for f, e in groups)
        negative = soft(zu).mean() - prior * soft(zp).mean()
        dp = -prior * sig(-zp) / len(zp)
        du = np.zeros(len(zu))
        if negative >= 0:
            dp = dp - prior * sig(zp) / len(zp)
            du = sig(zu) / len(zu)
        else:
            dp, du = prior * sig(zp) / len(zp), -sig(zu) / len(zu)
        g = sum(np.bincount(f, weights=np.repeat(d, np.diff(e)), minlength=size) for (f, e), d in zip(groups, (dp, du), strict=True)) * scale + decay * w
        gb = dp.sum() + du.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return (w * scale).astype(np.float32), float(b)


def scorer(model, bits: int):
    def run(batches):
        hasher = hashers()
        weights, bias = model.value
        for batch in slices(batches):
            out = [sums(weights[f].astype(np.float64), e) + bias for f, e in document_features(texts_of(batch), hasher, bits)]
            z = np.clip(np.concatenate([*out, np.zeros(0)]), -40, 40)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, sample_bytes: int = SAMPLE_BYTES, bits: int = BITS):
    """(weights, bias) learnt from the training folds."""
    labels = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, ones = labels.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("bigint")), F.lit(0))).first()
    if not ones:
        return np.zeros(1 << bits, dtype=np.float32), -40.0
    prior = min(max(ones / n, 1e-3), 1 - 1e-3)
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    toxic = labels.where("toxic = 1").select("doc_id", F.lit(True).alias("found"))
    sized = rows.select("doc_id", F.octet_length("text").alias("size")).join(toxic, "doc_id", "left").groupBy("found")
    sizes = {r["found"]: (r["n"], r["bytes"] or 0) for r in sized.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()}  # two rows
    both = tuple(map(sum, zip(*sizes.values(), strict=True))) if sizes else (0, 0)

    def part(most: int, n: int, size: int):
        share = min(1.0, most / max(1, n), sample_bytes / max(1, size))
        return F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * share)

    own = toxic.where(part(positives, *sizes.get(True, (0, 0)))).select("doc_id")
    own = F.broadcast(own) if own.count() <= 16 * positives else own  # ids; more only if most labels have no document
    picked = rows.join(own, "doc_id", "left_semi").withColumn("toxic", F.lit(1))
    picked = picked.unionByName(rows.where(part(unlabelled, *both)).withColumn("toxic", F.lit(0)))
    table = picked.select("toxic", F.xxhash64("doc_id", "text").alias("mark"), "text").mapInArrow(featurizer(bits), "toxic int, mark bigint, features binary").toArrow().sort_by([("mark", "ascending"), ("toxic", "ascending")])
    flag = table.column("toxic").to_numpy()
    if len(set(flag.tolist())) < 2:
        return np.zeros(1 << bits, dtype=np.float32), float(np.log(prior / (1 - prior)))
    return train(*(flat(table.column("features").filter(pa.array(flag == side))) for side in (1, 0)), prior, bits)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The lists of int32 in a binary column end to end, without a copy for each, and their bounds."""
    lists = column.combine_chunks().cast(pa.large_binary())
    ends = np.frombuffer(lists.buffers()[1], dtype=np.int64, count=len(lists) + 1, offset=8 * lists.offset)
    data = lists.buffers()[2]
    values = np.frombuffer(data, dtype=np.int32) if data is not None and data.size else np.zeros(0, np.int32)
    return values[ends[0] // 4 : ends[-1] // 4], (ends - ends[0]) // 4


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bits=bits, **options))  # 2**bits floats
    scored = docs.mapInArrow(scorer(model, bits), "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_filter(model, bits: int, text_col: str):
    def run(batches):
        hasher = hashers()
        weights, bias = model.value
        for batch in slices(batches, text_col):
            out = [sums(weights[f].astype(np.float64), e) + bias for f, e in document_features(texts_of(batch, text_col), hasher, bits)]
            yield batch.filter(pa.array(np.concatenate([*out, np.zeros(0)]) < 0, pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, **options) -> DataFrame:
    """The documents that aren't predicted toxic, all columns, no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), labels, bits=bits, **options))
    return docs.mapInArrow(clean_filter(model, bits, text_col), docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
