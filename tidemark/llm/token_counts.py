"""Token counts of sections by offset-mapped attribution.

Each whole document is encoded once. Token spans follow from the tokens' byte lengths (byte-level BPE: the spans tile
the text), and are interval-joined to the document's sections by binary search. Sections are the text's lines
(``section_tokens``), spans of characters given in a column (its ``spans``), or the fields of a record that are encoded
as one text (``field_tokens``). A token that crosses a boundary is allocated by an explicit rule: ``first`` to the
section of its first byte, ``last`` to that of its last, ``most`` to the one that holds most of its bytes (the earlier of
equals). Counts so add up to the document's tokens, which separate encodings of sections wouldn't.

Lines: a section is a line with its line break; the part after the last break is a section if it isn't empty; a text
without any character is one empty section. Given spans may leave gaps and overlap: their ends cut the text into
pieces, tokens go to pieces by the rule, and a span has the tokens of its pieces. Spans are [first, end) in characters
and are clipped to the text; a null span, end or one that ends before it begins is empty where it begins.

Defined cases: a null text is empty; null and repeated ids are passed on; a document without spans (null or empty list)
has no rows; an empty section has 0 tokens; an empty table gives an empty result; other columns aren't read.
"""

import base64

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import slices

RULES = ("first", "last", "most")
SCHEMA = "doc_id bigint, section bigint, first_byte bigint, n_bytes bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint"


def rank_file() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def load(path: str, pattern: str):
    """(encoding, bytes of each id)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    width[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), width


def line_starts(data: bytes) -> np.ndarray:
    breaks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
    return np.concatenate([[0], breaks[breaks < len(data)]])


def attribute(ends: np.ndarray, starts: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary. ends: of the tokens, which tile the text;
    starts: of the sections, which tile it too."""
    begins = np.concatenate([[0], ends])[:-1].astype(np.int64)
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    own = last.copy() if rule == "last" else first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "most":
        limit = np.append(starts, ends[-1] if len(ends) else 0)
        for t in crossing.tolist():
            held = [min(limit[s + 1], ends[t]) - max(limit[s], begins[t]) for s in range(first[t], last[t] + 1)]
            own[t] = first[t] + int(np.argmax(held))
    return np.bincount(own, minlength=len(starts)), np.bincount(own[crossing], minlength=len(starts))


def span_bytes(text: str, data: bytes, spans: list) -> tuple[np.ndarray, np.ndarray]:
    """First and end bytes of [first, end) spans of characters."""
    n = len(text)
    clip = lambda x: min(max(x, 0), n)
    first = np.array([clip(s["first"] or 0) if s else 0 for s in spans], dtype=np.int64)
    end = np.array([clip(s["end"]) if s and s["end"] is not None else 0 for s in spans], dtype=np.int64)
    if len(data) != n:  # the byte at which each character begins
        begins = np.append(np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80), len(data))
        first, end = begins[first], begins[end]
    return first, np.maximum(first, end)


def attribute_spans(ends: np.ndarray, first: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and tokens that cross a boundary, of byte spans that may leave gaps and overlap."""
    size = int(ends[-1]) if len(ends) else 0
    cuts = np.unique(np.concatenate([[0], first, end]))
    starts = cuts[cuts < size] if size else cuts[:1]
    tokens, crossing = attribute(ends, starts, rule)
    upto = lambda x, at: np.concatenate([[0], np.cumsum(x)])[np.searchsorted(starts, at)]
    return upto(tokens, end) - upto(tokens, first), upto(crossing, end) - upto(crossing, first)


def counter(path: str, pattern: str, rule: str, spans: bool = False):
    def run(batches):
        import pyarrow as pa

        encoding, width = load(path, pattern)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in slices(batches):
            columns: list[list] = [[] for _ in names]
            which = []
            given = batch.column("spans").to_pylist() if spans else None
            for row, text in enumerate(batch.column("text").to_pylist()):
                text = text or ""
                data = text.encode()
                ids = np.frombuffer(encoding.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)
                ends = np.cumsum(width[ids])
                if spans:
                    first, end = span_bytes(text, data, given[row] or [])
                    tokens, crossing = attribute_spans(ends, first, end, rule)
                else:
                    first = line_starts(data)
                    end = np.append(first[1:], len(data))
                    tokens, crossing = attribute(ends, first, rule)
                which.append(np.full(len(first), row))
                for c, x in zip(columns[1:], (np.arange(len(first)), first, end - first, tokens, crossing, np.full(len(first), len(ids))), strict=True):
                    c.append(x)
            if which:
                arrays = [pa.array(np.concatenate(c).astype(np.int64)) for c in columns[1:]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.concatenate(which))), *arrays], names)

    return run


def section_tokens(docs: DataFrame, rule: str = "first", id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None, ranks: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, section, first_byte, n_bytes, n_tokens, n_crossing, doc_tokens): a row per section. Sections are lines, or
    the spans in ``spans_col``: array<struct<first, end>> of characters, section being a span's index."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(spans_col).alias("spans")] if spans_col else []))
    return rows.mapInArrow(counter(*(ranks or rank_file()), rule, spans_col is not None), SCHEMA)


def field_tokens(docs: DataFrame, fields: list[str], separator: str = "\n", rule: str = "first", id_col: str = "doc_id", ranks: tuple[str, str] | None = None) -> DataFrame:
    """Tokens of each field of a record whose fields are encoded as one text, with ``separator`` between them; adds the
    field's name. Null fields are empty; separators are in no field."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    spans, at = [], F.lit(0)
    for p in parts:
        spans.append(F.struct(at.cast("bigint").alias("first"), (at + F.char_length(p)).cast("bigint").alias("end")))
        at = at + F.char_length(p) + len(separator)
    whole = docs.select(F.col(id_col).alias("doc_id"), F.concat_ws(separator, *parts).alias("text"), F.array(*spans).alias("spans"))
    made = section_tokens(whole, rule, spans_col="spans", ranks=ranks)
    return made.withColumn("field", F.element_at(F.array(*map(F.lit, fields)), (F.col("section") + 1).cast("int")))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
