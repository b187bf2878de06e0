"""Token-ID output: Parquet files of token lists in ascending id order, and reads of them.

Layout. Documents are range-partitioned by id, encoded in order and written one file per range. Columns: doc_id,
part (the range), offset (ids in the part before the document), n_tokens and ids (list<int32>). ids is
dictionary encoded while its dictionary fits a page and delta encoded beyond (Parquet v2 pages); the others are
delta encoded. Row groups and pages are bounded (``ROW_GROUP``, ``PAGE``), and the writer adds page indexes, so a
reader fetches the few pages of a document by doc_id, or the metadata columns without any tokens. A document's
place in the whole stream is its part's base (a running sum of the parts' totals) plus its offset.

Encoding. No pre-token of this kind of tokenizer spans white space. A slice of texts is cut as bytes, by what the pattern
takes ASCII and those letters and signs below U+0500 for that the encoder finds, when it starts, to be treated as the
library does it. Equal words are found by one hashing of the slice beside the known words; only new ones are normalised and
go to the library's model, many in a call (a bounded cache per worker, a small one for few words); a long text is taken in
segments. A run between ASCII blanks that holds any other character, an apostrophe or the string of a special token goes
to the library's ``encode`` as it is. All give the library's own ids.

Defined cases: a null text is empty and has the end id alone; null ids come first and repeated ids stand together,
ordered by their text; an empty table gives an empty result; other columns aren't read.
"""

import json
import re
import uuid
from functools import lru_cache
from unicodedata import normalize

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import _written, shared_dir, shuffle_width
from ._words import slices

END_ID = 1
ROW_GROUP, PAGE, CACHE = 16 << 20, 256 << 10, 400_000
LONG, CALL, FEW = 64, 1 << 14, 1 << 12  # most ids of a string that is kept when a cache is full; strings in a call of the library; a small cache
SLICE, SEGMENT = 1 << 14, 16 << 20  # most texts in a slice, whose bytes slices() bounds; bytes that are cut together
BLANKS = " \t\n\x0b\x0c\r"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BLANK, LETTER, NUMBER, OTHER, ODD = range(5)
TOP = 0x500  # characters from here on are odd
SCHEMA = "doc_id bigint, part int, offset bigint, n_tokens int, ids array<int>"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Known:
    """Ids of distinct strings. Given strings are found by one hashing of the known and the given ones, so that only a new
    one becomes a Python value. ``make`` gets new strings, and which are odd; it gives ids and their number for each."""

    def __init__(self, make, limit: int):
        import pyarrow as pa

        self.make, self.limit = make, limit
        self.strings, self.flat = pa.array([], pa.string()), np.zeros(0, np.int32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, values, odd: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all values one after the other, the end of each value's)."""
        import pyarrow as pa

        n = len(self.strings)
        found = pa.chunked_array([*([self.strings] if n else []), values]).dictionary_encode().chunk(1 if n else 0)
        at = found.indices.to_numpy()
        if len(found.dictionary) > n:
            strange = np.zeros(len(found.dictionary), dtype=bool)
            if odd is not None:
                strange[at[odd]] = True
            flat, sizes = self.make(found.dictionary.slice(n).to_pylist(), strange[n:])
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.strings, self.flat, self.sizes = found.dictionary, np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        out = self.flat[_places(self.starts[at], sizes, ends)]
        if len(self.strings) > self.limit or len(self.flat) > 8 * self.limit:
            self._forget(at)
        return out, ends

    def _forget(self, at: np.ndarray) -> None:
        """Keep the short strings that the last call gave more than once, if they leave room."""
        import pyarrow as pa

        keep = np.flatnonzero((np.bincount(at, minlength=len(self.sizes)) > 1) & (self.sizes <= LONG))
        if len(keep) > self.limit // 2:
            keep = keep[:0]
        sizes = self.sizes[keep]
        ends = np.cumsum(sizes)
        self.flat = self.flat[_places(self.starts[keep], sizes, ends)]
        self.strings, self.starts, self.sizes = self.strings.take(pa.array(keep)), ends - sizes, sizes


def _places(starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the runs that begin at ``starts``."""
    out = np.repeat(starts - (ends - sizes), sizes)
    out += np.arange(len(out))
    return out


def _by_library(tokenizer, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, their number for each) of strings that the tokenizer encodes one by one."""
    ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(strings), CALL):
        part = strings[at : at + CALL]
        made = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
        ids.append(np.array(made.ids, dtype=np.int32))
        sizes.append(np.bincount(np.array(made.word_ids, dtype=np.int64), minlength=len(part)))
    return np.concatenate(ids), np.concatenate(sizes)


class PieceEncoder:
    """Ids of texts under a BPE of words."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        state = json.loads(self.whole.to_str())
        split, level = state["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in state["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or level["type"] != "ByteLevel" or level["add_prefix_space"] or split["pattern"] != {"Regex": PATTERN}:
            raise ValueError("this encoder is for NFC, lower case, words split by its pattern and byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or set(t["content"]) & set(BLANKS) for t in state["added_tokens"]):
            raise ValueError("this encoder is for special tokens that stand for their own string alone")
        self.special = [t["content"].encode() for t in state["added_tokens"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE shows as themselves
        rest = iter(range(256, 512))
        self.letter = {b: b if b in plain else next(rest) for b in range(256)}
        self.letter[10] = 10  # stands between words
        self.model = Tokenizer.from_str(json.dumps({**state, "normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
        self._classes()
        self.words, self.few = Known(self._make, cache), Known(self._make, min(cache, FEW))

    def _classes(self) -> None:
        """What the pattern takes each character below U+0500 for. Odd are all that this encoder doesn't treat, alone or
        beside others, as the library does. Combining marks, final sigma and dotted I depend on what stands beside them."""
        import regex

        of = regex.compile(r"(\p{L})|(\p{N})|.", regex.DOTALL)
        kind = [of.match(chr(c)).lastindex or OTHER for c in range(TOP)]
        tried = [c for c in (*range(0x80, 0x300), *range(0x370, TOP)) if c not in (0x85, 0x3A3, 0x130) and chr(c).isprintable() and normalize("NFD", chr(c))[0] != "\u0308"]
        self.kind = np.full(256, ODD, dtype=np.uint8)
        self.kind[:128] = kind[:128]
        self.kind[list(map(ord, BLANKS))] = BLANK
        self.kind[[0x1C, 0x1D, 0x1E, 0x1F, ord("'")]] = ODD  # separators; what may begin a clitic
        self.pairs = np.full(TOP, ODD, dtype=np.uint8)
        self.pairs[tried] = np.array(kind)[tried]
        self.words = self.few = Known(self._make, CACHE)
        beside = [x for c in map(chr, tried) for x in (c, f"a{c}", f"{c}a", f"a{c}b", f"1{c}2", f"{c}.", f"{c},", f"-{c}-", f"{c}{c}", f"{c}s's")]
        own, library = (np.split(ids, np.cumsum(sizes)[:-1]) for ids, sizes in (self.texts(beside), _by_library(self.whole, beside)))
        same = np.array([np.array_equal(x, y) for x, y in zip(own, library, strict=True)]).reshape(len(tried), -1).all(axis=1)
        self.pairs[np.array(tried)[~same]] = ODD

    def _make(self, strings: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if odd.any():
            own, library = self._make([s for s, o in zip(strings, odd, strict=True) if not o], np.zeros(1, bool)), _by_library(self.whole, [s for s, o in zip(strings, odd, strict=True) if o])
            sizes = np.zeros(len(strings), dtype=np.int64)
            sizes[~odd], sizes[odd] = own[1], library[1]
            ids, whose = np.zeros(sizes.sum(), dtype=np.int32), np.repeat(odd, sizes)
            ids[~whose], ids[whose] = own[0], library[0]
            return ids, sizes
        if not strings:
            return _by_library(self.model, [])
        text = "\n".join(strings)
        text = (text if text.isascii() else normalize("NFC", text)).lower()
        return _by_library(self.model, text.encode().decode("latin-1").translate(self.letter).split("\n"))

    def _cut(self, data: np.ndarray, offsets: np.ndarray):
        """Words of texts that stand one after the other: (strings, which are odd, number of words before each text). A
        run between blanks that holds an odd character or a special token is one odd word."""
        import pyarrow as pa

        n, begins = len(data), offsets[:-1][offsets[:-1] < len(data)]
        kind = self.kind[data]
        lead = np.flatnonzero((data >= 0xC2) & (data < 0xC0 + TOP // 64))
        kind[lead] = kind[lead + 1] = self.pairs[(data[lead] & 31).astype(np.int64) << 6 | data[lead + 1] & 63]
        raw = data.tobytes()
        for special in self.special:
            at = raw.find(special)
            while at >= 0:
                kind[at] = ODD
                at = raw.find(special, at + 1)
        start = kind == NUMBER
        start[lead + 1] = False
        start[1:] |= kind[1:] != kind[:-1]
        start[begins] = True
        solid, odd = kind != BLANK, None
        if len(at := np.flatnonzero(kind == ODD)):
            edge = ~solid
            edge[1:] |= edge[:-1]
            edge[begins] = True  # blanks, what follows them, beginnings
            edges = np.append(np.flatnonzero(edge), n)
            which = np.unique(np.searchsorted(edges, at, side="right"))
            inside = np.zeros(n + 1, dtype=np.int8)
            inside[edges[which - 1]] += 1
            inside[edges[which]] -= 1
            odd = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
            start &= ~odd
            start[edges[which - 1]] = True
        first = np.flatnonzero(start[solid])
        if odd is not None:
            odd = odd[solid][first]
        text = data[solid]
        strings = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(text)).astype(np.int32)), pa.py_buffer(text))
        return strings, odd, np.searchsorted(np.flatnonzero(start & solid), offsets)

    def texts(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, the number of each text's); null is empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        ids, sizes = [np.zeros(0, np.int32)], np.zeros(len(texts), dtype=np.int64)
        data, offsets = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
        for a, b in self._segments(data):
            strings, odd, bounds = self._cut(data[a:b], np.clip(offsets, a, b) - a)
            if len(strings):
                known = self.words if 4 * len(strings) >= len(self.words.strings) else self.few  # few words: not for the price of all
                part, ends = known.ids(strings, odd)
                ids.append(part)
                sizes += np.diff(np.append(0, ends)[bounds])
        return ids[1] if len(ids) == 2 else np.concatenate(ids), sizes

    def _segments(self, data: np.ndarray):
        """Ranges of about ``SEGMENT`` bytes that end after a blank, so that a long text needs no more memory at once."""
        a = 0
        while a < len(data):
            b = a + SEGMENT
            while b < len(data) and not (blank := np.flatnonzero(self.kind[data[b - SEGMENT : b]] == BLANK)).size:
                b += SEGMENT
            b = b - SEGMENT + int(blank[-1]) + 1 if b < len(data) else len(data)
            yield a, b
            a = b

    def text(self, text: str) -> bytes:
        return self.texts([text])[0].astype("<i4", copy=False).tobytes()


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> PieceEncoder:
    """One for all tasks of a worker."""
    return PieceEncoder(path)


def encoder(path: str, end_id: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part, offset = shared_encoder(path).texts, TaskContext.get().partitionId(), 0
        for batch in slices(batches, rows=SLICE):
            flat, sizes = encode(batch.column("text"))
            flat, sizes = np.insert(flat, np.cumsum(sizes), end_id), sizes + 1
            ends = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            columns = [batch.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(ends[:-1] + offset), pa.array(sizes.astype(np.int32)), ids]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "offset", "n_tokens", "ids"])
            offset += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents' token lists to ``path`` in ascending id order."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    mark = F.xxhash64("text")
    parts = parts or shuffle_width(docs.sparkSession)
    ordered = rows.withColumn("mark", mark).repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "mark").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "mark").drop("mark")
    tokens = ordered.mapInArrow(encoder(tokenizer or tokenizer_path(), end_id), SCHEMA)
    options = {"parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": PAGE}
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "offset", "n_tokens")}
    tokens.write.options(compression="zstd", **options, **plain).parquet(path)


def read_starts(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) without reading a token."""
    rows = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "offset", "n_tokens")
    return rows.join(_bases(rows), "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), F.col("n_tokens").cast("bigint").alias("n_tokens"))


def _bases(rows: DataFrame) -> DataFrame:
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row per file
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def read_tokens(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def checksums(batches):
    import zlib

    import pyarrow as pa

    for batch in batches:
        lists = batch.column("ids")
        values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))]).tolist()
        data = memoryview(values.tobytes())
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "offset", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "part", "offset", "n_tokens", "ids_crc32"])


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/llm-tokens-{uuid.uuid4().hex}"
    _written.append((spark, path))
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    sums = read_tokens(spark, path).mapInArrow(checksums, "doc_id bigint, part int, offset bigint, n_tokens int, ids_crc32 bigint")
    bases = _bases(read_tokens(spark, path).select("part", "n_tokens"))
    return sums.join(bases, "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), F.col("n_tokens").cast("bigint").alias("n_tokens"), "ids_crc32")
