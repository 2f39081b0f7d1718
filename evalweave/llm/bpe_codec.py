"""Byte-level BPE encoding by a table of distinct words, and decoding by a table of pieces.

The tokenizer never merges across the words of its pre-tokenizer, so a text's ids are its
words' ids one after another. Texts are split and cut into chunks; a chunk keeps its words as
numbers into a list of its distinct words, and that list is dealt into buckets by a hash of
the word. A bucket sees each of its words once per chunk, encodes it once, and answers every
chunk's list with ids in the list's order; chunks then join these ids to their words by
position. Decoding looks every id up in the table of pieces.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from evalweave.llm.packed import pack, pack_bytes, runs, unpack, unpack_bytes
from evalweave.llm.packing import TextIds, _byte_values
from evalweave.llm.shared import written
from evalweave.llm.words import slices

# Words of a chunk; a longer text is a chunk by itself.
WORDS_AT_ONCE = 4_000_000
_ID = 4

# Fixed value: the words of byte-level tokenizers of this kind.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """What a tokenizers file says about words, ids and pieces."""

    def __init__(self, path: str) -> None:
        self.ids = TextIds(path)
        library = self.ids.library
        flags = ("single_word", "lstrip", "rstrip")
        added = library.get_added_tokens_decoder()
        if self.ids.fast is None or any(getattr(t, f) for t in added.values() for f in flags):
            raise ValueError("not a byte-level tokenizer of the kind this operator splits")
        self.before = library.pre_tokenizer
        self.words = regex.compile(_WORDS)
        values = _byte_values()
        special = {i: t.content for i, t in added.items()}
        pieces = []
        for i in range(library.get_vocab_size()):
            piece = special.get(i) or library.id_to_token(i)
            # A piece that is not written in the byte alphabet stands for itself.
            plain = i in special or any(c not in values for c in piece)
            pieces.append(piece.encode() if plain else bytes(values[c] for c in piece))
        self.pieces = pa.array(pieces, pa.large_binary())
        self.numerals = pa.array([b"%d," % i for i in range(len(pieces))], pa.large_binary())

    def _part(self, text: str) -> list[str]:
        if text.isascii() or not any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self.words.findall(text)
        # Characters newer than the expression's tables: the library's own words.
        return [text[a:b] for _, (a, b) in self.before.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        """The words of a text; strings of added tokens are words by themselves."""
        if self.ids.cut is None or not any(mark in text for mark in self.ids.special):
            return self._part(text)
        parts = self.ids.cut.split(text)
        return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self._part(p))]

    def joined(self, table: pa.Array, ids: np.ndarray, firsts: np.ndarray) -> list[bytes]:
        """Entries of a table at the ids of each text, one after another.

        ``firsts`` bounds the ids of each text.
        """
        found = table.take(pa.array(ids))
        _, bounds, data = found.buffers()
        ends = np.frombuffer(bounds, np.int64)[found.offset : found.offset + len(ids) + 1]
        at = ends[firsts]
        data = memoryview(data or b"")
        return [bytes(data[a:b]) for a, b in zip(at, at[1:])]


# One per worker process, which serves many tasks.
_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


class _Numbers(dict):
    """Numbers words as they first appear."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _listed(words: list[bytes]) -> bytes:
    """A list of words as compressed bytes: lengths, and texts one after another."""
    lengths = pack(np.array([*map(len, words)], np.int64))
    return len(lengths).to_bytes(4, "little") + lengths + pack_bytes(b"".join(words))


def _unlisted(data: bytes) -> list[bytes]:
    at = 4 + int.from_bytes(data[:4], "little")
    ends = np.cumsum(unpack(data[4:at]), dtype=np.int64)
    texts = unpack_bytes(data[at:])
    return [texts[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _chunks(docs: DataFrame, path: str, buckets: int, id_kind: str) -> DataFrame:
    """Some documents per row: the numbers of their words, and the distinct words by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = codec(path).split
        task, n_chunks = TaskContext.get().partitionId(), 0
        numbers, ids, lengths, held = _Numbers(), [], [], []

        def done() -> pa.RecordBatch:
            nonlocal numbers, ids, lengths, held, n_chunks
            # Frequent words get small numbers, and words that are about as frequent stand
            # in alphabetical order: both compress well.
            number = np.concatenate(held) if held else np.zeros(0, np.int32)
            classes = np.log2(np.bincount(number, minlength=len(numbers)).clip(1)).astype(int).tolist()
            words = [w.encode() for w in numbers]
            by_count = sorted(range(len(words)), key=lambda i: (-classes[i], words[i]))
            rank = np.empty(len(by_count), np.int64)
            rank[by_count] = np.arange(len(by_count))
            words = [words[i] for i in by_count]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            kinds, first = np.unique(bucket[order], return_index=True)
            lists = np.split(order, first[1:]) if len(kinds) else []
            row = [
                pa.array([task << 20 | n_chunks], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.concat_arrays(ids)),
                pa.array([pack(np.array(lengths, np.int64), "<i8")], pa.binary()),
                pa.array([pack(rank[number])], pa.binary()),
                pa.array([pack(bucket)], pa.binary()),
                pa.array([kinds.tolist()], pa.list_(pa.int32())),
                pa.array([[_listed([words[i] for i in some]) for some in lists]], pa.list_(pa.binary())),
            ]
            numbers, ids, lengths, held, n_chunks = _Numbers(), [], [], [], n_chunks + 1
            return pa.RecordBatch.from_arrays(row, names)

        size = 0
        for batch in batches:
            for part in slices(batch, 1):
                ids.append(part[0])
                for text in part[1].to_pylist():
                    words = split(text)
                    lengths.append(len(words))
                    held.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    size += len(words)
                if size >= WORDS_AT_ONCE:
                    yield done()
                    size = 0
        if ids:
            yield done()

    names = ["chunk", "ids", "lengths", "numbers", "word_buckets", "buckets", "words"]
    return docs.mapInArrow(
        run,
        f"chunk long, ids array<{id_kind}>, lengths binary, numbers binary, word_buckets binary, "
        "buckets array<int>, words array<binary>",
    )


def _encoded(lists: DataFrame, path: str) -> DataFrame:
    """Ids of each listed word, in the list's order; a word is encoded once per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path).ids.of
        known: dict[bytes, bytes] = {}
        current = None
        for batch in batches:
            for chunk, bucket, words in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != current:
                    known, current = {}, bucket
                found = []
                for word in _unlisted(words):
                    if word not in known:
                        known[word] = of(word.decode())
                    found.append(known[word])
                lengths = np.fromiter(map(len, found), np.int64, len(found)) // _ID
                row = [
                    pa.array([chunk], pa.int64()),
                    pa.array([bucket], pa.int32()),
                    pa.array([pack(lengths)], pa.binary()),
                    pa.array([pack(np.frombuffer(b"".join(found), "<u4"))], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(row, ["chunk", "bucket", "n_ids", "word_ids"])

    dealt = lists.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "chunk long, bucket int, n_ids binary, word_ids binary")


def encode_decode(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int | None = None,
) -> DataFrame:
    """``(id, n_tokens, ids, decoded)`` for every row: its ids, little-endian unsigned 32-bit
    integers, and the text that they decode to.

    ``path`` names a byte-level file of the tokenizers library that every executor can open; a
    file of another kind raises ``ValueError``. Strings of added tokens in a text become those
    tokens. A NULL text counts as empty (no ids, empty text), a NULL id stays NULL, repeated
    rows give a row each, an empty table gives none, and other columns are ignored whatever
    their names. A task holds one chunk (``WORDS_AT_ONCE`` words, or one text) or the distinct
    words of one of ``buckets`` buckets: as many as shuffle partitions by default.
    """
    chunks = _coded(docs, path, id_col, text_col, buckets)
    id_kind = docs.schema[id_col].dataType.simpleString()
    return _evaluated(chunks, path, id_col, id_kind, digests=False)


def digests(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int | None = None,
) -> DataFrame:
    """As ``encode_decode``, with SHA-256 digests of the decimal ids joined by commas
    (``ids_sha256``) and of the decoded text (``decoded_sha256``) in place of both."""
    chunks = _coded(docs, path, id_col, text_col, buckets)
    id_kind = docs.schema[id_col].dataType.simpleString()
    return _evaluated(chunks, path, id_col, id_kind, digests=True)


def _coded(docs: DataFrame, path: str, id_col: str, text_col: str, buckets: int | None) -> tuple[DataFrame, DataFrame]:
    """Chunks of words, and the ids of their distinct words."""
    spark = docs.sparkSession
    codec(path)  # fails on the driver for other kinds of files
    if buckets is None:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    chunks = written(_chunks(rows, path, buckets, id_kind), "bpe-chunks")
    lists = chunks.select("chunk", F.explode(F.arrays_zip("buckets", "words")).alias("x"))
    return chunks, _encoded(lists.select("chunk", F.col("x.buckets").alias("bucket"), "x.words"), path)


def _evaluated(coded: tuple[DataFrame, DataFrame], path: str, id_col: str, id_kind: str, digests: bool) -> DataFrame:
    """Join a chunk's ids to its words by position, and decode them."""
    chunks, answers = coded

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        known = codec(path)
        right = right.sort_by("bucket")
        lengths = [unpack(x) for x in right["n_ids"].to_pylist()]
        found = [unpack(x, "<u4") for x in right["word_ids"].to_pylist()]
        empty = np.zeros(0, np.int64)
        n_ids, word_ids = np.concatenate([empty, *lengths]).astype(np.int64), np.concatenate([empty, *found])
        starts = np.cumsum(n_ids) - n_ids
        tables: list[pa.Table] = []
        for row in left.to_batches(max_chunksize=1):
            if not row.num_rows:
                continue
            words = unpack(row["lengths"][0].as_py(), "<i8")
            # The answers hold a chunk's words by bucket, and by number within a bucket.
            order = np.argsort(unpack(row["word_buckets"][0].as_py()), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            numbers = place[unpack(row["numbers"][0].as_py())]
            ids = word_ids[runs(starts[numbers], n_ids[numbers])]
            before = np.concatenate(([0], np.cumsum(n_ids[numbers])))
            firsts = before[np.concatenate(([0], np.cumsum(words)))]
            decoded = [b.decode("utf-8", "replace").encode() for b in known.joined(known.pieces, ids, firsts)]
            out = [row["ids"].flatten(), pa.array(np.diff(firsts), pa.int64())]
            if digests:
                decimal = [b[:-1] for b in known.joined(known.numerals, ids, firsts)]
                out += [pa.array([hashlib.sha256(b).hexdigest() for b in some]) for some in (decimal, decoded)]
            else:
                raw = ids.astype("<u4").tobytes()
                at = _ID * firsts
                out += [pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary()), pa.array([b.decode() for b in decoded])]
            tables.append(pa.table(out, names))
        return pa.concat_tables(tables)

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["id", "n_tokens", "ids", "decoded"]
    kinds = ("string", "string") if digests else ("binary", "string")
    schema = f"id {id_kind}, n_tokens long, {names[2]} {kinds[0]}, {names[3]} {kinds[1]}"
    asked = chunks.select("chunk", "ids", "lengths", "numbers", "word_buckets").groupBy("chunk")
    found = asked.cogroup(answers.groupBy("chunk")).applyInArrow(join, schema)
    return found.select(F.col("id").alias(id_col), *names[1:])
