"""Sum-of-squares packing of token sequences.

Each task tokenizes its share of the documents and packs it at once, so nothing is
shuffled. A document's full windows are sequences by themselves; its rest goes to the fill
level that keeps the sum of squared level counts lowest. What is still open when the task
ends is cut and moved together, and the very last sequence is cut to powers of two.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

# Longer texts go to the tokenizer's own library, which bounds the matching of words.
LONGEST_FAST = 1 << 22
ROWS_AT_ONCE = 256
# Open sequences a task keeps before it cuts and moves them together.
MOST_OPEN = 4096
_WORD_BYTES = 4

# Fixed value: the words of byte-level tokenizers of this kind.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_values() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the characters from U+0100 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class TextIds:
    """Ids of texts, as little-endian unsigned 32-bit integers, for a tokenizers file.

    If the file's merges rank like their ids, a faster library with the same words and
    merges yields the same ids; it leaves out the offsets that are not needed here.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        special = self.library.get_added_tokens_decoder()
        self.special = {t.content: np.uint32(i).tobytes() for i, t in special.items()}
        marks = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.cut = re.compile(f"({marks})") if marks else None
        self.fast = self._same_ids(json.loads(self.library.to_str()), set(special))

    @staticmethod
    def _same_ids(spec: dict, special: set[int]) -> tiktoken.Encoding | None:
        model, values = spec["model"], _byte_values()
        before = spec["pre_tokenizer"] or {}
        plain = (
            model["type"] == "BPE"
            and spec["normalizer"] is None
            and before == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            and not (model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("dropout"))
        )
        if not plain:
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"][x + y] for x, y in merges]
        vocab = {t: i for t, i in model["vocab"].items() if i not in special}
        if order != sorted(set(order)) or len(order) + 256 != len(vocab):
            return None
        ranks = {bytes(values[c] for c in token): i for token, i in vocab.items()}
        return tiktoken.Encoding("own", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def _part(self, text: str) -> bytes:
        if self.fast is not None and len(text) <= LONGEST_FAST:
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        """Ids of a text; strings of added tokens in it become those tokens."""
        if self.cut is None or not any(mark in text for mark in self.special):
            return self._part(text)
        parts = self.cut.split(text)
        return b"".join(self.special[p] if k % 2 else self._part(p) for k, p in enumerate(parts))


# One per worker process, which serves many tasks.
_text_ids: dict[str, TextIds] = {}


class Packer:
    """Sum-of-squares placement; ``pieces`` collects what is final.

    A piece is ``(doc, start, ids, doc_tokens)``; a final one gets its sequence and offset.
    """

    def __init__(self, window: int, first_sequence: int = 0, most_open: int = MOST_OPEN) -> None:
        self.window, self.most_open = window, most_open
        self.counts = np.zeros(window + 1, np.int64)
        self.levels: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.next_sequence = first_sequence
        self.pieces: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        """Place one document."""
        total = len(ids) // _WORD_BYTES
        full = total - total % self.window
        for start in range(0, full, self.window):
            self._close([(doc, start, self._cut(ids, start, start + self.window), total)])
        if full < total:
            self._place((doc, full, self._cut(ids, full, total), total), total - full)
            if self.n_open > self.most_open:
                self.gather()

    @staticmethod
    def _cut(ids: bytes, start: int, end: int) -> bytes:
        return ids[start * _WORD_BYTES : end * _WORD_BYTES]

    def _place(self, piece: tuple, size: int) -> None:
        """Choose the level whose change of the sum of squares is least, the fullest at ties."""
        counts, window = self.counts, self.window
        change = 2 * (counts[size:] - counts[: window + 1 - size]) + 2
        change[0] -= 1  # a new sequence empties no level
        change[-1] -= 1  # a full one joins no level
        allowed = counts[: window + 1 - size] > 0
        allowed[0] = True
        change[~allowed] = np.iinfo(np.int64).max
        level = len(change) - 1 - int(change[::-1].argmin())
        if level:
            held = self.levels[level].pop()
            counts[level] -= 1
            self.n_open -= 1
        else:
            held = []
        held.append(piece)
        if level + size == window:
            self._close(held)
        else:
            self.levels[level + size].append(held)
            counts[level + size] += 1
            self.n_open += 1

    def _close(self, held: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in held:
            n = len(ids) // _WORD_BYTES
            self.pieces.append((doc, start, n, zlib.crc32(ids), total, self.next_sequence, offset))
            offset += n
        self.next_sequence += 1

    def gather(self) -> None:
        """Fill the fullest open sequences with cuts of the emptiest; at most one stays open."""
        held = [(level, pieces) for level in range(self.window) for pieces in self.levels[level]]
        self.levels = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        first, last = 0, len(held) - 1
        while first < last:
            level, pieces = held[last]
            source = held[first][1]
            while level < self.window and source:
                doc, start, ids, total = source.pop()
                n = min(self.window - level, len(ids) // _WORD_BYTES)
                pieces.append((doc, start, self._cut(ids, 0, n), total))
                level += n
                if n * _WORD_BYTES < len(ids):
                    source.append((doc, start + n, ids[n * _WORD_BYTES :], total))
            if level == self.window:
                self._close(pieces)
                last -= 1
            else:
                held[last] = (level, pieces)
            if not source:
                first += 1
        self.n_open = 0
        if first == last and held[first][1]:
            pieces = held[first][1]
            level = sum(len(p[2]) for p in pieces) // _WORD_BYTES
            self.levels[level].append(pieces)
            self.counts[level] = self.n_open = 1

    def finish(self) -> None:
        """Close everything; the last sequence is cut into lengths that are powers of two."""
        self.gather()
        rest = next((pieces for level in self.levels for pieces in level), [])
        rest.reverse()
        left = sum(len(p[2]) for p in rest) // _WORD_BYTES
        for bit in reversed(range(left.bit_length())):
            room, held = left & (1 << bit), []
            while room:
                doc, start, ids, total = rest.pop()
                n = min(room, len(ids) // _WORD_BYTES)
                held.append((doc, start, self._cut(ids, 0, n), total))
                room -= n
                if n * _WORD_BYTES < len(ids):
                    rest.append((doc, start + n, ids[n * _WORD_BYTES :], total))
            if held:
                self._close(held)
        self.levels = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        self.n_open = 0


_NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents with their place: one row per piece.

    ``tokenizer_path`` names a tokenizers file that every executor can open. A document is
    its ids and then ``end_id``. No sequence is longer than ``window``; only those shorter
    that are no power of two need padding, and every task leaves none. ``sequence_id`` is
    unique: the task's number in its high bits, a counter in its low 40. A NULL text is
    empty (one id, the end), a NULL id stays NULL, repeated rows are packed each, an empty
    table gives no row, and other columns are ignored whatever their names. A task holds
    one batch of texts and ``MOST_OPEN`` open sequences.
    """
    end = np.uint32(end_id).tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _text_ids:
            _text_ids[tokenizer_path] = TextIds(tokenizer_path)
        ids = _text_ids[tokenizer_path]
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        kind = None

        def done() -> pa.RecordBatch:
            columns = list(zip(*packer.pieces)) or [()] * 7
            types = [kind, *[pa.int64()] * 6]
            packer.pieces = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _NAMES)

        for batch in batches:
            kind = batch[0].type
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                for doc, text in zip(part[0].to_pylist(), part[1].to_pylist()):
                    packer.add(doc, ids.of(text) + end)
                yield done()
        if kind is not None:
            packer.finish()
            yield done()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    names = ", ".join(f"{n} long" for n in _NAMES[1:])
    return rows.mapInArrow(packed, f"id {kind}, {names}").withColumnRenamed("id", id_col)
