"""Token counts of whole texts with a whole-token shortcut.

A text is cut into segments that no vocabulary piece spans, so its count is the sum of its
segments' counts. Segments that are one token by themselves, as proven once on the driver,
are looked up; only the remaining ones are merged by the library, once per worker and
distinct segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
# Distinct merged segments a worker remembers before it starts anew.
REMEMBERED = 400_000
ROWS_AT_ONCE = 256
_SEGMENT = re.compile(r" *[^ \n]+| +|\n")


@cache
def _library(model_path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def segments(text: str) -> list[str]:
    """The segments of a text: words with the spaces before them, and line ends.

    The library writes a space as U+2581 and puts one before every text but the empty one.
    """
    return _SEGMENT.findall(" " + text.replace(SPACE, " ")) if text else []


def prove_model(model_path: str) -> frozenset[str]:
    """Check that segments are independent, and list those that are a token by themselves.

    Merges join neighbours only if the result is a piece. So no merge crosses a place
    between two characters that no piece holds next to each other: here before a space
    that follows something else, and on either side of a line end. Raises ``ValueError``
    for a model where this fails, or that changes texts before it cuts them.
    """
    model = _library(model_path)
    ids = [
        i
        for i in range(model.vocab_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    pieces = [model.id_to_piece(i) for i in ids]
    if any(re.search(f"[^{SPACE}]{SPACE}|\n.|.\n", p, re.DOTALL) for p in pieces):
        raise ValueError("a piece spans two segments")
    before = model.encode("\n")
    for sample in ("a  b", " a ", "\té́ﬁ  A\n", "\n"):
        if model.decode(model.encode(sample)) != sample:
            raise ValueError("the model normalizes texts")
    texts = [p.replace(SPACE, " ") for p in pieces]
    encoded = model.encode(["\n" + t for t in texts], num_threads=1)
    return frozenset(t for t, i, e in zip(texts, ids, encoded) if e == [*before, i])


class _Costs(dict):
    """Tokens per segment; a segment not yet known is merged by the library."""

    def __init__(self, model_path: str, whole: frozenset[str]) -> None:
        super().__init__(dict.fromkeys(whole, 1))
        self.whole = whole
        self.model = _library(model_path)
        # A line end cuts the segment off from the space that the library puts in front.
        self.front = len(self.model.encode("\n"))

    def __missing__(self, segment: str) -> int:
        if len(self) > REMEMBERED + len(self.whole):
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        cost = len(self.model.encode("\n" + segment)) - self.front
        self[segment] = cost
        return cost


# One table per worker process, which serves many tasks.
_costs: dict[str, _Costs] = {}


def count_tokens(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for every row.

    ``model_path`` names a sentencepiece BPE model that every executor can open. Counts are
    those of the library, without begin and end tokens. A NULL text counts as empty (0
    bytes, 0 tokens), a NULL id stays NULL, repeated rows give a row each, an empty table
    gives none, and other columns are ignored whatever their names. Texts may have any
    length; memory holds one batch of texts and ``REMEMBERED`` segments.
    """
    whole = prove_model(model_path)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _costs:
            _costs[model_path] = _Costs(model_path, whole)
        costs = _costs[model_path]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                n = [sum(map(costs.__getitem__, segments(t))) for t in part[1].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part[0], part[2], pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"]
                )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"),
        text.alias("text"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    found = rows.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long")
    return found.select(
        F.col("id").alias(id_col),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
