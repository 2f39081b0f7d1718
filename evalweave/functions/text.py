"""Answer cleaning, tokenization and multiset token overlap.

All functions are JVM-side column expressions over a single row: scoring a pair of
answers needs no shuffle and no Python worker, so no key can become a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evalweave.functions.binding import bind

# The characters removed by stripping, the answer prefixes, the
# articles that carry no weight, and the separator between words.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ANSWER_PREFIXES = ("answer", "assistant")
ARTICLES = ("a", "an", "the")
WORD_SEPARATOR = r"[^\p{L}\p{N}_]+"

# Markers that sort the two sides of a pair next to each other. Tokens consist of
# letters, digits and underscores, so a control character can not occur in them.
_LEFT, _RIGHT = "\x01", "\x02"


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends (``trim`` removes blanks only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def clean_answer(text: Column) -> Column:
    """Strip, drop one leading ``answer:`` / ``assistant:`` and strip again; NULL gives ``''``."""
    space = f"[{WHITESPACE}]*"
    prefix = rf"(?iu)\A(?:{'|'.join(ANSWER_PREFIXES)}){space}:"
    return strip(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), prefix, ""))


def answer_tokens(text: Column) -> Column:
    """Lower-cased words without articles, in order; NULL and blank give ``[]``."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_SEPARATOR)
    return F.filter(words, lambda w: (w != "") & ~w.isin(*ARTICLES))


def normalize_answer(text: Column) -> Column:
    """The tokens of a text joined by single blanks."""
    return F.array_join(answer_tokens(text), " ")


def _repeats(tokens: Column) -> Column:
    """Every copy of a token but its first, of a sorted array."""
    return bind(
        tokens, lambda sorted_: F.filter(sorted_, lambda t, i: t == F.get(sorted_, i - 1))
    )


def _overlap_by_runs(left: Column, right: Column) -> Column:
    """Shared copies found in the runs of equal tokens of both sides sorted together."""
    marked = F.sort_array(
        F.concat(
            F.transform(left, lambda t: F.concat(t, F.lit(_LEFT))),
            F.transform(right, lambda t: F.concat(t, F.lit(_RIGHT))),
        )
    )

    def run_ends(tokens: Column) -> Column:
        last = F.transform(
            tokens, lambda t, i: F.when(~t.eqNullSafe(F.get(tokens, i + 1)), i)
        )
        return F.filter(last, lambda i: i.isNotNull())

    def shared(tokens: Column, ends: Column) -> Column:
        def of_run(end: Column, run: Column) -> Column:
            before = F.get(ends, run - 1)
            copies = end - before
            copies_before = before - F.coalesce(F.get(ends, run - 2), F.lit(-1))
            same_token = F.rtrim(F.get(tokens, end), F.lit(_RIGHT)) == F.rtrim(
                F.get(tokens, before), F.lit(_LEFT)
            )
            return F.when(same_token, F.least(copies, copies_before)).otherwise(0)

        return F.aggregate(F.transform(ends, of_run), F.lit(0), lambda total, n: total + n)

    return bind(marked, lambda tokens: bind(run_ends(tokens), lambda ends: shared(tokens, ends)))


def multiset_overlap(left: Column, right: Column) -> Column:
    """Number of tokens two arrays share, counting repetitions (sum of smaller counts).

    Tokens both sides have are counted once by a set intersection. What either side
    repeats is then matched by sorting: a run of left copies of a token is followed by
    the run of its right copies. The cost is that of a few sorts per row instead of a
    shuffle of every token of the table.
    """
    return bind(
        F.struct(F.sort_array(left).alias("left"), F.sort_array(right).alias("right")),
        lambda s: F.size(F.array_intersect(s["left"], s["right"]))
        + _overlap_by_runs(_repeats(s["left"]), _repeats(s["right"])),
    )


def token_counts(prediction: Column, reference: Column) -> Column:
    """``struct(n_prediction, n_reference, overlap)`` of two texts."""
    return bind(
        F.struct(
            answer_tokens(prediction).alias("prediction"),
            answer_tokens(reference).alias("reference"),
        ),
        lambda t: F.struct(
            F.size(t["prediction"]).alias("n_prediction"),
            F.size(t["reference"]).alias("n_reference"),
            multiset_overlap(t["prediction"], t["reference"]).alias("overlap"),
        ),
    )


def precision(counts: Column) -> Column:
    """Shared tokens per predicted token; NULL when nothing was predicted."""
    return F.when(counts["n_prediction"] > 0, counts["overlap"] / counts["n_prediction"])


def recall(counts: Column) -> Column:
    """Shared tokens per reference token; NULL when the reference is empty."""
    return F.when(counts["n_reference"] > 0, counts["overlap"] / counts["n_reference"])


def f1(counts: Column) -> Column:
    """Token F1 from :func:`token_counts`: two empty texts agree, one empty text never does."""
    size = counts["n_prediction"] + counts["n_reference"]
    return F.when(size == 0, F.lit(1.0)).otherwise(2.0 * counts["overlap"] / size)


def token_f1(prediction: Column, reference: Column) -> Column:
    """Multiset token F1 of two texts."""
    return bind(token_counts(prediction, reference), f1)


def model_slug(model_id: Column, separator: str = "__") -> Column:
    """A model id usable as a file name (``separator='_'`` for run names)."""
    return F.replace(model_id, F.lit("/"), F.lit(separator))
