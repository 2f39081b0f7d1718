"""Phrase collocations, counted by a multikey quicksort of suffixes.

A suffix is a word and the words after it in its piece, four at most, cut at the first word
that is too rare to be in a candidate. Suffixes are routed over all tasks by their leading
words, up to and with the first one that is not very frequent, so that no route holds more
suffixes than such a word has occurrences. A task sorts pointers to its suffixes by a three-way
quicksort, word by word: a partition of pointers that are equal up to some word counts that
phrase, one with too few pointers is abandoned, and no pointer is compared beyond the longest
phrase. A phrase of very frequent words alone is routed as a suffix of its own. Equal suffixes
of a chunk of texts are one pointer with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from evalweave.llm.packed import pack, runs, unpack
from evalweave.llm.shared import written
from evalweave.llm.words import _LOWER, byte_class, mixed, slices, text_bytes, words

LONGEST = 4
# Words of a chunk; a longer text is a chunk by itself.
WORDS_AT_ONCE = 1_000_000
_SLICE = 1 << 20
# Occurrences from which the next word takes part in a suffix's route, and suffixes per task.
LARGEST_ROUTE, SUFFIXES_AT_ONCE = 1 << 16, 1 << 20
_SALTS = 64
_SEPARATOR = byte_class(b".,;:!?\n\x0b\x0c\r")
_WORD = ~(byte_class(b" \t") | _SEPARATOR)


@dataclass(frozen=True)
class Settings:
    """Phrases of at least ``least`` occurrences; one in a longer phrase that has
    ``covered`` percent of its occurrences is dropped; ``most`` phrases per language."""

    least: int = 30
    covered: int = 80
    most: int = 2000


def _chunks(docs: DataFrame) -> DataFrame:
    """Words of some documents per row, as numbers into a list of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n_chunks, size = TaskContext.get().partitionId(), 0, 0
        langs: dict[str, int] = {}
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            nonlocal langs, held, n_chunks, size
            offsets = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
            lang, first = (np.concatenate([h[i] for h in held]) for i in (3, 5))
            names = np.concatenate([h[4] for h in held])
            names = mixed(names + lang.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            _, example, number, n = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
            del names
            data = np.concatenate([h[0] for h in held])
            starts = np.concatenate([h[1].astype(np.int64) + at for h, at in zip(held, offsets)])
            size_of = np.concatenate([h[2] for h in held])[example].astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(size_of))).astype(np.int32)
            texts = _LOWER[data[runs(starts[example], size_of)]].tobytes()
            kinds = pa.StringArray.from_buffers(len(example), pa.py_buffer(ends), pa.py_buffer(texts))
            of_lang = np.bincount(lang, minlength=len(langs))
            bounds = pa.array([0, len(example)], pa.int32())
            row = [
                pa.array([task << 20 | n_chunks], pa.int64()),
                pa.array([pack(number)], pa.binary()),
                pa.array([np.packbits(first).tobytes()], pa.binary()),
                pa.array([list(langs)], pa.list_(pa.string())),
                pa.array([of_lang.tolist()], pa.list_(pa.int64())),
                pa.ListArray.from_arrays(bounds, kinds),
                pa.ListArray.from_arrays(bounds, pa.array(lang[example].astype(np.int32))),
                pa.ListArray.from_arrays(bounds, pa.array(n.astype(np.int64))),
            ]
            langs, held, size, n_chunks = {}, [], 0, n_chunks + 1
            return pa.RecordBatch.from_arrays(row, columns)

        for batch in batches:
            for part in slices(batch, 1, _SLICE):
                data, bounds = text_bytes(part[1])
                found = words(data, bounds, _WORD)
                if not len(found.starts):
                    continue
                # A word begins a piece if a separator or a text's end lies before it.
                before = np.concatenate(([0], np.cumsum(_SEPARATOR[data])))
                first = np.ones(len(found.starts), bool)
                first[1:] = before[found.starts[1:]] > before[found.ends[:-1]]
                first[found.first[:-1][np.diff(found.first) > 0]] = True
                lang = np.array([langs.setdefault(x, len(langs)) for x in part[0].to_pylist()], np.int32)
                lengths = (found.ends - found.starts).astype(np.int32)
                held.append((data, found.starts.astype(np.int32), lengths, lang[found.docs], found.hashes, first))
                size += len(found.starts)
                if size >= WORDS_AT_ONCE:
                    yield done()
        if held:
            yield done()

    columns = ["chunk", "numbers", "first", "langs", "lang_words", "words", "word_lang", "n"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), text.alias("text")).mapInArrow(
        run,
        "chunk long, numbers binary, first binary, langs array<string>, lang_words array<long>, "
        "words array<string>, word_lang array<int>, n array<long>",
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``id``: dense numbers from 1; only the rows per partition reach the driver."""
    kept = written(rows.withColumn("place", F.monotonically_increasing_id()), "phrase-words")
    part = F.shiftright("place", 33)
    sizes = sorted(kept.groupBy(part.alias("part")).count().collect())
    first, offsets = 1, []
    for row in sizes:
        offsets.append((row["part"], first))
        first += row["count"]
    if first > 1 << 31:
        raise ValueError("over 2^31 frequent words")
    table = rows.sparkSession.createDataFrame(offsets, "part long, first long")
    return (
        kept.withColumn("part", part)
        .join(F.broadcast(table), "part")
        .withColumn("id", (F.col("first") + F.col("place").bitwiseAND((1 << 33) - 1)).cast("int"))
        .drop("part", "first", "place")
    )


def _suffixes(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's distinct suffixes: words, and weight and lead as one number.

    The first ``lead`` words are very frequent ones, whose prefixes are not counted from this
    suffix: every prefix of two words or more that has only such words is a suffix by itself,
    counted at its full length alone.
    """
    out = []
    for row in left.to_pylist():
        n_words = row["n_words"]
        ids, hot = np.zeros(n_words, np.int64), np.zeros(n_words, bool)
        ids[right["pos"].to_numpy()] = right["id"].to_numpy()
        hot[right["pos"].to_numpy()] = right["hot"].to_numpy(zero_copy_only=False)
        numbers = unpack(row["numbers"])
        first = np.unpackbits(np.frombuffer(row["first"], np.uint8), count=len(numbers)).astype(bool)
        word, is_hot = ids[numbers], hot[numbers]
        w, open_ = [word], word > 0
        led = [is_hot & open_]
        for d in range(1, LONGEST):
            follows, next_word, next_hot = (np.zeros_like(x) for x in (first, word, is_hot))
            if d < len(word):
                follows[:-d], next_word[:-d], next_hot[:-d] = ~first[d:], word[d:], is_hot[d:]
            open_ = open_ & follows & (next_word > 0)
            w.append(np.where(open_, next_word, 0))
            led.append(led[-1] & open_ & next_hot)
        lead = np.sum(led, axis=0)
        ends = np.stack([*(x == 0 for x in w), np.ones(len(word), bool)])
        whole = (w[1] > 0) & ~ends[lead, np.arange(len(word))]
        k1, k2 = w[0] << 32 | w[1], w[2] << 32 | w[3]
        masks = (0, 0, 0, -(1 << 32), -1)  # the second number of a prefix, by its length
        found = [(k1[whole], k2[whole], lead[whole])]
        for length in range(2, LONGEST + 1):
            some = led[length - 1]
            found.append((k1[some], k2[some] & masks[length], np.full(int(some.sum()), length - 1)))
        k1, k2, lead = (np.concatenate([x[i] for x in found]) for i in range(3))
        order = np.lexsort((k2, k1))
        k1, k2 = k1[order], k2[order]
        edge = np.ones(len(k1), bool)
        edge[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        at = np.flatnonzero(edge)
        n = np.diff(np.append(at, len(k1))).astype(np.int64)
        out.append(pa.table([pa.array(k1[at]), pa.array(k2[at]), pa.array(n << 3 | lead[order][at])], ["k1", "k2", "n_lead"]))
    return pa.concat_tables(out)


def _route() -> list[Column]:
    """The leading words up to and with the first one that is not very frequent."""
    lead = F.col("n_lead").bitwiseAND(F.lit(7))
    first = F.shiftleft(F.shiftright("k1", 32), 32)
    third = F.shiftleft(F.shiftright("k2", 32), 32)
    return [
        F.when(lead == 0, first).otherwise(F.col("k1")),
        F.when(lead <= 1, 0).when(lead == 2, third).otherwise(F.col("k2")),
    ]


def frequent_prefixes(
    w: list[np.ndarray], n: np.ndarray, lead: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefixes of two words or more of weighted suffixes, by a multikey quicksort of pointers.

    ``w[d]`` holds the word of depth ``d`` of every suffix, 0 behind its end. Returns a suffix
    with the prefix, the prefix's length and its weight. Prefixes lighter than ``least`` are
    abandoned; those within the first ``lead`` words of their suffix are only sorted. Whether
    a prefix of some suffix is counted from it must depend on the prefix and the suffix's end
    alone, as it does for suffixes cut and routed by how frequent their words are.
    """
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[np.ndarray, int, int]] = []

    def push(pointers: np.ndarray, depth: int) -> None:
        shared = lead[pointers] > depth
        if shared.any():
            stack.append((pointers[shared], depth, 0))
            pointers = pointers[~shared]
        if len(pointers):
            stack.append((pointers, depth, least))

    push(np.arange(len(n)), 0)
    while stack:
        pointers, depth, few = stack.pop()
        if few and int(n[pointers].sum()) < few:
            continue
        key = w[depth][pointers]
        a, b, c = key[0], key[len(key) // 2], key[-1]
        pivot = max(min(a, b), min(max(a, b), c))
        same = key == pivot
        if not same.all():
            below = key < pivot
            above = ~(below | same)
            for side in (below, above):
                rest = pointers[side]
                if len(rest):
                    stack.append((rest, depth, few))
            pointers = pointers[same]
        weight = int(n[pointers].sum())
        if weight < few:
            continue
        if depth and few == least:
            found.append((int(pointers[0]), depth + 1, weight))
        if depth + 1 < LONGEST:
            longer = pointers[w[depth + 1][pointers] > 0]
            if len(longer):
                push(longer, depth + 1)
    table = np.array(found, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


_LOW = (1 << 32) - 1


def _counted(suffixes: DataFrame, least: int) -> DataFrame:
    """``(k1, k2, a)``: phrases and their counts; one whole partition per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if not rows:
            return
        k1, k2, n_lead = (np.concatenate([r[i] for r in rows]) for i in range(3))
        rows.clear()
        n, lead = n_lead >> 3, n_lead & 7
        w = [k1 >> 32, k1 & _LOW, k2 >> 32, k2 & _LOW]
        w = [x.astype(np.int32) for x in w]
        at, length, weight = frequent_prefixes(w, n, lead, least)
        masks = np.array([0, 0, 0, -(1 << 32), -1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(k1[at]), pa.array(k2[at] & masks[length]), pa.array(weight)], ["k1", "k2", "a"]
        )

    return suffixes.mapInArrow(run, "k1 long, k2 long, a long")


def _key(*ids: Column) -> tuple[Column, Column]:
    """The two numbers that stand for a phrase of one to four words."""
    w = [i.cast("long") for i in ids] + [F.lit(0).cast("long")] * (LONGEST - len(ids))
    return F.shiftleft(w[0], 32).bitwiseOR(w[1]), F.shiftleft(w[2], 32).bitwiseOR(w[3])


def _words() -> list[Column]:
    low = F.lit(_LOW)
    return [x for k in ("k1", "k2") for x in (F.shiftright(k, 32), F.col(k).bitwiseAND(low))]


def _length() -> Column:
    return F.when(F.col("k2") == 0, 2).when(F.col("k2").bitwiseAND(F.lit(_LOW)) == 0, 3).otherwise(4)


def _by_length(parts: dict[int, list[Column]]) -> Column:
    """Explode an array that depends on the phrase's length."""
    choice = None
    for length, made in parts.items():
        test = _length() == length
        choice = F.when(test, F.array(*made)) if choice is None else choice.when(test, F.array(*made))
    return F.explode(choice)


def _scored(phrases: DataFrame, frequent: DataFrame) -> DataFrame:
    """Each phrase with the parts' counts and score of its lowest-scoring cut."""
    one = frequent.select(*(c.alias(x) for c, x in zip(_key(F.col("id")), ("k1", "k2"))), F.col("c").alias("f"))
    counts = one.unionByName(phrases.select("k1", "k2", F.col("a").alias("f")))
    w = _words()

    def cut(length: int, k: int) -> Column:
        (l1, l2), (r1, r2) = _key(*w[:k]), _key(*w[k:length])
        return F.struct(F.lit(k).alias("k"), l1.alias("l1"), l2.alias("l2"), r1.alias("r1"), r2.alias("r2"))

    cuts = {length: [cut(length, k) for k in range(1, length)] for length in range(2, LONGEST + 1)}
    rows = phrases.select("k1", "k2", "a", _by_length(cuts).alias("cut")).select("k1", "k2", "a", "cut.*")
    left = counts.select(F.col("k1").alias("l1"), F.col("k2").alias("l2"), F.col("f").alias("l"))
    right = counts.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.col("f").alias("r"))
    rows = rows.join(left, ["l1", "l2"]).join(right, ["r1", "r2"])
    wide = [F.col(x).cast("decimal(19,0)") for x in ("a", "l", "r")]
    rows = rows.withColumns({"up": F.lit(2_000_000).cast("decimal(7,0)") * wide[0], "down": wide[1] + wide[2]})
    lowest = F.min(F.struct(F.expr("up div down").cast("long").alias("score"), "k", "l", "r"))
    return rows.groupBy("k1", "k2", "a").agg(lowest.alias("cut")).select("k1", "k2", "a", "cut.l", "cut.r", "cut.score")


def _independent(phrases: DataFrame, covered: int) -> DataFrame:
    """Phrases that no longer one covers."""
    w = _words()

    def part(start: int, end: int) -> Column:
        s1, s2 = _key(*w[start:end])
        return F.struct(s1.alias("k1"), s2.alias("k2"))

    parts = {
        length: [part(i, i + size) for size in range(2, length) for i in range(length - size + 1)]
        for length in range(3, LONGEST + 1)
    }
    inside = phrases.filter("k2 <> 0").select(_by_length(parts).alias("x"), "a")
    longest = inside.groupBy("x.k1", "x.k2").agg(F.max("a").alias("longer"))
    dropped = F.coalesce(100 * F.col("longer") >= covered * F.col("a"), F.lit(False))
    return phrases.join(longest, ["k1", "k2"], "left").filter(~dropped).drop("longer")


def _first(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(
    docs: DataFrame,
    settings: Settings = Settings(),
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's best phrases.

    A-Z count as a-z; texts are split at ``.,;:!?`` and line ends into pieces, and these at
    spaces and tabs into words. A phrase of 2 to 4 words occurs ``a`` times, the parts of its
    lowest-scoring cut (the first one at ties) ``l`` and ``r`` times, and its language has ``n``
    words. Equal scores rank by falling ``a``, then by the phrase. A NULL text is empty, a NULL
    language is ``und``, every row counts, also a repeated one, an empty table gives no row, and
    other columns are ignored whatever their names. Words of a chunk are told apart by 64-bit
    hashes, words of the table by their texts. A task holds one chunk (``WORDS_AT_ONCE`` words,
    or one text) or some ``SUFFIXES_AT_ONCE`` suffixes.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    chunks = written(_chunks(rows), "phrase-chunks")
    of_lang = chunks.select(F.explode(F.arrays_zip("langs", "lang_words")).alias("x"))
    of_lang = of_lang.groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.lang_words").alias("n"))
    n_words = chunks.agg(F.coalesce(F.sum(F.expr("aggregate(lang_words, 0L, (s, x) -> s + x)")), F.lit(0))).first()[0]
    requests = chunks.select("chunk", "langs", F.posexplode(F.arrays_zip("words", "word_lang", "n")).alias("pos", "x"))
    requests = requests.select(
        "chunk", "pos", F.col("langs")[F.col("x.word_lang")].alias("lang"), F.col("x.words").alias("word"), "x.n"
    )
    counts = requests.groupBy("lang", "word").agg(F.sum("n").alias("c"))
    frequent = written(_numbered(counts.filter(F.col("c") >= settings.least)), "phrase-words")
    answers = requests.join(frequent, ["lang", "word"]).select(
        F.col("chunk").alias("asking"), "pos", "id", (F.col("c") > LARGEST_ROUTE).alias("hot")
    )
    asked = chunks.select("chunk", "numbers", "first", F.size("words").alias("n_words"))
    suffixes = (
        asked.groupBy("chunk")
        .cogroup(answers.groupBy("asking"))
        .applyInArrow(_suffixes, "k1 long, k2 long, n_lead long")
    )
    tasks = max(1, -(-n_words // SUFFIXES_AT_ONCE))
    phrases = written(_counted(suffixes.repartition(tasks, *_route()), settings.least), "phrases")
    best = _scored(phrases, frequent)
    kept = written(_independent(best, settings.covered), "phrases")
    spelt = (
        kept.select("k1", "k2", F.posexplode(F.filter(F.array(*_words()), lambda x: x > 0)).alias("pos", "id"))
        .join(frequent.select(F.col("id").cast("long").alias("id"), "lang", "word"), "id")
        .groupBy("k1", "k2")
        .agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("words"))
        .select("k1", "k2", "lang", F.array_join("words.word", " ").alias("phrase"))
    )
    named = kept.join(spelt, ["k1", "k2"])
    some = _first(named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))), ["lang", "salt"], settings.most)
    top = _first(some, ["lang"], settings.most).join(of_lang, "lang")
    return top.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(settings: Settings = Settings()) -> str:
    """The same result in SQL, over ``documents``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = f"translate(coalesce(text, ''), '{upper}', '{lower}')"
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, unnest([array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k - 2})]) AS p"
        " FROM pieces" + f" WHERE len(w) >= {k}"
        for k in range(1, LONGEST + 1)
    )
    return rf"""
    WITH cut AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({text}, '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM cut),
    total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
    grams AS ({grams}),
    f AS (SELECT lang, k, p, count(*) AS a FROM grams GROUP BY lang, k, p HAVING count(*) >= {settings.least}),
    cand AS (SELECT *, string_split(p, ' ') AS w FROM f WHERE k > 1),
    cuts AS (SELECT *, unnest(range(1, k)) AS c FROM cand),
    parts AS (
        SELECT lang, p, k, a, c, array_to_string(w[:c], ' ') AS lp, array_to_string(w[c + 1:], ' ') AS rp FROM cuts),
    scored AS (
        SELECT parts.lang, parts.p, parts.k, parts.a, x.a AS l, y.a AS r,
            ((2000000::HUGEINT * parts.a) // (x.a::HUGEINT + y.a))::BIGINT AS score, c
        FROM parts JOIN f x ON x.lang = parts.lang AND x.p = lp JOIN f y ON y.lang = parts.lang AND y.p = rp),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
    inside AS (
        SELECT lang, a, unnest([array_to_string(w[i:i + s - 1], ' ') FOR i IN range(1, k - s + 2)]) AS p
        FROM (SELECT *, unnest(range(2, k)) AS s FROM cand)),
    longest AS (SELECT lang, p, max(a) AS longer FROM inside GROUP BY lang, p),
    kept AS (
        SELECT lowest.* FROM lowest LEFT JOIN longest USING (lang, p)
        WHERE longer IS NULL OR 100 * longer < {settings.covered} * a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept)
    SELECT lang, rank, p AS phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {settings.most}
    """
