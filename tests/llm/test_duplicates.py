"""Line dedup, Jaccard join and components against all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.llm import components, line_dedup, near_duplicates
from tests.llm import messy


def union(n, pairs):
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    links += [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = {r.node: r.root for r in components.components(df).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    roots = union(200, real)
    assert got == {n: roots[n] for pair in real for n in pair}
    assert components.components(df.limit(0)).count() == 0


def shingles(text):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    texts = list(messy.TEXTS)
    for group in range(12):
        base = [word() for _ in range([4, 90, 200, 200][group % 4])]
        for i in range([1, 3, 40][group % 3]):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = word()
            texts.append((500 + 50 * group + i, " ".join(words).capitalize() + "."))
    return texts


def test_blocks_add_few_connections():
    """A group of alike sets in blocks: connections grow with the blocks, not with the sets."""
    rng = np.random.default_rng(1)
    common = np.sort(rng.integers(0, 1 << 60, 60).astype(np.uint64))
    edges = {}
    for n in (256, 512, 1024):
        sets = [np.unique(np.append(common[rng.permutation(60)[:57]], np.uint64(i))) for i in range(n)]
        nodes, size, seen = np.arange(n) * 7 % n, 64, set()
        blocks = [np.sort(nodes[at : at + size]) for at in range(0, n, size)]
        links = Counter()
        for a, left in enumerate(blocks):
            for right in blocks[a:]:
                within = left is right
                both = left if within else np.concatenate([left, right])
                found, root = near_duplicates.compare_block(both, [sets[i] for i in both], size, 0.8, within)
                links.update(dict(zip(both.tolist(), found.tolist())))
                seen |= {(int(x), int(r)) for x, r in zip(both, root) if x != r}
        edges[n] = len(seen)
        close = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
        some = range(0, n, 101)
        assert all(links[i] == sum(close(sets[i], s) for j, s in enumerate(sets) if j != i) for i in some)
        assert set(union(n, list(seen))) == {union(n, list(seen))[0]}
    assert edges[1024] <= 4.5 * edges[256] and edges[1024] < 1024 + (1024 // 64) ** 2


@pytest.mark.parametrize("block, limit", [(512, 10**6), (7, 0)])
def test_jaccard_join(spark, near_texts, monkeypatch, block, limit):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    monkeypatch.setattr(near_duplicates, "MOST_BROADCAST", limit)
    monkeypatch.setattr(near_duplicates, "_COLUMNS", 64)
    docs = messy.docs(spark, near_texts).repartition(3)
    joined = near_duplicates.join(docs)
    got = Counter(
        (r.doc_id, r.class_id, r.n_copies, r.n_links, r.group_id) for r in joined.collect()
    )
    sets = defaultdict(list)
    for i, t in near_texts:
        if shingles(t):
            sets[shingles(t)].append(i)
    kinds = list(sets)
    links = [
        (a, b)
        for a in range(len(kinds))
        for b in range(a)
        if len(kinds[a] & kinds[b]) >= 0.8 * len(kinds[a] | kinds[b])
    ]
    roots = union(len(kinds), links)
    n_links = Counter(k for pair in links for k in pair)
    first = lambda ids: min(ids, key=messy.key)
    want = Counter()
    for k, s in enumerate(kinds):
        group = [i for j, x in enumerate(kinds) if roots[j] == roots[k] for i in sets[x]]
        for i in sets[s]:
            want[i, first(sets[s]), len(sets[s]), n_links[k], first(group)] += 1
    for i, t in near_texts:
        if not shingles(t):
            want[i, i, 1, 0, i] += 1
    assert not got - want and not want - got
    assert len(links) > 500
    kept = near_duplicates.one_per_group(docs, joined)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    groups = len(set(roots)) + len({(i, t or "") for i, t in near_texts if not shingles(t)})
    assert len(rows) == groups
    assert near_duplicates.join(messy.empty(spark)).count() == 0


def test_banding():
    banding = near_duplicates.choose_banding(0.8, 0.999)
    assert 1 - (1 - 0.8**banding.rows) ** banding.bands >= 0.999
    rng = np.random.default_rng(13)
    constants = near_duplicates._constants(banding)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    found = 0
    for _ in range(50):
        b = a.copy()
        b[rng.choice(1000, 111, replace=False)] = rng.integers(0, 1 << 63, 111).astype(np.uint64)
        x = near_duplicates.signature(np.unique(a), banding, constants)
        y = near_duplicates.signature(np.unique(b), banding, constants)
        found += bool((x == y).any())
    assert found == 50


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def line_texts():
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    pool = [" ".join(word() for _ in range(rng.choice([1, 3, 12, 30]))) for _ in range(60)]
    texts = list(messy.TEXTS)
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(6)):
            words = rng.choice(pool).split()
            if rng.random() < 0.4 and len(words) > 11:
                words[rng.randrange(len(words))] += "x"
            lines.append(" ".join(words).capitalize() + rng.choice(["", " ", "\t"]))
        texts.append((300 + i, "\n".join(lines)))
    return texts


@pytest.mark.parametrize("limit", [10**6, 0])
def test_line_dedup(spark, line_texts, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", limit)
    docs = messy.docs(spark, line_texts).repartition(3)
    found = line_dedup.duplicate_lines(docs)
    dropped = {(r.doc_id, p) for r in found.collect() for p in r.dropped}
    occurrences = sorted(
        {
            (messy.key(i), p, line.strip(" \t\r\x0b\x0c").lower())
            for i, t in line_texts
            for p, line in enumerate((t or "").split("\n"))
        }
    )
    first, kinds = {}, []
    for i, p, line in occurrences:
        if line and line not in first:
            first[line] = (i, p)
            kinds.append(line)
    assert all(
        ((i[1] if i[0] else None), p) in dropped
        for i, p, line in occurrences
        if line and first[line] != (i, p) and line_texts
    )
    # Fuzzily dropped lines have a similar one; most similar pairs are found.
    short = [k for k in kinds if len(k) < 2000]
    near = [
        (a, b)
        for a in range(len(short))
        for b in range(a)
        if len(short[a].split()) >= 5
        and min(len(short[a]), len(short[b])) >= 0.8 * max(len(short[a]), len(short[b]))
        and len(set(short[a].split()) & set(short[b].split())) > 3
        and distance(short[a], short[b]) <= 0.2 * max(len(short[a]), len(short[b]))
    ]
    roots = union(len(short), near)
    size = Counter(roots)
    fuzzy = [k for k, line in enumerate(short) if tuple_of(first[line]) in dropped]
    assert all(size[roots[k]] > 1 for k in fuzzy)
    groups = sum(n - 1 for n in size.values())
    assert len(fuzzy) >= 0.5 * groups
    kept = line_dedup.without_duplicate_lines(docs, found)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    for r in kept.collect():
        old = dict(line_texts)[r.doc_id] if r.doc_id is not None else None
        if r.doc_id is not None and old is not None:
            lines = [x for p, x in enumerate(old.split("\n")) if (r.doc_id, p) not in dropped]
            assert r.text == "\n".join(lines)
        elif r.doc_id is not None:
            assert r.text is None
    assert line_dedup.duplicate_lines(messy.empty(spark)).count() == 0


def tuple_of(place):
    (has, doc_id), position = place
    return (doc_id if has else None, position)


def test_simhash(spark):
    """Bits follow the words' majority; lines of equal words agree whatever their order."""
    docs = messy.docs(spark, [(1, "a b c d e f g"), (2, "g f e d c b a"), (3, "q r s t u v w")])
    rows = {r.id: r.sim for r in line_dedup.simhashes(line_dedup.lines(docs)).collect()}
    assert rows[1] == rows[2] != rows[3]
    words = spark.createDataFrame([(w,) for w in "abcdefg"], "w string")
    hashes = [r[0] for r in words.select(F.xxhash64("w")).collect()]
    want = sum((sum(h >> b & 1 for h in hashes) * 2 > 7) << b for b in range(63))
    assert rows[1] == want


def test_pigeonhole(spark):
    """Hashes that differ in three bits share a block key."""
    rng = random.Random(15)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(63)
        b = a
        for bit in rng.sample(range(63), 3):
            b ^= 1 << bit
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a long, b long")
    keys = [line_dedup.block_keys(F.col(c), F.lit(300)) for c in "ab"]
    both = F.arrays_overlap(*keys)
    assert df.filter(~both).count() == 0


@pytest.mark.parametrize("block", [512, 3])
def test_all_lines_of_a_bucket_meet(spark, monkeypatch, block):
    """Similar lines are found although others hold the ends of their buckets."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for pair in range(10):
        words = [word() for _ in range(12)]
        rows += [(4 * pair + 20, " ".join(words)), (4 * pair + 21, " ".join([*words[:-1], "x" + words[-1][1:]]))]
    rows += [(0, " ".join(word() for _ in range(12))), (99, " ".join(word() for _ in range(12)))]
    found = line_dedup.lines(messy.docs(spark, rows))
    distinct = line_dedup.simhashes(found).withColumn("sim", F.lit(7).cast("long"))
    distinct = distinct.withColumn("n_chars", F.lit(80)).withColumn("gram_sim", F.lit(7).cast("long"))
    of = {r.key: r.id for r in found.collect()}
    got = {tuple(sorted((of[r.a], of[r.b]))) for r in line_dedup.similar_lines(found, distinct, 0.8).collect()}
    assert got == {(4 * pair + 20, 4 * pair + 21) for pair in range(10)}


def test_pigeonhole_of_unequal_lengths(spark):
    """Hashes that differ in three bits share a key at all lengths that can be similar."""
    rng = random.Random(18)
    rows = []
    for n in range(400):
        a = rng.getrandbits(63)
        b = a
        for bit in rng.sample(range(63), 3):
            b ^= 1 << bit
        long = rng.randrange(10, 10_000) if n else 10
        rows.append((a, b, long, -(-long * 4 // 5)))
    df = spark.createDataFrame(rows, "a long, b long, m int, n int")
    keys = [line_dedup.block_keys(F.col(c), F.col(n)) for c, n in ("am", "bn")]
    assert df.filter(~F.arrays_overlap(*keys)).count() == 0


def test_long_lines_are_compared_by_characters(spark):
    """Neither a long word counts as one edit, nor a letter as a whole word."""
    rng = random.Random(19)
    blob = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    words = [blob(5) for _ in range(9)]
    many = [blob(8) for _ in range(600)]
    rows = [
        (1, " ".join([*words, blob(5000)]), " ".join([*words, blob(5000)])),
        (2, " ".join(many), " ".join(w[:-1] + "x" if k % 3 == 0 else w for k, w in enumerate(many))),
    ]
    df = spark.createDataFrame(rows, "id int, x string, y string")
    assert [r.id for r in line_dedup.within_edits(df, 0.8, ["id"]).collect()] == [2]


def test_lines_of_few_words(spark):
    """Repeated words, other white space and scripts without spaces take part."""
    han = "".join(chr(0x4E00 + 37 * k) for k in range(60))
    lines = ["one\ttwo\tthree\tfour\tfive\tsix\tseven\teight\tnine\tten", han]
    pairs = [(line, line[:-1] + "z") for line in lines]
    pairs.append(("alpha beta gamma delta " * 6, "alpha beta gamma delta " * 6 + "alpha"))
    docs = messy.docs(spark, [(2 * k + e, pair[e]) for k, pair in enumerate(pairs) for e in (0, 1)])
    got = {r.doc_id: r.dropped for r in line_dedup.duplicate_lines(docs).collect()}
    assert got == {1: [0], 3: [0], 5: [0]}


def test_no_python_on_the_main_path(spark, line_texts):
    plan = line_dedup.simhashes(line_dedup.lines(messy.docs(spark, line_texts)))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_star_links_connect_the_same_with_a_link_per_class(spark):
    """Thirty bands of a large group of near copies add no link per class and band."""
    rng = random.Random(21)
    stars = [(100 + i, h) for i in range(300) for h in rng.sample(range(12), 9)] + [(7, 2), (900, 800)]
    links = near_duplicates.star_links(spark.createDataFrame(stars, "class long, hub long"))
    assert links.count() <= 302 + 12 * 12
    root = {x: x for pair in stars for x in pair}
    while True:
        before = dict(root)
        for a, b in stars:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert {tuple(r) for r in near_duplicates.components(links, "class", "hub").collect()} == set(root.items())


def test_line_dedup_shuffles_texts_once_and_keys_once(spark):
    """Both SimHashes are summed where a line's text arrives, not sent as sums of their own."""
    text = "one two three four five six seven\nnine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    found = line_dedup.lines(docs)
    sims = line_dedup.distinct_lines(found)
    plan = sims._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    by_key = {r.key: (r.sim, r.n_words) for r in line_dedup.simhashes(found).collect()}
    grams = {r.key: r.gram_sim for r in line_dedup.gram_simhashes(found).collect()}
    got = {r.key: (r.sim, r.n_words, r.gram_sim) for r in sims.collect()}
    assert got == {k: (*v, grams[k]) for k, v in by_key.items()} and len(got) == 2


def test_pairs_of_lines_are_compared_in_rounds(spark, line_texts, monkeypatch):
    """Texts are written once, not once more per pair, and rounds find the same lines."""
    docs = messy.docs(spark, line_texts)
    rows = lambda: sorted(map(str, line_dedup.duplicate_lines(docs).collect()))
    made, keep = [], line_dedup.moved
    monkeypatch.setattr(line_dedup, "moved", lambda df, name, *a, **k: made.append((name, df.columns)) or keep(df, name, *a, **k))
    want = rows()
    assert {name for name, columns in made if {"line", "x", "_x"} & {*columns}} == {"line-candidate-texts"}
    one = [name for name, _ in made].count("line-links")
    monkeypatch.setattr(line_dedup, "PAIRS_AT_ONCE", 5)
    monkeypatch.setattr(line_dedup, "SHARE_AT_ONCE", 1000)
    assert rows() == want and len(want) > 20
    assert [name for name, _ in made].count("line-links") > 2 * one


def test_middles_are_taken_once(spark):
    """No filter computes what a comparison needs again for each of its uses."""
    pairs = spark.createDataFrame([(1, "a b c d", "a b c e")], "id int, x string, y string")
    plan = line_dedup.within_edits(pairs, 0.8, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unhex(") == 2 and plan.count("levenshtein(") == 4


def test_blanks_around_lines(spark):
    """Blanks at either end are left out, others stay; lines of blanks alone are none."""
    text = "\n".join(["  A b ", "\ta b", "a b\x0c\r", "\x0b", " \t ", "", "a\tb", "\u00a0a b"])
    got = [r.line for r in line_dedup.lines(messy.docs(spark, [(1, text)])).orderBy("position").collect()]
    assert got == ["a b", "a b", "a b", "a\tb", "\u00a0a b"]


def test_gram_simhashes_add_several_runs_at_once(spark):
    """Bits follow the majority of the distinct runs; neither lambdas nor a row per run are needed."""
    rng = random.Random(23)
    texts = ["".join(rng.choice("abcé ") for _ in range(n)).strip() + "x" for n in (1, 2, 3, 4, 5, 14, 15, 16, 31, 400)]
    texts += ["ab" * 40, texts[-1], "zz"]
    found = line_dedup.lines(messy.docs(spark, list(enumerate(texts))))
    runs = {(t, t[i : i + 4]) for t in texts for i in range(max(1, len(t) - 3))}
    rows = [(t, *(run[k : k + 1] or None for k in range(4))) for t, run in runs]
    hashed = spark.createDataFrame(rows, "line string, c0 string, c1 string, c2 string, c3 string")
    by_line = defaultdict(list)
    for r in hashed.select(F.xxhash64("line").alias("key"), F.xxhash64("c0", "c1", "c2", "c3").alias("h")).collect():
        by_line[r.key].append(r.h)
    want = {
        key: sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(63))
        for key, hashes in by_line.items()
    }
    sims = line_dedup.gram_simhashes(found)
    assert {r.key: r.gram_sim for r in sims.collect()} == want and len(want) == 12
    plan = sims._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and plan.count("explode(sequence(") == 2


def test_counts_of_characters_tell_lines_apart_before_texts_are_compared(spark, monkeypatch):
    """Lines whose characters differ by more than edits allow are not compared; all similar ones are."""
    rng = random.Random(24)
    rows = []
    for n in (30, 90, 400):
        for letters in ("etaoin ", "abcdefghijklmnopqrstuvwxyz ", "éжx漢 "):
            x = [rng.choice(letters) for _ in range(n)]
            for edits in (n // 20, n // 5, n // 4):
                y = list(x)
                for _ in range(edits):
                    kind, at = rng.randrange(3), rng.randrange(len(y))
                    y[at : at + (kind != 0)] = [rng.choice(letters)] * (kind != 1)
                rows.append(("".join(x), "".join(y)))
            rows.append(("".join(x), "".join(rng.choice("qzéж") for _ in range(n))))
    df = spark.createDataFrame(rows, "x string, y string")
    df = df.withColumns({f"{c}_counts": line_dedup.char_counts(F.col(c)) for c in "xy"})
    near = df.withColumn("near", line_dedup._near_in_counts("x", "y", 0.8)).collect()
    assert all(r.near for r in near if distance(r.x, r.y) <= 0.2 * max(len(r.x), len(r.y)))
    # The third kind of lines has few characters that are counted.
    others = [r for i, r in enumerate(near) if i % 4 == 3 and i % 12 != 11]
    assert not any(r.near for r in others) and sum(r.near for r in near) >= 18

    sent, keep = [], line_dedup.within_edits
    monkeypatch.setattr(line_dedup, "within_edits", lambda df, *a: sent.extend(df.select("a", "b").collect()) or keep(df, *a))
    lines = ["aab " * 12, "aab " * 11 + "aac ", "xyz " * 12]
    found = line_dedup.lines(messy.docs(spark, list(enumerate(lines))))
    distinct = line_dedup.simhashes(found).withColumns({c: F.lit(7).cast("long") for c in ("sim", "gram_sim")})
    of = {r.key: r.id for r in found.collect()}
    got = {tuple(sorted((of[r.a], of[r.b]))) for r in line_dedup.similar_lines(found, distinct, 0.8).collect()}
    assert got == {tuple(sorted((of[r.a], of[r.b]))) for r in sent} == {(0, 1)}
