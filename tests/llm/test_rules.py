"""Quality rules against a plain version."""

from __future__ import annotations

import re
from collections import Counter

from evalweave.llm import quality_rules
from tests.llm import messy


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


TEXTS = messy.TEXTS + [
    (20, "a b c a b c a b"),
    (21, "x y z\nx y z\n \nx y z | # <b>"),
    (22, "the cat and the dog went to the park " * 10),
    (23, "word " * 60),
    (24, " ".join(f"the w{i} of" for i in range(40))),
    (25, "ab c\x0bd\x0ce a bc d e ab"),
]


def test_measures(spark):
    got = quality_rules.judge(messy.docs(spark, TEXTS).repartition(3)).collect()
    rows = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        for r in got
    )
    assert rows == Counter((i, *plain(t)) for i, t in TEXTS)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert 24 in kept and not kept & {3, 4, 20, 23}
    assert quality_rules.judge(messy.empty(spark)).count() == 0


def test_rules_compile(spark):
    rules = (quality_rules.Rule("n_words", high=10, least_words=5), quality_rules.Rule("n_symbols"))
    df = spark.createDataFrame([(3, 9), (7, 9), (11, 9)], "n_words int, n_symbols int")
    assert [r[0] for r in df.select(quality_rules.verdict(rules)).collect()] == [True, True, False]


def test_one_projection(spark):
    plan = quality_rules.judge(messy.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Generate|Python|Arrow|Aggregate", plan)
