"""Every stage of the pipeline on odd rows, each of them twice, and on columns whose names clash with those inside."""

from collections import Counter

import corpus_pipeline
import pytest

from tests.llm import test_keep_first, test_line_dedup
from tidewrack.llm import ngram_join
from tidewrack.session import materialize

SF = "/root/testdata/sf0.001"
OWN = ("_digest", "_doc", "_gone", "_word", "_bits", "_hash", "_row", "decoded", "cls", "row", "id", "digest", "of", "goes", "removed", "text_hash", "spans", "toxicity", "most", "total", "mix_order", "first", "line")
NAMES = "doc_id long, text string, lang string, source string, n_chars long, _slot int, " + ", ".join(f"{c} string" for c in OWN)
WORDS = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, WORDS), (2, WORDS + " end"), (None, WORDS + " end too"), (3, None), (4, ""), (5, " \n\t\n"), (6, "one line\n\none line\nanother"), (6, "a second text of six\nits own line"),
    (7, "x " * 400_000), (8, "y" * 1_000_000), (9, "repeated row"), (None, None), (None, ""), (None, "lone null id\nwith two lines"), (7, None),
]


def twice(spark):
    own = lambda i: ("en", f"s{i % 3}" if i % 4 else None, 1, 3, *(f"{c}{i}" for c in OWN))
    return spark.createDataFrame([(i, t, *own(k)) for k, (i, t) in enumerate(TEXTS) for _ in range(2)], NAMES)


def rows(df, *left_out):
    names = [c for c in df.columns if c not in left_out]
    return Counter(tuple(r) for r in df.select(names).collect())


@pytest.fixture(scope="module")
def stages(spark):
    out = [materialize(twice(spark), "odd")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), name))
    return out


def test_no_row_is_toxic(stages):
    assert rows(stages[1]) == rows(stages[0])


def test_lines_go_and_nothing_else(stages):
    before = [tuple(r) for r in stages[1].collect()]
    some = list(dict.fromkeys(r[:2] for r in before))  # repeated rows keep and lose the same lines
    lost = dict(zip(some, test_line_dedup.brute(some)))
    gone = [lost[r[:2]] for r in before]
    text = lambda t, w: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in w)
    want = Counter((r[0], text(r[1], w), *r[2:4], None if r[1] is None else len(text(r[1], w)), *r[5:]) for r, w in zip(before, gone))
    assert rows(stages[2]) == want


def left(before):
    """One row of each group of linked texts; all rows without words."""
    kept, groups = [r for r in before if not (r[1] or "").split()], []
    for r in sorted((r for r in before if (r[1] or "").split()), key=lambda r: (r[0] is None, r[0] or 0)):
        if not any(test_keep_first.linked_texts(r[1], g[1]) for g in groups):
            groups.append(r)
    return Counter(kept + groups)


def test_one_of_every_group_and_all_without_words(spark, stages):
    assert rows(stages[3]) == left([tuple(r) for r in stages[2].collect()])
    docs = stages[0]
    assert rows(ngram_join.keep_first(docs)) == left([tuple(r) for r in docs.collect()])


def test_repeats_without_words_stay_at_every_size(spark):
    some = [(7, None), (7, None), (5, ""), (5, ""), (None, None), (None, None), (1, "one other")]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    assert rows(ngram_join.keep_first(docs)) == Counter(some)


def test_the_mix_takes_whole_rows(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert stages[4].columns == stages[3].columns and set(after) <= set(before)
    assert all((r[1] or "").split() for r in after)


def test_tokens_come_with_all_other_columns(stages):
    own = [c for c in stages[4].columns if c != "text"]
    assert stages[5].columns == [*own, *corpus_pipeline.ADDED]
    assert rows(stages[5].select(own)) == rows(stages[4], "text")


def test_tokens_of_all_odd_rows(spark):
    docs = twice(spark)
    out = corpus_pipeline.tokenize(spark, docs, SF)
    assert rows(out, *corpus_pipeline.ADDED) == rows(docs, "text") and "decoded" in out.columns
    assert rows(corpus_pipeline.tokenize(spark, docs.withColumn("N_tokens", docs["id"]), SF).drop("token_ids")).keys() == rows(out.drop("token_ids")).keys()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], NAMES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
