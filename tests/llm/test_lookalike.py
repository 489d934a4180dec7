from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltline.llm import lookalike
from siltline.llm.lookalike import canonical_form, canonical_text, look_alike_classes, look_alike_pairs, visual_form

SAME = [("file", "ﬁle"), ("paper", "рареr"), ("café", "cafe\u0301"), ("a b", "a\u00a0b"), ("ab", "a\u200bb"), ("ab", "a\u00adb"), ("ABC", "ＡＢＣ"), ("x!", "x！"), ("ガ", "ｶﾞ"), ("a-b", "a‐b"), ("ë", "ё"), ("K", "\u212a"), ("", "\u200b"), ("a\nb", "a\r\nb"), ("\U0001f469\u200d\U0001f4bb", "\U0001f469\U0001f4bb"), ("и\u0306", "й"), ("go", "ɡօ")]
DIFFERENT = [("a", "A"), ("e", "é"), ("1", "2"), ("a.", "a!"), ("a b", "a\nb"), ("x²", "x2"), ("①", "1"), ("ab", "a b"), ("œ", "oe"), ("ß", "ss"), ("–", "-"), ("и", "й"), ("l", "I"), ("0", "O")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert visual_form(a) == visual_form(b) and canonical_form(a) == canonical_form(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert visual_form(a) != visual_form(b)


def test_canonical_form_also_folds():
    assert canonical_form("STRASSE ²") == canonical_form("Straße 2") == "strasse 2"


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=12))
def test_forms_are_stable(text):
    assert visual_form(visual_form(text)) == visual_form(text)
    assert canonical_form(canonical_form(text)) == canonical_form(text)
    assert canonical_form(visual_form(text)) == canonical_form(text)


def test_column(spark):
    df = spark.createDataFrame([(1, "Ｆull"), (2, None), (3, ""), (4, "\u200b"), (5, "x" * 300_000)], "i int, t string").withColumn("canonical", F.lit("clash"))
    assert [r.canonical for r in canonical_text(df, "t").orderBy("i").collect()] == ["full", None, "", "", "x" * 300_000]
    assert canonical_text(df.limit(0), "t").count() == 0


def test_pairs_like_brute_force(spark):
    texts = [x for pair in SAME + DIFFERENT for x in pair] * 2 + [None, "", "long " * 40_000, "ⅼong " * 40_000]
    rows = list(enumerate(texts))
    by = defaultdict(list)
    for i, t in rows:
        if t is not None:
            by[visual_form(t)].append((i, t))
    expected = sorted((a, b) for g in by.values() for a, s in g for b, t in g if a < b and s != t)
    df = spark.createDataFrame(rows, "i bigint, t string").withColumns({"id": F.lit(1), "visual": F.lit(2), "exact": F.lit(3)})
    assert sorted(tuple(r) for r in look_alike_pairs(df, "i", "t").collect()) == expected
    assert look_alike_pairs(df.limit(0), "i", "t").count() == 0


def test_pairs_that_were_written_down(spark):
    """Pairs given by hand, not by the form that is tested."""
    rows, alike = [], set()
    for n, (a, b) in enumerate(SAME):
        rows += [(10 * n, f"{n}:{a}"), (10 * n + 1, f"{n}:{b}")]
        alike.add((10 * n, 10 * n + 1))
    for n, (a, b) in enumerate(DIFFERENT, 100):
        rows += [(10 * n, f"{n}:{a}"), (10 * n + 1, f"{n}:{b}")]
    rows += [(5_000, "Lisu"), (5_001, "ꓡisu"), (5_002, "Coptic"), (5_003, "Ⲥoptic")]
    alike |= {(5_000, 5_001), (5_002, 5_003)}
    df = spark.createDataFrame(rows, "i bigint, t string")
    assert {tuple(r) for r in look_alike_pairs(df, "i", "t").collect()} == alike


def test_classes(spark):
    rows = [(1, "ab"), (2, "аb"), (3, "ab"), (4, "a\u200bb"), (5, "c"), (6, "c"), (7, None), (None, "ab"), (8, "d"), (9, "ｄ"), (2, "ab")]
    df = spark.createDataFrame(rows, "i bigint, t string").withColumns({"members": F.lit(1), "class_id": F.lit(2)})
    got = sorted((r.i, r.class_id, r.members, r.links) for r in look_alike_classes(df, "i", "t").collect())
    assert got == [(1, 1, 5, 2), (2, 1, 5, 2), (2, 1, 5, 4), (3, 1, 5, 2), (4, 1, 5, 4), (8, 8, 2, 1), (9, 8, 2, 1)]
    assert sorted(tuple(r) for r in look_alike_pairs(df, "i", "t").collect()) == [(1, 2), (1, 4), (2, 3), (2, 4), (2, 4), (3, 4), (8, 9)]
    assert look_alike_classes(df.limit(0), "i", "t").count() == 0


def test_rows_of_one_key_are_divided(spark):
    left = spark.range(1_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    right = left.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("least"))
    plain = sorted(tuple(r) for r in left.join(right.drop("rows"), "key").select("id", "least").collect())
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lookalike, "broadcast_if_small", lambda df: df)
        assert sorted(tuple(r) for r in lookalike.spread_join(left, right, ["key"], "id", per_task=50).select("id", "least").collect()) == plain


def test_copies_are_a_third_of_all_rows(spark):
    df = spark.range(6_000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "hot text").when(F.col("id") == 1, "hot tехt").otherwise(F.col("id").cast("string")).alias("t"))
    assert look_alike_pairs(df, "i", "t").count() == 2_000
