import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltline.operators.shred import KEYED, NESTED, ROOTS, flat_table, nested_rows, shred


def read(v):
    for _ in range(4):
        if isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                return None
    return v if not isinstance(v, str) else None


def walk(value, names, path, pos, out):
    for name in names:
        if name not in value:
            continue
        v, at = read(value[name]), [*path, name]
        if not path and name in KEYED and isinstance(v, dict) and all(x is None or isinstance(read(x), (dict, list)) for x in v.values()):
            for key, x in v.items():
                objects(read(x), at, [key], out)
        else:
            objects(v, at, pos, out)


def objects(v, path, pos, out):
    for i, x in enumerate([v] if isinstance(v, dict) else v if isinstance(v, list) else []):
        x = read(x)
        if isinstance(x, dict):
            out.append((".".join(path), ".".join(map(str, [*pos, i]))))
            walk(x, NESTED, path, [*pos, i], out)


def expected(texts):
    out = []
    for i, text in enumerate(texts):
        try:
            value = json.loads(text)
        except (TypeError, ValueError):
            continue
        rows = []
        if isinstance(value, dict):
            walk(value, ROOTS, [], [], rows)
        out += [(i, *r) for r in rows]
    return sorted(out)


def found(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, raw string").withColumns({"member_path": F.lit("clash"), "i0": F.lit(0)})
    return nested_rows(df, ["i"], "raw", **options)


TEXTS = [
    None, "", "[]", "null", '{"formats":', "{}", '{"formats": null, "chapters": [], "comments": {}}', '{"formats": [{"a": 1, "fragments": [{"x": 1}, null, {"x": 2}]}, null, {"fragments": {"x": 9}}, 5, "text"]}',
    '{"subtitles": {"en": [{"u": 1}, null, {"u": 2}], "fr": {"u": 3}, "de": [], "x": null}, "entries": [{"formats": "[{\\"a\\": 1}]", "chapters": {"t": 1}}]}', '{"subtitles": [{"u": 1}], "thumbnails": {"id": "0"}}',
    '{"comments": {"id": 1, "replies": [{"id": 2, "replies": [{"id": 5}, null, {"id": 6}]}, {"id": 3}]}}', '{"comments": "{\\"id\\": 1}"}', '{"formats": [{"n": "' + "y" * 200_000 + '"}]}', '{"subtitles": {"en": [{"fragments": [{"a": 1}]}], "fr": [{"a": 1}, {"fragments": [{"b": 1}, {"b": 2}]}]}}',
    '{"formats": [{"t": "\\ud800", "k": {"deep": [1]}}]} ', '{"formats": [{}]} x', '{"formats": NaN}', '{"formats": [[{"a": 1}]]}',
]


def test_defined_cases(spark):
    assert sorted(tuple(r)[:3] for r in found(spark, TEXTS, attributes=False).collect()) == expected(TEXTS)
    assert found(spark, TEXTS).limit(0).count() == 0 and found(spark, [None]).count() == 0


def test_links_and_values(spark):
    rows = {(r.i, r.member_path, r.pos_path): r for r in found(spark, TEXTS).collect()}
    assert sorted(rows) == expected(TEXTS)
    assert rows[7, "formats.fragments", "0.2"].parent_pos == "0" and rows[7, "formats.fragments", "0.2"].attributes == {"x": "2"}
    assert rows[13, "subtitles.fragments", "fr.1.1"].parent_pos == "fr.1" and rows[14, "formats", "0"].attributes == {"t": "\\ud800", "k": '{"deep": [1]}'}
    for (i, path, pos), r in rows.items():
        if "." in path:
            assert (i, r.parent_path, r.parent_pos) in rows


def test_flat_table(spark):
    table = flat_table(found(spark, ['{"formats": [{"w": 5, "x": "a"}, {"w": "no"}]}']), ["i"], "formats", {"w": "bigint", "x": "string"})
    assert [tuple(r) for r in table.orderBy("pos_path").collect()] == [(0, "0", "", 5, "a"), (0, "1", "", None, None)]


json_values = st.recursive(st.one_of(st.none(), st.integers(0, 9), st.just("t")), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["a", "formats", "fragments", "replies", "chapters"]), x, max_size=3)), max_leaves=12)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.dictionaries(st.sampled_from([*ROOTS, "other"]), json_values, max_size=4), max_size=8), st.booleans())
def test_like_brute_force(spark, records, wrapped):
    texts = [json.dumps({k: json.dumps(v) if wrapped else v for k, v in r.items()}) for r in records] or ["{}"]
    assert sorted(tuple(r)[:3] for r in found(spark, texts, attributes=False).collect()) == expected(texts)


@pytest.mark.parametrize("depth", [5, 3_000])
def test_depth(spark, depth):
    text = '{"comments": ' + '{"replies": ' * depth + "1" + "}" * depth + "}"
    assert found(spark, [text, '{"formats": {}}'], attributes=False).count() >= 1


def test_members_encoded_many_times(spark):
    member = [{"a": 1, "chapters": [{"b": 2}]}, "no json"]
    for _ in range(9):
        member = json.dumps(member)
    rows = found(spark, [json.dumps({"formats": member, "chapters": "\"\\\"text\\\"\""})]).select("member_path", "pos_path").collect()
    assert sorted(map(tuple, rows)) == [("formats", "0"), ("formats.chapters", "0.0")]


def test_leaf_levels():
    columns = shred(['{"formats": [{"a": 1, "fragments": [{"x": 1}, null]}, null, {"a": null}]}', "{}"])
    group = columns["formats",]
    leaf = group.leaf("a")
    assert leaf.max_def == 3 and list(leaf.reps) == [0, 1, 1, 0] and leaf.defs.tolist() == [3, 1, 3, 0] and leaf.values == [1, None]
    inner = columns["formats", "fragments"].leaf("x")
    assert inner.max_def == 5 and list(inner.reps) == [0, 2, 1, 1, 0] and inner.defs.tolist() == [5, 3, 1, 2, 0] and inner.values == [1]


def test_depth_of_other_members(spark):
    text = '{"comments": {"x": ' + "[" * 50_000 + "]" * 50_000 + "}}"
    row = found(spark, [text]).head()
    assert row.member_path == "comments" and len(row.attributes["x"]) == 100_000
