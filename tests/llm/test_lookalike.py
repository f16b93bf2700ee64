from __future__ import annotations

import unicodedata
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexivec.llm import lookalike

RECORDS = "record_id bigint, label_vi string, description_vi string, aliases_vi array<string>"


@pytest.fixture(scope="module")
def rewriter(spark):
    classes = lookalike.LookAlikes(lookalike.alike_pairs(spark))
    return lookalike.Rewriter(classes.rewrites({c: 1000 for c in "ABCEHIKMOPTXYaceiopsuvxy-"}))


@pytest.mark.parametrize(
    "a, b",
    [
        ("Việt Nam", unicodedata.normalize("NFD", "Việt Nam")),
        ("Cầu Nau", "Ｃầｕ　Ｎａｕ"),
        ("Sông Hồng", "Sôn​g  Hồ­ng \n"),
        ("Cống Đa", "Сống Ða"),
        ("Vườn Khó", "Vưὸ̛n Κhó".replace("ὸ̛", "ờ")),
        ("Gò Tám", "Gὸ Τám"),
        ("Tồi", "T\u043e\u200c\u0302\u0300\u0456"),
        ("xIVa", "xⅣa"),
        ("XIV", "ⅩⅣ"),
        ("fine", "ﬁne"),
        ("ít", "ı́t"),
        ("a b", "　a  b "),
        ("", "​  "),
    ],
)
def test_same_look(rewriter, a, b):
    assert rewriter(a) == rewriter(b)
    assert rewriter(rewriter(b)) == rewriter(b)


@pytest.mark.parametrize(
    "a, b",
    [("Hoà", "Hòa"), ("ga", "gà"), ("Ga", "ga"), ("a b", "ab"), ("a2", "a²"), ("a-b", "a–b"), ("đ", "d"), ("o", "0"), ("ga.", "ga"), ("㎏x", "x"),
     ("I", "l"), ("I", "1"), ("O", "0"), ("m", "rn"), ("i", "ı"), ("гора", "ropa"), ("œ", "oe"), ("ø", "o"), ("в", "B"), ("к", "k"), ("’", "'"), ("-", "–"), ("–", "—"), ("о", "О")],
)
def test_other_look(rewriter, a, b):
    assert rewriter(a) != rewriter(b)


def test_classes_are_transitive_and_frequent_members_win():
    c = lookalike.LookAlikes([("x", "y"), ("z", "y"), ("q", ""), ("W", "xx"), ("W", "zz")])
    out = c.rewrites({"z": 5, "x": 2, "zz": 1})
    assert out["x"] == out["y"] == "z" and out["q"] == "" and out["W"] == "zz" and out["xx"] == "zz"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aiıeo.ô\u0301\u0323\u0302 \u200b\u00adІеАｗﬁⅣ…rn᠎\u3000Ðƣ"), max_size=12))
def test_one_form_whatever_the_path(rewriter, text):
    assert rewriter(text) == by_automaton(rewriter)(text) == rewriter(rewriter(text))


@lru_cache(maxsize=None)
def by_automaton(rewriter):
    slow = lookalike.Rewriter({})
    slow.machine, slow.plain = rewriter.machine, lambda s: False
    slow.strings = lookalike.automaton((k, k) for k in rewriter.machine.keys())  # no translation where anything changes
    return slow


def test_no_class_holds_two_letters(spark):
    classes = lookalike.LookAlikes(lookalike.alike_pairs(spark))
    assert len({classes.find(b) for b in map(lambda c: unicodedata.normalize("NFD", c), lookalike.BASE)}) == len(lookalike.BASE)
    assert len(classes.members()) > 1500


def test_classes_give_the_pairs(spark):
    rows = [(i, ["Cầu", "Сầu", "Cầu "][i % 3] if i % 5 else f"Gò {i}", None, ["x", "х"] if i == 7 else ["x"]) for i in range(30)]
    df = spark.createDataFrame([*rows, (None, "Cầu", None, None), (50, None, " ", []), (3, *rows[3][1:])], RECORDS)
    classes = lookalike.same_look_classes(df).collect()
    assert len({tuple(r) for r in classes}) == len(classes)
    pairs = {
        (a.record_id, b.record_id, a.field)
        for a in classes for b in classes
        if a.record_id < b.record_id and (a.field, a.look_class) == (b.field, b.look_class) and a.spelling != b.spelling
    }
    assert pairs == {tuple(r) for r in lookalike.same_look_pairs(df).collect()} and pairs


def brute(rows, form):
    out = set()
    for name, at in (("label_vi", 1), ("description_vi", 2), ("aliases_vi", 3)):
        for a in rows:
            for b in rows:
                if a[0] is not None and b[0] is not None and a[0] < b[0]:
                    va, vb = ([x for x in (r[at] if at == 3 else [r[at]]) or [] if x] for r in (a, b))
                    if any(form(x) and form(x) == form(y) and x != y for x in va for y in vb):
                        out.add((a[0], b[0], name))
    return out


def test_pairs_against_brute_force(spark, rewriter):
    rows = [
        (1, "Cầu Tám", None, ["Bến A", "Gò B", None]),
        (2, "Сầu Tám", "mô tả", ["Bến A"]),
        (3, "Cầu  Tám", "mô​ tả", ["Gò В", "Bến А"]),
        (4, "Cầu Tám", "mô tả", []),
        (5, "Câu Tám", "  ", None),
        (6, "", "​", [""]),
        (None, "Cầu​ Tám", None, None),
    ]
    rows += [(100 + i, "Sông", None, None) for i in range(60)] + [(200, "Sôn​g", None, None)]  # a hot value with one variant
    df = spark.createDataFrame(rows, RECORDS).withColumns({"id": F.lit(1), "form": F.lit("x"), "raw": F.lit("y"), "field": F.lit(2)})
    got = [tuple(r) for r in lookalike.same_look_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, rewriter)
    assert lookalike.same_look_pairs(df.limit(0)).count() == 0
    forms = lookalike.canonical_values(df, lookalike.learn(df)).where("record_id = 3 and field = 'aliases_vi'").collect()
    assert [r.canonical for r in forms] == ["Gò B", "Bến A"]
