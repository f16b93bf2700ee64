from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexivec.llm.splitting import CHARACTER, LEVELS, last_end, part_ends, split_oversized, split_text
from lexivec.llm.tokens import encoder, token_count


def check(text, pieces, limit, overlap):
    e = encoder()
    for r in pieces:
        assert len(e.encode_ordinary(r[6])) == r[4] <= limit and text[r[1] : r[2]] == r[6]
    assert pieces[0][1] == 0
    assert "".join(text[a[2] : b[2]] for a, b in zip([(0, 0, 0), *pieces], pieces)) == text
    for a, b in zip(pieces, pieces[1:]):
        tail = b"".join(e.decode_single_token_bytes(i) for i in e.encode_ordinary(a[6])[-overlap:])
        shared = b[6][: a[2] - b[1]].encode()
        assert shared.endswith(tail) and len(shared) - len(tail) < 4  # a whole character at most more


SENTENCE = "Người ta ghi rằng lò gốm bao quanh câu hát; tinh thể thì thấp dần. "


@pytest.mark.parametrize(
    "text",
    [
        SENTENCE * 300,
        ("## Phần\n\n" + SENTENCE * 20 + "\n\n") * 20,
        "a" * 60_000,
        "ấ" * 20_000,
        "🇻🇳" * 3000,
        " " * 9000 + "x",
        "\n" * 20_000,
        "東谷駅。" * 3000,
        "x" * 9000 + " " + SENTENCE * 200,
    ],
)
def test_round_trip(text):
    pieces = split_text(text, 512, 32)
    assert len(pieces) > 1 or len(encoder().encode_ordinary(text)) <= 512
    if pieces:
        check(text, pieces, 512, 32)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text(alphabet=st.sampled_from("ab ấ\n.東🇻 \t\r#!?"), max_size=1500))
def test_any_text(text):
    pieces = split_text(text, 32, 4)
    if pieces:
        check(text, pieces, 32, 4)
    else:
        assert len(encoder().encode_ordinary(text)) <= 32


def test_boundaries_are_preferred():
    part = SENTENCE * 12 + "\n\n"
    cuts = {r[5] for r in split_text("".join(f"## S{i}\n\n{part}" for i in range(30)), 1024, 64)}
    assert cuts <= {"section", "paragraph", "sentence", "end"} and "section" in cuts


def test_a_section_break_comes_before_any_later_boundary():
    first, second = SENTENCE * 60, SENTENCE * 200
    text = f"# Một\n\n{first}\n\n# Hai\n\n{second}"
    pieces = split_text(text, 2048, 64)
    check(text, pieces, 2048, 64)
    assert pieces[0][5] == "section" and pieces[0][2] == text.index("\n\n# Hai")
    assert {p[5] for p in pieces[1:]} <= {"sentence", "end"}


@pytest.mark.parametrize("seed", range(6))
def test_no_lower_cut_where_a_higher_one_fits(seed):
    rng = random.Random(seed)
    makers = [
        lambda: SENTENCE * rng.randint(1, 30), lambda: "dài" * rng.randint(1, 900), lambda: "## Phần\n", lambda: "\n\n", lambda: "\n\n\n\n",
        lambda: "\f", lambda: " ", lambda: "\n",
    ]
    text = "".join(rng.choice(makers)() for _ in range(200))
    limit, overlap = 256, 16
    pieces = split_text(text, limit, overlap)
    check(text, pieces, limit, overlap)
    begins = [0, *(p[2] for p in pieces)]
    for own, p in zip(begins, pieces[:-1]):
        level = LEVELS.index(p[5])
        for higher in range(level):
            assert not list(part_ends(text, higher, own, p[2]))
        # greedy: no further part of the cut's level would have fitted
        if level < CHARACTER:
            more = next(part_ends(text, level, p[2], p[2] + 4000), None)
            assert more is None or len(encoder().encode_ordinary(text[p[1] : more])) > limit


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab.。\n\r\f \t#-!”"), max_size=60), st.integers(1, 40))
def test_the_last_end_is_found_from_behind(unit, n):
    text = unit + "x" * 900 + unit * n + "y" * 300
    for level in range(CHARACTER):
        for lo, reach in ((0, len(text)), (3, len(text) - 200), (len(unit), len(unit) + 700)):
            ends = list(part_ends(text, level, lo, reach))
            assert last_end(text, level, lo, reach) == (ends[-1] if ends else lo)


def test_operator(spark):
    rows = [(1, SENTENCE * 500), (2, "short"), (3, None), (4, ""), (None, SENTENCE * 500), (2**60 + 1, SENTENCE * 500), (1, SENTENCE * 500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"id": F.lit(0), "piece_no": F.lit(0), "piece": F.lit("")})
    got = split_oversized(df).where("piece_no = 0").select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(["1", "1", "None", str(2**60 + 1)])
    assert split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, limit=100, overlap=64)


def test_exactly_the_texts_over_the_limit(spark):
    rows = [(i, "tree " * i) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id for r in split_oversized(df, limit=32, overlap=2).collect()}
    counted = {r.doc_id for r in df.withColumn("n", token_count(F.col("text"))).where("n > 32").collect()}
    assert got == counted
