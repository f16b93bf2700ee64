from __future__ import annotations

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexivec.llm import garbled

HEADS = ["Cầu", "Sông", "Vườn", "Trạm", "Lễ hội", "Đồn điền", "Phường nghề", "Khoáng vật", "Chi bướm", "Hải đăng"]
NAMES = ["Mừng", "Phằn", "Nguyễn", "Huyền", "Rậu", "Đuyên", "Xường", "Thượng", "Quảnh", "Bổng", "Vẳng", "Lặn", "Cẻn", "Gội", "Tệ"]
TAILS = ["bị bỏ quên nằm giữa đầm nước", "nổi tiếng với tiếng nói", "được khảo sát năm 1834", "lập ra, nay phức tạp", "ở vùng trũng"]
DECOYS = ["(Ærøvik)", "(Ðalvík þorpið)", "(Сорьяка)", "(Ναρύσα)", "(東谷駅)", "(nhãn hiệu Lumorê® ©)", "(BÃI CÂU – XÃ LÃNG)", "(50 °C – 60 °C ± ½)", "(“bờ cũ” – ‘bến mới’…)"]


def value(rng):
    return f"{rng.choice(HEADS)} {rng.choice(NAMES)} {rng.choice(NAMES)} {rng.choice(TAILS)}"


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return garbled.Model(sorted({value(rng) for _ in range(1200)}))


@pytest.mark.parametrize("chain", [c for c in garbled.CHAINS if not c.lossy], ids=lambda c: c.name)
def test_chains_invert_exactly(model, chain):
    text = "Phường nghề Nguyễn Huyền bị bỏ quên nằm giữa đầm nước"
    spoiled = garbled.garble(text, chain)
    assert spoiled is not None and spoiled != text
    fixed, sure = garbled.invert(spoiled, chain, model.letters)
    # a multi-byte reading loses some bytes
    assert sure and fixed == (None if "�" in spoiled else text) and ("�" not in spoiled or chain.read in garbled.MULTI_BYTE)


def spoil(text, *names):
    for name in names:
        text = garbled.garble(text, next(c for c in garbled.CHAINS if c.name == name))
    return text


@pytest.mark.parametrize("names, chain", [
    (["utf_8>latin_1"] * 3, "utf_8>latin_1 x3"), (["utf_8>cp1252"] * 4, "utf_8>cp1252 x4"),
    (["utf_8>cp1252", "utf_8>cp437"], "utf_8>cp1252 + utf_8>cp437"), (["tcvn3>cp1252", "utf_8>cp1252"], "tcvn3>cp1252 + utf_8>cp1252"),
])
def test_several_readings_are_undone_whole_or_not_at_all(model, names, chain):
    texts = ["Phường nghề Nguyễn Huyền bị bỏ quên nằm giữa đầm nước", "Lễ hội Thượng Quảnh nổi tiếng với tiếng nói", "Vườn Vẳng Lặn được khảo sát năm 1834"]
    got = {i: (c, r) for i, c, r in garbled.examine([spoil(t, *names) for t in texts], model)}
    assert len(got) == 3 and all(got[i][1] in (t, None) for i, t in enumerate(texts))
    assert sum(c == chain and r == t for (c, r), t in zip(got.values(), texts)) >= 2
    # undone no further than allowed: nothing is given out
    assert all(r is None for _, _, r in garbled.examine([spoil(texts[0], *["utf_8>latin_1"] * 3)], model, most=1))


@pytest.mark.parametrize("name", [c.name for c in garbled.CHAINS])
def test_every_chain_is_found(model, name):
    rng = random.Random(5)
    texts = [value(rng) for _ in range(60)]
    spoiled = [spoil(t, name) for t in texts]
    pairs = [(t, s) for t, s in zip(texts, spoiled) if s is not None and s != t]
    got = {i: (c, r) for i, c, r in garbled.examine([s for _, s in pairs], model)}
    assert len(got) >= 0.95 * len(pairs)
    right = sum(r == t or (r is None and ("�" in s or "?" in s)) for (t, s), (_, r) in zip([pairs[i] for i in got], got.values()))
    assert right >= 0.85 * len(got)  # whole, or honestly not at all


def test_correct_questions_addresses_and_foreign_words(model):
    values = ["Ai? Không phải", "https://vi.example/a?b=c", "nước?", "What? No", "C++ và +84 912", "Zoë, naïve, Noël, José, Maïs", "São Paulo", "東京大学", "서울", "WHO?", "a?b"]
    assert [values[i] for i, _, _ in garbled.examine(values, model)] in ([], ["a?b"])


def test_lost_letters_and_other_alphabets(model):
    values = ["Th?nh ph? H? Ch? Minh", "Nguyeãn Huyeàn noåi tieáng vôùi tieáng noùi", "Nguy+Hsk-n Huy+HsE-n"]
    got = {i: (c, r) for i, c, r in garbled.examine(values, model)}
    assert set(got) == {0, 1, 2} and got[0][1] is None
    assert got[1] == ("vni>cp1252", "Nguyễn Huyền nổi tiếng với tiếng nói")


def test_held_out_accuracy(model):
    rng = random.Random(2)
    # chains whose results differ for these texts and that the corpora at hand contain
    names = ["utf_8>latin_1", "utf_8>cp1252", "utf_8>cp1250", "utf_8>cp1251", "utf_8>cp437", "utf_8>cp850", "utf_8>mac_roman",
             "utf_8>cp1252 x2", "tcvn3>cp1252", "cp1258>cp1252"]
    spoiled, correct = [], []
    for _ in range(400):
        name = rng.choice(names)
        chain = next(c for c in garbled.CHAINS if c.name == name)
        text = value(rng)
        words = text.split(" ")
        if rng.random() < 0.3:  # a part alone
            at = rng.randrange(len(words) - 4)
            part = garbled.garble(" ".join(words[at : at + 5]), chain)
            if part == " ".join(words[at : at + 5]):
                continue
            spoiled.append((text, " ".join([*words[:at], part, *words[at + 5 :]])))
        else:
            spoiled.append((text, garbled.garble(text, chain)))
        correct.append(value(rng) + " " + rng.choice(DECOYS + [""] * 6))
    found = {i: r for i, _, r in garbled.examine([s for _, s in spoiled], model)}
    assert len(found) / len(spoiled) > 0.97
    restored = sum(found.get(i) == t for i, (t, _) in enumerate(spoiled))
    assert restored / len(spoiled) > 0.9
    assert len(list(garbled.examine(correct, model))) / len(correct) < 0.01


def test_lossy_and_torn(model):
    values = ["Khoa�ng v��t", "cá»‘i xay bá»‹ bá» quÃªn", "ga (XÃ ĐÃ MÃ)", "suối do người Màn (Ærøvik)", "Ðồn điền", "Bà\xadn"]
    got = {i: r for i, _, r in garbled.examine(values, model)}
    assert set(got) == {0, 1} and got[0] is None and got[1] is None


def test_operator(spark):
    rng = random.Random(3)
    rows = [(i, value(rng), value(rng)) for i in range(1500)]
    bad = garbled.garble("Sông Huyền Thượng nổi tiếng với tiếng nói", next(c for c in garbled.CHAINS if c.name == "utf_8>cp1252"))
    rows += [(2000, bad, None), (2001, None, bad * 300), (2002, "", " "), (2003, "plain text", "naïve"), (None, bad, bad), (2000, bad, None)]
    df = spark.createDataFrame(rows, "record_id bigint, label_vi string, description_vi string").withColumns({"id": F.lit(1), "value": F.lit("x"), "field": F.lit("y")})
    got = sorted((str(r.record_id), r.field, r.restored is not None) for r in garbled.find_garbled(df).collect())
    assert got == sorted([("2000", "label_vi", True)] * 2 + [("2001", "description_vi", True), ("None", "label_vi", True), ("None", "description_vi", True)])
    assert garbled.find_garbled(df.limit(0)).count() == 0


def test_every_likely_chain_is_tried(model):
    text = "Phường nghề Nguyễn Huyền bị bỏ quên nằm giữa đầm nước"
    names = [c.name for c in garbled.CHAINS]
    # a Cyrillic code page; none of the chains before it can have made its letters
    before = ["utf_8>latin_1", "utf_8>cp1252", "utf_8>cp1250", "utf_8>cp1254", "utf_8>cp1258", "utf_8>latin_1 x2", "utf_8>cp1252 x2"]

    class Ranked:
        letters = model.letters

        def scores(self, values):
            out = np.full((len(values), len(names)), -1.0)
            for k, name in enumerate([*before, "utf_8>cp1251"]):
                out[:, names.index(name)] = 100.0 - k
            return out

    spoiled = garbled.garble(text, garbled.CHAINS[names.index("utf_8>cp1251")])
    assert list(garbled.examine([spoiled, "a � b"], Ranked())) == [(0, "utf_8>cp1251", text), (1, "utf_8>ascii", None)]


def test_words_in_their_places_give_the_bigrams_of_whole_values():
    rng = random.Random(7)
    values = [*(value(rng) for _ in range(40)), "É A?b  x", "a-é-b é", "x é,", " đầu cuối ", "một"]

    def signed(v):
        first, last = v.split(" ")[0], v.split(" ")[-1]
        return f"“{first} {last}” – ‘{last}’ — {first}… «{last}»"

    counts = np.zeros((len(garbled.CLASSES), garbled.BUCKETS))
    garbled._count_bigrams(counts, garbled._forms(zip(*garbled._tally(pa.array(values)))))
    for k, chain in enumerate((None, *garbled.CHAINS)):
        if chain and chain.written == "tcvn3":  # cannot write all of these words; leaves out no others
            continue
        composed, decomposed = (1, 1) if chain is None else (20, 4) if chain.written == "utf_8" else (1, 0)
        direct = np.zeros(garbled.BUCKETS)
        for text, n in [(v, 18) for v in values] + [(signed(v), 6) for v in values]:
            for form, times in ((text, composed), (unicodedata.normalize("NFD", text), decomposed)):
                spoiled = garbled.garble(form, chain) if chain else form
                if spoiled is not None:
                    direct += n * times * np.bincount(garbled._bigrams(spoiled.encode("utf-8", "surrogatepass")), minlength=garbled.BUCKETS)
        assert np.array_equal(counts[k], direct), garbled.CLASSES[k]


def test_training_counts_every_correct_value(spark):
    rng = random.Random(8)
    values = sorted({value(rng) for _ in range(20000)})[:7500]
    # a long one, pairs of letters in as many values as they must be or one less, repeated values count once
    values += [" ".join(values[:20]) + " dài", *(f"Sông {n} Zwăx" for n in range(5)), *(f"Sông {n} Jqăf" for n in range(4))]
    rows = [(i, v, "not in these letters: 東") for i, v in enumerate(values + values[-4:])]
    df = spark.createDataFrame(rows, "record_id bigint, label_vi string, description_vi string")
    whole = garbled.Model(values)
    for parts in (1, 5):
        model = garbled.train(df.repartition(parts))
        assert np.array_equal(model.gain, whole.gain)
        assert model.letters.pairs == whole.letters.pairs
    assert {("z", "w"), ("w", "ă")} <= whole.letters.pairs and not {("j", "q"), ("q", "ă")} & whole.letters.pairs


def test_garbled_values_in_correct_letters_are_no_letter_statistics(spark):
    rng = random.Random(9)
    values = sorted({value(rng) for _ in range(3000)})
    lost = [f"Th?nh ph? {v.split(' ')[0]} {n}" for n, v in enumerate(values[:60])]
    df = spark.createDataFrame([(i, v, None) for i, v in enumerate(values + lost)], "record_id bigint, label_vi string, description_vi string")
    assert ("h", "?") in garbled.Model(values + lost).letters.pairs
    assert garbled.train(df).letters.pairs == garbled.Model(values).letters.pairs


def test_readings_that_do_not_differ_have_one_name(model):
    # torn: cannot be restored
    assert [(c, r) for _, c, r in garbled.examine(["há»™i nghá» thuá»™c huyá»‡n GÃ n Phan Cao"], model)] == [("utf_8>cp1252", None)]
