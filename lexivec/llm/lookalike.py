"""Problem 2: bring text that looks the same to one form.

Method: look-alike pairs over strings and code points are joined by union-find into
transitive classes; each class is represented by its most frequent member in the
corpus; a multi-pattern automaton rewrites every value greedily (leftmost, longest).

The pairs come from the Unicode tables: the confusable skeletons that Spark's own ICU library
holds, for all letters of scripts written from left to right, and compatibility characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.session import cut_lineage, spread_out

#: Letters that others may be drawn like.
BASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzĐđ"

# Signs and letters the skeletons join too coarsely or not at all, drawn like the first of their line.
DRAWN_LIKE = """
- ‐ ‑
– −
’ ʼ
: ∶
! ǃ
e ℮
l ӏ ǀ
"""

#: Letters whose skeleton is a letter they can be told apart from: without its dot, of another shape or height.
TOLD_APART = "ǀıɩɪιꙇᎥ𑣃ꭵӏ" "гᴦⲅꭇꭈꮁ" "γɣʏỿყᶌꭚ" "υʋꭎꭒ" "ɯƦƍƄЬƖſքẝꬵ" "ᎽᏚᏀ"

#: Compatibility characters that are drawn like their expansion, as ranges of code points.
DRAWN_ALIKE = ((0x00B5, 0x00B5), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2024, 0x2026),
               (0x2160, 0x217F), (0x2F00, 0x2FD5), (0xFB00, 0xFB06))

#: Marks above that replace the dot of an i: a dotless i under them looks like an i.
OVER_DOT = "̀́̂̃̄̆̈̉̌"
DOTLESS = "ıι"

#: Drawn as nothing, besides all of category Cf.
UNSEEN = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065),
          (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))

FIELDS = ("label_vi", "description_vi", "aliases_vi")


def is_unseen(ch: str) -> bool:
    kind = unicodedata.category(ch)
    return (
        kind == "Cf"
        or (kind == "Cc" and not ch.isspace())
        or any(lo <= ord(ch) <= hi for lo, hi in UNSEEN)
    )


def skeletons(spark: SparkSession, letters: list[str]) -> dict[str, str]:
    """The confusable skeleton of each letter, from the ICU library on Spark's class path."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    return dict(zip(letters, checker.getSkeleton("\n".join(letters)).split("\n")))


@lru_cache(maxsize=None)
def candidates() -> list[str]:
    """Letters that may be drawn like one of BASE: of scripts written from left to right, no ideographs or syllables."""
    skipped = ("CJK", "HANGUL", "TANGUT", "NUSHU", "KHITAN", "EGYPTIAN", "CUNEIFORM", "ANATOLIAN", "BAMUM", "VAI", "YI ")
    out = []
    for cp in range(0x80, 0x20000):
        ch = chr(cp)
        if unicodedata.category(ch) in ("Lu", "Ll", "Lo", "Nl") and unicodedata.bidirectional(ch) == "L":
            if not unicodedata.decomposition(ch) and not unicodedata.name(ch, "CJK").startswith(skipped) and ch not in TOLD_APART:
                out.append(ch)
    return out


def drawn_like_letters(spark: SparkSession) -> list[tuple[str, str]]:
    """Letters of other scripts and the letter of BASE they are drawn like.

    Case is seen: of letters with one skeleton a capital goes with the capital, and no letter of a script with
    cases goes with one of the other case.
    """
    of = skeletons(spark, [*BASE, *candidates()])
    by_skeleton: dict[str, list[str]] = {}
    for b in BASE:
        by_skeleton.setdefault(of[b], []).append(b)
    out = []
    for ch in candidates():
        targets = by_skeleton.get(of[ch], [])
        kind = unicodedata.category(ch)
        small = [b for b in targets if b.islower()]
        large = [b for b in targets if b.isupper()]
        cased = kind in ("Lu", "Ll") and unicodedata.name(ch).startswith(("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "COPTIC"))
        order = small + large if kind == "Ll" else large + small
        order = [b for b in order if not cased or b.isupper() == (kind == "Lu")]
        if order:
            out.append((ch, order[0]))
    return out


def alike_pairs(spark: SparkSession) -> list[tuple[str, str]]:
    """Pairs of strings that look the same, in NFD; the second is '' for what is not drawn."""
    out: list[tuple[str, str]] = drawn_like_letters(spark)
    for line in DRAWN_LIKE.split("\n"):
        first, *others = [c for c in line if c != " "] or [""]
        out += [(o, first) for o in others]
    return out + [(i + m, "i" + m) for i in DOTLESS for m in OVER_DOT] + table_pairs()


@lru_cache(maxsize=None)
def table_pairs() -> list[tuple[str, str]]:
    """What is not drawn, and characters drawn like their compatibility expansion."""
    out: list[tuple[str, str]] = []
    for cp in range(0x80, 0x110000):
        ch = chr(cp)
        if is_unseen(ch):
            out.append((ch, ""))
            continue
        tag, _, codes = unicodedata.decomposition(ch).partition(" ")
        if tag in ("<wide>", "<narrow>", "<font>", "<noBreak>") or (
            tag == "<compat>" and any(lo <= cp <= hi for lo, hi in DRAWN_ALIKE)
        ):
            to = unicodedata.normalize("NFD", "".join(chr(int(c, 16)) for c in codes.split()))
            if not to.isspace():
                out.append((ch, to))
    out += [(chr(c), "") for c in range(0x20) if not chr(c).isspace()] + [("\x7f", "")]
    return out


class LookAlikes:
    """Union-find over strings and code points."""

    def __init__(self, pairs: Iterable[tuple[str, str]]):
        self.parent: dict[str, str] = {}
        self.unseen: set[str] = set()
        for a, b in pairs:
            if b:
                self.join(a, b)
            else:
                self.unseen.add(a)

    def find(self, s: str) -> str:
        root = s
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[s] != root:
            self.parent[s], s = root, self.parent[s]
        return root

    def join(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def members(self) -> list[str]:
        """All strings and code points of any class, and those not drawn."""
        return sorted({*self.parent, *self.unseen})

    def rewrites(self, counts: dict[str, int]) -> dict[str, str]:
        """What each member becomes.

        The representative is the most frequent member; ties go to the lower code points.  A class
        that holds strings is represented by one of its strings, so that a character for two
        letters and the two letters meet in the same form however a text is cut; strings
        are then rewritten by their parts.
        """
        classes: dict[str, list[str]] = {}
        for s in self.parent:
            classes.setdefault(self.find(s), []).append(s)
        out = {s: "" for s in self.unseen}
        strings = []
        for group in classes.values():
            long = [s for s in group if len(s) > 1]
            best = min(long or group, key=lambda s: (-counts.get(s, 0), s))
            out |= {s: best for s in group if s != best}
            if long:
                strings += group
        for _ in range(3):
            for s in strings:
                to = out.get(s, s)
                parts = "".join(out.get(c, c) for c in to)
                if parts != s:
                    out[s] = parts
        return out


def automaton(keys: Iterable[tuple[str, object]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, v in keys:
        a.add_word(k, v)
    a.make_automaton()
    return a


class Rewriter:
    """Rewrites values to their one form.

    Values of characters that no rewrite touches, most of all, only lose blanks.  In values that hold no string
    of several characters the automaton's single characters are a translation table.
    """

    def __init__(self, rewrites: dict[str, str]):
        self.machine = automaton((k, (len(k), v)) for k, v in rewrites.items()) if rewrites else None
        long = [k for k in rewrites if len(k) > 1]
        self.strings = automaton((k, k) for k in long) if long else None
        self.table = {ord(k): v for k, v in rewrites.items() if len(k) == 1}
        touched = {k for k in rewrites if len(k) == 1}
        for k in long:  # one character of each string, not a mark where possible
            if not touched.intersection(k):
                touched.add(max(k, key=lambda c: (not unicodedata.combining(c), not c.isascii())))
        plain = [c for c in map(chr, [*range(0x20, 0x7F), *range(0xA1, 0x250), *range(0x1E00, 0x1F00)]) if self._stays(c, touched)]
        self.plain = re.compile(f"[{''.join(map(re.escape, plain))} ]*").fullmatch

    @staticmethod
    def _stays(ch: str, touched: set[str]) -> bool:
        d = unicodedata.normalize("NFD", ch)
        return not touched.intersection(d) and not unicodedata.combining(ch) and unicodedata.normalize("NFC", d) == ch

    def _greedy(self, s: str) -> str:
        if self.strings is None or next(self.strings.iter(s), None) is None:
            return s.translate(self.table)
        out, at = [], 0
        for end, (n, to) in self.machine.iter_long(s):
            out += (s[at : end + 1 - n], to)
            at = end + 1
        return "".join((*out, s[at:])) if out else s

    def __call__(self, s: str) -> str:
        if not self.plain(s):
            s = unicodedata.normalize("NFD", s)
            while self.machine is not None:
                # what is not drawn may have kept marks from their order: until nothing changes
                t = unicodedata.normalize("NFD", self._greedy(s))
                if t == s:
                    break
                s = t
            s = unicodedata.normalize("NFC", s)
        return " ".join(s.split())


def _values(batch: pa.RecordBatch, fields: tuple[str, ...]) -> Iterator[tuple[object, str, str]]:
    """Id, field and text of every value; arrays give each of their entries."""
    ids = batch["id"].to_pylist() if "id" in batch.schema.names else [None] * len(batch)
    for name in fields:
        for rid, v in zip(ids, batch[name].to_pylist()):
            for x in [v] if isinstance(v, str) else v or ():
                if x is not None:
                    yield rid, name, x


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def member_counts(df: DataFrame, fields: tuple[str, ...], members: list[str]) -> dict[str, int]:
    """How often each member occurs in all values, counted in partitions and summed once.

    ``members`` is a fixed set taken from the Unicode tables, so the result is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        single = {m for m in members if len(m) == 1}
        strings = automaton((m, m) for m in members if len(m) > 1)
        for batch in batches:
            for _, _, v in _values(batch, fields):
                v = unicodedata.normalize("NFD", v)
                total.update(v)
                if not v.isascii() or "..." in v:
                    total.update(m for _, m in strings.iter(v))
        kept = [(m, n) for m, n in total.items() if len(m) > 1 or m in single]
        yield _batch(kept, ["member", "n"], [pa.string(), pa.int64()])

    rows = spread_out(df.select(*fields)).mapInArrow(count, "member string, n bigint")
    return {r.member: r.n for r in rows.groupBy("member").agg(F.sum("n").alias("n")).collect()}


def learn(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> dict[str, str]:
    """The rewrites for the values of ``fields`` (strings or arrays of strings)."""
    classes = LookAlikes(alike_pairs(df.sparkSession))
    return classes.rewrites(member_counts(df, fields, classes.members()))


def canonical_values(
    df: DataFrame, rewrites: dict[str, str], id_col: str = "record_id", fields: tuple[str, ...] = FIELDS
) -> DataFrame:
    """Every value with its one form: ``id_col, field, value, canonical``.

    A narrow operation.  Nulls have no row; blank values have the form ''.  Each entry of an array has
    its own row, repeated entries repeated rows.  Other columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Rewriter(rewrites)
        for batch in batches:
            rows = [(i, f, v, to(v)) for i, f, v in _values(batch, fields)]
            kinds = [batch.schema.field("id").type, pa.string(), pa.string(), pa.string()]
            yield _batch(rows, ["id", "field", "value", "canonical"], kinds)

    cols = spread_out(df.select(F.col(id_col).alias("id"), *fields))
    return cols.mapInArrow(rewrite, f"id {kind}, field string, value string, canonical string").withColumnRenamed(
        "id", id_col
    )


def keyed_values(df: DataFrame, rewrites: dict[str, str], id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """``id, field, form, raw``: 16-byte digests of each value's form and of the value; blank values are left out."""
    kind = df.schema[id_col].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Rewriter(rewrites)
        for batch in batches:
            rows = []
            for i, f, v in _values(batch, fields):
                c = to(v)
                if c:
                    raw = blake2b(v.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    form = raw if c == v else blake2b(c.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    rows.append((i, fields.index(f), form, raw))
            kinds = [batch.schema.field("id").type, pa.int8(), pa.binary(), pa.binary()]
            yield _batch(rows, ["id", "field", "form", "raw"], kinds)

    cols = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *fields)
    return spread_out(cols).mapInArrow(digest, f"id {kind}, field tinyint, form binary, raw binary")


def same_look_pairs(
    df: DataFrame, id_col: str = "record_id", fields: tuple[str, ...] = FIELDS, rewrites: dict[str, str] | None = None
) -> DataFrame:
    """Pairs of rows whose values of a field look the same but differ in code points.

    ``<id>_a, <id>_b, field`` with ``a < b``, once for each pair and field.  Nulls and blank values
    have no pairs, nor have rows with a null id; equal values have none with each other.

    Values are grouped by their form with partial aggregation; only forms written in more than one
    way go on.  Their distinct spellings are paired, and spellings are then joined to their rows, so
    a spelling shared by very many rows is never compared with itself; the work follows the result.
    """
    v = several_spellings(df, id_col, fields, rewrites)
    spelled = v.select("field", "form", "raw").distinct()
    pairs = spelled.withColumnRenamed("raw", "raw1").join(
        spelled.withColumnRenamed("raw", "raw2"), ["field", "form"]
    ).where("raw1 < raw2")
    one = v.select("field", F.col("raw").alias("raw1"), F.col("id").alias("id1"))
    two = v.select("field", F.col("raw").alias("raw2"), F.col("id").alias("id2"))
    rows = pairs.drop("form").join(one, ["field", "raw1"]).join(two, ["field", "raw2"]).where("id1 != id2")
    return rows.select(
        F.least("id1", "id2").alias(f"{id_col}_a"), F.greatest("id1", "id2").alias(f"{id_col}_b"), _name(fields)
    ).distinct()


def several_spellings(
    df: DataFrame, id_col: str, fields: tuple[str, ...], rewrites: dict[str, str] | None
) -> DataFrame:
    """``id, field, form, raw`` of the values whose form is written in more than one way."""
    values = cut_lineage(keyed_values(df, rewrites or learn(df, fields), id_col, fields))
    several = (
        values.groupBy("field", "form")
        .agg(F.min("raw").alias("least"), F.max("raw").alias("most"))
        .where("least != most")
        .select("field", "form")
    )
    return cut_lineage(values.join(several, ["field", "form"], "left_semi").distinct())


def _name(fields: tuple[str, ...]):
    return F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field").cast("int") + 1).alias("field")


def same_look_classes(
    df: DataFrame, id_col: str = "record_id", fields: tuple[str, ...] = FIELDS, rewrites: dict[str, str] | None = None
) -> DataFrame:
    """Rows whose value of a field is written differently elsewhere, with the class of their look.

    ``<id>, field, look_class, spelling``: two rows of a field look the same if they share a class, and differ in
    code points if their spellings differ.  As many rows as values, however large a class is.
    Nulls, blank values and null ids have no class; repeated rows come out once.
    """
    v = several_spellings(df, id_col, fields, rewrites)
    return v.select(
        F.col("id").alias(id_col), _name(fields), F.lower(F.hex("form")).alias("look_class"), F.lower(F.hex("raw")).alias("spelling")
    )
