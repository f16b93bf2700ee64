"""Problem 3: find text decoded with a wrong encoding and restore it.

Method: a multinomial classifier on hashed byte bigrams is trained on all correct values of
the corpus, garbled synthetically by every known encoding chain.  As no chain carries anything
over a blank, the bigrams of all garbled values are counted exactly from how often each word stands at the
start, within and at the end of a value.  It predicts the exact chain of each value; the chain is inverted and the result
verified: multi-byte sequences must decode strictly, single-byte alphabets must give
words that the corpus' own letter statistics find likelier.  What was restored is examined again,
so chains of several readings are undone one by one, and a text that stays garbled is not given out.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.session import cut_lineage, spread_out

FIELDS = ("label_vi", "description_vi")
BUCKETS = 1 << 14
SMOOTHING = 0.02
#: Log odds of a value to be garbled by one chain.
PRIOR = -9.0
#: In so many values, and in one of so many, a pair of letters must occur to count as correct: there are a few garbled values
#: among those with correct letters, as many more as the corpus is larger.
SUPPORT = 4
SUPPORT_SHARE = 1500
#: Every correct value counts in so many parts: some of them with signs, and some with decomposed letters.
PARTS, SIGNED, DECOMPOSED = 24, 6, 4
#: So many strange pairs a restoration of letters must explain.
EXPLAINED = 2
#: Words whose strangeness a task remembers.
KNOWN_WORDS = 1 << 16
#: Readings over one another that are undone.
MOST_READINGS = 4
#: What no text that was restored whole has: controls.
_UNDEFINED = re.compile("[\x00-\x08\x0e-\x1f\x80-\x9f\ufffd]")

# The letters of Vietnamese beyond ASCII, composed.
LETTERS = (
    "àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
    "ÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬĐÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴ"
)
MARKS = "̛̣̀́̂̃̆̉"

# The TCVN 5712-3 (ABC) byte of each letter.
TCVN3 = {
    0xA1: "Ă", 0xA2: "Â", 0xA3: "Ê", 0xA4: "Ô", 0xA5: "Ơ", 0xA6: "Ư", 0xA7: "Đ", 0xA8: "ă", 0xA9: "â", 0xAA: "ê",
    0xAB: "ô", 0xAC: "ơ", 0xAD: "ư", 0xAE: "đ", 0xB5: "à", 0xB6: "ả", 0xB7: "ã", 0xB8: "á", 0xB9: "ạ", 0xBB: "ằ",
    0xBC: "ẳ", 0xBD: "ẵ", 0xBE: "ắ", 0xC6: "ặ", 0xC7: "ầ", 0xC8: "ẩ", 0xC9: "ẫ", 0xCA: "ấ", 0xCB: "ậ", 0xCC: "è",
    0xCE: "ẻ", 0xCF: "ẽ", 0xD0: "é", 0xD1: "ẹ", 0xD2: "ề", 0xD3: "ể", 0xD4: "ễ", 0xD5: "ế", 0xD6: "ệ", 0xD7: "ì",
    0xD8: "ỉ", 0xDC: "ĩ", 0xDD: "í", 0xDE: "ị", 0xDF: "ò", 0xE1: "ỏ", 0xE2: "õ", 0xE3: "ó", 0xE4: "ọ", 0xE5: "ồ",
    0xE6: "ổ", 0xE7: "ỗ", 0xE8: "ố", 0xE9: "ộ", 0xEA: "ờ", 0xEB: "ở", 0xEC: "ỡ", 0xED: "ớ", 0xEE: "ợ", 0xEF: "ù",
    0xF1: "ủ", 0xF2: "ũ", 0xF3: "ú", 0xF4: "ụ", 0xF5: "ừ", 0xF6: "ử", 0xF7: "ữ", 0xF8: "ứ", 0xF9: "ự", 0xFA: "ỳ",
    0xFB: "ỷ", 0xFC: "ỹ", 0xFD: "ý", 0xFE: "ỵ",
}

# VISCII (RFC 1456), the letters of the bytes 0x80 to 0xFF, and those below.
VISCII_HIGH = (
    "ẠẮẰẶẤẦẨẬẼẸẾỀỂỄỆỐỒỔỖỘỢỚỜỞỊỎỌỈỦŨỤỲÕắằặấầẩậẽẹếềểễệốồổỗỠƠộờởịỰỨỪỬơớƯ"
    "ÀÁÂÃẢĂẳẵÈÉÊẺÌÍĨỳĐứÒÓÔạỷừửÙÚỹỵÝỡưàáâãảăữẫèéêẻìíĩỉđựòóôõỏọụùúũủýợỮ"
)
VISCII_LOW = {0x02: "Ẳ", 0x05: "Ẵ", 0x06: "Ẫ", 0x14: "Ỷ", 0x19: "Ỹ", 0x1E: "Ỵ"}

# VNI writes a vowel and a sign for its tone, the sign depending on the vowel's own mark.
VNI_ALONE = {"í": "í", "ì": "ì", "ỉ": "æ", "ĩ": "ó", "ị": "ò", "ơ": "ô", "ư": "ö", "đ": "ñ", "ỵ": "î"}
VNI_TONES = {
    "": {"\u0301": "ù", "\u0300": "ø", "\u0309": "û", "\u0303": "õ", "\u0323": "ï"},
    "\u0306": {"": "ê", "\u0301": "é", "\u0300": "è", "\u0309": "ú", "\u0303": "ü", "\u0323": "ë"},
    "\u0302": {"": "â", "\u0301": "á", "\u0300": "à", "\u0309": "å", "\u0303": "ã", "\u0323": "ä"},
}


@dataclass(frozen=True)
class Chain:
    """Text was written as ``written`` and read as ``read``, ``times`` times over.

    ``lossy`` chains leave ``mark`` in place of what was lost; ``written`` is "text" where the writing lost it.
    """

    written: str
    read: str
    times: int = 1
    lossy: bool = False
    mark: str = "\ufffd"

    @property
    def name(self) -> str:
        lost = f" {self.mark}" if self.written == "text" else ""
        return f"{self.written}>{self.read}{lost}" + (f" x{self.times}" if self.times > 1 else "")

    @property
    def family(self) -> str:
        if self.lossy:
            return "lossy"
        if self.read in MULTI_BYTE or self.written.startswith("utf_") and self.written != "utf_8":
            return "wide"
        return "legacy" if self.written != "utf_8" else f"utf_8 x{self.times}"


READ_AS = ("latin_1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp1258", "cp437", "cp850", "cp852",
           "mac_roman", "koi8_r", "cp866", "cp874")
MULTI_BYTE = ("gbk", "big5", "shift_jis", "euc_kr")
CHAINS = (
    *(Chain("utf_8", r) for r in READ_AS),
    *(Chain("utf_8", r, 2) for r in ("latin_1", "cp1252", "cp1258", "mac_roman")),
    *(Chain("utf_8", r) for r in MULTI_BYTE),
    *(Chain(w, "latin_1") for w in ("utf_16_le", "utf_16_be")),
    Chain("utf_7", "ascii"),
    *(Chain("tcvn3", r) for r in ("cp1252", "cp1258")),
    *(Chain("viscii", r) for r in ("latin_1", "cp1252")),
    Chain("vni", "cp1252"),
    *(Chain("cp1258", r) for r in ("cp1252", "mac_roman")),
    Chain("utf_8", "ascii", lossy=True),
    *(Chain(w, "utf_8", lossy=True) for w in ("cp1258", "tcvn3", "viscii")),
    *(Chain("text", r, lossy=True, mark="?") for r in ("ascii", "latin_1", "cp1252")),
)
CLASSES = ("", *(c.name for c in CHAINS))
FAMILIES = tuple(sorted({c.family for c in CHAINS}))


@lru_cache(maxsize=None)
def alphabet(charset: str) -> tuple[str, ...]:
    """The character of each byte; undefined bytes stand for the control of the same number."""
    if charset == "tcvn3":
        return tuple(TCVN3.get(b, chr(b)) for b in range(256))
    if charset == "viscii":
        return tuple(VISCII_LOW.get(b, chr(b)) for b in range(128)) + tuple(VISCII_HIGH)
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(charset))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@lru_cache(maxsize=None)
def _table(charset: str) -> str:
    return "".join(alphabet(charset))


@lru_cache(maxsize=None)
def byte_of(charset: str) -> dict[str, str]:
    """The byte of each character, as the character of that number."""
    out = {c: chr(b) for b, c in reversed(list(enumerate(alphabet(charset))))}
    for b in range(0x80, 0xA0):  # controls that another reading left
        out.setdefault(chr(b), chr(b))
    return out


@lru_cache(maxsize=4096)
def _bytes_for(ch: str, charset: str) -> bytes | None:
    """The bytes of one composed character: itself, or a letter the alphabet has and marks."""
    to = byte_of(charset)
    d = unicodedata.normalize("NFD", ch)
    heads = [(unicodedata.normalize("NFC", d[:k] + d[k + 1 :]), d[k]) for k in range(1, len(d))]
    for parts in ((ch,), *heads, tuple(d)):
        if all(p in to for p in parts):
            return bytes(ord(to[p]) for p in parts)
    return None


@lru_cache(maxsize=None)
def vni_forms() -> dict[str, str]:
    """How VNI writes each letter."""
    out = {}
    for ch in LETTERS[: len(LETTERS) // 2]:
        base, *marks = unicodedata.normalize("NFD", ch)
        if "\u031b" in marks:
            base = VNI_ALONE[unicodedata.normalize("NFC", base + "\u031b")]
        own = next((m for m in marks if m in VNI_TONES), "")
        tone = next((m for m in marks if m not in VNI_TONES and m != "\u031b"), "")
        out[ch] = VNI_ALONE.get(ch) or base + VNI_TONES[own].get(tone, "")
    return out | {a.upper(): b.upper() for a, b in out.items()}


@lru_cache(maxsize=None)
def _vni_back() -> tuple[re.Pattern, dict[str, str]]:
    back = {b: a for a, b in vni_forms().items()}
    return re.compile("|".join(sorted(map(re.escape, back), key=len, reverse=True))), back


def _write(text: str, charset: str) -> bytes | None:
    if charset == "utf_8":
        return text.encode("utf-8")
    text = unicodedata.normalize("NFC", text)
    if charset == "vni":
        forms = vni_forms()
        try:
            return "".join(forms.get(ch, ch) for ch in text).encode("cp1252")
        except UnicodeEncodeError:
            return None
    if charset.startswith("utf_"):
        return text.encode(charset)
    parts = [_bytes_for(ch, charset) for ch in text]
    return None if None in parts else b"".join(parts)


def garble(text: str, chain: Chain) -> str | None:
    """``text`` as the chain spoils it; None where the chain cannot write it."""
    if chain.written == "text":
        return unicodedata.normalize("NFC", text).encode(chain.read, errors="replace").decode(chain.read)
    for _ in range(chain.times):
        data = _write(text, chain.written)
        if data is None:
            return None
        if chain.lossy or chain.read in MULTI_BYTE or chain.read == "ascii":
            text = data.decode(chain.read, errors="replace")
        else:
            text = codecs.charmap_decode(data, "strict", _table(chain.read))[0]
    return text


_SEQUENCE = re.compile(
    "[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)
#: Lead bytes of Vietnamese letters without what must follow; the first kind is never correct text.
_TORN = re.compile("\xe1[\xba\xbb](?![\x80-\xbf])")
_BROKEN = re.compile("\xe1[\xba\xbb](?![\x80-\xbf])|[\xc3-\xc6](?![\x80-\xbf])(?=[ a-z\\n]|$)")
SIGNS = "“”‘’–—…«»·•©®™°€£±½×"


@lru_cache(maxsize=None)
def readable() -> frozenset[str]:
    """What a reading can have left: all characters of the code pages."""
    return frozenset(c for r in READ_AS for c in alphabet(r) if not c.isascii())


def _plausible(ch: str) -> bool:
    return ch in SIGNS or ch in MARKS or ch in readable() or unicodedata.category(ch)[0] == "L"


def _telling(ch: str) -> bool:
    """Whether a decoded character speaks for the chain: Latin letters, marks and signs do."""
    return ch in SIGNS or ch in MARKS or ch in LETTERS or (ch < "\u0180" and ch.isalpha())


def _undo_utf8(text: str, read: str, last: bool) -> tuple[str, int, int, int]:
    """The text with all strictly decodable sequences decoded, their number, and torn and broken ones left.

    Before the last round any character may come out; after it letters, marks, signs and what another reading left.
    """
    to = byte_of(read)
    data = "".join([to.get(c, "\uffff") for c in text])
    out, left, at, n = [], [], 0, 0
    for m in _SEQUENCE.finditer(data):
        ch = m.group().encode("latin_1").decode("utf-8")
        if not last or _plausible(ch):
            out += (text[at : m.start()], ch)
            left += (data[at : m.start()], "\n")
            at, n = m.end(), n + (not last or _telling(ch))
    rest = "".join((*left, data[at:]))
    return "".join((*out, text[at:])), n, len(_TORN.findall(rest)), len(_BROKEN.findall(rest))


class Letters:
    """Pairs of neighbouring letters in correct words, from the number of values with each pair; that of "" is the number of all."""

    def __init__(self, seen: Counter):
        values = int(seen[""])
        least = max(min(SUPPORT, 1 + values // 500), values // SUPPORT_SHARE)
        self.pairs = {tuple(p) for p, n in seen.items() if p and n >= least}
        self.known: dict[str, int] = {}

    def strange(self, word: str) -> int:
        """Pairs of letters of ``word`` that correct words do not have; a capital after a small letter is one."""
        if word not in self.known:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            self.known[word] = self._strange(word)
        return self.known[word]

    def any_strange(self, text: str) -> bool:
        return any(not w.isascii() and self.strange(w) for w in text.split(" "))

    def _strange(self, word: str) -> int:
        w = unicodedata.normalize("NFC", word).strip("()“”‘’«».,;:…!?\"'")
        inner = sum(a.islower() and b.isupper() for a, b in zip(w, w[1:]))
        w = w.lower()
        return inner + sum(p not in self.pairs for p in zip(f" {w}", f"{w} "))


def _undo_letters(text: str, chain: Chain, letters: Letters) -> tuple[str, int]:
    """The text with each word rewritten that the chain can have made and that is likelier restored."""
    to = byte_of(chain.read)
    if chain.written == "vni":
        pattern, forms = _vni_back()

        def read(w: str) -> str:
            return pattern.sub(lambda m: forms[m.group()], w)
    else:
        back = alphabet(chain.written)

        def read(w: str) -> str:
            return unicodedata.normalize("NFC", "".join(back[ord(to[c])] for c in w))

    if not letters.any_strange(text):
        return text, 0
    words = re.split("( +)", text)
    fixed = [read(w) if not w.isascii() and all(c in to for c in w) else w for w in words]
    right = [
        f != w and all(c.isascii() or c in LETTERS for c in f if c not in SIGNS) and not all(c in SIGNS for c in w)
        for w, f in zip(words, fixed)
    ]
    # a look-alike letter alone says nothing about the encoding
    alike = [r and w.replace("Ð", "Đ") == f for r, w, f in zip(right, words, fixed)]
    gain = [
        letters.strange(w) if r and not a and not letters.strange(f) else 0
        for r, a, w, f in zip(right, alike, words, fixed)
    ]
    likelier = [g > 0 for g in gain]
    n = sum(likelier) if sum(gain) and sum(gain) + any(alike) >= EXPLAINED else 0
    # where most words became likelier the whole text was spoiled, also words that could be either
    take = right if 2 * n > sum(not w.isascii() for w in words) else likelier
    return "".join(f if t else w for t, w, f in zip(take, words, fixed)), n


def _vietnamese(s: str) -> bool:
    return all(c in LETTERS or c in MARKS or c in SIGNS or (c.isascii() and c.isprintable()) for c in s)


def _undo_words(text: str, read: str) -> tuple[str | None, int]:
    """Words that were read as a multi-byte encoding, and how many decode strictly to Vietnamese letters.

    A blank is no byte of a longer character, so words stay apart.  None where a word of such characters does not decode.
    """
    out, n, left = [], 0, 0
    for w in re.split("( +)", text):
        if not w.isascii():
            try:
                fixed = w.encode(read).decode("utf-8")
            except UnicodeError:
                fixed = ""
            if fixed and fixed != w and _vietnamese(fixed):
                w, n = fixed, n + 1
            else:
                left += any("\u2e80" <= c < "\ue000" or c >= "\uf900" for c in w)
        out.append(w)
    return (None if left else "".join(out)), n


_UTF7 = re.compile(r"\+([A-Za-z0-9/]{3,})-?")
_UTF16 = {
    "utf_16_le": re.compile("(?:[\x00-\xff][\x00-\x03\x1e\x20])*[\x00-\xff]\x00(?:[\x00-\xff][\x00-\x03\x1e\x20])+"),
    "utf_16_be": re.compile("(?:[\x00-\x03\x1e\x20][\x00-\xff])*\x00[\x00-\xff](?:[\x00-\x03\x1e\x20][\x00-\xff])+"),
}


def _undo_wide(text: str, written: str) -> tuple[str, int]:
    """Stretches of UTF-7 or UTF-16 that decode strictly to Vietnamese letters, and their number."""
    n = 0

    def read(m: re.Match) -> str:
        nonlocal n
        try:
            data = m.group().encode("latin_1")
            fixed = (f"+{m.group(1)}-".encode() if written == "utf_7" else data).decode(written)
        except UnicodeError:
            return m.group()
        if not _vietnamese(fixed):
            return m.group()
        n += 1
        return fixed

    return (_UTF7 if written == "utf_7" else _UTF16[written]).sub(read, text), n


#: A question mark for a lost letter: between small letters or between capitals, in no address.
_LOST = re.compile(r"(?:^|(?<=\s))[^\s/=&.@]*?[^\W\d_]\?+(?:[^\W\d_A-Z]|(?<=[A-Z]\?)[A-Z])")


def is_marked(text: str) -> bool:
    """Whether something is left in place of what was lost."""
    return "\ufffd" in text or ("?" in text and _LOST.search(text) is not None)


def invert(text: str, chain: Chain, letters: Letters) -> tuple[str | None, bool]:
    """The restored text, or None, and whether the text was verified to be garbled by the chain."""
    if chain.lossy:
        return None, "\ufffd" in text if chain.mark != "?" else _LOST.search(text) is not None
    lost = "\ufffd" in text
    if chain.read in MULTI_BYTE:
        fixed, n = _undo_words(text, chain.read)
        return (None if lost else fixed), n > 0
    if chain.family == "wide":
        fixed, n = _undo_wide(text, chain.written)
        return (None if lost else fixed), n > 0
    if chain.written != "utf_8":
        fixed, n = _undo_letters(text, chain, letters)
        return (None if lost or not n else fixed), n > 0
    fixed, done, torn, broken = text, 0, 0, 0
    for k in range(chain.times):
        fixed, n, t, broken = _undo_utf8(fixed, chain.read, k + 1 == chain.times)
        done += n > 0
        torn += t
        if not n:
            break
    if done == chain.times:
        return (fixed if not broken and "\ufffd" not in fixed else None), True
    return None, torn > 0 and chain.times == 1


class Model:
    """Multinomials over hashed byte bigrams, of correct text and of text spoiled by each chain.

    A value is correct throughout, or in one stretch spoiled by one chain.
    """

    def __init__(self, values: list[str]):
        keys, n = _tally(pa.array(values, pa.string()))
        counts = np.zeros((len(CLASSES), BUCKETS))
        _count_bigrams(counts, _forms(zip(keys, n)))
        self._fit(counts)
        self.letters = Letters(Counter({k[1:]: c for k, c in zip(keys, n) if k[0] == PAIR}))

    @classmethod
    def counted(cls, counts: np.ndarray, letters: Letters) -> Model:
        """The model of a corpus whose bigrams, for each class, were counted."""
        model = cls.__new__(cls)
        model._fit(counts)
        model.letters = letters
        return model

    def _fit(self, counts: np.ndarray) -> None:
        p = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
        logp = np.log((1 - SMOOTHING) * p + SMOOTHING / BUCKETS)
        self.gain = (logp[1:] - logp[0]).T.astype(np.float32).copy()
        self.members = [np.array([k for k, c in enumerate(CHAINS) if c.family == f]) for f in FAMILIES]
        # no chain of a family gains more by a bigram
        self.most = np.stack([self.gain[:, m].max(axis=1) for m in self.members], axis=1)

    def scores(self, values: list[str]) -> np.ndarray:
        """For each value and chain, the log odds that a stretch of the value was spoiled by the chain.

        Chains of a family whose bound is not positive are not looked at: they have a score of minus infinity.
        Lossy chains are looked at where something was left in place of what was lost.
        """
        out = np.full((len(values), len(CHAINS)), -np.inf)
        if not values:
            return out
        data = [v.encode("utf-8", "surrogatepass").replace(b"\n", b" ") for v in values]
        bound = _best_stretches(data, self.most)
        bound[:, FAMILIES.index("lossy")] = [1.0 if is_marked(v) else -1.0 for v in values]
        for f, members in enumerate(self.members):
            at = np.flatnonzero(bound[:, f] > 0)
            if len(at):
                gain = np.ascontiguousarray(self.gain[:, members])
                out[np.ix_(at, members)] = _best_stretches([data[i] for i in at.tolist()], gain)
        return out


def _best_stretches(data: list[bytes], gain: np.ndarray) -> np.ndarray:
    """For each text and column of ``gain``, the highest sum over a stretch of its bigrams, and the prior.

    It is found from running sums and their running minima.
    """
    out = np.zeros((len(data), gain.shape[1]))
    for at in range(0, len(data), 500):
        part = data[at : at + 500]
        joined = np.frombuffer(b"\n" + b"\n".join(part) + b"\n", dtype=np.uint8).astype(np.int64)
        gains = gain[_hash(joined[:-1], joined[1:])].astype(np.float64)
        starts = np.concatenate(([0], np.cumsum([len(d) + 1 for d in part])[:-1]))
        # each value's sums lie far below those before, so minima begin anew
        floor = np.abs(gains).sum(axis=0).max() + 1.0
        drop = np.zeros(len(gains))
        drop[starts] = -2 * floor
        sums = np.cumsum(gains + drop[:, None], axis=0)
        best = sums - np.minimum.accumulate(sums - gains, axis=0)
        out[at : at + 500] = np.maximum.reduceat(best, starts, axis=0) + PRIOR
    return out


def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * 256 + b) * 40503 >> 4) % BUCKETS


def _bigrams(data: bytes) -> np.ndarray:
    a = np.frombuffer(data + b"\n", dtype=np.uint8).astype(np.int64)
    return _hash(a[:-1], a[1:])


#: The places of a word in its value: within, first, last, alone; and what stands for a pair of letters.
WITHIN, FIRST, LAST, ALONE, PAIR = "01234"


def _letter_pairs(values: list[str]) -> tuple[list[str], list[int]]:
    """Each pair of neighbouring letters, or of a letter and a word's bound, and in how many of the values it occurs; "" occurs in all."""
    text = " " + " \n ".join(values).lower() + " "
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    value = np.cumsum(codes == 10)
    a, b = codes[:-1], codes[1:]
    inner = (a != 10) & (b != 10) & ((a != 32) | (b != 32))
    pairs = np.sort((value[:-1] << 42 | a << 21 | b)[inner])
    once = np.append(pairs[1:] != pairs[:-1], [True] * bool(len(pairs)))
    pairs = np.sort(pairs[once] & ((1 << 42) - 1))
    ends = np.flatnonzero(np.append(pairs[1:] != pairs[:-1], [True] * bool(len(pairs))))
    n = np.diff(ends, prepend=-1).tolist()
    return [chr(p >> 21) + chr(p & ((1 << 21) - 1)) for p in pairs[ends].tolist()] + [""], n + [len(values)]


def _tally(values: pa.Array) -> tuple[list[str], list[int]]:
    """Words after the sign of their place, and pairs of letters, with how often they occur in the values."""
    words = pc.split_pattern(values, " ")
    bounds = words.offsets.to_numpy()
    place = np.zeros(bounds[-1] - bounds[0], np.int8)
    place[bounds[:-1]] += 1
    place[bounds[1:] - 1] += 2
    signs = pa.array([WITHIN, FIRST, LAST, ALONE]).take(pa.array(place))
    counted = pc.value_counts(pc.binary_join_element_wise(signs, words.flatten(), ""))
    pairs, in_values = _letter_pairs(values.to_pylist())
    return counted.field(0).to_pylist() + [PAIR + p for p in pairs], counted.field(1).to_pylist() + in_values


def _forms(tallied: Iterable[tuple[str, int]]) -> Counter:
    """How often each word, with its place, is to be learned: as it is, and in values with the signs that these have now and then.

    A signed value is “first last” – ‘last’ — first… «last».
    """
    out: Counter = Counter()
    for key, n in tallied:
        place, word = key[0], key[1:]
        if place == PAIR:
            continue
        out[key] += n * (PARTS - SIGNED)
        if place in (FIRST, ALONE):
            out.update({f"{FIRST}“{word}": n * SIGNED, f"{WITHIN}–": n * SIGNED, f"{WITHIN}—": n * SIGNED, f"{WITHIN}{word}…": n * SIGNED})
        if place in (LAST, ALONE):
            out.update({f"{WITHIN}{word}”": n * SIGNED, f"{WITHIN}‘{word}’": n * SIGNED, f"{LAST}«{word}»": n * SIGNED})
    return out


def _count_bigrams(counts: np.ndarray, forms: Counter) -> None:
    """Adds the bigrams of correct text, and of what each chain makes of it, to the row of each class.

    Those of a word go from the last byte before it to the first it leaves to the next; what a chain cannot write is left out.
    """
    # a blank follows all words but the last, and is spoiled with them
    composed = [(key[1:] + ("" if key[0] in (LAST, ALONE) else " "), key[0], n) for key, n in forms.items()]
    decomposed = [(unicodedata.normalize("NFD", text), place, n) for text, place, n in composed]
    for k, chain in enumerate((None, *CHAINS)):
        if chain is None:  # both ways of writing letters are correct
            parts = ((composed, 1), (decomposed, 1))
        elif chain.written == "utf_8":
            parts = ((composed, PARTS - DECOMPOSED), (decomposed, DECOMPOSED))
        else:
            parts = ((composed, 1),)  # letters are composed when written
        blank = " " if chain is None else garble(" ", chain)[-1]
        before = {WITHIN: blank, FIRST: "", LAST: blank, ALONE: ""}
        after = {WITHIN: "", FIRST: "", LAST: "\n", ALONE: "\n"}
        for words, weight in parts:
            spoiled, times = [], []
            for text, place, n in words:
                left = text if chain is None else garble(text, chain)
                if left is not None:
                    spoiled.append((before[place] + left + after[place]).encode("utf-8", "surrogatepass"))
                    times.append(n * weight)
            if not spoiled:
                continue
            data = np.frombuffer(b"".join(spoiled), dtype=np.uint8).astype(np.int64)
            size = np.array([len(d) for d in spoiled])
            times = np.repeat(np.array(times, dtype=float), size)
            times[np.cumsum(size) - 1] = 0  # nothing reaches from one to the next
            counts[k] += np.bincount(_hash(data[:-1], data[1:]), weights=times[:-1], minlength=BUCKETS)


def _first_alike(text: str, chain: Chain, restored: str | None, letters: Letters) -> Chain:
    """The first chain that does the same: where readings do not differ for a text, the same one is named always."""
    for c in CHAINS[: CHAINS.index(chain)]:
        if (c.written, c.times, c.family) != (chain.written, chain.times, chain.family) or c.lossy:
            continue
        if restored is not None and invert(text, c, letters) == (restored, True):
            return c
        if restored is None and c.times == 1 and c.family != "wide" and all(byte_of(c.read).get(ch) == byte_of(chain.read).get(ch) for ch in text):
            return c
    return chain


def _suspects(values: list[str], scores: np.ndarray) -> list[int]:
    """The values that a chain may have spoiled, by their scores or what it left in place of what was lost."""
    return np.flatnonzero((scores > 0).any(axis=1) | np.array([is_marked(v) for v in values], dtype=bool)).tolist()


_LETTERS_ALONE = np.array([c.family == "legacy" for c in CHAINS])


def _likeliest(values: list[str], model: Model) -> Iterator[tuple[int, Chain, str | None]]:
    """Index, chain and text with the chain undone of each value that the likeliest verified chain has spoiled."""
    scores = model.scores(values)
    for i in _suspects(values, scores):
        marked = is_marked(values[i])
        if not marked and not (scores[i] > 0)[~_LETTERS_ALONE].any() and not model.letters.any_strange(values[i]):
            continue  # these chains can only be told by strange words
        for k in np.argsort(-scores[i]):
            if scores[i, k] <= 0 and not (marked and CHAINS[k].lossy):
                continue
            restored, sure = invert(values[i], CHAINS[k], model.letters)
            if sure:
                yield i, _first_alike(values[i], CHAINS[k], restored, model.letters), restored
                break


def _named(chains: list[Chain]) -> str:
    """The readings in the order they happened, repeated ones counted."""
    runs: list[list] = []
    for c in reversed(chains):
        if runs and runs[-1][0] == (c.written, c.read):
            runs[-1][1] += c.times
        else:
            runs.append([(c.written, c.read), c.times, c.mark])
    return " + ".join(Chain(*pair, times=n, mark=m).name for pair, n, m in runs)


def examine(values: list[str], model: Model, most: int = MOST_READINGS) -> Iterator[tuple[int, str, str | None]]:
    """Index, chain and restored text of each garbled value.

    What a chain left is examined again, until nothing is found; what is garbled still after ``most``
    rounds, or holds what cannot be undone, is not restored.
    """
    found: dict[int, list[Chain]] = {}
    text: dict[int, str | None] = {}
    at, now = list(range(len(values))), values
    for _ in range(most + 1):
        hits = [(at[i], c, r) for i, c, r in _likeliest(now, model)]
        for i, chain, restored in hits:
            if len(found.setdefault(i, [])) == most:
                restored = None
            elif not (found[i] and chain.lossy):
                found[i].append(chain)
            text[i] = restored
        at = [i for i, _, _ in hits if text[i] is not None]
        now = [text[i] for i in at]
        if not at:
            break
    for i in sorted(found):
        yield i, _named(found[i]), None if text[i] is None or _UNDEFINED.search(text[i]) else text[i]


_CORRECT = re.compile(f"^[ -~{LETTERS}]*[{LETTERS}][ -~{LETTERS}]*$")


def _stacked(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """``id, field, value`` of all values that a chain can have made.

    These have other characters than printable ASCII, a question mark inside a word or a shift of UTF-7.
    """
    items = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    return (
        df.select(F.col(id_col).alias("id"), items.alias("x"))
        .select("id", "x.field", "x.value")
        .where(F.col("value").rlike(r"[^\x20-\x7E]|\w\?+\w|\+[A-Za-z0-9/]{3,}"))
    )


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys, n = _tally(batch.column(0).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(n, pa.int64())], ["key", "n"])


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigrams of each class for words, and the tallies of letters as they are."""
    counts = np.zeros((len(CLASSES), BUCKETS))
    for batch in batches:
        keys, n = batch["key"].to_pylist(), batch["n"].to_pylist()
        _count_bigrams(counts, _forms(zip(keys, n)))
        pairs = [(k[1:], c) for k, c in zip(keys, n) if k[0] == PAIR]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in pairs], pa.string()), pa.nulls(len(pairs), pa.int32()), pa.array([float(c) for _, c in pairs], pa.float64())],
            ["pair", "bigram", "n"],
        )
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts.ravel()[at], pa.float64())], ["pair", "bigram", "n"]
    )


def _sums(values: DataFrame, parts: int) -> DataFrame:
    """``key, n``: what is tallied in the distinct values; a row for each word and place, and for each pair of letters.

    Their number is given, so that small partitions are not joined before Python work.
    """
    tallied = values.repartition(parts, "value").distinct().mapInArrow(_tallies, "key string, n bigint")
    return tallied.groupBy("key").agg(F.sum("n").alias("n"))


def _kept(values: DataFrame, model: Model, which: Callable[[list[str], Model], list[int]]) -> DataFrame:
    """The rows whose values ``which`` picks out of each batch."""
    shared = values.sparkSession.sparkContext.broadcast(model)  # BUCKETS x chains numbers and the letter pairs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(which(batch["value"].to_pylist(), shared.value), pa.int64()))

    return values.mapInArrow(keep, values.schema)


def _trained(values: DataFrame) -> tuple[Model, DataFrame]:
    """A model from all distinct correct values, those written in Vietnamese letters alone, and the rows it suspects.

    Only sums come to the driver, at most one for each class and bucket and for each pair of these letters. The values are scored
    once: scores do not depend on the pairs of letters, which are known when all garbled values are.
    """
    is_correct = F.col("value").rlike(_CORRECT.pattern)
    cores = values.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, values.rdd.getNumPartitions())
    # sums of whole numbers, the same whatever the partitions
    sums = (
        _sums(values.where(is_correct).select("value"), parts).repartition(cores, "key")
        .mapInArrow(_learned, "pair string, bigram int, n double").groupBy("pair", "bigram").agg(F.sum("n").alias("n")).toArrow()
    )
    of_bigrams, of_pairs = sums.filter(pc.is_valid(sums["bigram"])), sums.filter(pc.is_valid(sums["pair"]))
    counts = np.zeros(len(CLASSES) * BUCKETS)
    counts[of_bigrams["bigram"].to_numpy()] = of_bigrams["n"].to_numpy()
    seen = Counter(dict(zip(of_pairs["pair"].to_pylist(), of_pairs["n"].to_pylist())))
    model = Model.counted(counts.reshape(len(CLASSES), BUCKETS), Letters(seen))
    suspects = cut_lineage(_kept(spread_out(values), model, lambda v, m: _suspects(v, m.scores(v))))
    # some garbled values have correct letters only
    spoiled = _kept(suspects.where(is_correct).select("value"), model, lambda v, m: [i for i, _, _ in examine(v, m)])
    in_spoiled = _sums(spoiled, cores).where(F.col("key").startswith(PAIR)).toArrow()
    seen.subtract(dict(zip([k[1:] for k in in_spoiled["key"].to_pylist()], in_spoiled["n"].to_pylist())))
    model = Model.counted(counts.reshape(len(CLASSES), BUCKETS), Letters(seen))
    return model, suspects


def train(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> Model:
    """A model from all correct values."""
    return _trained(_stacked(df, fields[0], fields))[0]


def find_garbled(
    df: DataFrame, id_col: str = "record_id", fields: tuple[str, ...] = FIELDS, model: Model | None = None
) -> DataFrame:
    """The garbled values: ``id_col, field, value, chain, restored``.

    ``restored`` is null where bytes are lost or a part stays garbled.  Nulls, blank and correct values have no row, an empty
    table none at all; very long values are read whole; repeated rows come out each; other columns are
    ignored.  A narrow operation but for training: every value is classified in its own partition.
    """
    values = _stacked(df, id_col, fields)
    if model is None:
        model, values = _trained(values)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch["value"].to_pylist()
            found = list(examine(values, shared.value)) if values else []
            at = pa.array([i for i, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch[c].take(at) for c in ("id", "field", "value")],
                    pa.array([c for _, c, _ in found], pa.string()),
                    pa.array([r for _, _, r in found], pa.string()),
                ],
                ["id", "field", "value", "chain", "restored"],
            )

    return (
        spread_out(values)
        .mapInArrow(classify, f"id {kind}, field string, value string, chain string, restored string")
        .withColumnRenamed("id", id_col)
    )
