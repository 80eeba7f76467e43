"""Text that was decoded with the wrong encoding: a hidden Markov model labels it, inverse transforms restore it.

States: one for clean text and one for each pair (written, read) of encodings. A state's emissions are character
bigrams with a backoff to bigrams of character classes; those of a pair come from clean training text that was put
through the pair, or, where the pair maps characters one to one, from the clean model itself through the inverse map.
The most probable path labels every character; each labelled span gets the inverse transform of its state.
"""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkdex.llm.words import blocks
from inkdex.runtime import spread_scan

#: (written, read, cost of entering the state in nats): how rare the mistake is, and how little it takes to imitate it.
PAIRS = [
    ("utf-8", "cp1252", 8.0),
    ("utf-8", "mac_roman", 8.0),
    ("utf-8", "cp437", 8.0),
    ("utf-8", "cp850", 8.0),
    ("utf-8", "cp1251", 9.0),
    ("utf-8", "koi8-r", 9.0),
    ("utf-8", "cp866", 9.0),
    ("utf-8", "cp1250", 10.0),
    ("utf-8", "gbk", 9.0),
    ("gbk", "cp1252", 10.0),
    ("gbk", "cp1251", 10.0),
    ("gbk", "mac_roman", 12.0),
    ("cp1251", "cp1252", 11.0),
    ("cp1251", "koi8-r", 11.0),
    ("cp1251", "mac_roman", 14.0),
    ("koi8-r", "cp1251", 11.0),
    ("koi8-r", "cp1252", 11.0),
    ("cp866", "cp1251", 11.0),
    ("cp866", "cp1252", 13.0),
    ("cp1252", "mac_roman", 13.0),
    ("cp1252", "cp437", 20.0),
    ("cp1252", "cp850", 20.0),
    ("cp1252", "cp1251", 20.0),
    ("mac_roman", "cp1252", 24.0),
    ("cp850", "cp1252", 24.0),
]
#: The state of text whose bytes were replaced on reading; nothing restores it.
LOST = "lost"
LOST_COST, LEAVE_COST, STAY_COST, BROKEN_COST = 4.0, 3.0, 0.05, 7.0
#: Characters that are labelled at once; different bigrams that a task holds before it hands them on.
BLOCK, HELD = 1 << 18, 2_000_000

# Clean but rare characters as they stand in ordinary text, so that they don't look like mistakes.
SEED = [
    "Łódź, Kraków, Gdańsk, Wrocław, Plzeň, Košice, Győr, Timișoara, Niš, Šibenik, Żywiec, Ústí, Brașov, İzmir, Eskişehir",
    "São Paulo, Conceição, João, Ação, Málaga, Coruña, Besançon, Orléans, Århus, Ærø, Øresund, Tromsø, Malmö, Umeå, Þórshöfn, Ísafjörður",
    "NÃO, AÇÃO, CORAÇÃO, CHÂTEAU, FÊTE, ÉTÉ, NOËL, ÜBER, GRÖSSE, ÄRGER, AÑO, NIÑO, MÁS, ÀS, ÓPERA, ÎLE, MÛRE, PÂTE, Âge, Être",
    "the letters Å, Ä and Ö; ð and þ; ş, ğ, ı; č, š, ž; ł, ń, ś, ź; ř, ě, ů; ő, ű; ã, õ, ê, â, î, Ã, Õ, Ê, Â, Î",
    "α, β, γ, δ, π ≈ 3.14, Σ, Ω, Δ, θ, λ, μ; Ωmega, Alphα; √2, x ≤ y, y ≥ z, a ≠ b, ±1, ×2, ÷3, ∞, ∑, ∫, ∂, ∈, →, ←",
    "20 °C, 5 £, 7 €, 9 ¥, 3 ¢, § 4, ¶ 2, © 2020, ® and ™, ¼, ½, ¾, m², m³, 1º, 2ª, «oui», ‹a›, „ja“, †, ‡, •, ‰, №, µm, ¿qué?, ¡no!, a·b, ¬x, ¦",
    "├── src\n│   ├── main\n│   └── test\n└── docs\n┌──┐\n│  │\n└──┘\n═══ ║ ▒ █ ■ □ ● ○ ★ ☆ ✓ ✔ ✅ ❌",
    "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "Каждый человек должен обладать всеми правами и всеми свободами, без какого бы то ни было различия, как-то: в отношении расы, цвета кожи, пола, языка, религии, политических или иных убеждений.",
    "Съешь же ещё этих мягких французских булок, да выпей чаю. Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства. В чащах юга жил бы цитрус? Да, но фальшивый экземпляр!",
    "Однажды утром мы вышли из дома, чтобы купить хлеба, молока и свежих овощей; на улице было холодно, но солнце уже светило. После этого он сказал: «Это слово стоит здесь, такие как оно — тоже».",
    "НОВЫЕ КНИГИ. Важные сообщения и общие правила: что, где, когда, почему, между, через, после, около, только, который, которые, некоторые, другие, очень, может, нужно, время, система, страница, поиск, запрос.",
    "Всі люди народжуються вільними і рівними у своїй гідності та правах. Всички хора се раждат свободни и равни по достойнство и права. Сва људска бића рађају се слободна и једнака у достојанству и правима.",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
    "🙂 👍 🎉 📚 🔎 💻 👩‍💻 🇪🇺 ❤️",
    "ƒ, œ, Œ, æ, Æ, ß, ÿ, Ÿ, ſ, ŋ, Đ, đ, Ð, ð, Þ, þ; Ñandú, Øre, Łza, Čapek, Šk, Žižka, Čech",
]


def _codec(name: str) -> str:
    return {"gbk": "gb18030"}.get(name, name)


@lru_cache(1 << 16)
def _byte_of(c: str, read: str) -> bytes | None:
    """The bytes that ``read`` shows as ``c``; what cp1252 leaves undefined is shown as the control of the same code."""
    try:
        return c.encode(read)
    except UnicodeEncodeError:
        if ord(c) < 256 and read == "cp1252":
            return bytes([ord(c)])
        if read == "gbk":
            try:
                return c.encode("gb18030")
            except UnicodeEncodeError:
                return None
        return None


def unread(text: str, read: str) -> bytes | None:
    """The bytes that ``read`` shows as ``text``; None if there are none."""
    parts = [_byte_of(c, read) for c in text]
    return None if None in parts else b"".join(parts)


def misread(text: str, written: str, read: str) -> str | None:
    """``text`` written in one encoding and read in another; None if it can't be written so."""
    try:
        data = text.encode(_codec(written))
    except UnicodeEncodeError:
        return None
    if read == "cp1252":
        return "".join(_show_1252(b) for b in data)
    return data.decode(_codec(read), "replace")


@lru_cache(256)
def _show_1252(b: int) -> str:
    try:
        return bytes([b]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(b)


def _as_1252(c: str) -> str:
    """A C1 control as cp1252 shows its byte: texts read as Latin-1 and as cp1252 are the same to the model."""
    return _show_1252(ord(c)) if "\x80" <= c < "\xa0" else c


# Ranges of code points with a common character, in order; the first that holds a character counts.
RANGES = [
    ("break", "\t\n\v\f\r"), ("blank", " "), ("digit", "0-9"), ("a", "a-z"), ("A", "A-Z"), ("ascii", "!-~"), ("control", "\x00-\x1f\x7f"), ("c1", "\x80-\x9f"),
    ("hidden", "\xa0\xad -‏ - ⁠-⁯﻿︀-️"), ("lat", "àâäáãåæçèéêëìíîïñòóôöõøœùúûüýÿß"), ("LAT", "ÀÂÄÁÃÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÖÕØŒÙÚÛÜÝŸ"), ("quote", "¡¿«»"), ("sign", "\xa1-\xbf×÷€™№ƒ"),
    ("latin", "\xc0-ɏ"), ("phonetic", "ɐ-ʯ"), ("mark", "ʰ-ͯ"), ("greek", "Ͱ-Ͽ"), ("cyr", "а-яё"), ("CYR", "А-ЯЁ"), ("cyrillic", "Ѐ-ԯ"),
    ("typo", "–—‘’“”…"), ("point", "‐-⁞"), ("letterlike", "₠-⅏"), ("math", "⅐-⏿"), ("box", "─-╿"), ("shape", "▀-➿"),
    ("cjkpoint", "　-〿！-／：-？"), ("kana", "぀-ヿ"), ("han1", ""), ("han2", ""), ("han", "㐀-鿿豈-﫿"), ("lost", "�"), ("private", "-"), ("emoji", "\U0001f000-\U0001faff"), ("far", "԰-￿"), ("astral", "\U00010000-\U0010ffff"),
]


def _spans(text: str) -> Iterable[tuple[int, int]]:
    k = 0
    while k < len(text):
        if k + 2 < len(text) and text[k + 1] == "-":
            yield ord(text[k]), ord(text[k + 2])
            k += 3
        else:
            yield ord(text[k]), ord(text[k])
            k += 1


_TABLE = [(name, list(_spans(spec))) for name, spec in RANGES]


@lru_cache(1 << 16)
def kind_of(c: str) -> str:
    """The class of a character in the clean model; Han characters by their level in GB 2312."""
    n = ord(c)
    if 0x4E00 <= n < 0xA000:
        try:
            return "han1" if c.encode("gb2312")[0] < 0xD8 else "han2"
        except UnicodeEncodeError:
            return "han"
    for name, spans in _TABLE:
        if any(a <= n <= b for a, b in spans):
            return name
    return "astral"


#: How many characters a class has, in round numbers.
SIZES = {"break": 5, "blank": 1, "digit": 10, "a": 26, "A": 26, "ascii": 32, "control": 28, "c1": 32, "hidden": 40, "lat": 31, "LAT": 31, "quote": 4, "sign": 34, "latin": 330, "phonetic": 96, "mark": 190, "greek": 130, "cyr": 33, "CYR": 33, "cyrillic": 240, "typo": 7, "point": 60, "letterlike": 110, "math": 600, "box": 128, "shape": 570, "cjkpoint": 90, "kana": 190, "han1": 3755, "han2": 3008, "han": 21000, "lost": 1, "private": 6400, "emoji": 1500, "far": 20000, "astral": 100000}


def _utf8_kind(b: int) -> str:
    return "t" if b < 0xC0 else "2" if b < 0xC4 else "r" if b in (0xD0, 0xD1) else "3" if b in (0xE2, 0xE3, 0xEF) else "h" if 0xE4 <= b <= 0xE9 else "4" if b == 0xF0 else "?"


def _gbk_kind(b: int) -> str:
    return "p" if 0xA1 <= b <= 0xA9 else "1" if 0xB0 <= b <= 0xD7 else "2" if 0xD8 <= b <= 0xF7 else "?"


@lru_cache(1 << 18)
def kind_in(c: str, written: str, read: str) -> str | None:
    """The class of a character in the model of a pair: the roles of its bytes in the written encoding; None if it has no bytes."""
    if written == "clean" or c < "\x80":
        return kind_of(c)
    raw = _byte_of(c, read)
    by = _utf8_kind if written == "utf-8" else _gbk_kind
    return None if raw is None else "".join(by(b) if b > 127 else "." for b in raw)


def _sizes(written: str, read: str) -> dict[str, int]:
    """How many characters each class of a pair's model has."""
    by = _utf8_kind if written == "utf-8" else _gbk_kind
    if read != "gbk":
        return dict(Counter(by(b) for b in range(128, 256)))
    return dict(Counter(by(b) + (by(b2) if b2 > 127 else ".") for b in range(129, 255) for b2 in [*range(0x40, 0x7F), *range(0x80, 0xFF)]))


#: Counted bigrams: ascending keys (code point before << 21 | code point), and how often; behind ``ANY`` characters are counted alone.
Counts = tuple[np.ndarray, np.ndarray]
ANY, CODE = 0x1FFFFF, 0x1FFFFF


def total_of(parts: list[Counts]) -> Counts:
    """The sum of counts."""
    keys = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in parts)])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def bigrams(texts: Iterable[str]) -> Counts:
    """The bigrams of texts, each begun by a line break, none reaching over to the next text."""
    texts = ["\n" + t for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    there = np.zeros(CODE + 1, bool)
    there[points] = True
    codes = np.flatnonzero(there)
    number = np.zeros(CODE + 1, np.int64)
    number[codes] = np.arange(len(codes))
    points = number[points]
    pairs = np.delete(points[:-1] * len(codes) + points[1:], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))[:-1] - 1)
    if len(codes) <= 4_096:
        n = np.bincount(pairs)
        pairs = np.flatnonzero(n)
        n = n[pairs]
    else:
        pairs, n = np.unique(pairs, return_counts=True)
    keys = codes[pairs // max(len(codes), 1)] << 21 | codes[pairs % max(len(codes), 1)]
    return np.concatenate((keys, codes | ANY << 21)), np.concatenate((n, np.bincount(points, minlength=len(codes))))


def tally(texts: Iterable[str]) -> list[Counts]:
    """The counts that a model is made of: of ASCII texts, of others, and of those as gbk shows their UTF-8."""
    plain, others = [], []
    for t in texts:
        (plain if t.isascii() else others).append(t)
    shown = ((misread(t, "utf-8", "gbk") or "").replace("\ufffd", "") for t in others)
    return [bigrams(plain), bigrams(others), bigrams(shown)]


def misread_counts(counts: Counts, written: str, read: str) -> Counts:
    """The bigrams of texts put through a pair, from those of the texts: ``read`` shows each byte by itself.

    Bytes that ``read`` doesn't have are left out, with the bigrams they are in.
    """
    keys, n = counts
    alone = keys >> 21 == ANY
    codes, many = keys[alone] & CODE, n[alone]
    first, last, inner = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64), []
    for k, (c, m) in enumerate(zip(codes.tolist(), many.tolist())):
        try:
            shown = [ord(_show(b, read)) if b > 127 else b for b in chr(c).encode(_codec(written))]
        except UnicodeEncodeError:
            shown = [0xFFFD]
        first[k], last[k] = shown[0], shown[-1]
        inner += [(ANY << 21 | x, m) for x in shown] + [(x << 21 | y, m) for x, y in zip(shown, shown[1:])]
    pairs = keys[~alone]
    over = last[np.searchsorted(codes, pairs >> 21)] << 21 | first[np.searchsorted(codes, pairs & CODE)]
    x = np.array(inner, np.int64).reshape(-1, 2)
    keys, n = total_of([(over, n[~alone]), (x[:, 0], x[:, 1])])
    there = (keys >> 21 != 0xFFFD) & (keys & CODE != 0xFFFD)
    return keys[there], n[there]


class Bigrams:
    """P(character | the one before): counts, backed off to classes of characters by the number of different successors."""

    def __init__(self, written: str, read: str, counts: Counts):
        self.written, self.read = written, read
        self.sizes = SIZES if written == "clean" else SIZES | _sizes(written, read)
        keys, n = counts
        alone = keys >> 21 == ANY
        codes, many = keys[alone] & CODE, n[alone]
        self.keys, self.n = keys[~alone], n[~alone]
        self.singles = Counter(dict(zip(map(chr, codes.tolist()), many.tolist())))
        names = [kind_in(c, written, read) for c in self.singles]
        order = list(dict.fromkeys(names))
        kinds = np.array([order.index(k) for k in names], np.int64)
        self.kinds, self.after = Counter(), Counter()
        for k, m in zip(names, many.tolist()):
            self.kinds[k] += m
        before = np.searchsorted(codes, self.keys >> 21)
        met = kinds[before] * len(order) + kinds[np.searchsorted(codes, self.keys & CODE)]
        for k, m in zip(*total_of([(met, self.n)])):
            self.after[order[k // len(order)], order[k % len(order)]] = int(m)
        self.followers = Counter(dict(zip(self.singles, np.bincount(before, minlength=len(codes)).tolist())))
        self.total = sum(self.kinds.values())
        self.logs: dict[tuple[str, str], float] = {}

    def met(self, before: str, c: str) -> int:
        """How often ``c`` stands behind ``before``."""
        key = ord(before) << 21 | ord(c)
        k = self.keys.searchsorted(key)
        return int(self.n[k]) if k < len(self.keys) and self.keys[k] == key else 0

    def log(self, before: str, c: str) -> float:
        """Log probability of ``c`` behind ``before``."""
        if (known := self.logs.get((before, c))) is None:
            if len(self.logs) > 500_000:
                self.logs.clear()
            known = self.logs[before, c] = self._log(before, c)
        return known

    def _log(self, before: str, c: str) -> float:
        k, j = kind_in(c, self.written, self.read), kind_in(before, self.written, self.read)
        if k is None:
            return -60.0
        within = (self.singles[c] + 0.5) / (self.kinds[k] + 0.5 * self.sizes.get(k, 64))
        overall = (self.kinds[k] + 0.2) / (self.total + 10.0)
        by_kind = (self.after[j, k] + 4.0 * overall) / (self.kinds[j] + 4.0)
        more = 6.0 + self.followers[before]
        return math.log((self.met(before, c) + more * by_kind * within) / (self.singles[before] + more))

    def logs_of(self, before: np.ndarray, now: np.ndarray) -> np.ndarray:
        """``log`` of many pairs of code points."""
        codes, at = np.unique(np.concatenate((before, now)), return_inverse=True)
        j, k = at[: len(before)], at[len(before) :]
        chars = list(map(chr, codes.tolist()))
        names = [kind_in(c, self.written, self.read) for c in chars]
        order = {x: n for n, x in enumerate(dict.fromkeys(names))}
        kind = np.array([order[x] for x in names], np.int64)
        many = lambda counter, of: np.array([counter[x] for x in of], float)
        kinds, sizes = many(self.kinds, order), np.array([self.sizes.get(x, 64) for x in order], float)
        after = many(self.after, [(x, y) for x in order for y in order]).reshape(len(order), len(order))
        singles, more = many(self.singles, chars), 6.0 + many(self.followers, chars)
        within = (singles + 0.5) / (kinds + 0.5 * sizes)[kind]
        overall = (kinds + 0.2) / (self.total + 10.0)
        by_kind = ((after + 4.0 * overall) / (kinds + 4.0)[:, None])[kind[j], kind[k]]
        keys = before << 21 | now
        met = np.zeros(len(keys))
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            met = np.where(self.keys[place] == keys, self.n[place], 0)
        out = np.log((met + more[j] * by_kind * within[k]) / (singles[j] + more[j]))
        return np.where(np.array([x is None for x in names], bool)[k], -60.0, out)

    def text(self, text: str) -> float:
        """Log probability of a text but for its first character."""
        return sum(map(self.log, text, text[1:]))


@lru_cache(1 << 16)
def _back(c: str, written: str, read: str) -> str | None:
    """What a character was written as, by a pair that maps characters one to one."""
    if c < "\x80":
        return c
    raw = _byte_of(c, read)
    if raw is None or len(raw) != 1:
        return None
    try:
        return raw.decode(written)
    except UnicodeDecodeError:
        return None


def _show(b: int, read: str) -> str:
    return _show_1252(b) if read == "cp1252" else bytes([b]).decode(read, "replace")


@lru_cache(32)
def _bytes_table(read: str) -> np.ndarray:
    """The byte of every code point in a single-byte encoding; 0 for ASCII, 1 for what it doesn't have."""
    out = np.ones(0x110000, np.uint8)
    out[:128] = 0
    for b in range(128, 256):
        if (c := _show(b, read)) != "\ufffd":
            out[ord(c)] = b
    if read == "cp1252":
        out[128:160] = range(128, 160)
    return out


def _broken(points: np.ndarray, written: str, read: str) -> np.ndarray:
    """Where characters beyond ASCII can't be what ``read`` shows of whole characters of ``written``."""
    b = _bytes_table(read)[points]
    high = b >= 128
    if written == "gbk":  # pairs of high bytes
        begin = np.maximum.accumulate(np.where(high & ~np.concatenate(([False], high[:-1])), np.arange(len(b)), 0))
        last = high & ~np.concatenate((high[1:], [False]))
        return (last & ((np.arange(len(b)) - begin) % 2 == 0)) | (b == 1)
    cont = (b >= 0x80) & (b < 0xC0)
    n1, n2, n3 = (np.concatenate((cont[k:], np.zeros(min(k, len(b)), bool)))[: len(b)] for k in (1, 2, 3))
    two, three, four = (b >= 0xC2) & (b < 0xE0) & n1, (b >= 0xE0) & (b < 0xF0) & n1 & n2, (b >= 0xF0) & (b < 0xF5) & n1 & n2 & n3
    whole = two | three | four
    for k, x in ((1, whole.copy()), (2, three | four), (3, four)):
        whole[k:] |= x[:-k]
    return (high & ~whole) | (b == 1)


class Model:
    """The states with their emissions and the costs of entering them, from the counts of clean texts (see ``tally``)."""

    def __init__(self, counts: list[Counts]):
        plain, others, shown = (total_of([a, b]) for a, b in zip(counts, tally(SEED)))
        clean = total_of([plain, others])
        self.clean = Bigrams("clean", "clean", clean)
        self.pairs: dict[int, Bigrams] = {}
        self.names, enter = ["clean"], [0.0]
        for k, (written, read, cost) in enumerate(PAIRS, 1):
            if written in ("utf-8", "gbk"):
                self.pairs[k] = Bigrams(written, read, total_of([plain, shown]) if read == "gbk" else misread_counts(clean, written, read))
            self.names.append(f"{written}>{read}")
            enter.append(cost)
        self.names.append(LOST)
        self.enter = np.array([*enter, LOST_COST], np.float32)
        self.known, self.where = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.rows = np.zeros((0, len(self.names)), np.float32)

    def emit(self, before: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Log probabilities of code points ``now`` behind ``before`` in every state."""
        codes, at = np.unique(np.concatenate((before, now)), return_inverse=True)
        j, k = at[: len(before)], at[len(before) :]
        chars, lost = list(map(chr, codes.tolist())), now == 0xFFFD
        clean = self.clean.logs_of(before, now)
        out = [np.where(lost, -30.0, clean)]
        for n, (written, read, _) in enumerate(PAIRS, 1):
            if n in self.pairs:
                seen = np.array([ord(_as_1252(c)) for c in chars], np.int64) if read == "cp1252" else codes
                out.append(self.pairs[n].logs_of(seen[j], seen[k]))
            else:
                was = [_back(c, written, read) for c in chars]
                known = np.array([x is not None for x in was], bool)[k]
                back = np.array([ord(x or "\n") for x in was], np.int64)
                out.append(np.where(known, self.clean.logs_of(back[j], back[k]), -60.0))
        odd = np.array([kind_of(c) in ("far", "astral", "mark", "private") for c in chars], bool)[k]
        out.append(np.where(lost, -1.0, np.maximum(clean - 0.3, np.where(odd, -7.0, -60.0))))
        return np.stack(out, 1).astype(np.float32)

    def emissions(self, before: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Log probabilities of (before, now) in every state; each different pair is worked out once."""
        keys, inverse = np.unique(before.astype(np.int64) << 21 | now, return_inverse=True)
        if len(self.known) > 400_000:
            self.known, self.where, self.rows = self.known[:0], self.where[:0], self.rows[:0]
        fresh = keys[~np.isin(keys, self.known, assume_unique=True)]
        if len(fresh):
            more = self.emit(fresh >> 21, fresh & CODE)
            place = np.searchsorted(self.known, fresh)
            self.known = np.insert(self.known, place, fresh)
            self.where = np.insert(self.where, place, np.arange(len(self.rows), len(self.rows) + len(fresh)))
            self.rows = np.concatenate((self.rows, more))
        return self.rows[self.where[np.searchsorted(self.known, keys)]][inverse]


def _paths(e: np.ndarray, begins: np.ndarray, sizes: np.ndarray, enter: np.ndarray) -> list[np.ndarray]:
    """The most probable states of each sequence e[begin : begin + size], all walked in lockstep, longest first."""
    states, many = e.shape[1], len(begins)
    offsets = np.cumsum(sizes) - sizes
    came = np.zeros((int(sizes.sum()), states), np.int8)
    score = e[begins] - enter
    rows = np.arange(states)
    for t in range(1, int(sizes[0])):
        live = int(np.searchsorted(-sizes, -t, "left"))
        s = score[:live]
        leave = s - np.float32(LEAVE_COST)
        leave[:, 0] = s[:, 0]
        best = leave.argmax(1)
        move = leave[np.arange(live), best][:, None] - enter
        stay = s - np.float32(STAY_COST)
        stay[:, 0] = s[:, 0]
        moved = move > stay
        came[offsets[:live] + t] = np.where(moved, best[:, None], rows)
        score[:live] = np.where(moved, move, stay) + e[begins[:live] + t]
    out = []
    for k in range(many):
        at, path = int(score[k].argmax()), np.zeros(sizes[k], np.int8)
        for t in range(int(sizes[k]) - 1, -1, -1):
            path[t] = at
            at = int(came[offsets[k] + t, at])
        out.append(path)
    return out


def _suspects(texts: list[str], model: Model) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The texts of a block that may leave the clean state: (index, places, log probabilities there).

    Only characters beyond ASCII and those right behind them tell states apart. A text in which no state gains more
    over the clean one than entering it costs cannot leave the clean state. A pair's state pays for every character
    that cannot belong to a whole character of its written encoding.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(lengths + 1) - lengths - 1
    before = np.concatenate(([np.uint32(10)], points[:-1]))
    told = np.flatnonzero((points > 127) | (before > 127))
    if not len(told):
        return []
    e = model.emissions(before[told], points[told])
    for narrow in (False, True):
        owner = np.searchsorted(starts, told, "right") - 1
        who, first = np.unique(owner, return_index=True)
        most = np.add.reduceat(np.maximum(e - e[:, :1], 0), first, axis=0)
        keep = (most[:, 1:] > model.enter[1:]).any(1)
        if narrow or not keep.any():
            break
        held = keep[np.searchsorted(who, owner)]
        told, e = told[held], e[held]
        # the structure of the written encoding, over the texts that are left
        texts_held = np.zeros(len(texts), bool)
        texts_held[who[keep]] = True
        inside = np.flatnonzero(np.repeat(texts_held, lengths + 1))
        place = np.searchsorted(inside, told)
        for k, (written, read, _) in enumerate(PAIRS, 1):
            if k in model.pairs and read != "gbk":
                e[:, k] -= BROKEN_COST * _broken(points[inside], written, read)[place]
    ends = np.append(first, len(told))
    return [(int(who[k]), told[ends[k] : ends[k + 1]] - starts[who[k]], e[ends[k] : ends[k + 1]].copy()) for k in np.flatnonzero(keep)]


def _pieces(text: str, size: int) -> list[str]:
    """A text in pieces of about ``size`` characters, cut behind white space where there is some near."""
    out = []
    while len(text) > size:
        cut = max(text.rfind("\n", size - 2_000, size), text.rfind(" ", size - 2_000, size)) + 1 or size
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text]


def label(texts: list[str], model: Model, block: int = BLOCK) -> list[list[tuple[int, int, int]]]:
    """Of each text the spans (begin, end, state) that the model takes for wrongly decoded, in order.

    Texts are looked through in blocks of about ``block`` characters, longer ones in pieces, so that memory is bounded;
    the paths of the few that may hold something are found together, as many places at a time.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    pieces = [(k, p) for k, t in enumerate(texts) for p in _pieces(t, block)]
    offsets, pool, pooled = {}, [], 0

    def walk() -> None:
        nonlocal pooled
        pool.sort(key=lambda x: -len(x[1]))
        sizes = np.array([len(x[1]) for x in pool])
        for (n, places, _), path in zip(pool, _paths(np.concatenate([x[2] for x in pool]), np.cumsum(sizes) - sizes, sizes, model.enter)):
            if path.any():
                (k, piece), offset = pieces[n], offsets.get(n, 0)
                edges = np.flatnonzero(np.diff(path, prepend=-1, append=-1))
                spans = [(int(places[a]), min(int(places[b - 1]) + 1, len(piece)), int(path[a])) for a, b in zip(edges, edges[1:]) if path[a]]
                out[k] += [(x[0] + offset, x[1] + offset, x[2]) for x in spans if _holds(piece, x, model)]
        pool.clear()
        pooled = 0

    for n in range(1, len(pieces)):
        if pieces[n][0] == pieces[n - 1][0]:
            offsets[n] = offsets.get(n - 1, 0) + len(pieces[n - 1][1])
    for lo, hi in blocks([p for _, p in pieces], block):
        for n, places, e in _suspects([p for _, p in pieces[lo:hi]], model):
            pool.append((lo + n, places, e))
            pooled += len(places)
        if pooled > 2 * block:
            walk()
    if pool:
        walk()
    return [sorted(x) for x in out]


def _holds(text: str, span: tuple[int, int, int], model: Model) -> bool:
    """Whether undoing the span makes the text more probable by more than the mistake is improbable; lost bytes speak for themselves."""
    begin, end, state = span
    if model.names[state] == LOST:
        return "\ufffd" in text[begin:end]
    around = lambda x: text[begin - 1 : begin] + x + text[end : end + 1] if begin else "\n" + x + text[end : end + 1]
    was = inverse(text[begin:end], *model.names[state].split(">"))
    return was != text[begin:end] and model.clean.text(around(was)) - model.clean.text(around(text[begin:end])) > model.enter[state]


@lru_cache(64)
def _as_read(read: str) -> str:
    """Name of the error handler that leaves bytes which the written encoding doesn't explain as they were read."""
    codecs.register_error(f"as-read-{read}", lambda e: ("".join(_show(b, read) for b in e.object[e.start : e.end]) if read != "gbk" else "\ufffd", e.end))
    return f"as-read-{read}"


def inverse(span: str, written: str, read: str) -> str:
    """What was written, where bytes explain it; characters that ``read`` cannot show, and bytes that ``written`` doesn't have, stay."""
    out, run = [], bytearray()

    def flush():
        out.append(run.decode(_codec(written), _as_read(read)))
        run.clear()

    for c in span:
        raw = _byte_of(c, read)
        if raw is None:
            flush()
            out.append(c)
        else:
            run += raw
    flush()
    return "".join(out)


def restore(text: str, spans: list[tuple[int, int, int]], model: Model) -> str:
    """``text`` with each span replaced by what was written; lost bytes stay lost."""
    out, at = [], 0
    for begin, end, state in spans:
        name = model.names[state]
        out += [text[at:begin], text[begin:end] if name == LOST else inverse(text[begin:end], *name.split(">"))]
        at = end
    return "".join(out) + text[at:]


#: Controls, private and lost characters: not in texts that the model should take for clean.
_ODD = re.compile("[\x80-\x9f\ue000-\uf8ff\ufffd]").search


#: Where UTF-8 read as cp1252 may stand: what shows the first byte of a character, then a later one.
_COMMON = re.compile("[\xc2-\xf4][" + "".join(re.escape(_show_1252(b)) for b in range(0x80, 0xC0)) + "\x80-\x9f]").search


def fine_texts(texts: list[str], first: Model) -> list[str]:
    """The texts in which neither the commonest mistake nor a first model shows."""
    fine = [t for t in texts if t.isascii() or not (_ODD(t) or _COMMON(t) and inverse(t, "utf-8", "cp1252") != t)]
    return [t for t, spans in zip(fine, label(fine, first)) if not spans]


def train(clean: list[str], mixed: list[str] = ()) -> Model:
    """A model from clean texts, and from those of ``mixed`` in which neither the commonest mistake nor a first model shows. Deterministic."""
    counts = tally(clean)
    first = Model(counts)
    fine = fine_texts(list(mixed), first)
    return Model([total_of(list(x)) for x in zip(counts, tally(fine))]) if fine else first


def tally_all(texts: DataFrame, column: str, first: Model | None = None) -> list[Counts]:
    """``tally`` of every row of a table, null and empty texts aside; with ``first`` of those that ``fine_texts`` lets pass.

    Tasks count what they read, the sums come to the driver: one row for each different bigram.
    """
    model = texts.sparkSession.sparkContext.broadcast(first)

    def run(batches):
        parts: list[list[Counts]] = [[], [], []]

        def rows():
            for part, held in enumerate(parts):
                keys, n = total_of(held)
                held.clear()
                for k in range(0, len(keys), 100_000):
                    x = keys[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), part, np.int32)), pa.array(x), pa.array(n[k : k + 100_000])], ["part", "pair", "n"])

        for b in batches:
            for lo, hi in blocks(rest := [t for t in b.column(0).to_pylist() if t], 16 * BLOCK):
                some = rest[lo:hi]
                for held, counts in zip(parts, tally(fine_texts(some, model.value) if model.value else some)):
                    held.append(counts)
                if sum(len(k) for held in parts for k, _ in held) > HELD:
                    for held in parts:
                        held[:] = [total_of(held)]
                    if sum(len(held[0][0]) for held in parts) > HELD // 2:
                        yield from rows()
        yield from rows()

    counted = texts.select(F.col(column).alias("t")).mapInArrow(run, "part int, pair bigint, n bigint").groupBy("part", "pair").agg(F.sum("n").alias("n")).toArrow()
    part, pair, n = (counted.column(c).to_numpy() for c in ("part", "pair", "n"))
    return [total_of([(pair[part == k], n[part == k])]) for k in range(3)]


def garbled(df: DataFrame, key: str, text: str, clean: DataFrame, clean_text: str = "text") -> DataFrame:
    """The rows whose text was, in whole or in part, decoded with the wrong encoding.

    Result: (key, n_chars int: characters labelled at first, pairs array<string>: the states found, restored string:
    the text with every span undone, as often as it shows any; lost bytes stay as they are). Null and empty texts
    are in no result, repeats each have a row, texts are read whole. ``clean``: texts known to be clean.

    The model is made of the bigrams of every text of ``clean`` and of every text of ``df`` that a first model, made of
    ``clean`` alone, takes for clean; tasks count them. So ``df`` is read twice, to train and to be labelled, both
    times without a shuffle.
    """
    source = spread_scan(df.select(F.col(key).alias("k"), F.col(text).alias("t")), "k")
    trusted = tally_all(clean, clean_text)
    own = tally_all(source, "t", Model(trusted))
    own = [(keys, n - (keys >> 21 != ANY)) for keys, n in own]  # a text doesn't vouch for itself: of each bigram one is left out
    model = df.sparkSession.sparkContext.broadcast(Model([total_of([a, (b[0][b[1] > 0], b[1][b[1] > 0])]) for a, b in zip(trusted, own)]))
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        hmm = model.value
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = [k for k, t in enumerate(texts) if t and not t.isascii()]
            now, chars, pairs = {k: texts[k] for k in rows}, {}, {}
            forms = {k: {texts[k]} for k in rows}
            while rows:
                again = []
                for k, spans in zip(rows, label([now[k] for k in rows], hmm)):
                    if spans:
                        chars.setdefault(k, sum(e - a for a, e, _ in spans))
                        pairs.setdefault(k, {}).update(dict.fromkeys(hmm.names[s] for _, _, s in spans))
                        fixed = restore(now[k], spans, hmm)
                        if fixed not in forms[k]:  # else it is settled, or would go in a circle
                            forms[k].add(fixed)
                            now[k] = fixed
                            again.append(k)
                rows = again
            if hit := sorted(pairs):
                cols = [b.column(0).take(pa.array(hit)), pa.array([chars[k] for k in hit], pa.int32()), pa.array([list(pairs[k]) for k in hit], pa.list_(pa.string())), pa.array([now[k] for k in hit], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["k", "n_chars", "pairs", "restored"])

    found = source.mapInArrow(run, f"k {kind}, n_chars int, pairs array<string>, restored string")
    return found.withColumnRenamed("k", key)
