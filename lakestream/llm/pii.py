"""Personal data, also in disguise: offset-preserving deobfuscation.

The base detectors read a text as it is. A text that shows a sign of disguise also goes through transducers, one after
the other: look-alike characters to ASCII, spelled digits to digits, written-out at and dot to signs, the latter in
addresses and between groups of digits. Each normalised character remembers the source characters it came from, so
what the same detectors find in the normalised text is mapped back to a source span.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never begins within a run of digits: where it could, it could begin at the run's start
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
MANY_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9]){11}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters that look like ASCII ones and have no compatibility form, and how digits, at and dot are spelled.
LOOK_ALIKE = dict(
    zip(
        "аАВсСеЕНіІјЈкКМоОрРѕЅТхХуУһԁԛԝӏѵѡԍαΑΒΕΖΗιΙκΚΜΝνοΟρΡτΤυΥχΧϲϳɑɡɩıʋօսհոց",
        "aABcCeEHiIjJkKMoOpPsSTxXyYhdqwlvwgaABEZHiIkKMNvoOpPtTuYxXcjagiivouhng",
        strict=True,
    )
)
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
#: Written out without brackets, an address must end in one of these: "look at the dot on" is none.
COUNTRIES = frozenset(
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf "
    "cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf "
    "gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki "
    "km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx "
    "my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc "
    "sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us "
    "uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()
)
GENERIC = frozenset(
    "com org net edu gov mil int info biz name pro mobi aero coop museum jobs travel tel asia cat post dev app xyz online "
    "site website shop store tech blog cloud club email page top wiki news media agency digital live space world network "
    "solutions services group team life today work works studio design systems software company consulting fun icu vip art".split()
)
TOP_DOMAINS = COUNTRIES | GENERIC
#: Top-level domains that are common words, too, and words that stand before a point or dot in a plain sentence.
WORDY = frozenset(
    "in is so no to my be do as by am an la se ne si sa va om name pro jobs travel post cat online site website shop store "
    "tech blog cloud club email page top news media agency digital live space world network solutions services group team "
    "life today work works studio design systems software company consulting fun art".split()
)
SENTENCE_WORDS = frozenset(
    "a an the this that these those which what each every any some one no another my your his her its our their whose "
    "same such first last next".split()
)
AT_WORDS, DOT_WORDS = r"(?:at|arroba|ät|chez)", r"(?:dot|point|punkt|punto)"

_digit = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_gap = r"[\x20\t.,-]{1,3}"
#: A run of digits and spelled digits, and the parts of it that are spelled.
DIGIT_RUN = re.compile(rf"(?i)(?:\bplus{_gap})?\b(?:[0-9]++|{_digit})\b(?:{_gap}(?:[0-9]++|{_digit})\b)+")
SPELLED = re.compile(rf"(?i)\bplus{_gap}(?=[0-9])|(?:\bplus{_gap})?\b{_digit}(?:{_gap}{_digit})*\b")
SPELLED_PART = re.compile(rf"(?i){_digit}\b|plus\b")
SPELLED_WORD = re.compile(rf"(?i)\b{_digit}\b")
#: Signs as they are written out: in brackets, as a word between spaces, or as a sign between spaces.
_AT = rf"\s?[\[({{<]\s?(?:{AT_WORDS}|@)\s?[\])}}>]\s?|[\[({{<]a[\])}}>]|\s{AT_WORDS}\s|\x20@\x20"
_DOT = rf"\s?[\[({{<]\s?(?:{DOT_WORDS}|\.)\s?[\])}}>]\s?|\s{DOT_WORDS}\s|\x20\.\x20"
WRITTEN = re.compile(
    rf"(?i)(?<![A-Za-z0-9%+_-])[A-Za-z0-9%+_-]++(?:(?:\.|{_DOT})[A-Za-z0-9%+_-]++)*+"
    rf"(?:@|{_AT})[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)+"
)
WRITTEN_AT, WRITTEN_DOT = re.compile(f"(?i){_AT}"), re.compile(f"(?i){_DOT}")
#: Signs as references of a page or escapes of an address.
ESCAPED = re.compile(r"(?i)&#0*64;|&#x0*40;|&commat;|%40|&#0*46;|&#x0*2e;|&period;|%2e")
#: Groups of digits joined by dots, written out or plain: what they are is left to the detectors.
WRITTEN_DIGITS = re.compile(rf"(?i)(?<![0-9])[0-9]++(?:(?:\.|{_DOT})[0-9]++)+")
#: A plain dot after a whole address, and a capital after it, begin a sentence; in "example.co.UK" they do not.
SENTENCE = re.compile(
    rf"(@(?:[A-Za-z0-9-]+\.)+?(?:{'|'.join(sorted(TOP_DOMAINS))}))\."
    rf"(?=[A-Z][a-z]|[A-Z]\b)(?!(?i:{'|'.join(sorted(TOP_DOMAINS - WORDY - {'it', 'at', 'me', 'us'}))})\b)"
)
DISGUISED_DOT = re.compile(rf"(?i)(?<![^\W_]){DOT_WORDS}(?![^\W_])|[\[({{<]\s?(?:{AT_WORDS}|@|\.|a)\s?[\])}}>]|\x20[@.]\x20")

Span = tuple[int, str, int]
Turn = Callable[[re.Match], str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so a long run without one costs nothing."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def ascii_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def detect(text: str) -> list[Span]:
    """``(start, kind, end)`` of all kinds; a match that fails its check is dropped and not tried again."""
    found = []
    if "@" in text:
        found += [(a, "email", b) for a, b in emails(text)]
    if "." in text:
        found += [
            (m.start(), "ip", m.end())
            for m in IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
        ]
    if MANY_DIGITS.search(text):
        for m in CARD.finditer(text):
            digits = ascii_digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), "card", m.end()))
    if "+" in text:
        found += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(ascii_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


class Mapped:
    """A text whose characters know the source characters they came from."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, turn: Turn) -> Mapped:
        """Replace matches. As many characters as before keep their places; else each new one stands for the match."""
        parts, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            a, b, new = m.start(), m.end(), turn(m)
            parts += [self.text[at:a], new]
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if len(new) == b - a:
                starts += self.starts[a:b]
                ends += self.ends[a:b]
            else:
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        if at:
            self.text = "".join(parts) + self.text[at:]
            self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]
        return self

    def within(self, pattern: re.Pattern, accept: Callable[[str], bool], *steps: tuple[re.Pattern, Turn]) -> Mapped:
        """Rewrite by ``steps``, but only inside the accepted matches of ``pattern``."""
        areas = [m.span() for m in pattern.finditer(self.text) if accept(m[0])]
        if not areas:
            return self
        out = Mapped("")
        texts, at = [], 0
        for a, b in [*areas, (len(self.text), len(self.text))]:
            for x, y, inner in ((at, a, False), (a, b, True)):
                piece = Mapped("")
                piece.text, piece.starts, piece.ends = self.text[x:y], self.starts[x:y], self.ends[x:y]
                for step, turn in steps if inner else ():
                    piece.rewrite(step, turn)
                texts.append(piece.text)
                out.starts += piece.starts
                out.ends += piece.ends
            at = b
        out.text = "".join(texts)
        return out


@lru_cache(1 << 16)
def plain_form(c: str) -> str | None:
    """What a character stands for in ASCII, by its properties: nothing if it is invisible, its compatibility form, the
    digit it is, or the letter it looks like. None for a character that stands for itself.
    """
    if c.isascii():
        return None
    if unicodedata.category(c) == "Cf":
        return ""
    form = LOOK_ALIKE.get(c) or unicodedata.normalize("NFKC", c)
    if len(form) == 1 and not form.isascii():
        form = LOOK_ALIKE.get(form, form)
        if form.isdigit():
            form = str(unicodedata.digit(form))
    return form if form.isascii() else None


def suspects(text: str) -> list[str]:
    """The text's characters that stand for others."""
    return [] if text.isascii() else sorted(c for c in set(text) if plain_form(c) is not None)


def look_alike(m: re.Match) -> str:
    return plain_form(m[0])


def unescaped(m: re.Match) -> str:
    return "." if re.search("(?i)46|2e|period", m[0]) else "@"


def at_sign(_: re.Match) -> str:
    return "@"


def dot(_: re.Match) -> str:
    return "."


def end_sentence(m: re.Match) -> str:
    return m[1] + " "


def is_address(text: str) -> bool:
    """A sign or a bracketed word shows intent; bare words, signs between spaces and "(a)" need a top-level domain.

    Where that is a common word, the domain must not read like a sentence: "arrive at this point in" is none.
    """
    if re.search(r"[@\[({<]", re.sub(r"\x20[@.]\x20|[\[({<][aA][\])}>]", "", text)):
        return True
    address = WRITTEN_DOT.sub(".", WRITTEN_AT.sub("@", text, count=1))
    labels = SENTENCE.sub(end_sentence, address).split(" ")[0].partition("@")[2].lower().split(".")
    if labels[-1] not in TOP_DOMAINS:
        return False
    return labels[-1] not in WORDY or not (labels[0] in SENTENCE_WORDS or re.search(r"(?i)\sat\s.*\spoint\s", text))


def has_written_dot(text: str) -> bool:
    return bool(WRITTEN_DOT.search(text))


def is_spelled(run: str) -> bool:
    """Seven digits or more, at least one of them spelled."""
    words = len(SPELLED_WORD.findall(run))
    return words > 0 and words + len(ascii_digits(run)) >= 7


def spelled(m: re.Match) -> str:
    parts = [p[0].lower() for p in SPELLED_PART.finditer(m[0])]
    return "".join("+" if p == "plus" else str(DIGIT_WORDS[p]) for p in parts)


def disguised(text: str) -> list[Span]:
    """Spans of the source that read as personal data once normalised, and not before."""
    normal = Mapped(text)
    if strange := suspects(text):
        normal.rewrite(re.compile("[" + re.escape("".join(strange)) + "]"), look_alike)
    normal.rewrite(ESCAPED, unescaped)
    normal = normal.within(DIGIT_RUN, is_spelled, (SPELLED, spelled))
    if DISGUISED_DOT.search(normal.text):
        normal = normal.within(WRITTEN, is_address, (WRITTEN_AT, at_sign), (WRITTEN_DOT, dot), (SENTENCE, end_sentence))
        normal = normal.within(WRITTEN_DIGITS, has_written_dot, (WRITTEN_DOT, dot))
    if normal.text == text:
        return []
    found = []
    for a, kind, b in detect(normal.text):
        start, end = normal.starts[a], normal.ends[b - 1]
        if text[start:end] != normal.text[a:b]:
            found.append((start, kind, end))
    return found


def may_hide(text: str) -> bool:
    return bool(
        suspects(text)
        or DISGUISED_DOT.search(text)
        or ESCAPED.search(text)
        or any(is_spelled(m[0]) for m in DIGIT_RUN.finditer(text))
    )


def pii_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: hidden ones are added that touch no base span, or hold those of their kind they touch."""
    base = detect(text)
    hidden = disguised(text) if may_hide(text) else []
    # starts rise, and so do the furthest ends up to each: the base spans a hidden one can touch lie side by side
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    extra = []
    for start, kind, end in hidden:
        near = base[bisect_right(reach, start) : bisect_left(starts, end)]
        if all(b <= start or (k == kind and start <= a and b <= end) for a, k, b in near):
            extra.append((start, kind, end))
    return base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


FOUND = T.StructType(
    [T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    + [T.StructField("n_hidden", T.LongType())]
)


@F.pandas_udf(FOUND)
def pii_columns(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch:
            base, spans = pii_spans(text or "")
            kinds = [k for _, k, _ in base]
            digest = hashlib.sha256(written(base).encode()).hexdigest()
            rows.append((*map(kinds.count, KINDS), digest, written(spans), len(spans) - len(base)))
        yield pd.DataFrame(rows, columns=FOUND.names)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_hidden``.

    Counts and ``base_sha256`` are of the base spans; ``spans`` has the ``n_hidden`` disguised ones, too, as spans of
    the source. Null counts as an empty text; null ids and repeated rows are rows of their own; an empty table gives
    no rows. Other columns are ignored.
    """
    return docs.select("doc_id", pii_columns("text").alias("_found")).select("doc_id", "_found.*")
