"""Sentence boundaries across languages and scripts by cascading rule tables.

Method: candidate positions (final marks with their closing quotes and
brackets, line breaks, blanks in Thai) are decided by ordered pairs of regular
expressions, one for what stands before the position and one for what follows;
the first pair that matches decides break or no break. The tables cascade: those
of the languages of a script, that of the script, and the table for all; line
breaks and ends of quotations have tables of their own. The script is read off
the nearest letter, because the stored language may be wrong or missing; a text
may also mix languages, so the tables of all languages of a script are asked in
turn. Quotations are paired over the whole text, within a paragraph.

The rules see a shadow of the text in which look-alike and full-width letters
are plain and invisible characters left out; places are mapped back.

Defined results: null, empty and blank texts give no sentence; sentences are
half-open places in code points of the stored text, without white space at
either end, and cover everything but white space.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.look_alikes import BLANKS, CYRILLIC, GREEK, INVISIBLE, LATIN
from loomgraph.plans.runtime import table


def _ranges(keep) -> str:
    """Character class body of the code points below U+2C00 for which ``keep`` holds."""
    out, start, prev = [], None, None
    for o in [o for o in range(0x2C00) if keep(chr(o))] + [None]:
        if start is not None and o != prev + 1:
            out.append(re.escape(chr(start)) + ("-" + re.escape(chr(prev)) if prev > start else ""))
            start = None
        if o is not None and start is None:
            start = o
        prev = o
    return "".join(out)


LOW, UP = _ranges(str.islower), _ranges(str.isupper)
CJK = "々-〇぀-ヿ㐀-䶿一-鿿豈-﫿"
THAI = "฀-๿"
INDIC = "ऀ-ൿ"
SP = r"[^\S\r\n]*"

# Abbreviations after which a name or number follows.
VI_TITLES = "TP|Tp|TX|Tx|TT|Tt|Q|H|P|Đ|TS|Ts|ThS|Ths|PGS|GS|BS|KS|LS|CN|TĐ|Tđ|Cty|CTY|C\\.ty|T\\.Cty|TCT|NSND|NSƯT|Th\\.S|HLV|LHQ"
EN_TITLES = "Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|Gen|Sen|Rep|Gov|Capt|Col|Lt|Sgt|Rev|Hon|Messrs"
EN_BEFORE = "vs|v|e\\.g|i\\.e|approx|cf|viz|ca|c|pp|ed|eds"
EN_NUMBERED = "No|Nos|Fig|Figs|Vol|Art|Sec|Ch|Eq|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec|p|Đ|[Ss]ố"
COMPANY = "Corp|Inc|Ltd|Co|Bros|JSC|LLC"
CLOSERS = "'”’»」』)\\]）】》〉"
FINAL = ".!?…。！？।॥؟．។៕။۔።፧։།"
#: signs that rules ask for, put before or after the text: quotation that opens its sentence, item of a list, line break, blank line
OPENS, ITEM_LINE, LINE, BLANK_LINE = "\x02\x03\x04\x05"
#: characters that the rules for what stands before a mark may take in (blanks at their left and closers at their right not counted)
LEAD = 24

ITEM = rf"(?:[-•*·▪◦‣–—]|\(?\d{{1,3}}[.)]|\(?[{LOW}]\)|\(?[ivx]{{1,4}}\)|\(?[IVX]{{1,4}}[.)]){SP}(?=\S)(?<=[\s.)])"
_STOPPED = rf"[{FINAL}][{CLOSERS}\"]?"
_ABBREVIATED = rf"(?<![\w.])(?:(?:{VI_TITLES}|{EN_TITLES}|{EN_BEFORE}|{EN_NUMBERED}|[{UP}])\.|[{UP}]\.)"

#: each table: (break?, before, after); the first pair that matches decides
TABLES: dict[str, list[tuple[bool, str, str]]] = {
    "numbers": [
        (False, r"\d\.", r"\d"),
        (False, rf"(?:^|\n){SP}\(?\d{{1,3}}\.", rf"{SP}\S"),  # number of a list item
    ],
    "vietnamese": [(False, rf"(?<![\w.])(?:{VI_TITLES})\.", rf"{SP}[{UP}{CJK}\d]")],
    "english": [
        (False, rf"(?<![\w.])(?:{EN_TITLES})\.", rf"{SP}[{UP}{CJK}\d]"),
        (False, rf"(?<![\w.])(?:{EN_BEFORE})\.", r""),
        (False, rf"(?<![\w.])(?:{EN_NUMBERED})\.", rf"{SP}[\d#IVX]"),
        (False, rf"(?<!\w)(?:{COMPANY})\.['”’»)\]）]*", rf"{SP}[^{UP}\s\"“「«\d{CJK}]|[{CJK}]"),
    ],
    "latin": [
        (False, rf"(?<![\w.])[{UP}]\.", rf"{SP}[{UP}]"),  # initial of a name
        (False, r"(?:\.\.+|…)", rf"{SP}[\d]"),
        (True, rf"[{LOW}\d%)\]™²]\.", rf"[{UP}][{LOW}̀-ͯ]"),  # blank left out after the stop
        (True, rf"(?:[{LOW}]\.){{2}}", rf"[{UP}][{LOW}̀-ͯ]"),
        (True, rf"[{LOW}{UP}\d)\]\"”]{{2}}\.", rf"[{UP}][{LOW}̀-ͯ]|[{CJK}{THAI}{INDIC}]"),
        (False, r"\.", r"[\w@/\\-]"),
    ],
    "chinese and japanese": [
        (False, r"…", rf"[^{FINAL}\s]"),  # an ellipsis inside the running sentence
        (False, r"\.", rf"[{CJK}\w]"),
        (True, r"[。！？!?．]", r""),
    ],
    "thai": [
        (False, rf"\d[%\w]*{SP}", r""),
        (False, r"[฿$€£¥]", r""),
        (False, r"", r"[(\[]?[$€£¥฿+-]?\d"),
        (False, r"", r"[ๆฯ%]"),
        (False, r"[,;:(\[–-]", r""),
        (False, r"", r"[,;:)\]–-]"),
        (True, r"", r""),
    ],
    "hindi": [
        (True, r"[।॥]", r""),
        (False, r"\d\.", r"\d"),
        (False, r"(?<![\w.])(?:डॉ|प्रो|श्री|सुश्री)\.", rf"{SP}\S"),
    ],
    "others": [(True, r"[។៕။۔።፧։།]", r"")],  # Khmer, Burmese, Urdu, Ethiopic, Armenian, Tibetan
    "quoted": [  # after a quotation with a stop at its end
        (False, OPENS, r""),
        (False, r"", r"[とはがをにのでもって、，,;:]"),
        (True, r"", r""),
    ],
    "line": [
        (True, BLANK_LINE, r""),
        (True, rf"(?:{_STOPPED}|[:：]){LINE}", ITEM),
        (True, rf"^{ITEM_LINE}(?s:.*)", ITEM),
        (True, r"", rf"(?![–—*·]){ITEM}"),
        (False, r"", ITEM),
        (False, r"", rf"[{LOW},;:)\]）】，；：、%–—]"),
        (False, rf"[,;–—，、(（/&]{LINE}", r""),
        (False, rf"{_ABBREVIATED}{LINE}", r""),
        (True, rf"{_STOPPED}{LINE}", r""),
        (True, rf"^{ITEM_LINE}(?s:.*)", r""),
        (False, r"", r"\d[\d.,]*(?!\w)"),
        (True, r"", r""),
    ],
    "all": [
        (False, r"", rf"{SP}[,;:、，；：·\])）】%]"),
        (False, r"", rf"{SP}[{LOW}]"),
        (False, r"", rf"{SP}[-–—/|=+*&~]"),
        (True, r"[!?؟]", r""),
        (True, r"", rf"{SP}$"),
        (True, r"", r"\s"),
        (True, r"(?:\.\.|…|。|！|？|।)", r""),
        (False, r"", r""),
    ],
}
#: tables asked in turn, by script of the nearest letter, or by kind of position
CASCADES = {
    "latin": ("numbers", "vietnamese", "english", "latin", "others", "all"),
    "cjk": ("chinese and japanese", "others", "all"),
    "indic": ("hindi", "others", "all"),
    "thai mark": ("others", "all"),
    "thai": ("thai",),
    "quoted": ("quoted",),
    "line": ("line",),
}
_COMPILED = {
    name: [(cut, re.compile(f"(?:{b})[{CLOSERS}\"]*\\Z") if b else None, re.compile(a) if a else None) for cut, b, a in rules]
    for name, rules in TABLES.items()
}
_RULES = {name: [rule for t in tables for rule in _COMPILED[t]] for name, tables in CASCADES.items()}

#: full stops before a digit or small letter never end a sentence and are no candidates
_MARK = rf"[.]++(?![{LOW}\d])|[{FINAL[1:]}][{FINAL}]*+"
_CANDIDATE = re.compile(f"{_MARK}|[\\r\\n]\\s*")
_CANDIDATE_THAI = re.compile(f"{_MARK}|[\\r\\n]\\s*|(?<=[{THAI}])[^\\S\\r\\n]+(?=\\S)|(?<=\\S)[^\\S\\r\\n]+(?=[{THAI}])")
_QUOTED = re.compile(
    r'(?<![^\s(\[:：，。、—–-])"(?=\S)(?:[^"\n]|\n(?!\s*\n))*+(?<=\S)"(?!\w)'
    r"|“(?:[^“”\n]|\n(?!\s*\n))*+”|«(?:[^«»\n]|\n(?!\s*\n))*+»|「(?:[^「」\n]|\n(?!\s*\n))*+」|『[^『』]*+』"
)
_ITEM = re.compile(ITEM)
_THAI = re.compile(f"[{THAI}]")
_ODD = re.compile(f"[{BLANKS}{INVISIBLE}{''.join(CYRILLIC)}{''.join(GREEK)}{''.join(LATIN)}０-９Ａ-Ｚａ-ｚ．]")
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_PLAIN = str.maketrans(
    {**CYRILLIC, **GREEK, **LATIN, **{chr(o): " " for o in [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]}}
    | {chr(o): unicodedata.normalize("NFKC", chr(o)) for o in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), 0xFF0E]}
)


def _script(text: str, at: int, known: tuple[int, str] = (0, "latin")) -> str:
    """Script of the nearest letter before the position; ``known`` is a place further left whose script is known."""
    for i in range(at - 1, known[0] - 1, -1):
        o = ord(text[i])
        if 0x0E00 <= o < 0x0E80:
            return "thai"
        if 0x0900 <= o < 0x0D80:
            return "indic"
        if 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000:
            return "cjk"
        if text[i].isalpha():
            return "latin"
    return known[1]


def _decide(name: str, text: str, lead: str, at: int) -> bool:
    for cut, before, after in _RULES[name]:
        if (after is None or after.match(text, at)) and (before is None or before.search(lead)):
            return cut
    return False


def _lead(text: str, start: int, mark: int, at: int) -> str:
    """What stands before ``at``, as far as rules look; LEAD characters before ``mark``, and all blanks if it begins with some."""
    a = max(start, mark - LEAD)
    while a > start and text[a].isspace() and text[a - 1].isspace():
        a -= 1
    return ("\n" if a == start and (start == 0 or text[start - 1] == "\n") else "") + text[a:at]


def _cut_plain(text: str) -> list[tuple[int, int]]:
    n = len(text)
    thai = _THAI.search(text) is not None
    spans = [(m.start(), m.end() - 1) for m in _QUOTED.finditer(text)]
    opens, closes = [s for s, _ in spans], {e: s for s, e in spans}
    out: list[tuple[int, int]] = []
    start = 0
    while start < n and text[start].isspace():
        start += 1
    item_line = bool(_ITEM.match(text, start)) if start < n else False
    skip = 0
    known = (0, "latin")
    for m in (_CANDIDATE_THAI if thai else _CANDIDATE).finditer(text):
        a, b = m.span()
        if a < skip or a < start:
            continue
        known = (a, _script(text, a, known))
        quote = bisect_right(opens, a) - 1
        inside = quote >= 0 and spans[quote][0] < a < spans[quote][1]
        first = text[a]
        if first in FINAL:
            at = b
            while at < n and (text[at] in "'”’»」』)]）】》〉" or at in closes):
                at += 1
            if inside and at <= spans[quote][1]:
                continue  # a stop within a quotation
            skip = at
            k = at
            while k < n and text[k].isspace() and text[k] not in "\r\n":
                k += 1
            if k >= n or text[k] in "\r\n":
                continue  # the line break, or the end, decides
            shut = next((i for i in range(b, at) if i in closes), None)
            if shut is not None:
                cut = not text[k].islower() and _decide("quoted", text, OPENS if closes[shut] == start else "", k)
            elif known[1] in ("latin", "thai") and text[k].islower():
                continue  # none of their tables breaks before a small letter
            else:
                cut = _decide("thai mark" if known[1] == "thai" else known[1], text, _lead(text, start, b, at), at)
            end, nxt = at, k
        elif first in "\r\n":
            if b >= n:
                break
            while a > start and text[a - 1].isspace():
                a -= 1
            if a == start:
                continue
            if inside and m[0].count("\n") < 2:
                continue
            gap = text[a:b]
            blank = gap.count("\n") > 1 or (gap.count("\r") > 1 and "\n" not in gap)
            cut = _decide("line", text, (ITEM_LINE if item_line else "") + text[max(start, a - LEAD) : a] + (BLANK_LINE if blank else LINE), b)
            if not cut and thai and (_THAI.match(text[a - 1]) or _THAI.match(text[b])) and not text[b].islower():
                cut = _decide("thai", text, text[max(start, a - LEAD) : a], b)
            if not cut and _ITEM.match(text, b) is None and nxt_script_differs(text, a, b):
                cut = True
            end, nxt = a, b
        else:
            if inside or text[a - 1] in FINAL:
                continue
            cut = _decide("thai", text, text[max(start, a - LEAD) : a], b)
            end, nxt = a, b
        if cut and end > start:
            out.append((start, end))
            start = nxt
            item_line = bool(_ITEM.match(text, start)) and text[start - 1] in "\r\n \t" and "\n" in text[end:start]
    end = n
    while end > start and text[end - 1].isspace():
        end -= 1
    if end > start:
        out.append((start, end))
    return out


def nxt_script_differs(text: str, a: int, b: int) -> bool:
    """A line break between letters of different scripts, as between a title and its text."""
    return text[b].isalpha() and not text[b].islower() and _script(text, a) != _script(text, b + 1)


def cut_sentences(text: str | None) -> list[tuple[int, int]]:
    """Half-open places of the sentences of ``text``."""
    if not text or text.isspace():
        return []
    if not _ODD.search(text):
        return _cut_plain(text)
    gone = {m.start() for m in _INVISIBLE.finditer(text)}
    if not gone:
        return _cut_plain(text.translate(_PLAIN))
    keep = [i for i in range(len(text)) if i not in gone]
    plain = _INVISIBLE.sub("", text).translate(_PLAIN)
    out = [(keep[a], keep[b - 1] + 1) for a, b in _cut_plain(plain)]
    return _cover(text, out)


def _cover(text: str, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Invisible characters between sentences go to the one they touch."""
    if not cuts:
        body = text.strip()
        return [(text.index(body), text.index(body) + len(body))] if body else []
    lead = text[: cuts[0][0]]
    out, start = [], len(lead) - len(lead.lstrip())
    for i, (_, end) in enumerate(cuts):
        last = i + 1 == len(cuts)
        gap = text[end : len(text) if last else cuts[i + 1][0]]
        tail = 0  # what stands right before the next sentence
        if not last and gap.strip() and any(map(str.isspace, gap)):
            while not gap[len(gap) - 1 - tail].isspace():
                tail += 1
        out.append((start, end + len(gap[: len(gap) - tail].rstrip())))
        start = end + len(gap) - tail
    return out


_PLACES = T.ArrayType(T.StructType([T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())]))


@F.pandas_udf(_PLACES)
def sentence_places(texts: pd.Series) -> pd.Series:
    return texts.map(cut_sentences)


def segment(records: DataFrame, key: str, column: str = "text") -> DataFrame:
    """One row a sentence: ``key, start_pos, end_pos``; rows with nothing but white space never reach Python."""
    wanted = records.where(F.col(column).rlike(r"(?U)\S")).select(key, column)
    places = wanted.select(key, F.explode(sentence_places(column)).alias("p"))
    return places.select(key, "p.start_pos", "p.end_pos")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(table(spark, sf_dir, "sentence_records"), "rec_id")


QUERIES = {"p4_found": p4_found}
