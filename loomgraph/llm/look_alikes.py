"""One consistent form for text that looks the same but is stored in different characters.

Method: the quick-check properties of canonical composition (which characters
never occur in composed text, which may compose with the one before, which have
a combining class and so an order) are worked out from the character data, with
the look-alikes below. A class of characters that are stable by all of them is
tested in the JVM; only texts with any other go to Python. There, unstable
segments (runs between plain blanks, which are stable boundaries) are isolated,
those and no others are normalized with the context they need, and spliced back
into the unchanged rest.

What is normalized: full-width letters, digits and (outside Chinese and
Japanese text) marks; canonical composition of accents; invisible characters
(dropped, except joiners and selectors inside emoji); blanks other than the
plain one; letters of another script, or odd Latin letters, inside a word.
Tabs, line breaks, typographic quotes, dashes, ellipses, symbols, units and
words wholly in another script stay.

Defined results: null stays null, empty and blank texts stay as they are unless
a blank in them is an unusual one; applying the operator twice changes nothing more.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.plans.runtime import table

# Letters and the plain letter each looks like, from the public confusables data of Unicode (as far as one letter stands for one).
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсухһԁԛԝӏҮѴѵЬгѡҽԌꙇү", "ABESIJKMHOPCTXYaesijopcyxhdqwlYVvbrweGiy", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυϲϳϹͿγσϒϜϱϺᴦ", "ABEZHIKMNOPTYXaivopucjCJyoYFpMr", strict=True))
LATIN = dict(zip("ɡɑıÐƉðɩʏᴏꜱſƄƍƖƦƽɣɪɯʋᴄᴑᴜᴠᴡᴢᶃᶌẝỿꞘꞙꞟꞲꞳꞴꬲꬵꬽꭇꭈꭎꭒꭚⅰⅴⅹⅼⅽⅾⅿⅠⅤⅩⅬⅭⅮⅯ", "gaiĐĐđiyossbglRsyiwucouvwzgyfyFfuJXBeforruuyivxlcdmIVXLCDM", strict=True))
ARMENIAN = dict(zip("ՍՏՕագզհոռսցքօ", "USOwqqhnnugfo", strict=True))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiYAJEWMHYGhZbRWSVSLCPKdGB", strict=True))
COPTIC = dict(zip("ⲅⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬⳐ", "rHIKMNOoPpCcTYXL", strict=True))
LISU = dict(zip("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU", strict=True))
OTHERS = ARMENIAN | CHEROKEE | COPTIC | LISU
BLANKS = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
INVISIBLE = (
    "\u0001-\u0008\u000e-\u001f\u007f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f"
    "\u202a-\u202e\u2060-\u2064\u2066-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb"
)
#: signs and units whose canonical form is a letter: kept
KEPT_SIGNS = "ΩKÅ"

_WIDE = "！-\uffefﬀ-ﬆ\U0001d400-\U0001d7ff"
_TAGS = "\U000e0000-\U000e007f\U000e0100-\U000e01ef"
_POSING = "".join(CYRILLIC) + "".join(GREEK) + "".join(LATIN) + "".join(OTHERS)


def _spelled(points: list[int]) -> str:
    """Body of a character class of sorted code points."""
    out, k = [], 0
    while k < len(points):
        end = k
        while end + 1 < len(points) and points[end + 1] == points[end] + 1:
            end += 1
        out.append(re.escape(chr(points[k])) + ("-" + re.escape(chr(points[end])) if end > k else ""))
        k = end + 1
    return "".join(out)


def quick_check() -> tuple[list[int], list[int], list[int]]:
    """Code points by the quick-check properties of composition: never in composed text, maybe (compose with what stands before), with a combining class."""
    never, maybe, marks = [], {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}, []
    for o in (*range(0xD800), *range(0xF900, 0x1F000), *range(0x2F800, 0x2FA20)):  # the rest is unassigned, for private use, or ideographs
        ch = chr(o)
        if unicodedata.combining(ch):
            marks.append(o)
        if not unicodedata.is_normalized("NFC", ch):
            never.append(o)
            continue
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and parts[0][0] != "<":
            maybe.add(int(parts[1], 16))
    return never, sorted(maybe), marks


_NEVER, _MAYBE, _MARKED = quick_check()
_UNSTABLE = _WIDE + _TAGS + BLANKS + INVISIBLE + _POSING + _spelled(sorted({*_NEVER, *_MAYBE}))
_MARKS = _spelled(_MARKED)
#: unstable: a character of the classes above, or two marks in a row, which may stand in the wrong order
_OPEN = f"[{_UNSTABLE}]|[{_MARKS}]{{2}}"


def _stable_class() -> str:
    """Characters of the common blocks that are stable by every property, for the test in the JVM."""
    unstable = re.compile(f"[{_UNSTABLE}{_MARKS}]")
    blocks = ((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA1, 0x17F), (0x1A0, 0x1B0), (0x1EA0, 0x1EF9), (0x2010, 0x2027), (0x2030, 0x2057), (0x20A0, 0x20BF), (0x3001, 0x3002), (0x3008, 0x3011), (0x3041, 0x3094), (0x30A1, 0x30FC), (0x4E00, 0x9FFF))
    return _spelled([o for a, b in blocks for o in range(a, b + 1) if not unstable.match(chr(o))])


#: the quick check in the JVM: a text of none but stable characters is in its final form. As one possessive run it took a sixth of the time of a search for the first other character.
STABLE = rf"^[{_stable_class()}]*+\z"

_segment = re.compile(f"[^ \\t\\r\\n]*(?:{_OPEN})[^ \\t\\r\\n]*")
_unstable = re.compile(_OPEN)
_blank = re.compile(f"[{BLANKS}]")
_invisible = re.compile(f"[{INVISIBLE}\U000e0000-\U000e007f\U000e0100-\U000e01ef]")
_word = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")
_posing = re.compile(f"[{_POSING}]")
_wide_letter = re.compile("[\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff66-\uff9f\ufb00-\ufb06\U0001d400-\U0001d7ff]")
_wide_mark = re.compile("[\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65\uffe0-\uffee]")
_cjk = re.compile("[\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f]")
_EMOJI = ((0x1F000, 0x1FAFF), (0x2190, 0x2BFF), (0x1F1E6, 0x1F1FF), (0x3030, 0x303D), (0xA9, 0xA9), (0xAE, 0xAE), (0x203C, 0x2049), (0x2122, 0x2139))


def _emoji(ch: str) -> bool:
    o = ord(ch)
    return any(a <= o <= b for a, b in _EMOJI)


def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or 0x250 <= o < 0x2B0 or 0x2C60 <= o < 0x2C80 or 0xA720 <= o < 0xA800 or 0x1D00 <= o < 0x1D80:
        return "latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    return "other"


_BACK = {"cyrillic": {v: k for k, v in reversed(CYRILLIC.items())}, "greek": {v: k for k, v in reversed(GREEK.items())}}  # the common letters come first


def _plain_word(match: re.Match) -> str:
    """Letters posing inside a word get the script of the letters that cannot be mistaken."""
    word = match[0]
    if not _posing.search(word):
        return word
    scripts = {"latin": 0, "greek": 0, "cyrillic": 0, "other": 0}
    sure = dict(scripts)
    for ch in word:
        if "\u0300" <= ch <= "\u036f":
            continue
        s = _script(ch)
        scripts[s] += 1
        if not (ch in CYRILLIC or ch in GREEK or ch in OTHERS):
            sure[s] += 1
    if scripts["latin"] or (scripts["greek"] and scripts["cyrillic"]):
        for own in ("cyrillic", "greek"):
            if sure[own] > sure["latin"]:  # a word of that script with Latin letters in it
                other = CYRILLIC if own == "greek" else GREEK
                return "".join(_BACK[own].get(other.get(ch, ch), ch) for ch in word)
        if sure["other"] > sure["latin"]:
            return word
        return "".join(CYRILLIC.get(ch) or GREEK.get(ch) or OTHERS.get(ch) or LATIN.get(ch, ch) for ch in word)
    return word


def _in_emoji(text: str, i: int) -> bool:
    """Joiner, selector or tag that belongs to an emoji."""
    before = i - 1
    while before >= 0 and (text[before] in "\u200d\ufe0f\ufe0e" or 0xE0020 <= ord(text[before]) <= 0xE007F):
        before -= 1
    if before < 0 or not (_emoji(text[before]) or (text[before] in "#*0123456789" and text[i] == "\ufe0f")):
        return False
    if text[i] == "\u200d":
        return i + 1 < len(text) and _emoji(text[i + 1])
    return text[i] in "\ufe0f\ufe0e" or 0xE0020 <= ord(text[i]) <= 0xE007F


def _chinese_or_japanese(text: str, i: int) -> bool:
    """Whether the mark at ``i`` stands in Chinese or Japanese text: by the nearest letters, else by its line."""
    for step in (-1, 1):
        k = i + step
        while 0 <= k < len(text) and text[k] not in "\r\n":
            if text[k].isalpha():
                if _cjk.match(text[k]):
                    return True
                break
            k += step
    a = max(text.rfind("\n", 0, i), text.rfind("\r", 0, i)) + 1
    b = min((x for x in (text.find("\n", i), text.find("\r", i)) if x >= 0), default=len(text))
    line = text[a:b]
    return 2 * len(_cjk.findall(line)) > sum(map(str.isalpha, line))


def _drop_invisible(segment: str) -> str:
    if not _invisible.search(segment):
        return segment
    return "".join(ch for i, ch in enumerate(segment) if not _invisible.match(ch) or _in_emoji(segment, i))


def _normal_segment(text: str, start: int, end: int) -> str:
    seg = text[start:end]
    if _wide_mark.search(seg):
        seg = "".join(
            unicodedata.normalize("NFKC", ch) if _wide_mark.match(ch) and not _chinese_or_japanese(text, start + i) else ch
            for i, ch in enumerate(seg)
        )
    seg = _blank.sub(" ", seg)
    seg = _drop_invisible(seg)
    seg = _wide_letter.sub(lambda m: unicodedata.normalize("NFKC", m[0]), seg)
    seg = _word.sub(_plain_word, seg)  # before composing: an accent may stand on a posing letter
    if not unicodedata.is_normalized("NFC", seg):
        seg = "".join(p if p in KEPT_SIGNS else unicodedata.normalize("NFC", p) for p in re.split(f"([{KEPT_SIGNS}])", seg))
    return seg


def normalize_text(text: str | None) -> str | None:
    """The consistent form of one text."""
    if text is None:
        return None
    if not _unstable.search(text):
        return text
    out, last = [], 0
    for m in _segment.finditer(text):
        out += (text[last : m.start()], _normal_segment(text, m.start(), m.end()))
        last = m.end()
    return "".join(out) + text[last:] if out else text


@F.pandas_udf(T.StringType())
def _normalize(texts: pd.Series) -> pd.Series:
    return texts.map(normalize_text, na_action="ignore")


def is_unstable(text: Column) -> Column:
    return ~text.rlike(STABLE)


def consistent(df: DataFrame, column: str, out: str = "normal") -> DataFrame:
    """``df`` with the consistent form of ``column`` as ``out``; stable texts never leave the JVM."""
    unstable = F.when(is_unstable(F.col(column)), F.col(column))
    return df.withColumn(out, F.coalesce(_normalize(unstable), F.col(column)))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = table(spark, sf_dir, "sentence_records").select(F.lit("sentence").alias("src"), F.col("rec_id").alias("id"), "text")
    spans = table(spark, sf_dir, "entity_spans").select(F.lit("span").alias("src"), F.col("span_id").alias("id"), "text")
    return sentences.unionByName(spans)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    unstable = _sources(spark, sf_dir).where(is_unstable(F.col("text")))
    return unstable.where(_normalize("text") != F.col("text")).select("src", "id")


def p3_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of sentence_records and entity_spans in its consistent form."""
    return consistent(_sources(spark, sf_dir), "text").select("src", "id", "normal", (F.col("normal") != F.col("text")).alias("changed"))


QUERIES = {"p3_found": p3_found, "p3_normalized": p3_normalized}
