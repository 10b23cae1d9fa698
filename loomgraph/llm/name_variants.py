"""Variant spellings of persons and organisations, linked by a set-similarity join.

Method: names are parsed (legal forms, titles and branch words apart; see the
fixed values below) and equal parses fall together. The distinct tokens, far
fewer than the names, are joined with one another on their padded q-grams: the
grams of a token are put in order of rarity and only a prefix of them is looked
up, as long as the most edits can destroy, and one more; what meets is checked
by edit distance. A token is then found under itself and under every similar
token that is more frequent, so a spelling and its typos share a key while a
frequent token has few keys.

Names are joined on these keys by a second prefix filter, over tokens: rare
tokens weigh more, and two names can reach ``ENOUGH`` only if so many of the
heaviest tokens agree that at least one to four of a prefix of them must be met
at once. Keys are therefore of one to four tokens, the most that the weights
allow, and a family name that a third of all names bear is no key by itself.
Where the other name has initials, as many of the tokens may be met by their
first letters. What meets is verified by a weighted soft token similarity with
the tokens aligned; tokens of only one name count against it with their weight.
A pair must also agree in class, legal form and branch. Verified links are
closed to components, since two damaged spellings may be linked only through the
sound one; the components are found by label propagation over tables kept in the
shared checkpoint folder.

Defined results: null or blank names, names of products, events and places, and
names of initials only give no pair; a name of unknown type joins persons or
organisations only through what it is written like; equal names under different
ids are pairs; names of one token need more likeness than others; a person is
never linked to an organisation, nor a branch to its parent. Tokens that share
no q-gram are not similar, whatever their edit distance.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.look_alikes import normalize_text
from loomgraph.plans.runtime import materialize, table

ENOUGH = 0.8
LONG = 8
#: tokens up to this length are joined on 2-grams, those from it on on 3-grams
SHORT = 5
#: letters a name of one token needs for an edit
ALONE = 6
#: most tokens met at once in names of up to FEW_WORDS words, and in longer ones, which have more combinations
TOGETHER, TOGETHER_LONG, FEW_WORDS = 4, 2, 5
#: rows of one key that one task joins, before the key is split
KEY_ROWS = 4096
#: distinct tokens up to which their keys are broadcast (about 100 bytes each)
BROADCAST_TOKENS = 200_000

# Legal forms (without accents), by kind.
FORMS = (
    ("tnhh", "cong ty trach nhiem huu han|cong ty tnhh|cty tnhh|c ty tnhh|tnhh|co ltd|limited|ltd|llc"),
    ("cp", "cong ty co phan|cty co phan|cong ty cp|cty cp|c ty cp|ctcp|joint stock company|jsc"),
    ("tong", "tong cong ty|tong cty|tong c ty|t cty|tct|general corporation|general corp"),
    ("nh", "ngan hang thuong mai co phan|ngan hang tmcp|nh tmcp|nhtmcp|ngan hang|commercial bank|bank|nh"),
    ("td", "cong ty tap doan|cty tap doan|tap doan|holdings group|holding group|holdings|group|grp|td"),
    ("", "corporation|corp|incorporated|inc|company|cong ty|cty|co"),
)
# Titles before a person's name (without accents).
TITLE_PHRASES = "tien si|thac si|pho giao su|giao su|luat su|ky su|bac si|doanh nhan|pgs|ths|gs|ts|ks|bs|ls|mr|mrs|ms|miss|dr|prof|ong|ba"
# Words that make a branch or a subsidiary another organisation.
BRANCHES = (
    "chi nhanh [a-z0-9]+|mien (?:bac|nam|trung|tay|dong)|(?:khu vuc|van phong) [a-z0-9]+|bat dong san|nang luong|logistics|retail|"
    "ban le|chung khoan|bao hiem|tai chinh|securities|insurance|finance|energy|real estate|land|digital|viet nam|vietnam|quoc te|international"
)
# Words for what a firm does, which often come and go; they weigh a quarter.
DESCRIPTORS = frozenset("trading services service solutions systems international enterprise industries industry thuong mai dich vu san xuat dau tu phat trien xuat nhap khau and va".split())
# Given names and their short forms.
SHORT_FORMS = {
    "alexander": "alex sandy xander", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny", "catherine": "cathy cate",
    "charles": "charlie chuck", "christopher": "chris topher", "christine": "chrissy tina", "daniel": "dan danny", "david": "dave davy",
    "deborah": "deb debbie debby", "donald": "don donny", "edward": "ed eddie ned", "elizabeth": "liz beth betty lizzie eliza",
    "eugene": "gene", "francis": "frank", "frederick": "fred freddie", "gerald": "gerry jerry", "gregory": "greg", "henry": "hank harry",
    "jacqueline": "jackie", "james": "jim jimmy jamie", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon jonny",
    "joseph": "joe joey", "joshua": "josh", "katherine": "kate kathy katie kat", "kenneth": "ken kenny", "lawrence": "larry",
    "leonard": "leo len lenny", "margaret": "maggie meg peggy marge", "matthew": "matt", "michael": "mike mick mickey",
    "nathaniel": "nate nathan", "nicholas": "nick nicky", "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "paddy",
    "peter": "pete", "philip": "phil", "raymond": "ray", "rebecca": "becky becca", "richard": "dick rick rich richie ricky",
    "robert": "bob rob bobby robbie", "ronald": "ron ronny", "samantha": "sam sammy", "samuel": "sam sammy", "stephanie": "steph",
    "stephen": "steve", "steven": "steve", "susan": "sue susie", "theodore": "ted teddy theo", "thomas": "tom tommy",
    "timothy": "tim timmy", "victoria": "vicky vicki tori", "vincent": "vince vinny", "walter": "walt", "william": "bill will billy willy liam",
    "zachary": "zach zack",
}
#: initial sounds that are commonly confused in writing
CONFUSED = (("tr", "ch"), ("l", "n"), ("s", "x"), ("d", "gi"), ("d", "r"), ("gi", "r"), ("v", "d"), ("th", "t"), ("kh", "k"), ("ph", "p"))

_formal = {short: {full for full, s in SHORT_FORMS.items() if short in s.split()} for shorts in SHORT_FORMS.values() for short in shorts.split()}
_forms = [(kind, re.compile(rf"(?<![a-z0-9])(?:{p})(?![a-z0-9])")) for kind, p in FORMS]
_branches = re.compile(rf"(?<![a-z0-9])(?:{BRANCHES})(?![a-z0-9])")
_titles = re.compile(rf"^(?:(?:{TITLE_PHRASES})\s+)+(?=\S+\s+\S)")


def plain(text: str) -> str:
    """Lower case without accents."""
    out = unicodedata.normalize("NFD", text.lower().replace("đ", "d"))
    return "".join(ch for ch in out if not unicodedata.combining(ch))


def parse(name: str, etype: str | None) -> tuple[str, str, str, list[str], list[str]] | None:
    """``class, form, branch, core tokens, core tokens without accents``, or None for what is neither person nor organisation."""
    kind = (etype or "UNKNOWN").strip().upper()
    if kind not in ("PERSON", "ORGANIZATION", "UNKNOWN", ""):
        return None
    text = unicodedata.normalize("NFC", normalize_text(name)).strip()
    text = re.sub(r"\([^()]*\)\s*$", " ", text)
    text = "".join(
        " " + ch if i and ch.isupper() and text[i - 1].islower() and i + 1 < len(text) and text[i + 1].islower() else ch
        for i, ch in enumerate(text)
    )
    head, comma, tail = text.partition(",")
    tokens = re.findall(r"[^\W_]+", text.lower())
    bare = [plain(t) for t in tokens]
    line = " ".join(bare)
    forms, left = set(), line
    for form, pattern in _forms:
        found = pattern.search(left)
        if found:
            forms.add(form)
            left = pattern.sub(lambda m: " ".join("\x00" for _ in m[0].split()), left)
    branch = []
    if kind != "PERSON":
        branch = sorted(m[0] for m in _branches.finditer(left))
        left = _branches.sub(lambda m: " ".join("\x00" for _ in m[0].split()), left)
    titled = False
    if kind == "PERSON" or not forms:
        m = _titles.match(left)
        if m:
            titled = True
            left = " ".join("\x00" for _ in m[0].split()) + " " + left[m.end() :]
    marks = left.split()
    if len(marks) != len(tokens):
        return None
    keep = [i for i, t in enumerate(marks) if t != "\x00"]
    core, flat = [tokens[i] for i in keep], [bare[i] for i in keep]
    if all(len(t) == 1 for t in core):
        return None
    cls = {"PERSON": "P", "ORGANIZATION": "O"}.get(kind, "O" if forms or branch else "P" if titled else "U")
    if cls != "O":
        if any(ch.isdigit() for t in flat for ch in t):
            return None
        core, flat = _person_order(core, flat, comma and len(re.findall(r"[^\W_]+", head.lower())), titled and len(tokens) - len(core))
    return cls, " ".join(sorted(f for f in forms if f)), " ".join(branch), core, flat


def _person_order(core: list[str], flat: list[str], before_comma: int, titles: int) -> tuple[list[str], list[str]]:
    """Given names first: "rest, first" and "Surname Given" are turned round."""
    at = (before_comma or 0) - (titles or 0)
    if before_comma and 0 < at < len(core):
        core, flat = core[at:] + core[:at], flat[at:] + flat[:at]
    elif len(flat[0]) >= LONG and any(t in SHORT_FORMS or t in _formal or len(t) == 1 for t in flat[1:]) and flat[0] not in SHORT_FORMS:
        core, flat = core[1:] + core[:1], flat[1:] + flat[:1]
    return core, flat


def prefix(w: list[float], met: int) -> int | None:
    """How many of the heaviest of ``w`` (falling) there must be so that ``met`` of them are matched in any similar name, None if there are too few."""
    total, left = sum(w), 0.0
    for m in range(met - 1, len(w)):
        left += w[m]
        if left > (1 - ENOUGH) * total * (1 + 1e-9):
            return m + 1
    return None


def _mix(tag: int, parts: tuple[int, ...]) -> int:
    h = tag
    for x in sorted(parts):
        h = (h * 0x9E3779B97F4A7C15 + (x & _ALL) + 1) & _ALL
        h ^= h >> 29
    return h - (1 << 64) if h >> 63 else h


_ALL = (1 << 64) - 1


def kind_of(flat: list[str]) -> int:
    """Initials of a name (3 for more), and 4 more for a name of many words."""
    words = sum(len(t) > 1 for t in flat)
    return min(3, len(flat) - words) + (4 if words > FEW_WORDS else 0)


def _letters(token: str) -> list[int]:
    """Elements by which a token is met by an initial."""
    return sorted({ord(f[0]) for f in (token, *_formal.get(token, ()))})


def _combined(base: int, tokens: list[tuple[list[int], list[int]]], size: int, initials: int) -> Iterator[int]:
    """Keys of ``size`` of the ``tokens`` (elements, letters): up to ``initials`` of them met by a letter, one at least by an element."""
    for some in itertools.combinations(tokens, size):
        for n in range(min(initials, size - 1) + 1):
            for short in itertools.combinations(range(size), n):
                choice = [t[1] if i in short else t[0] for i, t in enumerate(some)]
                for parts in itertools.product(*choice):
                    yield _mix(base | size, parts)


def name_keys(cls: str, branch: str, flat: list[str], w: list[float], elements: list[list[int]], kinds: list[int]) -> tuple[set[int], set[int]]:
    """Keys under which a name is found, and keys by which it looks for names of each of ``kinds`` with as many initials or more."""
    found: set[int] = set()
    looks: set[int] = set()
    own = kind_of(flat)
    words = sorted((i for i in range(len(flat)) if len(flat[i]) > 1), key=lambda i: (-w[i], i))
    heavy = [w[i] for i in words]
    rest = sum(w) - sum(heavy)
    tokens = [(elements[i], _letters(flat[i])) for i in words]
    letters = [[ord(t)] for t in flat if len(t) == 1]
    cap = lambda kind: TOGETHER_LONG if kind & 4 else TOGETHER
    for mode in {"P": (1,), "O": (2,), "U": (1, 2)}[cls]:
        base = zlib.crc32(branch.encode()) << 8 | mode << 6  # below it the kind of the one that is found, and the number of tokens
        for size in range(1, cap(own) + 1):
            for n in range(min(len(letters), size - 1) + 1 if own & 3 < 3 else 1):
                for short in itertools.combinations(letters, n):
                    for some in itertools.combinations(tokens, size - n):
                        found.update(_mix(base | own << 3 | size, parts) for parts in itertools.product(*short, *(t[0] for t in some)))
        for kind in kinds:
            more = kind & 3
            if more < own & 3:
                continue
            among, size, initials = tokens, 1, 0
            for together in range(cap(kind), more, -1) if more < 3 else ():
                most = prefix([*heavy, rest], together)
                if most is not None and most <= len(tokens):
                    among, size, initials = tokens[:most], together, more
                    break
            looks.update(_combined(base | kind << 3, among, size, initials))
    return found, looks


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for node_id, name, etype in zip(pdf["node_id"], pdf["node"], pdf["entity_type"], strict=True):
            got = parse(name, etype) if name and name.strip() else None
            if got:
                cls, form, branch, core, flat = got
                rows.append((node_id, cls, form, branch, core, flat))
        yield pd.DataFrame(rows, columns=["node_id", "cls", "form", "branch", "core", "flat"])


_SCHEMA = "node_id bigint, cls string, form string, branch string, core array<string>, flat array<string>"


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, cut off above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before2, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before2[j - 2] + 1)
        if min(row) > most:
            return most + 1
    return row[-1]


def _confused(a: str, b: str) -> bool:
    for x, y in CONFUSED:
        for p, q in ((x, y), (y, x)):
            if a.startswith(p) and b.startswith(q) and a[len(p) :] == b[len(q) :]:
                return True
    return False


def token_similarity(a: str, b: str, fa: str, fb: str) -> float:
    """Soft similarity of two tokens, given with and without accents."""
    if a == b:
        return 1.0
    if fa == fb:
        return 0.95
    if len(fa) == 1 or len(fb) == 1:
        short, full = sorted((fa, fb), key=len)
        return 0.9 if any(f[0] == short for f in (full, *_formal.get(full, ()))) else 0.0
    if (_formal.get(fa, {fa}) | {fa}) & (_formal.get(fb, {fb}) | {fb}):
        return 0.95
    if min(len(fa), len(fb)) >= LONG:
        return 0.9 if edits(fa, fb, 2) <= 2 else 0.0
    if min(len(fa), len(fb)) < 2:
        return 0.0
    accented = a != fa and b != fb
    if edits(a, b, 1) <= 1 if accented else edits(fa, fb, 1) <= 1:
        return 0.85
    if _confused(fa, fb) or (accented and edits(fa, fb, 1) <= 1 and edits(a, b, 2) <= 2):
        return 0.8
    return 0.0


def similar_tokens(a: str, b: str) -> bool:
    """Whether two tokens without accents, none an initial, may have a similarity above 0 (short forms of names apart)."""
    most = 2 if min(len(a), len(b)) >= LONG else 1
    return edits(a, b, most) <= most or _confused(a, b)


def _ratio(pairs: list[tuple[float, float, float]], alone: float, words: bool) -> float:
    got = sum(min(u, v) * s for s, u, v in pairs)
    whole = sum(min(u, v) for _, u, v in pairs) + alone
    return got / whole if whole and words else 0.0


def _aligned(x: tuple, y: tuple) -> float:
    """Similarity with the tokens of both names in their order: place by place if they have as many, else by the best alignment."""
    (ca, fa, wa), (cb, fb, wb) = x, y
    n, m = len(fa), len(fb)
    sim = lambda i, j: token_similarity(ca[i], cb[j], fa[i], fb[j])
    if n == m:
        places = [(i, i, sim(i, i)) for i in range(n)]
    else:
        best = [[0.0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + min(wa[i], wb[j]) * sim(i, j))
        places, i, j = [], 0, 0
        while i < n and j < m:
            if best[i][j] == best[i + 1][j]:
                i += 1
            elif best[i][j] == best[i][j + 1]:
                j += 1
            else:
                places.append((i, j, sim(i, j)))
                i, j = i + 1, j + 1
    pairs = [(s, wa[i], wb[j]) for i, j, s in places if s]
    words = any(s and min(len(fa[i]), len(fb[j])) > 1 for i, j, s in places)  # initials alone are no evidence
    if n == m:
        alone = sum(max(wa[i], wb[j]) for i, j, s in places if not s)
    else:
        alone = sum(wa) + sum(wb) - sum(u + v for _, u, v in pairs)
    return _ratio(pairs, alone, words)


def name_similarity(ca: list[str], fa: list[str], wa: list[float], cb: list[str], fb: list[str], wb: list[float], person: bool) -> float:
    """Weighted soft token similarity under the best of the orders in which a name may stand."""
    x, y = (list(ca), list(fa), list(wa)), (list(cb), list(fb), list(wb))
    if len(fa) == len(fb) == 1:
        return _alone(ca[0], cb[0], fa[0], fb[0])
    if min(len(fa), len(fb)) == 1 and person:
        return 0.0
    if len(x[1]) != len(y[1]) and person:
        drop = lambda t: tuple([v for v, f in zip(part, t[1], strict=True) if len(f) > 1] for part in t)
        longer, shorter = (x, y) if len(x[1]) > len(y[1]) else (y, x)
        middle = [i for i in range(1, len(longer[1]) - 1) if len(longer[1][i]) == 1]
        if len(longer[1]) - len(shorter[1]) == 1 and middle:
            cut = middle[0]
            longer = tuple(part[:cut] + part[cut + 1 :] for part in longer)
        else:
            longer, shorter = drop(longer), drop(shorter)
        if min(len(longer[1]), len(shorter[1])) < 2:
            return 0.0
        x, y = longer, shorter
    best = _aligned(x, y)
    n = len(x[1])
    if person and n == len(y[1]) and n > 1 and best < ENOUGH:
        order = [n - 1, *range(1, n - 1), 0]
        best = max(best, _aligned(x, tuple([part[i] for i in order] for part in y)))
    return best


def _alone(a: str, b: str, fa: str, fb: str) -> float:
    """Similarity of two names of one token: the same but for accents, or an edit apart (two for long ones)."""
    if fa == fb:
        return 1.0 if a == b or a == fa or b == fb or len(fa) >= ALONE else 0.0
    short = min(len(fa), len(fb))
    return 0.9 if short >= ALONE and edits(fa, fb, 2 if short >= LONG + 2 else 1) <= (2 if short >= LONG + 2 else 1) else 0.0


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        score = [
            name_similarity(*(list(v) for v in row[:6]), person=row[6] != "O" and row[7] != "O")
            for row in zip(pdf["core_a"], pdf["flat_a"], pdf["w_a"], pdf["core_b"], pdf["flat_b"], pdf["w_b"], pdf["cls_a"], pdf["cls_b"], strict=True)
        ]
        keep = np.asarray(score) >= ENOUGH
        yield pdf.loc[keep, ["a", "b", "cls_a", "cls_b"]]


def parsed_names(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members, names)``: the distinct parses under their smallest ``node_id``, and to which of them each node belongs."""
    parts = ["cls", "form", "branch", "core", "flat"]
    rows = materialize(nodes.select("node_id", "node", "entity_type").mapInPandas(_parsed, _SCHEMA).withColumn("h", F.xxhash64(*parts)))
    names = materialize(rows.groupBy("h", *parts[:3], "core").agg(F.min("node_id").alias("name_id"), F.first("flat").alias("flat")))
    members = rows.select("node_id", "h", *parts[:4]).join(names.select("name_id", "h", *parts[:4]), ["h", *parts[:4]]).select("node_id", "name_id")
    return materialize(members), names.select(F.col("name_id").alias("node_id"), *parts)


def grams(token: Column, q: int) -> Column:
    """Distinct q-grams of a padded token with the q in front, so that grams of two lengths never meet."""
    padded = F.concat(F.lit("^" * (q - 1)), token, F.lit("$" * (q - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - q + 1), lambda i: F.concat(F.lit(str(q)), F.substring(padded, i, F.lit(q)))))


def _check_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[[similar_tokens(a, b) for a, b in zip(pdf["a"], pdf["b"], strict=True)]]


def similar_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """``a, b``: pairs a < b of similar tokens, by a prefix-filtered join on q-grams, and by initial sounds commonly confused.

    An edit destroys at most q grams and a transposition q + 1, so two similar
    tokens share one of the rarest (q + 1) * edits + 1 grams of each.
    """
    size = F.length("token")
    most = F.when(size >= LONG, 2).otherwise(1)
    sets = [
        vocabulary.where(here).select("token", grams(F.col("token"), q).alias("g"), ((q + 1) * most + 1).alias("keep"))
        for q, here in ((2, size <= SHORT), (3, size >= SHORT))
    ]
    each = sets[0].unionByName(sets[1]).select("token", "keep", F.explode("g").alias("gram"))
    counted = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(counted, "gram").groupBy("token", "keep", F.substring("gram", 1, 1).alias("q")).agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("g"))  # the grams of one token
    first = materialize(ordered.select("token", F.explode(F.slice("g", F.lit(1), F.col("keep"))).alias("g")).select("token", "g.gram"))
    met = first.withColumnRenamed("token", "a").join(first.withColumnRenamed("token", "b").hint("merge"), "gram").where("a < b and abs(length(a) - length(b)) <= 2")
    near = F.when(F.least(F.length("a"), F.length("b")) >= LONG, 2).otherwise(1)
    close = met.where(F.levenshtein("a", "b") <= 2 * near).select("a", "b").distinct()  # a transposition is two plain edits
    swapped = F.array_compact(F.array(*[
        F.when(F.col("token").startswith(x), F.concat(F.lit(y), F.expr(f"substring(token, {len(x) + 1})"))) for u, v in CONFUSED for x, y in ((u, v), (v, u))
    ]))
    sounds = vocabulary.select(F.col("token").alias("a"), F.explode(swapped).alias("token")).join(vocabulary.select("token"), "token")
    sounds = sounds.select(F.least("a", "token").alias("a"), F.greatest("a", "token").alias("b"))
    return close.mapInPandas(_check_tokens, "a string, b string").unionByName(sounds).where("a <> b").distinct()


def weighted_names(names: DataFrame) -> DataFrame:
    """``names`` with the weight of each core token (the rarer, the larger) and the elements by which it is met: itself, its full forms, and similar tokens that are more frequent."""
    total = max(names.count(), 1)
    places = names.select("node_id", F.posexplode("flat").alias("at", "token"))
    vocabulary = materialize(places.groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    words = vocabulary.where("length(token) > 1")
    pairs = similar_vocabulary(words)
    df = lambda c: words.select(F.col("token").alias(c), F.col("df").alias(f"df_{c}"))
    ranked = pairs.join(df("a"), "a").join(df("b"), "b")
    up = F.struct("df_a", "a") < F.struct("df_b", "b")
    hubs = ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("token"), F.xxhash64(F.when(up, F.col("b")).otherwise(F.col("a"))).alias("e"))
    full = F.create_map(*[F.lit(v) for t in sorted({*SHORT_FORMS, *_formal}) for v in (t, "|".join(sorted({f"={f}" for f in _formal.get(t, ())} | ({f"={t}"} if t in SHORT_FORMS else set()))))])
    given = words.select("token", F.explode(F.split(F.try_element_at(full, F.col("token")), r"\|")).alias("f")).select("token", F.xxhash64("f").alias("e"))
    own = vocabulary.select("token", F.xxhash64("token").alias("e"))
    elements = own.unionByName(hubs).unionByName(given).groupBy("token").agg(F.collect_set("e").alias("elements"))  # similar words of one word
    weight = F.log(1 + F.lit(float(total)) / F.col("df")) * F.when(F.col("token").isin(*sorted(DESCRIPTORS)), 0.25).otherwise(1.0)
    known = materialize(vocabulary.join(elements, "token").select("token", weight.alias("w"), "elements"))
    known = F.broadcast(known) if known.count() <= BROADCAST_TOKENS else known
    filled = places.join(known, "token").groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("at", "w", "elements"))).alias("p"))  # the tokens of one name
    return materialize(names.join(filled, "node_id").select(*names.columns, F.transform("p", lambda p: p["w"]).alias("w"), F.transform("p", lambda p: p["elements"]).alias("elements")))


def _keyed(kinds: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, keys, looking = [], [], []
            for node_id, cls, branch, flat, w, elements in zip(*(pdf[c] for c in ("node_id", "cls", "branch", "flat", "w", "elements")), strict=True):
                for looks, some in enumerate(name_keys(cls, branch, list(flat), list(w), [e.tolist() for e in elements], kinds)):
                    ids += [node_id] * len(some)
                    keys += some
                    looking += [bool(looks)] * len(some)
            yield pd.DataFrame({"node_id": np.array(ids, np.int64), "key": np.array(keys, np.int64), "looks": np.array(looking, bool)})

    return run


def candidates(names: DataFrame) -> DataFrame:
    """``a, b``: pairs of names of which one looks for the other by a key; a key of many rows is split by their number."""
    size = F.size(F.filter("flat", lambda t: F.length(t) > 1))
    kind = F.least(F.size("flat") - size, F.lit(3)) + F.when(size > FEW_WORDS, 4).otherwise(0)
    kinds = sorted(r[0] for r in names.select(kind.alias("k")).distinct().collect())  # at most eight
    spread = names.select("node_id", "cls", "branch", "flat", "w", "elements").repartition("node_id")
    keys = materialize(spread.mapInPandas(_keyed(kinds), "node_id bigint, key bigint, looks boolean"))
    count = keys.groupBy("key").agg(
        F.max("looks").alias("some"), F.count_if(~F.col("looks")).alias("found"), F.min("node_id").alias("low"), F.max("node_id").alias("high")
    )
    shared = count.where("some and found > 0 and low < high").select("key", F.ceil(F.col("found") / KEY_ROWS).cast("int").alias("parts"))
    placed = materialize(keys.join(shared, "key"))
    left = placed.where("looks").select(F.col("node_id").alias("x"), "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = placed.where("not looks").select(F.col("node_id").alias("y"), "key", F.pmod(F.xxhash64("node_id"), F.col("parts")).cast("int").alias("part"))
    return left.join(right.hint("merge"), ["key", "part"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def links(names: DataFrame) -> DataFrame:
    """Verified links ``a, b, cls_a, cls_b``."""
    side = lambda s: names.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cls", "form", "branch", "core", "flat", "w")], F.col("node_id").alias(s))
    pairs = materialize(candidates(names)).join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    forms = (F.col("form_a") == "") | (F.col("form_b") == "") | F.arrays_overlap(F.split("form_a", " "), F.split("form_b", " "))
    classes = (F.col("cls_a") == F.col("cls_b")) | (F.col("cls_a") == "U") | (F.col("cls_b") == "U")
    fit = pairs.where(classes & (F.col("branch_a") == F.col("branch_b")) & forms)
    return fit.select("a", "b", "cls_a", "cls_b", "core_a", "flat_a", "w_a", "core_b", "flat_b", "w_b").mapInPandas(
        _verify, "a bigint, b bigint, cls_a string, cls_b string"
    )


def settle_unknown(found: DataFrame, names: DataFrame) -> DataFrame:
    """Links within one class: a name of unknown type takes the class to which most of its links lead."""
    both = found.select("a", "cls_a", "b", "cls_b").unionByName(
        found.select(F.col("b").alias("a"), F.col("cls_b").alias("cls_a"), F.col("a").alias("b"), F.col("cls_a").alias("cls_b"))
    )
    votes = both.where("cls_a = 'U' and cls_b <> 'U'").groupBy("a").agg(
        F.sum(F.when(F.col("cls_b") == "P", 1).otherwise(-1)).alias("v")
    )
    settled = names.select(F.col("node_id").alias("a"), "cls").join(votes, "a", "left").select(
        "a", F.when(F.col("cls") != "U", F.col("cls")).when(F.col("v") > 0, "P").when(F.col("v") <= 0, "O").alias("c")
    ).where("c is not null")
    left, right = settled.withColumnRenamed("c", "ca"), settled.select(F.col("a").alias("b"), F.col("c").alias("cb"))
    return found.select("a", "b").join(left, "a").join(right, "b").where("ca = cb").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node_id, component`` (smallest id) of every node with a link, by label propagation with pointer jumping."""
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        spread = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        low = labels.join(spread, "a").select("a", "label", F.least("label", "near").alias("new"))
        jump = low.join(labels.select(F.col("a").alias("new"), F.col("label").alias("far")), "new", "left")
        nxt = materialize(jump.select("a", F.least("new", F.coalesce("far", "new")).alias("label"), (F.least("new", F.coalesce("far", "new")) != F.col("label")).alias("moved")))
        if nxt.where("moved").isEmpty():
            return nxt.select(F.col("a").alias("node_id"), F.col("label").alias("component"))
        labels = nxt.select("a", "label")


def entities(nodes: DataFrame) -> DataFrame:
    """``node_id, entity_id``: names that have a variant, with the smallest id among the variants."""
    members, parsed = parsed_names(nodes)
    names = weighted_names(parsed)
    found = materialize(links(names))
    joined = components(settle_unknown(found, names)).withColumnsRenamed({"node_id": "name_id", "component": "entity_id"})
    placed = materialize(members.join(joined, "name_id", "left").select("node_id", F.coalesce("entity_id", "name_id").alias("entity_id")))
    several = placed.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entity_id")
    return placed.join(several, "entity_id").select("node_id", "entity_id")


def p6_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class membership: one row a name that has variants."""
    return entities(table(spark, sf_dir, "nodes"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of spellings of one entity, as the query is defined; spellings of one name are few."""
    members = materialize(p6_entities(spark, sf_dir))
    other = members.select(F.col("node_id").alias("node_id_b"), "entity_id")
    return members.withColumnRenamed("node_id", "node_id_a").join(other, "entity_id").where("node_id_a < node_id_b").select("node_id_a", "node_id_b")


QUERIES = {"p6_found": p6_found, "p6_entities": p6_entities}
