"""SQL over the same tables for the queries on tokens, spans, labels and relations."""

from __future__ import annotations

import re

from loomgraph.operators import bio, relations
from loomgraph.plans import rules

_SPACE = r"\s\p{Z}\x1c-\x1f\x85"
_SINGLE = {k: v for k, v in rules.CHAR_MAP.items() if len(v) == 1}
_GONE = [k for k, v in rules.CHAR_MAP.items() if not v]


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(map(quoted, values))


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def normal(x: str) -> str:
    """SQL of the text normalization."""
    mapped = f"translate(nfc_normalize(coalesce({x}, '')), {quoted(''.join(_SINGLE) + ''.join(_GONE))}, {quoted(''.join(_SINGLE.values()))})"
    return strip(rf"regexp_replace(replace({mapped}, '…', '...'), '[ \t]{{2,}}', ' ', 'g')")


def _class(chars: str) -> str:
    return "".join("\\" + c if c in "[](){}.,;:!?" else c for c in chars).replace("'", "''")


_OPEN, _CLOSE = _class(bio.OPENING), _class(bio.CLOSING)
_DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]"

TEXTS = f"t AS (SELECT rec_id, row_id, field_name, {normal('text')} AS text, entities FROM sentence_records)"
TOKENS = rf"""
pieces AS (SELECT rec_id, unnest(regexp_extract_all(text, '[{_SPACE}]+|[^{_SPACE}]+')) AS p, generate_subscripts(regexp_extract_all(text, '[{_SPACE}]+|[^{_SPACE}]+'), 1) AS no FROM t),
placed AS (SELECT *, sum(length(p)) OVER (PARTITION BY rec_id ORDER BY no) - length(p) AS pos FROM pieces),
heads AS (SELECT rec_id, no, pos, p, regexp_extract(p, '^[{_OPEN}]*') AS head FROM placed WHERE NOT regexp_matches(p, '^[{_SPACE}]')),
cores AS (SELECT *, regexp_extract(substr(p, length(head) + 1), '(?s)^(?:.*(?:{_DIGIT}[.,]|[^{_CLOSE}]))?') AS core FROM heads),
words AS (SELECT rec_id, no, pos, list_filter(list_concat(string_split(head, ''), [core], string_split(substr(p, length(head) + length(core) + 1), '')), lambda x: x <> '') AS ws FROM cores),
loose AS (SELECT rec_id, no, pos, unnest(ws) AS token, generate_subscripts(ws, 1) AS k FROM words),
toks AS (SELECT rec_id, token, row_number() OVER (PARTITION BY rec_id ORDER BY no, k) - 1 AS i,
  pos + sum(length(token)) OVER (PARTITION BY rec_id, no ORDER BY k) - length(token) AS s, pos + sum(length(token)) OVER (PARTITION BY rec_id, no ORDER BY k) AS e FROM loose)"""

_RANK = "CASE etype " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(rules.DICTIONARY_ORDER)) + " ELSE 9 END"
_TRIGGER = " OR ".join(f"contains(w, {quoted(t)})" for t in rules.INDUSTRY_TRIGGERS)
_FOLD = "list_reduce({spans}, lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.s < x[1].e AND x[1].s < a.e)) > 0 THEN acc ELSE list_concat(acc, x) END)"
#: dictionary hits: positions of each name, whole words only, in the case that is asked for, with a trigger word where one is needed; longest first without overlaps
DICTIONARY = rf"""
g AS (SELECT orig_name AS name, lower(orig_name) AS low, etype, coalesce(case_sensitive, false) AS exact, row_number() OVER (ORDER BY length(orig_name) DESC, {_RANK}, entry_id) AS no
  FROM gazetteer WHERE length(trim(orig_name)) > 0),
held AS (SELECT rec_id, text, lower(text) AS low_text, g.*, string_split(lower(text), low) AS parts FROM t JOIN g ON contains(lower(text), low)),
hits AS (SELECT *, unnest(list_transform(range(1, len(parts)), lambda k: list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(low))) AS s FROM held),
whole AS (SELECT *, s + length(low) AS e, substr(low_text, CAST(greatest(s - 49, 1) AS BIGINT), CAST(least(s, 50) AS BIGINT)) AS w1, substr(low_text, CAST(s + 1 AS BIGINT), 50) AS w2 FROM hits
  WHERE NOT (s > 0 AND regexp_matches(substr(low_text, CAST(s AS BIGINT), 1), '[\p{{L}}\p{{N}}]')) AND NOT regexp_matches(substr(low_text, CAST(s + length(low) + 1 AS BIGINT), 1), '[\p{{L}}\p{{N}}]')),
fit AS (SELECT rec_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, etype, no FROM whole WHERE (NOT exact OR substr(text, CAST(s + 1 AS BIGINT), length(name)) = name)
  AND (etype <> 'INDUSTRY' OR low NOT IN ({listed(rules.INDUSTRY_NEEDS_CONTEXT)}) OR {_TRIGGER.replace("(w,", "(w1,")} OR {_TRIGGER.replace("(w,", "(w2,")})),
taken AS (SELECT rec_id, {_FOLD.format(spans="list([struct_pack(s := s, e := e, etype := etype)] ORDER BY s - e, s, no)")} AS spans FROM fit GROUP BY rec_id),
dict AS (SELECT rec_id, unnest(spans).s AS s, unnest(spans).e AS e, unnest(spans).etype AS etype FROM taken)"""
_LABEL = "CASE x.etype " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.MODEL_LABELS.items()) + " ELSE x.etype END"
MODEL = f"""
ents AS (SELECT rec_id, text, unnest(entities) AS x, generate_subscripts(entities, 1) AS no FROM t),
model AS (SELECT rec_id, instr(text, x.text) - 1 AS s, instr(text, x.text) - 1 + length(x.text) AS e, {_LABEL} AS etype, no FROM ents
  WHERE x.score >= 0.7 AND length(trim(x.text)) > 0 AND {_LABEL} <> '{rules.DROPPED_TYPE}' AND instr(text, x.text) > 0)"""
RESOLVED = f"""
two AS (SELECT rec_id, s, e, etype, 3 AS p, no FROM model UNION ALL SELECT rec_id, s, e, etype, 1, s FROM dict),
won AS (SELECT rec_id, {_FOLD.format(spans="list([struct_pack(s := s, e := e, etype := etype)] ORDER BY p DESC, s - e, s, no)")} AS spans FROM two GROUP BY rec_id),
sp AS (SELECT rec_id, unnest(spans).s AS s, unnest(spans).e AS e, unnest(spans).etype AS etype FROM won)"""
SPANS = f"{TEXTS},{DICTIONARY},{MODEL},{RESOLVED}"
BIO = f"""{SPANS},{TOKENS},
bio AS (SELECT rec_id, i, token, coalesce((SELECT CASE WHEN sp.s = k.s THEN 'B-' ELSE 'I-' END || sp.etype FROM sp WHERE sp.rec_id = k.rec_id AND sp.s <= k.s AND k.e <= sp.e ORDER BY sp.s LIMIT 1), 'O') AS label FROM toks k)"""


def _steps() -> str:
    known = ", ".join(f"({quoted(t)}, {quoted(k)}, {str(add).lower()})" for t, (k, add) in rules.TOKEN_FIXES.items())
    out = rf"""
split AS (SELECT rec_id, i, label, token, CASE WHEN contains(token, '/') AND token NOT IN ({listed(rules.UNSPLIT_TOKENS)}) THEN regexp_extract_all(token, '/|[^/]+') ELSE [token] END AS parts FROM bio),
pieces2 AS (SELECT rec_id, i, label, parts, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM split),
f0 AS (SELECT rec_id, part AS token, row_number() OVER (PARTITION BY rec_id ORDER BY i, k) - 1 AS i,
  CASE WHEN len(parts) = 1 AND part <> '/' OR k = list_position(list_transform(parts, lambda x: x <> '/'), true) THEN label WHEN len(parts) = 1 AND part = '/' THEN 'O' ELSE 'O' END AS label FROM pieces2),
f1 AS (SELECT rec_id, f0.token, i, CASE WHEN v.token IS NULL THEN label WHEN label = 'O' THEN CASE WHEN add_it THEN 'B-' || kind ELSE 'O' END WHEN substr(label, 3) <> kind THEN left(label, 2) || kind ELSE label END AS label
  FROM f0 LEFT JOIN (VALUES {known}) AS v(token, kind, add_it) ON v.token = f0.token)"""
    for no, (pair, kind, add) in enumerate(rules.SEQUENCE_FIXES, 1):
        a, b = map(quoted, pair)
        wrong = lambda x: f"({x} <> 'O' AND substr({x}, 3) <> '{kind}')"  # noqa: E731, B023

        def change(mine: str, first: str, second: str, prefix: str, kind=kind, add=add, wrong=wrong) -> str:
            if kind is None:
                return "'O'"
            whether = f"({str(add).lower()} AND {first} = 'O' AND {second} = 'O') OR {wrong(first)} OR {wrong(second)}"
            return f"CASE WHEN {whether} THEN '{prefix}-{kind}' ELSE {mine} END"

        out += f""",
f{no + 1} AS (SELECT rec_id, token, i, CASE WHEN token = {a} AND nt = {b} THEN {change("label", "label", "nl", "B")} WHEN token = {b} AND pt = {a} THEN {change("label", "pl", "label", "I")} ELSE label END AS label
  FROM (SELECT *, lead(token) OVER w AS nt, lead(label) OVER w AS nl, lag(token) OVER w AS pt, lag(label) OVER w AS pl FROM f{no} WINDOW w AS (PARTITION BY rec_id ORDER BY i)))"""
    return out + f""",
fixed AS (SELECT rec_id, token, i, CASE WHEN left(label, 2) = 'I-' AND coalesce(nullif(substr(lag(label) OVER (PARTITION BY rec_id ORDER BY i), 3), ''), '') <> substr(label, 3) THEN 'B-' || substr(label, 3) ELSE label END AS label
  FROM f{len(rules.SEQUENCE_FIXES) + 1})"""


FIXED = f"{BIO},{_steps()}"
_CANON = "CASE {x} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in rules.CANONICAL.items()) + " ELSE {y} END"
#: entities: B- opens one, I- goes on whatever its type, O closes; an island is all that follows a B- up to the next B- or O
ISLANDS = f"""{FIXED},
marked AS (SELECT *, sum(CASE WHEN left(label, 2) <> 'I-' THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY i) AS island FROM fixed),
named AS (SELECT rec_id, island, string_agg(token, ' ' ORDER BY i) AS text, substr(arg_min(label, i), 3) AS type FROM marked GROUP BY 1, 2 HAVING left(arg_min(label, i), 2) = 'B-'),
entities AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY island) - 1 AS i, text, {_CANON.format(x="text", y=_CANON.format(x=strip("text"), y="text"))} AS canonical, type FROM named)"""


def entity(x: str) -> str:
    """SQL of the entity normalization (without composition)."""
    base = rf"regexp_replace(regexp_replace({strip(x)}, '[\s\p{{Z}}]{{2,}}', ' ', 'g'), '^[.,;:!?\"'']+|[.,;:!?\"'']+$', '', 'g')"
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in rules.ALIASES.items())
    return rf"""(CASE WHEN {x} IS NULL OR {strip(x)} = '' THEN '' ELSE coalesce(CASE lower({base}) {cases} ELSE NULL END,
      CASE WHEN length({base}) < 2 OR length({base}) > 80 OR regexp_matches({base}, '^[\p{{Nd}}\s\p{{Z}}.,;:\-/]+$') THEN '' ELSE {base} END) END)"""


def _bag(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[{_SPACE}]+'), lambda z: z <> ''))"


def best_match(surface: str, known: str) -> str:
    """SQL of the best entity: equal, else containing or contained, else with enough words in common; the first of its kind."""
    low = f"lower({strip(surface)})"
    words, common = _bag("e.text"), _bag(surface)
    share = f"len(list_intersect({words}, {common})) / CAST(greatest(1, len(list_distinct(list_concat({words}, {common})))) AS DOUBLE)"
    return (
        f"coalesce(list_filter({known}, lambda e: lower(e.text) = {low})[1], list_filter({known}, lambda e: contains({low}, lower(e.text)) OR contains(lower(e.text), {low}))[1], "
        f"list_filter({known}, lambda e: {share} >= 0.45)[1])"
    )


def _re2(pattern: str) -> str:
    """The pattern with white space of all scripts, inside classes and outside."""
    out, inside = "", False
    for part in re.split(r"(\\.|\[|\])", pattern):
        if part in ("[", "]"):
            inside = part == "["
        space = r"\s\p{Z}\x85"
        out += {r"\w": r"\p{L}\p{N}_", r"\d": r"\p{Nd}", r"\s": space if inside else f"[{space}]"}.get(part, part)
    return out.replace("'", "''")


def relations_sql(named: bool = False) -> str:
    """All triples of all records: pattern matches and pairs, of equal ones within a record the first; ``named``: entities are normalized beforehand."""
    parts = []
    for no, (name, pattern, st, ot, weight, both) in enumerate(rules.RELATIONS):
        p = _re2(pattern)
        of = lambda ts: f"list_filter(ents, lambda e: e.etype IN ({listed(ts)}))" if ts else "ents"
        parts.append(f"""
m{no} AS (SELECT rec_id, text, ents, unnest(regexp_extract_all(text, '{p}', 1)) AS l, unnest(regexp_extract_all(text, '{p}', 2)) AS r, generate_subscripts(regexp_extract_all(text, '{p}', 1), 1) AS k FROM r),
b{no} AS (SELECT rec_id, text, {strip("l")} AS l, {strip("r")} AS r, k, {best_match(strip("l"), of(st))} AS a, {best_match(strip("r"), of(ot))} AS b FROM m{no}),
d{no} AS (SELECT rec_id, text, {no} * 1000000 + k * 2 AS k, '{name}' AS relation, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a.name ELSE {entity("l") if st is None else "NULL"} END AS s, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b.name ELSE {entity("r") if st is None else "NULL"} END AS o,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a.etype ELSE 'UNKNOWN' END AS st, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b.etype ELSE 'UNKNOWN' END AS ot,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CAST(round(least(1.0, CAST({weight} AS DECIMAL(6,4)) * (0.7 + 0.15 * (CAST(a.score AS DECIMAL(10,6)) + CAST(b.score AS DECIMAL(10,6))))), 4) AS DOUBLE) ELSE {weight}::DOUBLE END AS c FROM b{no}
  {"" if st is None else "WHERE a IS NOT NULL AND b IS NOT NULL"})""")
    found = []
    for no, (*_, both) in enumerate(rules.RELATIONS):
        found.append(f"SELECT rec_id, text, k, relation, s, st, o, ot, c FROM d{no}")
        if both:
            found.append(f"SELECT rec_id, text, k + 1, relation, o, ot, s, st, c FROM d{no}")
    pairs = []
    for no, (left, right) in enumerate(rules.CO_PAIRS):
        pairs.append(f"""SELECT x.rec_id, x.text, {50 + no} * 1000000 + x.i * 1000 + y.i, '{rules.CO_OCCURRENCE}', x.name, x.etype, y.name, y.etype,
          CAST(round((CAST(x.score AS DECIMAL(10,6)) + CAST(y.score AS DECIMAL(10,6))) * CAST(0.25 AS DECIMAL(6,4)), 4) AS DOUBLE) FROM flat x JOIN flat y ON x.rec_id = y.rec_id AND x.i <> y.i
          WHERE length(x.text) < {relations.SHORT} AND x.etype IN ({listed(left)}) AND y.etype IN ({listed(right)})""")
    return f"""{TEXTS},
raw AS (SELECT rec_id, text, unnest(entities) AS x, generate_subscripts(entities, 1) AS no FROM t WHERE entities IS NOT NULL AND text <> ''),
once AS (SELECT rec_id, text, no, x, {entity("nfc_normalize(x.text)") if named else "nfc_normalize(x.text)"} AS etext FROM raw),
flat AS (SELECT rec_id, text, row_number() OVER (PARTITION BY rec_id ORDER BY no) AS i, etext, x.etype AS etype, coalesce(x.score, 0.0) AS score, {entity("etext")} AS name FROM once WHERE length(etext) > 0),
r AS (SELECT rec_id, any_value(text) AS text, list(struct_pack(text := etext, etype := etype, score := score, name := name) ORDER BY i) AS ents FROM flat GROUP BY rec_id),{",".join(parts)},
every AS ({" UNION ALL ".join(found + pairs)}),
rel AS (SELECT rec_id, relation, s AS subject, o AS obj, min(k) AS k, arg_min(struct_pack(v := st), k).v AS subject_type, arg_min(struct_pack(v := ot), k).v AS obj_type, arg_min(c, k) AS confidence, any_value(left(text, 120)) AS source_text
  FROM every WHERE s <> '' AND o <> '' AND s <> o GROUP BY rec_id, relation, s, o)"""


def packs(text: str, keys: str, source: str, marks: str = ".!?;", most: int = 600) -> str:
    """Greedy sentence packs of ``text`` in ``source``, as rows ``keys, sent_no, text``: a fold whose last entry is the open pack."""
    cuts = f"list_filter(list_transform(range(0, CAST(ceil(length(x[1]) / {float(most)}) AS BIGINT)), lambda i: {strip(f'substr(x[1], i * {most} + 1, {most})')}), lambda p: p <> '')"
    fold = (
        f"list_reduce(list_prepend([''], list_transform(string_split(regexp_replace({strip(text)}, '([{marks}])[{_SPACE}]+', '\\1' || chr(1), 'g'), chr(1)), lambda z: [z])), "
        f"lambda acc, x: CASE WHEN length(acc[-1]) + length(x[1]) + 1 <= {most} THEN list_concat(acc[:-2], [{strip("acc[-1] || ' ' || x[1]")}]) "
        f"WHEN length(x[1]) > {most} THEN list_concat(acc, {cuts}, ['']) ELSE list_concat(acc, x) END)"
    )
    return f"""folded AS (SELECT {keys}, list_filter(list_transform({fold}, lambda p: {strip("p")}), lambda p: length(p) >= 5) AS packs FROM {source}),
packed AS (SELECT {keys}, unnest(packs) AS text, generate_subscripts(packs, 1) - 1 AS sent_no FROM folded)"""


def chunks(text: str, keys: str, source: str, marks: str = ".!?", most: int = 1500) -> str:
    """Chunks for a model with their starts: sentences joined while they fit, none cut."""
    fold = (
        f"list_reduce(list_prepend([''], list_transform(string_split(regexp_replace({text}, '([{marks}])[{_SPACE}]+', '\\1' || chr(1), 'g'), chr(1)), lambda z: [z])), "
        f"lambda acc, x: CASE WHEN length(acc[-1]) = 0 THEN list_concat(acc[:-2], x) WHEN length(acc[-1]) + length(x[1]) + 1 <= {most} THEN list_concat(acc[:-2], [acc[-1] || ' ' || x[1]]) ELSE list_concat(acc, x) END)"
    )
    return f"""folded AS (SELECT {keys}, list_filter({fold}, lambda p: length(p) > 0) AS cs FROM {source}),
chunked AS (SELECT {keys}, unnest(cs) AS chunk, generate_subscripts(cs, 1) - 1 AS chunk_no, unnest(list_transform(range(0, len(cs)), lambda k: coalesce(list_sum(list_transform(cs[1:k], lambda c: length(c) + 1)), 0))) AS start FROM folded)"""
