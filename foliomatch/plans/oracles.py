"""The same queries in DuckDB's SQL, built from the same word lists and patterns. Containment and ratios are
spelled out as plain comparisons of all words of a pair, unlike the joins they are held against."""

from __future__ import annotations

from foliomatch import config as C
from foliomatch.functions import patterns as P


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inlist(words) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


def rx(s: str, pattern: str) -> str:
    return f"regexp_matches({s}, {q(pattern)})"


def sub(s: str, pattern: str, to: str) -> str:
    return f"regexp_replace({s}, {q(pattern)}, {q(to)}, 'g')"


def clean(s: str) -> str:
    return f"lower({sub(s, P.NOT_WORD, '')})"


def tones(s: str) -> str:
    return f"translate({s}, {q(C.TONES)}, '')"


def pad_zeros(s: str) -> str:
    (a, _), (b, _), (c, _) = P.PAD_ZERO
    return sub(sub(sub(s, a, r"0\1\2"), b, r"\g0").replace(q(r"\g0"), q(r"\10\2")), c, r"\10\2\3")


def bare(s: str) -> str:
    return sub(s, r"[,\s\p{Z}]", "")


def ascii_digits(s: str) -> str:
    return f"translate({s}, {q(C.THAI_DIGITS)}, '0123456789')"


def smart_number(s: str) -> str:
    n = bare(s)
    d = ascii_digits(n)
    strip = lambda x: f"coalesce(nullif(regexp_replace({x}, '^0+', ''), ''), '0')"
    whole = strip(f"regexp_replace(replace({d}, '_', ''), '^[+-]', '')")
    x = f"try_cast({d} AS DOUBLE)"
    return (
        f"CASE WHEN {rx(n, P.DECIMAL)} THEN CASE WHEN abs({x}) > 1e37 THEN NULL WHEN {x} = floor({x}) THEN ({x}::DECIMAL(38,0))::VARCHAR ELSE format('{{:g}}', {x}) END "
        f"WHEN {rx(n, P.INTEGER)} THEN CASE WHEN {whole} = '0' THEN '0' WHEN {n} LIKE '-%' THEN '-' || {whole} ELSE {whole} END ELSE {strip(n)} END"
    )


def is_number(s: str) -> str:
    return rx(bare(s), P.NUMBER)


def thai_number(s: str) -> str:
    has = lambda w: rx(s, P.any_of(w))
    return f"({has(C.NUMBER_WORDS)} AND ({has(C.NUMBER_UNITS)} OR {has(C.MONEY_WORDS)}))"


def extract_dates(s: str) -> str:
    two = lambda m, p, i: f"lpad({ascii_digits(f'regexp_extract({m}, {q(p)}, {i})')}, 2, '0')"
    named = [f"list_transform(regexp_extract_all({s}, {q(p)}), lambda m: {two('m', p, 1)} || '-{mm}-' || regexp_extract(m, {q(p)}, 2))" for p, mm in P.MONTH_DATES]
    p = P.NUMERIC_DATE
    named.append(f"list_transform(regexp_extract_all({s}, {q(p)}), lambda m: {two('m', p, 1)} || '-' || {two('m', p, 2)} || '-' || regexp_extract(m, {q(p)}, 3))")
    return f"flatten([{', '.join(named)}])"


def extract_times(s: str) -> str:
    h = ascii_digits(f"regexp_extract(m, {q(P.TIME)}, 1)")
    found = f"list_transform(regexp_extract_all({s}, {q(P.TIME)}), lambda m: {{'h': ({h})::INT, 'm': regexp_extract(m, {q(P.TIME)}, 2)}})"
    return f"list_transform(list_filter({found}, lambda hm: hm.h <= 24), lambda hm: lpad(hm.h::VARCHAR, 2, '0') || ':' || hm.m)"


def date_word(s: str) -> str:
    return f"({s} IN {inlist(C.MONTHS)} OR {rx(s, P.BE_YEAR)} OR {rx(s, P.DAY)} OR ({rx(s, P.any_of(C.MONTHS))} AND {rx(s, chr(92) + 'p{Nd}')}) OR {rx(s, '^' + P.NUMERIC_DATE + '$')})"


def date_context(s: str) -> str:
    return f"({rx(f'lower({s})', P.any_of(C.DATE_KEYWORDS))} OR {rx(s, P.any_of(C.DATE_KEYWORDS))})"


def match(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN NULL WHEN len({a}) > 0 AND len({b}) > 0 THEN list_sort({a}) = list_sort({b}) ELSE false END"


def same(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN list_sort({a}) = list_sort({b}) ELSE true END"


def significant(c: str) -> str:
    return f"(length({c}) >= {C.CONFIG.min_word_length} AND {c} NOT IN {inlist(C.STOPWORDS)})"


def form_label(s: str) -> str:
    c, raw = clean(s), f"regexp_replace(lower({s}), {q(chr(94) + r'[\s\p{Z}]+|[\s\p{Z}]+$')}, '', 'g')"
    return f"({c} <> '' AND ({c} IN {inlist(C.LABELS_EXACT + C.LABELS_PARTIAL)} OR {rx(c, P.LABEL_INSIDE)} OR {rx(raw, P.LABEL_INSIDE)} OR {rx(c, P.LABEL_START)} OR {rx(raw, P.LABEL_START)}))"


def lcs(a: str, b: str) -> str:
    return (
        f"list_reduce(list_prepend([0 for x in range(length({b}) + 1)], [[i] for i in range(1, length({a}) + 1)]), "
        f"lambda prev, i: list_reduce(list_prepend([0], [[j] for j in range(1, length({b}) + 1)]), "
        f"lambda r, j: list_append(r, CASE WHEN substr({a}, i[1], 1) = substr({b}, j[1], 1) THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], r[j[1]]) END)))[-1]"
    )


def blank(s: str) -> str:
    return f"coalesce(NOT {rx(s, r'[^\s\p{Z}]')}, true)"


def token_table(samples) -> str:
    """The distinct words of all documents and the sample texts."""
    return f"SELECT s FROM (SELECT DISTINCT unnest(regexp_extract_all(text, {q(P.TOKEN)})) AS s FROM documents UNION SELECT unnest([{', '.join(map(q, samples))}]))"


def words(source: str = "documents") -> str:
    """CTEs lines and words."""
    return f"""
lines AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS page_num, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {source})),
words AS (SELECT doc_id, page_num, (generate_subscripts(w, 1) - 1)::INT AS pos, unnest(w) AS text FROM (SELECT doc_id, page_num, regexp_extract_all(line, {q(P.TOKEN)}) AS w FROM lines))"""


SIGNIFICANT = f"sig AS (SELECT *, {clean('text')} AS clean FROM words), signif AS (SELECT * FROM sig WHERE {significant('clean')})"
VOCABULARY = f"""{SIGNIFICANT},
v0 AS (SELECT doc_id, clean, count(*)::BIGINT AS n_occ, arg_min(text, (page_num, pos)) AS first_text, min((page_num, pos)) AS place FROM signif GROUP BY ALL),
v1 AS (SELECT *, {pad_zeros('clean')} AS norm FROM v0),
vocab AS (SELECT *, {tones('norm')} AS norm_nt, length(clean)::INT AS len FROM v1)"""
#: Pairs with Thai words, tones, dates, times and numbers, which the tables lack: doc_id and text of both documents.
INLINE = (
    (-1, "Policy Insured John Smith Plate BM123 Amount 0500 Seats 17 Color red sometimes Bangkok 12.30"),
    (-2, "Policy Insured Jane Smyth Plate NM333 Amount 500 Seats 25 Colour blue never Pattaya 13.45"),
    (-3, "5มกราคม บ้าน บ้านพัก กรุงเทพ 1 มกราคม 2567 ทะเบียน กข1234 จำนวน 0700 007 หนึ่งร้อยบาท ห้อง 31\nบ้าน บ้านสวน"),
    (-4, "05มกราคม บาน บานพักอาศัย เชียงใหม่ 2 กุมภาพันธ์ 2567 ทะเบียน กข1235 จำนวน 700 0๗ สองร้อยบาท ห้อง 12\nบาน บ้านสวนหลวง"),
    (-5, "premium insurance 1 มกราคม 2567 09.15 kitten abcd 15 2567 x9 ตำบล"),
    (-6, "premiun insurances 1 มกราคม 2567 09.15 sitting abdc 16 2568 x8 ตำบล"),
)
INLINE_PAIRS = ((-1, -2), (-3, -4), (-5, -6))
#: Documents' sets of five-word runs, their classes, and links of a Jaccard similarity of 0.8 or more by counting common runs of all pairs.
SIMILAR = f"""
near_texts AS (SELECT min(doc_id) AS rep, text, regexp_extract_all(text, {q(P.TOKEN)}) AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY text),
near_sets AS (SELECT rep, text, list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)])) AS s FROM near_texts WHERE len(w) > 0),
near_keyed AS (SELECT *, md5(array_to_string(s, chr(10))) AS same FROM near_sets),
near_class AS (SELECT same, min(rep) AS class_id, any_value(s) AS s FROM near_keyed GROUP BY same),
near_items AS (SELECT class_id, len(s) AS n, unnest(s) AS x FROM near_class),
near_common AS (SELECT a.class_id AS a, b.class_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM near_items a JOIN near_items b ON a.x = b.x AND a.class_id <> b.class_id GROUP BY ALL),
near_links AS (SELECT a, b, c::DOUBLE / (na + nb - c) AS similarity FROM near_common WHERE 5 * c >= 4 * (na + nb - c)),
near_best AS (SELECT a, count(*)::BIGINT AS links, min((-similarity, b)) AS best FROM near_links GROUP BY a),
near_members AS (SELECT DISTINCT d.doc_id, c.class_id FROM documents d JOIN near_keyed k USING (text) JOIN near_class c USING (same))"""
_chr = lambda t: q(t).replace("\n", "' || chr(10) || '")
PAIRS = f"""
docs AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {', '.join(f'({i}, {_chr(t)})' for i, t in INLINE)})),
{SIMILAR},
pairs AS (SELECT a AS pair_id, a AS doc1, best[2] AS doc2 FROM near_best x WHERE NOT (a > best[2] AND EXISTS (SELECT 1 FROM near_best y WHERE y.a = x.best[2] AND y.best[2] = x.a))
  UNION ALL SELECT * FROM (VALUES {', '.join(f'({a}, {a}, {b})' for a, b in INLINE_PAIRS)})),
chosen AS (SELECT * FROM docs WHERE doc_id IN (SELECT doc1 FROM pairs UNION SELECT doc2 FROM pairs))"""
BASE = f"WITH {PAIRS}, {words('chosen')}, {VOCABULARY}"


def sides(catalog: bool) -> str:
    second = "" if catalog else " UNION ALL SELECT pair_id, 2, doc2, doc1 FROM pairs"
    return f"sides AS (SELECT pair_id, 1 AS side, doc1 AS doc_id, doc2 AS other FROM pairs{second})"


def matches(left: str, threshold: float, full: bool) -> str:
    """pair_id, side, a, b, score of the ladder for the words in `left` (pair_id, side, clean, norm, norm_nt, len, other)."""
    inside = lambda x: f"(length(l.{x}) >= 3 AND length(o.{x}) >= 3 AND (contains(l.{x}, o.{x}) OR contains(o.{x}, l.{x})))"
    tone = f"WHEN {inside('norm_nt')} THEN 0.83" if full else ""
    near = f"abs(o.len - l.len) <= greatest(l.len * 0.5, 3) AND 2 * least(l.len, o.len) >= {threshold} * (l.len + o.len)"
    shared = f"2 * len(list_filter(string_split(l.clean, ''), lambda c: contains(o.clean, c))) >= {threshold} * (l.len + o.len)"
    both = f"2 * len(list_filter(string_split(o.clean, ''), lambda c: contains(l.clean, c))) >= {threshold} * (l.len + o.len)"
    exact = "WHEN l.clean = o.clean THEN 1.0" if full else ""
    return f"""SELECT * FROM (SELECT l.pair_id, l.side, l.clean AS a, o.clean AS b,
      (CASE {exact} WHEN l.norm = o.norm THEN 0.95 WHEN l.norm_nt = o.norm_nt THEN 0.93 WHEN {inside('norm')} THEN 0.85 {tone}
       WHEN {near} AND {shared} AND {both} THEN (CASE WHEN 2 * ({lcs('l.clean', 'o.clean')}) / (l.len + o.len)::DOUBLE >= {threshold} THEN 2 * ({lcs('l.clean', 'o.clean')}) / (l.len + o.len)::DOUBLE END) END)::DOUBLE AS score
      FROM {left} l JOIN vocab o ON o.doc_id = l.other) WHERE score IS NOT NULL"""


def diff(catalog: bool) -> str:
    """CTEs up to diff: pair_id, side, doc_id, clean, first_text, place, n_occ."""
    day = rx("u.clean", P.DAY) + ("" if catalog else " AND len(list_filter(g.dates, lambda d: contains(d, u.clean))) > 0")
    return f"""{BASE}, {sides(catalog)},
ft AS (SELECT doc_id, string_agg(text, ' ' ORDER BY page_num, pos) AS t FROM words GROUP BY doc_id),
dt AS (SELECT doc_id, {extract_dates('t')} AS dates, {extract_times('t')} AS times FROM ft),
gate AS (SELECT s.pair_id, s.side, coalesce(a.dates, []) AS dates, {same('coalesce(a.dates, [])', 'coalesce(b.dates, [])')} AS dates_same, {same('coalesce(a.times, [])', 'coalesce(b.times, [])')} AS times_same
  FROM sides s LEFT JOIN dt a ON a.doc_id = s.doc_id LEFT JOIN dt b ON b.doc_id = s.other),
u AS (SELECT s.pair_id, s.side, s.other, v.* FROM sides s JOIN vocab v USING (doc_id)
  WHERE NOT EXISTS (SELECT 1 FROM vocab o WHERE o.doc_id = s.other AND o.clean = v.clean) AND NOT EXISTS (SELECT 1 FROM vocab o WHERE o.doc_id = s.other AND o.norm = v.norm)
  AND NOT {form_label('v.first_text')} AND NOT {form_label('v.clean')}),
k AS (SELECT u.*, ({rx('u.clean', chr(92) + 'p{Nd}')} OR {thai_number('u.first_text')}) AS num, g.dates_same FROM u JOIN gate g USING (pair_id, side)
  WHERE NOT (g.dates_same AND {date_word('u.first_text')}) AND NOT (g.times_same AND len({extract_times('u.first_text')}) > 0)
  AND NOT (({rx('u.clean', chr(92) + 'p{Nd}')} OR {thai_number('u.first_text')}) AND g.dates_same AND ({rx('u.clean', P.BE_YEAR)} OR ({day})))),
nums AS (SELECT doc_id, {smart_number('clean')} AS value FROM vocab WHERE {is_number('clean')}),
text_left AS (SELECT * FROM k WHERE NOT num),
met AS ({matches('text_left', C.CONFIG.fuzzy_strict, not catalog)}),
diff AS (
  SELECT * FROM k WHERE num AND NOT EXISTS (SELECT 1 FROM nums n WHERE n.doc_id = k.other AND n.value = {smart_number('k.clean')})
  UNION ALL SELECT * FROM text_left t WHERE NOT EXISTS (SELECT 1 FROM met m WHERE m.pair_id = t.pair_id AND m.side = t.side AND m.a = t.clean))"""


def same_ctes(catalog: bool) -> str:
    head = f"{BASE}, {sides(True)}, own AS (SELECT s.pair_id, s.side, s.other, v.* FROM sides s JOIN vocab v USING (doc_id))"
    exact = "exact AS (SELECT w.* FROM own w WHERE EXISTS (SELECT 1 FROM vocab o WHERE o.doc_id = w.other AND o.clean = w.clean)), rest AS (SELECT w.* FROM own w WHERE NOT EXISTS (SELECT 1 FROM vocab o WHERE o.doc_id = w.other AND o.clean = w.clean))"
    if catalog:
        return f"""{head}, {exact}, met AS ({matches('rest', C.CONFIG.fuzzy_loose, False)}),
same AS (SELECT pair_id, clean AS a, NULL::VARCHAR AS b, 'exact' AS stage FROM exact UNION ALL SELECT DISTINCT pair_id, a, NULL, 'fuzzy' FROM met)"""
    return f"""{head}, {exact},
partner AS (SELECT doc_id, norm, min(clean) AS b FROM vocab GROUP BY ALL),
normed AS (SELECT r.pair_id, r.clean AS a, p.b FROM rest r JOIN partner p ON p.doc_id = r.other AND p.norm = r.norm),
rest2 AS (SELECT * FROM rest r WHERE NOT EXISTS (SELECT 1 FROM partner p WHERE p.doc_id = r.other AND p.norm = r.norm)),
met AS ({matches('rest2', C.CONFIG.fuzzy_loose, True)}),
same AS (SELECT pair_id, clean AS a, clean AS b, 'exact' AS stage FROM exact UNION ALL SELECT pair_id, a, b, 'norm' FROM normed UNION ALL SELECT pair_id, a, b, 'fuzzy' FROM met)"""


TOTALS = f"""tot AS (SELECT doc_id, count(DISTINCT page_num)::BIGINT AS pages, count(*)::BIGINT AS total_words,
  count(DISTINCT clean) FILTER ({significant('clean')})::BIGINT AS unique_words FROM sig GROUP BY doc_id),
base AS (SELECT p.pair_id, p.doc1, p.doc2, {', '.join(f'coalesce(t{n}.{c}, 0) AS doc{n}_{c}' for n in (1, 2) for c in ('pages', 'total_words', 'unique_words'))}
  FROM pairs p LEFT JOIN tot t1 ON t1.doc_id = p.doc1 LEFT JOIN tot t2 ON t2.doc_id = p.doc2)"""
SAMPLE = "array_to_string(list_transform(list_sort(list(row(place, clean)))[1:10], lambda x: x[2]), ', ')"


def diff_summary(catalog: bool) -> str:
    of = lambda n: f"LEFT JOIN (SELECT pair_id, count(*)::BIGINT AS n, sum(n_occ)::BIGINT AS places, {SAMPLE} AS sample FROM diff WHERE side = {n} GROUP BY pair_id) d{n} USING (pair_id)"
    return f"""{diff(catalog)}, {TOTALS},
summary AS (SELECT base.*, coalesce(d1.n, 0) AS diff_doc1, coalesce(d1.places, 0) AS highlighted_doc1, coalesce(d1.sample, '') AS sample_doc1,
  coalesce(d2.n, 0) AS diff_doc2, coalesce(d2.places, 0) AS highlighted_doc2, coalesce(d2.sample, '') AS sample_doc2,
  CASE WHEN doc1_unique_words + doc2_unique_words > 0 THEN round((coalesce(d1.n, 0) + coalesce(d2.n, 0)) * 100.0::DOUBLE / (doc1_unique_words + doc2_unique_words), 4) ELSE 0.0 END AS diff_rate
  FROM base {of(1)} {of(2)})"""


def same_summary(catalog: bool) -> str:
    return f"""{same_ctes(catalog)}, {TOTALS},
one AS (SELECT m.pair_id, count(*)::BIGINT AS matched_unique_words, {SAMPLE.replace('clean', 'v.clean')} AS sample_matched
  FROM (SELECT DISTINCT pair_id, a FROM same) m JOIN pairs p USING (pair_id) JOIN vocab v ON v.doc_id = p.doc1 AND v.clean = m.a GROUP BY m.pair_id),
place1 AS (SELECT m.pair_id, count(DISTINCT (s.page_num, s.pos, s.text))::BIGINT AS matched_doc1 FROM (SELECT DISTINCT pair_id, a FROM same) m JOIN pairs p USING (pair_id) JOIN signif s ON s.doc_id = p.doc1 AND s.clean = m.a GROUP BY m.pair_id),
two AS (SELECT m.pair_id, count(DISTINCT (s.page_num, s.pos, s.text))::BIGINT AS matched_doc2 FROM (SELECT DISTINCT pair_id, b FROM same WHERE b IS NOT NULL) m JOIN pairs p USING (pair_id) JOIN signif s ON s.doc_id = p.doc2 AND s.clean = m.b GROUP BY m.pair_id)
SELECT base.*, coalesce(matched_doc1, 0) AS matched_doc1, coalesce(matched_unique_words, 0) AS matched_unique_words, coalesce(sample_matched, '') AS sample_matched, coalesce(matched_doc2, 0) AS matched_doc2,
  CASE WHEN doc1_unique_words > 0 THEN round(coalesce(matched_doc1, 0) * 100.0::DOUBLE / doc1_unique_words, 4) ELSE 0.0 END AS match_rate
FROM base LEFT JOIN one USING (pair_id) LEFT JOIN place1 USING (pair_id) LEFT JOIN two USING (pair_id)"""
