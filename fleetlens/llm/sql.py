"""Queries 3, 5, 7, 11, 12 and 13 as DuckDB SQL over the same tables."""

from __future__ import annotations

from . import hard_negatives as H
from . import lexical_search as L
from . import mixing as M
from .license_scan import BASE, COVERED, GRAM, SLACK, TEMPLATES
from .quality_rules import CHARS_APART, COMMON, MIN_CHARS, MIN_WORDS, WORDS_APART

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = "[\\x20\\x09-\\x0D]+"


def _words(text: str, separators: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{separators}'), lambda x: x <> '')"


JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_FOLD, _SPACES)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pr AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM sh a JOIN sh b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
ln AS (SELECT u, v FROM pr JOIN sz x ON x.doc_id = u JOIN sz y ON y.doc_id = v WHERE 100 * i >= 80 * (x.n + y.n - i)),
both_ways AS (SELECT u, v FROM ln UNION ALL SELECT v, u FROM ln),
reach AS (SELECT DISTINCT u AS node, u AS other FROM both_ways UNION SELECT reach.node, both_ways.v FROM reach JOIN both_ways ON both_ways.u = reach.other)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(component, d.doc_id) AS BIGINT) AS component_id
FROM d LEFT JOIN sz USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(other) AS component FROM reach GROUP BY 1) USING (doc_id)
"""

_TEMPLATE_ROWS = ", ".join(
    f"({k}, '{label}', {len(w)}, {at}, '{w[at]}', '{w[at + 1]}', '{w[at + 2]}')" for k, (label, text) in enumerate(TEMPLATES) for w in [text.split()] for at in range(len(w) - GRAM + 1)
)
_BASE_ROWS = " UNION ALL ".join(
    f"SELECT rid, i - 1 AS place, '{label}' AS label FROM w, unnest(range(1, len(w) + 1)) r(i) WHERE " + " AND ".join(f"w[i + {k}] = '{part}'" for k, part in enumerate(phrase.split())) for phrase, label in BASE.items()
)
LICENSE = f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, {_words(_FOLD, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM documents),
t(template, label, size, pos, t0, t1, t2) AS (VALUES {_TEMPLATE_ROWS}),
hits AS (SELECT DISTINCT rid, template, label, size, pos, i - 1 AS place FROM w, unnest(range(1, len(w) - 1)) r(i) JOIN t ON w[i] = t0 AND w[i + 1] = t1 AND w[i + 2] = t2),
dg AS (SELECT *, place - pos AS diagonal FROM hits),
op AS (SELECT rid, template, diagonal, CASE WHEN diagonal - lag(diagonal) OVER n <= {SLACK} THEN 0 ELSE 1 END AS opens FROM (SELECT DISTINCT rid, template, diagonal FROM dg) WINDOW n AS (PARTITION BY rid, template ORDER BY diagonal)),
sp AS (SELECT *, sum(opens) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM op),
cv AS (SELECT rid, label, template, span, max(size) AS size, count(DISTINCT pos + k) AS found, min(place) AS a, max(place) + {GRAM - 1} AS z FROM dg JOIN sp USING (rid, template, diagonal), range({GRAM}) q(k) GROUP BY 1, 2, 3, 4),
ok0 AS (SELECT DISTINCT rid, label, a, z, size, found / CAST(size AS DOUBLE) AS score FROM cv WHERE found / CAST(size AS DOUBLE) >= {COVERED}),
ok AS (SELECT * FROM ok0 s WHERE NOT EXISTS (SELECT 1 FROM ok0 t WHERE t.rid = s.rid AND t.label <> s.label AND (t.score > s.score OR t.score = s.score AND t.size > s.size) AND 2 * (least(s.z, t.z) - greatest(s.a, t.a) + 1) >= s.z - s.a + 1)),
b AS ({_BASE_ROWS}),
bb AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM b GROUP BY 1),
al AS (SELECT rid, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM (SELECT rid, label FROM b UNION ALL SELECT rid, label FROM ok) GROUP BY 1),
sc AS (SELECT rid, max(score) AS score FROM ok GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
 coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(score, 0) END AS score
FROM w LEFT JOIN bb USING (rid) LEFT JOIN al USING (rid) LEFT JOIN sc USING (rid)
"""

_BINS = sorted({x for ws in COMMON.values() for x in ws.split()})
_LANGS = ", ".join(f"'{x}'" for x in COMMON)
_STEPS = ["[a-z]+", _SPACES, "[A-Z]+", "[0-9]+", "[.,;:!?''\"()-]+", "[#*$%&|<>]+", "\\p{L}+"]


def _rest(k: int) -> str:
    """The text after the first k steps have taken their characters away."""
    out = "t"
    for s in _STEPS[:k]:
        out = f"regexp_replace({out}, '{s}', '', 'g')"
    return out


_CLASSES = ", ".join(["length(t) - length(r0)", *(f"length(r{k}) - length(r{k + 1})" for k in range(6)), "length(r6)"])
_JS = "sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))"
QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
r AS (SELECT *, {_words('t', _SPACES)} AS w, {', '.join(f'{_rest(k + 1)} AS r{k}' for k in range(7))}, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM r, unnest(range(1, len(w) - 1)) q(i))),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM win, range(3) q(k) WHERE c > 1 GROUP BY 1),
cls AS (SELECT rid, lang, unnest([{_CLASSES}]) AS n, unnest(range(8)) AS bin, 'c' AS kind FROM r),
hit AS (SELECT rid, lang, word, count(*) AS n FROM (SELECT rid, lang, unnest(w) AS word FROM r) WHERE word IN ({', '.join(f"'{b}'" for b in _BINS)}) GROUP BY 1, 2, 3),
wrd AS (SELECT rid, lang, n, word AS bin FROM hit UNION ALL SELECT r.rid, r.lang, len(w) - coalesce(h, 0), ' other' FROM r LEFT JOIN (SELECT rid, sum(n) AS h FROM hit GROUP BY 1) USING (rid)),
cell AS (SELECT rid, lang, n, CAST(bin AS VARCHAR) AS bin, kind FROM cls UNION ALL SELECT rid, lang, n, bin, 'w' FROM wrd),
tot AS (SELECT rid, kind, sum(n) AS total FROM cell GROUP BY 1, 2),
ref0 AS (SELECT lang, kind, bin, sum(n) AS n FROM cell WHERE lang IN ({_LANGS}) GROUP BY 1, 2, 3),
ref AS (SELECT lang AS ref_lang, kind, bin, n / CAST(sum(n) OVER (PARTITION BY lang, kind) AS DOUBLE) AS q FROM ref0),
judged AS (SELECT rid, kind, total FROM tot WHERE total >= CASE kind WHEN 'c' THEN {MIN_CHARS} ELSE {MIN_WORDS} END),
grid AS (SELECT j.rid, j.kind, ref_lang, ref.bin, q, coalesce(n, 0) / CAST(total AS DOUBLE) AS p FROM judged j JOIN ref USING (kind) LEFT JOIN cell ON cell.rid = j.rid AND cell.kind = j.kind AND cell.bin = ref.bin),
extra AS (SELECT j.rid, j.kind, ref_lang, sum(coalesce(n, 0)) / any_value(CAST(total AS DOUBLE)) AS mass FROM judged j JOIN cell ON cell.rid = j.rid AND cell.kind = j.kind, (SELECT DISTINCT ref_lang FROM ref) l WHERE NOT EXISTS (SELECT 1 FROM ref x WHERE x.ref_lang = l.ref_lang AND x.kind = j.kind AND x.bin = cell.bin) GROUP BY 1, 2, 3),
dist AS (SELECT rid, kind, ref_lang, sqrt(greatest(0, js * js + coalesce(mass, 0) / 2)) AS js FROM (SELECT rid, kind, ref_lang, {_JS} AS js FROM grid GROUP BY 1, 2, 3) LEFT JOIN extra USING (rid, kind, ref_lang)),
near AS (SELECT rid, bool_or(js > CASE kind WHEN 'c' THEN {CHARS_APART} ELSE {WORDS_APART} END) AS far FROM (SELECT rid, kind, min(js) AS js FROM dist GROUP BY 1, 2) GROUP BY 1),
base AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(t) - length(r0) + length(r1) AS BIGINT) AS word_chars, CAST(length(r4) - length(r5) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM r LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(far, false) AS kept
FROM base LEFT JOIN near USING (rid)
"""


def _drawn(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('-', '{M.SEED}', {', '.join(parts)})), 1, 15) AS BIGINT)"


_ROUNDS = [f"p{r + 1} AS (SELECT * REPLACE (CASE WHEN (u % {M._P} * (k{r} % {M._P - 1} + 1) + u // {M._P} * b + b) % {M._P} % 2 = 1 THEN o ELSE x END AS x) FROM"
           f" (SELECT *, greatest(x, o) AS u, k{r} // {M._P} % {M._P} AS b FROM (SELECT * EXCLUDE (u, b, o), (k{r} % n + n - x) % n AS o FROM p{r})))" for r in range(M.ROUNDS)]  # fmt: skip
MIX = f"""
WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY 1),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM s0),
s2 AS (SELECT *, CAST([{', '.join(map(str, M.WEIGHTS))}][number % {len(M.WEIGHTS)} + 1] AS DOUBLE) AS weight FROM s1),
s3 AS (SELECT *, CAST(coalesce(sum(source_size) OVER q, 0) AS DOUBLE) AS stopped, coalesce(sum(weight) OVER q, 0) AS w FROM s2 WINDOW q AS (ORDER BY source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT max(({M.SHARE} * (SELECT CAST(sum(source_size) AS DOUBLE) FROM s0) - {M.MOST}.0 * stopped) / ((SELECT sum(weight) FROM s2) - w)) AS level FROM s3),
s4 AS (SELECT source, number, source_size, least(weight * level, {M.MOST}.0 * source_size) AS target FROM s3, lv),
s5 AS (SELECT *, (source_size + {M.BLOCK - 1}) // {M.BLOCK} AS n FROM s4 WHERE source_size > 0),
s6 AS (SELECT *, CAST(floor(target * n / source_size + 0.5) AS BIGINT) AS slots FROM s5),
t0 AS (SELECT CAST(sum(slots) AS BIGINT) AS total FROM s6),
t1 AS (SELECT total, greatest(1, (total + {M.SHARD - 1}) // {M.SHARD}) AS shards FROM t0),
t2 AS (SELECT *, (total + shards - 1) // shards AS each FROM t1),
s7 AS (SELECT *, slots * each // total AS whole, slots * each % total AS rest FROM s6, t2),
t3 AS (SELECT t2.*, each - (SELECT CAST(sum(whole) AS BIGINT) FROM s7) AS lft FROM t2),
r AS (SELECT number, CAST(sum(rest) OVER (ORDER BY number) AS BIGINT) AS high, rest FROM s7 WHERE rest > 0),
d AS (SELECT i // lft AS shard, {_drawn("'draw'", 'CAST(i AS VARCHAR)')} % (lft * total) AS y FROM t3, unnest(range(shards * lft)) u(i)),
c0 AS (SELECT number, h.shard, whole AS n FROM s7, t3, unnest(range(t3.shards)) h(shard) WHERE whole > 0 UNION ALL SELECT number, shard, count(*) FROM d JOIN r ON y >= high - rest AND y < high GROUP BY 1, 2),
c1 AS (SELECT number, shard, CAST(sum(n) AS BIGINT) AS cnt FROM c0 GROUP BY 1, 2),
c2 AS (SELECT number, sum(cnt) AS cnt FROM c1 GROUP BY 1),
p0 AS (SELECT *, place % n AS x, 0 AS u, 0 AS b, 0 AS o, {', '.join(f"{_drawn(chr(39) + 'key' + chr(39), 'CAST(number AS VARCHAR)', 'CAST(place // n AS VARCHAR)', chr(39) + str(r) + chr(39))} AS k{r}" for r in range(M.ROUNDS))}
 FROM (SELECT number, n, unnest(range(CAST(least(cnt, {M.MOST} * n) AS BIGINT))) AS place FROM c2 JOIN s5 USING (number))),
{', '.join(_ROUNDS)},
tm AS (SELECT number, x AS idx, count(*) AS times FROM p{M.ROUNDS} GROUP BY 1, 2),
e0 AS (SELECT z.doc_id, z.size, number, source_size, target, row_number() OVER () AS rid, CAST(sum(size) OVER (PARTITION BY number ORDER BY z.doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS a FROM z JOIN s4 ON z.source IS NOT DISTINCT FROM s4.source),
e1 AS (SELECT *, unnest(CASE WHEN size > 0 THEN range(a // {M.BLOCK}, (a + size - 1) // {M.BLOCK} + 1) ELSE [-1] END) AS idx FROM e0)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN times IS NULL THEN 0 ELSE times * (least((idx + 1) * {M.BLOCK}, a + size) - greatest(idx * {M.BLOCK}, a)) END) AS BIGINT) AS taken
FROM e1 LEFT JOIN tm USING (number, idx) GROUP BY rid, doc_id, size, source_size, target
"""

_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLD}, '{_TERM}') AS w FROM documents),
dn AS (SELECT *, len(w) AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM dn),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM dn) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, s),
m AS (SELECT rid, doc_id, {L.FREE} + ({L.BY_LENGTH} * n * nn) // ll AS m FROM dn, s),
i AS (SELECT row_number() OVER () AS iid, item_id, list_distinct(regexp_extract_all({_FOLD}, '{_TERM}')) AS w FROM benchmark),
it AS (SELECT iid, item_id, unnest(w) AS term FROM i),
sc AS (SELECT iid, item_id, rid, doc_id, CAST(sum(w * (({L.SCALE} * tf) // ({L.PER_TF} * tf + {L.PER_M} * m))) AS BIGINT) AS score FROM it JOIN wt USING (term) JOIN tf USING (term) JOIN m USING (rid) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM rk WHERE rank <= 10
"""

NEGATIVES = f"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {H.EVERY} = 0),
pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id) AS k FROM p WHERE alike) WHERE k <= {H.POSITIVES}),
neg AS (SELECT pos.anchor_id, pos.vec_id AS positive_id, pos.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score, row_number() OVER (PARTITION BY pos.arid, pos.k ORDER BY n.score DESC, n.vec_id) AS rank
 FROM pos JOIN p n ON n.arid = pos.arid AND NOT n.alike AND {H.LOW} * pos.score <= 100 * n.score AND 100 * n.score <= {H.HIGH} * pos.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= {H.NEGATIVES}
"""
