"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tankline.llm.mixing import BLOCK, REPEATS, SEED, SHARD, WEIGHTS
from tankline.llm.quality_rules import RULES, STOP_WORDS

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"


def _rule(r) -> str:
    return f"CAST({r.over} AS DOUBLE) / greatest({r.per}, 1) BETWEEN {r.low} AND {r.high}"


def quality_rules() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(3) AS s(k) GROUP BY r),
ln AS (SELECT r, t, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM ln WHERE regexp_matches(line, '[^ \t\n\x0b\f\r]') GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop_words,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN cov USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(map(_rule, RULES))} AS kept
FROM b
"""


def _draw(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 7) AS BIGINT)"


def mixing() -> str:
    weights = ", ".join(map(str, WEIGHTS))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS sk, source IS NULL AS sn, len({WORDS}) AS size FROM documents),
s0 AS (SELECT sk, sn, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY sk, sn),
s1 AS (SELECT *, [{weights}][(row_number() OVER (ORDER BY sn, sk) - 1) % {len(WEIGHTS)} + 1] AS weight FROM s0),
s2 AS (SELECT *, {REPEATS} * source_size AS lim, {REPEATS} * source_size / weight AS ratio FROM s1),
s3 AS (SELECT *, ((SELECT sum(source_size) FROM s2) - coalesce(sum(lim) OVER (ORDER BY ratio, sn, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY ratio, sn, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s2),
s4 AS (SELECT sk, sn, source_size, least(CAST(lim AS DOUBLE), (SELECT max(lev) FROM s3 WHERE lev <= ratio) * weight) AS target FROM s3),
total AS (SELECT CAST(floor(sum(source_size) / {BLOCK} + 0.5) AS BIGINT) AS m FROM s4),
seat AS (SELECT sk, sn, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, sn, sk) AS place
         FROM s4, (SELECT unnest(range(1, m + 1)) AS k FROM total) WHERE target > 0),
q AS (SELECT sk, sn, count(*) AS quota FROM seat WHERE place <= (SELECT m FROM total) GROUP BY sk, sn),
p0 AS (SELECT s4.*, coalesce(quota, 0) * {BLOCK} AS wd FROM s4 LEFT JOIN q USING (sk, sn)),
p1 AS (SELECT *, CASE WHEN source_size > 0 THEN least(wd // source_size, {REPEATS}) ELSE 0 END AS passes,
              ceil(sqrt(greatest(ceil(source_size / {SHARD}), 1))) AS groups FROM p0),
p AS (SELECT *, CAST(CASE WHEN passes < {REPEATS} THEN floor((wd - passes * source_size) / {BLOCK} + 0.5) ELSE 0 END AS BIGINT) AS blocks,
             CAST(ceil(greatest(ceil(source_size / {SHARD}), 1) / groups) AS BIGINT) AS per_group FROM p1),
x AS (SELECT *, {_draw(f"'group {SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')")} % CAST(groups AS BIGINT) AS g,
             {_draw(f"'shard {SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')")} % per_group AS h FROM d JOIN p USING (sk, sn)),
u AS (SELECT sk, sn, g, sum(size) AS gs, any_value(blocks) AS blocks FROM x GROUP BY sk, sn, g),
us AS (SELECT sk, sn, g, blocks, row_number() OVER (PARTITION BY sk, sn ORDER BY gs / (2 * k - 1) DESC, g) AS place
       FROM (SELECT *, unnest(range(1, blocks + 1)) AS k FROM u WHERE gs > 0)),
uq AS (SELECT sk, sn, g, count(*) AS gb FROM us WHERE place <= blocks GROUP BY sk, sn, g),
h AS (SELECT sk, sn, g, h, sum(size) AS hs FROM x GROUP BY sk, sn, g, h),
hk AS (SELECT sk, sn, g, h, gb, row_number() OVER (PARTITION BY sk, sn, g ORDER BY hs / (2 * k - 1) DESC, h) AS place
       FROM (SELECT *, unnest(range(1, gb + 1)) AS k FROM h JOIN uq USING (sk, sn, g) WHERE hs > 0)),
hq AS (SELECT sk, sn, g, h, count(*) AS quota FROM hk WHERE place <= gb GROUP BY sk, sn, g, h),
z0 AS (SELECT sk, sn, g, h, CAST(hs AS BIGINT) AS hs, coalesce(quota, 0) * {BLOCK} AS want, CAST(hs AS BIGINT) // {BLOCK} * {BLOCK} AS ring0 FROM h LEFT JOIN hq USING (sk, sn, g, h)),
z1 AS (SELECT *, CASE WHEN want = 0 THEN 0 WHEN want >= ring0 THEN hs ELSE want END AS lng FROM z0),
z AS (SELECT *, CASE WHEN lng < ring0 THEN ring0 ELSE hs END AS ring,
             CASE WHEN lng < ring0 THEN {_draw(f"'start {SEED}|' || sk || '|' || CAST(sn AS VARCHAR) || '|' || CAST(g AS VARCHAR) || '|' || CAST(h AS VARCHAR)")} % (ring0 // {BLOCK}) * {BLOCK} ELSE 0 END AS bg FROM z1),
o AS (SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, passes, ring, lng, bg,
             sum(size) OVER (PARTITION BY sk, sn, g, h ORDER BY md5('order {SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS f
      FROM x JOIN z USING (sk, sn, g, h))
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(bg + lng - ring, f + size) - f) + greatest(0, least(least(bg + lng, ring), f + size) - greatest(bg, f)) AS BIGINT) AS taken
FROM o
"""


def jaccard_join() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
             list_filter(string_split_regex({lower}, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
link AS (SELECT x, y FROM common JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
reach AS (SELECT r, r AS c FROM d UNION SELECT y, c FROM reach JOIN link ON x = reach.r)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN reach USING (r) JOIN d o ON o.r = c GROUP BY d.r, d.doc_id
"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _crc32(text: str) -> str:
    byte = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    bytes_ = f"list_prepend(4294967295, list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT)))"
    return f"xor(list_reduce({bytes_}, lambda a, b: {byte}), 4294967295)"


def merkle_manifest(modulus: int = 7) -> str:
    leaf = lambda n: f"sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field(n)} || {_field('text')})"

    def tree(name: str, leaves: str) -> str:
        return f"""{name} AS (SELECT k, 0 AS lvl, i, h, c FROM {leaves} UNION ALL
  SELECT k, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(c) + 1) // 2 FROM {name} WHERE c > 1 GROUP BY k, lvl, i // 2)"""

    def fold(name: str, start: str, nodes: str) -> str:
        both = "CASE WHEN f.i % 2 = 0 THEN f.cur || coalesce(s.h, '') ELSE s.h || f.cur END"
        return f"""{name} AS (SELECT r, k, 0 AS lvl, i, c, cur, proof FROM {start} UNION ALL
  SELECT f.r, f.k, f.lvl + 1, f.i // 2, (f.c + 1) // 2, sha256({both}), f.proof || coalesce(s.h, '')
  FROM {name} f LEFT JOIN {nodes} s ON s.k = f.k AND s.lvl = f.lvl AND s.i = f.i + 1 - 2 * (f.i % 2) WHERE f.c > 1)"""

    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS k, {leaf("n_chars")} AS h,
             CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % {modulus} = 0 THEN {leaf("(CAST(n_chars AS HUGEINT) + 1)")} ELSE {leaf("n_chars")} END AS cur FROM documents),
l AS (SELECT r, doc_id, k, h, cur, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h, r) - 1 AS i, count(*) OVER (PARTITION BY k) AS c FROM d),
{tree("t", "l")},
top AS (SELECT k AS name, h FROM t WHERE c = 1),
g AS (SELECT '' AS k, name, h, row_number() OVER (ORDER BY name) - 1 AS i, count(*) OVER () AS c FROM top),
{tree("u", "g")},
a AS (SELECT r, k, i, c, cur, '' AS proof FROM l),
{fold("f", "a", "t")},
b AS (SELECT f.r, g.k, g.i, g.c, f.cur, f.proof FROM f JOIN g ON g.name = f.k WHERE f.c = 1),
{fold("z", "b", "u")}
SELECT l.doc_id, l.h AS leaf, top.h AS subroot, u.h AS root, sha256(z.proof) AS proof_sha256, z.cur AS folded_root, z.cur = u.h AS verified
FROM l JOIN top ON top.name = l.k JOIN z ON z.r = l.r AND z.c = 1 JOIN u ON u.c = 1
"""


def exact_dedup() -> str:
    return r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def oracles() -> dict[str, str]:
    return {
        "op4_quality_rules": quality_rules(),
        "op5_jaccard_join": jaccard_join(),
        "op6_mixing": mixing(),
        "op11_merkle_manifest": merkle_manifest(),
        "op12_exact_dedup": exact_dedup(),
    }
