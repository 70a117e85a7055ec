"""The same queries as SQL for another engine, built from shared pieces.

Written from the definitions and not from the Spark plans: text functions, blocking keys, lists,
features and decisions are stated again as common table expressions.
"""

from __future__ import annotations

from tessera.functions import text as t
from tessera.operators.blocking import ADDRESS_WORDS, GENERIC_WORDS
from tessera.sources import world

_TOKENS = r"list_filter(string_split_regex(trim({x}), '\s+'), lambda t: t <> '')"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tokens(x: str) -> str:
    return _TOKENS.format(x=x)


def plain(x: str) -> str:
    return rf"regexp_replace(strip_accents(coalesce({x}, '')), '[^\x00-\x7F]', '', 'g')"


def domains(x: str) -> str:
    return f"regexp_replace({x}, {q('(?i)' + t.DOMAINS)}, '', 'g')"


def leet(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[0-9@$]') AND regexp_matches({x}, '[A-Za-z]') THEN translate({x}, '{t.LEET_FROM}', '{t.LEET_TO}') ELSE {x} END"


def name(x: str) -> str:
    s = f"replace({domains(f'lower({plain(x)})')}, '&', ' and ')"
    for pattern, put in t.LEGAL_RULES:
        s = f"regexp_replace({s}, {q(pattern)}, {q(put)}, 'g')"
    s = rf"regexp_replace({s}, '[^a-z0-9\s]', ' ', 'g')"
    return f"array_to_string(list_transform({tokens(s)}, lambda w: {leet('w')}), ' ')"


def base(x: str) -> str:
    b = rf"trim(regexp_replace(regexp_replace({x}, {q(t.BASE_STRIP)}, '', 'g'), '\s+', ' ', 'g'))"
    return f"CASE WHEN length({b}) >= 3 THEN {b} ELSE {x} END"


def country(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'UNKNOWN' ELSE upper(trim({x})) END"


def postal(x: str) -> str:
    return f"coalesce(list_last(regexp_extract_all({plain(x)}, {q(t.POSTAL)}, 1)), '')"


def house(x: str) -> str:
    return f"regexp_extract({plain(x)}, {q(t.NUMBER)}, 1)"


def nums(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all({plain(x)}, {q(t.NUMBER)}, 1))), ',')"


def address(x: str) -> str:
    table = ", ".join(f"{q(k)}: {q(v)}" for k, v in t.ADDRESS_WORDS.items())
    words = tokens(rf"regexp_replace(replace(lower({plain(x)}), '&', ' and '), '[^a-z0-9\s]', ' ', 'g')")
    return f"array_to_string(list_transform({words}, lambda w: coalesce((MAP {{{table}}})[w], w)), ' ')"


def soundex(x: str) -> str:
    codes = f"string_split(translate(upper({x}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202'), '')"
    runs = f"list_filter({codes}, lambda c, i: i = 1 OR c <> {codes}[i - 1])"
    rest = f"replace(array_to_string({runs}[2:], ''), '0', '')"
    return f"CASE WHEN regexp_matches({x}, '^[A-Za-z]+$') THEN rpad(substr(upper(substr({x}, 1, 1)) || {rest}, 1, 4), 4, '0') ELSE '' END"


def grams(x: str) -> str:
    s = f"replace({x}, ' ', '')"
    return f"CASE WHEN length({s}) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(length({s}) - 2, 1) + 1), lambda i: substr({s}, i, 3))) END"


def shared(a: str, b: str) -> str:
    return f"len(list_distinct(list_intersect({a}, {b})))"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN CAST({shared(a, b)} AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN CAST({shared(a, b)} AS DOUBLE) / least(len(list_distinct({a})), len(list_distinct({b}))) ELSE 0.0 END"


def numbers(x: str) -> str:
    return rf"list_distinct(regexp_extract_all({x}, '\b[0-9]{{1,6}}\b'))"


def indel(a: str, b: str) -> str:
    """Indel similarity, 0 to 1, of strings of at most 120 characters, as a fold over bit vectors."""
    full = f"((1::HUGEINT << length({a})::INT) - 1)"
    mask = f"list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substr({a}, i + 1, 1) = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT"
    masks = f"list_transform(string_split({b}, ''), lambda c: {mask})"
    step = f"(((v + (v & m)) | (v - (v & m))) & {full})"
    v = f"list_reduce({masks}, lambda v, m: {step}, {full})"
    return f"CASE WHEN length({a}) = 0 AND length({b}) = 0 THEN 1.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 2.0 * (length({a}) - bit_count({v})) / (length({a}) + length({b})) END"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, from the indel similarity."""
    return f"CAST(round({indel(a, b)} * (length({a}) + length({b})) / 2) AS BIGINT)"


def token_set(rows: str, a: str, b: str, name: str) -> str:
    """rows with ``name``, the best ratio among shared tokens and shared tokens with either rest, 0 to 1."""
    both = "CAST(length(sb) AS DOUBLE)"
    na, nb = (f"({both} + CASE WHEN sb <> '' THEN 1 ELSE 0 END + length({x}))" for x in ("ra", "rb"))
    rest = f"1 - (length(ra) + length(rb) - 2 * {lcs('ra', 'rb')}) / greatest({na} + {nb}, 1)"
    best = f"CASE WHEN len(xa) = 0 OR len(xb) = 0 THEN 0.0 WHEN sb <> '' AND (ra = '' OR rb = '') THEN 1.0 WHEN sb = '' THEN {rest} ELSE greatest({rest}, 2 * {both} / ({both} + {na}), 2 * {both} / ({both} + {nb})) END"
    return f"""SELECT *, {best} AS {name} FROM (SELECT *, array_to_string(list_sort(list_intersect(xa, xb)), ' ') AS sb, array_to_string(list_sort(list_filter(xa, lambda t: NOT list_contains(xb, t))), ' ') AS ra,
  array_to_string(list_sort(list_filter(xb, lambda t: NOT list_contains(xa, t))), ' ') AS rb FROM (SELECT *, list_distinct({tokens(a)}) AS xa, list_distinct({tokens(b)}) AS xb FROM {rows}))"""


def sorted_name(x: str) -> str:
    return f"array_to_string(list_sort({tokens(x)}), ' ')"


def partial(rows: str, a: str, b: str, name: str) -> str:
    """(s1_id, t_id, name): the best indel similarity, 0 to 1, of the shorter string with any window of the longer; every window is a row."""
    return f"""WITH sides AS (SELECT s1_id, t_id, CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END AS x, CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END AS y FROM {rows}),
tried AS (SELECT DISTINCT x, y FROM (SELECT x, y FROM sides UNION ALL SELECT y, x FROM sides WHERE length(x) = length(y)) WHERE x <> '' AND x <> y),
windows AS (SELECT DISTINCT x, y, substr(y, greatest(i, 1), i + length(x) - greatest(i, 1)) AS w FROM (SELECT x, y, unnest(range(2 - length(x), length(y) + 1)) AS i FROM tried)),
found AS MATERIALIZED (SELECT x, w, {indel('x', 'w')} AS v FROM (SELECT DISTINCT x, w FROM windows)),
best AS (SELECT x, y, max(v) AS v FROM windows JOIN found USING (x, w) GROUP BY x, y)
SELECT s1_id, t_id, CASE WHEN sides.x = sides.y THEN 1.0 WHEN sides.x = '' THEN 0.0 ELSE greatest(one.v, coalesce(two.v, 0.0)) END AS {name}
FROM sides LEFT JOIN best one ON one.x = sides.x AND one.y = sides.y LEFT JOIN best two ON two.x = sides.y AND two.y = sides.x"""


def entities(source: str) -> str:
    return (
        f"SELECT entity_id AS id, ord, k, {country('country')} AS country, norm_name, {base('norm_name')} AS base_name, {address('business_address')} AS norm_addr, "
        f"{postal('business_address')} AS postal_code, {house('business_address')} AS house_num, {nums('business_address')} AS addr_nums FROM (SELECT *, {name('business_name')} AS norm_name FROM {source})"
    )


ENTITIES = f"{world.CTES}, n1 AS MATERIALIZED ({entities('s1')}), nt AS MATERIALIZED ({entities('targets')})"
_GENERIC = "(" + ", ".join(map(q, GENERIC_WORDS)) + ")"
_STREETS = "(" + ", ".join(map(q, ADDRESS_WORDS)) + ")"


def keys(source: str) -> str:
    """(id, ord, country, key_rank, key_ord, key) of an entity table."""
    head = rf"trim(regexp_replace(norm_name, {q(t.HONORIFIC)}, '')) "
    parts = f"list_filter(list_transform(string_split({head}, ' dba '), lambda p: trim(p)), lambda p: p <> '')"
    rows = [
        (0, 0, "glued", "length(glued) >= 4"), (0, 1, "bglued", "length(bglued) >= 4 AND bglued <> glued"), (0, 2, "glue3", "len(toks) >= 2 AND length(glue3) >= 4"),
        (1, 0, "part", "true"), (1, 1, "base", "base <> '' AND base <> part"),
        (2, 0, "array_to_string(list_sort(special[1:4]), '_')", "len(toks) >= 2 AND len(special) >= 2"), (2, 1, "array_to_string(list_sort(toks[1:4]), '_')", "len(toks) >= 2"),
        (3, 0, "toks[1] || '_' || postal_code", "postal_code <> ''"), (4, 0, "toks[1] || '_' || house_num", "length(house_num) >= 2"),
        (6, 0, "toks[1] || '_' || toks[2]", "len(toks) >= 2"), (7, 0, "letters", "len(toks) >= 3 AND length(letters) >= 3"), (7, 0, "toks[1]", "len(toks) = 1 AND length(toks[1]) <= 5 AND regexp_matches(toks[1], '^[a-z]+$')"),
        (9, 0, soundex("toks[1]"), f"length(toks[1]) >= 3 AND toks[1] NOT IN {_GENERIC} AND regexp_matches(toks[1], '^[a-z]+$')"),
    ]
    named = " UNION ALL ".join(f"SELECT id, ord, country, {r} AS key_rank, (part_no * 1000 + {o})::INT AS key_ord, {k} AS key FROM f WHERE {c}" for r, o, k, c in rows)
    return f"""
  WITH p AS (SELECT *, unnest(range(len(parts))) AS part_no FROM (SELECT *, {parts} AS parts FROM {source})),
  b AS (SELECT *, {base('part')} AS base FROM (SELECT *, parts[part_no + 1] AS part FROM p)),
  a AS (SELECT *, CASE WHEN len(bt) >= 2 THEN bt ELSE pt END AS toks FROM (SELECT *, {tokens('base')} AS bt, {tokens('part')} AS pt FROM b)),
  f AS (SELECT *, replace(part, ' ', '') AS glued, replace(base, ' ', '') AS bglued, array_to_string(list_sort(toks[1:3]), '') AS glue3, list_filter(toks, lambda x: x NOT IN {_GENERIC}) AS special,
        array_to_string(list_transform(list_filter(toks, lambda x: regexp_matches(x, '^[a-z]')), lambda x: substr(x, 1, 1)), '') AS letters FROM a),
  g AS (SELECT *, list_filter({tokens('norm_addr')}, lambda x: length(x) >= 4 AND x NOT IN {_STREETS}) AS addr FROM {source})
  {named}
  UNION ALL SELECT id, ord, country, 5, 0, house_num || '_' || addr[len(addr)] FROM g WHERE house_num <> '' AND len(addr) >= 1
  UNION ALL SELECT id, ord, country, 5, 1, house_num || '_' || addr[1] FROM g WHERE house_num <> '' AND len(addr) >= 2
  UNION ALL SELECT id, ord, country, 8, key_ord, key FROM (SELECT id, ord, country, (part_no * 1000 + i - 1)::INT AS key_ord, toks[i] AS key FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM f))
    WHERE length(key) >= 4 AND key NOT IN {_GENERIC}"""


POSTINGS = f"""{ENTITIES}, pk AS ({keys('n1')}), tk AS ({keys('nt')}),
postings AS (SELECT * FROM (SELECT country, key_rank, key, row_number() OVER (PARTITION BY country, key_rank, key ORDER BY ord, key_ord) AS pos, id AS t_id, ord AS t_ord FROM tk) WHERE key_rank < 3 OR pos <= 300)"""


def candidates(k: int) -> str:
    """Adds cand (s1_id, t_id, cand_rank); the priority is one number."""
    return f"""{POSTINGS}, met AS (
  SELECT pk.id AS s1_id, t_id, min(pk.key_rank::HUGEINT * 100000000000000000000 + pk.key_ord::HUGEINT * 10000000000000 + t_ord) AS pri
  FROM pk JOIN postings USING (country, key_rank, key) GROUP BY ALL
), cand AS MATERIALIZED (SELECT s1_id, t_id, r::INT AS cand_rank FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY pri, t_id) AS r FROM met) WHERE r <= {k})"""


_SIDE = ("norm_name", "base_name", "norm_addr", "postal_code", "house_num", "toks", "addr_toks")


def pairs(k: int) -> str:
    both = ", ".join(f"s.{c} AS s_{c}, t.{c} AS t_{c}" for c in _SIDE)
    return f"""{candidates(k)},
q1 AS MATERIALIZED (SELECT *, {tokens('norm_name')} AS toks, {tokens('norm_addr')} AS addr_toks FROM n1), qt AS MATERIALIZED (SELECT *, {tokens('norm_name')} AS toks, {tokens('norm_addr')} AS addr_toks FROM nt),
pairs AS MATERIALIZED (SELECT cand.s1_id, cand.t_id, cand_rank, s.ord AS s1_ord, {both} FROM cand JOIN q1 s ON s.id = cand.s1_id JOIN qt t ON t.id = cand.t_id)"""


PRUNED = "(s_postal_code <> '' AND s_postal_code = t_postal_code) OR len(list_intersect(s_toks, t_toks)) > 0 OR length(s_norm_name) <= 5 OR length(t_norm_name) <= 5"
_LINEAR = (
    f"round(0.5 * {jaccard('s_toks', 't_toks')} + 0.3 * CASE WHEN s_base_name <> '' AND s_base_name = t_base_name THEN 1.0 ELSE 0.0 END + "
    "0.2 * CASE WHEN s_postal_code <> '' AND t_postal_code <> '' THEN CASE WHEN s_postal_code = t_postal_code THEN 1.0 ELSE 0.0 END ELSE 0.5 END, 9)"
)


def scores(k: int, prune: bool = True, serving: bool = True) -> str:
    p = _LINEAR if not serving else _LINEAR.replace(jaccard("s_toks", "t_toks"), f"CASE WHEN s_norm_name <> '' AND s_norm_name = t_norm_name THEN 1.0 ELSE {jaccard('s_toks', 't_toks')} END")
    return f"{pairs(k)}, scores AS MATERIALIZED (SELECT s1_id, t_id, cand_rank, s1_ord, CAST({p} AS DOUBLE) AS p FROM pairs{f' WHERE {PRUNED}' if prune else ''})"


def passing(chain: str, adaptive: bool = True, gate: float = 0.58, sibling: float = 0.38, margin: float = 0.22) -> str:
    reach = f"{margin} * sqrt(least(1.0, greatest(0.40, top)))" if adaptive else str(margin)
    return f"{chain}, passing AS MATERIALIZED (SELECT s1_id, t_id, cand_rank, s1_ord, p FROM (SELECT *, max(p) OVER (PARTITION BY s1_id) AS top FROM scores) WHERE top >= {gate} AND p >= greatest({sibling}, top - {reach}))"


def boosted(chain: str) -> str:
    alike = indel("na", "nb")
    return f"""{passing(chain)}, firsts AS (
  SELECT * FROM (SELECT s1_id, t_id, substr(t_id, 1, 2) AS source, row_number() OVER (PARTITION BY s1_id, substr(t_id, 1, 2) ORDER BY cand_rank) AS n FROM passing) WHERE n <= 2
), named AS (SELECT firsts.*, {sorted_name('norm_name')} AS sn FROM firsts JOIN nt ON nt.id = t_id),
duo AS (SELECT a.s1_id, a.t_id AS a, b.t_id AS b, a.sn AS na, b.sn AS nb FROM named a JOIN named b ON a.s1_id = b.s1_id AND a.source = 'S2' AND b.source = 'S3'),
alike AS (SELECT s1_id, a, b, {alike} AS sim FROM duo),
gains AS (SELECT s1_id, t_id, sum(0.08 * sim) AS more FROM (SELECT s1_id, a AS t_id, sim FROM alike WHERE sim >= 0.70 UNION ALL SELECT s1_id, b, sim FROM alike WHERE sim >= 0.70) GROUP BY ALL),
boosted AS MATERIALIZED (SELECT s1_id, t_id, cand_rank, s1_ord, p, least(1.0, p + coalesce(more, 0.0)) AS pb FROM passing LEFT JOIN gains USING (s1_id, t_id)),
ranked AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(pb, 9) DESC, cand_rank) AS rank FROM boosted) WHERE rank <= 6),
owners AS (SELECT t_id, s1_id AS owner FROM (SELECT t_id, s1_id, row_number() OVER (PARTITION BY t_id ORDER BY round(pb, 9) DESC, s1_ord) AS n FROM ranked) WHERE n = 1),
owned AS (SELECT ranked.* FROM ranked JOIN owners USING (t_id) WHERE owner = s1_id),
matches AS MATERIALIZED (SELECT s1_id, t_id, rank, pb FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, substr(t_id, 1, 2) ORDER BY rank) AS nth FROM owned) WHERE nth <= 3)"""


TRUTH = "truth AS (SELECT s1.entity_id AS s1_id, coalesce(m, []) AS matched FROM s1 LEFT JOIN (SELECT k, list_sort(list(entity_id)) AS m FROM targets GROUP BY k) USING (k))"
EDGES = "edges AS (SELECT s1.entity_id AS s1_id, targets.entity_id AS t_id FROM s1 JOIN targets USING (k))"


def lists(chain: str, pairs_from: str, order: str, column: str) -> str:
    return f"WITH {chain} SELECT s1.entity_id AS source1_entity_id, coalesce(l, '') AS {column} FROM s1 LEFT JOIN (SELECT s1_id, string_agg(t_id, ',' ORDER BY {order}) AS l FROM {pairs_from} GROUP BY s1_id) x ON x.s1_id = s1.entity_id"
