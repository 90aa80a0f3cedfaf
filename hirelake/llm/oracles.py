"""DuckDB SQL of the corpus queries that SQL can express, on the same tables."""

from __future__ import annotations

#: Fixed values: the primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_FULL = "18446744073709551616"


def _u(x: str | int) -> str:
    return f"CAST({x} AS UHUGEINT)"


def _mul(a: str, b: str | int) -> str:
    return f"CAST(({_u(a)} * {_u(b)}) % {_u(_FULL)} AS UBIGINT)"


def _add(a: str, b: str | int) -> str:
    return f"CAST(({_u(a)} + {_u(b)}) % {_u(_FULL)} AS UBIGINT)"


def _bind(value: str, name: str, body: str) -> str:
    """``body`` in which the name stands for the value."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _rotl(x: str, r: int) -> str:
    """``x`` is a name: it is used twice."""
    return f"({_mul(x, 1 << r)} | ({x} >> {64 - r}))"


def _round(acc: str | int, lane: str) -> str:
    return _bind(_add(str(acc), _mul(lane, P2)), "q", _mul(_rotl("q", 31), P1))


def _bytes(at: str, n: int) -> str:
    """The n bytes of the hex text ``x`` from byte ``at`` (a name) as a little-endian number."""
    return "CAST('0x' || " + " || ".join(f"substr(x, CAST(2 * ({at}) + {2 * k + 1} AS BIGINT), 2)" for k in reversed(range(n))) + " AS UBIGINT)"


def _fold(start: str, items: str, step: str) -> str:
    """Folds a list of UBIGINT from ``start`` with ``step`` over the names h and i."""
    return f"list_reduce(list_prepend(CAST({start} AS UBIGINT), {items}), lambda h, i: {step})"


def xxh64(seed: int) -> str:
    """XXH64 of the bytes whose hex digits are ``x`` and whose number is ``n``."""
    lanes = [(seed + P1 + P2) % 2**64, (seed + P2) % 2**64, seed, (seed - P1) % 2**64]
    state = [_fold(str(v), "stripes", _round("h", _bytes(f"i + {8 * k}", 8))) for k, v in enumerate(lanes)]
    merged = _bind("[" + ", ".join(state) + "]", "v", "{}")
    total = "+".join(f"{_u(_bind(f'v[{k + 1}]', 'w', _rotl('w', r)))}" for k, r in enumerate((1, 7, 12, 18)))
    mixed = f"CAST(({total}) % {_u(_FULL)} AS UBIGINT)"
    for k in range(4):
        mixed = _add(_mul(f"xor({mixed}, {_round(0, f'v[{k + 1}]')})", P1), P4)
    long = merged.format(mixed)
    begin = _add(f"CASE WHEN n >= 32 THEN {long} ELSE {(seed + P5) % 2**64} END", "n")
    h = _fold(begin, "eights", _bind(f"xor(h, {_round(0, _bytes('i', 8))})", "z", _add(_mul(_rotl("z", 27), P1), P4)))
    h = _fold(h, "fours", _bind(f"xor(h, {_mul(_bytes('i', 4), P1)})", "z", _add(_mul(_rotl("z", 23), P2), P3)))
    h = _fold(h, "ones", _bind(f"xor(h, {_mul(_bytes('i', 1), P5)})", "z", _mul(_rotl("z", 11), P1)))
    h = _bind(h, "a", _mul("xor(a, a >> 33)", P2))
    h = _bind(h, "a", _mul("xor(a, a >> 29)", P3))
    return _bind(h, "a", "xor(a, a >> 32)")


def _places(first: str, end: str, step: int) -> str:
    return f"CAST(range({first}, {end}, {step}) AS UBIGINT[])"


_ODD = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS k, {_ODD} AS w FROM documents),
s AS (SELECT k, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS t FROM d),
u AS MATERIALIZED (SELECT t, hex(encode(t)) AS x, strlen(t) AS n FROM (SELECT DISTINCT t FROM s)),
p AS (SELECT t, x, n, {_places('0', '(n // 32) * 32', 32)} AS stripes, {_places('(n // 32) * 32', '(n // 32) * 32 + (n % 32) // 8 * 8', 8)} AS eights,
  {_places('n // 8 * 8', 'n // 8 * 8 + (n % 8) // 4 * 4', 4)} AS fours, {_places('n // 4 * 4', 'n', 1)} AS ones FROM u),
h AS MATERIALIZED (SELECT t, {xxh64(42)} AS h FROM p),
b AS (SELECT k, {', '.join(f'CASE WHEN 2 * sum((h >> {i}) & 1) > count(*) THEN {_u(1 << i)} ELSE {_u(0)} END AS b{i}' for i in range(64))} FROM s JOIN h USING (t) GROUP BY k),
f AS MATERIALIZED (SELECT doc_id, k, CAST(coalesce({' + '.join(f'b{i}' for i in range(64))}, {_u(0)}) AS UBIGINT) AS fp FROM d LEFT JOIN b USING (k)),
g AS MATERIALIZED (SELECT fp, min(doc_id) AS least FROM f WHERE doc_id IS NOT NULL GROUP BY fp),
l AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM g a JOIN g b ON bit_count(xor(a.fp, b.fp)) <= 3 AND a.fp <> b.fp),
r(fp, c) AS (SELECT fp, least FROM g UNION SELECT l.b, r.c FROM r JOIN l ON r.fp = l.a),
m AS (SELECT fp, min(c) AS component_id FROM r GROUP BY fp)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, CASE WHEN doc_id IS NOT NULL THEN component_id END AS component_id FROM f LEFT JOIN m USING (fp)
"""

OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS MATERIALIZED (SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(id, c) AS (SELECT vec_id, vec_id FROM v WHERE vec_id IS NOT NULL UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1), m AS (SELECT id AS vec_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)
"""

#: Pieces of a text that are cut into strings at once.
_PIECE = 2000
OP5 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS k, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
c AS (SELECT k, p, substr(x, 2 * p + 1, {2 * (_PIECE + 399)}) AS y FROM (SELECT k, x, unnest(range(0, greatest(n - 399, 0), {_PIECE})) AS p FROM d)),
w AS (SELECT k, p + i AS pos, md5(substr(y, 2 * i + 1, 800)) AS s FROM (SELECT k, p, y, unnest(range(0, least({_PIECE}, len(y) // 2 - 399))) AS i FROM c)),
t AS (SELECT k, pos FROM w QUALIFY count(*) OVER (PARTITION BY s) > 1),
g AS (SELECT k, pos, CASE WHEN pos > lag(pos) OVER (PARTITION BY k ORDER BY pos) + 400 THEN 1 ELSE 0 END AS new FROM t),
e AS (SELECT k, min(pos) AS a, max(pos) + 400 AS b FROM (SELECT k, pos, sum(new) OVER (PARTITION BY k ORDER BY pos) AS z FROM g) GROUP BY k, z),
q AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM e),
r AS (SELECT k, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept, sum(b - a) AS gone, count(*) AS spans FROM q JOIN d USING (k) GROUP BY k)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN r USING (k)
"""

OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces),
placed AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded),
spans AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS p, m FROM placed, (VALUES (1), (2), (3), (4)) AS sizes(m) WHERE i + m - 1 <= len(ws)),
f AS MATERIALIZED (SELECT lang, p, m, count(*) AS f FROM spans GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM worded GROUP BY lang),
found AS (SELECT lang, p, m, string_split(p, ' ') AS ws, f AS a FROM f WHERE m >= 2),
ways AS (SELECT lang, p, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM found)),
cuts AS (
  SELECT w.lang, w.p, w.a, k, g.f AS l, h.f AS r, CAST(CAST(2000000 AS HUGEINT) * w.a // (CAST(g.f AS HUGEINT) + h.f) AS BIGINT) AS score
  FROM ways w JOIN f g ON g.lang = w.lang AND g.p = w.x JOIN f h ON h.lang = w.lang AND h.p = w.y),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
starts AS (SELECT *, unnest(range(1, m + 1)) AS i FROM found),
inside AS (
  SELECT lang, array_to_string(ws[i:i + z - 1], ' ') AS p, max(a) AS cover
  FROM starts, (VALUES (2), (3)) AS sizes(z) WHERE z < m AND i + z - 1 <= m GROUP BY ALL),
ranked AS (
  SELECT s.*, s.p AS phrase, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.p) AS rank
  FROM scored s LEFT JOIN inside ON inside.lang = s.lang AND inside.p = s.p
  WHERE cover IS NULL OR CAST(100 AS HUGEINT) * cover < CAST(80 AS HUGEINT) * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

def _edit(e: str, cost: int | str, initial: str) -> str:
    """An edit before what costs and reads ``e``: nine digits of cost, then the audit."""
    return f"printf('%09d', CAST(e{e}[1:9] AS BIGINT) + {cost}) || '{initial}' || e{e}[10:]"


def _own(state: int, keeps: dict[str, int], due: int) -> str:
    """The least (cost, audit) of a row's own edits in a state of the grammar."""
    kept = " ".join(f"WHEN initial = '{r}' THEN {_edit(str(to), 'extra', 'K')}" for r, to in keeps.items())
    stays = f"least({_edit(str(due), '3 + extra', 'R')}, CASE {kept} ELSE 'none' END)"
    return f"least({_edit(str(state), 4, 'D')}, CASE WHEN fault IN ('blank', 'duplicate') THEN 'none' ELSE {stays} END)"


_STEP = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
OP12 = rf"""
WITH RECURSIVE spaced AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
summed AS (
  SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT)),
                            lambda c, b: list_reduce(range(0, 8), lambda x, k: {_STEP}, xor(c, b)), 4294967295), 4294967295) % 20 AS d FROM spaced),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM summed WHERE d <> 0),
numbered AS (
  SELECT *, CASE WHEN role = '' THEN ' ' ELSE role[1:1] END AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN regexp_matches(text, '[^ 	-.!?][ 	-]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
given AS MATERIALIZED (SELECT conv_id, i, initial, role, text, fault, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM faulty),
figures AS MATERIALIZED (
  SELECT conv_id, count(*) AS rows, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
solved AS (
  SELECT conv_id, rows AS i, '000000000' AS e0, '000000006II' AS e1, '000000003I' AS e2, '000000000' AS e3 FROM figures
  UNION ALL
  SELECT conv_id, i, least(b0, printf('%09d', CAST(n2[1:9] AS BIGINT) + 3) || 'I' || n2[10:]), least(b1, printf('%09d', CAST(n2[1:9] AS BIGINT) + 3) || 'I' || n2[10:]), n2, n3 FROM (
    SELECT *, least(b2, printf('%09d', CAST(b3[1:9] AS BIGINT) + 3) || 'I' || b3[10:]) AS n2, least(b3, printf('%09d', CAST(b2[1:9] AS BIGINT) + 3) || 'I' || b2[10:]) AS n3 FROM (
      SELECT s.conv_id, s.i - 1 AS i, {_own(0, {"s": 1, "u": 2}, 2)} AS b0, {_own(1, {"u": 2}, 2)} AS b1, {_own(2, {"a": 3}, 3)} AS b2, {_own(3, {"u": 2}, 2)} AS b3
      FROM solved s JOIN given g ON g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.i = s.i))),
audits AS (SELECT conv_id, CAST(e0[1:9] AS BIGINT) AS cost, e0[10:] AS audit FROM solved WHERE i = 0),
edits AS (SELECT conv_id, generate_subscripts(string_split(audit, ''), 1) AS j, unnest(string_split(audit, '')) AS e FROM audits WHERE audit <> ''),
met AS (SELECT *, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY j) AS i, sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY j) AS p FROM edits),
lines AS (
  SELECT m.conv_id, j, e, p, g.role, CASE WHEN e = 'I' THEN '' ELSE g.text END AS text,
         max(CASE WHEN p = 1 AND e = 'K' AND g.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS headed
  FROM met m LEFT JOIN given g ON g.conv_id IS NOT DISTINCT FROM m.conv_id AND g.i = m.i WHERE e <> 'D'),
repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (p - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS digest FROM lines GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP13 = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda k: CAST(q.v[k] AS HUGEINT) * coalesce(c.v[k], 0))), 0) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
