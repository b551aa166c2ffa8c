"""DuckDB counterparts of the queries that plain SQL can express."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op10_exact_dedup"] = r"""
WITH plain AS (
  SELECT doc_id, coalesce(length(text), 0) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept, text_sha256
FROM plain
WINDOW best AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST)
"""


def _moment(fraction: str, knots: tuple) -> str:
    """SQL for the inverse of a schedule's integral, segment by segment."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    cases, before = [], 0.0
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        y, slope = f"greatest({fraction} * {sum(areas)} - {before}, 0)", (w1 - w0) / (t1 - t0)
        root = f"sqrt(greatest({w0 * w0} + 2 * {slope} * {y}, 0))"
        before += area
        cases.append(f"WHEN {fraction} * {sum(areas)} <= {before} THEN least({t0} + 2 * {y} / ({w0} + {root}), {t1})")
    return f"CASE {' '.join(cases)} ELSE {knots[-1][0]} END"


_SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.6, 0.75), (1.0, 2.125)))
_MOMENTS = " ".join(f"WHEN {k} THEN {_moment('(middle / target)', s)}" for k, s in enumerate(_SCHEDULES))

ORACLE_SQL["op8_curriculum"] = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat_ws(':', 7, doc_id)) AS h
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth
  FROM sized GROUP BY source),
weighed AS (SELECT *, 2.0::DOUBLE * source_size AS ceiling, [5.0::DOUBLE, 2, 1][nth % 3 + 1] AS weight FROM sources),
-- The level per unit of weight if the sources that fill up before are capped; the first that the next one holds.
levels AS (
  SELECT *, row_number() OVER (ORDER BY ceiling / weight, nth) AS place, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(ceiling) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY ceiling / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, nth, least(ceiling, weight * (SELECT arg_min(level, place) FROM levels WHERE level <= ceiling / weight)) AS target
  FROM weighed),
placed AS (
  SELECT doc_id, size, source_size, target, nth,
         sum(size) OVER (PARTITION BY sized.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * ((middle <= target)::INT + (middle + source_size <= target)::INT) AS BIGINT) AS taken,
       round(CASE WHEN middle <= target THEN CASE nth % 3 {_MOMENTS} END END, 6) AS position
FROM placed
"""

ORACLE_SQL["op2_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
-- Each backslash and each control string costs one more character; a turn opens a block or stands after [NEXT].
sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
            + len(regexp_extract_all(text, '</?s>|\[/?INST\]|\[NEXT\]')) AS chars,
         length(role) + length(regexp_replace(role, '[^\\]', '', 'g'))
            + len(regexp_extract_all(role, '</?s>|\[/?INST\]|\[NEXT\]')) + 20 AS heading,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS goes_on
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + CASE WHEN goes_on THEN 6 ELSE heading END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

ORACLE_SQL["op9_line_dedup"] = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts, text FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split),
filled AS (
  SELECT doc_id, pos, trim(line, E' \t\x0b\x0c\r') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place
  FROM lines WHERE trim(line, E' \t\x0b\x0c\r') <> ''),
wins AS (
  SELECT doc_id, place, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c
  FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
later AS (
  SELECT doc_id, place FROM (
    SELECT doc_id, place, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, place) AS nth FROM wins WHERE c IS NOT NULL)
  WHERE nth > 1),
covered AS (SELECT DISTINCT doc_id, place + k AS place FROM later, (VALUES (0), (1), (2)) v(k)),
islands AS (SELECT doc_id, place, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS island FROM covered),
runs AS (
  SELECT i.doc_id, island, min(f.pos) AS start, max(f.pos) + 1 AS stop
  FROM islands i JOIN filled f ON f.doc_id = i.doc_id AND f.place = i.place GROUP BY i.doc_id, island),
left_over AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM lines l
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = l.doc_id AND l.pos >= r.start AND l.pos < r.stop) GROUP BY l.doc_id),
counts AS (SELECT doc_id, count(*) AS n_runs, CAST(sum(stop - start) AS BIGINT) AS lines_removed FROM runs GROUP BY doc_id)
SELECT s.doc_id, coalesce(n_runs, 0) AS n_runs, coalesce(lines_removed, 0) AS lines_removed,
       sha256(coalesce(left_over.text, '')) AS text_sha256
FROM split s LEFT JOIN counts USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""

_BYTES = "list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
_STEP = "list_reduce(list_concat([xor(a, b)], range(8)), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)"
_CRC = f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {_BYTES}), lambda a, b: {_STEP}))"
ORACLE_SQL["op13_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
               sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations WHERE conv_id IS NOT NULL)),
m AS (SELECT conv_id AS c, count(*) AS m FROM t GROUP BY ALL),
convs AS (SELECT c, c - c % 5 AS base, {_CRC} % 9 AS h FROM m),
rebuilt AS (SELECT c, pos, role, text FROM convs JOIN t ON conv_id = base AND pos < h
  UNION ALL SELECT convs.c, pos - h + least(h, coalesce(m.m, 0)), role, text
            FROM convs JOIN t ON conv_id = convs.c AND pos >= h LEFT JOIN m ON m.c = base),
keyed AS (SELECT c, pos + 1 AS depth, strlen(text) AS bytes,
                 string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY c ORDER BY pos) AS key FROM rebuilt),
paths AS (SELECT c, depth, bytes, key, lag(key, 1, '') OVER (PARTITION BY c ORDER BY depth) AS parent FROM keyed
  UNION ALL SELECT c, 0, 0, '', NULL FROM convs),
nodes AS (SELECT depth, key, min(c) AS conv_id, count(*) AS n_convs, min(parent) AS parent, max(bytes) AS bytes FROM paths GROUP BY depth, key),
kids AS (SELECT depth - 1 AS depth, parent AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
every AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, key)),
below AS (SELECT p.depth, p.key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * e.bytes) AS saved
  FROM every e JOIN paths p ON p.c = e.conv_id AND p.depth <= e.depth GROUP BY p.depth, p.key),
final AS (SELECT c, max(depth) AS depth, arg_max(key, depth) AS key FROM paths GROUP BY c),
ends AS (SELECT depth, key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM final GROUP BY depth, key)
SELECT e.conv_id, e.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, e.n_convs, e.n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM every e JOIN below USING (depth, key) LEFT JOIN ends USING (depth, key)
LEFT JOIN every above ON above.depth = e.depth - 1 AND above.key = e.parent"""
