"""SQL for the queries that SQL can express, written for DuckDB; the others are tested by brute force."""

from __future__ import annotations

from turnloom.llm.merkle import FIELDS, WIDTH
from turnloom.llm.mixing import MOST, WEIGHTS

#: Blanks as a character class, and the polynomial of CRC-32.
BLANKS = r"\x20\x09-\x0D"
POLYNOMIAL = 3988292384


def _number(digest: str, place: int) -> str:
    """Eight digits of a hexadecimal digest as a number."""
    return f"CAST('0x' || substr({digest}, {8 * place + 1}, 8) AS BIGINT)"


INFILL = f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+') AS units,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, {_number('h', 0)} % (len(units) + 1) AS a,
         {_number('h', 1)} % (len(units) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR {_number('h', 2)} % 100 >= 50 THEN 'plain'
              WHEN {_number('h', 3)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix,
         array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(units[greatest(a, b) + 1:], '') AS suffix
  FROM drawn),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN text
                      WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
  FROM parts)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form
         WHEN 'plain' THEN output
         WHEN 'psm' THEN regexp_replace(output, '^<P>([^\\x00]*)<S>([^\\x00]*)<M>([^\\x00]*)$', '\\1\\3\\2')
         ELSE regexp_replace(output, '^<S>([^\\x00]*)<P>([^\\x00]*)<M>([^\\x00]*)$', '\\2\\3\\1') END) AS restored_sha256
FROM made
"""

# Sources that reach their limit come first in the order of limit by weight, so each can be
# judged by what those before it leave to the weights that remain.
COMMON = 1
for _weight in WEIGHTS:
    COMMON *= _weight
MIX = f"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^{BLANKS}]+')) AS BIGINT) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) || md5(coalesce(text, '')) AS place
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT *, [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight,
         sum(source_size) OVER () AS total
  FROM sizes),
filled AS (
  SELECT *, coalesce(sum({MOST} * source_size) OVER (ORDER BY {MOST} * source_size * ({COMMON} // weight), source
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (ORDER BY {MOST} * source_size * ({COMMON} // weight), source
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining
  FROM weighed),
judged AS (SELECT *, weight * (total - used) >= {MOST} * source_size * remaining AS is_full FROM filled),
level AS (SELECT min(used) AS used, max(remaining) AS remaining, any_value(total) AS total FROM judged WHERE NOT is_full),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST({MOST} * source_size AS DOUBLE)
    ELSE weight * (CAST(level.total - level.used AS DOUBLE) / CAST(level.remaining AS DOUBLE)) END AS target
  FROM judged, level),
budgets AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS times FROM targets),
placed AS (
  SELECT rows.*, source_size, target, times, target - times * source_size AS budget,
         coalesce(sum(size) OVER (PARTITION BY rows.source ORDER BY place
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows JOIN budgets ON rows.source IS NOT DISTINCT FROM budgets.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (times + CASE WHEN 2 * before + size <= 2 * budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""

_field = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field.format(text if name == "text" else name) for name in FIELDS) + ")"


def _levels(name: str, source: str) -> str:
    """A tree's nodes as one list for each level."""
    return f"""
{name} AS (
  {source}
  UNION ALL
  SELECT tree, level + 1, list_transform(range(0, len(nodes), {WIDTH}),
    lambda k: sha256(array_to_string(nodes[k + 1:k + {WIDTH}], '')))
  FROM {name} WHERE len(nodes) > 1)"""


def _run(at: str, low: str, high: str) -> str:
    return f"array_to_string(nodes[({at}) - ({at}) % {WIDTH} + {low}:({at}) - ({at}) % {WIDTH} + {high}], '')"


MERKLE = f"""
WITH RECURSIVE digits AS (
  SELECT doc_id, list_transform(range(0, 8 * length(CAST(doc_id AS VARCHAR))),
    lambda k: CASE WHEN k % 8 = 0 THEN ascii(CAST(doc_id AS VARCHAR)[k // 8 + 1]) ELSE 0 END) AS steps
  FROM documents),
sums AS (
  SELECT DISTINCT doc_id, xor(list_reduce(list_transform(steps, lambda s: CAST(s AS BIGINT)),
    lambda c, s: xor(xor(c, s) >> 1, {POLYNOMIAL} * (xor(c, s) & 1)), CAST(4294967295 AS BIGINT)), 4294967295) AS crc
  FROM digits),
leaves AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
         CASE WHEN crc % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS changed
  FROM documents LEFT JOIN sums USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
{_levels('inner_nodes', '''SELECT source AS tree, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY source''').strip()},
subroots AS (
  SELECT tree AS source, nodes[1] AS subroot, max_level,
         row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS top_pos
  FROM (SELECT *, max(level) OVER (PARTITION BY tree) AS max_level FROM inner_nodes)
  WHERE level = max_level),
{_levels('top_nodes', '''SELECT 0 AS tree, 0 AS level, list(subroot ORDER BY top_pos) AS nodes FROM subroots''').strip()},
steps AS (
  SELECT placed.source, pos, level AS step, nodes, pos // CAST(pow({WIDTH}, level) AS BIGINT) AS place
  FROM placed JOIN inner_nodes ON placed.source IS NOT DISTINCT FROM tree WHERE len(nodes) > 1
  UNION ALL
  SELECT placed.source, pos, max_level + level, nodes, top_pos // CAST(pow({WIDTH}, level) AS BIGINT)
  FROM placed JOIN subroots ON placed.source IS NOT DISTINCT FROM subroots.source, top_nodes WHERE len(nodes) > 1),
beside AS (
  SELECT source, pos, step, {_run('place', '1', f'place % {WIDTH}')} AS l,
         array_to_string(nodes[place + 2:place - place % {WIDTH} + {WIDTH}], '') AS r
  FROM steps),
ways AS (
  SELECT source, pos, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256,
         list(struct_pack(l := l, r := r) ORDER BY step) AS way
  FROM beside GROUP BY source, pos),
proven AS (
  SELECT placed.*, coalesce(proof_sha256, sha256('')) AS proof_sha256, coalesce(way, []) AS way
  FROM placed LEFT JOIN ways ON placed.source IS NOT DISTINCT FROM ways.source AND placed.pos = ways.pos),
climbed AS (
  SELECT doc_id, source, pos, leaf, proof_sha256, way, 1 AS step, coalesce(changed, leaf) AS node FROM proven
  UNION ALL
  SELECT doc_id, source, pos, leaf, proof_sha256, way, step + 1, sha256(way[step].l || node || way[step].r)
  FROM climbed WHERE step <= len(way))
SELECT doc_id, leaf, subroot, root, proof_sha256, node AS folded_root, node = root AS verified
FROM climbed JOIN subroots ON climbed.source IS NOT DISTINCT FROM subroots.source,
     (SELECT nodes[1] AS root FROM top_nodes WHERE len(nodes) = 1)
WHERE step = len(way) + 1
"""

ORACLES: dict[str, str] = {
    "op11_sorted_infill": INFILL,
    "op12_hash_threshold_mix": MIX,
    "op13_merkle_manifest": MERKLE,
}
