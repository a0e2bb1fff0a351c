"""The SQL that gives the same result for each query, written for DuckDB."""

from __future__ import annotations

from turnloom.operators.judge import CONSTRAINT_PROMPT, HELPFULNESS_PROMPT
from turnloom.operators.packing import BLOCK
from turnloom.plans.queries import BUDGET, EPOCHS, ESCAPES, LONGEST, MAX_TURNS, PACK, PATTERNS, SAMPLES, argument


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(column: str) -> str:
    return f"len(string_split({column}, ' '))"


def pieces(column: str) -> str:
    return (
        f"regexp_extract_all({column}, "
        r"'<\|im_start\|>|<\|im_end\|>|\s|[^\s<]+|<')"
    )


def joined(pieces_sql: str, by: str) -> str:
    return f"array_to_string({pieces_sql}, '{by}')"


def turn_text(role: str = "role", text: str = "text") -> str:
    return f"'<|im_start|>' || {role} || chr(10) || {text} || '<|im_end|>' || chr(10)"


HEADER = "'<|im_start|>assistant' || chr(10)"
TERMINATOR = "'<|im_end|>' || chr(10)"

MEASURES = f"""
measured AS (
  SELECT conv_id, turn, role, text,
         sum({words('text')}) OVER (PARTITION BY conv_id ORDER BY turn
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS words_before
  FROM conversations),
convs AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages,
         CAST(coalesce(max(words_before), 0) AS BIGINT) AS n_words_before_last,
         bool_and(role = CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END) AS roles_ok
  FROM measured GROUP BY conv_id)
"""
PASSED = f"n_messages <= {2 * MAX_TURNS} AND n_words_before_last < {BUDGET} AND roles_ok"
KEPT = f"""{MEASURES},
kept AS (
  SELECT c.* FROM conversations c JOIN convs USING (conv_id) WHERE {PASSED})
"""

# Words of messages that are not text are not counted.
UNTYPED = f"""
untyped AS (
  SELECT *, (conv_id * 5 + turn) % 23 AS kind FROM conversations),
uconvs AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages, bool_and(kind > 2) AS content_ok
  FROM untyped GROUP BY conv_id)
"""

USERS = """
users AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k
  FROM conversations WHERE role = 'user')
"""
SPOKEN = """
spoken AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k
  FROM conversations WHERE role = 'assistant')
"""


def mask_query(segment: str, lead: int, learn: str) -> str:
    """Tokens and mask of one segment per turn."""
    return f"""
WITH seg AS (SELECT conv_id, turn, {pieces(segment)} AS p, {learn} AS learn FROM conversations),
sized AS (SELECT *, len(p) AS n FROM seg)
SELECT conv_id, turn, {joined('p', '|')} AS tokens,
  CASE WHEN learn THEN repeat('0', {lead}) || repeat('1', n - {lead}) ELSE repeat('0', n) END
    AS loss_mask,
  CAST(CASE WHEN learn THEN n - {lead} ELSE 0 END AS BIGINT) AS response_length
FROM sized
"""


SIMPLE_SEGMENT = f"""CASE role
  WHEN 'system' THEN {turn_text()}
  WHEN 'user' THEN {turn_text()} || {HEADER}
  ELSE text || {TERMINATOR} END"""

OVERRIDE = "role = 'assistant' AND (conv_id + turn) % 4 <> 0"

DRAWN = f"""
{SPOKEN},
outs AS (
  SELECT conv_id AS sample_id, k,
    CASE (conv_id * 3 + k * 5) % 13 WHEN 0 THEN 'length' WHEN 1 THEN 'abort'
      WHEN 2 THEN 'other' ELSE 'stop' END AS finish,
    text || CASE (conv_id * 3 + k * 5) % 13 WHEN 0 THEN '' ELSE {TERMINATOR} END AS text,
    conv_id % 2 = 0 AND NOT (conv_id % 6 = 0 AND k = 1) AS known
  FROM spoken),
{USERS},
turns AS (
  SELECT conv_id AS sample_id, count(*) AS n, max(CASE WHEN k = 0 THEN text END) AS head
  FROM users GROUP BY conv_id),
cuts AS (
  SELECT sample_id, min(k) AS cut FROM outs WHERE finish IN ('length', 'abort') GROUP BY 1),
lim AS (
  SELECT t.sample_id, n, head, least(n - 1, coalesce(cut, n - 1)) AS last_ix
  FROM turns t LEFT JOIN cuts USING (sample_id)),
steps AS (
  SELECT o.*, l.last_ix,
    CASE WHEN o.k < l.last_ix THEN {turn_text("'user'", 'u.text')} END AS follow
  FROM outs o JOIN lim l USING (sample_id)
  LEFT JOIN users u ON u.conv_id = o.sample_id AND u.k = o.k + 1
  WHERE o.k <= l.last_ix)
"""

TRAJECTORY = f"""
WITH {DRAWN},
sized AS (
  SELECT *, text || coalesce(follow || {HEADER}, '') AS said,
    len({pieces('text')}) AS n_out,
    len({pieces(f"coalesce(follow || {HEADER}, '')")}) AS n_follow
  FROM steps),
gathered AS (
  SELECT sample_id, string_agg(said, '' ORDER BY k) AS response,
    string_agg({joined(pieces('said'), '|')}, '|' ORDER BY k) AS tokens,
    string_agg(repeat('1', n_out) || repeat('0', n_follow), '' ORDER BY k) AS mask,
    bool_or(known) AS any_known, bool_and(known) AS all_known,
    sum(CASE WHEN known THEN n_out ELSE 0 END) * -0.5 AS logprobs,
    max(CASE WHEN k = last_ix THEN finish END) AS finish
  FROM sized GROUP BY sample_id),
base AS (
  SELECT l.sample_id, {turn_text("'user'", 'head')} || {HEADER} AS prompt,
    coalesce(response, '') AS response, tokens, coalesce(mask, '') AS mask,
    any_known, all_known, logprobs, finish, coalesce(finish, '') <> 'abort' AS run
  FROM lim l LEFT JOIN gathered g USING (sample_id))
SELECT sample_id,
  CASE WHEN run THEN prompt END AS prompt,
  CASE WHEN run THEN response END AS response,
  CASE WHEN run THEN {joined(pieces('prompt'), '|')} || coalesce('|' || tokens, '') END AS tokens,
  CASE WHEN run THEN mask END AS loss_mask,
  CASE WHEN run THEN CAST(length(mask) AS BIGINT) END AS response_length,
  CASE WHEN run AND any_known THEN CAST(logprobs AS DOUBLE) END AS logprob_sum,
  NOT coalesce(any_known, false) OR all_known AS logprobs_match,
  CASE finish WHEN 'length' THEN 'TRUNCATED' WHEN 'abort' THEN 'ABORTED'
    WHEN 'stop' THEN 'COMPLETED' END AS status,
  CASE WHEN run THEN CAST(length(prompt || response) AS BIGINT) END AS payload_chars,
  CASE WHEN run THEN contains(prompt || response, '<|im_start|>system') END AS payload_has_system,
  CASE WHEN run THEN contains(prompt || response, '# Tools') END AS payload_has_tools
FROM base
"""


def constraint_values() -> str:
    return """
pool(id, con, vtype) AS (VALUES
  ('0', 'Use at least 40 words.', 'hard'), ('1', 'Use the word {placeholder}.', 'hard'),
  ('2', 'Use 5 to 120 words.', 'hard'), ('3', 'Be kind.', 'soft'))
"""


def checks(turns: str) -> str:
    """Two checks per ranked turn, none where the key says so."""
    return f"""
checks AS (
  SELECT conv_id AS sample_id, k AS turn_ix, CAST(v AS BIGINT) AS ver_ix,
    CAST((conv_id + k + v) % 4 AS VARCHAR) AS id,
    CASE WHEN conv_id % 2 = 0 THEN 'the' ELSE 'que' END AS word
  FROM {turns}, (VALUES (0), (1)) AS w(v)
  WHERE (conv_id + k) % 7 <> 6)
"""


def rule_case(response: str, word: str = "word") -> str:
    return f"""CASE id
  WHEN '0' THEN {words(response)} >= 40
  WHEN '1' THEN contains({response}, {word})
  WHEN '2' THEN {words(response)} BETWEEN 5 AND 120
  ELSE verdict END"""


VERDICT = """CASE WHEN (sample_id + turn_ix) % 11 = 0 THEN true
  WHEN (sample_id * 7 + turn_ix * 3) % 5 IN (0, 2) THEN false ELSE true END"""

TRIMMED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"

SCORED = f"""
{SPOKEN},
{checks('spoken')},
said AS (SELECT conv_id AS sample_id, k AS turn_ix, {TRIMMED} AS response FROM spoken),
judged AS (
  SELECT c.*, s.response, {VERDICT} AS verdict
  FROM checks c JOIN said s USING (sample_id, turn_ix)),
scored AS (SELECT *, {rule_case('response')} AS ok FROM judged)
"""

SELECTED = """CAST('0x' || substr(md5(concat_ws(':', sample_id, turn_ix, ver_ix, 3)), 1, 8) AS BIGINT)
  / 4294967296.0 < 0.5"""


def prompt_sql(text: str) -> str:
    head, rest = text.split("{constraint}")
    middle, end = rest.split("{response}")
    return f"{quoted(head)} || con || {quoted(middle)} || response || {quoted(end)}"


VOCAB = f"""
toks AS (
  SELECT conv_id, turn, {pieces(turn_text())} AS p FROM conversations),
flat AS (
  SELECT conv_id, turn, unnest(p) AS token, generate_subscripts(p, 1) AS i FROM toks),
vocab AS (
  SELECT token, row_number() OVER (ORDER BY md5(concat_ws(':', token, '0')), token) + 1 AS id
  FROM (SELECT DISTINCT token FROM flat WHERE token NOT IN ('<|im_start|>', '<|im_end|>'))
  UNION ALL VALUES ('<|im_start|>', 0), ('<|im_end|>', 1))
"""

def _escaped() -> str:
    found = "text"
    for mark, written in ESCAPES.items():
        found = f"replace({found}, chr({ord(mark)}), {quoted(written)})"
    return found


DRESSED = f"""CASE doc_id % 8 WHEN 0 THEN text WHEN 1 THEN '<<A title>>' || chr(10) || chr(10) || text
    WHEN 2 THEN upper(replace(text, 'ß', 'ss')) WHEN 3 THEN lower(text)
    WHEN 4 THEN '* one' || chr(10) || '  - two' || chr(10) || text
    WHEN 5 THEN '{{"text": "' || {_escaped()} || '"}}'
    WHEN 6 THEN text || chr(10) || ' ' || chr(10) || 'Write to [name] at [place].'
    ELSE replace(text, ',', '') END"""


def catalogue_sql() -> str:
    """One row per kind; measures are compared in three ways."""

    def filled(pattern: str) -> str:
        return f"len(list_filter(regexp_split_to_array(t, '{pattern}'), lambda x: trim(x) <> ''))"

    measures = {
        "words": filled("[ \\t\\n\\r]+"),
        "chars": "length(t)",
        "sentences": "len(regexp_extract_all(t, '[^.!?]+[.!?]'))",
        "paragraphs": filled("\\n\\s*\\n"),
        "lines": filled("\\n"),
        "bullets": "len(regexp_extract_all(t, '(?m)^\\s*[*-] '))",
        "placeholders": "len(regexp_extract_all(t, '\\[[^\\]\\n]+\\]'))",
        "capital_words": "len(list_filter(regexp_split_to_array(t, '[^\\p{L}]+'), lambda w: length(w) > 1 AND w = upper(w)))",
    }
    word, _, least = argument("keyword_count").partition(":")
    tests = {
        f"{how}_{name}": f"{measure} {sign} {argument(how + '_' + name)}"
        for name, measure in measures.items()
        for how, sign in (("min", ">="), ("max", "<="), ("n", "="))
    } | {
        "contains": f"contains(lower(t), lower('{argument('contains')}'))",
        "forbids": f"NOT contains(lower(t), lower('{argument('forbids')}'))",
        "contains_all": " AND ".join(f"contains(lower(t), lower('{w}'))" for w in argument("contains_all").split(",")),
        "starts_with": f"starts_with(lower(trim(t)), lower('{argument('starts_with')}'))",
        "ends_with": f"ends_with(lower(trim(t)), lower('{argument('ends_with')}'))",
        "all_lower": "t = lower(t)",
        "all_upper": "t = upper(t)",
        "no_comma": "NOT contains(t, ',')",
        "title": "regexp_matches(t, '<<[^\\n]+>>')",
        "valid_json": "json_valid(t)",
        "keyword_count": f"(length(lower(t)) - length(replace(lower(t), '{word}', ''))) / {len(word)} >= {least}",
    }
    parts = [
        f"SELECT count(*) AS n_rows, '{kind}' AS kind, count(*) FILTER (WHERE {test}) AS n_passed FROM d"
        for kind, test in tests.items()
    ]
    return f"WITH d AS MATERIALIZED (SELECT {DRESSED} AS t FROM documents) " + " UNION ALL ".join(parts)


ORACLES = {
    "filter_turn_limit": f"WITH {MEASURES} SELECT conv_id, n_messages FROM convs "
    f"WHERE n_messages <= {2 * MAX_TURNS}",
    "filter_word_budget": f"WITH {MEASURES} SELECT conv_id, n_words_before_last FROM convs "
    f"WHERE n_words_before_last < {BUDGET}",
    "filter_role_alternation": f"WITH {MEASURES} SELECT conv_id FROM convs WHERE roles_ok",
    "filter_content_type": f"WITH {UNTYPED} SELECT conv_id, n_messages FROM uconvs "
    "WHERE content_ok",
    "sft_filter": f"""
WITH {KEPT}
SELECT conv_id, n_messages, n_words_before_last,
  string_agg(role || ':' || text, '|' ORDER BY turn) AS messages
FROM kept JOIN convs USING (conv_id) GROUP BY ALL""",
    "sft_filter_untyped": f"""
WITH {KEPT}, {UNTYPED}
SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS texts
FROM kept JOIN uconvs USING (conv_id) WHERE content_ok GROUP BY conv_id""",
    "sft_filter_counts": f"""
WITH {MEASURES}
SELECT CAST(count(*) AS BIGINT) AS loaded,
  CAST(count(*) FILTER (WHERE {PASSED}) AS BIGINT) AS kept FROM convs""",
    "word_count": f"SELECT doc_id, CAST({words('text')} AS BIGINT) AS n_words FROM documents",
    "running_words": f"WITH {MEASURES} SELECT conv_id, turn, "
    "CAST(coalesce(words_before, 0) AS BIGINT) AS words_before FROM measured",
    "prompt_heads": """
SELECT conv_id, min_by(text, turn) AS prompt, '0' AS label, count(*) AS n_turns,
  count(*) - 1 AS n_follow_ups
FROM conversations WHERE role = 'user' GROUP BY conv_id""",
    "prompt_records": f"""
WITH {USERS}
SELECT conv_id, min_by(text, k) AS prompt, '0' AS label, CAST(conv_id AS VARCHAR) AS id,
  'persona ' || conv_id % 7 AS persona,
  string_agg(CAST((conv_id + k) % 4 AS VARCHAR), ',' ORDER BY k) AS verifier_ids,
  min_by(text, k) AS first_text,
  coalesce(string_agg(text, '|' ORDER BY k) FILTER (WHERE k > 0), '') AS rest_text,
  count(*) AS n_turns
FROM users GROUP BY conv_id""",
    "split_roundtrip": f"""
WITH {USERS}
SELECT CAST(conv_id AS VARCHAR) AS id, min_by(text, k) AS prompt, '0' AS label,
  count(*) AS n_turns
FROM users WHERE conv_id % 5 <> 0 GROUP BY conv_id""",
    "jsonl_roundtrip": f"""
WITH {KEPT}
SELECT conv_id AS id, string_agg({turn_text()}, '' ORDER BY turn) AS rendered,
  CAST(NULL AS VARCHAR) AS note
FROM kept GROUP BY conv_id""",
    "shuffle_batches": """
WITH ids AS (SELECT conv_id, count(*) AS n_messages FROM conversations GROUP BY conv_id),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', conv_id, 7)), conv_id) - 1 AS ix
  FROM ids)
SELECT conv_id, n_messages, ix, ix // 16 AS batch_id FROM numbered""",
    "chat_render": f"SELECT conv_id, turn, {turn_text()} AS rendered FROM conversations",
    "chat_render_generation": f"""
SELECT conv_id, CASE WHEN min_by(role, turn) = 'system' THEN '' ELSE
  {turn_text("'system'", "'You help.'")} END || string_agg({turn_text()}, '' ORDER BY turn) || {HEADER} AS rendered
FROM conversations GROUP BY conv_id""",
    "payload_flags": f"""
SELECT conv_id, bool_or(contains({turn_text()}, '<|im_start|>system')) AS payload_has_system,
  bool_or(contains({turn_text()}, '# Tools')) AS payload_has_tools
FROM conversations GROUP BY conv_id""",
    "assistant_spans": f"SELECT conv_id, turn, {TRIMMED} AS response FROM conversations "
    "WHERE role = 'assistant'",
    "record_spans": f"""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_ix,
  {TRIMMED} AS response
FROM conversations WHERE role = 'assistant'""",
    "tag_extract": f"""
WITH w AS (
  SELECT conv_id, turn, text, (conv_id + turn) % 4 AS kind, {TRIMMED} AS inner_text,
    text || '<answer></answer>' AS empty_tag
  FROM conversations)
SELECT conv_id, turn,
  CASE kind WHEN 0 THEN inner_text WHEN 2 THEN 'YES' ELSE '' END AS strict,
  CASE kind WHEN 0 THEN inner_text WHEN 1 THEN empty_tag WHEN 2 THEN 'YES' ELSE text END AS lenient,
  CASE kind WHEN 0 THEN lower(inner_text) = 'yes' WHEN 2 THEN true ELSE false END AS judge_passes
FROM w""",
    "tag_pair": rf"""
SELECT conv_id, turn,
  regexp_extract('[[ ' || text || ' ]] [[later]]', '\[\[\s*(.*?)\s*\]\]', 1, 'si') AS content,
  (conv_id + turn) % 3 = 0 AS rule_passes
FROM conversations""",
    "tokenize": f"""
WITH t AS (SELECT conv_id, turn, {pieces(turn_text())} AS p FROM conversations)
SELECT conv_id, turn, CAST(len(p) AS BIGINT) AS n_tokens, {joined('p', '|')} AS tokens FROM t""",
    "token_ids": f"""
WITH {VOCAB}
SELECT conv_id, turn, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY i) AS ids
FROM flat JOIN vocab USING (token) GROUP BY conv_id, turn""",
    "detokenize": f"SELECT conv_id, turn, {turn_text()} AS rendered FROM conversations",
    "sublist_search": """
WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS p FROM conversations),
f AS (SELECT conv_id, turn, p, unnest(p) AS token, generate_subscripts(p, 1) AS i FROM w)
SELECT conv_id, turn,
  string_agg(CAST(i - 1 AS VARCHAR), ',' ORDER BY i) FILTER (WHERE token = p[1]) AS positions
FROM f GROUP BY conv_id, turn""",
    "loss_mask_simple": mask_query(SIMPLE_SEGMENT, 0, "role = 'assistant'"),
    "loss_mask_qwen": mask_query(
        f"CASE WHEN turn = 0 AND role <> 'system' THEN {turn_text(quoted('system'), quoted('You help.'))}"
        f" ELSE '' END || {turn_text()}",
        3,
        OVERRIDE,
    ),
    "loss_mask_qwen3": mask_query(turn_text(), 3, OVERRIDE),
    "loss_mask_distill": f"""
WITH ends AS (
  SELECT conv_id, min_by(role, turn) AS r0, min_by(text, turn) AS t0, max_by(text, turn) AS t1
  FROM conversations GROUP BY conv_id),
p AS (
  SELECT conv_id, {pieces(turn_text('r0', 't0') + ' || ' + HEADER)} AS a, {pieces('t1')} AS b
  FROM ends)
SELECT conv_id, {joined('list_concat(a, b)', '|')} AS tokens,
  repeat('0', len(a)) || repeat('1', len(b)) AS loss_mask
FROM p""",
    "mask_lengths": f"""
WITH seg AS (
  SELECT conv_id, turn, role, len({pieces(SIMPLE_SEGMENT)}) AS n FROM conversations),
f AS (SELECT conv_id, min(turn) AS first_turn FROM seg WHERE role = 'assistant' GROUP BY conv_id)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_tokens,
  CAST(coalesce(sum(n) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS n_ones,
  CAST(coalesce(sum(n) FILTER (WHERE turn >= first_turn), 0) AS BIGINT) AS response_length
FROM seg LEFT JOIN f USING (conv_id) GROUP BY conv_id""",
    "sft_samples": f"""
WITH {KEPT},
seg AS (
  SELECT conv_id, turn, {pieces(SIMPLE_SEGMENT)} AS p,
    CASE WHEN role = 'assistant' THEN '1' ELSE '0' END AS bit
  FROM kept),
whole AS (
  SELECT conv_id, string_agg({joined('p', '|')}, '|' ORDER BY turn) AS tokens,
    string_agg(repeat(bit, len(p)), '' ORDER BY turn) AS mask
  FROM seg GROUP BY conv_id)
SELECT conv_id, tokens, regexp_replace(mask, '^0+', '') AS loss_mask,
  CAST(length(regexp_replace(mask, '^0+', '')) AS BIGINT) AS response_length,
  CAST(0 AS DOUBLE) AS reward
FROM whole""",
    "mask_text_spans": f"""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS span_ix,
  text || {TERMINATOR} AS span
FROM conversations WHERE role = 'assistant'""",
    "token_view": f"""
WITH
seg AS (
  SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS mask,
    {pieces(SIMPLE_SEGMENT)} AS p
  FROM conversations),
flat AS (
  SELECT conv_id, turn, mask, unnest(p) AS token, generate_subscripts(p, 1) AS i FROM seg)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS ix, token,
  CAST(mask AS BIGINT) AS mask
FROM flat""",
    "multimodal_align": f"""
WITH
flat AS (
  SELECT conv_id, turn, role,
    CASE WHEN turn % 2 = 0 THEN text || ' tail ' ELSE text END AS text
  FROM conversations),
seg AS (SELECT conv_id, turn, role, {SIMPLE_SEGMENT} AS s FROM flat)
SELECT conv_id, string_agg(s, '' ORDER BY turn) AS text,
  repeat('0', conv_id % 5) || string_agg(
    repeat(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, len({pieces('s')})),
    '' ORDER BY turn) AS loss_mask,
  string_agg(CASE WHEN turn % 2 = 1 AND turn % 3 = 0 THEN '0' ELSE '1' END, '' ORDER BY turn) AS learned
FROM seg GROUP BY conv_id""",
    "trajectory": TRAJECTORY,
    "constraint_index": """
SELECT CAST(doc_id % 97 AS VARCHAR) AS id, max_by(text, doc_id) AS constraint,
  max_by(CASE WHEN doc_id % 3 = 0 THEN 'soft' ELSE 'hard' END, doc_id) AS verifier_type,
  max_by(n_chars > 500, doc_id) AS content_template
FROM documents GROUP BY 1""",
    "constraint_lookup": f"""
WITH {SPOKEN}, {checks('spoken')}, {constraint_values()}
SELECT sample_id, turn_ix, ver_ix, id, con AS constraint, vtype AS verifier_type,
  CASE WHEN id = '1' THEN word END AS argument
FROM checks JOIN pool USING (id)""",
    "unknown_constraints": f"""
WITH {SPOKEN}, {checks('spoken')}
SELECT id, count(*) AS n_checks FROM checks WHERE id NOT IN ('0', '3') GROUP BY id""",
    "rule_results": f"WITH {SCORED} SELECT sample_id, turn_ix, ver_ix, id, ok FROM scored",
    "turn_pass": f"""
WITH {SCORED}
SELECT s.sample_id, s.turn_ix, coalesce(bool_and(ok), true) AS passed
FROM said s LEFT JOIN scored c USING (sample_id, turn_ix) GROUP BY 1, 2""",
    "turn_reward": f"""
WITH {SCORED}, ids AS (SELECT DISTINCT conv_id AS sample_id FROM conversations)
SELECT i.sample_id, CASE WHEN coalesce(bool_and(ok), true) THEN 1.0::DOUBLE ELSE 0.0 END AS reward
FROM ids i LEFT JOIN scored c USING (sample_id) GROUP BY 1""",
    "judge_requests": f"""
WITH {SCORED}, {constraint_values()}
SELECT sample_id, turn_ix, ver_ix, id AS constraint_id,
  CASE vtype WHEN 'hard' THEN 'helpfulness' ELSE 'constraint' END AS kind,
  CASE vtype WHEN 'hard' THEN {prompt_sql(HELPFULNESS_PROMPT)}
    ELSE {prompt_sql(CONSTRAINT_PROMPT)} END AS prompt
FROM scored JOIN pool USING (id)
WHERE vtype = 'soft' OR {SELECTED}""",
    "judge_verdicts": f"""
WITH {SCORED} SELECT sample_id, turn_ix, id, verdict, ok FROM scored WHERE id = '3'""",
    "helpfulness_veto": f"""
WITH {SCORED}, ids AS (SELECT DISTINCT conv_id AS sample_id FROM conversations),
vetoed AS (
  SELECT sample_id, ok AND NOT (id = '0' AND {SELECTED} AND NOT verdict) AS ok FROM scored)
SELECT i.sample_id, CASE WHEN coalesce(bool_and(ok), true) THEN 1.0::DOUBLE ELSE 0.0 END AS reward
FROM ids i LEFT JOIN vetoed c USING (sample_id) GROUP BY 1""",
    "conversation_reward": rf"""
WITH {DRAWN}, {checks('users')},
spans AS (
  SELECT sample_id, k, unnest(regexp_extract_all(
    {HEADER} || text || coalesce(follow, ''),
    '<\|im_start\|>assistant\n\s*(.*?)\s*<\|im_end\|>', 1, 's')) AS response
  FROM steps s
  WHERE NOT EXISTS (SELECT 1 FROM steps a WHERE a.sample_id = s.sample_id
    AND a.k = a.last_ix AND a.finish = 'abort')),
found AS (
  SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY k) - 1 AS turn_ix, response
  FROM spans),
counts AS (SELECT sample_id, count(*) AS n_spans FROM found GROUP BY 1),
judged AS (
  SELECT c.*, f.response, {VERDICT} AS verdict
  FROM checks c JOIN found f USING (sample_id, turn_ix)),
scored AS (SELECT sample_id, {rule_case('response')} AS ok FROM judged),
rolled AS (SELECT sample_id, bool_and(ok) AS ok FROM scored GROUP BY 1)
SELECT l.sample_id, CASE WHEN coalesce(n_spans, 0) = n AND coalesce(ok, true)
  THEN 1.0::DOUBLE ELSE 0.0 END AS reward
FROM lim l LEFT JOIN counts USING (sample_id) LEFT JOIN rolled USING (sample_id)""",
    "record_reward": f"""
WITH {KEPT},
ranked AS (
  SELECT conv_id AS sample_id, {TRIMMED} AS response,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k
  FROM kept WHERE role = 'assistant'),
judged AS (
  SELECT sample_id, response, CAST((sample_id + k) % 4 AS VARCHAR) AS id, true AS verdict
  FROM ranked),
scored AS (SELECT sample_id, {rule_case('response', "'the'")} AS ok FROM judged),
ids AS (SELECT DISTINCT conv_id AS sample_id FROM kept)
SELECT i.sample_id, CASE WHEN coalesce(bool_and(ok), true) THEN 1.0::DOUBLE ELSE 0.0 END AS reward
FROM ids i LEFT JOIN scored USING (sample_id) GROUP BY 1""",
    "registered_verifier": rf"""
WITH {SPOKEN}
SELECT conv_id, turn, regexp_matches(text, '[.!?]\s*$')
  AND (k % 2 <> 0 OR (conv_id % 9 <> 0 AND {words('text')} >= 40)) AS ok
FROM spoken""",
}

ORACLES |= {
    "untyped_jsonl": ORACLES["sft_filter_untyped"],
    "balanced_packing": f"""
SELECT count(DISTINCT conv_id) AS n_samples, CAST(sum({words("text")}) AS BIGINT) AS n_tokens, true AS budget_kept,
  true AS ranks_level, true AS pack_in_one_rank, true AS no_more_packs
FROM conversations""",
    "mask_span_rows": f"""
WITH marked AS (
  SELECT *, role = 'assistant' AS learned,
    coalesce(lag(role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn), false) AS goes_on
  FROM conversations),
numbered AS (
  SELECT *, sum(CASE WHEN learned AND NOT goes_on THEN 1 ELSE 0 END) OVER (
    PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS span_ix
  FROM marked)
SELECT conv_id, CAST(span_ix AS BIGINT) AS span_ix, string_agg(text || {TERMINATOR}, '' ORDER BY turn) AS span
FROM numbered WHERE learned GROUP BY conv_id, span_ix""",
    "trajectory_turns": f"""
WITH {DRAWN},
ended AS (
  SELECT l.sample_id, head, coalesce(finish, '') AS finish
  FROM lim l LEFT JOIN steps s ON s.sample_id = l.sample_id AND s.k = s.last_ix),
laid AS (
  SELECT sample_id, 0 AS place, 0 AS learned, {turn_text("'user'", 'head')} || {HEADER} AS text, NULL AS known FROM ended
  UNION ALL SELECT sample_id, 2 * k + 1, 1, text, CASE WHEN known THEN true END FROM steps
  UNION ALL SELECT sample_id, 2 * k + 2, 0, follow || {HEADER}, CASE WHEN known THEN true END FROM steps WHERE follow IS NOT NULL),
split AS (SELECT laid.*, {pieces('text')} AS p FROM laid JOIN ended USING (sample_id) WHERE finish <> 'abort')
SELECT sample_id, CAST(place AS BIGINT) AS place, CAST(learned AS BIGINT) AS learned, text, {joined('p', '|')} AS tokens,
  CAST(coalesce(sum(len(p)) OVER (PARTITION BY sample_id ORDER BY place
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS token_offset,
  CAST(CASE WHEN known THEN len(p) ELSE -1 END AS BIGINT) AS n_logprobs
FROM split""",
    "trajectory_totals": f"""
WITH built AS ({TRAJECTORY})
SELECT sample_id, CASE WHEN prompt IS NOT NULL THEN CAST(len({pieces('prompt')}) AS BIGINT) END AS prompt_length,
  response_length, CASE WHEN status = 'ABORTED' THEN true ELSE logprobs_match END AS logprobs_match, status
FROM built""",
    "array_reward": f"""
SELECT sample_id, CASE WHEN sample_id % 10 = 3 AND EXISTS (
    SELECT 1 FROM conversations c WHERE c.conv_id = r.sample_id AND c.role = 'assistant')
  THEN 0.0::DOUBLE ELSE reward END AS reward
FROM ({ORACLES["turn_reward"]}) r""",
    "pass_rate": f"""
WITH checks AS ({ORACLES["rule_results"]})
SELECT id, CASE WHEN id = '3' THEN 'soft' ELSE 'hard' END AS verifier_type,
  CAST(count(*) AS BIGINT) AS n_checks, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS n_passed,
  CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*) AS pass_rate
FROM checks GROUP BY 1, 2""",
    "pass_rate_rollup": f"""
WITH checks AS (
  SELECT *, CASE WHEN id = '3' THEN 'soft' ELSE 'hard' END AS verifier_type FROM ({ORACLES["rule_results"]}))
SELECT verifier_type, id, turn_ix,
  CAST(3 - grouping(verifier_type) - grouping(id) - grouping(turn_ix) AS BIGINT) AS level,
  CAST(count(*) AS BIGINT) AS n_checks, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS n_passed,
  CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*) AS pass_rate
FROM checks GROUP BY ROLLUP (verifier_type, id, turn_ix)""",
    "fanout": f"""
WITH heads AS ({ORACLES["prompt_heads"]})
SELECT conv_id, prompt, sample_ix FROM heads, range({SAMPLES}) AS r(sample_ix)""",
    "group_advantage": f"""
WITH rewarded AS (SELECT *, sample_id // 8 AS group_id FROM ({ORACLES["turn_reward"]})),
stats AS (
  SELECT group_id, avg(reward) AS mean, coalesce(stddev_samp(reward), 0) AS spread
  FROM rewarded GROUP BY group_id)
SELECT sample_id, group_id, reward, round((reward - mean) / (spread + 1e-6), 6) AS advantage
FROM rewarded JOIN stats USING (group_id)""",
    "length_flag": f"""
WITH built AS ({ORACLES["trajectory"]})
SELECT sample_id, status, coalesce(response_length >= {LONGEST}, false) AS too_long
FROM built""",
    "epoch_batches": f"""
WITH ids AS (SELECT conv_id, count(*) AS n_messages FROM conversations GROUP BY conv_id),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY md5(concat_ws(':', conv_id, 7 + epoch)), conv_id) - 1 AS ix
  FROM ids, range({EPOCHS}) t(epoch))
SELECT conv_id, n_messages, ix, ix // 16 AS batch_id, epoch FROM numbered""",
    "token_packing": f"""
WITH RECURSIVE sizes AS (
  SELECT conv_id, CAST(sum({words("text")}) AS BIGINT) AS n_tokens FROM conversations GROUP BY conv_id),
numbered AS (
  SELECT *, coalesce(n_tokens, 0) AS n,
    row_number() OVER (ORDER BY md5(concat_ws(':', conv_id, 7)), conv_id) - 1 AS ix
  FROM sizes),
packed AS (
  SELECT conv_id, n_tokens, ix, n AS used, CAST(0 AS BIGINT) AS place FROM numbered WHERE ix % {BLOCK} = 0
  UNION ALL
  SELECT r.conv_id, r.n_tokens, r.ix, CASE WHEN p.used + r.n > {PACK} THEN r.n ELSE p.used + r.n END,
    p.place + CASE WHEN p.used + r.n > {PACK} THEN 1 ELSE 0 END
  FROM packed p JOIN numbered r ON r.ix = p.ix + 1 AND r.ix % {BLOCK} <> 0)
SELECT conv_id, n_tokens, ix // {BLOCK} * {BLOCK} + place AS pack_id FROM packed""",
    "rule_catalogue": catalogue_sql(),
    "pattern_rules": f"""
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) >= 20
  AND CASE doc_id % {len(PATTERNS)}
    {' '.join(f"WHEN {k} THEN regexp_matches(text, {quoted(p)})" for k, p in enumerate(PATTERNS[:-2]))}
    ELSE false END AS ok
FROM documents""",
}
