"""DuckDB oracle SQL.

Each registered query has an independent restatement here, written the plain
way (correlated lookups, theta joins, string_agg) so that it checks the Spark
plan rather than mirroring it.  Fragments are CTE bodies composed per query.
"""

from __future__ import annotations

from ..constants import ALLOWED_ACTS, DEFAULT_MAX_TRIES

# -- fixture view --------------------------------------------------------------
UTTERANCES = r"""
u_e AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
        FROM conversations),
u_t AS (SELECT conv_id, turn, concat(role, '_', CAST((turn // 2) % 2 AS VARCHAR(9))) AS uid,
               min(turn) OVER (PARTITION BY conv_id) AS t0 FROM conversations),
u_r AS (SELECT u_t.*, lag(uid) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_uid,
               first_value(uid) OVER (PARTITION BY conv_id ORDER BY turn) AS op_uid FROM u_t),
u_x AS (SELECT *, CASE WHEN turn = t0 THEN NULL WHEN (conv_id + turn) % 7 = 0 THEN 'N/A'
                       WHEN (conv_id + turn) % 5 = 0 THEN op_uid ELSE prev_uid END AS reply_to FROM u_r),
utterances AS MATERIALIZED (
 SELECT CASE WHEN u_e.conv_id % 2 = 0 THEN 'thr' ELSE 'seq' END AS corpus,
        CASE WHEN u_e.conv_id % 2 = 0 THEN 'threaded' ELSE 'sequential' END AS layout,
        u_e.conv_id AS thread_id,
        CAST(row_number() OVER (PARTITION BY u_e.conv_id ORDER BY u_e.turn, u_e.pos) - 1 AS BIGINT) AS row_idx,
        CAST(u_e.turn + 1 AS BIGINT) AS msg_id,
        CAST(row_number() OVER (PARTITION BY u_e.conv_id, u_e.turn ORDER BY u_e.pos) AS BIGINT) AS utt_no,
        u_x.uid AS user_id, u_e.line AS message, u_x.reply_to,
        CASE WHEN u_e.turn = u_x.t0 THEN 'Original post' WHEN u_x.reply_to = u_x.op_uid THEN 'Comment'
             ELSE 'Reply' END AS category
 FROM u_e JOIN u_x ON u_e.conv_id = u_x.conv_id AND u_e.turn = u_x.turn
 WHERE length(trim(u_e.line)) > 0)
"""

# Python str.strip() whitespace set, spelled out for DuckDB's trim(s, characters).
_PY_WS_CODEPOINTS = (
    list(range(0x09, 0x0E))
    + list(range(0x1C, 0x21))
    + [0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
PY_WS = "concat(" + ", ".join(f"chr({c})" for c in _PY_WS_CODEPOINTS) + ")"


def strip(expr: str) -> str:
    """Python ``str.strip()`` of a DuckDB string expression."""
    return f"trim({expr}, {PY_WS})"


def with_ctes(*bodies: str) -> str:
    """``WITH <utterances>, <bodies...>`` ready for a final SELECT."""
    parts = [UTTERANCES.strip()] + [b.strip().rstrip(",") for b in bodies if b.strip()]
    return "WITH " + ",\n".join(parts) + "\n"


def S(expr: str) -> str:
    """Rendered text cell: null as '', Python-stripped."""
    return strip(f"coalesce({expr}, '')")


NL = "chr(10)"

# -- per-message aggregates (A1a / A1b / A4) -------------------------------------
MSG_TEXTS = f"""
msg_texts AS MATERIALIZED (
 SELECT corpus, thread_id, msg_id, CAST(count(*) AS BIGINT) AS n_utts, CAST(min(row_idx) AS BIGINT) AS first_row,
        coalesce(string_agg({S('message')}, ' ' ORDER BY row_idx) FILTER (WHERE {S('message')} <> ''), '') AS text_nonblank,
        string_agg({S('message')}, ' ' ORDER BY row_idx) AS text_all
 FROM utterances WHERE msg_id IS NOT NULL GROUP BY corpus, thread_id, msg_id)
"""

# -- C2: sequential narrative ----------------------------------------------------
CONTEXT_SEQUENTIAL = f"""
seq AS (SELECT * FROM utterances WHERE layout <> 'threaded'),
context_sequential AS (
 SELECT a.corpus, a.thread_id, a.row_idx, concat(
   '**Local Context**: We will be annotating Utterance #', a.msg_id, ' (#', a.utt_no, ') from ', coalesce(a.user_id, ''), ':', {NL},
   '"', {S('a.message')}, '"', {NL}, 'The full message is:', {NL}, coalesce(m.text_nonblank, ''), {NL}, {NL},
   'You are asked only to annotate the utterance "', {S('a.message')}, '".',
   CASE WHEN p.row_idx IS NOT NULL THEN concat({NL}, 'This follows the previous message from ', coalesce(p.user_id, ''), ':', {NL}, '"', {S('p.message')}, '"') ELSE '' END,
   CASE WHEN n.row_idx IS NOT NULL THEN concat({NL}, {NL}, 'It is followed by a message from ', coalesce(n.user_id, ''), ':', {NL}, '"', {S('n.message')}, '"') ELSE '' END
 ) AS narrative
 FROM seq a
 LEFT JOIN msg_texts m ON m.corpus = a.corpus AND m.thread_id = a.thread_id AND m.msg_id = a.msg_id
 LEFT JOIN seq p ON p.corpus = a.corpus AND p.thread_id = a.thread_id AND p.row_idx = a.row_idx - 1
 LEFT JOIN seq n ON n.corpus = a.corpus AND n.thread_id = a.thread_id AND n.row_idx = a.row_idx + 1)
"""

# -- C1: threaded narrative, by brute force ----------------------------------------
_SAME_THREAD = "b.corpus = a.corpus AND b.thread_id = a.thread_id"
CONTEXT_THREADED = f"""
thr AS (SELECT * FROM utterances WHERE layout = 'threaded'),
ref_rows AS (
 SELECT a.corpus, a.thread_id, a.row_idx, b.msg_id, b.row_idx AS b_row, {S('b.message')} AS s, b.category AS b_cat
 FROM thr a JOIN thr b ON {_SAME_THREAD} AND b.user_id = a.reply_to AND b.row_idx < a.row_idx
 WHERE a.reply_to IS NOT NULL AND a.reply_to <> 'N/A'),
ref_any AS (SELECT corpus, thread_id, row_idx, count(*) AS n FROM ref_rows GROUP BY ALL),
ref_grp AS (SELECT corpus, thread_id, row_idx, msg_id, string_agg(s, ' ' ORDER BY b_row) AS txt
            FROM ref_rows WHERE coalesce(b_cat, '') <> 'Original post' AND msg_id IS NOT NULL GROUP BY ALL),
ref_list AS (SELECT corpus, thread_id, row_idx,
                    string_agg(concat({NL}, '- Message #', msg_id, ': "', txt, '"'), '' ORDER BY msg_id) AS lst
             FROM ref_grp GROUP BY ALL),
sa_prev AS (
 SELECT a.corpus, a.thread_id, a.row_idx, arg_max(b.msg_id, b.row_idx) AS m
 FROM thr a JOIN thr b ON {_SAME_THREAD} AND b.user_id = a.user_id AND b.reply_to = a.reply_to
                       AND b.row_idx < a.row_idx AND b.msg_id <> a.msg_id
 GROUP BY ALL),
sa_next AS (
 SELECT a.corpus, a.thread_id, a.row_idx, arg_min(b.msg_id, b.row_idx) AS m
 FROM thr a JOIN thr b ON {_SAME_THREAD} AND b.user_id = a.user_id AND b.reply_to = a.reply_to
                       AND b.row_idx > a.row_idx AND b.msg_id <> a.msg_id
 GROUP BY ALL),
rep_rows AS (
 SELECT a.corpus, a.thread_id, a.row_idx, b.msg_id, b.row_idx AS b_row, b.user_id AS b_user, {S('b.message')} AS s
 FROM thr a JOIN thr b ON {_SAME_THREAD} AND b.reply_to = a.user_id AND b.row_idx > a.row_idx AND b.user_id <> a.user_id
 WHERE b.msg_id IS NOT NULL),
rep_msgs AS (SELECT corpus, thread_id, row_idx, msg_id, min(b_row) AS first_b, arg_min(b_user, b_row) AS who,
                    string_agg(s, ' ' ORDER BY b_row) AS txt FROM rep_rows GROUP BY ALL),
rep_top AS (SELECT *, row_number() OVER (PARTITION BY corpus, thread_id, row_idx ORDER BY first_b) AS rk FROM rep_msgs),
rep_list AS (SELECT corpus, thread_id, row_idx,
                    string_agg(concat({NL}, '- Message #', msg_id, ' from ', who, ': "', txt, '"'), '' ORDER BY msg_id) AS lst
             FROM rep_top WHERE rk <= 2 GROUP BY ALL),
context_threaded AS (
 SELECT a.corpus, a.thread_id, a.row_idx, concat(
   'We will be annotating Utterance #', a.row_idx, ' from Message #', a.msg_id, ' by ', coalesce(a.user_id, ''), ':', {NL},
   '"', {S('a.message')}, '"', {NL}, {NL}, '**Local Context**:',
   CASE WHEN m.n_utts > 1 THEN
     CASE WHEN a.category = 'Original post'
          THEN concat({NL}, 'The Utterance is part of the thread message. Read the full thread starter message for context.')
          ELSE concat({NL}, 'This utterance is part of the full message:', {NL}, '"', m.text_nonblank, '"', {NL}, {NL},
                      'You are asked only to annotate the Utterance #', a.row_idx, '".') END
   ELSE '' END,
   CASE WHEN ra.n > 0 THEN
     CASE WHEN a.category = 'Comment'
          THEN concat({NL}, 'Utterance #', a.row_idx, ' is a comment on the original post by "', a.reply_to,
                      '". Read the thread starter message for the context.')
          ELSE concat({NL}, 'Utterance #', a.row_idx, ' is a reply to user "', a.reply_to, '". The following earlier messages by ',
                      a.reply_to, ' may help contextualize the reply:', coalesce(rl.lst, '')) END
   ELSE '' END,
   CASE WHEN coalesce(a.category, '') <> 'Original post' AND sp.m IS NOT NULL
        THEN concat({NL}, {NL}, 'Previous message from ', coalesce(a.user_id, ''), ' in this thread:', {NL},
                    '- Message #', sp.m, ': "', pm.text_all, '"') ELSE '' END,
   CASE WHEN coalesce(a.category, '') <> 'Original post' AND sn.m IS NOT NULL
        THEN concat({NL}, {NL}, 'Next message from ', coalesce(a.user_id, ''), ' in this thread:', {NL},
                    '- Message #', sn.m, ': "', nm.text_all, '"') ELSE '' END,
   CASE WHEN rp.lst IS NOT NULL
        THEN concat({NL}, {NL}, 'Other users replied to ', coalesce(a.user_id, ''), ' afterward. Here are some such replies:', rp.lst)
        ELSE '' END
 ) AS narrative
 FROM thr a
 LEFT JOIN msg_texts m ON m.corpus = a.corpus AND m.thread_id = a.thread_id AND m.msg_id = a.msg_id
 LEFT JOIN ref_any ra ON ra.corpus = a.corpus AND ra.thread_id = a.thread_id AND ra.row_idx = a.row_idx
 LEFT JOIN ref_list rl ON rl.corpus = a.corpus AND rl.thread_id = a.thread_id AND rl.row_idx = a.row_idx
 LEFT JOIN sa_prev sp ON sp.corpus = a.corpus AND sp.thread_id = a.thread_id AND sp.row_idx = a.row_idx
 LEFT JOIN msg_texts pm ON pm.corpus = a.corpus AND pm.thread_id = a.thread_id AND pm.msg_id = sp.m
 LEFT JOIN sa_next sn ON sn.corpus = a.corpus AND sn.thread_id = a.thread_id AND sn.row_idx = a.row_idx
 LEFT JOIN msg_texts nm ON nm.corpus = a.corpus AND nm.thread_id = a.thread_id AND nm.msg_id = sn.m
 LEFT JOIN rep_list rp ON rp.corpus = a.corpus AND rp.thread_id = a.thread_id AND rp.row_idx = a.row_idx)
"""


# -- F1: stub generator over every row and attempt (FIXTURES.md §3) -------------
ACTS_SQL = ", ".join(f"'{a}'" for a in ALLOWED_ACTS)
_ACT_CASE = " ".join(
    f"WHEN {i} THEN '{a}'" for i, a in enumerate(ALLOWED_ACTS)
)
STUB = f"""
att AS (SELECT u.corpus, u.thread_id, u.row_idx, CAST(a.attempt AS INTEGER) AS attempt
        FROM utterances u CROSS JOIN (SELECT unnest(range({DEFAULT_MAX_TRIES})) AS attempt) a),
k AS (SELECT *, (thread_id * 31 + row_idx * 7 + attempt * (CASE WHEN row_idx % 11 = 5 THEN 0 ELSE 13 END)) % 23 AS k FROM att),
stub AS MATERIALIZED (
 SELECT corpus, thread_id, row_idx, attempt, CAST(93187 + attempt AS BIGINT) AS seed,
  CASE k WHEN 19 THEN 'Request rejected by content policy' WHEN 20 THEN 'empty output' END AS error,
  CASE WHEN k IN (19, 20) THEN NULL
   WHEN k = 21 THEN '[REASON]The speaker states something in context.[/REASON] {{"act":"Claim"}}'
   ELSE concat('[REASON] ', CASE WHEN k = 22 THEN 'too short' ELSE concat('Row ', CAST(row_idx AS VARCHAR), ' is read in its local context.') END,
     ' [/REASON]', chr(10), '[ANNOT]{{"act":"', CASE k {_ACT_CASE} ELSE 'Claim' END,
     '","politeness":"', CASE (row_idx + attempt) % 29 WHEN 28 THEN '*P' WHEN 1 THEN '+P' WHEN 2 THEN '–N' WHEN 3 THEN '-P [Insult]' WHEN 4 THEN '—P [Silencer]' ELSE '' END,
     '","self/reported":"', CASE row_idx % 5 WHEN 1 THEN 'reported' WHEN 2 THEN 'reported, bogus' WHEN 3 THEN 'NA' ELSE '' END,
     '","non-bona fide":', CASE row_idx % 7 WHEN 1 THEN 'true' WHEN 2 THEN '"True"' WHEN 3 THEN '"Ture"' WHEN 4 THEN 'false' WHEN 5 THEN '"False"' WHEN 6 THEN 'null' ELSE '""' END,
     '}}[/ANNOT]') END AS response,
  CAST(1700000000.0 + attempt AS DOUBLE) AS ts
 FROM k)
"""


def _between(expr: str, open_tag: str, close_tag: str) -> str:
    return (
        f"CASE WHEN contains({expr}, '{open_tag}') AND contains({expr}, '{close_tag}') "
        f"THEN {strip(f'split_part(substr({expr}, instr({expr}, {chr(39)}{open_tag}{chr(39)}) + {len(open_tag)}), {chr(39)}{close_tag}{chr(39)}, 1)')} END"
    )


def _field_text(path: str) -> str:
    """Python ``str(value or '')`` of a JSON field, for DuckDB."""
    jt = f"json_type(j, '{path}')"
    ex = f"json_extract(j, '{path}')"
    return (
        f"CASE WHEN {jt} IS NULL OR {jt} = 'NULL' THEN '' "
        f"WHEN {jt} = 'VARCHAR' THEN json_extract_string(j, '{path}') "
        f"WHEN {jt} = 'BOOLEAN' THEN (CASE WHEN json_extract_string(j, '{path}') = 'true' THEN 'True' ELSE '' END) "
        f"WHEN {jt} = 'ARRAY' AND json_array_length({ex}) = 0 THEN '' "
        f"WHEN {jt} = 'OBJECT' AND CAST({ex} AS VARCHAR) = '{{}}' THEN '' "
        f"WHEN {jt} IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') AND TRY_CAST(json_extract_string(j, '{path}') AS DOUBLE) = 0 THEN '' "
        f"ELSE CAST({ex} AS VARCHAR) END"
    )


def _tag_list(expr: str, allowed: list[str]) -> str:
    allowed_sql = "[" + ", ".join(f"'{a}'" for a in allowed) + "]"
    return (
        f"array_to_string(list_filter(list_transform(string_split({expr}, ','), lambda x: {strip('x')}), "
        f"lambda x: x <> '' AND list_contains({allowed_sql}, x)), ', ')"
    )


# -- C5 + X8: parse every stub attempt ---------------------------------------------------
PARSED = f"""
p1 AS (SELECT *, coalesce({_between('response', '[REASON]', '[/REASON]')}, '') AS reasoning,
              {_between('response', '[ANNOT]', '[/ANNOT]')} AS js FROM stub),
p2 AS MATERIALIZED (SELECT *, CASE WHEN js IS NOT NULL AND json_valid(js) AND json_type(js) = 'OBJECT' THEN CAST(js AS JSON) END AS j FROM p1),
p3 AS MATERIALIZED (SELECT *,
   CASE WHEN json_type(j, '$."act"') = 'VARCHAR' THEN {strip("json_extract_string(j, '$.\"act\"')")} END AS act_v,
   {strip("replace(replace(" + _field_text('$."politeness"') + ", '–', '-'), '—', '-')")} AS pol_v,
   {strip(_field_text('$."self/reported"'))} AS meta_raw,
   {strip(_field_text('$."non-bona fide"'))} AS nbf_raw
 FROM p2),
parsed AS MATERIALIZED (
 SELECT corpus, thread_id, row_idx, attempt, seed, response, error, ts, reasoning, j IS NOT NULL AS j_ok,
  CASE WHEN error IS NOT NULL THEN (CASE WHEN lower(error) LIKE '%policy%' OR lower(error) LIKE '%safety%' THEN 'flagged' ELSE 'api_error' END)
       WHEN length(reasoning) < 20 THEN 'reason_short'
       WHEN NOT (contains(response, '[ANNOT]') AND contains(response, '[/ANNOT]')) THEN 'no_tags'
       WHEN j IS NULL THEN 'bad_json'
       WHEN act_v IS NULL OR act_v NOT IN ({ACTS_SQL}) THEN 'bad_act'
       WHEN pol_v <> '' AND split_part(pol_v, ' ', 1) NOT IN ('+P', '+N', '-P', '-N') THEN 'bad_politeness'
       ELSE 'ok' END AS outcome,
  act_v, pol_v, {_tag_list('meta_raw', ['non-bona fide', 'reported'])} AS meta_v, {_tag_list('nbf_raw', ['True', 'False'])} AS nbf_v
 FROM p3),
decided AS MATERIALIZED (
 SELECT *, min(CASE WHEN outcome IN ('ok', 'flagged') THEN attempt END) OVER (PARTITION BY corpus, thread_id, row_idx) AS decided FROM parsed),
ledger AS (SELECT * FROM decided WHERE attempt <= coalesce(decided, {DEFAULT_MAX_TRIES})),
last_tries AS MATERIALIZED (
 SELECT corpus, thread_id, row_idx, decided, decided IS NOT NULL AND outcome = 'ok' AS good, decided IS NOT NULL AND outcome = 'flagged' AS refused,
  act_v, pol_v, meta_v, nbf_v, reasoning, seed, response, ts
 FROM decided WHERE attempt = coalesce(decided, 0)),
resolved AS (
 SELECT corpus, thread_id, row_idx,
  CASE WHEN good THEN 'ok' WHEN refused THEN 'flagged' ELSE 'failed' END AS status,
  CASE WHEN good THEN act_v WHEN refused THEN '__FLAGGED__' ELSE '__FAILED__' END AS annotation_act,
  CASE WHEN good THEN pol_v ELSE '' END AS annotation_politeness,
  CASE WHEN good THEN meta_v ELSE '' END AS annotation_meta,
  CASE WHEN good THEN nbf_v ELSE '' END AS annotation_NBF,
  CASE WHEN good THEN reasoning ELSE '' END AS annotation_reasoning,
  CASE WHEN good THEN seed ELSE CAST(93187 AS BIGINT) END AS annotation_seed,
  CASE WHEN good THEN decided END AS attempt,
  decided AS decided_attempt,
  CASE WHEN good THEN response END AS response,
  CASE WHEN good THEN ts END AS ts
 FROM last_tries)
"""


def lit(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


from ..constants import (  # noqa: E402
    BACKGROUND_SEQUENTIAL,
    BACKGROUND_THREADED,
    FORMAT_BLOCK,
    REASONING_BLOCK,
    TASK_INSTRUCTION,
)

# -- A1c / A2 / J10: thread starters, global context ---------------------------------
STARTERS = f"""
starter_rows AS (SELECT * FROM utterances
  WHERE msg_id IS NOT NULL AND CASE WHEN layout = 'threaded' THEN coalesce(category = 'Original post', false)
                                    ELSE coalesce(msg_id = 1, false) END),
starter_msgs AS (SELECT corpus, thread_id, msg_id, CAST(min(row_idx) AS BIGINT) AS first_row,
                        coalesce(string_agg(message, ' ' ORDER BY row_idx), '') AS text
                 FROM starter_rows GROUP BY ALL)
"""
_BACKGROUND = f"CASE t.layout WHEN 'threaded' THEN {lit(BACKGROUND_THREADED)} ELSE {lit(BACKGROUND_SEQUENTIAL)} END"
GLOBAL = f"""
starter_lines AS (SELECT corpus, thread_id, string_agg(concat('- ', text), {NL} ORDER BY first_row) AS lines
                  FROM starter_msgs GROUP BY ALL),
threads AS (SELECT DISTINCT corpus, thread_id, layout FROM utterances),
global_ctx AS (
 SELECT t.corpus, t.thread_id, t.layout, {_BACKGROUND} AS background,
        concat({_BACKGROUND}, {NL}, {NL}, 'Thread starter messages:', {NL}, coalesce(l.lines, '')) AS global_context
 FROM threads t LEFT JOIN starter_lines l ON l.corpus = t.corpus AND l.thread_id = t.thread_id)
"""
# -- C4: prompts ------------------------------------------------------------------------
PROMPTS = f"""
narratives AS (SELECT corpus, thread_id, row_idx, narrative FROM context_threaded
               UNION ALL SELECT corpus, thread_id, row_idx, narrative FROM context_sequential),
prompts AS (
 SELECT n.corpus, n.thread_id, n.row_idx,
        concat({lit(TASK_INSTRUCTION)}, {NL}, {NL}, {strip('g.global_context')}, {NL}, {NL}, n.narrative, {NL},
               {lit(REASONING_BLOCK)}, {NL}, {lit(FORMAT_BLOCK)}) AS user_prompt
 FROM narratives n LEFT JOIN global_ctx g ON g.corpus = n.corpus AND g.thread_id = n.thread_id)
"""


def system_prompt_sql() -> str:
    """The stripped system prompt asset, read by DuckDB from the package folder."""
    from ..operators.prompts import DEFAULT_SYSTEM_PROMPT

    return f"(SELECT {strip('content')} FROM read_text({lit(DEFAULT_SYSTEM_PROMPT)}))"


def prompts_ctes() -> list[str]:
    return [MSG_TEXTS, CONTEXT_SEQUENTIAL, CONTEXT_THREADED, STARTERS, GLOBAL, PROMPTS]


def prompt_json_sql(user_expr: str) -> str:
    return (
        f"concat('[{{\"role\": \"system\", \"content\": ', to_json({system_prompt_sql()}), "
        f"'}}, {{\"role\": \"user\", \"content\": ', to_json({user_expr}), '}}]')"
    )
