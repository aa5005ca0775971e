"""SQL that says what those queries return that SQL can express."""

from seqloom.llm.chat_format import TOKEN_BYTES, TURN_OVERHEAD
from seqloom.llm.mixing import CELL_ROWS


def _fraction(*parts: str) -> str:
    joined = " || chr(31) || ".join(f"coalesce(CAST({p} AS VARCHAR), chr(1))" for p in parts)
    digit = "(instr('0123456789abcdef', substr(md5(KEY), i, 1)) - 1) * pow(16, 8 - i)"
    return f"(list_sum(list_transform(range(1, 9), lambda i: {digit.replace('KEY', joined)})) / 4294967296.0)"


WORDS = r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)"

MIXING = f"""WITH d AS (SELECT doc_id, source, {WORDS} AS size, CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) END AS tie FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS weight FROM s),
o AS (SELECT *, 1.5 * sum(source_size) OVER () AS total, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM w),
v AS (SELECT a.*, CAST(a.total - (SELECT coalesce(sum(b.cap), 0) FROM o b WHERE b.place < a.place) AS DOUBLE) / CAST((SELECT sum(b.weight) FROM o b WHERE b.place >= a.place) AS DOUBLE) AS level FROM o a),
l AS (SELECT level FROM v WHERE level * weight <= cap ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, CAST(CASE WHEN (SELECT level FROM l) IS NULL THEN cap ELSE least(cap, (SELECT level FROM l) * weight) END AS DOUBLE) AS target FROM w),
b AS (SELECT *, length(bin(size)) * 16 + (size >> CAST(greatest(length(bin(size)) - 4, 0) AS INTEGER)) AS bucket,
 floor({_fraction("1", "coalesce(CAST(doc_id AS VARCHAR), tie)", "size")} * greatest(8, CAST(ceil(count(*) OVER () / {CELL_ROWS}.0) AS BIGINT))) AS salt FROM d),
r AS (SELECT b.doc_id, b.size, t.source_size, t.target, {_fraction("1", "t.source")} AS start, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each,
 CAST(row_number() OVER (PARTITION BY b.source ORDER BY bucket, salt, b.doc_id NULLS FIRST, b.tie NULLS FIRST, b.size) AS DOUBLE) AS n FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN CAST(floor(n * each + start) - floor((n - 1) * each + start) AS BIGINT) * size ELSE 0 END AS taken FROM r"""

#: Characters of a turn in the template: its marks, role, line end and escaped text.
_CHARS = r"12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11"

CHAT = f"""WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (SELECT *, greatest({WORDS}, (strlen(text) + {TOKEN_BYTES - 1}) // {TOKEN_BYTES}) + {TURN_OVERHEAD} AS tokens, {_CHARS} AS chars, row_number() OVER w AS place FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, first_value(role) OVER w = 'system' AS has_system, first_value(tokens) OVER w AS lead_tokens, first_value(chars) OVER w AS lead_chars FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
g AS (SELECT *, has_system AND place = 1 AS is_system, greatest(1024 - CASE WHEN has_system THEN lead_tokens ELSE 0 END, 256) AS room FROM f),
h AS (SELECT *, coalesce(sum(CASE WHEN is_system THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
 CASE WHEN NOT lag(is_system, 1) OVER w THEN lag(tokens, 1) OVER w END AS t1, lag(chars, 1) OVER w AS c1, CASE WHEN NOT lag(is_system, 2) OVER w THEN lag(tokens, 2) OVER w END AS t2, lag(chars, 2) OVER w AS c2
 FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
i AS (SELECT *, CASE WHEN is_system THEN 0 ELSE before // greatest(room // 2, 1) END AS win FROM h),
p AS (SELECT conv_id, win, sum(tokens) AS used, sum(chars) AS chars, min(place) AS first, any_value(room) AS room, any_value(has_system) AS has_system, any_value(lead_chars) AS lead_chars,
 arg_min(coalesce(t1, -1), place) AS t1, arg_min(coalesce(c1, 0), place) AS c1, arg_min(coalesce(t2, -1), place) AS t2, arg_min(coalesce(c2, 0), place) AS c2 FROM i GROUP BY conv_id, win),
q AS (SELECT *, first > 1 AND t1 >= 0 AND used + t1 <= room AS k1 FROM p),
s AS (SELECT conv_id, sum(chars + CASE WHEN first > 1 AND has_system THEN lead_chars ELSE 0 END + CASE WHEN k1 THEN c1 ELSE 0 END + CASE WHEN k1 AND t2 >= 0 AND used + t1 + t2 <= room THEN c2 ELSE 0 END) AS n FROM q GROUP BY conv_id),
u AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
 coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY place), '') AS loss FROM t GROUP BY conv_id)
SELECT u.conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM u JOIN s ON u.conv_id IS NOT DISTINCT FROM s.conv_id"""
