"""The operators' results in DuckDB's SQL, where SQL can express them."""

CHAT = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-7::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(text, '␛', '␛e'), '[INST]', '␛i'), '[/INST]', '␛j'), '<s>', '␛s'), '</s>', '␛t'), '<<SYS>>', '␛y'), '<</SYS>>', '␛z') AS body
  FROM rows
), rendered AS (
  SELECT *, CASE role WHEN 'user' THEN '[INST] ' || body || ' [/INST]' WHEN 'assistant' THEN '<s>' || body || '</s>' ELSE '<<SYS>>' || role || chr(10) || body || '<</SYS>>' END AS formatted
  FROM escaped
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(formatted))::BIGINT AS formatted_chars
FROM rendered GROUP BY conv_id
"""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
), d AS (SELECT *, sha1(payload) AS h FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(h, (1 + 5 * (j // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (j % 4))::BIGINT) & 31))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""


def quality() -> str:
    """The quality rules with their default bounds."""
    from drumlin.llm.quality import COMMON_WORDS, PROSE, PROSE_LIMIT

    lists = " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in words)}]" for lang, words in COMMON_WORDS.items())
    share = lambda v: f"list_transform({v}, lambda x: CASE WHEN list_sum({v}) > 0 THEN x / list_sum({v}) ELSE 0.0::DOUBLE END)"
    term = lambda x: f"CASE WHEN {x}[i] > 0 THEN {x}[i] * log2({x}[i] / ((p[i] + q[i]) / 2)) ELSE 0.0::DOUBLE END"
    divergence = f"list_sum(list_transform(range(1, len(p) + 1), lambda i: {term('p')} + {term('q')})) / 2"
    prose = f"[{', '.join(f'{x}::DOUBLE' for x in PROSE.values())}]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS s0, CASE lang {lists} END AS known FROM d),
s1 AS (SELECT *, regexp_replace(s0, '[a-z]+', '', 'g') AS s1 FROM w), s2 AS (SELECT *, regexp_replace(s1, '[A-Z]+', '', 'g') AS s2 FROM s1), s3 AS (SELECT *, regexp_replace(s2, '[0-9]+', '', 'g') AS s3 FROM s2),
s4 AS (SELECT *, regexp_replace(s3, '[#*$%&|<>]+', '', 'g') AS s4 FROM s3), s5 AS (SELECT *, regexp_replace(s4, '[.,;:!?''"()\-]+', '', 'g') AS s5 FROM s4), s6 AS (SELECT *, regexp_replace(s5, '\p{{L}}+', '', 'g') AS s6 FROM s5),
c AS (SELECT rid, doc_id, lang, words, known, t, len(words) AS n_words, length(s0) AS word_chars, length(s3) - length(s4) AS n_symbols,
  list_transform([length(t) - length(s0), length(s0) - length(s1), length(s1) - length(s2), length(s2) - length(s3), length(s3) - length(s4), length(s4) - length(s5), length(s5) - length(s6), length(s6)], lambda x: x::DOUBLE) AS chars,
  list_transform(range(1, 15), lambda k: coalesce(len(list_filter(words, lambda x: x = known[k])), 0)::DOUBLE) AS bins FROM s6),
h0 AS (SELECT *, list_concat(bins, [n_words - list_sum(bins)]) AS counts, [chars[2] + chars[3] + chars[7], chars[1], chars[4], chars[5], chars[6], chars[8]] AS kinds FROM c),
h AS (SELECT *, {divergence} AS prose FROM (SELECT *, {share('kinds')} AS p, {share(prose)} AS q FROM h0)),
clean AS (SELECT * FROM h WHERE word_chars >= 200 AND prose <= {PROSE_LIMIT}),
r AS (SELECT lang, list(s ORDER BY k) AS ref FROM (SELECT lang, k, sum(chars[k]) AS s FROM clean, range(1, 9) AS g(k) GROUP BY lang, k) GROUP BY lang),
v AS (SELECT lang, list(s ORDER BY k) AS ref FROM (SELECT lang, k, sum(counts[k]) AS s FROM clean, range(1, 16) AS g(k) GROUP BY lang, k) GROUP BY lang),
jc AS (SELECT rid, {divergence} AS char_divergence FROM (SELECT rid, {share('chars')} AS p, {share('ref')} AS q FROM h0 JOIN r ON h0.lang IS NOT DISTINCT FROM r.lang)),
jw AS (SELECT rid, {divergence} AS word_divergence FROM (SELECT rid, {share('counts')} AS p, {share('ref')} AS q FROM h0 JOIN v ON h0.lang IS NOT DISTINCT FROM v.lang)),
win AS (SELECT rid, i, array_to_string(words[i : i + 4], ' ') AS g FROM (SELECT rid, words, unnest(range(1, n_words - 3)) AS i FROM h WHERE n_words >= 5)),
dup AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM h) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * coalesce(rep.n, 0) > 20 * n_words AS base_failed, coalesce(char_divergence, prose) AS char_divergence, coalesce(word_divergence, 0) AS word_divergence, known
  FROM h LEFT JOIN jc USING (rid) LEFT JOIN jw USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(char_divergence, 6) AS char_divergence, round(word_divergence, 6) AS word_divergence,
  NOT (base_failed OR (word_chars >= 200 AND char_divergence > 0.08) OR (n_words >= 80 AND known IS NOT NULL AND word_divergence > 0.08)) AS kept
FROM f
"""
