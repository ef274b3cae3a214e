"""The SQL that the operators' queries are checked against."""

from __future__ import annotations

from tracelore.llm import chat, mixing, packing, phrases, prefix_trie, secrets

WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"

PACKING = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
 seqs AS (SELECT doc_id, seq, least({packing.MAX_LEN}, n - seq * {packing.MAX_LEN}) AS n_tokens FROM
   (SELECT doc_id, n, unnest(range(0, greatest(1, (n + {packing.MAX_LEN - 1}) // {packing.MAX_LEN}))) AS seq FROM docs)),
 lens AS (SELECT row_number() OVER (ORDER BY n_tokens) AS i, n_tokens AS bound, CAST(sum(count(*)) OVER (ORDER BY n_tokens) AS BIGINT) AS upto FROM seqs WHERE n_tokens > 0 GROUP BY n_tokens),
 last AS (SELECT coalesce(max(i), 0) AS n FROM lens),
 best AS (SELECT 0 AS k, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS upto, CAST(0 AS BIGINT) AS cost, CAST(0 AS BIGINT) AS prev
   UNION ALL SELECT k, j, upto, cost, prev FROM (
     SELECT b.k + 1 AS k, l.i AS j, l.upto, min(b.cost + l.bound * (l.upto - b.upto)) AS cost, arg_min(b.j, (b.cost + l.bound * (l.upto - b.upto), b.j)) AS prev
     FROM best b JOIN lens l ON l.i > b.j WHERE b.k < (SELECT least({packing.N_BUCKETS}, n) FROM last) GROUP BY b.k, l.i, l.upto)),
 trace AS (SELECT k, j, prev FROM best WHERE k = (SELECT least({packing.N_BUCKETS}, n) FROM last) AND j = (SELECT n FROM last) AND k > 0
   UNION ALL SELECT b.k, b.j, b.prev FROM trace t JOIN best b ON b.k = t.k - 1 AND b.j = t.prev WHERE b.k > 0),
 bounds AS (SELECT l.bound FROM trace t JOIN lens l ON l.i = t.j),
 placed AS (SELECT s.*, (SELECT min(bound) FROM bounds WHERE bound >= s.n_tokens) AS bucket_len,
   substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || seq), 1, 15) AS place FROM seqs s WHERE n_tokens > 0),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY bucket_len ORDER BY place, doc_id, seq) - 1 AS at_ FROM placed)
SELECT doc_id, seq, seq * {packing.MAX_LEN} AS start_word, n_tokens, bucket_len, at_ // ({packing.BUDGET} // bucket_len) AS batch, at_ % ({packing.BUDGET} // bucket_len) AS slot FROM numbered
UNION ALL SELECT doc_id, seq, 0, n_tokens, NULL, NULL, NULL FROM seqs WHERE n_tokens = 0"""

CHAT = f"""
WITH placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place,
   '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' AS line, coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)) AS said FROM conversations),
 prefixes AS (SELECT *, list(said) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix, count(*) OVER (PARTITION BY conv_id) AS turns FROM placed),
 proper AS (SELECT DISTINCT prefix FROM prefixes WHERE place + 1 < turns),
 kept AS (SELECT min(conv_id) AS conv_id, any_value(turns) AS turns FROM prefixes WHERE place + 1 = turns AND prefix NOT IN (SELECT prefix FROM proper) GROUP BY prefix)
SELECT p.conv_id, k.turns, p.place // {chat.PART_TURNS} AS part, count(*) AS n_turns, string_agg(p.line, chr(10) ORDER BY p.place) AS text
FROM placed p JOIN kept k ON k.conv_id IS NOT DISTINCT FROM p.conv_id GROUP BY 1, 2, 3"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS r FROM embeddings),
 fine AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 links AS (SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM fine a JOIN fine b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
 reach AS (SELECT r AS a, r AS b FROM v UNION SELECT x.a, l.b FROM reach x JOIN links l ON l.a = x.b),
 low AS (SELECT x.a AS r, min(v.vec_id) AS component_id FROM reach x JOIN v ON v.r = x.b GROUP BY 1)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.r) AS n_links, low.component_id, coalesce(v.vec_id = low.component_id, false) AS kept FROM v JOIN low USING (r)"""


def _shared(name: str, of: str, total: str, part: str) -> str:
    """Weights share ``total`` within ``part`` up to the caps of table ``of``: groups are capped in the order of cap by weight
    until the level of the rest is no more than the next one's."""
    over = f"PARTITION BY {part} ORDER BY cap / weight, weight, cap"
    own = f"PARTITION BY {part}"
    return f"""
 {name}_run AS (SELECT *, coalesce(sum(cap) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_,
   sum(weight) OVER ({own}) - coalesce(sum(weight) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_,
   row_number() OVER ({over}) AS pos FROM {of}),
 {name}_fit AS (SELECT *, min(pos) FILTER (WHERE ({total} - used_) / open_ <= cap / weight) OVER ({own}) AS first_ FROM {name}_run),
 {name}_sum AS (SELECT *, sum(cap) FILTER (WHERE first_ IS NULL OR pos < first_) OVER ({own}) AS used2, sum(weight) FILTER (WHERE pos >= first_) OVER ({own}) AS open2 FROM {name}_fit),
 {name} AS (SELECT *, CASE WHEN first_ IS NULL OR pos < first_ THEN cap ELSE ({total} - coalesce(used2, 0)) * weight / open2 END AS target FROM {name}_sum)"""


MIXING = rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
 rows_ AS (SELECT *, CAST(floor(log2(greatest(size, 1))) AS INTEGER) AS class FROM sized),
 classes AS (SELECT source, class, sum(size) AS class_size, count(*) AS n FROM rows_ GROUP BY ALL),
 src AS (SELECT source, CAST(sum(class_size) AS BIGINT) AS source_size, (SELECT CAST(sum(size) AS DOUBLE) FROM sized) AS total,
   CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {mixing.WEIGHTS[0]} WHEN 1 THEN {mixing.WEIGHTS[1]} ELSE {mixing.WEIGHTS[2]} END AS DOUBLE) AS weight,
   CAST({mixing.MOST} * sum(class_size) AS DOUBLE) AS cap FROM classes GROUP BY source),{_shared("by_source", "src", "total", "1")},
 mixed AS (SELECT c.source, c.class, c.class_size, c.n, s.target AS whole_target, c.class_size / (1 + c.class / 16.0::DOUBLE) AS weight, CAST({mixing.MOST} * c.class_size AS DOUBLE) AS cap
   FROM classes c JOIN by_source s ON s.source IS NOT DISTINCT FROM c.source WHERE class_size > 0),{_shared("by_class", "mixed", "whole_target", "source")},
 copies AS (SELECT source, class, class_size, n, whole_target, round(target / class_size, 9) AS c FROM by_class),
 parts AS (SELECT *, floor(c) AS whole, c - floor(c) AS p FROM copies),
 rest AS (SELECT source, max(whole_target) - sum(class_size * whole) AS rest FROM parts GROUP BY source),
 ranked AS (SELECT r.*, p.whole, p.p, t.rest, ln(u / (1 - u)) - ln(p.p / (1 - p.p)) AS odds FROM
   (SELECT *, (CAST(CAST('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u FROM rows_ WHERE size > 0) r
   JOIN parts p ON p.source IS NOT DISTINCT FROM r.source AND p.class = r.class JOIN rest t ON t.source IS NOT DISTINCT FROM r.source WHERE p.p > 0),
 steps AS (SELECT source, odds, doc_id, sum(size) AS words, max(rest) AS rest FROM ranked GROUP BY ALL),
 walked AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY odds, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached FROM steps),
 more AS (SELECT source, odds, doc_id FROM walked WHERE reached <= rest OR abs(reached - rest) <= abs(reached - words - rest))
SELECT r.doc_id, r.size, s.source_size, s.target, CAST(r.size * (coalesce(p.whole, 0) + CASE WHEN m.odds IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rows_ r JOIN by_source s ON s.source IS NOT DISTINCT FROM r.source
 LEFT JOIN parts p ON p.source IS NOT DISTINCT FROM r.source AND p.class = r.class AND r.size > 0
 LEFT JOIN (SELECT DISTINCT a.source, a.class, a.doc_id, a.odds FROM ranked a JOIN more b ON a.source IS NOT DISTINCT FROM b.source AND a.odds = b.odds AND a.doc_id IS NOT DISTINCT FROM b.doc_id) m
   ON m.source IS NOT DISTINCT FROM r.source AND m.class = r.class AND m.doc_id IS NOT DISTINCT FROM r.doc_id AND r.size > 0"""


def _spans(kind: str, pattern: str, keep: str = "true") -> str:
    """Gaps and matches alternate: a match starts after the gaps up to it and the matches before it."""
    p = pattern.replace("'", "''")
    return f"""SELECT r, {secrets.KINDS.index(kind)} AS k, start_, start_ + length(m) AS end_ FROM (SELECT r, m, v,
   list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start_ FROM (
   SELECT r, found, string_split_regex(t, '{p}') AS gaps, unnest(found) AS m, unnest(values_) AS v, unnest(range(1, len(found) + 1)) AS i FROM (
   SELECT r, t, regexp_extract_all(t, '{p}') AS found, {"regexp_extract_all(t, '" + p + "', 2)" if kind == "assign" else "regexp_extract_all(t, '" + p + "')"} AS values_ FROM d))) WHERE {keep}"""


_SIX = "length(v) >= 6"
_RANDOM = "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')"
SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 base AS ({_spans("assign", secrets.ASSIGN, _SIX)} UNION ALL {_spans("access", secrets.ACCESS)} UNION ALL {_spans("hex", secrets.HEX)}),
 weak AS ({_spans("login", secrets.LOGIN)} UNION ALL {_spans("bare", secrets.BARE, _RANDOM)} UNION ALL {_spans("endpoint", secrets.ENDPOINT)}),
 part AS (SELECT *, CASE WHEN k IN (0, 2, 4) THEN 'secret' WHEN k IN (1, 3) THEN 'identifier' ELSE 'endpoint' END AS role FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
 extra AS (SELECT * FROM weak w WHERE EXISTS (SELECT 1 FROM part p WHERE p.r = w.r AND p.start_ - w.end_ <= {secrets.SCOPE} AND w.start_ - p.end_ <= {secrets.SCOPE} AND CASE WHEN w.k = 4 THEN p.role IN ('identifier', 'endpoint') ELSE p.role = 'secret' END)),
 said AS (SELECT r, k, start_, end_, k < 3 AS strong, CASE k {" ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(secrets.KINDS))} END || ':' || CAST(start_ AS BIGINT) || ':' || CAST(end_ AS BIGINT) AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM extra)),
 per AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2,
   string_agg(s, ',' ORDER BY start_, k) FILTER (WHERE strong) AS base_, string_agg(s, ',' ORDER BY start_, k) AS all_ FROM said GROUP BY r)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base_, '')) AS base_sha256, coalesce(all_, '') AS spans FROM d LEFT JOIN per USING (r)"""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, {WORDS} AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
 win AS (SELECT r, i, words[i:i + 7] AS eight FROM (SELECT r, words, unnest(range(1, greatest(1, len(words) - 6))) AS i FROM w)),
 twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, eight) AS c FROM win) WHERE c > 1),
 rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
 pairs AS (SELECT r, count(*) FILTER (WHERE a = b) AS n FROM (SELECT r, unnest(words[1:len(words) - 1]) AS a, unnest(words[2:]) AS b FROM w WHERE len(words) > 1) GROUP BY r),
 c AS (SELECT w.doc_id, w.t, words, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
   len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(pairs.n, 0) AS stutter FROM w LEFT JOIN rep USING (r) LEFT JOIN pairs USING (r)),
 f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR 10 * (length(t) - length(translate(t, '!', ''))) > n_words
  OR length(translate(t, '{UPPER}', '')) < length(translate(t, '{UPPER.lower()}', '')) OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
  OR 10 * stutter > 3 * n_words OR 2 * len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{{L}}'))) > n_words) AS kept FROM f"""

PHRASES = rf"""
WITH d AS (SELECT coalesce(lang, '{phrases.UNKNOWN}') AS lang, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
 p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
 g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS m))),
 f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
 totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
 cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= {phrases.MIN_COUNT}),
 held AS (SELECT lang, phrase, max(a) AS longer FROM (
   SELECT lang, a, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, a, k, unnest(range(1, m - k + 2)) AS i FROM cand JOIN (SELECT unnest([2, 3]) AS k) ON k < m)) GROUP BY ALL),
 kept AS (SELECT c.* FROM cand c LEFT JOIN held h USING (lang, phrase) WHERE h.longer IS NULL OR 100 * CAST(h.longer AS HUGEINT) < {phrases.COVERED} * CAST(c.a AS HUGEINT)),
 cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
 each_ AS (SELECT c.lang, c.phrase, c.a, c.k, l.a AS l, r.a AS r, CAST({phrases.SCALE} * CAST(c.a AS HUGEINT) // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score
   FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.tail),
 low AS (SELECT * FROM each_ QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM low JOIN totals USING (lang) QUALIFY rank <= {phrases.TOP}"""

#: CRC-32 of a short ASCII text, bit by bit.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)),
   lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
TRIE = f"""
WITH own AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place
   FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
 ids AS (SELECT conv_id, count(*) AS turns, conv_id - conv_id % {prefix_trie.FAMILY} AS base, {CRC.format("CAST(conv_id AS VARCHAR)")} % {prefix_trie.PREFIX} AS h FROM own GROUP BY conv_id),
 c AS (SELECT i.conv_id, i.base, i.h, least(i.h, coalesce(b.turns, 0)) AS given FROM ids i LEFT JOIN ids b ON b.conv_id = i.base),
 re AS (SELECT c.conv_id, o.place, o.role, o.text FROM c JOIN own o ON o.conv_id = c.base WHERE o.place < c.h
   UNION ALL SELECT o.conv_id, o.place - c.h + c.given, o.role, o.text FROM own o JOIN c USING (conv_id) WHERE o.place >= c.h),
 path AS (SELECT conv_id, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, octet_length(encode(text)) AS size FROM re
   UNION ALL SELECT conv_id, list_filter([{{'r': '', 't': ''}}], lambda x: false), 0 FROM c),
 node AS (SELECT p, len(p) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved FROM path GROUP BY p),
 kid AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
 tree AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM node n LEFT JOIN kid k ON k.p = n.p),
 under AS (SELECT p[1:d] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM tree) GROUP BY ALL),
 last AS (SELECT conv_id, max_by(p, len(p)) AS p FROM path GROUP BY conv_id),
 done AS (SELECT p, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM last GROUP BY p)
SELECT t.conv_id, t.depth, u.conv_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(d.ends_sha256, sha256('')) AS ends_sha256
FROM tree t JOIN under s ON s.p = t.p LEFT JOIN node u ON t.depth > 0 AND u.p = t.p[1:t.depth - 1] LEFT JOIN done d ON d.p = t.p"""

ORACLES = {
    "op1_packing": PACKING, "op2_chat": CHAT, "op5_vectors": VECTORS, "op6_mixing": MIXING, "op8_secrets": SECRETS, "op9_quality": QUALITY,
    "op12_phrases": PHRASES,
    "op13_prefix_trie": TRIE,
}
