"""SQL (DuckDB) for the queries that SQL can express."""

from __future__ import annotations

from linelake.llm.license import PHRASES, TEMPLATES, THRESHOLD, template_words, window_sizes

_SPACE = "'[^\\x20\\x09-\\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


OP3 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower('text')}, {_SPACE}) AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 2, 2))) AS r(i) WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)),
 b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
 r(node, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.v, r.m FROM r JOIN b ON b.u = r.node WHERE r.m < b.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(m) FROM r WHERE node = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)"""

OP4 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACE}) AS w FROM documents),
 g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM w, unnest(range(1, len(w) - 18)) AS r(i)),
 f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM g),
 x AS (SELECT DISTINCT doc_id, i + j AS i FROM f, unnest(range(0, 20)) AS t(j) WHERE r > 1),
 a AS (SELECT doc_id, i, w[i] AS word FROM w, unnest(range(1, len(w) + 1)) AS t(i)),
 k AS (SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.i) FILTER (x.i IS NULL) AS kept, count(x.i) AS n FROM a LEFT JOIN x ON x.doc_id = a.doc_id AND x.i = a.i GROUP BY a.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

_NIBBLE = "(strpos('0123456789abcdef', substr(h || '00', {}, 1)) - 1)"
_FIVE = f"(({_NIBBLE.format('(5 * i) // 4 + 1')} * 256 + {_NIBBLE.format('(5 * i) // 4 + 2')} * 16 + {_NIBBLE.format('(5 * i) // 4 + 3')}) >> (7 - (5 * i) % 4)::INT) & 31"

OP5 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages)
SELECT page_id, strlen(body) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_FIVE}) + 1)::INT, 1)), '') AS payload_digest,
 CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to, true AS intact FROM p"""


def _op6() -> str:
    phrases = ", ".join(f"([{', '.join(repr(w) for w in p.split())}], '{label}')" for p, label in PHRASES.items())
    sizes = window_sizes(TEMPLATES)
    templates = ", ".join(f"({i}, '{label}', [{', '.join(repr(w) for w in own)}], {sizes[i]})" for i, label, own in template_words(TEMPLATES))
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all({_lower('text')}, {_ALNUM}) AS w FROM documents),
 p(words, label) AS (VALUES {phrases}),
 b AS (SELECT doc_id, i - 1 AS i, label FROM w, p, unnest(range(1, len(w) + 1)) AS t(i) WHERE w[i:i + len(words) - 1] = words),
 bs AS (SELECT doc_id, count(*) AS n, min(i) AS low, max(i) AS high, list_sort(list_distinct(list(label))) AS labels FROM b GROUP BY doc_id),
 t(id, label, words, wide) AS (VALUES {templates}),
 o AS (SELECT DISTINCT doc_id, w, id, label, words, wide FROM w, t WHERE len(list_intersect(w, words)) >= greatest(1, ceil({THRESHOLD} * len(words) - 1e-9))),
 l AS (SELECT doc_id, label, words, list_distinct(w[i:i + wide - 1]) AS block FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM o) WHERE list_contains(words, w[i])),
 m AS (SELECT doc_id, label, len(list_intersect(block, words)) / len(words) AS share FROM l WHERE len(list_intersect(block, words)) >= greatest(1, ceil({THRESHOLD} * len(words) - 1e-9))),
 ms AS (SELECT doc_id, list(label) AS labels, max(share) AS most FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(bs.n, 0) AS n_base, low AS first_word, high AS last_word, coalesce(array_to_string(bs.labels, ','), '') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(ms.labels, [])))), ',') AS labels, CASE WHEN bs.n > 0 THEN 1.0 ELSE coalesce(most, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN bs USING (doc_id) LEFT JOIN ms USING (doc_id)"""


OP7 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_lower('text')}, {_ALNUM}) AS w FROM documents),
 b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_lower('text')}, {_ALNUM}) AS w FROM benchmark),
 i AS (SELECT item, least(10, len(w)) AS m, w FROM b WHERE len(w) > 0),
 k AS (SELECT DISTINCT item, m, len(w) AS n, p, array_to_string(w[p:p + m - 1], ' ') AS g FROM i, unnest(range(1, len(w) - m + 2)) AS t(p)),
 ms AS (SELECT DISTINCT m FROM i),
 g AS (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS g FROM d, ms, unnest(range(1, len(w) - m + 2)) AS t(p)),
 h AS (SELECT doc_id, g.p, m, item FROM g JOIN (SELECT DISTINCT item, m, g FROM k) k USING (m, g)),
 c AS (SELECT doc_id, count(DISTINCT p + j) AS n FROM h, unnest(range(0, m)) AS t(j) GROUP BY doc_id),
 s AS (SELECT doc_id, list_sort(list_distinct(list(item))) AS items FROM h GROUP BY doc_id),
 x AS (SELECT h.doc_id, h.p - 1 AS place, h.item, k.p AS q, h.m FROM h JOIN k ON k.item = h.item AND k.m = h.m JOIN g ON g.doc_id = h.doc_id AND g.p = h.p AND g.m = h.m AND g.g = k.g),
 y AS (SELECT x.doc_id, x.place, x.item, (SELECT coalesce(min(z) - 1, least(len(d.w) - x.place, len(i.w) - x.q + 1)) FROM unnest(range(1, least(len(d.w) - x.place, len(i.w) - x.q + 1) + 1)) AS t(z) WHERE d.w[x.place + z] <> i.w[x.q + z - 1]) AS long FROM x JOIN d USING (doc_id) JOIN i ON i.item = x.item),
 z AS (SELECT doc_id, long, item, place FROM y QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY long DESC, item, place) = 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated,
 coalesce(z.long, 0)::BIGINT AS longest, z.item AS longest_item, z.place AS longest_at FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN z USING (doc_id)"""

_GRAMS = " UNION ALL ".join(f"SELECT lang, w[i:i + {d - 1}] AS p FROM w, unnest(range(1, len(w) - {d - 2})) AS t(i)" for d in range(1, 6))
OP11 = f"""WITH q AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_lower('text')}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM q),
 n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
 f AS (SELECT lang, p, count(*) AS a FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= 100),
 c AS (SELECT lang, p, a FROM f WHERE len(p) > 1),
 i AS (SELECT b.lang, b.a, b.p[i:i + m - 1] AS p FROM c AS b, unnest(range(2, len(b.p))) AS t(m), unnest(range(1, len(b.p) - m + 2)) AS u(i)),
 x AS (SELECT DISTINCT lang, p FROM c JOIN i USING (lang, p) WHERE 100 * i.a >= 100 * c.a),
 k AS (SELECT c.lang, c.p, c.a, k, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM c) AS c JOIN n USING (lang) JOIN f AS l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN f AS r ON r.lang = c.lang AND r.p = c.p[k + 1:]),
 b AS (SELECT * FROM k ANTI JOIN x USING (lang, p) QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
 o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM b)
SELECT * FROM o WHERE rank <= 2000"""


def _escaped(text: str) -> str:
    return rf"regexp_replace({text}, '([<\[])(\\*(?:s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\]))', '\1\\\2', 'g')"


OP12 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, k, ['user', 'assistant'][k + 1], '</s>[INST] ok [/INST]' FROM range(0, 2) AS t(k)),
 s AS (SELECT *, CASE role WHEN 'system' THEN 22 WHEN 'user' THEN 20 WHEN 'assistant' THEN 7 ELSE 20 + length({_escaped('role')}) END + length({_escaped('text')}) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars FROM s GROUP BY conv_id"""


def _merkle(name: str, leaves: str, deep: int) -> str:
    """CTEs of trees: {name}0 (s, pos, node, n) are their leaves; {name}p has each leaf's way and the top node."""
    out = [f"{name}0 AS MATERIALIZED ({leaves})"]
    for k in range(deep):
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT s, pos // 3 AS pos, CASE WHEN n = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node, (n + 2) // 3 AS n FROM {name}{k} GROUP BY s, pos // 3, n)")
        sides = [f"coalesce(string_agg(node, '') OVER (PARTITION BY s, pos // 3 ORDER BY pos ROWS BETWEEN {rows}), '')" for rows in ("UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING")]
        out.append(f"{name}s{k} AS MATERIALIZED (SELECT s, pos, CASE WHEN n = 1 THEN '-' ELSE {sides[0]} END AS low, {sides[1]} AS high FROM {name}{k})")
    ways = ", ".join(f"[s{k}.low, s{k}.high]" for k in range(deep))
    joins = "".join(f" JOIN {name}s{k} AS s{k} ON s{k}.s = l.s AND s{k}.pos = l.pos // {3**k}" for k in range(deep))
    out.append(f"{name}p AS (SELECT l.s, l.pos, [{ways}] AS way, t.node AS top FROM {name}0 AS l JOIN {name}{deep} AS t ON t.s = l.s{joins})")
    return ",\n ".join(out)


def _fold(node: str, ways: str) -> str:
    return f"list_reduce({ways}, lambda x, y: [CASE WHEN y[1] = '-' THEN x[1] ELSE sha256(y[1] || x[1] || y[2]) END, ''], [{node}, ''])[1]"


def _op13(deep: int = 12, wide: int = 6) -> str:
    one = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(one, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    # crc32 by its table: bit by bit over the digits
    step = "list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, {})"
    crc = f"xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT), lambda c, d: {step.format('xor(c, d)')}, 4294967295::BIGINT), 4294967295)"
    sibs = "replace(array_to_string(flatten(list_concat(a.way, b.way)), ''), '-', '')"
    return f"""WITH d AS MATERIALIZED (SELECT *, {crc} % 2 = 0 AS even FROM documents),
 l AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN even THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS other, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {leaf('text')}) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
 {_merkle('a', 'SELECT s, pos, leaf AS node, n FROM l', deep)},
 {_merkle('b', f'SELECT 0 AS s, s AS pos, node, count(*) OVER () AS n FROM a{deep}', wide)}
SELECT doc_id, leaf, a.top AS subroot, b.top AS root, sha256({sibs}) AS proof_sha256, {_fold('other', 'list_concat(a.way, b.way)')} AS folded_root, folded_root = b.top AS verified
FROM l JOIN ap AS a USING (s, pos) JOIN bp AS b ON b.pos = l.s"""


ORACLE: dict[str, str] = {
    "op3_ngram_jaccard_join": OP3,
    "op4_substring_dedup": OP4,
    "op5_warc": OP5,
    "op6_license_scan": _op6(),
    "op7_benchmark_decontamination": OP7,
    "op11_phrase_mining": OP11,
    "op12_chat_formatting": OP12,
    "op13_merkle_manifest": _op13(),
}
