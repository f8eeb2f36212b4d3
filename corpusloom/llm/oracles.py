"""SQL for the operators that SQL can express, over the same tables: plain, and for small tables only."""

from __future__ import annotations

WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
#: A-Z to a-z and nothing else.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def jaccard_components(size: int, percent: int) -> str:
    """Sets of shingles, pairs by the shingles they share, and the least id over links of any number."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", LOWER)} AS w FROM documents),
sh AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' '))) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), ids AS (SELECT doc_id, hash(s) AS s FROM sh),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM ids a JOIN ids b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= {percent} * (a.n + b.n - k)),
c(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.v, c.root FROM c JOIN l ON l.u = c.node WHERE c.root < l.v)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(root) FROM c WHERE node = doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id)"""


def repeated_words(length: int) -> str:
    """Every window with the first place of its words, the words that windows of later places cover, and the others' digest."""
    return f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, hash(array_to_string(w[i:i + {length - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {length - 2})) AS i FROM w WHERE len(w) >= {length})),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM win) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM late, (SELECT unnest(range({length})) AS j)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
left_over AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = word.doc_id AND gone.i = word.i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN left_over USING (doc_id)"""


def repeated_bytes(length: int) -> str:
    """The same over bytes, as hexadecimal digits, where every copy goes; runs of removed bytes come from the places of windows."""
    return f"""WITH b AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, {2 * length})) AS k FROM (SELECT doc_id, h, unnest(range(n - {length - 1})) AS i FROM b WHERE n >= {length})),
again AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1), hit AS (SELECT doc_id, i FROM win SEMI JOIN again USING (k)),
opens AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1 - {length}) + {length} AS new FROM hit),
span AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS z FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM opens) GROUP BY doc_id, g),
kept AS (SELECT doc_id, z AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM span UNION ALL SELECT doc_id, 0, min(a) FROM span GROUP BY doc_id),
text_left AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, n) - a)), '' ORDER BY a) AS t FROM kept JOIN b USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256 FROM b LEFT JOIN counts USING (doc_id) LEFT JOIN text_left USING (doc_id)"""


def quality(rules: list[tuple[str, str, float, float]], growth: float, floor: float, chance: float, least: int, apart: float, min_words: int) -> str:
    """Counts, ratios, sorted bins in place of sketches, fences by group and verdicts."""
    ratio = {
        "symbols_per_word": f"greatest(n_symbols - {chance} * sqrt(n_symbols), 0.0) / greatest(n_words, 1)",
        "dup_line_share": f"greatest(n_dup_lines - {chance} * sqrt(n_dup_lines), 0.0) / greatest(n_lines, 1)",
        "repeat_share": f"greatest(n_repeat_words - {chance} * sqrt(n_repeat_words), 0.0) / greatest(n_words, 1)",
        "capital_share": f"greatest(n_capitals - {chance} * sqrt(n_capitals), 0.0) / greatest(word_chars, 1)",
        "chars_per_word": "word_chars / greatest(n_words, 1)",
    }
    names = list(dict.fromkeys(r[0] for r in rules))
    value = lambda k: f"({floor}::DOUBLE * pow({growth}::DOUBLE, {k}))"
    levels, picks = [], []
    for level, keys in (("s", "lang, source"), ("l", "lang"), ("a", "")):
        found = ", ".join(f"quantile_disc(bin_{n}, [0.5, {p}]) AS {side}_{n}" for n, side, p, _ in rules)
        levels.append(f"{level} AS (SELECT {keys + ', ' if keys else ''}count(*) AS total, {found} FROM live {'GROUP BY ' + keys if keys else ''})")
    for n, side, _, times in rules:
        c = f"{side}_{n}"
        q = f"CASE WHEN s.total >= {least} THEN s.{c} WHEN l.total >= {least} THEN l.{c} ELSE a.{c} END"
        middle, outer = value(f"({q})[1]"), value(f"(({q})[2] - {0 if side == 'high' else 1})")
        reach = f"{times} * greatest(abs({outer} - {middle}), {apart} * {middle})"
        picks.append(f"coalesce({n} > {outer} + {reach}, false)" if side == "high" else f"coalesce({n} < {outer} - {reach}, false)")
    return f"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 2], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1), (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
(len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g'))::BIGINT AS n_capitals, coalesce(rep.n, 0) AS n_repeat_words FROM t LEFT JOIN rep USING (doc_id)),
c AS (SELECT *, coalesce(chars, 0) AS word_chars, n_words < {min_words} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m), r AS (SELECT *, {", ".join(f"{ratio[n]} AS {n}" for n in names)} FROM c),
live AS (SELECT *, {", ".join(f"ceil(ln(greatest({n}, {floor}) / {floor}) / ln({growth}::DOUBLE)) AS bin_{n}" for n in names)} FROM r WHERE NOT base_failed), {", ".join(levels)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(picks)}) AS kept
FROM r LEFT JOIN s ON s.lang IS NOT DISTINCT FROM r.lang AND s.source IS NOT DISTINCT FROM r.source LEFT JOIN l ON l.lang IS NOT DISTINCT FROM r.lang, a"""
