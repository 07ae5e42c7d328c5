"""SQL that DuckDB runs on the same tables, for the queries that SQL can express.

The others are tested against brute force in ``tests/llm``: fingerprints, models and token
ids are beyond SQL.
"""

from __future__ import annotations

from trialmart.llm.mixing import BUDGET, EPOCHS, WEIGHTS
from trialmart.llm.negatives import HIGH, LOW, NEGATIVES, POSITIVES
from trialmart.llm.rules import (
    BOILERPLATE,
    MAX_REPEAT_PERCENT,
    MIN_WORDS,
    NAVIGATION,
    SYMBOLS,
    LineRules,
)

_RULES = LineRules()
_WORD = r"[^\x20\x09-\x0D]+"
_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, pattern: str) -> str:
    return f"coalesce(regexp_extract_all({text}, '{pattern}'), [])"


_OP2 = f"""
WITH sizes AS (
    SELECT doc_id, source, len({_words("text", _WORD)}) AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
    FROM documents
), totals AS (
    SELECT source, sum(size) AS source_size FROM sizes GROUP BY source
), capped AS (
    SELECT source, CAST(source_size AS BIGINT) AS source_size,
        CAST([{", ".join(map(str, WEIGHTS))}][
            ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % {len(WEIGHTS)} + 1
        ] AS DOUBLE) AS w,
        CAST({EPOCHS} * source_size AS DOUBLE) AS cap
    FROM totals
), filled AS (
    SELECT *, sum(cap) OVER fill - cap AS cap_before,
        sum(w) OVER () - (sum(w) OVER fill - w) AS w_left,
        row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place
    FROM capped
    WINDOW fill AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), shares AS (
    SELECT place, cap, w,
        ({BUDGET} * (SELECT sum(source_size) FROM capped) - cap_before) / w_left AS share
    FROM filled
), level AS (
    SELECT arg_min(share, place) AS share FROM shares WHERE cap > share * w
), targets AS (
    SELECT source, source_size, least(cap, (SELECT share FROM level) * w) AS target FROM capped
), queued AS (
    SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
        sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size
            ROWS UNBOUNDED PRECEDING) - s.size AS start
    FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target,
    CAST(greatest(0, least(floor(target) - start, size))
        + greatest(0, least(floor(target) - start - source_size, size)) AS BIGINT) AS taken
FROM queued
"""

_OP8 = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
        {_words("text", _WORD)} AS words
    FROM documents
), lines AS (
    SELECT r, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS place
    FROM docs
), worded AS (
    SELECT r, line, {_words("line", _WORD)} AS own,
        row_number() OVER (PARTITION BY r, line ORDER BY place) > 1 AS repeated
    FROM lines
    WHERE regexp_matches(line, '{_WORD}')
), judged AS (
    SELECT r, repeated, list_sum(list_transform(own, lambda w: length(w))) AS chars,
        (repeated
        OR NOT regexp_matches(line, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]')
        OR len(list_filter(own, lambda w: w IN ({", ".join(f"'{c}'" for c in NAVIGATION)})))
            > {_RULES.max_separator_share} * len(own)
        OR len(regexp_extract_all(line, '[{SYMBOLS}]'))
            > {_RULES.max_symbol_share} * list_sum(list_transform(own, lambda w: length(w)))
        OR (len(own) >= {_RULES.min_shout_words}
            AND len(list_filter(own, lambda w: ends_with(w, '!!') OR ends_with(w, '??')))
            > {_RULES.max_shout_share} * len(own))
        OR {" OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)}) AS removed
    FROM worded
), by_lines AS (
    SELECT r, count_if(repeated) AS n_dup_lines, count_if(removed) AS n_removed_lines,
        sum(CASE WHEN removed THEN chars ELSE 0 END) AS removed_chars
    FROM judged GROUP BY r
), placed AS (
    SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM docs
), windows AS (
    SELECT r, place, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c
    FROM placed WINDOW o AS (PARTITION BY r ORDER BY place)
), twice AS (
    SELECT r, place, count(*) OVER (PARTITION BY r, a, b, c) AS n
    FROM windows WHERE c IS NOT NULL
), covered AS (
    SELECT r, count(DISTINCT place + k) AS n_repeat_words
    FROM twice, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r
), counted AS (
    SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT)
            AS word_chars,
        CAST(len(regexp_extract_all(text, '[{SYMBOLS}]')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(n_removed_lines, 0) AS BIGINT) AS n_removed_lines,
        coalesce(removed_chars, 0) AS removed_chars
    FROM docs d LEFT JOIN by_lines USING (r) LEFT JOIN covered USING (r)
), failing AS (
    SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words
        AS base_failed
    FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND removed_chars <= {_RULES.max_removed} * word_chars AS kept,
    n_removed_lines
FROM failing
"""

_OP9 = f"""
WITH items AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
        {_words(_LOWER.format("text"), _ITEM_WORD)} AS w
    FROM benchmark
), starts AS (
    SELECT item, w, least(10, len(w)) AS size,
        unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
    FROM items WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS cut FROM starts
), docs AS (
    SELECT row_number() OVER () AS r, doc_id, {_words(_LOWER.format("text"), _ITEM_WORD)} AS w
    FROM documents
), places AS (
    SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i
    FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size
), cuts AS (
    SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS cut FROM places
), hits AS (
    SELECT r, i, c.size, item FROM cuts c JOIN windows USING (size, cut)
), found AS (
    SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',')
        AS items
    FROM hits GROUP BY r
), covered AS (
    SELECT r, count(DISTINCT place) AS n_hit
    FROM (SELECT r, unnest(range(i, i + size)) AS place FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN found USING (r) LEFT JOIN covered USING (r)
"""

_OP11 = f"""
WITH vectors AS (
    SELECT row_number() OVER () AS r, vec_id,
        CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
        CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM vectors a, vectors b WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place
    FROM scores WHERE same AND r <> anchor QUALIFY place <= {POSITIVES}
)
SELECT p.anchor_id, p.vec_id AS positive_id,
    CAST(row_number() OVER (
        PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id
    ) AS INTEGER) AS rank,
    n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same
    AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}
"""

ORACLES = {
    "op2_mixing": _OP2, "op8_rules": _OP8, "op9_decontamination": _OP9, "op11_negatives": _OP11,
}
