"""DuckDB SQL with the same results as the native corpus queries."""

from __future__ import annotations

from . import linededup, quality, urlfilter
from .common import LOWER, UPPER

_BLANK = r"[^\x20\x09-\x0D]"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _line_dedup() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS site,
             string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
 total AS (SELECT site, count(DISTINCT coalesce(text, '')) AS pages FROM d GROUP BY site),
 has AS (SELECT DISTINCT coalesce(text, '') AS page, site, unnest(lines) AS line FROM d),
 bad AS (SELECT site, list(line) AS gone FROM (
   SELECT h.site, h.line FROM has h JOIN total t ON t.site = h.site
   WHERE regexp_matches(h.line, '{_BLANK}')
   GROUP BY h.site, h.line, t.pages HAVING count(*) >= {linededup.MIN_PAGES} AND count(*) > {linededup.RATIO}::DOUBLE * t.pages)
  GROUP BY site),
 cut AS (SELECT d.doc_id, d.text, d.lines, CASE WHEN gone IS NULL THEN d.lines
           ELSE list_filter(d.lines, lambda x: NOT list_contains(gone, x)) END AS kept FROM d LEFT JOIN bad USING (site))
SELECT doc_id, (CASE WHEN text IS NULL THEN 0 ELSE len(lines) END)::BIGINT AS n_lines,
       (CASE WHEN text IS NULL THEN 0 ELSE len(lines) - len(kept) END)::BIGINT AS n_dropped,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM cut"""


def _url_filter() -> str:
    rule, action = "NULL", "NULL"
    for what, text in sorted(urlfilter.PATH_RULES, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = f"(host = {_text(name)} OR ends_with(host, {_text('.' + name)})) AND starts_with(path, {_text(slash + rest)})"
        rule = f"CASE WHEN {fits} THEN {_text(text)} ELSE {rule} END"
        action = f"CASE WHEN {fits} THEN {_text(what)} ELSE {action} END"

    def any_of(what):
        return " OR ".join(f"regexp_matches(low, {_text(p)})" for a, p, _ in urlfilter.PATTERN_RULES if a == what)

    return f"""
WITH u AS (SELECT page_id, translate(url, '{UPPER}', '{LOWER}') AS low,
             CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, {rule} AS rule,
       coalesce({action}, CASE WHEN low IS NULL OR ({any_of('allow')}) THEN 'allow' WHEN {any_of('block')} THEN 'block'
                ELSE 'allow' END) AS verdict FROM h"""


def _quality() -> str:
    rules = {"symbols_per_word": "n_symbols::DOUBLE / greatest(n_words, 1)", "upper_share": "n_upper::DOUBLE / greatest(word_chars, 1)",
             "shouts_per_word": "n_shouts::DOUBLE / greatest(n_words, 1)",
             "dup_line_share": "n_dup_lines::DOUBLE / greatest(n_lines, 1)",
             "repeat_word_share": "n_repeat_words::DOUBLE / greatest(n_words, 1)",
             "chars_per_word": "word_chars::DOUBLE / greatest(n_words, 1)"}
    grid = ", ".join(f"({_text(r)}, {c}::DOUBLE)" for r, cuts in quality.GRID.items() for c in cuts)
    values = " UNION ALL ".join(f"SELECT rid, stratum, {_text(r)} AS rule, {v} AS value FROM q" for r, v in rules.items())
    size = max(map(len, quality.GRID.values())) * len(quality.GRID)
    p = quality.ALPHA / len(quality.GRID)
    upper = UPPER + "ÀÂÄÇÈÉÊËÎÏÍÑÓÖÔÙÚÛÜ"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
             CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS stratum FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '{_BLANK}+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_BLANK}')) AS lines FROM d),
 g AS (SELECT rid, i, words[i:i + 4] AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
 twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
 rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
 q AS (SELECT w.rid, doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^{upper}]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_shouts
       FROM w LEFT JOIN rep ON rep.rid = w.rid),
 b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q),
 lab AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
 vals AS ({values}),
 seen AS (SELECT v.*, CASE WHEN good > 0 THEN 1 ELSE 0 END AS good FROM vals v JOIN b USING (rid) JOIN lab ON lab.doc_id = b.doc_id
          WHERE NOT b.base_failed),
 grid(rule, cutoff) AS (VALUES {grid}),
 test AS (SELECT stratum, s.rule, cutoff, sum(good) AS n, sum(CASE WHEN value > cutoff THEN good ELSE 0 END) AS k,
            sum(CASE WHEN value > cutoff THEN 1 - good ELSE 0 END) AS hit, (SELECT count(DISTINCT stratum) FROM seen) AS strata
          FROM seen s JOIN grid USING (rule) GROUP BY stratum, s.rule, cutoff),
 tail AS (SELECT *, hit - {quality.GOOD_WEIGHT} * k AS worth, CASE WHEN k > n * {p!r}::DOUBLE THEN 1.0 ELSE list_sum(list_transform(range(0, k::BIGINT + 1),
            lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({p!r}::DOUBLE) + (n - j) * ln(1 - {p!r}::DOUBLE)))) END AS chance
          FROM test),
 cut AS (SELECT stratum, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY worth DESC, cutoff DESC) AS r
          FROM tail WHERE worth > 0 AND chance <= {quality.DELTA} / (strata * {size})) WHERE r = 1),
 out AS (SELECT DISTINCT v.rid FROM vals v JOIN cut c ON c.stratum = v.stratum AND c.rule = v.rule WHERE v.value > c.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM out) AS kept FROM b"""


def _hard_negatives() -> str:
    return """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
       FROM v a, v c WHERE a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
       QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
 n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS r
       FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score
         AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, r::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3"""


ORACLES = {"op7_quality": _quality(), "op9_urlfilter": _url_filter(), "op10_linededup": _line_dedup(),
           "op11_hardnegatives": _hard_negatives()}
