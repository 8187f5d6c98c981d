"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tallyspark.llm import collocation, divergence, line_dedup, mixing, quality
from tallyspark.llm.queries import URL_GLOBS, URL_RULES

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _like(glob: str) -> str:
    escaped = glob.replace("^", "^^").replace("%", "^%").replace("_", "^_")
    return escaped.replace("*", "%").replace("?", "_")


def _url_filter() -> str:
    rules = sorted(URL_RULES, key=lambda r: -len(r.name))
    fits = [f"(ends_with('.' || host, '.{r.host}') AND starts_with(path, '{r.path}'))" for r in rules]
    name = " ".join(f"WHEN {f} THEN '{r.name}'" for f, r in zip(fits, rules))
    verdict = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, rules))
    globs = " OR ".join(f"'.' || host || '#' || path LIKE '{_like(g)}' ESCAPE '^'" for g in URL_GLOBS)
    host = _LOWER.format(r"regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)")
    return f"""
        WITH parts AS (
          SELECT page_id, coalesce({host}, '') AS host,
                 coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
        SELECT page_id, host, path, CASE {name} END AS rule,
               CASE {verdict} WHEN {globs} THEN 'block' ELSE 'allow' END AS verdict FROM parts"""


def _line_dedup() -> str:
    key = _LOWER.format(f"trim(line, {_SPACE})")
    return f"""
        WITH lines AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        keyed AS (SELECT doc_id, line, pos, {key} AS key FROM lines),
        repeated AS (
          SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {line_dedup.MIN_CHARS}
          GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS})
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper <> doc_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR keeper = doc_id), ''))
                 AS kept_sha256
        FROM keyed LEFT JOIN repeated USING (key) GROUP BY doc_id"""


def _quality_rules() -> str:
    rules = quality.RULES
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(rules))
    masked = lambda p: f"(failed_bits & {p.mask()}) = 0"
    return f"""
        WITH docs AS (
          SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
        windows AS (
          SELECT doc_id, unnest(range(1, len(words) - {quality.WINDOW - 2})) AS pos, words FROM docs
          WHERE len(words) >= {quality.WINDOW}),
        grams AS (SELECT doc_id, pos, list_slice(words, pos, pos + {quality.WINDOW - 1}) AS gram FROM windows),
        counted AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams),
        covered AS (
          SELECT doc_id, count(DISTINCT word) AS n_repeat_words
          FROM (SELECT doc_id, unnest(range(pos, pos + {quality.WINDOW})) AS word FROM counted WHERE n > 1) GROUP BY doc_id),
        lines AS (
          SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
          WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
        measured AS (
          SELECT doc_id, len(words) AS n_words, CAST(list_sum(list_transform(words, lambda w: length(w))) AS BIGINT) AS chars,
                 len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, n_lines, n_dup_lines, n_repeat_words
          FROM docs LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
        filled AS (
          SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, coalesce(n_lines, 0) AS n_lines,
                 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM measured),
        failed AS (SELECT *, CAST({bits} AS BIGINT) AS failed_bits FROM filled)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits,
               NOT ({masked(quality.BASE)}) AS base_failed, {masked(quality.STANDARD)} AS kept FROM failed"""


def _mixing() -> str:
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    return f"""
        WITH sized AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
                 md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS shuffled FROM documents),
        sources AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
          FROM sized GROUP BY source),
        weighed AS (
          SELECT *, source_size * {mixing.MAX_EPOCHS} AS cap,
                 CASE (rank - 1) % {len(mixing.WEIGHTS)} {weights} END AS weight FROM sources),
        levels AS (
          SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, cap / weight AS ratio,
                 CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS DOUBLE) / sum(weight) OVER onward AS level
          FROM weighed
          WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                 onward AS (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        targets AS (
          SELECT *, least(CAST(cap AS DOUBLE), weight * (SELECT arg_min(level, (ratio, rank)) FROM levels WHERE level <= ratio))
                   AS target FROM levels),
        queued AS (
          SELECT doc_id, size, source_size, total, target, rank, shuffled,
                 sum(size) OVER (PARTITION BY rank ORDER BY shuffled, size ROWS UNBOUNDED PRECEDING) AS sent,
                 row_number() OVER (PARTITION BY rank ORDER BY shuffled, size) AS number
          FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
        copies AS (
          SELECT *, CAST(source_size * epoch + sent AS DOUBLE) / target AS finish
          FROM queued, (SELECT unnest(range({mixing.MAX_EPOCHS})) AS epoch)
          WHERE target > 0 AND source_size * epoch < target),
        cut AS (
          SELECT doc_id, rank, number, total,
                 sum(size) OVER (ORDER BY finish, rank, shuffled, epoch, number ROWS UNBOUNDED PRECEDING) AS until FROM copies),
        taken AS (SELECT rank, number, count(*) AS copies FROM cut WHERE until <= total GROUP BY rank, number)
        SELECT doc_id, size, source_size, target, CAST(coalesce(copies, 0) AS INTEGER) AS copies,
               CAST(size * coalesce(copies, 0) AS BIGINT) AS taken
        FROM queued LEFT JOIN taken USING (rank, number)"""


def _divergence() -> str:
    def share(count: str, total: str) -> str:
        return (f"CAST(1 + ({divergence.SCALE}::HUGEINT * ({count} + {divergence.SMOOTHING})) "
                f"// ({total} + {divergence.SMOOTHING} * terms) AS BIGINT)")

    return f"""
        WITH docs AS (
          SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
          FROM documents),
        words AS (SELECT d, lang, source, unnest(words) AS term FROM docs),
        kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term
                 HAVING count(DISTINCT d) >= {divergence.MIN_DOCS}),
        sized AS (SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
        counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS (
          SELECT lang, source, coalesce(total, 0) AS total, terms, lang_total
          FROM (SELECT DISTINCT lang, source FROM docs)
          LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) USING (lang, source)
          LEFT JOIN sized USING (lang)),
        shares AS (
          SELECT lang, source, term, coalesce(n, 0) AS n, {share("coalesce(n, 0)", "total")} AS p,
                 {share("lang_n", "lang_total")} AS q
          FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
        pairs AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                 (SELECT coalesce(sum(abs(x.p - y.p)), 0) FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term
                  WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
          FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}"""


def _collocations() -> str:
    score = "CAST(({}::HUGEINT * c.a * c.a) // (CAST({} AS HUGEINT) * {}) AS BIGINT)"
    return f"""
        WITH docs AS (
          SELECT coalesce(lang, '{collocation.UNKNOWN_LANG}') AS lang, {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
        pieces AS (
          SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS words FROM docs),
        placed AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
        runs AS (SELECT lang, unnest([list_slice(words, i, i + k) for k in range(0, 3) if i + k <= len(words)]) AS run FROM placed),
        counted AS (SELECT lang, array_to_string(run, ' ') AS phrase, len(any_value(run)) AS k, any_value(run) AS run, count(*) AS a
                    FROM runs GROUP BY lang, array_to_string(run, ' ') HAVING count(*) >= {collocation.MIN_COUNT}),
        totals AS (SELECT lang, count(*) AS n FROM placed GROUP BY lang),
        cuts AS (
          SELECT c.lang, c.phrase, c.run, c.k, c.a, cut, l.a AS l, r.a AS r, {score.format(collocation.SCALE, "l.a", "r.a")} AS score
          FROM (SELECT *, unnest(range(1, k)) AS cut FROM counted) c
          JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.run, 1, cut), ' ')
          JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.run, cut + 1, c.k), ' ')),
        lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        longer AS (
          SELECT lang, phrase, max(a) AS longest FROM (
            SELECT lang, unnest([array_to_string(run[1:2], ' '), array_to_string(run[2:3], ' ')]) AS phrase, a FROM counted WHERE k = 3)
          GROUP BY ALL),
        ranked AS (
          SELECT lowest.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
          FROM lowest LEFT JOIN longer USING (lang, phrase)
          WHERE longest IS NULL OR 100 * longest < {collocation.CONTAINED_PERCENT} * a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {collocation.TOP_PHRASES}"""


_TOPK_SEARCH = """
    WITH whole AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
    ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

ORACLES: dict[str, str] = {
    "op3_topk_search": _TOPK_SEARCH,
    "op4_url_filter": _url_filter(),
    "op6_line_dedup": _line_dedup(),
    "op7_quality_rules": _quality_rules(),
    "op9_mixing": _mixing(),
    "op12_divergence": _divergence(),
    "op13_collocations": _collocations(),
}
