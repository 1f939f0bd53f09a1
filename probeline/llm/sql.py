"""The same results as plain SQL, for queries that SQL can state."""

from __future__ import annotations

from probeline.llm import quality, secrets, urls

_BREAK = r"[\x20\x09-\x0D]+"


def _quality(risk: float = 0.005, doubt: float = 0.05) -> str:
    rules = {r: m.replace(" div ", " // ") for r, m in quality.MEASURES.items()}
    cells = " UNION ALL ".join(
        f"SELECT stratum, '{r}' AS rule, {c} AS cutoff, count(*) AS n, count(*) FILTER ({rules[r]} > {c}) AS k FROM good GROUP BY stratum"
        for r in rules for c in quality.CUTOFFS[r]
    )
    tests = sum(len(x) for x in quality.CUTOFFS.values())
    above = " AND ".join(
        f"NOT coalesce({rules[r]} > (SELECT min(cutoff) FROM proven p WHERE p.stratum = c.stratum AND p.rule = '{r}'), false)"
        for r in rules
    )
    return f"""
    WITH split AS (
      SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
             list_filter(string_split_regex(coalesce(text, ''), '{_BREAK}'), lambda w: w <> '') AS w FROM documents
    ), windows AS (
      SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: w[i:i + 7])) AS words FROM split
      WHERE len(w) >= 8
    ), twice AS (
      SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, words) > 1
    ), repeats AS (
      SELECT doc_id, sum(least(8, coalesce(next - i, 8))) AS n_repeat_words FROM (
        SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM twice) GROUP BY doc_id
    ), lines AS (
      SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM split
    ), counted AS (
      SELECT s.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(len(regexp_replace(t, '{_BREAK}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM split s JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
    ), failed AS (
      SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
    ), good AS (
      SELECT * FROM failed WHERE NOT base_failed AND doc_id IN (
        SELECT doc_id FROM labels GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1)
    ), cells AS ({cells}
    ), proven AS (
      SELECT stratum, rule, cutoff FROM cells, (SELECT count(DISTINCT stratum) AS strata FROM good)
      WHERE k < n * {risk} AND list_sum(list_transform(range(0, k + 1), lambda j:
        exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}) + (n - j) * ln(1 - {risk})))) <= {doubt} / ({tests} * strata)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {above} AS kept
    FROM failed c
    """


QUALITY = _quality()


def _secrets() -> str:
    rules = secrets.BASE + secrets.MORE
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
    hits = []
    for rank, r in enumerate(rules):
        pattern = r.pattern.replace("'", "''")
        hits.append(f"""
        SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, unnest(range(1, len(hit) + 1)) AS i, unnest(gap[1:len(hit)]) AS gap,
               unnest(hit) AS hit, unnest(part) AS part, {r.least} AS least
        FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gap, regexp_extract_all(t, '{pattern}') AS hit,
                     regexp_extract_all(t, '{pattern}', {r.group}) AS part FROM texts)""")
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    hits AS ({" UNION ALL ".join(hits)}),
    placed AS (
      SELECT doc_id, rank, kind, len(part) >= least AS long, len(hit) AS size,
             sum(len(gap) + len(hit)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM hits
    ), spans AS (
      SELECT doc_id, rank, kind, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE long
    ), joined AS (
      SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind IN ({base})) AS base,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
      FROM spans GROUP BY doc_id
    )
    SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
           CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM texts LEFT JOIN joined USING (doc_id)
    """


SECRETS = _secrets()


def _urls() -> str:
    fits = " UNION ALL ".join(
        f"SELECT '{verdict}' AS verdict, '{rule}' AS rule, '{rule.partition('/')[0]}' AS name, '/{rule.partition('/')[2]}' AS start"
        for verdict, rule in urls.RULES
    )
    link = urls.LINK.replace("'", "''")
    rounds = "".join(
        f"""
    s{i + 1} AS MATERIALIZED (
      SELECT kind, host, CAST(sum(score) AS HUGEINT) AS score FROM (
        SELECT l.kind, l.dst AS host, s.score * {urls.DAMPING} // 100 // l.degree AS score
        FROM s{i} s JOIN links l ON s.kind = l.kind AND s.host = l.src
        UNION ALL SELECT kind, host, score * {100 - urls.DAMPING} // 100 FROM s0) GROUP BY kind, host
    ),"""
        for i in range(urls.ROUNDS)
    )
    return f"""
    WITH rest AS (
      SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
    ), placed AS (
      SELECT page_id, html, translate(regexp_extract(r, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
    ), rules AS ({fits}
    ), ruled AS (
      SELECT page_id, html, host, path, (
        SELECT arg_max(struct_pack(rule := rule, verdict := verdict), len(rule)) FROM rules
        WHERE (p.host = name OR ends_with(p.host, '.' || name)) AND starts_with(p.path, start)) AS fit FROM placed p
    ), linked AS (
      SELECT host AS src, regexp_replace(translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), '{urls.UPPER}', '{urls.LOWER}'),
             '^[^@]*@', '') AS dst FROM placed
    ), up AS (
      SELECT host AS src, substr(host, strpos(host, '.') + 1) AS dst FROM (SELECT host FROM placed UNION SELECT dst FROM linked)
      WHERE host LIKE '%.%.%'
    ), edges AS (
      SELECT * FROM (SELECT src, dst FROM linked UNION SELECT src, dst FROM up UNION SELECT dst, src FROM up)
      WHERE src <> dst AND src <> '' AND dst <> ''
    ), ways AS (
      SELECT 'allow' AS kind, src, dst FROM edges UNION ALL SELECT 'block', dst, src FROM edges
    ), links AS MATERIALIZED (
      SELECT kind, src, dst, count(*) OVER (PARTITION BY kind, src) AS degree FROM ways
    ), seeds AS (
      SELECT fit.verdict AS kind, host, count(*) AS weight FROM ruled WHERE fit IS NOT NULL GROUP BY ALL
    ), s0 AS MATERIALIZED (
      SELECT kind, host, CAST(CAST(weight AS HUGEINT) * CAST('{urls.MASS}' AS HUGEINT) // sum(weight) OVER (PARTITION BY kind) AS HUGEINT) AS score FROM seeds
    ),{rounds}
    scores AS (
      SELECT host, coalesce(sum(score) FILTER (kind = 'allow'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'block'), 0) AS distrust
      FROM s{urls.ROUNDS} GROUP BY host
    )
    SELECT page_id, host, path, fit.rule AS rule,
           coalesce(fit.verdict, CASE WHEN distrust > 0 AND distrust >= trust THEN 'block' ELSE 'allow' END) AS verdict,
           CAST(coalesce(trust, 0) // {urls.TOLD} AS BIGINT) AS trust, CAST(coalesce(distrust, 0) // {urls.TOLD} AS BIGINT) AS distrust
    FROM ruled LEFT JOIN scores USING (host)
    """


URLS = _urls()

EMBEDDINGS = """
    WITH RECURSIVE usable AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
      WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS MATERIALIZED (
      SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.v, b.v) >= 0.93
    ), reach AS (
      SELECT vec_id AS a, vec_id AS b FROM embeddings
      UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
    ), first AS (
      SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
    ), counts AS (
      SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
    )
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
    FROM first LEFT JOIN counts USING (vec_id)
    """

def _audit(filters: str = "ABCDE") -> str:
    # The step that removes a document: the smallest position of a filter it fails.
    first = f"list_min([p FOR p IN range(1, {len(filters) + 1}) IF contains(mask, filter_order[p])])"
    letters = f"(SELECT unnest(string_split('{filters}', '')) AS x)"
    names = [f"l{i}" for i in range(len(filters))]
    joins = ", ".join(f"{letters} {n}" for n in names)
    unlike = " AND ".join(f"{a}.x <> {b}.x" for i, a in enumerate(names) for b in names[i + 1 :])
    return f"""
    WITH texts AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
             list_filter(string_split_regex(coalesce(text, ''), '{_BREAK}'), lambda w: w <> '') AS w FROM documents
    ), marks AS (
      SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
    ), masks AS (
      SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
             || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS mask
      FROM texts LEFT JOIN marks USING (doc_id)
    ), cells AS (
      SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask
    ), orders AS (
      SELECT concat({", ".join(f"{n}.x" for n in names)}) AS filter_order FROM {joins} WHERE {unlike}
    ), placed AS (
      SELECT part, mask, n, good, toxic, filter_order, coalesce({first}, 99) AS gone FROM cells, orders
    ), steps AS (
      SELECT part, filter_order, CAST(step AS INT) AS step, filter_order[step] AS letter,
             CAST(sum(n) FILTER (gone > step) AS BIGINT) AS kept, CAST(sum(n) FILTER (gone = step) AS BIGINT) AS removed,
             CAST(sum(n) FILTER (gone < step AND contains(mask, filter_order[step])) AS BIGINT) AS redundant,
             CAST(sum(n) FILTER (mask = filter_order[step]) AS BIGINT) AS unique_fails,
             CAST(sum(good) FILTER (gone = step) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (gone = step) AS BIGINT) AS toxic_lost
      FROM placed, (SELECT unnest(range(1, {len(filters) + 1})) AS step) GROUP BY ALL
    )
    SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
           coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
           CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley
    FROM steps
    """


AUDIT = _audit()


def _phrases(support: int = 30, top: int = 2000, scale: int = 2_000_000) -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, list_slice(w, i, i + {n - 1}) AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM words WHERE len(w) >= {n})"
        for n in range(1, 5)
    )
    return f"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang,
             unnest(string_split_regex(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
    ), words AS MATERIALIZED (
      SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
    ), sizes AS (
      SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang
    ), grams AS ({grams}
    ), freq AS MATERIALIZED (
      SELECT lang, p, count(*) AS f FROM grams GROUP BY lang, p HAVING count(*) >= {support}
    ), cuts AS (
      SELECT lang, p, f, k, list_slice(p, 1, k) AS one, list_slice(p, k + 1, len(p)) AS two
      FROM (SELECT lang, p, f, unnest(range(1, len(p))) AS k FROM freq WHERE len(p) > 1)
    ), scored AS (
      SELECT c.lang, c.p, c.f AS a, k, x.f AS l, y.f AS r, CAST({scale} * CAST(c.f AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
      FROM cuts c JOIN freq x ON x.lang = c.lang AND x.p = one JOIN freq y ON y.lang = c.lang AND y.p = two
    ), worst AS (
      SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
    ), inside AS (
      SELECT lang, list_slice(p, i, i + n - 1) AS p, max(f) AS longest FROM (
        SELECT lang, p, f, i, unnest(range(2, len(p))) AS n FROM (SELECT lang, p, f, unnest(range(1, len(p))) AS i FROM freq WHERE len(p) > 2))
      WHERE i + n - 1 <= len(p) GROUP BY ALL
    ), left_over AS (
      SELECT w.*, array_to_string(w.p, ' ') AS phrase FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.p = w.p
      WHERE longest IS NULL OR 100 * CAST(longest AS HUGEINT) < 80 * CAST(a AS HUGEINT)
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
    FROM left_over JOIN sizes USING (lang) QUALIFY rank <= {top}
    """


PHRASES = _phrases()
