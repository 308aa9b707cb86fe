"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm import (
    bpe, divergence, host_quality, html_text, importance, minhash, mixing, pii, secret_scan, simhash, topk, toxicity, urls,
)

#: Where the vocabulary of the encoder lies on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Rules by host and path: action, host, path.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under its name."""
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_url_filter(spark, sf_dir):
    """Rules and vocabulary over every url."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)


SQL["op1_url_filter"] = f"""
WITH rules(action, rule_host, rule_path) AS (VALUES {_values(URL_RULES)}),
terms(term, is_strict) AS (VALUES {_values([*((t, True) for t in urls.STRICT), *((t, False) for t in urls.SOFT)])}),
parts AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
ruled AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(action, length(rule_host || rule_path)) AS action
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id),
hits AS (
  SELECT page_id, count(*) FILTER (is_strict) AS strict_hits, count(*) FILTER (NOT is_strict) AS soft_hits
  FROM parts JOIN terms ON regexp_matches(
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')
  GROUP BY page_id)
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN strict_hits >= 1 OR soft_hits >= {urls.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_hits, 0) AS soft_hits
FROM parts LEFT JOIN ruled USING (page_id) LEFT JOIN hits USING (page_id)
"""


@query
def op2_exact_top_k(spark, sf_dir):
    """The ten nearest of every hundredth vector."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL["op2_exact_top_k"] = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM scaled q JOIN scaled c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op4_simhash(spark, sf_dir):
    """Fingerprints and components of all documents."""
    found = simhash.near_groups(table(spark, sf_dir, "documents"), width=4, n_words=1, radius=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query
def op5_host_quality(spark, sf_dir):
    """Counts, base rules and host verdicts of all documents."""
    return host_quality.judge(table(spark, sf_dir, "documents"))


SQL["op5_host_quality"] = f"""
WITH split AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
counts AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines
  FROM split LEFT JOIN repeats USING (doc_id)),
ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > {host_quality.MOST_SYMBOLS} * word_chars
      OR 100 * n_dup_lines > {host_quality.MOST_DUP_LINES} * n_lines AS failed
  FROM counts),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (failed) AS f FROM ruled GROUP BY source),
sums AS (
  SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(f)::DOUBLE AS f, sum(n::DOUBLE * n) AS nn, sum(f::DOUBLE * f / n) AS ffn FROM hosts),
parts AS (
  SELECT f / n AS mean, (ffn - f * (f / n)) / nullif(f / n * (1 - f / n), 0) - (k - 1) AS between_hosts, n - nn / n - (k - 1) AS room FROM sums),
prior AS (
  SELECT mean, least({host_quality.STRENGTH[1]}, greatest({host_quality.STRENGTH[0]},
    CASE WHEN between_hosts > 1e-9 AND room > 1e-9 THEN room / between_hosts - 1 ELSE {host_quality.STRENGTH[1]} END)) AS strength
  FROM parts),
verdicts AS (
  SELECT source, (f + mean * strength) / (n + strength) > {host_quality.MOST_FAILING} AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT rejected AS kept, rejected AS host_rejected
FROM ruled JOIN verdicts ON ruled.source IS NOT DISTINCT FROM verdicts.source
"""


@query
def op8_bpe(spark, sf_dir):
    """Token counts and digests of ids and decoded text of all documents."""
    return bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY)


@query
def op10_mix(spark, sf_dir):
    """What the mix takes of every document."""
    mixed = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL["op10_mix"] = f"""
WITH sized AS (
  SELECT doc_id, source,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / pow(2, 48) AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [{', '.join(f'{w}::DOUBLE' for w in mixing.WEIGHTS)}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INTEGER] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, {mixing.CAP} * source_size AS most,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum({mixing.CAP} * source_size) OVER
      (ORDER BY {mixing.CAP} * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY {mixing.CAP} * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
targets AS (
  SELECT source, source_size, least(most, max(level) OVER () * weight)::DOUBLE AS target
  FROM levels),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS certain,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM targets),
chances AS (
  SELECT doc_id, d.source, size, u, source_size, target, certain, target - certain * source_size AS need,
    least(1 - 1e-9::DOUBLE, (ratio - certain) * length(bin(size))::DOUBLE * greatest(source_size, 1)::DOUBLE
      / greatest(sum(size * length(bin(size))) OVER (PARTITION BY d.source)::DOUBLE, 1e-9::DOUBLE)) AS c
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source),
odds AS (
  SELECT *, CASE WHEN c > 0 THEN (u / (1 - u)) / (c / (1 - c)) END AS o FROM chances),
ranked AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY coalesce(o / (1 + o), 1), doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM odds)
SELECT doc_id, size, source_size, target,
  ((certain + CASE WHEN need > 0 AND ahead + size / 2 <= need THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM ranked
"""


@query
def op3_secret_scan(spark, sf_dir):
    """Secrets of all documents."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark, sf_dir):
    """Toxicity of all documents, learned from the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.learn(docs, labels))


@query
def op9_html_text(spark, sf_dir):
    """Main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op6_pii(spark, sf_dir):
    """Personal data of all documents."""
    return pii.redactions(table(spark, sf_dir, "documents"))


#: What `translate` lower-cases.
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query
def op11_resample(spark, sf_dir):
    """Documents drawn by importance towards the benchmark."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op11_resample"] = f"""
WITH texts AS (
  SELECT 1 AS corpus, doc_id, text, row_number() OVER () AS i FROM documents
  UNION ALL SELECT 0, NULL, text, NULL FROM benchmark),
cut_up AS (
  SELECT corpus, doc_id, i, list_filter(string_split_regex(translate(coalesce(text, ''), {LOWER}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM texts),
features AS (
  SELECT corpus, doc_id, i, unnest(list_concat(w, list_concat(
    list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]),
    list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])))) AS f
  FROM cut_up),
-- CRC-32 byte by byte: a table of 256 entries from the polynomial, then one step a byte.
steps AS (
  SELECT list(c ORDER BY k) AS step FROM (
    SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) t(k))),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
hashed AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2),
    lambda k: (position(h[2 * k + 1] IN '0123456789ABCDEF') - 1) * 16 + position(h[2 * k + 2] IN '0123456789ABCDEF') - 1)),
    lambda c, b: xor(c // 256, step[xor(c % 256, b) + 1]))) % {importance.BUCKETS} AS bucket
  FROM hexed, steps),
counts AS (
  SELECT bucket, count(*) FILTER (corpus = 1) AS s, count(*) FILTER (corpus = 0) AS t FROM features JOIN hashed USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {importance.BUCKETS})::DOUBLE
    / ((s + 1)::DOUBLE * (sum(t) OVER () + {importance.BUCKETS})::DOUBLE)))::BIGINT AS gain FROM counts),
weighed AS (
  SELECT i, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE corpus = 1 GROUP BY i),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM cut_up LEFT JOIN weighed USING (i) WHERE corpus = 1),
placed AS (
  SELECT *, n_words >= {importance.LEAST_WORDS} AS fit,
    row_number() OVER (PARTITION BY n_words >= {importance.LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
    count(*) OVER (PARTITION BY n_words >= {importance.LEAST_WORDS}) AS n
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= {importance.PERCENT} * n // 100 THEN place END AS rank
FROM placed
"""


@query
def op12_divergence(spark, sf_dir):
    """How the sources of each language differ in their words."""
    return divergence.audit(table(spark, sf_dir, "documents"))


SQL["op12_divergence"] = f"""
WITH docs AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
seen AS (SELECT lang, source, i, unnest(w) AS term FROM docs),
langs AS (SELECT lang, term, count(*) AS lang_n FROM seen GROUP BY lang, term HAVING count(DISTINCT i) >= {divergence.LEAST_DOCS}),
groups AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(lang_all, 0) AS lang_all, coalesce(g.n, 0) AS n_all
  FROM (SELECT DISTINCT lang, source FROM docs)
  LEFT JOIN (SELECT lang, count(*) AS v, sum(lang_n)::HUGEINT AS lang_all FROM langs GROUP BY lang) USING (lang)
  LEFT JOIN (SELECT lang, source, count(*)::HUGEINT AS n FROM seen JOIN langs USING (lang, term) GROUP BY lang, source) g USING (lang, source)),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM seen JOIN langs USING (lang, term) GROUP BY lang, source, term),
shares AS (
  SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n,
    1 + ({divergence.UNIT}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n_all + v) AS p,
    1 + ({divergence.UNIT}::HUGEINT * (l.lang_n + 1)) // (g.lang_all + v) AS q
  FROM groups g JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= {divergence.TOP}
"""


@query
def op13_minhash(spark, sf_dir):
    """Groups of documents by the similarity of their sets of word pairs."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


SQL["op13_minhash"] = f"""
WITH RECURSIVE cut_up AS (
  SELECT row_number() OVER () AS i, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), {LOWER}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingled AS (
  SELECT i, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END)) AS s
  FROM cut_up),
sets AS (SELECT row_number() OVER () AS g, s, len(s) AS n, min(doc_id) AS least FROM shingled WHERE len(s) > 0 GROUP BY s),
parts AS (SELECT g, n, unnest(s) AS f FROM sets),
common AS (SELECT a.g AS a, b.g AS b, a.n AS an, b.n AS bn, count(*) AS shared
  FROM parts a JOIN parts b ON a.f = b.f AND a.g < b.g AND 100 * least(a.n, b.n) >= {minhash.PERCENT} * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * shared >= {minhash.PERCENT} * (an + bn - shared)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached(g, h) AS (
  SELECT a, b FROM ways UNION SELECT reached.g, ways.b FROM reached JOIN ways ON reached.h = ways.a),
groups AS (
  SELECT x.g, least(any_value(x.least), min(y.least)) AS component_id
  FROM sets x LEFT JOIN reached ON x.g = reached.g LEFT JOIN sets y ON reached.h = y.g GROUP BY x.g)
SELECT doc_id, len(shingled.s)::BIGINT AS n_shingles, CASE WHEN len(shingled.s) = 0 THEN doc_id ELSE component_id END AS component_id,
  doc_id = CASE WHEN len(shingled.s) = 0 THEN doc_id ELSE component_id END AS kept
FROM shingled LEFT JOIN sets ON shingled.s = sets.s LEFT JOIN groups USING (g)
"""
