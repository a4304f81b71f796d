"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import embdedup, lexicon, lexsearch, linededup, lmscore, packing, secretscan, simhash, simple8b, topk, toxicity, urlfilter, whitening
from .common import scratch, table


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best inner products of every hundredth vector with all others."""
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every non-blank line, and whether it is the one that stays."""
    rows = linededup.line_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "line_no", "group_doc", "group_line", "kept")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=2)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple-8b files of all documents' ids, read back."""
    folder = scratch(spark, "ids")
    files = simple8b.write_token_files(table(spark, sf_dir, "documents"), folder, bpe_path(), end_id=2)
    rows = simple8b.read_token_files(spark, folder, files)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: (host, path, verdict) of the production rules.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of the good ones against one of all."""
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lmscore.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op9_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexicon.encode_decode(table(spark, sf_dir, "documents"), bpe_path())
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 ids."""
    rows = packing.pack(table(spark, sf_dir, "documents"), bpe_path(), window=2048, end_id=1)
    length = (F.octet_length("ids") / 4).cast("long")
    return rows.select("doc_id", "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for every benchmark item."""
    return lexsearch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: the fixed patterns' and what the randomness battery adds."""
    rows = secretscan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(secretscan.KINDS))

    def number(kind: int) -> Column:  # a second parameter of the lambda would be the span's place in the array
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(k).alias(f"n_{name}") for k, (name, *_) in enumerate(secretscan.KINDS)]
    return rows.select("doc_id", *counts, F.sha2(secretscan.written(base).cast("binary"), 256).alias("base_sha256"), secretscan.written(F.col("spans")).alias("spans"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the first 4 principal components; a deviation beyond a long is null."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), 4)
    return rows.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_line_dedup": op2_line_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_token_files": op6_token_files,
    "op7_url_filter": op7_url_filter,
    "op8_lm_score": op8_lm_score,
    "op9_bpe_lexicon": op9_bpe_lexicon,
    "op10_packing": op10_packing,
    "op11_lexical_search": op11_lexical_search,
    "op12_secret_scan": op12_secret_scan,
    "op13_whitening": op13_whitening,
    "pipeline": corpus_pipeline.run,
}

def _secret_sql() -> str:
    """The scan in SQL: patterns on the text, the battery on what they leave, thresholds by class."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def pieces(name: str, source: str, column: str, pattern: str, group: int) -> str:
        q = quoted(pattern)
        return f"{name} AS (SELECT r, string_split_regex({column}, {q}) AS p, regexp_extract_all({column}, {q}) AS m, regexp_extract_all({column}, {q}, {group}) AS g FROM {source})"

    def spans(name: str, source: str, least: int) -> str:
        return f"""{name} AS (
  SELECT r, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS n, m[i] AS v
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {source}) WHERE length(g[i]) >= {least})"""

    def hidden(name: str, source: str, least: int) -> str:
        return f"""{name} AS (
  SELECT r, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i > len(m) THEN '' WHEN length(g[i]) >= {least} THEN repeat(' ', length(m[i])) ELSE m[i] END), '') AS t FROM {source})"""

    ctes = ["d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)"]
    left = "d"
    for k, (name, pattern, group, least) in enumerate(secretscan.KINDS):
        ctes += [pieces(f"p{k}", "d", "t", pattern, group), spans(f"s{k}", f"p{k}", least), pieces(f"q{k}", left, "t", pattern, group), hidden(f"h{k}", f"q{k}", least)]
        left = f"h{k}"
    ctes += [pieces("pk", left, "t", secretscan.KEY, 0), spans("sk", "pk", secretscan.LEAST)]
    # the battery
    arms = "".join(f" WHEN regexp_matches(v, {quoted(p)}) THEN {k}" for k, (_, p, _, _) in enumerate(secretscan.ENCODINGS))
    per = lambda values: "[" + ", ".join(values) + "][e + 1]"
    alphabets = per([quoted(a) for *_, a in secretscan.ENCODINGS])
    folds = per([str(f).lower() for _, _, f, _ in secretscan.ENCODINGS])
    letters = secretscan.DIGITS + secretscan.UPPER + secretscan.LOWER + "+/_-"
    ctes += [
        f"k0 AS (SELECT r, s, n, v, CASE{arms} END AS e FROM sk WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]'))",
        f"k1 AS (SELECT r, s, n, e, {alphabets} AS a, length({alphabets}) AS size, CASE WHEN {folds} THEN lower(v) ELSE translate(v, '-_', '+/') END AS key FROM k0 WHERE e IS NOT NULL)",
        "k2 AS (SELECT *, list_transform(string_split(key, ''), lambda c: CAST(instr(a, c) AS DOUBLE)) AS v, list_transform(string_split(a, ''), lambda c: CAST(n - length(replace(key, c, '')) AS DOUBLE)) AS o FROM k1)",
        """k3 AS (
  SELECT *, size / n::DOUBLE * list_sum(list_transform(o, lambda x: x * x)) - n AS chi,
         list_transform(v, lambda x: x > size // 2) AS b, list_sum(v) / n AS mean FROM k2)""",
        """k4 AS (
  SELECT *, list_sum(list_transform(b, lambda x: x::DOUBLE)) AS ones, list_sum(list_transform(v, lambda x: x * x)) - n * mean * mean AS spread,
         list_sum(list_transform(range(1, n), lambda i: v[i] * v[i + 1])) - mean * (2 * list_sum(v) - v[1] - v[n]) + (n - 1) * mean * mean AS shared,
         list_sum(list_transform(range(1, n), lambda i: (b[i] <> b[i + 1])::DOUBLE)) AS cuts FROM k3)""",
        "k5 AS (SELECT *, 2 * ones * (n - ones) AS pairs2 FROM k4)",
        """k6 AS (
  SELECT *, CASE WHEN pairs2 > 0 AND pairs2 > n THEN (cuts - pairs2 / n) / sqrt(pairs2 * (pairs2 - n) / (n::DOUBLE * n * (n - 1))) ELSE 99 END AS runs,
         CASE WHEN spread > 1e-9 THEN (shared / spread + 1.0 / n) * sqrt(n) ELSE 99 END AS serial FROM k5)""",
        f"c0 AS (SELECT unnest(string_split({quoted(letters)}, '')) AS c)",
        "c1 AS (SELECT c, (SELECT sum(length(text) - length(replace(text, c, ''))) FROM documents) AS n FROM c0)",
        "c2 AS (SELECT translate(c, '-_', '+/') AS c, sum(n) AS n FROM c1 GROUP BY 1)",
        f"al AS (SELECT unnest(range(0, {len(secretscan.ENCODINGS)})) AS e)",
        f"un0 AS (SELECT e, {alphabets} AS a, {folds} AS fold FROM al)",
        "un1 AS (SELECT e, a, (SELECT sum(n) FROM c2 WHERE c2.c = x OR (fold AND c2.c = upper(x)))::DOUBLE AS n FROM (SELECT e, a, fold, unnest(string_split(a, '')) AS x FROM un0))",
        "un AS (SELECT e, CASE WHEN sum(n) > 0 THEN any_value(length(a)) * sum(n * n) / (sum(n) * sum(n)) - 1 ELSE 0 END AS uneven FROM un1 GROUP BY e)",
        "k7 AS (SELECT *, (chi - (size - 1) - uneven * n) / sqrt(2.0 * (size - 1) + 4 * uneven * n) AS z, 1 / (1 + 0.2316419 * abs((chi - (size - 1) - uneven * n) / sqrt(2.0 * (size - 1) + 4 * uneven * n))) AS t FROM k6 JOIN un USING (e))",
        "k8 AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))) AS tail FROM k7)",
        f"""k9 AS (
  SELECT r, s, n, e * 100 + CAST(floor(2 * log2(n)) AS INTEGER) AS class,
         CASE WHEN (chi - (size - 1)) / sqrt(2.0 * (size - 1)) <= {secretscan.REJECT} AND abs(runs) <= {secretscan.REJECT} AND abs(serial) <= {secretscan.REJECT}
              THEN least(floor(-{secretscan.STEPS} * log2(greatest(CASE WHEN z > 0 THEN 1 - tail ELSE tail END, 1e-300))), {secretscan.WORST}) ELSE 0 END AS rarity FROM k8)""",
        "b0 AS (SELECT class, rarity, count(*) AS n FROM k9 GROUP BY ALL)",
        "b1 AS (SELECT class, rarity, sum(n) OVER (PARTITION BY class ORDER BY rarity DESC) AS found, sum(n) OVER (PARTITION BY class) AS whole FROM b0)",
        f"b AS (SELECT class, min(rarity) AS least FROM b1 WHERE rarity > 0 AND whole * pow(2.0, -rarity / {secretscan.STEPS}) <= {secretscan.LEVEL} * found GROUP BY class)",
        "allspans AS (" + " UNION ALL ".join(f"SELECT r, s, {k} AS kind, n FROM s{k}" for k in range(len(secretscan.KINDS))) + f" UNION ALL SELECT r, s, {len(secretscan.KINDS)}, n FROM k9 JOIN b USING (class) WHERE rarity >= least)",
    ]
    kinds = "[" + ", ".join(quoted(name) for name in [*(k[0] for k in secretscan.KINDS), secretscan.ADDED]) + "]"
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, (name, *_) in enumerate(secretscan.KINDS))
    said = f"string_agg({kinds}[kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, kind)"
    return (
        "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, {counts}, sha256(coalesce({said} FILTER (kind < {len(secretscan.KINDS)}), '')) AS base_sha256, coalesce({said}, '') AS spans
FROM d LEFT JOIN allspans USING (r) GROUP BY r, doc_id"""
    )


ORACLE_SQL: dict[str, str] = {
    "op11_lexical_search": r"""
WITH dt AS (
  SELECT r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM (SELECT row_number() OVER () AS r, * FROM documents)),
d AS (SELECT r, doc_id, t, len(t) AS n FROM dt WHERE len(t) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM c) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term),
m AS (SELECT r, doc_id, 25 + (75 * n * (SELECT docs FROM c)) // (SELECT total FROM c) AS m FROM d),
i AS (
  SELECT j, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS j, * FROM benchmark)),
s AS (
  SELECT j, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id) AS n FROM s WHERE score > 0)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM k WHERE n <= 10""",
    "op12_secret_scan": _secret_sql(),
    "op1_topk": """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10""",
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, CAST((SELECT count(*) FROM links WHERE links.a = c.vec_id) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c""",
    # The pages of the given tables have no canonical links or redirects, so that a url without a rule is allowed.
    "op7_url_filter": """
WITH p AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '://([^/?#]*)', 1)), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT DISTINCT host, path FROM p),
m AS (
  SELECT u.host, u.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS said
  FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY ALL)
SELECT page_id, p.host, p.path, rule, coalesce(said, 'allow') AS verdict FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path""",
}
