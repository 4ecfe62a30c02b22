"""The corpus operators over their whole tables: ``opN_<name>`` and what SQL there is for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm import bpe, codes, embeddings, language, lines, negatives, packing, quality, secrets, simhash, substrings, subwords, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.cluster(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", simhash.digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of secrets, with counts and a digest of those of the fixed patterns."""
    out = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    return out.select("doc_id", *(secrets.number(spans, k).alias(f"n_{k}") for k in secrets.KINDS), F.sha2(secrets.joined(spans, secrets.KINDS[:3]), 256).alias("base_sha256"), secrets.joined(spans).alias("spans"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embeddings.cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the later copies of repeated runs of lines."""
    out = lines.remove_repeated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_removed", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: Lines to delete: the shortest runs of MIN_WORDS words from each line on, and up to it, that came before.
LINES_SQL = f"""
WITH raw AS (SELECT doc_id, string_split({{text}}, chr(10)) AS l FROM {{documents}} WHERE {{text}} IS NOT NULL),
lines AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM raw),
worded AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM lines),
numbered AS (SELECT *, row_number() OVER d AS j, sum(w) OVER d AS upto, sum(w) OVER (PARTITION BY doc_id) AS total FROM worded WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
forward AS (SELECT a.doc_id, a.j, min(b.j) AS e FROM numbered a JOIN numbered b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.upto - a.upto + a.w >= {lines.MIN_WORDS} GROUP BY ALL),
backward AS (SELECT a.doc_id, max(b.j) AS j, a.j AS e FROM numbered a JOIN numbered b ON a.doc_id = b.doc_id AND b.j <= a.j AND a.upto - b.upto + b.w >= {lines.MIN_WORDS} GROUP BY ALL),
runs AS (SELECT * FROM forward UNION SELECT * FROM backward),
texts AS (SELECT r.doc_id, r.j, r.e, string_agg(n.line, chr(10) ORDER BY n.j) AS t FROM runs r JOIN numbered n ON n.doc_id = r.doc_id AND n.j BETWEEN r.j AND r.e GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, j) AS nth FROM texts),
gone AS (SELECT DISTINCT n.doc_id, n.pos FROM ranked r JOIN numbered n ON n.doc_id = r.doc_id AND n.j BETWEEN r.j AND r.e WHERE r.nth > 1),
kept AS (SELECT l.doc_id, count(g.pos) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the strings of 100 bytes that start earlier."""
    out = substrings.remove(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["first"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in windows of 2048 tokens."""
    out = packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the documents that are not held out."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(documents)
    out = language.identify(documents.select("doc_id", "text"), model)
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


#: The rules for hosts and paths.
URL_RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every url."""
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every text."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(documents, _table(spark, sf_dir, "labels"))
    return quality.assess(documents, model).select("doc_id", *quality.COUNTS, "base_failed", "probability", "kept")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids, and give digests of both."""
    out = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), bpe.digest(F.col("ids")).alias("ids_sha256"), bpe.digest(F.col("decoded")).alias("decoded_sha256"))


#: Bytes to remove: those of every window of 100 bytes, in hexadecimal digits, that is not its first.
SUBSTRINGS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(greatest(0, CAST(length(x) // 2 AS BIGINT) - 99))) AS p FROM d)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS nth FROM w),
g AS (SELECT doc_id, p, coalesce(p - lag(p) OVER o > 100, true) AS fresh FROM r WHERE nth > 1 WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
i AS (SELECT doc_id, p, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM g),
s AS (SELECT doc_id, n, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, n),
k AS (SELECT doc_id, b AS a, lead(a, 1, 1000000000) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM s UNION ALL SELECT doc_id, 0, min(a) FROM s GROUP BY doc_id),
t AS (SELECT k.doc_id, string_agg(substr(x, 2 * k.a + 1, 2 * (k.b - k.a)), '' ORDER BY k.a) AS kept FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id),
c AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""


def _urls_sql() -> str:
    """The rules, the two models, the threshold and the verdicts."""
    order = urls.ORDER
    cases = {"rule": "", "verdict": ""}
    for r in sorted(URL_RULES, key=lambda r: (-len(r.name), r.name)):
        fits = f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN "
        cases["rule"] += f"{fits}'{r.name}' "
        cases["verdict"] += f"{fits}'{r.verdict}' "
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"

    def p(c: str) -> str:
        out = f"((coalesce(m1.{c}, 0) + 1.0) / (tot.{c} + {urls.SYMBOLS}))"
        for k in range(2, order + 1):
            out = f"(CASE WHEN coalesce(c{k}.a + c{k}.r, 0) >= {urls.SEEN} THEN (coalesce(m{k}.{c}, 0) + {urls.PRIOR} * {out}) / (coalesce(c{k}.{c}, 0) + {urls.PRIOR}) ELSE {out} END)"
        return out

    def model(name: str, start: int, length: int) -> str:
        return f"{name} AS (SELECT substr(g, {start}, {length}) AS k, CAST(sum(a) AS DOUBLE) AS a, CAST(sum(r) AS DOUBLE) AS r FROM n GROUP BY 1)"

    whole = [model(f"m{k}", order + 1 - k, k) for k in range(1, order + 1)]
    before = [model(f"c{k}", order + 1 - k, k - 1) for k in range(2, order + 1)]
    joins = " ".join(f"LEFT JOIN m{k} ON m{k}.k = substr(w.g, {order + 1 - k}, {k})" for k in range(1, order + 1)) + " " + " ".join(f"LEFT JOIN c{k} ON c{k}.k = substr(w.g, {order + 1 - k}, {k - 1})" for k in range(2, order + 1))
    return f"""
WITH h AS (SELECT row_number() OVER () AS id, page_id, url, translate(regexp_extract(coalesce(url, ''), '{pattern}', 1), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(coalesce(url, ''), '{pattern}', 2) AS path FROM pages),
u AS (SELECT *, CASE {cases["rule"]}END AS rule, CASE {cases["verdict"]}END AS given, CAST('0x' || substr(md5(coalesce(url, '')), 1, 4) AS BIGINT) % 5 = 0 AS held FROM h),
q AS (SELECT id, url, given, held, repeat(chr(1), {order - 1}) || coalesce(url, '') || chr(1) AS z FROM u),
e AS (SELECT id, url, given, held, unnest(list_transform(range(1, length(z) - {order - 2}), lambda i: substr(z, i, {order}))) AS g FROM q),
n AS (SELECT g, count(*) FILTER (WHERE given = 'allow') AS a, count(*) FILTER (WHERE given = 'block') AS r FROM e WHERE given IS NOT NULL AND url IS NOT NULL AND NOT held GROUP BY g),
{", ".join(whole + before)},
tot AS (SELECT CAST(sum(a) AS DOUBLE) AS a, CAST(sum(r) AS DOUBLE) AS r FROM n),
v AS (SELECT w.g, CAST(round({urls.PARTS} * (ln({p("a")}) - ln({p("r")}))) AS BIGINT) AS v FROM (SELECT DISTINCT g FROM e) w CROSS JOIN tot {joins}),
t AS (SELECT e.id, CAST(sum(v.v) AS BIGINT) AS total, count(*) AS n FROM e JOIN v ON v.g = e.g GROUP BY e.id),
b AS (SELECT CAST(floor(total / (n * {urls.BIN})) AS BIGINT) AS bin, count(*) FILTER (WHERE given = 'allow') AS a, count(*) FILTER (WHERE given = 'block') AS r FROM t JOIN u ON u.id = t.id WHERE given IS NOT NULL AND url IS NOT NULL AND held GROUP BY 1),
o AS (SELECT bin, coalesce(sum(r) OVER x, 0) / nullif(sum(r) OVER (), 0) - coalesce(sum(a) OVER x, 0) / nullif(sum(a) OVER (), 0) AS apart FROM b WINDOW x AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT coalesce(max(least), 0) AS least FROM (SELECT bin * {urls.BIN} AS least FROM o WHERE apart IS NOT NULL ORDER BY apart DESC, bin LIMIT 1))
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN total >= n * least THEN 'allow' ELSE 'block' END) AS verdict, total / n / {urls.PARTS} AS score
FROM u JOIN t ON t.id = u.id CROSS JOIN best
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, the errors of its label, and a digest of the codebooks."""
    return codes.compress(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def _codes_sql() -> str:
    """Codebooks of the first vectors, two rounds, and the last assignment; ``w`` is the width of a part."""
    steps = ""
    for r in range(codes.ROUNDS + 1):
        steps += f"""a{r} AS MATERIALIZED (SELECT id, p, arg_min(e, far * {codes.ENTRIES} + e) AS e, min(far) AS far FROM (SELECT v.id, v.p, c.e, CAST(list_sum(list_transform(range(1, w.w + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT) AS far FROM parts v JOIN c{r} c ON c.p = v.p CROSS JOIN w) GROUP BY id, p),
"""
        if r < codes.ROUNDS:
            steps += f"""m{r} AS (SELECT p, e, i, sum(n) // count(*) - CASE WHEN sum(n) < 0 AND sum(n) % count(*) <> 0 THEN 1 ELSE 0 END AS mean FROM (SELECT v.p, a.e, unnest(range(1, w.w + 1)) AS i, unnest(v.x) AS n FROM parts v JOIN a{r} a ON a.id = v.id AND a.p = v.p CROSS JOIN w) GROUP BY p, e, i),
n{r} AS (SELECT p, e, list(CAST(mean AS BIGINT) ORDER BY i) AS x FROM m{r} GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN n{r} n ON n.p = c.p AND n.e = c.e),
"""
    last = codes.ROUNDS
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT CAST(max(len(x)) // {codes.PARTS} AS BIGINT) AS w FROM kept),
parts AS MATERIALIZED (SELECT id, p, x[p * w.w + 1 : p * w.w + w.w] AS x FROM kept CROSS JOIN w CROSS JOIN (SELECT unnest(range({codes.PARTS})) AS p)),
c0 AS MATERIALIZED (SELECT p, id - 1 AS e, x FROM parts WHERE id <= {codes.ENTRIES}),
{steps}d AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{last} GROUP BY id),
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS s FROM c{last})
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, b.s AS codebooks_sha256 FROM kept JOIN d ON d.id = kept.id CROSS JOIN b
"""


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every text, learned from the labels of the documents that are not held out."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = subwords.train(documents, _table(spark, sf_dir, "labels"))
    return subwords.assess(documents, model).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor, with some labels moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


#: All scores of the anchors; the first rows of the same label, and for each the first of other labels in its window.
NEGATIVES_SQL = f"""
WITH kept AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({codes.SCALE} * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {negatives.POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY rank <= {negatives.NEGATIVES}
"""


def queries():
    return {f.__name__: f for f in (op1_simhash, op2_secret_scan, op3_embedding_dedup, op4_line_dedup, op5_substring_dedup, op6_packing, op7_language_id, op8_url_filter, op9_quality, op10_byte_bpe, op11_vector_codes, op12_quality_classifier, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op11_vector_codes": _codes_sql(), "op13_hard_negatives": NEGATIVES_SQL, "op5_substring_dedup": SUBSTRINGS_SQL, "op8_url_filter": _urls_sql(), "op4_line_dedup": LINES_SQL.format(text="text", documents="documents") + "SELECT d.doc_id, coalesce(k.n_removed, 0) AS n_removed, length(CASE WHEN d.text IS NULL THEN NULL ELSE k.text END) AS n_chars, sha256(coalesce(k.text, '')) AS kept_sha256 FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id"}
