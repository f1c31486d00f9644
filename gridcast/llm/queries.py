"""One query per operator over the given tables, beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm import chat, collocations, exact_dedup, line_dedup, mixing, sentencepiece, sharding, simhash, spelling, suffix_dedup, topk, toxicity, url_filter
from gridcast.llm.url_filter import ALLOW, BLOCK, Rule
from gridcast.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(
    r"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
)
def op1_topk_search(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query(
    r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t FROM documents),
     g AS (SELECT t, min(doc_id) keep_id, count(*) group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)
"""
)
def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


@query(
    r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
     w AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS s FROM d, unnest(range(0, greatest(n - 49, 0))) u(p)),
     m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
     c AS (SELECT w.doc_id, w.p FROM w JOIN m ON w.s = m.s WHERE w.doc_id > least),
     b AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS fresh FROM c),
     r AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM b),
     s AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS e FROM r GROUP BY doc_id, run),
     k AS (SELECT doc_id, a, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before, e, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM s),
     t AS (SELECT k.doc_id, count(*) AS n_spans, sum(e - a) AS gone,
                  string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a)
                  || max(CASE WHEN next IS NULL THEN substr(h, CAST(2 * e + 1 AS BIGINT)) END) AS rest
           FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""
)
def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(table(spark, sf, "documents")))


@query(
    r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
     p AS (SELECT *, length('### ' || role || text) + 10
                     + len(regexp_extract_all(role || chr(10) || text, '###|</turn>')) AS size FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
)
def op4_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], rows.schema)
    return chat.read_back(chat.formatted(rows.unionByName(more)))


PAGE_RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)


@query(
    r"""
WITH a AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     b AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
     rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                             ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
     r AS (SELECT b.*, string_split(path, '/') AS label,
                  (SELECT max_by(rhost || rpath, length(rhost || rpath)) FROM rules
                   WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
                  (SELECT max_by(verdict, length(rhost || rpath)) FROM rules
                   WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS verdict FROM b),
     t AS (SELECT page_id, rule, verdict, list_sort(list_distinct(list_concat([
                    'tld=' || string_split(host, '.')[-1],
                    'site=' || array_to_string(string_split(host, '.')[-2:], '.'),
                    'host=' || host,
                    'depth=' || (len(label) - 1),
                    'ending=' || regexp_extract(path, '\.([^./]*)$', 1),
                    'query=' || coalesce(contains(url, '?'), false),
                    'scheme=' || CASE WHEN instr(url, '://') > 0 THEN substr(url, 1, instr(url, '://') - 1) ELSE '' END
                  ], list_transform(range(2, len(label) + 1), lambda i: 'path' || (i - 1) || '=' || label[i])))) AS tokens FROM r),
     d AS (SELECT rule IS NULL AS asked, verdict, tokens, list(page_id) AS pages, count(*) AS pages_n FROM t GROUP BY 1, 2, 3),
     sets AS (SELECT asked, verdict, pages, pages_n, list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) AS ante
              FROM (SELECT *, unnest(range(1, 1 << len(tokens))) AS m FROM d)),
     n AS (SELECT count(*) AS n FROM r WHERE rule IS NOT NULL),
     g AS (SELECT ante, verdict, sum(pages_n) AS c FROM sets WHERE NOT asked GROUP BY ante, verdict),
     f AS (SELECT ante, verdict, c / CAST(sum(c) OVER (PARTITION BY ante) AS DOUBLE) AS confidence, c / CAST(n AS DOUBLE) AS support, c, n FROM g, n),
     k AS MATERIALIZED (SELECT * FROM f WHERE c >= ceil(0.01 * n) AND confidence >= 0.8),
     parts AS (SELECT ante, verdict, confidence, list_filter(ante, lambda x, i: (m >> (i - 1)) & 1 = 1) AS part
               FROM (SELECT *, unnest(range(1, (1 << len(ante)) - 1)) AS m FROM k WHERE len(ante) > 1)),
     lost AS (SELECT DISTINCT parts.ante, parts.verdict FROM parts JOIN k b ON b.ante = part AND b.verdict = parts.verdict AND b.confidence >= parts.confidence),
     kept AS (SELECT k.* FROM k ANTI JOIN lost ON lost.ante = k.ante AND lost.verdict = k.verdict),
     o AS (SELECT page_id, verdict, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, support DESC, verdict = 'block' DESC,
                                                       array_to_string(ante, ' ') DESC) AS place
           FROM (SELECT unnest(pages) AS page_id, ante, kept.verdict, confidence, support FROM sets JOIN kept USING (ante) WHERE asked))
SELECT r.page_id, host, path, rule, coalesce(r.verdict, o.verdict, 'allow') AS verdict
FROM r LEFT JOIN o ON o.page_id = r.page_id AND o.place = 1
"""
)
def op5_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judged(table(spark, sf, "pages"), PAGE_RULES)


@query()
def op6_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Piece numbers of every whole text, and whether decoding them gives the text back."""
    model = sentencepiece.model_bytes()
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = sentencepiece.encoded(docs, model, back="decoded")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == sentencepiece.readable(F.col("text"))).alias("round_trip"),
    )


@query()
def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.judged(docs, toxicity.fit(docs, table(spark, sf, "labels")))


@query(
    r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
           FROM documents),
     q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
     r AS (SELECT d.doc_id, d.source, d.size,
                  -ln((CAST('0x' || substr(md5('mix/' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)
                  / CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS sampling_key
           FROM d LEFT JOIN q ON d.doc_id = q.doc_id),
     t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(3 * sum(size) AS BIGINT) AS cap,
                  1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
           FROM r GROUP BY source),
     lower AS (SELECT a.source, a.source_size, a.cap, a.w,
                      coalesce(sum(b.cap) FILTER (WHERE b.cap * a.w < a.cap * b.w), 0) AS spent,
                      sum(b.w) FILTER (WHERE b.cap * a.w >= a.cap * b.w) AS still, sum(b.source_size) AS every
               FROM t a, t b GROUP BY a.source, a.source_size, a.cap, a.w),
     c AS (SELECT *, w * (every - spent) > cap * still AS capped FROM lower),
     s AS (SELECT any_value(every) - coalesce(sum(cap) FILTER (WHERE capped), 0) AS num, sum(w) FILTER (WHERE NOT capped) AS den FROM c),
     g AS (SELECT source, source_size,
                  CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(w * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target
           FROM c, s),
     e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
     o AS (SELECT r.doc_id, r.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
                  sum(size) OVER (PARTITION BY r.source ORDER BY sampling_key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                  sum(size) OVER (PARTITION BY r.source, sampling_key) AS own
           FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN rest > 0 AND upto + upto - own <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o
"""
)
def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    made = mixing.plan(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return made.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


@query(
    r"""
WITH h AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h,
                  coalesce(strlen(text), 0) AS size FROM documents),
     e AS (SELECT doc_id, h, size, unnest(generate_series(0, 60)) AS d FROM h),
     p AS (SELECT doc_id, size, d, h >> CAST(60 - d AS INTEGER) AS prefix FROM e),
     s AS (SELECT d, prefix, CAST(sum(size) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY d, prefix),
     f AS (SELECT doc_id, p.d, p.prefix, shard_bytes, shard_rows, row_number() OVER (PARTITION BY doc_id ORDER BY p.d) AS place
           FROM p JOIN s ON p.d = s.d AND p.prefix = s.prefix WHERE shard_bytes <= 1048576 OR shard_rows = 1)
SELECT doc_id, CASE WHEN d > 0 THEN lpad(bin(prefix), CAST(d AS INTEGER), '0') ELSE '' END AS shard, CAST(d AS BIGINT) AS depth, shard_bytes, shard_rows
FROM f WHERE place = 1
"""
)
def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length("text")
    docs = table(spark, sf, "documents")
    shards = sharding.write_shards(docs, scratch_path(spark, "shards"), "doc_id", size)
    return sharding.digest(shards, "doc_id", size, sharding.added(docs.columns)[0])


@query()
def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf, "documents"))


@query(
    r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
     p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
     i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
     g AS (SELECT lang, 1 AS words, w[i] AS phrase FROM i
           UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM i WHERE i + 1 <= len(w)
           UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM i WHERE i + 2 <= len(w)),
     f AS (SELECT lang, words, phrase, count(*) AS a FROM g GROUP BY lang, words, phrase),
     n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
     c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words >= 2 AND a >= 10),
     k AS (SELECT lang, words, phrase, a, w[1] AS one, array_to_string(w[2:], ' ') AS two, 1 AS k FROM c
           UNION ALL SELECT lang, words, phrase, a, array_to_string(w[:2], ' '), w[3], 2 FROM c WHERE words = 3),
     s AS (SELECT k.lang, k.words, k.phrase, k.a, k.k, l.a AS l, r.a AS r,
                  CAST((CAST(1000000 AS HUGEINT) * k.a * k.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
           FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.one JOIN f r ON r.lang = k.lang AND r.phrase = k.two),
     b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s),
     m AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE words = 3
                                                    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE words = 3) GROUP BY lang, phrase),
     o AS (SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score,
                  row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
           FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE b.cut = 1 AND NOT coalesce(100 * m.most >= 50 * b.a, false))
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""
)
def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


@query(
    r"""
WITH l AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     e AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS p FROM l),
     k AS (SELECT r, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
     c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
     m AS (SELECT k.r, k.p, k.line, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON c.key = k.key),
     t AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
                  coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM l JOIN t USING (r)
"""
)
def op12_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    made = line_dedup.cleaned(docs, line_dedup.built(docs))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(
    r"""
WITH RECURSIVE bits(i, k, v) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
                       UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
     crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
     r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
                  translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
           FROM documents),
     x AS (SELECT run, hex(encode(id || ':' || run)) AS x FROM r),
     h AS (SELECT run, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
                                       lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS BIGINT) + 1])), 4294967295) AS h FROM x, crc),
     w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
     v AS MATERIALIZED (SELECT word, count(*) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
     s AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
     c AS MATERIALIZED (SELECT word, n, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM s),
     p AS (SELECT x.word, y.word AS near, y.n AS near_n FROM c x JOIN c y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
           UNION SELECT c.word, v.word, v.n FROM c JOIN v ON v.word = c.a || c.b
           UNION SELECT v.word, c.word, c.n FROM c JOIN v ON v.word = c.a || c.b),
     o AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM p),
     f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form,
                  CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM v LEFT JOIN o ON o.word = v.word AND place = 1),
     u(word, root, depth) AS (SELECT word, word, 0 FROM f
                              UNION ALL SELECT u.word, f.form, depth + 1 FROM u JOIN f ON f.word = u.root WHERE f.form IS NOT NULL),
     z AS (SELECT word, max_by(root, depth) AS root FROM u GROUP BY word)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN z ON z.word = f.word
"""
)
def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf, "documents"))
    return spelling.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
