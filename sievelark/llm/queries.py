"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelark.llm import (
    clusters, infill, language, leaks, licences, mixing, neardup, pages, quotes, tokens, toxicity, vectors, warc,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(table(spark, sf_dir, "documents"), vocabulary())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, language.learnable(table(spark, sf_dir, "labels")))
    found = toxicity.score(docs, model, out="score")
    return found.select("doc_id", language.held_out().alias("held_out"), "score",
                        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked_conversations(table(spark, sf_dir, "conversations"))


def quoting_conversations(conversations: DataFrame) -> DataFrame:
    """The given conversations, every third turn quoting the first sentence of the turn before it."""
    before = Window.partitionBy("conv_id").orderBy("turn")
    first = F.split(F.trim(F.regexp_replace(F.lag("text").over(before), r"\s+", " ")), r"(?<=[.!?]) ", 2)[0]
    quoted = F.when((F.col("turn") % 3 == 1) & (first != ""), F.concat(F.lit("> "), first, F.lit("\n"), "text"))
    return conversations.select("conv_id", "turn", "role", F.coalesce(quoted, "text").alias("text"))


def quote_links_of_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation linking where it has something to link: conversations derived from the given ones."""
    found = quotes.linked_conversations(quoting_conversations(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "turn", "text", "reply_to", "thread", "depth", "n_quotes", "n_linked")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(language.learnable(docs))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out().alias("held_out"), "language.*")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.build_derivatives(warc.responses(table(spark, sf_dir, "pages")), "page_id")
    return records.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type",
                          "headers", F.decode("block", "UTF-8").alias("block"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op9_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.jaccard_classes(table(spark, sf_dir, "documents"))


def op10_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_table(table(spark, sf_dir, "embeddings"))


def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_table(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_token_blocks, op2_toxicity, op3_quote_links, quote_links_of_replies, op4_language, op5_nearest, op6_warc_derivatives, op7_main_text,
    op8_mixture, op9_jaccard_classes, op10_leaks, op11_infill, op12_clusters, op13_licences, pipeline)}


def _shingles(table: str, key: str) -> str:
    words = r"list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '')"
    return f"""
      SELECT DISTINCT {key}, unnest(CASE
          WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
          ELSE [array_to_string(w, ' ')] END) AS s
      FROM (SELECT {key}, {words} AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) > 0"""


def _lloyd(rounds: int, k: int) -> str:
    """Rounds of exact integer clustering, a pair of common tables each."""
    parts = [f"""
      kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
      c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, v AS c FROM kept
             ORDER BY sha256('2:' || vec_id) LIMIT {k})"""]
    for n in range(rounds + 1):
        parts.append(f"""
      a{n} AS MATERIALIZED (SELECT DISTINCT ON (vec_id) * FROM (
        SELECT vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM kept, c{n}) ORDER BY vec_id, d, cluster)""")
        if n < rounds:
            parts.append(f"""
      c{n + 1} AS MATERIALIZED (SELECT c{n}.cluster, coalesce(m.c, c{n}.c) AS c FROM c{n} LEFT JOIN (
        SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
          SELECT cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{n}, range(1, 65) AS t(i) GROUP BY 1, 2)
        GROUP BY 1) AS m ON m.cluster = c{n}.cluster)""")
    return "WITH" + ",".join(parts)


ORACLES = {
    # The given conversations quote nothing; this is what the operator gives then. Quotes are tested in tests/llm.
    "op3_quote_links": r"""
      SELECT conv_id, turn, role, text, CAST(NULL AS BIGINT) AS reply_to, turn AS thread, CAST(0 AS INTEGER) AS depth,
        CAST(0 AS BIGINT) AS n_quotes, CAST(0 AS BIGINT) AS n_linked,
        concat('<|', coalesce(role, 'unknown'), '|>', chr(10), coalesce(text, ''), chr(10), '<|end|>') AS formatted
      FROM conversations WHERE (SELECT count(*) FROM conversations WHERE regexp_matches(text, '(^|\n)[ \t]*>')) = 0""",
    "quote_links_of_replies": r"""
      WITH RECURSIVE c AS (SELECT *, trim(regexp_replace(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '\s+', ' ', 'g')) AS p
                           FROM conversations),
      q AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 1 THEN p END AS quoted FROM
            (SELECT conv_id, turn, text, CASE WHEN p <> '' THEN CASE WHEN regexp_matches(p, '[.!?] ')
               THEN regexp_extract(p, '^(.*?[.!?]) ', 1) ELSE p END END AS p FROM c)),
      pieces AS (SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(unnest(list_concat([text], regexp_split_to_array(text, '\n'),
                   regexp_split_to_array(text, '\n[ \t]*\n'), string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')),
                   '([.!?\x{2026}\x{3002}]) ', '\1' || chr(1), 'g'), chr(1))))), '\s+', ' ', 'g')) AS piece
                 FROM conversations WHERE text IS NOT NULL),
      r AS (SELECT q.conv_id, q.turn, max(o.turn) AS reply_to FROM q JOIN pieces o ON o.conv_id = q.conv_id AND o.turn < q.turn
              AND o.piece = lower(q.quoted) GROUP BY 1, 2),
      t AS (SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM r
            UNION ALL SELECT t.conv_id, t.turn, r.reply_to, t.depth + 1 FROM t JOIN r ON r.conv_id = t.conv_id AND r.turn = t.thread),
      d AS (SELECT conv_id, turn, min(thread) AS thread, max(depth) AS depth FROM t GROUP BY 1, 2)
      SELECT q.conv_id, q.turn, CASE WHEN coalesce(quoted, '') <> '' THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE text END AS text, r.reply_to,
        coalesce(d.thread, q.turn) AS thread, CAST(coalesce(d.depth, 0) AS INTEGER) AS depth,
        CAST(CASE WHEN coalesce(quoted, '') <> '' THEN 1 ELSE 0 END AS BIGINT) AS n_quotes,
        CAST(CASE WHEN r.reply_to IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_linked
      FROM q LEFT JOIN r ON r.conv_id = q.conv_id AND r.turn = q.turn LEFT JOIN d ON d.conv_id = q.conv_id AND d.turn = q.turn""",
    "op9_jaccard_classes": f"""
      WITH RECURSIVE s AS ({_shingles("documents", "doc_id")}),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
      shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
                 GROUP BY 1, 2),
      linked AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
                 WHERE 1.8 * c >= 0.8 * (a.n + b.n) - 1e-6),
      reach AS (SELECT doc_id, doc_id AS root FROM documents
                UNION SELECT linked.y, reach.root FROM reach JOIN linked ON linked.x = reach.doc_id)
      SELECT doc_id, min(root) AS class_id, any_value(coalesce(k, 0)) AS n_links
      FROM reach LEFT JOIN (SELECT x, count(*) AS k FROM linked GROUP BY 1) ON x = doc_id GROUP BY doc_id""",
    "op10_leaks": f"""
      WITH d AS ({_shingles("documents", "doc_id")}), i AS ({_shingles("benchmark", "item_id")}),
      n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY 1)
      SELECT doc_id, item_id, count(*) AS n_shared, n_shingles, count(*) / n_shingles AS containment
      FROM d JOIN i USING (s) JOIN n USING (item_id)
      GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles - 1e-9""",
    "op11_infill": r"""
      WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
      g AS (SELECT doc_id, text, length(text) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
              CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3,
              CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
      c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
              CASE WHEN n = 0 OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain'
                   WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
      p AS (SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM c)
      SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
        sha256(text) AS restored_sha256 FROM p""",
    "op12_clusters": f"""{_lloyd(clusters.ROUNDS, clusters.K)}
      SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
        CAST(sum(d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c, ',')) AS centroid_sha256
      FROM a{clusters.ROUNDS} AS a JOIN c{clusters.ROUNDS} AS c ON c.cluster = a.cluster""",
}
