"""The registered queries of this subpackage: one for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, exact_dedup, filter_audit, html_text, language, lm_score, ngram_join, prefix_trie, simhash, substring_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), *bpe.default_paths())


def bucket(n: int, column: str = "id"):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages"), keep=("url",))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    n_kept = F.octet_length("kept").cast("long")
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - n_kept).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "'</s>[INST] ok [/INST]'"
    more = spark.sql(f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, {text} AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    messages = chat_format.fold_events(chat_format.plain_events(rows.unionByName(more)), regenerates=False)
    read = chat_format.read_back(chat_format.render(messages))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.withColumn("said", said).withColumn("loss", F.array_join("learned", ""))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.score(table(spark, sf_dir, "documents"), bucket(5, "doc") != 1, *bpe.default_paths())
    return out.select("doc_id", (bucket(5, "doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), bucket(5) != 0)
    return toxicity.score(docs, model).select("doc_id", (bucket(5, "doc_id") == 0).alias("held_out"), "score", "predicted")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, bucket(4) != 2)
    return language.predict(docs, model).select("doc_id", (bucket(4, "doc_id") == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_html_text": op2_html_text,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_chat_format": op4_chat_format,
        "op5_ngram_join": op5_ngram_join,
        "op6_lm_score": op6_lm_score,
        "op7_decontaminate": op7_decontaminate,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_language": op10_language,
        "op11_simhash": op11_simhash,
        "op12_filter_audit": op12_filter_audit,
        "op13_prefix_trie": op13_prefix_trie,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": OP4_SQL, "op5_ngram_join": OP5_SQL, "op7_decontaminate": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op12_filter_audit": OP12_SQL, "op13_prefix_trie": OP13_SQL}


OP8_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
     r AS (SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""

OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
     e AS (SELECT *, 8 + length(replace(replace(replace(replace(role, '\', '\e'), '<', '\l'), '[', '\b'), chr(10), '\n')) + 1
                     + length(replace(replace(replace(text, '\', '\e'), '<', '\l'), '[', '\b')) + 8 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


#: Every alignment that has a word in common is looked at, without masks.
OP7_SQL = r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
     b AS (SELECT item_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark),
     dw AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS n FROM d),
     bw AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS n, least(13, len(ws)) AS size FROM b),
     a AS (SELECT dw.id AS doc_id, bw.id AS item_id, dw.n - bw.n AS shift FROM dw JOIN bw ON dw.w = bw.w GROUP BY ALL HAVING count(*) >= ceil(max(size) * 0.75)),
     s AS (SELECT a.doc_id, a.item_id, a.shift, bw.n, CASE WHEN dw.w = bw.w THEN 1 ELSE 0 END AS same
           FROM a JOIN bw ON bw.id = a.item_id LEFT JOIN dw ON dw.id = a.doc_id AND dw.n = bw.n + a.shift),
     r AS (SELECT *, sum(same) OVER (PARTITION BY doc_id, item_id, shift ORDER BY n ROWS 12 PRECEDING) AS n_equal,
                  least(13, count(*) OVER (PARTITION BY doc_id, item_id, shift)) AS n_window FROM s)
SELECT doc_id, item_id, CAST(max(n_window) AS BIGINT) AS n_window, CAST(max(n_equal) AS BIGINT) AS n_equal
FROM r GROUP BY doc_id, item_id HAVING max(n_equal) >= ceil(max(n_window) * 0.75)
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
     l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
     r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""

OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
     w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
     q AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
     m AS (SELECT w.part, coalesce(q.good, 0) AS good, coalesce(q.toxic, 0) AS toxic,
             CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
             || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), w.doc_id IS NULL AND min(w.doc_id) OVER (PARTITION BY text) IS NOT NULL) THEN 'E' ELSE '' END AS fails
           FROM w LEFT JOIN q ON q.doc_id = w.doc_id),
     c AS (SELECT part, fails, good, toxic, count(*) AS n FROM m GROUP BY ALL),
     f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
     o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
     s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS x, filter_order[1:step - 1] AS before FROM o, range(1, 6) r(step)),
     r AS (SELECT part, filter_order, step, x, n, good, toxic, contains(fails, x) AS failing, fails = x AS alone,
             before = '' OR translate(fails, before, '') = fails AS there FROM c, s),
     k AS (SELECT part, filter_order, step, x,
             sum(CASE WHEN there AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN there AND failing THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN failing AND NOT there THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN there AND failing THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN there AND failing THEN n * toxic ELSE 0 END) AS toxic_lost
           FROM r GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM k
"""

#: crc32 by its table of 256 values; a node is the list of its turns.
OP13_SQL = r"""
WITH RECURSIVE crc_table(i, v, s) AS (SELECT range, range, 0 FROM range(256) UNION ALL
       SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, s + 1 FROM crc_table WHERE s < 8),
     turns AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
     crc(c, digits, v, n) AS (SELECT c, CAST(c AS VARCHAR), CAST(4294967295 AS BIGINT), 1 FROM (SELECT DISTINCT c FROM turns) UNION ALL
       SELECT crc.c, digits, xor(crc.v >> 8, t.v), n + 1 FROM crc JOIN crc_table t ON t.s = 8 AND t.i = xor(crc.v, CAST(ascii(digits[n]) AS BIGINT)) & 255 WHERE n <= length(digits)),
     h AS (SELECT c, CAST(xor(v, 4294967295) % 9 AS BIGINT) AS h, c - c % 5 AS base FROM crc WHERE n > length(digits)),
     placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text[1:32], sha256(role || text)) AS k FROM turns),
     mixed AS (SELECT h.c, 0 AS own, k, role, text FROM h JOIN placed p ON p.c = h.base AND k <= h UNION ALL SELECT h.c, 1, k, role, text FROM h JOIN placed p ON p.c = h.c AND k > h),
     said AS (SELECT c, list({'role': role, 'text': text} ORDER BY own, k) AS seq FROM mixed GROUP BY c),
     seqs AS (SELECT h.c, coalesce(said.seq, []) AS seq FROM h LEFT JOIN said ON said.c = h.c),
     pre AS (SELECT c, seq[1:d] AS p, d, d = len(seq) AS ends FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM seqs)),
     node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256,
                CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(p[d].text) END AS saves FROM pre GROUP BY p, d),
     kids AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
     sub AS (SELECT n.p[1:u.d] AS p, sum(n.saves) AS saved_tokens, count(*) FILTER (k.n IS NULL) AS n_leaves
             FROM node n LEFT JOIN kids k ON k.p = n.p, LATERAL (SELECT unnest(range(0, n.d + 1)) AS d) u GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN sub s ON s.p = n.p LEFT JOIN kids k ON k.p = n.p LEFT JOIN node up ON n.d > 0 AND up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]
"""
