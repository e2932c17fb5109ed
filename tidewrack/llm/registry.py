"""The corpus operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm import ann, bpe, license_scan, line_dedup, mixing, ngram_join, pieces, resampling, runs, sharding, token_counts, topk, toxicity
from tidewrack.llm.tables import table

#: The rank file that the queries use; operators take any path.
RANK_FILE = "byte_bpe_50k.tiktoken"
#: The model file of op12.
PIECE_FILE = "piece_bpe_32k.model"


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found by multiprobe hashing, for every vec_id divisible by 50."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products, for every vec_id divisible by 50."""
    return topk.search(table(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    path, pattern = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, path, pattern).drop("text")
    decoded = bpe.decode(encoded, path, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents by source weights takes of each."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a chain model that two thirds of the labels taught."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        toxicity.in_test_fold(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.transform("spans", lambda s: s["start"]).alias("span_starts"),
        F.transform("spans", lambda s: s["end"]).alias("span_ends"),
    )


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public licenses that every document names, with the share of the template that the best window holds."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    named = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], F.format_string("%d", F.round(x["containment"] * 1000).cast("int")), x["word"].cast("string")))
    return found.select("doc_id", "n_licenses", F.array_join(named, ",").alias("licenses"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after three edits, of which only the regions around the edits are encoded again.

    The edits follow from the document: a word goes in at a third of the text,
    twelve characters go at two thirds, and a sentence goes in at the end.
    """
    path, pattern = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    built = token_counts.build(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    size = F.coalesce(F.length("text"), F.lit(0))

    def edit(start, removed, inserted):
        return F.struct(start.cast("int").alias("start"), F.lit(removed).alias("removed"), inserted.alias("inserted"))

    changes = F.array(
        edit(F.floor(size / 3), 0, F.concat(F.lit(" edit"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        edit(F.floor(2 * size / 3), 12, F.lit("")),
        edit(2 * size + 100, 0, F.lit(" One more sentence stands here.")),
    )
    edited = token_counts.apply_edits(built.withColumn("edits", changes), path, pattern)
    return edited.select("doc_id", "n_tokens", "edited_tokens", F.size("leaf_chars").alias("n_leaves"), F.length("edited_text").cast("long").alias("edited_chars"), "encoded_chars")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document that match an earlier line of the corpus; their numbers from 0, joined by commas."""
    found = line_dedup.report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under Jaccard links of five-word shingles."""
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def with_periodic_ends(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the documents, by their ids, get an end that repeats some of their words.

    With h the crc32 of the id and g = floor(h / 10), these are the ones with
    h % 10 = 0: from word g % n on, the p words there repeat to the end, p = 1 +
    floor((n - a) / (3 + g % 8)). Rows without id or words stay.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    sized = chosen.withColumn("w", words).withColumn("n", F.size("w").cast("long"))
    placed = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    span = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    left = F.col("n") - F.col("a")
    ends = F.slice(F.flatten(F.array_repeat(span, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left.cast("int"))
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), ends), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document's words: their number, the strongest, and digests of the list and of the text without repeats."""
    found = runs.detect(with_periodic_ends(table(spark, sf_dir, "documents"))).drop("text")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's SentencePiece ids and of the text that they decode to."""
    path = public_tokenizers.path(PIECE_FILE)
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    decoded = pieces.decode(encoded, path)
    return decoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draw of 5 in 100 documents towards the benchmark texts: every document's weight, score and rank."""
    found = resampling.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_exact_topk": op2_exact_topk,
    "op3_bpe": op3_bpe,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_license": op6_license,
    "op7_token_counts": op7_token_counts,
    "op8_sharding": op8_sharding,
    "op9_line_dedup": op9_line_dedup,
    "op10_ngram_join": op10_ngram_join,
    "op11_runs": op11_runs,
    "op12_pieces": op12_pieces,
    "op13_resampling": op13_resampling,
}

_TEMPLATES = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in notice)) for notice in license_scan.NOTICES)

ORACLE_SQL: dict[str, str] = {
    "op6_license": f"""
        WITH templates(license, text) AS (VALUES {_TEMPLATES}), texts AS (
            SELECT 't' AS kind, row_number() OVER () AS id, license, text FROM templates
            UNION ALL SELECT 'd', doc_id, NULL, text FROM documents WHERE text IS NOT NULL
        ), words AS (
            SELECT kind, id, license, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM texts
        ), shingles AS (
            SELECT kind, id, license, i - 1 AS pos, array_to_string(w[i : i + 4], ' ') AS s FROM words, unnest(range(1, len(w) - 3)) AS r(i)
        ), wanted AS (
            SELECT DISTINCT id, license, s FROM shingles WHERE kind = 't'
        ), sizes AS (
            SELECT id, license, count(*) AS n, (4 ** (floor(log(count(*) + 0.5) / log(4)) + 1))::BIGINT AS step FROM wanted GROUP BY id, license
        ), hits AS (
            SELECT d.id AS doc_id, z.id AS template, z.license, z.n, z.step, d.pos // z.step - k AS win, d.s
            FROM shingles d JOIN wanted t ON d.s = t.s JOIN sizes z ON z.id = t.id, (VALUES (0), (1)) AS k(k) WHERE d.kind = 'd'
        ), shares AS (
            SELECT doc_id, license, count(DISTINCT s) / n AS share, greatest(win, 0) * step AS word FROM hits GROUP BY doc_id, template, license, n, step, win
        ), best AS (
            SELECT doc_id, license, arg_max({{'c': share, 'w': word}}, (share, -word)) AS b FROM shares WHERE share >= 0.75 GROUP BY doc_id, license
        ), listed AS (
            SELECT doc_id, count(*) AS n, string_agg(license || ':' || round(b.c * 1000)::INTEGER || ':' || b.w, ',' ORDER BY license) AS l FROM best GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n, 0)::INTEGER AS n_licenses, coalesce(l, '') AS licenses FROM documents d LEFT JOIN listed USING (doc_id)
    """,
    "op9_line_dedup": """
        WITH lines AS (
            SELECT doc_id, u.i - 1 AS line_no, trim(regexp_replace(lower(l[u.i]), '[ \\t\\x0B\\x0C\\r]+', ' ', 'g')) AS line
            FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i)
        ), placed AS (
            SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS place FROM lines WHERE line <> ''
        ), classes AS (
            SELECT line, min(place) AS first, string_split(line, ' ') AS w FROM placed GROUP BY line
        ), tokens AS (
            SELECT DISTINCT first, CASE WHEN len(w) < 5 THEN line ELSE array_to_string(w[i : i + 4], ' ') END AS s
            FROM classes, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i)
        ), sizes AS (
            SELECT first, count(*) AS n FROM tokens GROUP BY first
        ), common AS (
            SELECT a.first AS x, b.first AS y, count(*) AS c FROM tokens a JOIN tokens b ON a.s = b.s AND a.first < b.first GROUP BY a.first, b.first
        ), later AS (
            SELECT DISTINCT y AS first FROM common JOIN sizes p ON p.first = x JOIN sizes q ON q.first = y WHERE 100 * c >= 75 * (p.n + q.n - c)
        ), gone AS (
            SELECT doc_id, line_no FROM placed JOIN classes USING (line) WHERE place <> classes.first OR classes.first IN (SELECT first FROM later)
        ), listed AS (
            SELECT doc_id, count(*) AS n_removed, string_agg(line_no, ',' ORDER BY line_no) AS removed FROM gone GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::INTEGER AS n_lines, coalesce(n_removed, 0)::INTEGER AS n_removed, coalesce(removed, '') AS removed
        FROM documents d LEFT JOIN listed USING (doc_id)
    """,
    "op10_ngram_join": """
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
            FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i)
            WHERE len(w) > 0
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id
        ), links AS (
            SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
            WHERE 100 * c >= 75 * (p.n + q.n - c)
        ), reach AS (
            SELECT doc_id AS x, doc_id AS y FROM documents
            UNION
            SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
        )
        SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.c AS component_id
        FROM documents d LEFT JOIN sizes s USING (doc_id)
        JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = d.doc_id
    """,
    "op2_exact_topk": """
        WITH rows AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}
