"""One query for each operator over its whole table, and SQL where SQL can express it."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.debruijn import substring_dedup
from tickloom.llm.exact_dedup import exact_dedup
from tickloom.llm.hmm import lm_scores
from tickloom.llm.hyperminhash import near_duplicates
from tickloom.llm.packing import pack
from tickloom.llm.periodic import periodic_runs, with_repeats
from tickloom.llm.quantised import near_vectors
from tickloom.llm.sentencepiece_wfst import decode, encode
from tickloom.llm.sharding import shard_rows
from tickloom.llm.token_counts import token_counts
from tickloom.llm.toxicity import toxicity
from tickloom.llm.warc import assemble_captures, read_warc, write_warc
from tickloom.llm.whitening import whiten
from tickloom.session import cut_lineage, shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op2_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWERED = WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{SMALL}')")
#: Components from links(x, y), both directions: reach(id, root) with all smaller or equal roots.
REACH = """
    reach AS (
        SELECT x AS id, x AS root FROM links
        UNION
        SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.id
    ),
    roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
"""


@query(
    "op3_warc",
    """
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
            sha1(coalesce(html, '')) AS payload_digest,
            max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id
        FROM pages
    )
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END
            AS record_type,
        CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
    FROM p
    """,
)
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(table(spark, folder, "pages"), path)
    # Written once: a capture's three kinds of record would read the archives each.
    records = cut_lineage(read_warc(spark, path, payloads=False))
    captures = assemble_captures(records).select(
        "capture_id",
        F.regexp_extract(F.col("metadata.payload").cast("string"), r"page-id: (-?\d+)", 1)
        .try_cast("long")
        .alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("refers_to_record"),
    )
    captures = cut_lineage(captures)
    target = captures.select(
        F.col("capture_id").alias("refers_to_record"), F.col("page_id").alias("refers_to")
    )
    revisits = captures.filter("record_type = 'revisit'").join(
        target.dropDuplicates(["refers_to_record"]), "refers_to_record", "left"
    )
    responses = captures.filter("record_type <> 'revisit'").withColumn(
        "refers_to", F.lit(None).cast("long")
    )
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return revisits.select(*names).unionByName(responses.select(*names))


@query(
    "op5_hyperminhash",
    f"""
    WITH RECURSIVE w AS (SELECT doc_id, {LOWERED} AS ws FROM documents),
    s AS (
        SELECT DISTINCT doc_id, shingle FROM (
            SELECT doc_id, unnest(CASE
                WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
            END) AS shingle FROM w)
    ),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
        FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
    ),
    links AS (
        SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
        WHERE 100 * c >= 80 * (a.n + b.n - c)
    ),
    {REACH}
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id,
        coalesce(root, d.doc_id) = d.doc_id AS kept
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN roots ON roots.id = d.doc_id
    """,
)
def op5_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query("op9_pattern_packing")
def op9_pattern_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query(
    "op7_de_bruijn",
    f"""
    WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
    win AS (
        SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)
    ),
    late AS (
        SELECT doc_id, s FROM win
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1
    ),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM late),
    word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
    kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
        FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
    )
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(ws) - coalesce(n, 0) AS n_removed,
        sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
    """,
)
def op7_de_bruijn(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substring_dedup(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_hmm")
def op4_hmm(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm_scores(table(spark, folder, "documents"), held_out)


@query(
    "op10_product_quantisation",
    f"""
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
    good AS (
        SELECT * FROM v WHERE x IS NOT NULL AND len(x) > 0 AND list_dot_product(x, x) > 0
            AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    ),
    links AS (
        SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b
        ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9
    ),
    degree AS (SELECT x, count(*) AS n FROM links GROUP BY x),
    {REACH}
    SELECT v.vec_id, coalesce(n, 0) AS n_links, coalesce(root, v.vec_id) AS component_id,
        coalesce(root, v.vec_id) = v.vec_id AS kept
    FROM v LEFT JOIN degree ON degree.x = v.vec_id LEFT JOIN roots ON roots.id = v.vec_id
    """,
)
def op10_product_quantisation(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = decode(encode(table(spark, folder, "documents"), model), model)
    return coded.select(
        "doc_id",
        F.size("ids").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" "))).alias(
            "round_trip"
        ),
    )


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(table(spark, folder, "documents"), path, ("source", "text"))


@query("op11_virtual_slots")
def op11_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    return shard_rows(table(spark, folder, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


@query("op12_whitening")
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    white = whiten(table(spark, folder, "embeddings"), components=4)
    return white.select(
        "vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained"))
    ).select(
        "vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", "col.whitened",
        "col.explained", "identity_error",
    )


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = F.when(h % 10 == 0, with_repeats(F.col("text"), F.expr("crc32(cast(string(doc_id) as binary)) div 10")))
    found = periodic_runs(docs.select("doc_id", text.otherwise(F.col("text")).alias("text")))
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"], r["period"]))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("most"), lines.alias("lines"), "collapsed"
    ).select(
        "doc_id", "n_runs", F.col("most.start").alias("start"), F.col("most.length").alias("length"),
        F.col("most.period").alias("period"),
        F.expr("most.length * 1000 div most.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("lines", lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
