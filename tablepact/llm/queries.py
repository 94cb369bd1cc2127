"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.llm.decontaminate import find_contamination
from tablepact.llm.embedding_dedup import near_embeddings
from tablepact.llm.filter_audit import audit_filters
from tablepact.llm.hard_negatives import mine_hard_negatives
from tablepact.llm.language_id import held_out, identify_languages, learn_from_documents
from tablepact.llm.licenses import scan_licenses
from tablepact.llm.line_dedup import dedup_lines
from tablepact.llm.mixing import plan_mix
from tablepact.llm.packing import pack
from tablepact.llm.pii import BASE_KINDS, find_pii, written
from tablepact.llm.quality import score_quality
from tablepact.llm.repeats import remove_repeats
from tablepact.llm.shared import table
from tablepact.llm.simhash import fingerprint_text, near_duplicates

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: The tokenizer of the packing query; installed at the same place on every executor.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = find_pii(table(spark, folder, "documents").select("doc_id", "text"))
    of_kind = lambda kind: lambda span: span["kind"] == kind
    numbers = [F.size(F.filter("base", of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(
        "doc_id",
        *numbers,
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(table(spark, folder, "documents"), TOKENIZER)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM split),
keyed AS (SELECT *, translate(trim(line, concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))),
    '{CAPITALS}', '{SMALL}') AS key FROM lines),
kept AS (SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
    GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT keyed.*, coalesce(keeper <> doc_id, false) AS lost FROM keyed LEFT JOIN kept USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = identify_languages(docs.select("doc_id", "text"), learn_from_documents(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: Words of the passages that op5 tells of beside what it removes: over 50.
OP5_PASSAGE = 51


def op5_repeats(spark: SparkSession, folder: str) -> DataFrame:
    done = remove_repeats(table(spark, folder, "documents").select("doc_id", "text"), passage=OP5_PASSAGE)
    return done.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "n_passage_words"
    )


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP6_SQL = rf"""
WITH texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
worded AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
windows AS (SELECT DISTINCT id AS item_id, list_aggregate(words[p + 1:p + 10], 'string_agg', ' ') AS phrase, least(len(words), 10) AS size
    FROM (SELECT *, unnest(range(greatest(1, len(words) - 9))) AS p FROM worded WHERE side = 1 AND len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
stretches AS (SELECT id AS doc_id, p, size, list_aggregate(words[p + 1:p + size], 'string_agg', ' ') AS phrase
    FROM (SELECT *, unnest(range(len(words) - size + 1)) AS p FROM worded, sizes WHERE side = 0 AND len(words) >= size)),
found AS (SELECT doc_id, p, size, item_id FROM stretches JOIN windows USING (size, phrase)),
hits AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS w FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT id AS doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN hits ON id = hits.doc_id LEFT JOIN items ON id = items.doc_id WHERE side = 0
"""

def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", fingerprint_text(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    scanned = scan_licenses(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda f: f["base"])
    starts = F.transform(base, lambda f: f["first"])
    names = F.array_sort(F.array_distinct(F.transform(base, lambda f: f["label"])))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(names, ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_embeddings(table(spark, folder, "embeddings"))


OP10_SQL = """
WITH RECURSIVE vectors AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT r, vec_id, list_transform(e, lambda x: coalesce(x, 0)) AS e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM vectors
    WHERE e IS NOT NULL AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(e, lambda x: x <> 0))),
links AS (SELECT a.r, a.vec_id AS a, b.vec_id AS b FROM good AS a JOIN good AS b
    ON a.r <> b.r AND list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.9),
counts AS (SELECT r, count(*) AS n FROM links GROUP BY r),
reached AS (SELECT vec_id AS id, vec_id AS start FROM vectors UNION SELECT b, start FROM reached JOIN links ON id = a),
least AS (SELECT id, min(start) AS component_id FROM reached GROUP BY id)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM vectors JOIN least ON vec_id = id LEFT JOIN counts USING (r)
"""



def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.select("vec_id", "embedding", turned.alias("label")), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH units AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS u FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
scores AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.u, b.u) AS BIGINT) AS score
    FROM units AS a JOIN units AS b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor, anchor_id, vec_id, score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place
    FROM scores WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY anchor, place ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
    n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives AS p JOIN scores AS n USING (anchor)
WHERE NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score QUALIFY rank <= 3
"""


def op12_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = plan_mix(table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP13_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts JOIN firsts USING (text)),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masked AS (SELECT part, good, toxic, CAST(len(words) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS INTEGER)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(first < doc_id, false) AS INTEGER) AS mask
    FROM worded LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM masked GROUP BY part, mask),
filters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)),
orders AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM filters AS a, filters AS b, filters AS c, filters AS d, filters AS e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT mask, filter_order, coalesce(min(strpos(filter_order, letter)) FILTER (WHERE mask & bit <> 0), 6) AS gone
    FROM (SELECT unnest(range(32)) AS mask), orders, filters GROUP BY mask, filter_order),
worth AS (SELECT part, letter, sum(n) AS shapley FROM counts JOIN steps USING (mask) JOIN filters ON letter = filter_order[gone] GROUP BY part, letter),
rows AS (SELECT part, filter_order, s.step, letter, bit FROM (SELECT DISTINCT part FROM counts), orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) AS s
    JOIN filters ON letter = filter_order[s.step])
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (WHERE gone > step), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE gone = step), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE gone < step AND mask & bit <> 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (WHERE gone = step), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE gone = step), 0) AS BIGINT) AS toxic_lost,
    CAST(coalesce(any_value(shapley), 0) AS BIGINT) AS shapley
FROM rows JOIN counts USING (part) JOIN steps USING (mask, filter_order) LEFT JOIN worth USING (part, letter) GROUP BY part, filter_order, step
"""

QUERIES = {
    "op1_pii": op1_pii,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_id": op4_language_id,
    "op5_repeats": op5_repeats,
    "op6_decontamination": op6_decontamination,
    "op7_simhash": op7_simhash,
    "op8_license_scan": op8_license_scan,
    "op9_quality": op9_quality,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_mixing": op12_mixing,
    "op13_filter_audit": op13_filter_audit,
}

#: SQL with the same result. The other operators have none: they are tested against brute force.
SQL = {
    "op3_line_dedup": OP3_SQL,
    "op6_decontamination": OP6_SQL,
    "op10_embedding_dedup": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}
