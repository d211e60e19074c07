"""The corpus-preparation queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.llm import entity_match, grouping, leakage, name_variants, term_counts, tokenizer, top_n
from kinweave.runtime import read

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_matches(spark, d).select("left_id", "right_id")


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    return entity_match.match_entities(read(spark, d, "companies_left"), read(spark, d, "companies_right"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.term_counts(read(spark, d, "companies_left"), "id", "current_name", "loaded_at", batches=2).marked()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n.top_n(read(spark, d, "suggestions"), 5)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return grouping.consolidate(read(spark, d, "matches"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.variant_pairs(name_variants.link_variants(read(spark, d, "board_names")))


def p6_bearers(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.link_variants(read(spark, d, "board_names"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return grouping.torn_groups(read(spark, d, "panel"), read(spark, d, "matches"))


def p7_split(spark: SparkSession, d: str) -> DataFrame:
    return grouping.grouped_split(read(spark, d, "panel"), read(spark, d, "matches"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(read(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, same): whether decoding a page's ids gives its text again."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    back = tokenizer.decode_corpus(tokenizer.encode_corpus(docs)).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("item_id", "doc_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the pages that hold no evaluation passage."""
    return leakage.without_leaks(read(spark, d, "documents").select("doc_id"), p9_leaks(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.split_oversized(read(spark, d, "documents")).filter(F.col("piece_no") == 1).select("doc_id")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.split_oversized(read(spark, d, "documents")).select("doc_id", "piece_no", "piece")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_matches, p3_found, p4_found, p5_found, p6_found, p6_bearers, p7_found, p7_split, p8_ids, p8_round_trip, p9_found, p9_leaks, p9_clean, p10_found, p10_pieces)}

_LINKS = 'SELECT "left" AS x, "right" AS y FROM matches WHERE "left" IS NOT NULL AND "right" IS NOT NULL'

SQL: dict[str, str] = {
    "p3_found": r"""
WITH named AS (SELECT id, arg_max(current_name, loaded_at) AS name FROM companies_left WHERE current_name IS NOT NULL GROUP BY id),
words AS (SELECT id, unnest(regexp_extract_all(lower(nfc_normalize(name)), '[\pL\pN]+')) AS term FROM named),
counted AS (SELECT term, count(*) AS occurrences, count(DISTINCT id) AS records FROM words GROUP BY term)
SELECT term, CASE WHEN records < 3 THEN 'rare' ELSE 'common' END AS mark, occurrences, records
FROM counted WHERE records < 3 OR records > 0.04 * (SELECT count(*) FROM named)""",
    "p4_found": """
WITH best AS (SELECT "left", "right", max(prediction) AS p FROM suggestions
              WHERE prediction BETWEEN 0 AND 1 AND NOT isnan(prediction) AND "left" IS NOT NULL AND "right" IS NOT NULL GROUP BY "left", "right")
SELECT "left", "right", row_number() OVER (PARTITION BY "left" ORDER BY p DESC, "right") AS place FROM best QUALIFY place <= 5""",
    "p5_found": f"""
WITH RECURSIVE l AS ({_LINKS}), e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(id, seen) AS (SELECT DISTINCT x, x FROM e UNION SELECT r.id, e.y FROM r JOIN e ON r.seen = e.x)
SELECT min(seen) AS group_id, id FROM r GROUP BY id""",
    "p7_found": f"""
WITH RECURSIVE l AS ({_LINKS}),
star AS (SELECT id AS x, min(id) OVER (PARTITION BY pid) AS y FROM panel WHERE pid IS NOT NULL),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l UNION SELECT x, y FROM star UNION SELECT y, x FROM star UNION SELECT id, id FROM panel),
r(id, seen) AS (SELECT DISTINCT x, x FROM e UNION SELECT r.id, e.y FROM r JOIN e ON r.seen = e.x),
g AS (SELECT id, min(seen) AS gid FROM r GROUP BY id),
torn AS (SELECT gid FROM panel JOIN g USING (id) GROUP BY gid HAVING count(DISTINCT old_split) > 1)
SELECT DISTINCT id FROM panel JOIN g USING (id) JOIN torn USING (gid)""",
}
