"""Queries of the problems on texts and typed names (2, 7, 8, 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netledger.llm.encoding import fit_model, garbled_texts
from netledger.llm.leaks import leaked_passages, shared_runs
from netledger.llm.names import link_names, spelling_pairs
from netledger.llm.packing import CAPACITY, pack, token_pieces
from netledger.session import table


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [("transfer", "from_isp"), ("transfer", "to_isp"), ("irr", "isp"), ("vrp", "isp"), ("scored_irr", "isp")]
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("name")).distinct() for t, c in fields]
    names = parts[0]
    for p in parts[1:]:
        names = names.unionByName(p)
    return names.where(F.col("name").isNotNull() & (F.col("name") != "None"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_pairs(link_names(_names(spark, sf_dir)))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with its organisation (the least spelling of it) and the number of spellings: membership instead of pairs."""
    linked = link_names(_names(spark, sf_dir))
    groups = linked.groupBy("org").agg(F.min("name").alias("organisation"), F.count(F.lit(1)).alias("n_spellings"))
    return linked.join(groups, "org").select("name", "organisation", "n_spellings")


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents"), "doc_id", "text"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used beside the least number any packing needs, and the share of room left empty."""
    slots = p7_packing(spark, sf_dir)
    used = slots.agg(F.coalesce(F.max("container") + 1, F.lit(0)).alias("n_containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return used.select(
        "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / CAPACITY).alias("least_containers"),
        F.round(1 - F.try_divide(F.col("n_tokens"), F.col("n_containers") * CAPACITY), 6).alias("unused_share"),
    )


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each text with any token: its pieces are whole and follow each other, and none exceeds the capacity with what shares its container."""
    slots = p7_packing(spark, sf_dir)
    full = slots.groupBy("container").agg((F.sum("n_tokens") <= CAPACITY).alias("fits"), (F.max("position") + 1 == F.count(F.lit(1))).alias("placed"))
    after = Window.partitionBy("doc_id").orderBy("piece")
    steps = slots.join(full, "container").withColumns({"follows": F.coalesce(F.lag("byte_to").over(after) == F.col("byte_from"), F.col("byte_from") == 0), "number": F.row_number().over(after) - 1})
    texts = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size"))
    per = steps.groupBy("doc_id").agg(F.min(F.col("fits") & F.col("placed") & F.col("follows") & (F.col("number") == F.col("piece"))).alias("sound"), F.max("byte_to").alias("end"))
    return texts.where(F.col("size") > 0).join(per, "doc_id", "left").select("doc_id", F.coalesce(F.col("sound") & (F.col("end") == F.col("size")), F.lit(False)).alias("sound"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_runs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id").distinct()


def p8_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited copies of whole items, and passages of twelve and more words; of a pair found both ways the better score."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    both = leaked_passages(docs, items).unionByName(shared_runs(docs, items))
    best = F.max(F.struct("score", "same_words")).alias("best")
    found = both.groupBy("doc_id", "item_id").agg(best, F.max("longest_run").alias("longest_run"), F.max("item_words").alias("item_words"))
    return found.select("doc_id", "item_id", "best.score", "longest_run", "best.same_words", "item_words")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return garbled_texts(docs, fit_model(docs)).select("doc_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return garbled_texts(docs, fit_model(docs))


QUERIES = {f.__name__: f for f in (p2_found, p2_groups, p7_packing, p7_fill, p7_invariants, p8_found, p8_alignments, p9_found, p9_restored)}
ORACLE = {
    # every text is packed once, whole, in containers that hold it
    "p7_invariants": "SELECT doc_id, true AS sound FROM documents WHERE text <> ''",
    # words as five-word shingles would need; here whole windows of twelve words meet on equal text
    "p8_found": """WITH w AS (SELECT doc_id AS id, 'd' AS k, list_filter(regexp_split_to_array(lower(regexp_replace(text, '\\p{Cf}+', '', 'g')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM documents
  UNION ALL SELECT item_id, 'i', list_filter(regexp_split_to_array(lower(regexp_replace(text, '\\p{Cf}+', '', 'g')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') FROM benchmark),
g AS (SELECT id, k, unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i+11], ' '))) AS t FROM w WHERE len(ws) >= 12)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.t = i.t AND d.k = 'd' AND i.k = 'i'""",
}
