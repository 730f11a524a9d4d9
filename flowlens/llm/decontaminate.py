"""Benchmark decontamination: a prefix-filtered set join of item windows with document words. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, fold_ascii, stage

#: What is no word character: ASCII but for digits and letters. Texts are lower-cased before.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _split(text: Column) -> Column:
    """The words, behind one empty string; after a trailing gap another empty string ends them."""
    return F.split(F.concat(F.lit(" "), fold_ascii(text)), GAP)


def item_windows(items: DataFrame, *, item_col: str, text_col: str, size: int) -> DataFrame:
    """item_id (string), words: each distinct run of size words of an item, or all words of a shorter one."""
    words = F.filter(_split(F.col(text_col)), lambda w: w != "")
    it = items.select(F.col(item_col).cast("string").alias("item_id"), words.alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(size - 1))))
    return it.select("item_id", "w", at.alias("at")).select("item_id", F.slice("w", F.col("at"), F.lit(size)).alias("words")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10) -> DataFrame:
    """One row per document: the id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is an ordered set of words that must occur whole, so at full containment one prefix token is
    enough: its rarest word, by counts over all documents (ties: the word itself). Each document word
    probes the prefix tokens; a match at an offset fixes the window's place (positional bound), places
    that would stick out of the document fall away (length bound), and the item-sized slice of the
    document is compared word by word. The probing runs inside one scan; only documents and true
    occurrences are shuffled, by document. Prefix tables of up to BROADCAST_BYTES are broadcast; larger
    ones are joined by a shuffle of words, each with its own small context.

    Null texts have no words; items without words have no windows; null item_ids are left out of n_items.
    An empty benchmark or documents table works. Rows that repeat an id and a text each get their row.
    Very long texts are arrays of their words; other columns, whatever their names, are not read.
    """
    windows = stage(item_windows(items, item_col=item_col, text_col=item_text_col, size=size), "decon-windows")
    n_bytes, = windows.select(F.coalesce(F.sum(F.expr("aggregate(words, 0L, (a, w) -> a + octet_length(w) + 24)")), F.lit(0)).alias("b")).first()
    small = n_bytes * 2 <= BROADCAST_BYTES
    hint = F.broadcast if small else (lambda df: df)

    # the arrays are never empty; the outer forms keep Catalyst from splitting twice to filter empty ones
    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"), _split(F.col(text_col)).alias("ws"))
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    seen = split.select(F.explode_outer("ws").alias("word")).join(hint(vocabulary), "word", "left_semi")
    counts = stage(seen.groupBy("word").agg(F.count(F.lit(1)).alias("freq")), "decon-counts")
    # prefix tokens by rarity: a word that no document has rules its window out, so the inner join may drop it
    spread = windows.select("words", F.posexplode("words").alias("off", "word")).distinct()
    absent = spread.join(counts, "word", "left_anti").select("words").distinct()
    rare = spread.join(absent, "words", "left_anti").join(counts, "word").groupBy("words").agg(F.min(F.struct("freq", "word", "off")).alias("first"))
    prefix = stage(rare.select(F.col("first.word").alias("word"), F.col("first.off").alias("off"), "words"), "decon-prefix")

    at = (F.col("pos") - F.col("off")).alias("at")
    probe = split.select("id", "th", "ws", F.posexplode_outer("ws").alias("pos", "word"))
    if small:
        place, found = F.slice("ws", F.col("at") + 1, F.size("words")), probe.join(hint(prefix), "word").select("id", "th", "ws", "words", at)
    else:  # each word takes the words around it along, not its document
        context = F.slice("ws", F.greatest(F.lit(1), F.col("pos") + 2 - size), F.lit(2 * size))
        found = probe.select("id", "th", "pos", "word", context.alias("ws")).join(prefix, "word").select("id", "th", "ws", "words", "pos", at)
        place = F.slice("ws", F.col("at") + 2 - F.greatest(F.lit(1), F.col("pos") + 2 - size), F.size("words"))
    inside = F.when(F.col("at") >= 1, place == F.col("words")).otherwise(False)
    hits = found.where(inside).select("id", "th", "at", "words").distinct()

    by_window = windows.groupBy("words").agg(F.collect_set("item_id").alias("items"))  # bounded by the items
    hits = hits.join(hint(by_window), "words").select("id", "th", "at", F.size("words").alias("len"), "items")
    # one document's occurrences lie within its own words: its group is bounded by its length
    per_doc = hits.groupBy("id", "th").agg(F.collect_set(F.struct("at", "len")).alias("occ"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("occ", lambda o: F.sequence(o["at"], o["at"] + o["len"] - 1))))).cast("long")
    per_doc = per_doc.select(F.col("id").alias("hid"), F.col("th").alias("hth"), covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.concat_ws(",", F.array_sort("items")).alias("ids"))
    n_words = (F.size("ws") - 1 - F.when(F.element_at("ws", -1) == "", 1).otherwise(0)).cast("long")
    each = split.select("id", "th", n_words.alias("n_words"))
    out = each.join(per_doc, each["id"].eqNullSafe(per_doc["hid"]) & (each["th"] == per_doc["hth"]), "left")
    none = F.lit(0).cast("long")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item, windows of 10 words."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
occ AS (
  SELECT p.doc_id, p.i, win.n, win.item_id FROM p CROSS JOIN sizes
  JOIN win ON win.n = sizes.n AND array_to_string(list_slice(p.w, p.i, p.i + sizes.n - 1), ' ') = win.s
  WHERE p.i + sizes.n - 1 <= len(p.w)
), hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM occ) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
