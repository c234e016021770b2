"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed size. Distinct blocks are sorted and get
integer names; then adjacent names are paired and the pairs sorted and named,
again and again, until one name stands for each text. Two texts have the same
(number of blocks, name) exactly when they are equal: names come from whole
blocks and whole pairs, never from a digest alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, no_spaces, private_name, settle

#: Characters in a block.
BLOCK = 4_096


def _named(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`distinct` with an integer name for each row: its task and its place among that task's sorted rows. Written once, so that names hold."""
    return settle(distinct.sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id()), "names")


def block_identity(docs: DataFrame, text: str = "text", *, block: int = BLOCK, row: str | None = None) -> DataFrame:
    """`docs` plus `n_blocks`, `identity`, `code_points` and `text_sha256` of the text without white space, and with `row` a number of that name for each row.

    Written as a table without the column `text`, which cuts the lineage. A key
    that holds many rows (a block that many texts share) is split where it is
    joined, by the adaptive skew join: nothing else stands in those stages. Null counts as the empty
    text, which has one (empty) block. (`n_blocks`, `identity`) are equal for
    exactly the equal texts. Repeated rows and rows of equal or null ids keep
    apart. An empty table gives an empty one.
    """
    keep, row = row is not None, row or private_name(docs, "row")
    parts, pos, name = (private_name(docs, x) for x in ("parts", "pos", "name"))
    norm = private_name(docs, "norm")
    texts = docs.withColumn(norm, no_spaces(F.col(text)))
    whole = F.when(F.col(norm) == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    # distinct blocks: the one exchange that moves text, after each task has dropped its own repeats
    blocks = texts.select(F.explode(whole).alias("b")).distinct()
    names = _named(blocks.withColumn("h", F.md5("b")), ["b"], name).select("h", "b", name)
    # a digest may stand for a block in the join below only if no other distinct block has it
    shared = names.groupBy("h").count().filter("count > 1")
    if not shared.isEmpty():
        raise ValueError("two different blocks share a 128-bit digest: use another block size")
    slim = texts.withColumns({
        "code_points": F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long"),
        "text_sha256": F.sha2(norm, 256),
        parts: F.transform(whole, lambda b: F.md5(b)),
        "n_blocks": F.size(whole),
        row: F.monotonically_increasing_id(),
    })
    slim = settle(slim.drop(text, norm), "dedup-rows")
    level = slim.select(row, "n_blocks", F.posexplode(parts).alias(pos, "h")).join(names.select("h", name), "h").select(row, "n_blocks", pos, name)
    longest, trash = slim.agg(F.max("n_blocks")).first()[0] or 1, []
    if longest > 1:
        level = settle(level, "level")
        trash.append(level)
    # a text of one block keeps that block's name; all others pair neighbours until one name is left
    done = level.filter("n_blocks = 1").select(row, name)
    level = level.filter("n_blocks > 1")
    while longest > 1:
        at = lambda k: F.max(F.when(F.col(pos) % 2 == k, F.col(name)))  # noqa: B023, E731
        pairs = level.groupBy(row, F.shiftright(pos, 1).alias(pos)).agg(at(0).alias("a"), F.coalesce(at(1), F.lit(-1).cast("long")).alias("b"))
        pairs = settle(pairs, "pairs")
        named = _named(pairs.select("a", "b").distinct(), ["a", "b"], name)
        level = settle(pairs.join(named, ["a", "b"]).select(row, pos, name), "level")
        trash += [pairs, named, level]
        longest = (longest + 1) // 2
    last = done.unionByName(level.select(row, name)) if trash else done
    out = slim.drop(parts).join(last.select(row, F.col(name).alias("identity")), row)
    out = settle(out, "identity")
    discard(docs.sparkSession, slim, names, *trash)
    return out if keep else out.drop(row)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, block: int = BLOCK) -> DataFrame:
    """One row per document: `doc_id`, `keep_id`, `group_size`, `kept`, `text_sha256`.

    Of equal texts the row with most code points in the original, then the
    smallest doc_id, stays. A null doc_id sorts after all others. Of rows equal
    in both, one stays; which one makes no difference to the result.
    """
    named = block_identity(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", block=block, row="row")
    # the last field tells rows apart that tie in all else
    order = F.struct(-F.col("code_points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    keys = ["n_blocks", "identity"]
    # written first, so that nothing but the join stands behind its exchanges and a group of many rows can be split there
    groups = settle(named.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best")), "groups")
    out = named.join(groups, keys)
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text and any other columns) with one row of each group of equal texts, the one that `exact_duplicates` keeps."""
    sha, gone_id, gone_sha, nth = (private_name(docs, x) for x in ("sha", "gone_id", "gone_sha", "nth"))
    decided = exact_duplicates(docs)
    keys = settle(decided.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "dedup-keys")
    gone = keys.filter("NOT kept").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha))
    marked = docs.withColumn(sha, F.sha2(no_spaces(F.col("text")), 256))
    out = marked.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(sha) == F.col(gone_sha)), "left_anti")
    if not keys.filter("kept AND n > 1").isEmpty():  # repeated rows: the longest text of each stays
        best = Window.partitionBy("doc_id", sha).orderBy(-F.char_length("text"), F.xxhash64("text"))
        out = out.withColumn(nth, F.row_number().over(best)).filter(F.col(nth) == 1).drop(nth)
    return out.drop(sha)


def op10_block_naming(spark, sf_dir: str) -> DataFrame:
    """All documents: of each group of equal texts, which stays, and how many it has. A null text counts as empty."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_W = r"[\x20\x09-\x0D]"
OP10_SQL = rf"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS cp, sha256(regexp_replace(coalesce(text, ''), '{_W}', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id NULLS LAST)
"""
