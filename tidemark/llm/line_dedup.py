"""Exact line deduplication across documents, carried out on hashes and keep bitmaps.

A line's key is the line without surrounding white space and with A-Z lowered. Only
(hash, document, position) rows are shuffled: they are placed by ranges of the hash, sorted by
document and position behind it, and the first holder of each key streams past first. What comes
back to the text is a run-length bitmap of the lines to keep, one row per changed document.

A key that a third of all documents hold does not meet in one task: its rows are first split by a
salt of the document, and only each salt's first holder goes on to the second, unsalted pass.

Defined results. NULL or empty text is one empty line. A NULL id sorts behind every other id and
all rows without an id count as one document. Rows that repeat an id are one document too: lines
common to them stay in each. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, UPPER, ascii_lower, partitions, repacked, row_key, table, written

MIN_CHARS = 10


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line long enough to count: the key's 128-bit hash, document and position."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    key = ascii_lower(F.trim("line", F.lit(SPACE)))
    return (
        docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("rid"),
                    F.posexplode(lines).alias("pos", "line"))
        .select("doc_id", "rid", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
                "doc_id", "rid", "pos")
    )


def _first_holder(rows: DataFrame, *group: str) -> DataFrame:
    """Mark the rows whose document is not the first of its group."""
    by_document = [F.col("doc_id").asc_nulls_last(), F.col("pos")]
    placed = rows.repartitionByRange(*group).sortWithinPartitions(*group, *by_document)
    first = F.first("doc_id").over(Window.partitionBy(*group).orderBy(*by_document))
    return placed.withColumn("lost", ~F.col("doc_id").eqNullSafe(first))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, rid, pos) of every line that an earlier document also holds."""
    salts = partitions(docs.sparkSession)
    salt = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(salts))
    rows = written(occurrences(docs, min_chars).withColumn("salt", salt), "lines")
    salted = written(_first_holder(rows, "h1", "h2", "salt"), "salted-lines")
    final = _first_holder(salted.where("not lost").drop("lost", "salt"), "h1", "h2")
    place = ["doc_id", "rid", "pos"]
    return salted.where("lost").select(place).unionAll(final.where("lost").select(place))


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """Per changed document the kept runs before its last dropped line, that line, and the count.

    Everything behind ``last`` is kept, so a bitmap needs no line count.
    """
    previous = F.lag("pos").over(Window.partitionBy("doc_id", "rid").orderBy("pos"))
    gap = F.col("pos") - F.coalesce("previous", F.lit(-1)) - 1
    run = F.when(gap > 0, F.struct((F.col("pos") - gap).alias("first"), gap.alias("length")))
    return (
        dropped.withColumn("previous", previous)
        .where("previous is null or previous < pos")  # a repeated row says the same twice
        .groupBy("doc_id", "rid")
        .agg(F.sort_array(F.collect_list(run)).alias("runs"), F.max("pos").alias("last"),
             F.count("*").alias("n_dropped"))
    )


def with_kept_text(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Packed rows beside their kept text, line count and dropped count."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").alias("id"),
                       row_key(F.col("doc_id"), F.col("text")).alias("row_rid"))
    joined = rows.join(
        bitmaps, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("row_rid") == F.col("rid")), "left")
    lines = F.split(F.coalesce("row.text", F.lit("")), "\n", -1)
    n_lines = F.size(lines)
    changed = F.struct(lines.alias("lines"), F.col("runs"), F.col("last"))

    def kept(part):  # binding the split once: a lambda would split again for every run
        tail = F.slice(part["lines"], part["last"] + 2, F.greatest(F.size(part["lines"]), F.lit(1)))
        runs = F.transform(part["runs"], lambda r: F.slice(part["lines"], r["first"] + 1, r["length"]))
        return F.array_join(F.concat(F.flatten(runs), tail), "\n")

    text = F.when(F.col("last").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(
        F.transform(F.array(changed), kept)[0])
    return joined.select("row", text.alias("kept"), n_lines.cast("long").alias("n_lines"),
                         F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with repeated lines gone; a text that loses every line becomes empty."""
    rows = with_kept_text(docs, keep_bitmaps(dropped_lines(docs, min_chars)))
    return repacked(rows, "row", text=F.when(F.col("row.text").isNotNull(), F.col("kept")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_kept_text(docs, keep_bitmaps(dropped_lines(docs)))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
                       F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
    from documents
), keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        '{UPPER}', '{UPPER.lower()}') as key
    from lines
), shared as (
    select key, min(doc_id) as holder from keyed where length(key) >= {MIN_CHARS}
    group by key having count(distinct doc_id) > 1
), judged as (
    select k.doc_id, pos, line, coalesce(k.doc_id <> holder, false) as dropped
    from keyed k left join shared s on k.key = s.key and length(k.key) >= {MIN_CHARS}
)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id
"""
