import hashlib

from pyspark.sql import functions as F

from tests.llm.cases import TEXTS, awkward, nothing
from tidemark.llm import line_dedup

SPACE = " \t\n\x0b\f\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def slow(rows):
    order = lambda i: (i is None, i)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(SPACE))
            if len(key) >= 10:
                holders[key] = min(holders.get(key, i), i, key=order)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if holders.get(lower(x.strip(SPACE)), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def test_awkward_rows_agree_with_a_plain_loop(spark):
    docs = awkward(spark)
    bitmaps = line_dedup.keep_bitmaps(line_dedup.dropped_lines(docs))
    got = line_dedup.with_kept_text(docs, bitmaps).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, got), key=key) == sorted(slow(TEXTS), key=key)


def test_whole_documents_come_back_with_their_columns(spark):
    docs = awkward(spark)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    assert out.where(F.col("doc_id") == 3).first().text is None


def test_bitmaps_are_runs_and_stay_short(spark):
    lines = [f"a line of its own number {i}" for i in range(500)]
    docs = spark.createDataFrame(
        [(1, "\n".join(lines[200:300])), (2, "\n".join(lines))], "doc_id bigint, text string")
    row = line_dedup.keep_bitmaps(line_dedup.dropped_lines(docs)).collect()
    assert [(r.doc_id, [tuple(x) for x in r.runs], r["last"], r.n_dropped) for r in row] == [(2, [(0, 200)], 299, 100)]


def test_a_hot_line_is_split_and_kept_once(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("the line they all have\nown line number "), "id").alias("text"))
    dropped = line_dedup.dropped_lines(docs)
    assert dropped.count() == 2999 and dropped.where("doc_id = 0").isEmpty()


def test_no_python_on_the_main_path(spark):
    docs = awkward(spark)
    rows = line_dedup.with_kept_text(docs, line_dedup.keep_bitmaps(line_dedup.dropped_lines(docs)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_no_documents(spark):
    assert line_dedup.dedup_lines(nothing(spark)).count() == 0


def test_digest_of_a_text_without_lines_left(spark):
    docs = spark.createDataFrame([(1, "all of this goes"), (2, "ALL OF THIS GOES")], "doc_id bigint, text string")
    rows = line_dedup.with_kept_text(docs, line_dedup.keep_bitmaps(line_dedup.dropped_lines(docs)))
    got = {r.i: r.s for r in rows.select(F.col("row.doc_id").alias("i"), F.sha2("kept", 256).alias("s")).collect()}
    assert got[2] == hashlib.sha256(b"").hexdigest()
