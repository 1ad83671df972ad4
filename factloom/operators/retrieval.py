"""Ranking definitions against questions by a fielded BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.facts import Facts
from factloom.operators.skew import top_n
from factloom.session import Scratch

K1, B = 1.2, 0.75
#: Weights of the fields; only the body is normalised by length.
FIELDS = {"name": 4.0, "path": 1.5, "doc": 2.0}
BODY = 1.0


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits of at least two characters, underscores and camel humps apart."""
    humps = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.regexp_extract_all(F.lower(humps), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 2)


def bm25(docs: DataFrame, questions: DataFrame, top: int | None = 4, body: DataFrame | None = None) -> DataFrame:
    """(qid, doc, score, matched): documents (doc, name, path, doc_text) ranked for questions (qid, question).

    The terms of the questions are few and select the postings first; document frequencies are counted over all documents.
    ``body``: (doc, terms), a row for each document with the words of its own lines, if the body counts; a document's occurrences are divided by
    1 - B + B * its words / the mean over all documents, at least 1.
    score = sum of idf * w * (K1 + 1) / (w + K1), raised by 15 % for each further matched term.
    """
    q = questions.select("qid", F.explode(F.array_distinct(words(F.col("question")))).alias("term"))
    post = None
    for column, field in (("name", "name"), ("path", "path"), ("doc_text", "doc")):
        p = docs.select("doc", F.explode(words(F.col(column))).alias("term"), F.lit(FIELDS[field]).alias("w"))
        post = p if post is None else post.unionByName(p)
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    wanted = q.select("term").distinct()
    hits = post.join(wanted, "term")
    if body is not None:
        few = body.withColumn("wanted", wanted.agg(F.collect_set("term")).scalar())
        few = few.select("doc", F.size("terms").alias("length"), F.filter("terms", lambda w: F.array_contains("wanted", w)).alias("hits"))
        few = Scratch(docs.sparkSession, "bodies").save(few)
        mean = F.greatest(few.agg(F.coalesce(F.sum("length"), F.lit(0))).scalar() / n, F.lit(1.0))
        found = few.select("doc", "length", F.explode("hits").alias("term")).groupBy("doc", "term", "length").agg(F.count(F.lit(1)).alias("k"))
        hits = hits.unionByName(found.select("term", "doc", (BODY * F.col("k") / (1 - B + B * F.col("length") / mean)).alias("w")))
    per = hits.groupBy("doc", "term").agg(F.sum("w").alias("w"))
    df = per.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    gain = F.col("idf") * F.col("w") * (K1 + 1) / (F.col("w") + K1)
    s = per.join(idf, "term").join(q, "term").groupBy("qid", "doc").agg(F.sum(gain).alias("s"), F.count(F.lit(1)).alias("matched"))
    s = s.select("qid", "doc", F.round(F.col("s") * (1 + 0.15 * (F.col("matched") - 1)), 6).alias("score"), "matched")
    if not top:
        return s
    return top_n(s, ["qid"], [F.desc("score"), F.asc("doc")], top, "doc").drop("rank")


def symbol_documents(f: Facts) -> DataFrame:
    """Functions, methods and classes as documents."""
    s = f.symbols.where(F.col("kind").isin("function", "method", "class", "struct"))
    return s.join(f.files.select("file_id", "path"), "file_id").select(F.col("sid").alias("doc"), "name", "path", F.coalesce("summary", F.lit("")).alias("doc_text"))


def symbol_bodies(f: Facts) -> DataFrame:
    """(doc, terms): the words of those lines of a definition that lie in none of its children; only of files whose text is the analysed one."""
    t = f.raw("source_texts").where(F.col("content").isNotNull()).select("file_id", "content").join(f.files.select("file_id", "content_hash"), "file_id")
    t = t.where(F.sha2("content", 256) == F.col("content_hash")).dropDuplicates(["file_id"]).select("file_id", F.split("content", "\r\n|\n").alias("x"))
    kids = f.symbols.where(F.col("start_line") <= F.col("end_line")).groupBy(F.col("pid").alias("sid")).agg(F.collect_list(F.struct(F.col("start_line").alias("c"), F.col("end_line").alias("d"))).alias("kids"))
    s = f.symbols.where(F.col("kind").isin("function", "method", "class", "struct")).select("sid", "file_id", F.greatest("start_line", F.lit(1)).alias("a"), F.col("end_line").alias("b"))
    s = s.where(F.col("a") <= F.col("b")).join(kids, "sid", "left").join(t, "file_id")
    inside = lambda k: lambda r: (r["c"] <= k) & (k <= r["d"])
    own = F.filter(F.slice("x", F.col("a"), F.col("b") - F.col("a") + 1), lambda _, i: ~F.coalesce(F.exists("kids", inside(i + F.col("a"))), F.lit(False)))
    return s.select(F.col("sid").alias("doc"), words(F.array_join(own, "\n")).alias("terms"))
