"""Ranked lexical search: integer-scored postings, joined with queries' terms and summed.

build_postings() makes a table of postings, a row for each term of each document, that is dealt by document and sorted by
the term's bucket inside each deal: a query reads the buckets of its terms, and all matches of a document lie in one
deal, so that scores are summed, and all but the best dropped, where they are. A term that most documents have is spread
over all deals. search() joins the terms of query items, whose number is checked before they are broadcast.

Scores are whole numbers: a term's weight floor(1000 ln((2N + 2) / (2df + 1))) is the only step in doubles. Null texts have
no terms; a document or item without terms is in no result; of repeated items or documents each row counts by itself;
equal scores rank by ascending identifier, null first. A text's terms are held in one row, as the text is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, discard, keyed, new_dir, own_keys

#: What parts terms: ASCII that is neither a letter nor a digit.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BUCKETS = 1 << 16
#: So many rows of item terms are broadcast at most, some 50 MB; more are joined by shuffling.
BROADCAST_TERMS = 1_000_000


def terms_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def term_bucket(term: Column) -> Column:
    return F.pmod(F.hash(term), F.lit(TERM_BUCKETS))


def places(docs: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each term's place in a document: _row, keep, n, term. Of explode() Spark infers that the array isn't empty, and would make all terms
    once more to test it, where documents are read; so empty ones give a row, which goes then."""
    found = docs.select("_row", *keep, terms_of(F.col(text)).alias("_terms"))
    return found.select("_row", *keep, F.size("_terms").alias("n"), F.explode_outer("_terms").alias("term")).where("term IS NOT NULL")


class Postings:
    """A table of postings: _row, further columns of the document (keep), term, bucket, tf, n (terms of the document)."""

    def __init__(self, docs: DataFrame, text: str, keep: tuple[str, ...] = ()):
        """docs: _row, which tells documents apart, the text and the columns of keep."""
        self.spark, self.keep = docs.sparkSession, keep
        self.name, self.path = f"postings_{uuid.uuid4().hex[:12]}", new_dir(self.spark, "postings")
        deals = int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))
        counts = places(docs.repartition(deals, "_row"), text, keep).groupBy("_row", *keep, "n", "term").agg(F.count(F.lit(1)).alias("tf")).withColumn("bucket", term_bucket(F.col("term")))
        counts.write.bucketBy(deals, "_row").sortBy("bucket", "term").option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
        self.table = self.spark.table(self.name)
        sizes = self.table.groupBy("_row").agg(F.sum("tf").alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        self.docs, self.terms = sizes.docs, sizes.terms

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.spark, self.path)


def search(postings: Postings, items: DataFrame, top: int, order: list[Column]) -> DataFrame:
    """The best documents of each item: _item, rank, _row, the postings' kept columns, score. items: _item, text.

    order: how equal scores rank, by columns of the document."""
    asked = cut(items.select("_item", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("_item", "term").agg(F.count(F.lit(1)).alias("times")), "item-terms")
    small = asked.count() <= BROADCAST_TERMS
    hint = F.broadcast if small else lambda df: df
    vocabulary = asked.select("term").distinct()
    found = postings.table
    if small:
        buckets = [r.bucket for r in vocabulary.select(term_bucket(F.col("term")).alias("bucket")).distinct().collect()]  # TERM_BUCKETS at most
        found = found.where(F.col("bucket").isin(buckets))
    held = cut(found.join(hint(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term-documents")
    weight = F.floor(1000 * F.log((2 * postings.docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    weights = asked.join(held, "term").select("_item", "term", (F.col("times") * weight).alias("_weight")).where("_weight > 0")
    m = F.expr(f"75 + (25 * cast(n as bigint) * {postings.docs}L) div {max(postings.terms, 1)}L")
    share = found.withColumn("_m", m).withColumn("_share", F.expr("(1000000000 * tf) div (1000 * tf + 12 * _m)"))
    matches = share.select("_row", *postings.keep, "term", "_share").join(hint(weights), "term")
    scores = matches.groupBy("_item", "_row", *postings.keep).agg(F.sum(F.col("_weight") * F.col("_share")).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("_item").orderBy(F.col("score").desc(), *order))
    return scores.withColumn("rank", rank).where(F.col("rank") <= top)


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 20, id: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """For each item, its `top` highest-scoring documents with a score above 0: item_id, rank (from 1), doc_id, score."""
    own = own_keys(docs, id)
    rows = docs.select(F.col(id).cast("bigint").alias("_row"), F.col(text).alias("text")) if own else keyed(docs, id).select("_row", F.col(f"_doc.{id}").alias("_id"), F.col(f"_doc.{text}").alias("text"))
    asked = cut(items.select(F.monotonically_increasing_id().alias("_item"), F.col(item).alias("_name"), F.col(text).alias("text")), "items")
    postings = Postings(rows, "text", () if own else ("_id",))
    order = [F.col("_row").asc()] if own else [F.col("_id").asc_nulls_first(), F.col("_row").asc()]
    best = search(postings, asked.select("_item", "text"), top, order)
    named = best.join(asked.select("_item", "_name"), "_item").select(F.col("_name").alias(item), F.col("rank").cast("int").alias("rank"), F.col("_row" if own else "_id").cast(docs.schema[id].dataType).alias(id), "score")
    out = cut(named, "ranked")
    postings.drop()
    return out
