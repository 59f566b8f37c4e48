"""A stored inverted index of stems.

Terms are lower-cased runs of letters and digits without the stop words; those of ASCII letters are stemmed. The index is two tables:
postings (term, key, tf, dl) in parts by the term's hash, so that a query reads its terms' parts only, and one row of corpus statistics.

Defined results: null texts aren't indexed; texts without terms count in the statistics; repeated keys are indexed once;
an empty corpus gives no hits; a query of stop words only gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from corvane.functions.text import STOPWORDS, porter
from corvane.operators import search as S


def content_words(text: Column) -> Column:
    """Words of a text without the stop words."""
    return F.filter(S.tokens(text), lambda x: ~x.isin(*STOPWORDS))


@pandas_udf(T.ArrayType(T.StringType()))
def _stemmed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}

    def stem(w: str) -> str:
        s = known.get(w)
        if s is None:
            if len(known) > 500_000:
                known.clear()
            s = known[w] = porter(w)
        return s

    for b in batches:
        yield b.map(lambda ws: None if ws is None else [x for x in map(stem, ws) if x])


def stems(text: Column) -> Column:
    """Terms of a text in order. Words of anything but ASCII letters stay as they are."""
    return _stemmed(content_words(text))


def query_stems(query: str) -> list[str]:
    """Distinct terms of a query, in order."""
    stop = frozenset(STOPWORDS)
    return list(dict.fromkeys(porter(w) for w in S.query_terms(query) if w not in stop))


class LexicalIndex:
    """The stored index in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 32):
        self.spark, self.path, self.parts = spark, path, parts

    def _part(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.parts))

    def build(self, docs: DataFrame, key: str, text: str) -> "LexicalIndex":
        """Writes the index of (key, text); one that is there is replaced."""
        own = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
        words = own.select("key", stems(F.col("text")).alias("w"))
        lengths = words.select("key", F.size("w").alias("dl"), "w")
        # counted within the row, so that no word crosses the shuffle twice
        counted = lengths.select("key", "dl", F.explode(F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), (F.size("w") - F.size(F.array_remove(F.col("w"), t))).alias("tf")))).alias("e"))
        post = counted.select("e.term", "key", "e.tf", "dl").withColumn("part", self._part(F.col("term")))
        post.repartition(self.parts, "part").sortWithinPartitions("part", "term", "key").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/postings")
        lengths.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{self.path}/statistics")
        return self

    def postings(self) -> DataFrame:
        """(term, key, tf, dl, part)."""
        return self.spark.read.schema("term string, key bigint, tf int, dl int, part bigint").parquet(f"{self.path}/postings")

    def bm25(self, query: str, allowed: DataFrame | None = None) -> DataFrame:
        """(key, score) of texts with a term of the query; statistics are the whole corpus's, ``allowed`` (key) only filters."""
        terms = query_stems(query)
        parts = [r.p for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._part(F.col("term")).alias("p")).collect()]
        own = self.postings().filter(F.col("part").isin(parts) & F.col("term").isin(terms)) if terms else self.postings().limit(0)
        stats = self.spark.read.parquet(f"{self.path}/statistics").first()
        n, avgdl = (stats.n, stats.avgdl) if stats else (0.0, None)
        df = own.groupBy("term").agg(F.count("*").cast("double").alias("df"))
        own = own.join(F.broadcast(df), "term")  # the query's terms
        if allowed is not None:
            own = own.join(allowed, "key", "left_semi")
        idf = F.log(F.lit(1.0) + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        tf = F.col("tf").cast("double")
        part = idf * tf * (S.K1 + 1) / (tf + S.K1 * (F.lit(1 - S.B) + S.B * F.col("dl") / F.lit(avgdl)))
        return own.groupBy("key").agg(F.sum(part).alias("score")).filter("score > 0")
