"""Inverted index over lines, its planner and the substring prefilter.

``terms`` (term, df) and ``postings`` (term, line_no).  A query word matches
every term that contains it, so the candidates of a pattern are a superset of
its hits whatever the pattern's place in a word; the exact filter stays.

``build`` writes both tables and the lines once, with a row of metadata:
postings sorted by term, so that a search for few terms reads the row groups
that can hold them; lines partitioned by blocks of documents, so that a search
with few candidates opens the blocks that hold them.  ``plan`` decides by the
document frequencies alone whether the index is worth it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.plans import patterns

MIN_TERM = 2
#: Terms that a word may match before it is given up as a filter; they come to the driver.
MOST_TERMS = 2000
#: Share of the lines that candidates may be before a scan is cheaper.
MOST_SHARE = 0.1
#: Blocks of documents whose paths a search may name; beyond, all blocks are scanned.
MOST_BLOCKS = 2000
#: Documents a block.
BLOCK_BITS = 12


def line_terms(line: str) -> Column:
    """The distinct runs of letters and digits of the case-folded line, at least MIN_TERM long."""
    runs = F.regexp_extract_all(patterns.casefold(F.col(line)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda t: F.length(t) >= MIN_TERM))


def postings(lines: DataFrame) -> DataFrame:
    return lines.select("line_no", F.explode(line_terms("line")).alias("term"))


def terms(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def words(pattern: str) -> list[str]:
    import regex

    return sorted({w for w in regex.findall(r"[\p{L}\p{N}]+", pattern.casefold()) if len(w) >= MIN_TERM})


def candidates(posted: DataFrame, pattern: str) -> DataFrame:
    """line_no of the lines in which every word of the pattern lies within a term.
    A pattern without a word says nothing of lines without a term: ``search`` scans all lines for it."""
    found = words(pattern)
    if not found:
        return posted.select("line_no").distinct()
    hit = posted.select("line_no", *[F.col("term").contains(w).alias(f"_w{i}") for i, w in enumerate(found)])
    hit = hit.where(" or ".join(f"_w{i}" for i in range(len(found))))
    all_ = hit.groupBy("line_no").agg(*[F.max(f"_w{i}").alias(f"_w{i}") for i in range(len(found))])
    return all_.where(" and ".join(f"_w{i}" for i in range(len(found)))).select("line_no")


def search(lines: DataFrame, posted: DataFrame, pattern: str) -> DataFrame:
    """Lines that contain the literal pattern, through postings that were not written."""
    if not words(pattern):
        return lines.where(F.col("line").contains(pattern))
    return lines.join(candidates(posted, pattern), "line_no", "left_semi").where(F.col("line").contains(pattern))


def build(lines: DataFrame, path: str, source: str = "") -> None:
    """Write the index of corpus lines (line_no a struct of doc_id and pos) to a folder."""
    spark = lines.sparkSession
    keyed = lines.withColumn("block", F.shiftright("line_no.doc_id", BLOCK_BITS))
    keyed.repartition("block").sortWithinPartitions("line_no").write.partitionBy("block").parquet(f"{path}/lines")
    kept = spark.read.parquet(f"{path}/lines")
    posted = postings(kept)
    posted.repartitionByRange("term", "line_no").sortWithinPartitions("term", "line_no").write.parquet(f"{path}/postings")
    written = spark.read.parquet(f"{path}/postings")
    terms(written).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    vocabulary = spark.read.parquet(f"{path}/terms")
    facts = kept.agg(F.count("*").alias("n_lines"), F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).alias("n_bytes"))
    found = vocabulary.agg(F.count("*").alias("n_terms"), F.count_if(F.col("df") == 1).alias("n_singletons"), F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings"))
    facts.crossJoin(found).withColumn("source", F.lit(source)).withColumn("min_term", F.lit(MIN_TERM)).withColumn("version", F.lit(1)).coalesce(1).write.parquet(f"{path}/meta")


@dataclass(frozen=True)
class Plan:
    """How a pattern is searched: the reason, and for an index search the terms of the words that filter."""

    indexed: bool
    reason: str
    terms: tuple[tuple[str, ...], ...] = ()
    estimate: int = 0


class Index:
    """A written index.  Budgets come from the session's spindle.index.* settings, if there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.meta = spark.read.parquet(f"{path}/meta").first()

        def setting(name: str, default: float) -> float:
            return float(spark.conf.get(f"spindle.index.{name}", str(default)))

        self.most_terms, self.most_share, self.most_blocks = int(setting("mostTerms", MOST_TERMS)), setting("mostShare", MOST_SHARE), int(setting("mostBlocks", MOST_BLOCKS))

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    def fresh(self, source: str, n_lines: int, n_bytes: int) -> bool:
        """The index was built from this source in this state."""
        return (self.meta["source"], self.meta["n_lines"], self.meta["n_bytes"]) == (source, n_lines, n_bytes)

    def lookup(self, word: str) -> list[tuple[str, int]] | None:
        """(term, df) of the terms that contain the word; None if they are over the budget."""
        found = self.read("terms").where(F.col("term").contains(word)).limit(self.most_terms + 1).collect()
        return None if len(found) > self.most_terms else [(r["term"], r["df"]) for r in found]

    def plan(self, pattern: str) -> Plan:
        """Words by their summed frequency, rarest first; further words are used
        while their postings are fewer than what they can still remove."""
        if not words(pattern):
            return Plan(False, "no word in the pattern")
        known = [(w, self.lookup(w)) for w in words(pattern)]
        if any(t == [] for _, t in known):
            return Plan(True, "a word that no term holds", ((),), 0)
        sized = sorted((sum(df for _, df in t), tuple(x for x, _ in t)) for _, t in known if t is not None)
        if not sized:
            return Plan(False, "every word matches too many terms")
        least = sized[0][0]
        if least > self.most_share * self.meta["n_lines"]:
            return Plan(False, "too many candidates", estimate=least)
        return Plan(True, "index", tuple(t for n, t in sized if n <= 20 * least), least)

    def candidates(self, plan: Plan) -> DataFrame:
        """line_no of the lines that hold a term of every word of the plan."""
        out = None
        for t in plan.terms:
            posted = self.read("postings").where(F.col("term").isin(*t) if t else F.lit(False)).select("line_no")
            out = posted.distinct() if out is None else out.join(posted, "line_no", "left_semi")
        return out

    def search(self, pattern: str) -> DataFrame:
        """Lines (line_no, line) that contain the literal pattern."""
        plan, lines = self.plan(pattern), self.read("lines")
        exact = F.col("line").contains(pattern)
        if plan.indexed:
            found = self.candidates(plan)
            blocks = [r[0] for r in found.select(F.shiftright("line_no.doc_id", BLOCK_BITS)).distinct().limit(self.most_blocks + 1).collect()]
            if len(blocks) <= self.most_blocks:
                lines = lines.where(F.col("block").isin(*blocks) if blocks else F.lit(False))
            lines = lines.join(found, "line_no", "left_semi")
        return lines.where(exact).select("line_no", "line")

    def estimate(self, pattern: str) -> DataFrame:
        """(word, terms, postings) of each word of the pattern: what a search would read."""
        found = self.spark.createDataFrame([(w,) for w in words(pattern)], "word string")
        hit = self.read("terms").join(F.broadcast(found), F.contains("term", "word"))
        return hit.groupBy("word").agg(F.count("*").alias("terms"), F.sum("df").alias("postings"))


def candidate_bytes(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """Bytes of the candidate lines, line feeds counted: one row."""
    return lines.join(chosen, "line_no", "left_semi").agg(F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).alias("n_bytes"))
