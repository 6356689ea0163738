"""A training corpus from documents: quality, repeated passages, near copies, benchmark leaks, mixing.

STAGES are applied in order; each takes (spark, docs, sf_dir) and returns a
DataFrame. Labels and benchmark are read from sf_dir. All stages keep columns of any name
that documents have besides doc_id and text, and return an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import decontamination, jaccard, lines, mixing, quality
from loomspark.llm._split import free_name
from loomspark.llm._store import documents, scope, stored
from loomspark.llm.queries import tree


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers take for good.

    Each row is judged by itself: repeated rows and equal texts by different metadata
    alike or not, null doc_ids like others; null and empty texts have the statistics 0, null lang, source and n_chars
    their own feature; whole texts of any length count. Without labels every row stays.
    """
    return quality.keep_good(docs, quality.train(docs, documents(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without multi-line passages that an earlier document has; n_chars follows the text.

    Every pair of neighbouring lines counts, in texts of any length. The occurrence of the smallest doc_id stays (null:
    the largest; then that of the smallest text hash); identical rows count as one document and stay alike. Null and empty texts,
    and texts of one line, stay as they are; no row goes, even if all its lines do.
    """
    out = lines.dedup_lines(docs, every_pair=True, counts=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each group that five-word shingles link at a Jaccard similarity of 0.8 or more.

    Null doc_ids count as the largest; of repeated rows one stays; null texts and texts without words
    link with nothing and stay; texts of under five words are one shingle; texts of any length are compared whole.
    """
    return jaccard.without_copies(docs, size=5, part=80, whole=100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no benchmark item has half of its words covered by greedy tiles.

    Each row is judged by its own whole text; repeated rows and null doc_ids like others; null and empty texts stay, as
    does everything if the benchmark is empty. Null and empty items match nothing; items of one or two words count as whole lines or whole texts.
    """
    return decontamination.drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen for the target weights, with the epoch they are read in.

    Tokens are white-space words. Null lang or source make leaves of their own; null doc_ids sort first; rows of one
    doc_id and leaf stand or fall together; null and empty texts have no tokens and are never chosen. A document longer than what its
    leaf has left ends its prefix.
    """
    names = docs.columns
    clash = [c for c in names if c.lower() in ("epoch", "n_tokens") or c.lower().startswith("mix_")]
    for c in clash:  # the operator replaces columns of its own names
        docs = docs.withColumnRenamed(c, free_name(docs, f"own_{c}"))
    held, out = docs.columns, mixing.mix(docs, tree())
    own = [F.col(f"`{h}`").alias(c) for h, c in zip(held, names, strict=True)]
    free = lambda name: next(n for n in (name, *(f"{'_' * k}{name}" for k in range(1, 1 + len(names)))) if n not in {c.lower() for c in names})
    return out.select(*own, *[F.col(c).alias(free(c)) for c in ("epoch", "n_tokens")])


STAGES = [("quality", good_quality), ("line dedup", without_repeated_lines), ("near copies", without_near_copies), ("decontamination", without_benchmark), ("mixing", mixed)]
#: The classifier has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each runs in a scope of its own, so its step tables go when it ends or fails, and its input once the next stage has read it."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with scope(spark) as made:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
            result = made.pop()
            made += [before] if before else []
        before = result
    return docs
