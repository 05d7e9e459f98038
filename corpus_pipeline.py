"""The corpus pipeline: stages of the training-data operators, each stored and read again before the next one.

Documents pass the quality classifier (rejected ones go), the n-gram Jaccard join (one of each group stays), benchmark
decontamination (leaking ones go), mixing to target weights (documents repeat, or go where their source has too much), and
sharding (shard and slot come in). The first four return the columns they were given. Every stage works on all rows that
its predecessor kept. Nulls, empty texts, repeated rows and clashing column names are treated as the operators state.
"""

from watchline.llm import decontaminate, jaccard, mixing, quality, sharding
from watchline.llm.queries import remainder
from watchline.llm.tables import stored, table


def quality_classifier(spark, docs, sf_dir):
    """Documents that the classifier predicts as quality 1; it learns from labels of rows that are not held out."""
    model = quality.train(docs, table(spark, sf_dir, "labels").where(remainder(3) != 1))
    return quality.accepted(docs, model)


def jaccard_join(spark, docs, sf_dir):
    """One document of each group of near copies."""
    return jaccard.one_of_each(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that leak no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """Rows as often as the mix takes them; documents without words fill no target and go."""
    return mixing.repeated(docs)


def shard(spark, docs, sf_dir):
    """Documents with shard and slot."""
    return sharding.sharded(docs)


STAGES = [("quality_classifier", quality_classifier), ("jaccard_join", jaccard_join), ("decontamination", decontamination),
          ("mix_sources", mix_sources), ("sharding", shard)]

#: A trained model and a tree of data-dependent cuts have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
