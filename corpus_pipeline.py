"""The corpus pipeline: five stages over documents, each an operator of sonoplan.llm.

1. quality: documents that the classifier predicts to be of quality 0 go.
2. near_duplicates: of each component of near copies the document with the smallest doc_id stays.
3. decontamination: passages of benchmark items are cut out; a document that is nothing else goes.
4. personal_data: personal data and secrets get surrogates.
5. mixing: each document gets its number of repeats and its places in the mixture of sources.

All stages but the last return the columns of documents. Stages are written as Parquet to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonoplan.llm.common import stash, table
from sonoplan.llm.decontaminate import remove_benchmark
from sonoplan.llm.mixing import mixed_documents
from sonoplan.llm.ngram_join import one_of_each
from sonoplan.llm.pii import without_pii
from sonoplan.llm.quality import keep_good

STAGES = [
    ("quality", keep_good),
    ("near_duplicates", one_of_each),
    ("decontamination", remove_benchmark),
    ("personal_data", without_pii),
    ("mixing", mixed_documents),
]

#: SQL cannot express the classifier's and the surrogates' stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages leave, with repeats and passes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
