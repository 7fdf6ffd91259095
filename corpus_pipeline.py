"""Corpus pipeline: stages applied to documents, each written and read again before the next.

Quality rules, near-duplicates (one of each group stays), repeated passages, mixing of sources, packing. All stages but the last return the
columns of documents. STAGES lists (name, function); a function takes (spark, docs, sf_dir).
"""

import uuid

from flowsieve.llm import stages
from flowsieve.llm.common import consumed, shared_dir


def _packed(spark, docs, sf_dir):
    import public_tokenizers

    return stages.packing_stage(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", lambda spark, docs, sf_dir: stages.quality_stage(docs)),
    ("near_duplicates", lambda spark, docs, sf_dir: stages.near_duplicate_stage(docs)),
    ("suffix_dedup", lambda spark, docs, sf_dir: stages.passage_stage(docs)),
    ("source_mixing", lambda spark, docs, sf_dir: stages.mixing_stage(docs)),
    ("packing", _packed),
]

#: Shingle similarity, suffix order and tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with consumed(spark):
            after = stage(spark, docs, sf_dir)
            path = f"{shared_dir(spark)}/flowsieve/stage-{uuid.uuid4().hex}"
            after.write.parquet(path)
        docs = spark.read.schema(after.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
