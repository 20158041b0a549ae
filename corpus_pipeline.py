"""The corpus pipeline: STAGES run in order over documents, each one's rows written as Parquet and reread as the next one's docs.

Each stage is one operator of tidemark.llm. All but the last return the columns of documents:

1. language ID drops documents without letters or with a score under its limit;
2. MinHash near-dedup keeps one document of each group, on five-word shingles at a similarity of 0.8;
3. personal data generalises spans in the text and removes disclosing terms;
4. source mixing gives each document as often as its source's rate takes it;
5. best-fit packing gives the pieces with their sequences and offsets.
"""

from __future__ import annotations

from tidemark.llm import language_id, minhash_dedup, mixing, packing, pii
from tidemark.llm.common import materialise, settle, table


def keep_known_languages(spark, docs, sf_dir):
    return language_id.filtered(docs)


def keep_one_of_near_copies(spark, docs, sf_dir):
    return minhash_dedup.deduplicated(docs)


def sanitise_personal_data(spark, docs, sf_dir):
    return pii.sanitised(docs)


def mix_sources(spark, docs, sf_dir):
    return mixing.mix(docs)


def pack_sequences(spark, docs, sf_dir):
    return packing.packed_documents(docs)


STAGES = [
    ("language ID", keep_known_languages),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("personal data", sanitise_personal_data),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: Models, similarity joins and packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The packed pieces of what the stages keep of documents, as a table; the stages' own tables are deleted."""
    return settle("pipeline", lambda: _run(spark, sf_dir))


def _run(spark, sf_dir):
    docs = spark.read.parquet(table(sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
