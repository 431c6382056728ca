"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from .brown import op1_brown_bigram
from .cotrain import op2_co_training
from .decontam import op9_ngram_hash_set
from .jaccard import op4_signature_tree_join
from .lines import op5_segment_edit_join
from .mixing import op7_golden_schedule
from .rules import op3_risk_controlled_rules
from .runs import op12_scale_tiled_runs
from .tokens import op10_zstd_dictionary_shards
from .sharding import op8_virtual_slots
from .simhash import op13_simhash_trie_join
from .spelling import op11_bloom_neighbourhoods
from .warc import op6_gzip_member_records

def pipeline(spark, sf_dir):
    """corpus_pipeline.run; imported late, as the stages import this package."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_brown_bigram": op1_brown_bigram,
    "op2_co_training": op2_co_training,
    "op3_risk_controlled_rules": op3_risk_controlled_rules,
    "op4_signature_tree_join": op4_signature_tree_join,
    "op5_segment_edit_join": op5_segment_edit_join,
    "op6_gzip_member_records": op6_gzip_member_records,
    "op7_golden_schedule": op7_golden_schedule,
    "op8_virtual_slots": op8_virtual_slots,
    "op9_ngram_hash_set": op9_ngram_hash_set,
    "op10_zstd_dictionary_shards": op10_zstd_dictionary_shards,
    "op11_bloom_neighbourhoods": op11_bloom_neighbourhoods,
    "op12_scale_tiled_runs": op12_scale_tiled_runs,
    "op13_simhash_trie_join": op13_simhash_trie_join,
}

SQL: dict[str, str] = {}
