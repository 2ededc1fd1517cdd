"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, kneser_ney, licenses, packing, shards, simhash, substrings, toxicity, vafile, warc

QUERIES = {
    "op1_nnls_packing": packing.op1,
    "op2_hash_tree": shards.op2,
    "op3_minhash_licenses": licenses.op3,
    "op4_warc_dictionary": warc.op4,
    "op5_va_file": vafile.op5,
    "op6_classifier_chain": toxicity.op6,
    "op7_kneser_ney": kneser_ney.op7,
    "op8_recompression": substrings.op8,
    "op9_ngram_decontamination": decontaminate.op9,
    "op10_popcount_simhash": simhash.op10,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc_dictionary": warc.OP4_SQL,
    "op5_va_file": vafile.OP5_SQL,
    "op8_recompression": substrings.OP8_SQL,
    "op9_ngram_decontamination": decontaminate.OP9_SQL,
}


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
