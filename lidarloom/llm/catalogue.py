"""The registered queries of the text operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import bpe, langid, multiindex, packing, pii, rulefit, rules, simhash, suffixes, windows


def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py, which lies beside the package."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_pii": pii.op1_pii,
        "op2_packing": packing.op2_packing,
        "op3_bpe": bpe.op3_bpe,
        "op4_langid": langid.op4_langid,
        "op5_rulefit": rulefit.op5_rulefit,
        "op6_suffixes": suffixes.op6_suffixes,
        "op7_simhash": simhash.op7_simhash,
        "op8_windows": windows.op8_windows,
        "op9_rules": rules.op9_rules,
        "op10_multiindex": multiindex.op10_multiindex,
        "pipeline": pipeline,
    }


def oracle_sql():
    return {"op6_suffixes": suffixes.ORACLE_SQL, "op10_multiindex": multiindex.ORACLE_SQL}
