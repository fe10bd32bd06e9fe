"""Operators of a training-data pipeline; nothing else in the package imports this folder."""

from __future__ import annotations


def queries() -> dict:
    from . import bpe, decontaminate, fim, knn, langid, licenses, lm, merkle, minhash, quality, simhash, suffix, warc

    return {
        "op1_quality": quality.op1_quality,
        "op2_topk": knn.op2_topk,
        "op3_licenses": licenses.op3_licenses,
        "op4_suffix": suffix.op4_suffix,
        "op5_langid": langid.op5_langid,
        "op6_simhash": simhash.op6_simhash,
        "op7_bpe": bpe.op7_bpe,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_lm": lm.op9_lm,
        "op10_warc": warc.op10_warc,
        "op11_fim": fim.op11_fim,
        "op12_minhash": minhash.op12_minhash,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    from . import fim, knn, licenses, merkle, minhash

    return {"op2_topk": knn.OP2_SQL, "op3_licenses": licenses.op3_sql(), "op11_fim": fim.OP11_SQL, "op12_minhash": minhash.OP12_SQL, "op13_merkle": merkle.OP13_SQL}
