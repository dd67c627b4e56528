"""Queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import exact, lines, minhash, mixing, neighbours, packing, phrases, pii, repair, repeats, simhash, toolcalls, toxicity


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_minhash": minhash.op1,
    "op2_toolcalls": toolcalls.op2,
    "op3_simhash": simhash.op3,
    "op4_mixing": mixing.op4,
    "op5_repeats": repeats.op5,
    "op6_exact": exact.op6,
    "op7_toxicity": toxicity.op7,
    "op8_pii": pii.op8,
    "op9_lines": lines.op9,
    "op10_packing": packing.op10,
    "op11_phrases": phrases.op11,
    "op12_neighbours": neighbours.op12,
    "op13_repair": repair.op13,
}

ORACLES: dict[str, str] = {
    "op2_toolcalls": toolcalls.SQL2,
    "op6_exact": exact.SQL6,
    "op9_lines": lines.SQL9,
    "op11_phrases": phrases.SQL11,
    "op13_repair": repair.SQL13,
}
