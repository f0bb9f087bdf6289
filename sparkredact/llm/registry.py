"""The queries of this subpackage, by name, and their DuckDB counterparts where SQL can say them."""

import corpus_pipeline

from . import ann, bpe, decontam, extract, hmm, licenses, neardup, quality, secrets, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_licenses": licenses.op2_licenses,
    "op3_neardup": neardup.op3_neardup,
    "op4_quality": quality.op4_quality,
    "op5_extraction": extract.op5_extraction,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_secrets": secrets.op7_secrets,
    "op8_neighbours": ann.op8_neighbours,
    "op9_bpe": bpe.op9_bpe,
    "op10_hmm": hmm.op10_hmm,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op1_warc": warc.OP1_SQL,
    "op2_licenses": licenses.OP2_SQL,
    "op3_neardup": neardup.OP3_SQL,
    "op6_decontamination": decontam.OP6_SQL,
}
