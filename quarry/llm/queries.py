"""The queries of the ten operators and their SQL; the pipeline is registered beside them."""

from __future__ import annotations

from . import op1_license, op2_html, op3_warc, op4_language, op5_pii, op6_simhash, op7_shards, op8_exact, op9_mix, op10_decon

QUERIES = {
    "op1_license": op1_license.op1_license, "op2_html": op2_html.op2_html, "op3_warc": op3_warc.op3_warc, "op4_language": op4_language.op4_language, "op5_pii": op5_pii.op5_pii,
    "op6_simhash": op6_simhash.op6_simhash, "op7_shards": op7_shards.op7_shards, "op8_exact": op8_exact.op8_exact, "op9_mix": op9_mix.op9_mix, "op10_decon": op10_decon.op10_decon,
}
SQL = {"op3_warc": op3_warc.SQL, "op8_exact": op8_exact.SQL, "op10_decon": op10_decon.SQL}
