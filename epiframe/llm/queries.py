"""The queries of this subpackage and, where SQL can express them, their SQL."""

from epiframe.llm.ann import op6_ann_adaptive_scan
from epiframe.llm.bpe import op9_bpe_roundtrip
from epiframe.llm.chat import OP5_SQL, op5_chat_format
from epiframe.llm.html_text import op3_html_tree_model
from epiframe.llm.licenses import op11_license_notices
from epiframe.llm.lm_bloom import op10_lm_bloom
from epiframe.llm.manifest import OP12_SQL, op12_merkle_manifest
from epiframe.llm.mixing import OP8_SQL, op8_source_mix
from epiframe.llm.pii import op2_pii_boosting
from epiframe.llm.quality import op1_quality_mcd
from epiframe.llm.simhash import op7_simhash_pigeonring
from epiframe.llm.toxicity import op4_toxic_segments
from epiframe.llm.whitening import op13_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_quality_mcd, op2_pii_boosting, op3_html_tree_model, op4_toxic_segments, op5_chat_format, op6_ann_adaptive_scan, op7_simhash_pigeonring, op8_source_mix, op9_bpe_roundtrip, op10_lm_bloom, op11_license_notices, op12_merkle_manifest, op13_embedding_whitening)}
ORACLES = {"op5_chat_format": OP5_SQL, "op8_source_mix": OP8_SQL, "op12_merkle_manifest": OP12_SQL}
