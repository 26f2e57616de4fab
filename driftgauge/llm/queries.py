"""Queries and oracle SQL of the training-data operators."""

from .jaccard_join import ORACLE_SQL as JACCARD_SQL
from .jaccard_join import op10_jaccard
from .language_id import op2_language_id
from .licences import ORACLE_SQL as LICENCES_SQL
from .licences import op9_licences
from .packing import op8_packing
from .repetition import ORACLE_SQL as REPETITION_SQL
from .repetition import op3_repetition
from .rule_quality import op6_quality
from .segment_bpe import op7_bpe
from .sketches import op4_fingerprints
from .token_counts import op1_token_counts
from .warc import ORACLE_SQL as WARC_SQL
from .warc import op5_warc

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_language_id, op3_repetition, op4_fingerprints, op5_warc, op6_quality, op7_bpe, op8_packing, op9_licences, op10_jaccard)}
ORACLES: dict[str, str] = {"op3_repetition": REPETITION_SQL, "op5_warc": WARC_SQL, "op9_licences": LICENCES_SQL, "op10_jaccard": JACCARD_SQL}
