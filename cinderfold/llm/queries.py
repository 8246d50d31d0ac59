"""Queries of this subpackage and, where SQL can say the same, their oracle."""

from __future__ import annotations

from cinderfold.llm.language_id import op2_language_id
from cinderfold.llm.media import op9_media_columns
from cinderfold.llm.mixing import OP3_SQL, op3_mixing
from cinderfold.llm.nearest import op7_nearest
from cinderfold.llm.packing import op8_best_fit_packing
from cinderfold.llm.pii import op5_pii
from cinderfold.llm.repeats import op10_repeats
from cinderfold.llm.simhash import op6_simhash
from cinderfold.llm.token_counts import op4_token_counts
from cinderfold.llm.token_output import op1_token_output

QUERIES = {f.__name__: f for f in (op1_token_output, op2_language_id, op3_mixing, op4_token_counts, op5_pii, op6_simhash, op7_nearest, op8_best_fit_packing, op9_media_columns, op10_repeats)}

ORACLE_SQL = {"op3_mixing": OP3_SQL}
