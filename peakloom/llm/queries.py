"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .conversations import OP13_SQL, op13_conversations
from .decontaminate import op2_decontaminate
from .hmm import op7_hmm
from .jaccard import op6_jaccard
from .licenses import op8_licenses
from .mixing import op4_mixing
from .neighbours import op5_neighbours
from .quality import op1_quality
from .records import op9_records
from .runs import op11_runs
from .secrets import op3_secrets
from .substrings import OP10_SQL, op10_substrings
from .token_counts import op12_token_counts

QUERIES = {f.__name__: f for f in (op1_quality, op2_decontaminate, op3_secrets, op4_mixing, op5_neighbours, op6_jaccard, op7_hmm, op8_licenses, op9_records, op10_substrings, op11_runs, op12_token_counts, op13_conversations)}
ORACLES = {"op10_substrings": OP10_SQL, "op13_conversations": OP13_SQL}
