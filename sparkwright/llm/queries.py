"""Queries of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from .bpe import op5_bpe
from .chat import OP2_SQL, op2_chat
from .jaccard import OP10_SQL, op10_jaccard
from .language import op4_language
from .licenses import op6_licenses
from .merkle import OP13_SQL, op13_merkle
from .mpegts import op1_mpegts
from .neighbours import op7_neighbours
from .packing import op3_packing
from .quality import op8_quality
from .search import OP12_SQL, op12_search
from .sharding import OP11_SQL, op11_sharding
from .toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_mpegts, op2_chat, op3_packing, op4_language, op5_bpe, op6_licenses, op7_neighbours, op8_quality, op9_toxicity, op10_jaccard, op11_sharding, op12_search, op13_merkle)}
SQL = {"op2_chat": OP2_SQL, "op10_jaccard": OP10_SQL, "op11_sharding": OP11_SQL, "op12_search": OP12_SQL, "op13_merkle": OP13_SQL}
