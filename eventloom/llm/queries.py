"""The queries of this subpackage, and SQL for those that SQL can express."""

from .alignment import op13_token_alignment
from .chat import OP8_SQL, op8_chat
from .language import op1_language_id
from .leakage import OP9_SQL, op9_decontamination
from .nearcopies import OP10_SQL, op10_ngram_jaccard
from .packing import op3_packing
from .prefixes import OP12_SQL, op12_prefix_trie
from .privacy import op7_pii
from .quality import OP6_SQL, op6_quality
from .secrets import op5_secrets
from .sharding import OP11_SQL, op11_sharding
from .toxicity import op2_toxicity
from .warc import OP4_SQL, op4_warc

QUERIES = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_packing, op4_warc, op5_secrets, op6_quality, op7_pii, op8_chat, op9_decontamination, op10_ngram_jaccard, op11_sharding, op12_prefix_trie, op13_token_alignment)}
ORACLES = {"op4_warc": OP4_SQL, "op6_quality": OP6_SQL, "op8_chat": OP8_SQL, "op9_decontamination": OP9_SQL, "op10_ngram_jaccard": OP10_SQL, "op11_sharding": OP11_SQL, "op12_prefix_trie": OP12_SQL}
