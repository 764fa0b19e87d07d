"""The registered queries of this subpackage, and their SQL."""

from .bpe import op1_bpe
from .html_text import op5_html
from .language import op10_language
from .merkle import op3_fingerprints
from .mixing import op7_mixing
from .quality import op8_quality
from .sharding import op4_shards
from .simhash import op9_simhash
from .topk import OP6_SQL, op6_topk
from .warc import OP2_SQL, op2_warc

QUERIES = {f.__name__: f for f in (op1_bpe, op2_warc, op3_fingerprints, op4_shards, op5_html, op6_topk, op7_mixing, op8_quality, op9_simhash, op10_language)}
ORACLE_SQL = {"op2_warc": OP2_SQL, "op6_topk": OP6_SQL}
