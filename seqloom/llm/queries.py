"""The queries of this subpackage."""

from seqloom.llm.ann import op5
from seqloom.llm.chat_format import op3
from seqloom.llm.html_extract import op7
from seqloom.llm.lang_id import op8
from seqloom.llm.mixing import op10
from seqloom.llm.oracles import CHAT, MIXING
from seqloom.llm.packing import op4
from seqloom.llm.pii import op6
from seqloom.llm.quality_rules import op1
from seqloom.llm.sharding import op2
from seqloom.llm.simhash import op9

QUERIES = {
    "op1_quality_rules": op1,
    "op2_sharding": op2,
    "op3_chat_format": op3,
    "op4_packing": op4,
    "op5_ann": op5,
    "op6_pii": op6,
    "op7_html": op7,
    "op8_language_id": op8,
    "op9_simhash": op9,
    "op10_mixing": op10,
}

#: The others have iterations, hashes, vocabularies or patterns with places that SQL lacks; their tests
#: hold them against brute-force versions.
ORACLE_SQL = {"op3_chat_format": CHAT, "op10_mixing": MIXING}
