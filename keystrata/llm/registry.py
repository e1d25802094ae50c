"""The corpus queries by name, and SQL for those that SQL can express."""

from keystrata.llm import oracles
from keystrata.llm.ann import op10_ann
from keystrata.llm.decontam import op9_decontamination
from keystrata.llm.langid import op5_language_id
from keystrata.llm.sentencepieces import op4_sentencepiece
from keystrata.llm.sharding import op7_sharding
from keystrata.llm.simhash import op1_simhash
from keystrata.llm.suffix_dedup import op2_suffix_dedup
from keystrata.llm.token_counts import op3_token_counts
from keystrata.llm.token_files import op8_token_files
from keystrata.llm.warc import op6_warc

_ALL = (op1_simhash, op2_suffix_dedup, op3_token_counts, op4_sentencepiece, op5_language_id, op6_warc, op7_sharding, op8_token_files, op9_decontamination, op10_ann)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_simhash": oracles.SIMHASH, "op2_suffix_dedup": oracles.SUFFIX_DEDUP, "op6_warc": oracles.WARC, "op7_sharding": oracles.SHARDING, "op9_decontamination": oracles.DECONTAMINATION, "op10_ann": oracles.NEAREST,
    }
