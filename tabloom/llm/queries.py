"""Registry of the numbered queries and their SQL."""

from __future__ import annotations

from tabloom.llm.collocations import OP12_SQL, op12_collocations
from tabloom.llm.decontaminate import OP6_SQL, op6_decontaminate
from tabloom.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from tabloom.llm.langid import op10_langid
from tabloom.llm.mixing import op4_mixing
from tabloom.llm.quality import OP13_SQL, op13_quality
from tabloom.llm.secrets import op7_secrets
from tabloom.llm.simhash import op1_simhash
from tabloom.llm.suffix_dedup import op5_suffix_dedup
from tabloom.llm.token_files import op2_token_files
from tabloom.llm.toxicity import op8_toxicity
from tabloom.llm.warc import OP9_SQL, op9_warc
from tabloom.llm.whitening import op11_whitening

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_files": op2_token_files,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mixing": op4_mixing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_secrets": op7_secrets,
    "op8_toxicity": op8_toxicity,
    "op9_warc": op9_warc,
    "op10_langid": op10_langid,
    "op11_whitening": op11_whitening,
    "op12_collocations": op12_collocations,
    "op13_quality": op13_quality,
}

ORACLES = {
    "op3_exact_dedup": OP3_SQL,
    "op6_decontaminate": OP6_SQL,
    "op9_warc": OP9_SQL,
    "op12_collocations": OP12_SQL,
    "op13_quality": OP13_SQL,
}
