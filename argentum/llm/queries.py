"""The queries of this package, and DuckDB SQL for those that SQL can express."""

from argentum.llm import op1_outliers, op3_urls, op7_licenses, op8_substrings, op9_lines, op10_mixing
from argentum.llm.op2_language import op2_language
from argentum.llm.op4_bpe import op4_bpe
from argentum.llm.op5_ogg import op5_ogg
from argentum.llm.op6_simhash import op6_simhash

QUERIES = {f.__name__: f for f in (op1_outliers.op1_outliers, op2_language, op3_urls.op3_urls, op4_bpe, op5_ogg, op6_simhash, op7_licenses.op7_licenses, op8_substrings.op8_substrings, op9_lines.op9_lines, op10_mixing.op10_mixing)}
ORACLE_SQL: dict[str, str] = {"op1_outliers": op1_outliers.oracle(), "op3_urls": op3_urls.oracle(), "op7_licenses": op7_licenses.oracle(), "op8_substrings": op8_substrings.ORACLE, "op9_lines": op9_lines.ORACLE, "op10_mixing": op10_mixing.ORACLE}
