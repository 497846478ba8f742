"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weaksift.llm import audit, fim, lines, secrets, topk
from weaksift.llm.common import read_table
from weaksift.llm.exact import exact_dedup
from weaksift.llm.language import language_query
from weaksift.llm.mixing import mixing_query
from weaksift.llm.near import near_duplicates
from weaksift.llm.packing import packing_query
from weaksift.llm.pages import extract_text
from weaksift.llm.suffix import suffix_query
from weaksift.llm.token_files import token_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUERIES["op6_exact_dedup"] = lambda spark, sf_dir: exact_dedup(read_table(spark, sf_dir, "documents"))
ORACLES["op6_exact_dedup"] = """
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm
  from documents
)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(norm) as text_sha256
from t window g as (partition by norm)
"""
QUERIES["op8_language_id"] = lambda spark, sf_dir: language_query(read_table(spark, sf_dir, "documents"))
QUERIES["op10_mixing"] = lambda spark, sf_dir: mixing_query(read_table(spark, sf_dir, "documents"))
QUERIES["op2_best_fit_packing"] = lambda spark, sf_dir: packing_query(read_table(spark, sf_dir, "documents"))
QUERIES["op1_secret_scans"] = lambda spark, sf_dir: secrets.scan_secrets(read_table(spark, sf_dir, "documents"))
ORACLES["op1_secret_scans"] = secrets.ORACLE
QUERIES["op5_html_extraction"] = lambda spark, sf_dir: extract_text(read_table(spark, sf_dir, "pages"))
QUERIES["op7_exact_top_k"] = lambda spark, sf_dir: topk.top_k(read_table(spark, sf_dir, "embeddings"))
ORACLES["op7_exact_top_k"] = topk.ORACLE
QUERIES["op9_line_dedup"] = lambda spark, sf_dir: lines.lines_query(read_table(spark, sf_dir, "documents"))
ORACLES["op9_line_dedup"] = lines.ORACLE
QUERIES["op3_minhash_near_dedup"] = lambda spark, sf_dir: near_duplicates(read_table(spark, sf_dir, "documents"))
QUERIES["op4_suffix_array_dedup"] = lambda spark, sf_dir: suffix_query(read_table(spark, sf_dir, "documents"))
QUERIES["op11_token_files"] = lambda spark, sf_dir: token_query(read_table(spark, sf_dir, "documents"))
QUERIES["op12_filter_audit"] = audit.audit_query
ORACLES["op12_filter_audit"] = audit.ORACLE
QUERIES["op13_fill_in_middle"] = lambda spark, sf_dir: fim.fim_query(read_table(spark, sf_dir, "documents"))
ORACLES["op13_fill_in_middle"] = fim.ORACLE
