"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann_forest, bin_completion, block_max_wand, chain_dedup, hash_tree, line_crf, piece_encoding, simhash, url_filter, warc_zstd

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_prefix_forest": ann_forest.op2_prefix_forest,
    "op3_chain_dedup": chain_dedup.op3_chain_dedup,
    "op4_bin_completion": bin_completion.op4_bin_completion,
    "op5_block_max_wand": block_max_wand.op5_block_max_wand,
    "op6_line_crf": line_crf.op6_line_crf,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_warc_zstd": warc_zstd.op8_warc_zstd,
    "op9_piece_offsets": piece_encoding.op9_piece_offsets,
    "op10_hash_tree": hash_tree.op10_hash_tree,
}

#: Base32 from the SHA-1's hex digits: 5 hex digits are 4 base32 digits.
WARC = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body) as n, sha1(body) as h, max(page_id) over (partition by body) as newest from p),
b as (select *, list_transform(range(8), lambda i: cast('0x' || substr(h, 5 * i + 1, 5) as bigint)) as v from d)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((x >> s) & 31 as bigint) + 1, 1)), '')), '') as payload_digest,
  case when page_id = newest then 'response' else 'revisit' end as record_type,
  case when page_id = newest then null else newest end as refers_to
from b
"""

ORACLES = {"op5_block_max_wand": block_max_wand.ORACLE, "op8_warc_zstd": WARC}
