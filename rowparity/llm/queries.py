"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, lines, packing, quality, sharding, simhash, substrings, tokencount, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_best_fit_packing,
        sharding.op2_hilbert_sharding,
        warc.op3_boundary_chain,
        substrings.op4_suffix_array_dedup,
        toxicity.op5_pu_toxicity,
        lines.op6_line_runs,
        simhash.op7_simhash_golay,
        tokencount.op8_longest_match,
        decontamination.op9_spaced_seeds,
        quality.op10_kneser_ney,
    )
}

ORACLES = {
    "op3_boundary_chain": """
with p as (select page_id, coalesce(html, '') html from pages),
q as (select page_id, strlen(html) n, sha1(html) d, html from p),
best as (select d, max(page_id) first_id from q where n >= 1000 group by d)
select page_id, n payload_bytes, d payload_digest,
  case when first_id is not null and first_id <> page_id then 'revisit' else 'response' end record_type,
  case when first_id is not null and first_id <> page_id then first_id end refers_to
from q left join best using (d)
""",
    "op4_suffix_array_dedup": substrings.ORACLE_OP4,
    "op6_line_runs": lines.ORACLE_OP6,
    "op9_spaced_seeds": decontamination.ORACLE_OP9,
}
