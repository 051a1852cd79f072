"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .ann import op3_nearest_neighbours
from .decontaminate import op6_decontamination
from .license_scan import OP2_SQL, op2_license_scan
from .mixing import OP4_SQL, op4_mix_sources
from .pii import op1_pii_surrogates
from .quality import op10_quality_classifier
from .secrets import op5_secret_scan
from .simhash import op7_simhash_dedup
from .suffix_dedup import op8_suffix_dedup
from .url_filter import OP9_SQL, op9_url_filter

QUERIES = {f.__name__: f for f in (op1_pii_surrogates, op2_license_scan, op3_nearest_neighbours, op4_mix_sources, op5_secret_scan, op6_decontamination, op7_simhash_dedup, op8_suffix_dedup, op9_url_filter, op10_quality_classifier)}
ORACLE_SQL = {"op2_license_scan": OP2_SQL, "op4_mix_sources": OP4_SQL, "op9_url_filter": OP9_SQL}
