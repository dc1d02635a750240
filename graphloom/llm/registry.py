"""The subpackage's queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from . import bpe, embeddings, jaccard, langid, licenses, mixing, oracles, packing, quality, sharding, suffix
from .common import prepare

_QUERIES = {
    "op1_hash_tree_sharding": sharding.query,
    "op2_bpe_round_trip": bpe.query,
    "op3_hyperdimensional_language_id": langid.query,
    "op4_divergence_quality": quality.query,
    "op5_diagonal_license_scan": licenses.query,
    "op6_ngram_jaccard_join": jaccard.query,
    "op7_hyperplane_near_duplicates": embeddings.query,
    "op8_pfair_mixing": mixing.query,
    "op9_run_length_repeats": suffix.query,
    "op10_packed_token_ids": packing.query,
}


def _prepared(query):
    def run(spark, sf_dir):
        prepare(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _prepared(query) for name, query in _QUERIES.items()}
#: The other operators (checksums, tokenizers, learned models, byte windows, packing) are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_diagonal_license_scan": oracles.license_sql(),
    "op6_ngram_jaccard_join": oracles.JACCARD,
    "op7_hyperplane_near_duplicates": oracles.EMBEDDINGS,
    "op8_pfair_mixing": oracles.mixing_sql(mixing.PERIOD, mixing.BLOCK_ROWS),
}
