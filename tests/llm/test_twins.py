"""Queries with a SQL twin give the twin's rows; every contract's columns are there."""

import pytest
from oracle_check import compare

from terrapath.llm import queries

COLUMNS = {
    "op1_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op6_simhash": ["doc_id", "fingerprint", "component_id"],
    "op7_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op8_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op9_jump_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op11_chat_tree": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op12_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op10_url_rules": ["page_id", "host", "path", "rule", "verdict"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, con, sf, name):
    status, _, _, _, info = compare(spark, con, queries.QUERIES[name], queries.ORACLES[name], sf)
    assert status == "ok", info


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    if name == "op11_chat_tree":
        assert df.count() == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count() + 1
        return
    source = "pages" if name == "op10_url_rules" else "documents"
    assert df.count() == spark.read.parquet(f"{sf}/{source}.parquet").count()
