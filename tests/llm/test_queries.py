import pytest
from compare import rows_of, rows_of_sql, same

from feldspark.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_sql(spark, duck, sf_dir, name):
    columns, got = rows_of(queries.queries()[name](spark, sf_dir))
    sql_columns, want = rows_of_sql(duck, queries.ORACLE[name])
    assert columns == sql_columns
    assert same(got, want)


def test_one_query_for_each_operator():
    assert [q.split("_")[0] for q in queries.queries()] == [f"op{n}" for n in range(1, 14)]


def test_contract_columns(spark, sf_dir):
    want = {
        "op1_html_extract": {"page_id", "url", "text", "n_chars"},
        "op4_chat_format": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
        "op5_matroska": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
        "op6_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op7_jaccard_join": {"doc_id", "n_shingles", "component_id"},
        "op8_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
        "op9_language_id": {"doc_id", "held_out", "lang_pred", "score"},
        "op10_jump_hash": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op11_sort_means": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
        "op12_collocations": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
        "op13_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    }
    for name, columns in want.items():
        assert columns <= set(queries.queries()[name](spark, sf_dir).columns)
