"""Tables of the news-signal model, as DDL, and the integrity rules that Spark doesn't enforce by itself."""

from __future__ import annotations

PROVENANCE = "id BIGINT, import_file_id BIGINT, source_file STRING, source_timestamp TIMESTAMP, row_number BIGINT, ingested_at TIMESTAMP, parsed_at TIMESTAMP"
LOCATION = "STRUCT<type: INT, name: STRING, countryCode: STRING, adm1Code: STRING, latitude: DOUBLE, longitude: DOUBLE, featureId: STRING>"
TONE_FIELDS = ("tone_value", "tone_positive_score", "tone_negative_score", "tone_polarity", "tone_activity_reference_density", "tone_self_group_reference_density", "tone_word_count")

IMPORT_FILES = "id BIGINT, dataset_type STRING, source_file STRING, source_url STRING, source_timestamp TIMESTAMP, checksum_sha256 STRING, status STRING, row_count BIGINT, started_at TIMESTAMP, completed_at TIMESTAMP, error_message STRING"
PAYLOADS = "id BIGINT, import_file_id BIGINT, source_file STRING, source_timestamp TIMESTAMP, row_number BIGINT, raw_tsv STRING, ingested_at TIMESTAMP"
EVENTS = f"{PROVENANCE}, global_event_id BIGINT, event_date DATE, actor1_code STRING, actor1_name STRING, actor1_country_code STRING, actor2_code STRING, actor2_name STRING, actor2_country_code STRING, event_code STRING, quad_class INT, goldstein_scale DOUBLE, avg_tone DOUBLE, source_url STRING, article_id BIGINT"
MENTIONS = f"{PROVENANCE}, global_event_id BIGINT, event_time_date TIMESTAMP, mention_time_date TIMESTAMP, mention_type INT, mention_source_name STRING, mention_identifier STRING, confidence INT, mention_doc_tone DOUBLE, article_id BIGINT"
GKG = (
    f"{PROVENANCE}, gkg_record_id STRING, document_date TIMESTAMP, source_collection_identifier INT, source_common_name STRING, document_identifier STRING, "
    "sharing_image_url STRING, page_title STRING, page_precise_pub_timestamp TIMESTAMP, article_id BIGINT, themes ARRAY<STRING>, persons ARRAY<STRING>, "
    f"organizations ARRAY<STRING>, locations ARRAY<{LOCATION}>, " + ", ".join(f"{f} {'INT' if f == 'tone_word_count' else 'DOUBLE'}" for f in TONE_FIELDS) + ", main_image_url STRING, main_image_source STRING, created_at TIMESTAMP"
)
ARTICLES = "id BIGINT, canonical_url STRING, url_hash STRING, domain STRING, first_seen_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"
EXTRACTION_ERRORS = "id BIGINT, signal_type STRING, source_id BIGINT, source_timestamp TIMESTAMP, raw_url STRING, error_code STRING, error_message STRING, created_at TIMESTAMP"
PROCESSING_ERRORS = "id BIGINT, dataset_type STRING, source_row_id BIGINT, import_file_id BIGINT, source_file STRING, source_timestamp TIMESTAMP, row_number BIGINT, failed_step STRING, error_code STRING, error_message STRING, occurred_at TIMESTAMP, resolved_at TIMESTAMP"
ARTICLE_INPUTS = "id BIGINT, clustering_version_id BIGINT, article_id BIGINT, article_ref STRING, effective_at TIMESTAMP, effective_at_source STRING, normalized_title STRING, title_input_hash STRING, title_usability STRING, article_input_fingerprint STRING, embedding_status STRING, embedding_artifact_id BIGINT, attempt_count INT, next_retry_at TIMESTAMP, current_marker SMALLINT, created_at TIMESTAMP, superseded_at TIMESTAMP"

ARTIFACTS = "id BIGINT, title_normalization_version STRING, title_input_hash STRING, embedding_model_id STRING, embedding_model_version STRING, embedding_dimension INT, normalized_title STRING, status STRING, vector_bytes BINARY, vector_hash STRING, vector_norm DECIMAL(20,10), attempt_count INT, next_retry_at TIMESTAMP, ready_at TIMESTAMP"

#: dataset -> (the column of its URL, number of columns a row needs, suffix of its files)
DATASETS = {
    "EVENTS": ("source_url", 61, "export.CSV.zip"),
    "MENTIONS": ("mention_identifier", 16, "mentions.CSV.zip"),
    "GKG": ("document_identifier", 16, "gkg.csv.zip"),
}

#: table kind -> {rule: SQL predicate that holds for every good row}
RULES = {
    "domain": {"parsed_after_ingested": "parsed_at >= ingested_at", "id_positive": "id > 0", "row_number_positive": "row_number > 0"},
    "gkg": {"image_both_or_none": "(main_image_url IS NULL) = (main_image_source IS NULL)"},
    "processing_errors": {"resolved_after_occurred": "resolved_at IS NULL OR resolved_at >= occurred_at"},
    "article_inputs": {"current_xor_superseded": "(current_marker IS NOT NULL) != (superseded_at IS NOT NULL)", "title_matrix": "(title_usability = 'USABLE') = (title_input_hash IS NOT NULL)"},
    "artifacts": {"ready_is_complete": "status != 'READY' OR (vector_bytes IS NOT NULL AND vector_hash IS NOT NULL AND vector_norm > 0 AND ready_at IS NOT NULL)", "retry_only_if_retryable": "next_retry_at IS NULL OR status = 'RETRYABLE_FAILURE'"},
    "pair_decisions": {"left_before_right": "left_ref < right_ref", "top_one_is_uncertain": "reason IS NULL OR reason != 'top-one-below-threshold-v1' OR result = 'UNCERTAIN'"},
    "memberships": {"interval": "valid_to IS NULL OR valid_to >= valid_from"},
}
