"""Table schemas of a photo library, and their validation at read time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The columns of each table, as DDL.
DDL = {
    "import_root": "id BIGINT NOT NULL, path STRING, created_at TIMESTAMP_NTZ, last_scanned_at TIMESTAMP_NTZ",
    "folder": "id BIGINT NOT NULL, import_root_id BIGINT, parent_folder_id BIGINT, relative_path STRING, name STRING",
    "photo": (
        "id BIGINT NOT NULL, folder_id BIGINT, absolute_path STRING, filename STRING, extension STRING, file_size BIGINT, image_width INT, image_height INT, "
        "capture_date TIMESTAMP_NTZ, capture_date_source STRING, imported_at TIMESTAMP_NTZ, last_seen_at TIMESTAMP_NTZ, orientation INT NOT NULL, camera_make STRING, "
        "camera_model STRING, lens_model STRING, exif_extra STRING, gps_lat DOUBLE, gps_lon DOUBLE, gps_altitude DOUBLE, ai_face_detect_done BOOLEAN NOT NULL, "
        "ai_face_embed_done BOOLEAN NOT NULL, ai_clip_embed_done BOOLEAN NOT NULL, ai_lucene_index_done BOOLEAN NOT NULL, ai_last_error STRING, "
        "ai_retry_count SMALLINT NOT NULL, ai_updated_at TIMESTAMP_NTZ, ai_tag_done BOOLEAN"
    ),
    "thumbnail": "photo_id BIGINT NOT NULL, cache_path STRING, width INT, height INT, generated_at TIMESTAMP_NTZ",
    "photo_preview": "photo_id BIGINT NOT NULL, bytes BINARY NOT NULL",
    "photo_hash": "photo_id BIGINT NOT NULL, pixel_hash STRING, hashed_file_size BIGINT, hashed_at TIMESTAMP_NTZ",
    "duplicate_job": "id BIGINT NOT NULL, status STRING, started_at TIMESTAMP_NTZ, ended_at TIMESTAMP_NTZ, total_count INT, processed_count INT, group_count INT, error_message STRING",
    "duplicate_group": "id BIGINT NOT NULL, duplicate_job_id BIGINT, extension STRING, pixel_hash STRING, created_at TIMESTAMP_NTZ, accepted BOOLEAN",
    "duplicate_group_member": "id BIGINT NOT NULL, duplicate_group_id BIGINT, photo_id BIGINT",
    "face": (
        "id BIGINT NOT NULL, photo_id BIGINT NOT NULL, bbox_x DOUBLE NOT NULL, bbox_y DOUBLE NOT NULL, bbox_w DOUBLE NOT NULL, bbox_h DOUBLE NOT NULL, confidence DOUBLE NOT NULL, "
        "landmark_left_eye_x DOUBLE, landmark_left_eye_y DOUBLE, landmark_right_eye_x DOUBLE, landmark_right_eye_y DOUBLE, landmark_nose_x DOUBLE, landmark_nose_y DOUBLE, "
        "landmark_left_mouth_x DOUBLE, landmark_left_mouth_y DOUBLE, landmark_right_mouth_x DOUBLE, landmark_right_mouth_y DOUBLE, created_at TIMESTAMP_NTZ NOT NULL, "
        "thumbnail_absolute_path STRING, assignment_locked BOOLEAN NOT NULL, excluded BOOLEAN NOT NULL, cluster_id BIGINT"
    ),
    "face_embedding": "face_id BIGINT NOT NULL, embedding ARRAY<FLOAT> NOT NULL, model_ver STRING NOT NULL",
    "cluster": "id BIGINT NOT NULL, person_id BIGINT NOT NULL, centroid_embedding ARRAY<FLOAT> NOT NULL, member_count INT NOT NULL, created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ",
    "person": "id BIGINT NOT NULL, name STRING, cover_face_id BIGINT, date_of_birth DATE, notes STRING, created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ, merged_into_id BIGINT",
    "clip_embedding": "photo_id BIGINT NOT NULL, embedding ARRAY<FLOAT> NOT NULL, model_ver STRING NOT NULL",
    "tag_embedding": "id BIGINT NOT NULL, category STRING, tag STRING, embedding ARRAY<FLOAT>, model_ver STRING",
    "photo_tag": "tag_id BIGINT NOT NULL, photo_id BIGINT NOT NULL, tag_source STRING, confidence DOUBLE",
    "album": "id BIGINT NOT NULL, name STRING NOT NULL, type STRING NOT NULL, cover_photo_id BIGINT, created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ, meta_json STRING",
    "album_photo": "album_id BIGINT NOT NULL, photo_id BIGINT NOT NULL, sort_order INT NOT NULL, added_at TIMESTAMP_NTZ NOT NULL",
    "user_preferences": "pref_key STRING NOT NULL, pref_value STRING",
    "pending_action": "id BIGINT NOT NULL, type STRING NOT NULL, payload BINARY, status STRING NOT NULL, retry_count INT NOT NULL, next_attempt_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ NOT NULL, last_error STRING",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def validate(df: DataFrame, table: str) -> DataFrame:
    """``df`` itself, if it has the table's columns with the table's types; extra columns are allowed."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have.get(f.name, 'missing')}" for f in schema(table) if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"{table}: " + "; ".join(map(str, wrong)))
    return df
