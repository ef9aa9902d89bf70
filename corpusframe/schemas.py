"""Record kinds as schemas, and sentinel values that results keep."""

from __future__ import annotations

TRAINING = "audio STRING, text STRING, dialect STRING"
EVALUATION = "utt_id STRING, audio STRING, refs ARRAY<STRING>, domain STRING, dataset STRING"
BLIND = EVALUATION + ", row INT"
HYPOTHESIS = "utt_id STRING, dataset STRING, ref STRING, hyp STRING"
ALIGNMENT = (
    "audio STRING, dialect STRING, text STRING, duration DOUBLE, n_frames INT, frame_stride DOUBLE, "
    "time_offset DOUBLE, words ARRAY<STRUCT<w: STRING, start: DOUBLE, end: DOUBLE, aligned: BOOLEAN>>, "
    "score DOUBLE, error STRING"
)
SHORT_CLIP = (
    "audio STRING, text STRING, dialect STRING, duration DOUBLE, src STRING, span ARRAY<INT>, "
    "t0 DOUBLE, t1 DOUBLE, gap DOUBLE, nw INT"
)
SEGMENT = "ID STRING, dialect STRING, source STRING, path STRING, start_s DOUBLE, dur_s DOUBLE"
PROBLEM = "id STRING, split STRING, dialect STRING, dur_s DOUBLE, speech_s DOUBLE, speech_ratio DOUBLE, reason STRING"
DURATION = "ID STRING, duration DOUBLE"
CONVERSION = "id STRING, dialect STRING, duration_s DOUBLE, source_id STRING, target_voice STRING"
CLIP = "id STRING, duration_s DOUBLE, transcription STRING"
EMBEDDING = "id STRING, country STRING, embedding ARRAY<FLOAT>"
VOICE = "clips ARRAY<STRING>, wav_paths ARRAY<STRING>, dur DOUBLE, n_video INT, cohesion DOUBLE, dialects ARRAY<STRING>"
SOURCE_AUDIO = "id STRING, transcription STRING, audio STRUCT<bytes: BINARY, path: STRING>"

#: A gap at a true edge, an unreadable duration, a masked label.
EDGE_GAP, UNREADABLE, MASKED = 9.0, -1.0, -100
