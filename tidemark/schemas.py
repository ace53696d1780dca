"""Fixed schemas of the tables; production paths never infer one."""

from __future__ import annotations

#: One source video.
ASSET = """
    asset_id string, filename string, local_path string, bytes bigint, source_fingerprint string,
    product struct<name:string,slug:string>, duration_s double, fps double, width int, height int, summary string
"""
#: A highlight as a model returns it, in a document per video.
HIGHLIGHT = """
    struct<start:double,end:double,start_s:double,end_s:double,start_time:double,end_time:double,label:string,
    visual_summary:string,source_meaning:string,source_asr:string,source_ocr:array<string>,
    hard_subtitle_risk:string,voiceover_fit:string,usable_start:double,usable_end:double,can_standalone:boolean,
    selling_points:array<string>,visual_actions:array<string>,shot_type:string>
"""
VIDEO_DOCUMENT = f"id string, asset_id string, product string, duration_s double, highlights array<{HIGHLIGHT}>"
SHOT = """
    shot_id string, asset_id string, segment_id string, idx int, start_s double, end_s double, duration_s double,
    usable_start double, usable_end double, label string, visual_summary string, source_meaning string,
    source_asr string, source_ocr array<string>, hard_subtitle_risk string, voiceover_fit string,
    can_standalone boolean, selling_points array<string>, visual_actions array<string>
"""
STORY_UNIT = """
    unit_id string, asset_id string, start_s double, end_s double, label string, visual_summary string,
    source_meaning string, child_shot_ids array<string>, boundary_source string
"""
PHYSICAL_SHOT = """
    shot_id string, parent_shot_id string, asset_id string, start_s double, end_s double, duration_s double,
    visual_summary string, source_meaning string, visual_actions array<string>, parent_visual_summary string,
    parent_source_meaning string, text_policy string, needs_refine boolean
"""
#: Long form: a row per shot and channel.
EMBEDDING = "shot_id string, channel string, mode string, status string, embedding array<float>, error string"
FINGERPRINT = """
    shot_id string, asset_id string, story_unit_id string, duration_s double, clip_sha256 string,
    phash array<bigint>, dhash array<bigint>, status string
"""
SOURCE = "source_path string, filename string, source_fingerprint string, bytes bigint, modified timestamp, suffix string"
REGISTRY = """
    source_fingerprint string, filename string, bytes bigint, status string, source_path_history array<string>,
    latest_run string, first_run string, created_at timestamp, updated_at timestamp, error_code string, error_message string
"""
SECTION = """
    section_id string, timeline_order int, role string, voice_text string, required_visual string,
    required_meaning string, intention_copy string, audio_duration_s double, keywords array<string>
"""
CAPTION = "section_id string, caption_order int, text string, start_s double, end_s double, text_source string"
CHECK = """
    id string, status string, metrics map<string,double>, blocks array<string>, warnings array<string>
"""
LOG_EVENT = "ts string, level string, stage string, run_id string, event string, data map<string,string>"
