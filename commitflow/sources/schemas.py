"""Declared schemas: nothing is inferred at scale."""

from __future__ import annotations

MOD = "struct<change_type:string,old_path:string,new_path:string,diff:string>"

COMMIT = (
    "author bigint, date string, timezone int, hash string, message string, "
    f"mods array<{MOD}>, language string, license string, repo string, original_message string"
)

CHOICES = "array<struct<message:struct<role:string,content:string>>>"

# Shape "body": {custom_id, response: {body: {choices}}}; shape "flat": {choices} at the top.
RESPONSE_BODY = f"custom_id string, response struct<body:struct<choices:{CHOICES}>>"
RESPONSE_FLAT = f"custom_id string, choices {CHOICES}"

MODEL_OUTPUT = "generated_commit string, reference_commit string"
