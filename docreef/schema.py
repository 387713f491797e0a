"""Schemas of the engine's tables, as DDL."""

LOCAL = "container string, name string, path string, size bigint, modified timestamp_ntz, hash string"
REMOTE = "container string, id string, name string, modifiedTime string, md5Checksum string, size string"
FOLDERS = "path string, name string, parent_path string, depth int"
DOMAINS = "domain string, keywords array<string>, aliases array<string>, folder_id string, color string, priority int"
PLAN = "container string, name string, action string, local_path string, remote_id string, local_hash string, remote_hash string, description string"
CHECKS = "seq int, check string, status string"
