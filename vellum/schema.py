"""Schemas of the engine's tables."""

from __future__ import annotations

#: One row for each note file. ``extra`` is JSON; keys the engine does not model stay in ``unmodelled``.
NOTE = (
    "path string, mtime double, id string, type string, title string, source string, url string, created date, ingested timestamp, "
    "tags array<string>, cwe array<string>, severity string, program string, assets array<string>, bounty double, links array<string>, "
    "extra string, unmodelled string, invalid map<string,string>, body string, error string"
)
#: One row for each chunk of a note.
CHUNK = (
    "id string, note_id string, slug string, type string, title string, heading string, text string, search_text string, chunk_index int, "
    "vector array<float>, source string, url string, cwe_str string, tags_str string, severity string, program string, path string, "
    "mtime double, quality int, created_ts double"
)
TOMBSTONE = "id string, url string, source string, reason string, ts string"
VERDICT = "url string, decision string, already_known string, reason string, justification string, technique_title string, when_to_try string, body_md string, tags array<string>, cwe array<string>"
CANDIDATE = "title string, url string, text string, source string, created date, source_id string, path string"

#: The note types.
NOTE_TYPES = ("report", "cve", "technique", "target", "finding", "writeup", "tool", "reference")
