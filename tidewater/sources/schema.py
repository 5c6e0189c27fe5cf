"""Declared schemas; nothing is inferred. Fields that a record lacks are null."""

PERSON = "STRUCT<_account_id: BIGINT, name: STRING, username: STRING, email: STRING>"
FILES = "MAP<STRING, STRUCT<lines_inserted: INT, lines_deleted: INT, size_delta: INT>>"
MESSAGE = f"STRUCT<id: STRING, author: {PERSON}, date: STRING, message: STRING, tag: STRING, revision_number: INT>"
SIGNATURE = "STRUCT<name: STRING, email: STRING, date: STRING>"
COMMIT = f"STRUCT<message: STRING, author: {SIGNATURE}, committer: {SIGNATURE}, parents: ARRAY<STRUCT<commit: STRING>>>"
REVISION = f"STRUCT<_number: INT, created: STRING, files: {FILES}, commit: {COMMIT}>"

CHANGE = (
    "change_number BIGINT, change_id STRING, component STRING, project STRING, branch STRING, subject STRING, message STRING, status STRING, created STRING, updated STRING, submitted STRING, "
    f"owner {PERSON}, messages ARRAY<{MESSAGE}>, comments MAP<STRING, ARRAY<{MESSAGE}>>, reviewers MAP<STRING, ARRAY<{PERSON}>>, current_revision STRING, revisions MAP<STRING, {REVISION}>, "
    f"files {FILES}, file_changes {FILES}, commit_ids ARRAY<STRING>, insertions INT, deletions INT"
)
CHECKLIST = "PRNumber INT, author STRING, comment STRING, request STRING, confirmation STRING"
RELEASE = "project STRING, version STRING, release_date STRING"
PREDICTION = "d INT, p INT, repeat INT, t STRING, change_id BIGINT, y_true DOUBLE, y_pred DOUBLE"
DELIVERABLE = "component STRING, releases ARRAY<STRUCT<version: STRING, date: STRING, notes_url: STRING, projects: ARRAY<STRUCT<repo: STRING>>>>"
