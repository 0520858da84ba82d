"""Scalar functions of the catalogue: tags, labels, times, sizes, paths, matching, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of a snapshot's labels and note, in bytes of UTF-8.
MOST_LABELS, MOST_LABEL_BYTES, MOST_NOTE_BYTES = 16, 64, 2048
DEFAULT_TAG, TRASH_DAYS = "DAILY", 7
#: Fixed texts of error presentations: (what the message holds in lower case, summary, hint), first match first.
ERRORS = (
    ("context canceled", "Operation cancelled", "No further work was started. Review partial output before retrying."),
    ("repository key-check failed: passphrase/salt mismatch", "Repository credentials do not match", "Reconnect using the passphrase and salt originally used for this repository."),
    ("repository contains data but no key-check metadata; run init with bind-existing", "Repository key-check metadata is missing", "Open Setup and bind the existing repository only after confirming its credentials."),
    ("repository is busy", "Repository is busy", "Wait for the active backup, retention, or metadata operation to finish, then retry."),
    ("permission denied", "Permission denied", "Check read/write permissions for the source, destination, and repository paths."),
    ("snapshot not found", "Snapshot was not found", "Refresh the snapshot catalog and select an existing snapshot."),
    ("authentication failed", "Encrypted data could not be authenticated", "Verify repository credentials. If they are correct, run Doctor and restore damaged data from another copy."),
    ("hash mismatch|decode error", "Repository data appears corrupted", "Run Doctor, avoid garbage collection, and restore affected repository files from another copy."),
)
NO_ERROR_MATCH = ("Operation failed", "Review the operation inputs and run it again.")


def tag_split(tags: Column, allow_empty: bool = False) -> Column:
    """Comma-separated tags, trimmed, without empty ones; DAILY where none are left, unless that is allowed."""
    parts = F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return parts if allow_empty else F.when(F.size(parts) == 0, F.array(F.lit(DEFAULT_TAG))).otherwise(parts)


def label_error(labels: Column, note: Column) -> Column:
    """Why labels or note are over a limit (bytes, before duplicates go), or null."""
    return (
        F.when(F.size(labels) > MOST_LABELS, F.lit(f"more than {MOST_LABELS} labels"))
        .when(F.exists(labels, lambda x: F.octet_length(F.trim(x)) > MOST_LABEL_BYTES), F.lit(f"a label is longer than {MOST_LABEL_BYTES} bytes"))
        .when(F.octet_length(note) > MOST_NOTE_BYTES, F.lit(f"the note is longer than {MOST_NOTE_BYTES} bytes"))
    )


def label_normalise(labels: Column) -> Column:
    """Labels trimmed, without empty ones and without case-insensitive repeats; the first spelling stays."""
    clean = F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: x != "")
    lower = F.transform(clean, lambda x: F.lower(x))
    return F.filter(clean, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def trash_times(state: Column, now: Column, seconds: Column) -> tuple[Column, Column]:
    """(trashed_at, purge_after) of trashing now: 0 seconds mean the default; null where already trashed or negative."""
    fresh = (F.coalesce(state, F.lit("active")) != "trashed") & (seconds >= 0)
    wait = F.when(seconds == 0, F.lit(TRASH_DAYS * 86400)).otherwise(seconds)
    return F.when(fresh, now), F.when(fresh, F.timestamp_seconds(F.unix_timestamp(now) + wait))


def parse_time(text: Column) -> Column:
    """A time as users write it: RFC 3339, date and minute, or date; null if none fits. Times without zone are of the session's."""
    shapes = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(s)) for s in shapes))


def human_bytes(size: Column, step: int = 1024) -> Column:
    """A size for people: step 1024 gives B, KiB, MiB, ..., step 1000 gives B, kB, MB, ...; one decimal below 10."""
    units = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB") if step == 1024 else ("B", "kB", "MB", "GB", "TB", "PB", "EB")
    out = F.concat(size.cast("string"), F.lit(" B"))
    for i, unit in enumerate(units[1:], 1):
        value = F.floor(size / F.lit(float(step**i)) * 10 + 0.5) / 10
        text = F.when(value < 10, F.format_number(value, 1)).otherwise(F.regexp_replace(F.format_number(value, 0), ",", ""))
        out = F.when(size >= step**i, F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return out


def fuzzy_match(name: Column, query: str) -> Column:
    """Whether the query's characters occur in the name in their order; an empty query always does."""
    pattern = ".*".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in query.lower())
    return F.lower(name).rlike(f"(?s){pattern}") if query else F.lit(True)


def normalise_path(path: Column, base: str | None = None) -> Column:
    """Slashes only, no doubled ones, and without the base directory in front; the base itself gives its last part."""
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    if base is None:
        return clean
    root = base.rstrip("/")
    return F.when(clean == root, F.lit(root.rpartition("/")[2])).when(F.startswith(clean, F.lit(root + "/")), F.substring(clean, len(root) + 2, 2**31 - 1)).otherwise(clean)


def safe_relative_path(path: Column) -> Column:
    """Whether a restored path stays inside its destination: relative and without `..` parts."""
    return ~path.rlike(r"^/|(^|/)\.\.(/|$)") & (path != "")


def rfc3339(time: Column) -> Column:
    """A time as RFC 3339 in the session's zone, to the second; null for none."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ssXXX")


def local_time(time: Column) -> Column:
    """A time for people: date, minute and the zone's short name."""
    return F.date_format(time, "yyyy-MM-dd HH:mm z")


def path_completions(names: DataFrame, typed: str, most: int = 50) -> DataFrame:
    """The names (column name) that begin with what was typed, in order, `most` of them at most: a top-k."""
    return names.filter(F.startswith("name", F.lit(typed))).select("name").distinct().orderBy("name").limit(most)


def present_error(message: Column) -> tuple[Column, Column]:
    """(summary, hint) for an error message; null for none. Causes are known by the texts that wrapped errors end in."""
    text, summary, hint = F.lower(message), F.lit(NO_ERROR_MATCH[0]), F.lit(NO_ERROR_MATCH[1])
    held = lambda kind: F.greatest(*(F.contains(text, F.lit(k)).cast("int") for k in kind.split("|")), F.lit(0)) == 1
    for kind, s, h in reversed(ERRORS):
        summary, hint = F.when(held(kind), F.lit(s)).otherwise(summary), F.when(held(kind), F.lit(h)).otherwise(hint)
    return F.when(message.isNotNull(), summary), F.when(message.isNotNull(), hint)


def hex_id(value: Column) -> Column:
    """The 32 bytes of a hex id; null unless it is 64 hex digits."""
    return F.when(value.rlike("^[0-9A-Fa-f]{64}$"), F.unhex(value))


def catalog_search(snapshot_id: Column, status: Column, ts: Column, state: Column, labels: Column, note: Column, query: str) -> Column:
    """Whether a catalogue row holds the query (trimmed, any case) in its id, status, date, state or labels, or in its note; an empty query finds all."""
    q = query.strip().lower()
    shown = F.concat_ws(" ", snapshot_id, status, F.date_format(ts, "yyyy-MM-dd HH:mm"), state, F.array_join(labels, " "))
    return F.contains(F.lower(shown), F.lit(q)) | F.contains(F.lower(F.coalesce(note, F.lit(""))), F.lit(q))
