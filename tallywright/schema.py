"""Row types. Times are epoch nanoseconds; digests are lower-case hex; NULL means unknown."""

from __future__ import annotations

FILES = "path string, size long, mtime_ns long, ctime_ns long, atime_ns long, sha256 string, kind string, status string"
#: Inventories taken here also say how a file was read: o_noatime (its access time stays), restored, none, skipped (too large); NULL if it wasn't.
FILES_READ = FILES + ", access_mode string"
KINDS = ("file", "dir", "symlink", "other", "error")
STATUSES = ("ok", "stat_error", "read_error", "hash_skipped_oversize", "changed_while_read")
#: A claimed item. ord is its place in the list it came from; lists are ordered, DataFrames aren't.
ITEMS = "ord long, claimed_path string, rel string, digest string, hash_algo string, unparsed boolean, raw string, claimed_meta map<string,string>"
CERTIFICATE = "seq string, name string, ext string, size string, path string, md5 string, sha1 string, sha256 string, created string, modified string, accessed string, note string, sheet string, row int"
CHANGE_CLASSES = ("kind_changed", "content_changed", "accessed", "metadata_changed", "unchanged", "status_changed", "modified_unverifiable", "unchanged_unverifiable")
VERIFY_STATUSES = ("verified", "hash_mismatch", "unverifiable", "unparsed_item", "not_in_inventory", "ambiguous_path")
VERDICTS = ("in_scope", "in_scope_partial", "borderline", "out_of_scope", "unverifiable", "excluded")
