"""Checking SQL of the round trips: what was written must come back."""

from __future__ import annotations

from . import document_oracle  # noqa: F401  its texts are read below
from .registry import ORACLE, oracle

#: What decoding makes of a text: no replacement characters, and line ends of one kind.
_READ = r"regexp_replace(replace(content, chr(65533), ''), '\r\n?', chr(10), 'g')"
_SEEN = f"SELECT repo, file_path, CAST(length({_READ}) AS INTEGER) AS chars, sha256({_READ}) AS sha256 FROM "
oracle("scan_corpus", "kept", _SEEN + "kept")
oracle("scan_zip", "files", _SEEN + "files")
_WHOLE = " UNION ALL ".join(f"SELECT * FROM ({ORACLE[name]})" for name in ("doc_architecture", "doc_setup"))
oracle("write_documents", "", f"""SELECT repo || '/' || doc_name AS path, string_agg(content, '' ORDER BY sec, part) AS content
  FROM ({_WHOLE}) GROUP BY repo, doc_name""")
oracle("write_bundles", "", ORACLE["write_documents"])
oracle("write_file_documents", "", f"""SELECT repo || '/files/' || CASE WHEN sharing > 1
    THEN regexp_replace(file_path, '[^A-Za-z0-9.-]', '~', 'g') || '.md' ELSE doc_name END AS path, content FROM ({ORACLE['doc_per_file']})""")
oracle("write_results_json", "", f"SELECT repo, json FROM ({ORACLE['result_json']})")
