"""Where a workflow's results lie below one base folder."""

from __future__ import annotations

import os
from dataclasses import dataclass


def resolve(root: str, path: str) -> str:
    """An absolute path as it is, another one below root."""
    return path if os.path.isabs(path) or "://" in path else os.path.join(root, path)


@dataclass(frozen=True)
class Layout:
    base: str

    raw_export = property(lambda s: os.path.join(s.base, "0_raw_export"))
    split_json = property(lambda s: os.path.join(s.base, "1_split_json"))
    notion_md = property(lambda s: os.path.join(s.base, "2_notion_md"))
    notion_md_renamed = property(lambda s: os.path.join(s.base, "3_notion_md_renamed"))
    notion_md_split = property(lambda s: os.path.join(s.base, "4_notion_md_renamed_split"))
    notion_md_renamed_split = notion_md_split
    zip_batches = property(lambda s: os.path.join(s.base, "5_zip_batches"))
    zip_batches_diff = property(lambda s: os.path.join(s.base, "5_zip_batches_diff"))
    report = property(lambda s: os.path.join(s.base, "6_report"))
    filename_mapping_csv = property(lambda s: os.path.join(s.report, "filename_mapping.csv"))
    snapshot_dir = property(lambda s: os.path.join(s.base, "_snapshot"))
    #: The snapshot is a Parquet table beside this name, where export.write_snapshot_json puts its JSON form.
    snapshot_path = property(lambda s: os.path.join(s.snapshot_dir, "snapshot.json"))
    snapshot_table = property(lambda s: os.path.join(s.snapshot_dir, "snapshot.parquet"))
