"""Scratch tables of the operators; see ``quernel.sources.shared``."""

from quernel.sources.shared import clear, delete, materialize, new_path, shared_dir

__all__ = ["clear", "delete", "materialize", "new_path", "shared_dir"]
