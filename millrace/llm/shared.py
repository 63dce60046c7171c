"""Tables that cut lineage, and names that no table has: the library's own, for the operators here."""

from millrace.scratch import checkpointed, ensure_checkpoint_dir, unique_name

__all__ = ["checkpointed", "ensure_checkpoint_dir", "unique_name"]
