"""The corpus pipeline at the repository's top; its body is tidewell.llm.pipeline."""

from tidewell.llm.pipeline import ORACLE_SQL, STAGES, as_tokens, in_target_shares, keep_good, keep_one_of_each, keep_uncontaminated, run

__all__ = ["ORACLE_SQL", "STAGES", "as_tokens", "in_target_shares", "keep_good", "keep_one_of_each", "keep_uncontaminated", "run"]
