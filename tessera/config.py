"""Settings of the pipeline; a frozen value that can be passed to executors."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

#: Chunk budgets by kind of document: most words, words of overlap, unit (fixed values).
CHUNK_BUDGETS = {"srs": (512, 51, "sentence"), "user_manual": (512, 51, "sentence"), "runtime": (256, 26, "line"), "design": (384, 38, "element")}
DEFAULT_BUDGET = (512, 51, "sentence")


@dataclass(frozen=True)
class PipelineConfig:
    item_cap: int = field(default_factory=lambda: int(os.environ.get("TESSERA_ITEM_CAP", "10")))
    similar_above: float = 0.75
    horizon: int = 19
    q_h: float = 0.78
    q_a: float = 0.85
    traceability: float = 0.90
    coverage: float = 0.95
    max_iterations: int = 2
    flagged_sent: int = 8
    gaps_sent: int = 8
    gap_rows: int = 10
    #: keep: rows without a replacement stay; reference: they are deleted
    feedback_mode: str = "keep"

    def caps(self) -> dict[str, int]:
        n = self.item_cap
        return {"actor_role": n, "interface_name": n, "function_point": 2 * n, "process_step": n, "constraint": 2 * n, "exception_condition": 3 * n, "glossary_term": 3 * n}
