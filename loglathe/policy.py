"""Policy of the fold engine: constants, validated as a whole."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

#: Limits that are not tunable.
WINDOW_TOKENS, LEASE_GENERATIONS, MAX_LEASES = 272_000, 8, 64
RECLAIM_FLOOR, PIN_CAP = 0.02, 0.25
MAX_MARKS, BYTES_PER_TOKEN, PLACEHOLDER_BYTES, MIN_PEEK_BYTES = 256, 4, 240, 1024
STATUS_BYTES, SPAN_CAP, WEDGE_TOKENS, PEEK_BYTES, PEEK_HEAD_SHARE = 24_000, 16_000, 256, 16_000, 0.6
MAX_RECORD_BYTES, MAX_EVENT_BYTES, MAX_FOLDS, MAX_PARTS = 256 << 10, 512 << 10, 4096, 1024
RESERVE_TOKENS, RESERVE_SHARE = 16_384, 0.1
MIN_BUDGET_TOKENS, MIN_FRESH_TOKENS = 10_000, 500


@dataclass(frozen=True)
class Policy:
    """All tunable thresholds; ``resolve`` replaces some and checks all."""

    max_target: float = 0.80
    min_target: float = 0.20
    fresh_tail: float = 0.02
    consolidate_after: int = 10
    refold_ratio: float = 0.85
    prepare_ratio: float = 0.90
    response_reserve: int = 16_384
    min_tool_chars: int = 2_000
    min_chapter_chars: int = 4_000
    max_chapter_chars: int = 128_000
    max_chapter_turns: int = 4
    max_source_chars: int = 200_000
    max_fold_source_refs: int = 256
    max_brief_chars: int = 2_000
    orientation_messages: int = 2
    max_orientation_chars: int = 12_000
    budget_tokens: int = WINDOW_TOKENS

    @staticmethod
    def resolve(**changes) -> "Policy":
        known = {f.name for f in fields(Policy)}
        if extra := sorted(set(changes) - known):
            raise ValueError(f"unknown policy fields: {', '.join(extra)}")
        p = replace(Policy(), **changes)
        for name in ("max_target", "min_target", "fresh_tail", "refold_ratio", "prepare_ratio"):
            if not 0 < getattr(p, name) < 1:
                raise ValueError(f"{name} must be between 0 and 1")
        for ok, why in (
            (p.min_target < p.max_target, "min_target must be below max_target"),
            (p.fresh_tail < p.min_target, "fresh_tail must be below min_target"),
            (p.max_target <= p.refold_ratio <= p.prepare_ratio, "max_target, refold_ratio and prepare_ratio must not fall"),
            (isinstance(p.consolidate_after, int) and p.consolidate_after >= 2, "consolidate_after must be 2 or more"),
            (p.min_chapter_chars <= p.max_chapter_chars, "a chapter's bounds must not cross"),
        ):
            if not ok:
                raise ValueError(why)
        return p

    def servable(self) -> "Policy":
        if self.budget_tokens < MIN_BUDGET_TOKENS:
            raise ValueError(f"the budget must be {MIN_BUDGET_TOKENS} tokens or more")
        if self.fresh_tail * self.budget_tokens < MIN_FRESH_TOKENS:
            raise ValueError(f"the fresh tail must be {MIN_FRESH_TOKENS} tokens or more")
        return self

    def zone_bytes(self, share: float) -> int:
        return int(share * self.budget_tokens * BYTES_PER_TOKEN)


#: The policy for the small test conversations.
SCALED = Policy.resolve(budget_tokens=1_000, min_chapter_chars=200, max_chapter_chars=1_500, consolidate_after=2, min_tool_chars=20, fresh_tail=0.1)


def serving_budget(window: int) -> int:
    return window - min(RESERVE_TOKENS, int(RESERVE_SHARE * window))
