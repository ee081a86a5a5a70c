"""Job parameters: frozen values passed into the operators."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ScanParams:
    """Which files of a working tree are looked at."""

    # Directories that are never scanned.
    excluded_dirs: tuple[str, ...] = (
        "node_modules",
        "vendor",
        "dist",
        "build",
        "bower_components",
        ".git",
    )
    max_file_bytes: int = 20 * 1024 * 1024
    sniff_bytes: int = 8192


@dataclass(frozen=True)
class BudgetParams:
    """How many code lines a sample may hold, and its quality goals."""

    target_loc: int = 5000
    tolerance_loc: int = 300
    cap_loc: int = 6500
    logic_share_min: float = 0.6
    low_value_share_max: float = 0.2
    test_share_min: float = 0.1
    test_share_max: float = 0.2
    primary_share_min: float = 0.20
    max_turns: int = 50
    # Request groups of one repository are spread over this many slices before
    # they are reduced to the bounded candidate list.
    salts: int = 16


@dataclass(frozen=True)
class CandidateParams:
    """Automatic choice of files when nobody supplied requests."""

    min_loc: int = 30
    preferred_min_loc: int = 100
    preferred_max_loc: int = 500
    partial_above_loc: int = 800
    # Choose files so that the shares of lines of ``BudgetParams`` hold, not by order alone.
    steer_shares: bool = False


@dataclass(frozen=True)
class TranscriptParams:
    keep_tool_results: int = 2
    keep_assistant_texts: int = 3
    long_result_chars: int = 300
    cut_result_chars: int = 150
    cut_marker: str = "\n[truncated]"
    # A rendered transcript is emitted in parts of this many messages.
    messages_per_part: int = 1024


@dataclass(frozen=True)
class RunMeta:
    """Values stamped on the manifest by the job that writes it."""

    model: str = "rules"
    sampled_at: str = "1970-01-01T00:00:00Z"
    tool_version: str = "0.1.0"


@dataclass(frozen=True)
class Settings:
    scan: ScanParams = field(default_factory=ScanParams)
    budget: BudgetParams = field(default_factory=BudgetParams)
    candidates: CandidateParams = field(default_factory=CandidateParams)
    transcript: TranscriptParams = field(default_factory=TranscriptParams)
    meta: RunMeta = field(default_factory=RunMeta)
