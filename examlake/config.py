"""One configuration for the whole engine."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds and switches; the defaults are those of the documented behaviour."""

    input_directory: str = "./data/input"
    file_glob: str = "Questions_*.pdf"
    look_back: int = 20
    look_ahead: int = 50
    min_context_chars: int = 16
    min_block_chars: int = 50
    min_confidence: float = 0.3
    max_questions: int | None = None
    duplicate_threshold: tuple[int, int] = (4, 5)
    rule_set: str = "safe"
    enhance: tuple[str, ...] = ("page_breaks", "ocr", "format", "grammar", "terms", "cleanup")
    use_model: bool = True
    requests_per_minute: int = 50
    model_attempts: int = 3
    description_chars: int = 200
    options_chars: int = 300
    report_rows: int = 20
    # fixed values: the report's header
    columns: tuple[str, ...] = field(
        default=(
            "Question No",
            "Question Description",
            "Answer Options",
            "Community Answer",
            "Highly Voted Answer",
            "Most Recent Answer",
            "Claude Answer",
            "Latest Date",
            "Topic",
            "Page Number",
            "Source",
        )
    )

    @classmethod
    def of(cls, settings: dict) -> "EngineConfig":
        """The defaults with what a configuration document holds of them (see FILE_KEYS); other keys are left alone."""
        found = {}
        for name, places in FILE_KEYS.items():
            for section, key in places:
                value = settings.get(section, {})
                value = value.get(key) if isinstance(value, dict) else None
                if value is not None:
                    found[name] = tuple(value) if isinstance(value, list) else value
        return cls(**found)


#: Field -> (section, key) in configuration documents; a later one goes before.
FILE_KEYS: dict[str, tuple[tuple[str, str], ...]] = {
    "input_directory": (("paths", "input_directory"), ("pdf_processing", "input_directory")),
    "file_glob": (("pdf_processing", "file_pattern"),),
    "min_block_chars": (("question_detection", "minimum_question_length"),),
    "requests_per_minute": (("claude", "requests_per_minute"), ("rate_limiting", "requests_per_minute")),
    "model_attempts": (("claude", "max_retries"),),
    "columns": (("output_format", "columns"),),
}

DEFAULT = EngineConfig()
