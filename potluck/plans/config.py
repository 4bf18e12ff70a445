"""Settings of the extraction pipeline: nested groups, with flat arguments that override them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame


class LogLevel(str, Enum):
    NONE = "NONE"
    DEBUG = "DEBUG"
    INFO = "INFO"
    WARNING = "WARNING"

    @classmethod
    def of(cls, text: str) -> LogLevel:
        return cls(text) if text in cls._value2member_map_ else cls.INFO


@dataclass(frozen=True)
class Extraction:
    use_pattern_extraction: bool = True
    include_raw_content: bool = True
    min_quality_score: int = 20
    # kept for callers that set them; they have no effect on extraction
    split_by_headers: bool = True
    header_split_level: int | None = None
    custom_validators: tuple = ()
    validate_recipes: bool = True
    extract_toc: bool = True


@dataclass(frozen=True)
class ABTest:
    enabled: bool = False
    use_new_method: bool = False
    log_level: LogLevel = LogLevel.INFO
    success_threshold: int = 25


_FLAT_AB = {"enable_ab_testing": "enabled", "ab_test_use_new": "use_new_method", "ab_test_log_level": "log_level", "ab_test_success_threshold": "success_threshold"}


@dataclass(frozen=True)
class Components:
    """Parts of the pipeline that a caller may replace; None is the default.

    parser, ingredients and instructions run in the passes over markup, so they are Python functions that workers can import:
    markup -> Node, and (Node, text) -> text or (text, details). The others are Column functions: validator(text, title) -> boolean,
    metadata(text, title) -> struct of the five fields, scorer(ingredients, instructions, serves, prep_time, cook_time, cooking_method, protein_type) -> number.
    """

    parser: Callable | None = None
    ingredients: Callable | None = None
    instructions: Callable | None = None
    validator: Callable | None = None
    metadata: Callable | None = None
    scorer: Callable | None = None


DEFAULT = Components()


@dataclass(frozen=True)
class Config:
    extraction: Extraction = field(default_factory=Extraction)
    ab_testing: ABTest = field(default_factory=ABTest)
    #: Extra stages, each DataFrame -> DataFrame, applied to the valid sections before extraction.
    stages: tuple = ()
    components: Components = DEFAULT

    @classmethod
    def of(cls, extraction: Extraction | None = None, ab_testing: ABTest | None = None, stages: tuple = (), components: Components = DEFAULT, **flat) -> Config:
        """Flat arguments that are not None win over the nested ones; an unknown log level means INFO."""
        given = {k: x for k, x in flat.items() if x is not None}
        ab = {_FLAT_AB[k]: LogLevel.of(x) if k == "ab_test_log_level" else x for k, x in given.items() if k in _FLAT_AB}
        rest = {k: x for k, x in given.items() if k not in _FLAT_AB}
        return cls(replace(extraction or Extraction(), **rest), replace(ab_testing or ABTest(), **ab), stages, components)

    def apply(self, sections: DataFrame) -> DataFrame:
        for stage in self.stages:
            sections = sections.transform(stage)
        return sections
