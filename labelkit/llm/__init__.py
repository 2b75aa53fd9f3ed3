"""Operations of a large training-data pipeline. Nothing else in the library imports this subpackage."""

from labelkit.llm import (  # noqa: F401
    decontaminate,
    jaccard,
    langid,
    licenses,
    lines,
    packing,
    periodic,
    pii,
    quality,
    secrets,
    sketches,
    spelling,
    warc,
)
from labelkit.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
