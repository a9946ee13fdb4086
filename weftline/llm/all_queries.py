"""Loads every operator; the registry then holds all queries of this subpackage."""

from weftline.llm import (  # noqa: F401
    hard_negatives,
    id_files,
    line_windows,
    mixing,
    ppm,
    resampling,
    secret_scan,
    sharding,
    simhash,
    syncmers,
    variants,
    viterbi,
    wu_manber,
)
from weftline.llm.registry import CHECKS, QUERIES  # noqa: F401
