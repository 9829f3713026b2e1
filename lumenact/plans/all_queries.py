"""Importing this module fills the catalogue."""

from . import (  # noqa: F401
    q_classify, q_corpus, q_features, q_long, q_models, q_networks, q_prompts, q_sources, q_streams, q_temporal,
)
from .catalog import ORACLES, QUERIES  # noqa: F401
