"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""

from .bpe import BpeTables, decode_ids, encode_documents
from .exact_dedup import exact_groups
from .host_reputation import host_reputation
from .jaccard_join import jaccard_components
from .language_id import fit_language_network, predict_language
from .manifest import folded, merkle_manifest, row_digest, siblings
from .packing import pack_documents
from .quality_model import fit_quality, quality_features, score_quality
from .quality_rules import quality_rules
from .secret_scan import find_secrets, redact, train_markov
from .sharding import rendezvous_shards
from .spelling import spelling_groups
from .token_counts import token_counts

__all__ = [
    "BpeTables",
    "decode_ids",
    "encode_documents",
    "exact_groups",
    "find_secrets",
    "fit_language_network",
    "fit_quality",
    "folded",
    "host_reputation",
    "jaccard_components",
    "merkle_manifest",
    "pack_documents",
    "predict_language",
    "quality_features",
    "quality_rules",
    "redact",
    "rendezvous_shards",
    "row_digest",
    "score_quality",
    "siblings",
    "spelling_groups",
    "token_counts",
    "train_markov",
]
